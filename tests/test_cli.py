from keystrata.cli import main


def test_commands(spark, tmp_path, capsys):
    root = str(tmp_path / "db")
    assert main([root, "command", "CREATE TABLE t (id INT PRIMARY KEY, v TEXT)", "INSERT INTO t VALUES (1, 'a')", "SELECT id, v FROM t"], spark) == 0
    assert capsys.readouterr().out.splitlines() == ["0 row(s)", "1 row(s)", "1\ta"]
    assert main([root, "put", "k", "v"], spark) == 0 and main([root, "get", "k"], spark) == 0 and main([root, "range"], spark) == 0
    assert capsys.readouterr().out.splitlines() == ["v", "k\tv"]
    assert main([root, "get", "nope"], spark) == 1 and main([root, "command", "DROP TABLE nope"], spark) == 1 and main([root], spark) == 2
    assert main([root, "command", "CREATE PARTITION RULE r RANGE (a) (PARTITION p VALUES FROM (MINVALUE) TO (MAXVALUE))"], spark) == 0
    assert main([root, "partition-route", "r", "5"], spark) == 0 and capsys.readouterr().out.splitlines()[-1] == "p None"


def test_packages_and_topology(spark, tmp_path, capsys):
    root = str(tmp_path / "db")
    assert main([root, "app-install", "kv"], spark) == 0 and "kv_read" in capsys.readouterr().out
    assert main([root, "invoke", "kv", "kv_insert", "a", "x"], spark) == 0 and main([root, "app-invoke", "kv", "kv_read", "a"], spark) == 0
    assert capsys.readouterr().out.splitlines() == ["None", "x"]
    assert main([root, "app-list"], spark) == 0 and "tpcc" in capsys.readouterr().out.split()
    assert main([root, "app-detail", "vote"], spark) == 0 and main([root, "app-detail", "nope"], spark) == 1
    capsys.readouterr()
    assert main([root, "command", "CREATE PARTITION RULE r RANGE (a) (PARTITION p VALUES FROM (MINVALUE) TO (MAXVALUE))", "CREATE PARTITION PLACEMENT FOR RULE r (PARTITION p ON WORKER 2)"], spark) == 0
    assert main([root, "server-topology"], spark) == 0 and capsys.readouterr().out.splitlines()[-1] == "r\tp\t2"
