from decimal import Decimal

import pytest

from keystrata.functions.types import EngineError
from keystrata.plans import parser as P
from keystrata.plans.parser import parse, split_script


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- parser -------------------------------------------------------------------------------------------------------------
def test_select_shapes():
    s, n = parse("SELECT a, t.b AS c FROM s.t WHERE (a = ? AND b <= 5) AND 7 > c")
    assert isinstance(s, P.Select) and n == 1
    assert s.terms == [("", "a", "a"), ("", "b", "c")] and s.where == [("a", "=", P.Param(0)), ("b", "<=", 5), ("c", "<", 7)]
    assert parse("select count(*), sum(v) total from t")[0].terms == [("count", None, "count"), ("sum", "v", "total")]


@pytest.mark.parametrize("text", ["SELECT a FROM t ORDER BY a", "SELECT a FROM t WHERE a = 1 OR b = 2", "SELECT upper(a) FROM t", "SELECT t.a FROM t JOIN u ON t.a = u.a", "SELECT a, count(*) FROM t GROUP BY a", "SELECT a + 1 FROM t", "SELECT a FROM t WHERE a BETWEEN 1 AND 2"])
def test_general_queries_go_to_spark(text):
    assert isinstance(parse(text)[0], P.Native)


@pytest.mark.parametrize("text", ["UPDATE t SET a = 1", "DELETE FROM t", "INSERT INTO t SELECT 1", "UPDATE t SET a = b + 1 WHERE k = 1", "ALTER TABLE t ADD c INT", "CREATE TABLE t (a BOOLEAN)", "CREATE TABLE t (a INT PRIMARY KEY, b INT PRIMARY KEY)", "SELECT a FROM t; garbage"])
def test_rejected(text):
    with pytest.raises(EngineError):
        parse(text)


def test_strings_and_scripts():
    assert parse("INSERT INTO t VALUES ('it''s ? ; x', -5, 2.50, NULL)")[0].rows == [["it's ? ; x", -5, Decimal("2.50"), None]]
    assert split_script("a 'x;y'; b -- c;\n; ;") == ["a 'x;y'", "b -- c;"]


# --- statements ---------------------------------------------------------------------------------------------------------
@pytest.fixture()
def session(engine):
    s = engine.session()
    s.execute("CREATE TABLE t (id INT PRIMARY KEY, v INT NOT NULL, note TEXT, price NUMERIC(12,2))")
    s.execute("INSERT INTO t (id, v, note, price) VALUES (1, 10, 'a', 1.255), (2, 20, NULL, ?)", (Decimal("7"),))
    return s


def test_crud(session):
    s = session
    assert rows(s.query("SELECT id, v, note, price FROM t")) == [(1, 10, "a", Decimal("1.26")), (2, 20, None, Decimal("7.00"))]
    assert s.execute("UPDATE t SET v = v + 5, note = 'b' WHERE id = 1") == 1
    assert s.execute("UPDATE t SET v = 0 WHERE id = 99") == 0
    assert s.execute("DELETE FROM t WHERE id = ?", (2,)) == 1
    assert rows(s.query("SELECT * FROM t")) == [(1, 15, "b", Decimal("1.26"))]
    assert s.one("SELECT COUNT(*) AS n, AVG(v) AS m FROM t WHERE id = 1").m == Decimal("15.000000")


def test_errors(session):
    s = session
    for text, code in [
        ("INSERT INTO t (id, v) VALUES (1, 1)", "duplicate_key"),
        ("INSERT INTO t (id) VALUES (5)", "null_value"),
        ("INSERT INTO t (id, v) VALUES (NULL, 1)", "null_value"),
        ("INSERT INTO t (id, v) VALUES (5)", "invalid_argument"),
        ("UPDATE t SET id = 7 WHERE id = 1", "immutable_key"),
        ("DELETE FROM t WHERE v = 10", "not_implemented"),
        ("UPDATE t SET v = 1 WHERE id = 1 AND v = 10", "not_implemented"),
        ("CREATE TABLE t (id INT)", "already_exists"),
        ("DROP TABLE nope", "not_found"),
        ("INSERT INTO nope VALUES (1)", "not_found"),
    ]:
        with pytest.raises(EngineError) as e:
            s.execute(text)
        assert e.value.code == code, text
    assert not s.in_transaction and s.one("SELECT COUNT(*) AS n FROM t").n == 2


def test_compat_default(spark, tmp_path):
    from keystrata.plans.engine import Engine

    s = Engine(spark, str(tmp_path / "c"), compat=frozenset({"default_for_not_null"})).session()
    s.execute("CREATE TABLE t (id INT PRIMARY KEY, v INT NOT NULL)")
    s.execute("INSERT INTO t (id) VALUES (1)")
    assert rows(s.query("SELECT id, v FROM t")) == [(1, 0)]


def test_transactions(engine, session):
    s, other = session, engine.session()
    s.execute("BEGIN")
    with pytest.raises(EngineError):
        s.execute("BEGIN")
    s.execute("UPDATE t SET v = 99 WHERE id = 1")
    assert s.one("SELECT v FROM t WHERE id = 1").v == 99 and other.one("SELECT v FROM t WHERE id = 1").v == 10
    s.execute("ROLLBACK")
    assert s.one("SELECT v FROM t WHERE id = 1").v == 10
    s.execute("BEGIN")
    s.execute("UPDATE t SET v = 1 WHERE id = 1")
    other.execute("UPDATE t SET v = 2 WHERE id = 1")
    with pytest.raises(EngineError, match="conflict"):
        s.execute("COMMIT")
    assert rows(s.query("SELECT id, v FROM t")) == [(1, 2), (2, 20)]
    s.execute("BEGIN")
    s.execute("UPDATE t SET v = 11 WHERE id = 1")
    other.execute("UPDATE t SET v = 22 WHERE id = 2")  # another key
    other.execute("INSERT INTO t (id, v) VALUES (3, 3)")
    s.execute("COMMIT")
    assert rows(s.query("SELECT id, v FROM t")) == [(1, 11), (2, 22), (3, 3)]
    s.execute("BEGIN")
    s.execute("INSERT INTO t (id, v) VALUES (4, 1)")
    other.execute("INSERT INTO t (id, v) VALUES (4, 2)")
    with pytest.raises(EngineError, match="conflict"):
        s.execute("COMMIT")
    other.execute("DELETE FROM t WHERE id = 4")
    other.execute("DELETE FROM t WHERE id = 3")
    s.close()
    with pytest.raises(EngineError):
        s.execute("BEGIN")


def test_increments_commute(engine, session):
    s, other = session, engine.session()
    v = lambda: s.one("SELECT v FROM t WHERE id = 1").v
    s.begin()
    s.execute("UPDATE t SET v = v + 5 WHERE id = 1")
    s.execute("UPDATE t SET v = v - 1 WHERE id = 1")
    other.execute("UPDATE t SET v = v + 100 WHERE id = 1")
    other.execute("UPDATE t SET note = 'other' WHERE id = 1")
    s.commit()
    assert tuple(s.one("SELECT v, note FROM t WHERE id = 1")) == (114, "other")
    s.begin()
    s.execute("UPDATE t SET v = v + 1 WHERE id = 1")
    assert v() == 115  # read since: what follows may depend on it
    other.execute("UPDATE t SET v = v + 1 WHERE id = 1")
    with pytest.raises(EngineError, match="conflict"):
        s.commit()
    s.begin()
    s.execute("UPDATE t SET v = v + 1 WHERE id = 1")
    other.execute("DELETE FROM t WHERE id = 1")
    with pytest.raises(EngineError, match="conflict"):
        s.commit()
    s.begin()
    s.execute("UPDATE t SET v = v + 1 WHERE id = 2")
    engine.storage.compact("t")
    s.commit()
    assert s.one("SELECT v FROM t WHERE id = 2").v == 21


def test_batch_is_atomic(session):
    s = session
    assert s.batch("INSERT INTO t (id, v) VALUES (3, 1); UPDATE t SET v = 7 WHERE id = 3") == 2
    with pytest.raises(EngineError):
        s.batch("INSERT INTO t (id, v) VALUES (4, 1); INSERT INTO t (id, v) VALUES (4, 1)")
    assert rows(s.query("SELECT id, v FROM t WHERE id >= 3")) == [(3, 7)]


def test_restart(spark, session, engine):
    from keystrata.plans.engine import Engine

    again = Engine(spark, engine.storage.root).session()
    assert again.one("SELECT COUNT(*) AS n FROM t").n == 2
    engine.storage.compact("t")
    assert engine.storage.vacuum() == 0  # young folders stay
    assert engine.storage.vacuum(grace=0) >= 1 and again.one("SELECT COUNT(*) AS n FROM t").n == 2


def test_general_sql_describe_prepare_explain(session):
    s = session
    assert rows(s.query("SELECT note, sum(v) AS s FROM t WHERE id > ? GROUP BY note ORDER BY 2", (0,))) == [("a", 10), (None, 20)]
    assert s.describe("SELECT id AS x, price FROM t WHERE v = ?").names == ["x", "price"]
    p = s.prepare("SELECT v FROM t WHERE id = $1")
    assert (p.query(1).first().v, p.bind(2).query().first().v, p.params) == (10, 20, 1)
    assert "path key" in s.one("EXPLAIN SELECT v FROM t WHERE id = 1").plan
    assert s.access_path("SELECT v FROM t WHERE id > 1").kind == "range"
    assert s.query("SELECT DISTINCT note FROM t WHERE note = 'zz'").count() == 0


def test_copy(session, tmp_path):
    s, path = session, str(tmp_path / "out")
    assert s.execute(f"COPY t TO '{path}'") == 2
    s.execute("CREATE TABLE u (id INT PRIMARY KEY, v INT NOT NULL, note TEXT, price NUMERIC(12,2))")
    assert s.execute(f"COPY u FROM '{path}'") == 2
    assert rows(s.query("SELECT * FROM u")) == rows(s.query("SELECT * FROM t"))
    with pytest.raises(EngineError, match="duplicate_key"):
        s.execute(f"COPY u FROM '{path}'")
    (tmp_path / "in.csv").write_text("id,name\n1,Alice\n2,\"Bob\"\n")
    s.execute("CREATE TABLE p (id INT PRIMARY KEY, name TEXT)")
    assert s.execute(f"COPY p FROM '{tmp_path}/in.csv'") == 2
    assert rows(s.query("SELECT id, name FROM p")) == [(1, "Alice"), (2, "Bob")]
    (tmp_path / "lines.csv").write_text('id,name\n3,"two\nlines"\n4,"a ""quoted"" one"\n')
    assert s.execute(f"COPY p FROM '{tmp_path}/lines.csv'") == 2
    assert rows(s.query("SELECT id, name FROM p WHERE id > 2")) == [(3, "two\nlines"), (4, 'a "quoted" one')]


def test_partitions(engine):
    s = engine.session()
    s.execute("CREATE PARTITION RULE r_orders RANGE (region_id, order_id) (PARTITION p0 VALUES FROM (MINVALUE, MINVALUE) TO (1000, MINVALUE), PARTITION p1 VALUES FROM (1000, MINVALUE) TO (2000, MINVALUE), PARTITION p2 VALUES FROM (2000, MINVALUE) TO (MAXVALUE, MAXVALUE))")
    s.execute("CREATE TABLE o (region_id BIGINT, order_id BIGINT, amount BIGINT, PRIMARY KEY(region_id, order_id)) PARTITION BY GLOBAL RULE r_orders REFERENCES (region_id, order_id)")
    s.execute("CREATE PARTITION PLACEMENT FOR RULE r_orders (PARTITION p0 ON WORKER 1, PARTITION p1 ON WORKER 2)")
    assert engine.route("r_orders", (1000, 1)) == ("p1", 2)
    assert s.partitions_of("SELECT amount FROM o WHERE region_id = 5 AND order_id = 1") == ["p0"]
    assert s.partitions_of("SELECT amount FROM o WHERE region_id >= 1500") == ["p1", "p2"]
    assert s.partitions_of("SELECT amount FROM o WHERE region_id = 1000") == ["p1"]
    assert s.catalog().rule_rows(engine.spark).count() == 3 and s.catalog().placement_rows(engine.spark).count() == 2
    assert s.insert_frame("o", engine.spark.range(3000).selectExpr("id as region_id", "id * 2 as order_id", "id as amount")) == 3000
    for compacted in (False, True):
        plan = s.query("SELECT amount FROM o WHERE region_id >= 1500 AND region_id < 1600")
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert plan.count() == 100 and "part_id" in text.split("PartitionFilters: [")[1].split("PushedFilters")[0] and "p1" in text
        files = plan.inputFiles()
        assert rows(s.query("SELECT amount FROM o WHERE region_id = 7 AND order_id = 14")) == [(7,)]
        assert s.query("SELECT amount FROM o WHERE region_id = 7 AND order_id = 15").count() == 0
        s.execute("UPDATE o SET amount = 0 WHERE region_id = 1500 AND order_id = 3000")
        assert rows(s.query("SELECT amount FROM o WHERE region_id = 1500")) == [(0,)] and files
        engine.storage.compact("o")
    s.execute("CREATE PARTITION RULE r_few RANGE (a) (PARTITION p VALUES FROM (0) TO (10))")
    s.execute("CREATE TABLE few (a INT PRIMARY KEY) PARTITION BY GLOBAL RULE r_few REFERENCES (a)")
    s.execute("INSERT INTO few VALUES (9)")
    with pytest.raises(EngineError, match="no partition"):
        s.execute("INSERT INTO few VALUES (10)")
    assert rows(s.query("SELECT * FROM few")) == [(9,)] and s.query("SELECT a FROM few WHERE a = 10").count() == 0


def test_a_point_read_opens_few_row_groups(spark, engine):
    """A base is sorted by key and dealt by key range: the statistics of all files but one rule a key out."""
    import pyarrow.parquet as pq

    s = engine.session()
    s.execute("CREATE TABLE t (id INT PRIMARY KEY, v INT)")
    s.insert_frame("t", spark.range(100_000).selectExpr("cast(hash(id) as int) id", "cast(id as int) v").dropDuplicates(["id"]).repartition(8))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        engine.storage.compact("t")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [f.removeprefix("file://") for f in s.table("t").inputFiles()]
    assert len(files) > 1
    held = []
    for f in files:
        meta = pq.ParquetFile(f).metadata
        held += [(meta.row_group(i).column(0).statistics.min, meta.row_group(i).column(0).statistics.max) for i in range(meta.num_row_groups)]
    key = s.table("t").limit(1).first().id
    assert sum(lo <= key <= hi for lo, hi in held) == 1
    assert "EqualTo(id" in s.query(f"SELECT v FROM t WHERE id = {key}" if key >= 0 else "SELECT v FROM t WHERE id = ?", () if key >= 0 else (key,))._jdf.queryExecution().executedPlan().toString()


def test_entities_and_order(engine, session):
    import dataclasses

    @dataclasses.dataclass
    class Item:
        id: int
        v: int
        note: str | None = None

    s = session
    s.put_entity("t", Item(9, 90, "n"))
    s.put_entity("t", Item(5, 50))
    assert s.entities("t", Item, {"id": 5}) == [Item(5, 50)] and len(s.entities("t", Item)) == 4
    assert [r.id for r in s.query("SELECT id FROM t", ordered=True).collect()] == [1, 2, 5, 9]
    assert s.relation_delete("t", {"id": 9}) == 1 and s.relation_delete("t", {"id": 9}) == 0


def test_file_types(engine):
    s = engine.session()
    s.execute("CREATE TYPE doc FILESYSTEM FILE")
    s.execute("CREATE TABLE f (id INT PRIMARY KEY, body doc)")
    s.execute("INSERT INTO f (id) VALUES (1)")
    first = s.one("SELECT body FROM f WHERE id = 1").body
    s.execute("UPDATE f SET body = NULL WHERE id = 1")
    assert len(first) == 32 and s.one("SELECT body FROM f WHERE id = 1").body not in (None, first)
    with pytest.raises(EngineError, match="in_use"):
        s.execute("DROP TYPE doc")


def test_objects(spark, tmp_path):
    from keystrata.sources.objects import Objects, new_id

    o, key = Objects(spark, str(tmp_path / "fs")), new_id()
    o.write(key, "d/a.bin", b"0123456789")
    assert bytes(o.read(key, "d/a.bin").first().content) == b"0123456789"
    assert o.pread(key, "d/a.bin", 3, 4) == b"3456" and bytes(o.pieces(key, "d", 3, 4).first().content) == b"3456"
    o.pwrite(key, "d/a.bin", 12, b"xy")
    o.pwrite(key, "d/b.bin", 0, b"first")
    assert o.pread(key, "d/a.bin") == b"0123456789\0\0xy" and o.pread(key, "d/b.bin", 1) == b"irst"
    o.write(key, "d/a.bin", b"0123456789")
    assert o.remove(key, "d/b.bin") and not o.remove(key, "d/b.bin")
    assert o.stat(key).first().length == 10 and o.readdir(key) == [("d", True, 0)] or o.readdir(key)[0][0] == "d"
    with pytest.raises(EngineError):
        o.read(key, "../x")


def test_foreign_urls():
    from keystrata.sources.foreign import options

    assert options("postgres://u:p@h:5433/db")["url"] == "jdbc:postgresql://h:5433/db" and options("postgres://u:p@h/db")["user"] == "u"
    assert options("sqlite:///tmp/x.db")["url"] == "jdbc:sqlite:tmp/x.db"
    with pytest.raises(EngineError):
        options("oracle://x")


def test_foreign_tables(spark, tmp_path):
    from keystrata.sources import foreign

    url = f"derby://{tmp_path}/db"
    foreign.write(spark.range(100).selectExpr("id as k", "cast(id % 7 as int) as v"), url, "numbers")
    df = foreign.read(spark, url, "numbers", split=("k", 0, 100, 3)).where("v = 3").select("k")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.rdd.getNumPartitions() == 3 and "EqualTo(v,3)" in plan
    assert rows(df) == sorted(((i,) for i in range(100) if i % 7 == 3), key=str)
    assert foreign.read(spark, url, query="SELECT count(*) AS n FROM numbers").first()[0] == 100
    foreign.write(spark.range(5).selectExpr("id as k", "1 as v"), url, "numbers", "overwrite")
    assert foreign.read(spark, url, "numbers").count() == 5


def test_key_value(engine):
    s = engine.session()
    for k, v in ((b"b", b"2"), (b"a", b"1"), (b"c", b"3")):
        s.put(k, v)
    assert s.get(b"b") == b"2" and s.get(b"x") is None
    assert [bytes(r.key) for r in s.range(b"a", b"c").collect()] == [b"a", b"b"] and s.range(b"b").count() == 2
    s.begin()
    s.put(b"b", b"9")
    s.delete(b"a")
    engine.session().put(b"z", b"0")
    assert [bytes(r.value) for r in s.range().collect()] == [b"9", b"3"]  # the snapshot of BEGIN and the own writes
    s.rollback()
    assert s.range().count() == 4


def test_streaming(spark, engine, tmp_path):
    from keystrata.streaming.changes import follow

    s = engine.session()
    s.execute("CREATE TABLE t (k INT PRIMARY KEY, v TEXT)")
    src = str(tmp_path / "log")
    spark.createDataFrame([(1, "a", 1, "P"), (2, "b", 2, "P"), (1, "c", 3, "P"), (2, None, 4, "D")], "k int, v string, xid long, op string").coalesce(1).write.parquet(src)
    follow(spark.readStream.schema("k int, v string, xid long, op string").parquet(src), "t", engine, str(tmp_path / "cp")).awaitTermination(60)
    assert rows(s.query("SELECT k, v FROM t")) == [(1, "c")]


def test_a_commit_writes_what_it_changes(spark, engine, monkeypatch):
    from keystrata.sources import storage

    monkeypatch.setattr(storage, "MOST_DELTAS", 3)
    s = engine.session()
    s.execute("CREATE TABLE t (id INT PRIMARY KEY, v INT)")
    s.insert_frame("t", spark.range(1000).selectExpr("cast(id as int) id", "cast(id as int) v"))
    engine.storage.compact("t")
    entry = lambda: engine.storage.manifest(engine.storage.latest())[1]["t"]
    base = entry()["base"]
    s.begin()
    s.execute("UPDATE t SET v = v + 1 WHERE id = 5")
    s.execute("UPDATE t SET v = v + 1 WHERE id = 5")
    s.execute("DELETE FROM t WHERE id = 6")
    s.execute("INSERT INTO t VALUES (2000, 1)")
    s.execute("DELETE FROM t WHERE id = 2000")
    s.commit()
    assert entry()["base"] == base and len(entry()["deltas"]) == 1
    assert spark.read.parquet(f"{engine.storage.root}/{entry()['deltas'][0]}").count() == 3
    for v in (8, 9):
        s.execute("UPDATE t SET v = ? WHERE id = 7", (v,))
    assert len(entry()["deltas"]) == 1  # merged
    want = [(i, {5: 7, 7: 9}.get(i, i)) for i in range(1000) if i != 6]
    assert sorted(map(tuple, s.query("SELECT id, v FROM t").collect())) == want
    s.execute("INSERT INTO t VALUES (6, 60)")
    engine.storage.compact("t")
    assert entry()["deltas"] == [] and s.query("SELECT v FROM t WHERE id = 6").first().v == 60
    plan = s.query("SELECT v FROM t WHERE id = 5")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,5)" in plan
