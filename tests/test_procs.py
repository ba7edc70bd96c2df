import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from keystrata.functions.types import EngineError
from keystrata.procs import seckill, tpcc, vote, wallet, ycsb


def test_tpcc(engine):
    engine.install(tpcc)
    s = engine.session()
    call = lambda name, *a: engine.invoke("tpcc", "tpcc", name, *a, session=s)
    call("seed", 2, 1, 2, 5, 20)
    assert call("new_order", 1, 1, 1, [1, 2], [1, 2], [12, 3]) == "order=1;lines=2;qty=15;amount=33;all_local=false;status=NEW"
    assert tuple(s.one("SELECT s_quantity, s_ytd, s_order_cnt, s_remote_cnt FROM stock WHERE s_w_id = 1 AND s_i_id = 1")) == (99, 12, 1, 0)
    assert tuple(s.one("SELECT s_quantity, s_ytd, s_order_cnt, s_remote_cnt FROM stock WHERE s_w_id = 2 AND s_i_id = 2")) == (17, 3, 1, 1)
    assert call("payment", 1, 1, 1, 7) == Decimal("-7.00")
    assert s.one("SELECT w_ytd FROM warehouse WHERE w_id = 1").w_ytd == Decimal("7.00")
    assert call("order_status", 1, 1, 1) == "NEW"
    assert call("delivery", 1, 1, 4) == "delivered order=1 carrier=4"
    assert call("order_status", 1, 1, 1) == "DELIVERED"
    assert call("stock_level", 1, 1, 21) == 4
    with pytest.raises(EngineError, match="no pending"):
        call("delivery", 1, 1, 4)
    with pytest.raises(EngineError, match="local"):
        call("new_order_partitioned", 1, 1, 1, [1], [2], [1])
    with pytest.raises(EngineError):
        call("new_order", 1, 1, 1, [99], [1], [1])  # rolled back as a whole
    assert s.one("SELECT d_next_o_id FROM district WHERE d_w_id = 1 AND d_id = 1").d_next_o_id == 2
    assert engine.apps()["tpcc"] and engine.uninstall("tpcc") > 5


def test_seckill(engine, spark):
    engine.install(seckill)
    call = lambda name, *a: engine.invoke("seckill", "seckill", name, *a)
    call("seed", 1, 1)
    assert [call("buy", 1, n, 5, 1, "x") for n in (1, 2)] == ["ok", "sold_out"]
    items = spark.createDataFrame([(1, 2)], "si_id int, si_stock int")
    asked = spark.createDataFrame([(1, 5), (1, 3), (1, 9), (2, 1)], "si_id int, xid int")
    assert {r.xid: r.result for r in seckill.buy_set(items, asked).collect()} == {3: "ok", 5: "ok", 9: "sold_out", 1: "sold_out"}


def test_ycsb(engine):
    engine.install(ycsb)
    call = lambda name, *a: engine.invoke("ycsb", "ycsb", name, *a)
    call("insert", "a", "1")
    call("insert", "b", "2")
    call("update", "a", "3")
    assert call("read", "a") == "3" and call("read_modify_write", "b", "!") == "2!"
    assert call("scan", "a", "c") == ["user:a=3", "user:b=2!"]
    with pytest.raises(EngineError):
        call("update", "zz", "1")


def test_wallet(engine):
    engine.install(wallet)
    s = engine.session()
    call = lambda name, *a: engine.invoke("wallet", "wallet", name, *a, session=s)
    call("create_user", 1, "A", "a@x")
    call("create_user", 2, "B", "b@x")
    call("deposit", 1, 50)
    call("transfer", 1, 2, 20)
    call("purchase", 2, 5, "tea")
    with pytest.raises(EngineError, match="insufficient"):
        call("withdraw", 2, 99)
    assert sorted(tuple(r) for r in s.query("SELECT user_id, balance FROM wallets").collect()) == [(1, 30), (2, 15)]
    assert s.one("SELECT COUNT(*) AS n FROM transactions").n == 3
    call("update_user", 1, "AA", "")
    with pytest.raises(EngineError, match="not zero"):
        call("delete_user", 1)


def test_vote(engine):
    engine.install(vote)
    s = engine.session()
    call = lambda name, *a: engine.invoke("vote", "vote", name, *a, session=s)
    v = call("create_vote", "me", "topic", "multiple", 2, int(time.time()) + 1000, "always")
    a, b = call("add_option", v, "x"), call("add_option", v, "y")
    call("cast_vote", "u1", v, [a, b])
    call("cast_vote", "u2", v, [a])
    with pytest.raises(EngineError, match="active"):
        call("cast_vote", "u2", v, [b])
    call("withdraw_vote", "u2", v)
    got = call("get_vote_result", v)
    assert got["total_votes"] == 1 and got["options"] == {a: 1, b: 1}
    assert [h["is_withdrawn"] for h in call("get_voting_history", "u2")] == [1]
    assert vote.results(s.table("vote_choices"), s.table("vote_actions")).agg(F.sum("n")).first()[0] == 2
