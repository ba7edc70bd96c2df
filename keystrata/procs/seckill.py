"""Flash sale: buy while stock lasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.operators.dml import Delta
from keystrata.operators.ranks import numbered
from keystrata.plans.engine import Session
from keystrata.procs.tpcc import positive

NAME = "seckill"
#: Table schemas. Fixed values.
DDL = """
CREATE TABLE seckill_item (si_id INTEGER PRIMARY KEY, si_name TEXT, si_stock INTEGER, si_sold INTEGER, si_price INTEGER);
CREATE TABLE seckill_order (so_item_id INTEGER NOT NULL, so_id INTEGER NOT NULL, so_user_id INTEGER, so_amount INTEGER, so_payload TEXT, PRIMARY KEY (so_item_id, so_id));
"""


def seed(s: Session, items: int, initial_stock: int) -> None:
    positive(items=items, initial_stock=initial_stock)
    i = s.engine.spark.range(1, items + 1)
    s.insert_frame("seckill_item", i.select(F.col("id").alias("si_id"), F.concat(F.lit("promo-item-"), "id").alias("si_name"), F.lit(initial_stock).alias("si_stock"), F.lit(0).alias("si_sold"), F.lit(100).alias("si_price")))


def buy(s: Session, item: int, order: int, user: int, amount: int, payload: str) -> str:
    """ "ok", or "sold_out" with nothing changed."""
    positive(item=item, order=order, user=user, amount=amount)
    row = s.relation_get("seckill_item", {"si_id": item}, ["si_stock"])
    if row is None or (row.si_stock or 0) <= 0:
        return "sold_out"
    s.relation_update("seckill_item", {"si_id": item}, deltas=[Delta("si_stock", "sub", 1), Delta("si_sold", "add", 1)])
    s.relation_insert("seckill_order", {"so_item_id": item, "so_id": order, "so_user_id": user, "so_amount": amount, "so_payload": payload})
    return "ok"


def buy_set(items: DataFrame, requests: DataFrame) -> DataFrame:
    """Many requests (si_id, xid) at once: the first si_stock of each item, by xid, get "ok"."""
    asked = numbered(requests, ["si_id"], "xid", "_n").join(items.select("si_id", "si_stock"), "si_id", "left")
    return asked.withColumn("result", F.when(F.col("_n") <= F.col("si_stock"), "ok").otherwise("sold_out")).drop("_n", "si_stock")


#: The names for partitioned schemas are aliases.
PROCEDURES = {"seed": seed, "buy": buy, "seed_partitioned": seed, "buy_partitioned": buy}
