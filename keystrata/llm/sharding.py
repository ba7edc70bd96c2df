"""Operator 9 [native]: histogram sort into shards of equal bytes.

The order is that of an integer key. Candidate boundaries ("probes") cut the key space; one aggregation counts the exact
bytes below each of them over all partitions; each splitter then keeps the cell that holds its target and cuts that cell
again, until the bytes below it are within tolerance of the target or no key lies between. Then rows are exchanged once:
every shard is dealt in several key ranges, so that no task has to hold a shard, and a row's slot is its place in its
range plus the exact counts of the ranges before it.

Only DataFrame functions are used. What reaches the driver are sums for probes: (shards - 1) * probes rows a round.

Defined results: rows with equal keys stay together in one shard, in an order by (key, tie columns); rows with a null
key come first; null sizes count as 0; no rows give no rows; other columns are carried along, except that columns named
shard or slot are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm.common import partitions

LOWEST = -(1 << 63)
#: Key ranges for each shard at most: bounds are compared in one expression, which must stay small enough to compile.
MOST_RANGES = 64


def _cases(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are <= key, by binary decisions."""
    if not bounds:
        return F.lit(0)

    def node(lo: int, hi: int) -> Column:  # the answer lies in lo..hi
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(key >= F.lit(bounds[mid - 1]), node(mid, hi)).otherwise(node(lo, mid - 1))

    return node(0, len(bounds))


def splitters(rows: DataFrame, parts: int, probes: int = 64, tolerance: float = 0.0) -> tuple[list[int], int, int]:
    """Keys b1 <= ... <= b(parts-1): part i holds keys in [b(i), b(i+1)). rows has k (long) and w (long). Also the rounds
    it took and all bytes.

    A splitter is final when the bytes below it differ from its target by at most tolerance (in bytes), or when its cell
    has been cut down to one key; then the nearer side of that key is taken.
    """
    low, high, total = rows.agg(F.min("k"), F.max("k"), F.sum("w")).first()
    if low is None or parts < 2:
        return [low or 0] * (parts - 1), 0, total or 0
    targets = [total * i // parts for i in range(1, parts)]
    # a cell: [lo, hi) with the bytes below lo and below hi
    cells = [(low, high + 1, 0, total)] * (parts - 1)
    final: dict[int, int] = {}
    rounds = 0
    while True:
        for i, (lo, hi, below, upto) in enumerate(cells):
            if i not in final:
                near, far = targets[i] - below, upto - targets[i]
                if min(near, far) <= tolerance or hi - lo == 1:
                    final[i] = lo if near <= far else hi
        live = sorted({cells[i] for i in range(parts - 1) if i not in final})
        if not live:
            break
        rounds += 1
        steps = {c: max(1, -(-(c[1] - c[0]) // probes)) for c in live}
        edges = sorted({x for c in live for x in c[:2]})
        spot = _cases(F.col("k"), edges)  # which stretch between edges a key lies in
        starts = {edges.index(c[0]) + 1: c for c in live}
        cell = F.lit(None).cast("long")
        for at, c in sorted(starts.items(), reverse=True):
            if c[1] - c[0] < 1 << 62:
                number = F.expr(f"(k - ({c[0]}L)) div {steps[c]}L")
            else:  # the difference may not fit a long
                number = F.expr(f"floor((cast(k as decimal(20,0)) - ({c[0]}BD)) / {steps[c]}BD)").cast("long")
            cell = F.when(F.col("spot") == at, number).otherwise(cell)
        counted = rows.withColumn("spot", spot).where(F.col("spot").isin(list(starts))).withColumn("cell", cell).groupBy("spot", "cell").agg(F.sum("w").alias("w")).collect()
        sums: dict[int, dict[int, int]] = {}
        for r in counted:
            sums.setdefault(r.spot, {})[r.cell] = r.w
        for i, c in enumerate(cells):
            if i in final:
                continue
            lo, hi, below, _ = c
            step, of = steps[c], sums.get(edges.index(lo) + 1, {})
            for n in sorted(of):
                upto = below + of[n]
                if upto >= targets[i]:
                    cells[i] = (lo + n * step, min(hi, lo + (n + 1) * step), below, upto)
                    break
                below = upto
    return [final[i] for i in range(parts - 1)], rounds, total


def shard_by_bytes(df: DataFrame, key: str, size: str, shards: int = 16, ranges: int | None = None, ties: list[str] | None = None, probes: int = 64, tolerance: float = 0.0) -> DataFrame:
    """df with shard (0 to shards-1, in key order, near equal sums of size) and slot (gapless from 0 in each shard).

    df is read several times, so give a narrow or materialised one. ranges: how many key ranges deal out one shard.
    """
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(LOWEST + 1)).alias("k"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("w"))
    ranges = ranges or min(MOST_RANGES, max(1, -(-partitions(spark) // shards)))
    fine, _, _ = splitters(rows, shards * ranges, probes, tolerance)
    bounds = sorted(fine)
    k = F.coalesce(F.col(key).cast("long"), F.lit(LOWEST + 1))
    part = _cases(k, bounds)
    held = {r.part: r.n for r in rows.withColumn("part", _cases(F.col("k"), bounds)).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    base, sofar = [], 0
    for p in range(shards * ranges):
        if p % ranges == 0:
            sofar = 0
        base.append(sofar)
        sofar += held.get(p, 0)
    dealt = df.drop("shard", "slot").withColumn("_part", part).repartitionById(shards * ranges, F.col("_part"))
    own = Window.partitionBy("_part").orderBy(F.col(key).asc_nulls_first(), *(ties or []))
    slot = F.row_number().over(own).cast("long") - 1 + F.element_at(F.array(*[F.lit(b).cast("long") for b in base]), F.col("_part") + 1)
    return dealt.withColumn("shard", F.floor(F.col("_part") / ranges).cast("int")).withColumn("slot", slot).drop("_part")
