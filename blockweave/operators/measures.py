"""Measures of a block collection: pairs completeness, pairs quality and reduction ratio.

Blocks are rows (block_id, id), entities rows (id, label). A member counts once in a block. Entities in no block
still count in n and in the pairs that duplicates should make.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import shared_table

#: Groups of an id up to which its pairs are counted by sets: an id has 2 ** MOST_GROUPS sets of groups at most. Ids of a tile.
MOST_GROUPS, TILE = 8, 512
RESULT = ("pc", "pq", "rr", "db", "b")


def label_frequency(entities: DataFrame) -> DataFrame:
    return entities.groupBy("label").agg(F.count("*").alias("n"))


def _choose2(n):
    return n * (n - 1) / 2


def members(blocks: DataFrame) -> DataFrame:
    return blocks.select("block_id", "id").dropDuplicates()


def _pairs(m: DataFrame, *keys: str) -> DataFrame:
    """Distinct pairs i < j that share ``keys``. A pair is made where its ids meet first: each row has its id's keys before
    its own, and ids that share one of these met there. So pairs are neither shuffled nor kept to find repeated ones."""
    of = m.groupBy("id").agg(F.sort_array(F.collect_set(F.struct(*keys))).alias("of"))
    rows = of.select("id", "of", F.posexplode("of").alias("at", "key")).select("id", *[F.col(f"key.{c}").alias(c) for c in keys], F.slice("of", F.lit(1), F.col("at")).alias("before"))
    left, right = (rows.select(*keys, F.col("id").alias(c), F.col("before").alias(f"before_{c}")) for c in "ij")
    return left.join(right, list(keys)).filter(F.col("i") < F.col("j")).filter(~F.arrays_overlap("before_i", "before_j")).select("i", "j")


def duplicate_pairs(entities: DataFrame, blocks: DataFrame) -> DataFrame:
    """Distinct pairs of one label that stand together in a block. The label is part of the join key, so a block's
    pairs of unlike labels are never made."""
    return _pairs(members(blocks).join(entities, "id"), "block_id", "label")


def pair_counts(m: DataFrame, keys: list[str], by: list[str], distinct: bool = True) -> DataFrame:
    """(by..., n): pairs of ids that share ``keys``, from the groups' sizes; ``distinct`` counts a pair of several groups
    once."""
    sizes = m.groupBy(*by, *keys).agg(F.count("*").alias("size"))
    total = sizes.groupBy(*by).agg(F.coalesce(F.sum(_choose2(F.col("size"))), F.lit(0.0)).alias("n"))
    if not distinct:
        return total
    again = _repeated(m.join(sizes.filter("size > 1").drop("size"), [*by, *keys], "left_semi"), keys, by)
    both = total.join(again, by, "left") if by else total.crossJoin(again)  # one row each
    return both.select(*by, (F.col("n") - F.coalesce("more", F.lit(0))).alias("n"))


def _repeated(m: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(by..., more): how often pairs of ids are counted beyond their first common group.

    For ids of at most MOST_GROUPS groups, by inclusion and exclusion, a pair of c common groups is
    counted c - 1 times too often, which is the sum over sets of two and more common groups, added for even sets and
    taken off for odd ones, and as many pairs share a set as its holders make. So the cost follows the rows, not the
    pairs. Only pairs with an id of more groups are made.
    """
    held = m.groupBy(*by, "id").agg(F.count("*").alias("groups")).filter("groups > 1")
    some = m.join(held, [*by, "id"])
    few = some.filter(F.col("groups") <= MOST_GROUPS).groupBy(*by, "id").agg(F.sort_array(F.collect_list(F.struct(*keys))).alias("of"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1), i)
    sets = F.transform(F.sequence(F.lit(1), bit(F.size("of")) - 1), lambda mask: F.filter("of", lambda x, i: mask.bitwiseAND(bit(i)) != 0))
    sets = few.select(*by, F.explode(F.filter(sets, lambda x: F.size(x) > 1)).alias("set")).groupBy(*by, "set").agg(F.count("*").alias("size")).filter("size > 1")
    counted = sets.select(*by, (F.when(F.size("set") % 2 == 0, 1).otherwise(-1) * _choose2(F.col("size"))).alias("more"))
    # Only groups with an id of many groups; each id with all its groups, as numbers.
    on, number = [*by, *keys], F.xxhash64(*keys)
    many = F.col("groups") > MOST_GROUPS
    busy = some.filter(many).select(*on).distinct()
    of = m.join(some.filter(many).select(*on).distinct(), on, "left_semi").select(*by, "id").distinct()
    lists = m.join(of, [*by, "id"], "left_semi").groupBy(*by, "id").agg(F.sort_array(F.collect_set(number)).alias("of"))
    rows = some.join(busy, on, "left_semi").select(*by, number.alias("g"), "id", many.alias("many")).join(lists, [*by, "id"])
    tiles = F.floor((F.col("size") + TILE - 1) / TILE).cast("int")
    rows = rows.join(rows.groupBy(*by, "g").agg(F.count("*").alias("size")).select(*by, "g", tiles.alias("tiles")), [*by, "g"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select(*by, "g", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "many", "of")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in m.schema.fields if f.name in by)
    told = rows.groupBy(*by, "g", "x", "y").applyInArrow(_shared_before(list(by)), kinds + "more double")
    return counted.union(told.select(*by, "more")).groupBy(*by).agg(F.sum("more").alias("more"))


def _shared_before(by: list[str]):
    """One row of a tile: how many of its pairs, one of them of many groups, share a group below the tile's own."""

    def run(t: pa.Table) -> pa.Table:
        g, own, many = t["g"][0].as_py(), np.asarray(t["own"].combine_chunks()), np.asarray(t["many"].combine_chunks())
        of = t["of"].combine_chunks()
        row = np.repeat(np.arange(len(t)), np.diff(np.asarray(of.offsets)))
        groups = np.asarray(of.flatten())
        row, (_, code) = row[groups < g], np.unique(groups[groups < g], return_inverse=True)
        held = np.zeros((len(t), int(code.max()) + 1 if len(code) else 0), np.float32)
        held[row, code] = 1
        a, b = (np.flatnonzero(own == t[c][0].as_py()) for c in ("x", "y"))
        met = (held[a] @ held[b].T > 0) & (many[a][:, None] | many[b][None])
        n = np.triu(met, 1).sum() if t["x"][0].as_py() == t["y"][0].as_py() else met.sum()
        return pa.table({**{c: t[c][:1] for c in by}, "more": pa.array([float(n)])})

    return run


def evaluate(entities: DataFrame, blocks: DataFrame, distinct: bool = False) -> DataFrame:
    """One row (pc, pq, rr, db, b). Ratios without a denominator are 0; without blocks all five are 0."""
    return evaluate_variants(entities, blocks, [distinct]).drop("variant")


def evaluate_variants(entities: DataFrame, blocks: DataFrame, variants: Sequence[bool] = (False, True)) -> DataFrame:
    """A row of measures for redundant (False) and for distinct comparisons (True), named by ``variant``. Blocks are made and
    pairs of one label counted once for both."""
    blocks = shared_table(members(blocks), "members")  # read by each of the counts below
    expected = label_frequency(entities).agg(F.coalesce(F.sum(_choose2(F.col("n"))), F.lit(0.0)).alias("de"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    db = pair_counts(blocks.join(entities, "id"), ["block_id", "label"], []).withColumnRenamed("n", "db")
    counts = [pair_counts(blocks, ["block_id"], [], d).select(F.lit("distinct" if d else "redundant").alias("variant"), F.col("n").alias("b")) for d in variants]
    b = reduce(DataFrame.union, counts)
    some = blocks.select(F.lit(1).alias("x")).limit(1).agg((F.count("*") > 0).alias("some"))
    r = b.crossJoin(F.broadcast(expected.crossJoin(db).crossJoin(some)))  # one row each
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    r = r.select(
        ratio(F.col("db"), F.col("de")).alias("pc"),
        ratio(F.col("db"), F.col("b")).alias("pq"),
        F.when(F.col("n") < 2, 0.0).otherwise(1 - ratio(F.col("b"), _choose2(F.col("n")))).alias("rr"),
        "db",
        "b",
        "some",
        "variant",
    )
    return r.select(*[F.when(F.col("some"), F.col(c)).otherwise(0.0).alias(c) for c in RESULT], "variant")


def evaluate_configs(entities: DataFrame, blocks: DataFrame, config: str = "config_id", distinct: bool = False) -> DataFrame:
    """``evaluate`` for many block collections at once, one row for each ``config`` with blocks."""
    m = shared_table(blocks.select(config, "block_id", "id").dropDuplicates(), "members")
    blocks_of = m.groupBy(config).agg(F.count_distinct("block_id").alias("blocks"))
    b = pair_counts(m, ["block_id"], [config], distinct).withColumnRenamed("n", "b").join(blocks_of, config)
    db = pair_counts(m.join(entities, "id"), ["block_id", "label"], [config]).withColumnRenamed("n", "db")
    de = label_frequency(entities).agg(F.sum(_choose2(F.col("n"))).alias("de"), F.sum("n").alias("n"))
    r = b.join(db, config, "left").crossJoin(de)
    d = F.coalesce("db", F.lit(0.0))
    ratio = lambda a, c: F.coalesce(F.try_divide(a, c), F.lit(0.0))
    return r.select(config, "blocks", ratio(d, F.col("de")).alias("pc"), ratio(d, F.col("b")).alias("pq"), (1 - ratio(F.col("b"), _choose2(F.col("n")))).alias("rr"), d.alias("db"), "b")
