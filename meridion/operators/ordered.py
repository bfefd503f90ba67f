"""Ordered computations over long tables: unwrapping, chains, pairing, neighbours on a circle, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridion.functions.constants import SEAM_ANGLE, TWO_PI
from meridion.functions.geodesy import lit, principal
from meridion.plans.session import checkpointed


def unwrap(df: DataFrame, key: str, order: str, lon: str, out: str = "unwrapped") -> DataFrame:
    """Running sum of nearest longitude steps within each key; the first is a principal value."""
    w = Window.partitionBy(key).orderBy(order)
    step = F.coalesce(principal(F.col(lon) - F.lag(lon).over(w)), principal(F.col(lon)))
    return df.withColumn("_step", step).withColumn(out, F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def winding_numbers(df: DataFrame, key: str, order: str, lon: str) -> DataFrame:
    """One row a key: n points and the whole turns of the closed path; one shuffle, and a task holds a key's window only."""
    w = Window.partitionBy(key).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = principal(F.coalesce(F.lead(lon).over(w), F.first(lon).over(whole)) - F.col(lon))
    return df.withColumn("_step", step).groupBy(key).agg(F.count("*").alias("n"), F.rint(F.sum("_step") / lit(TWO_PI)).cast("int").alias("winding"))


def chain_ids(df: DataFrame, key: str, order: str, start: str, end: str, out: str = "chain") -> DataFrame:
    """Gaps and islands: a new chain begins where a segment's start is not the end of the one before."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.lag(end).over(w) == F.col(start), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def close_chains(df: DataFrame, key: str, order: str, start: str, end: str, chain: str = "chain") -> DataFrame:
    """The last chain of a key continues in its first one if they touch: it takes that one's number."""
    whole = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    touch = (F.last(end).over(whole) == F.first(start).over(whole)) & (F.last(chain).over(whole) > 0)
    return df.withColumn(chain, F.when(touch & (F.col(chain) == F.last(chain).over(whole)), F.lit(0)).otherwise(F.col(chain)))


def pair_sorted(df: DataFrame, key: str, value: str, tie: str, tolerance: float = SEAM_ANGLE) -> DataFrame:
    """Sorts each key's values and pairs neighbours (0, 1), (2, 3), ...: pair, place, and an error if values touch or one is left over."""
    w = Window.partitionBy(key).orderBy(value, tie)
    whole = Window.partitionBy(key)
    out = df.withColumn("_place", F.row_number().over(w) - 1).withColumn("_gap", F.col(value) - F.lag(value).over(w)).withColumn("_n", F.count("*").over(whole))
    touch = F.max(F.when(F.col("_gap") <= lit(tolerance), 1).otherwise(0)).over(whole)
    error = F.when((F.col("_n") % 2 != 0) | (touch == 1), "ambiguous_seam_touch").otherwise("none")
    return out.withColumn("error", error).withColumn("pair", F.floor(F.col("_place") / 2).cast("int")).withColumn("place", F.col("_place").cast("int")).drop("_place", "_gap", "_n")


def circular_neighbours(df: DataFrame, key: str, angle: str, tie: str) -> DataFrame:
    """Each row's next and previous row on the circle, by angle, with the gap to the next one."""
    w = Window.partitionBy(key).orderBy(angle, tie)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt, prv = F.coalesce(F.lead(tie).over(w), F.first(tie).over(whole)), F.coalesce(F.lag(tie).over(w), F.last(tie).over(whole))
    gap = F.coalesce(F.lead(angle).over(w) - F.col(angle), F.first(angle).over(whole) + lit(TWO_PI) - F.col(angle))
    return df.select("*", nxt.alias("next_id"), prv.alias("previous_id"), gap.alias("gap"))


def horizon_transitions(df: DataFrame, key: str, order: str, visible: str) -> DataFrame:
    """Rows where visibility changes from the row before."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_was", F.lag(visible).over(w)).where(F.col("_was") != F.col(visible)).drop("_was")


def not_contiguous(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Keys whose indices are not 0, 1, 2, ... (an aggregate, not a window)."""
    ok = (F.min(index) == 0) & (F.max(index) == F.count("*") - 1) & (F.countDistinct(index) == F.count("*"))
    return df.groupBy(*keys).agg(ok.alias("_ok"), F.count("*").alias("n")).where(~F.col("_ok")).drop("_ok")


def not_increasing(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value is not above the one before."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_before", F.lag(value).over(w)).where(F.col("_before") >= F.col(value)).drop("_before")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A full outer join with an error column: which side lacks the key, or has it twice."""
    lc, rc = left.groupBy(key).agg(F.count("*").alias("_l")), right.groupBy(key).agg(F.count("*").alias("_r"))
    error = F.when(F.col("_l").isNull(), "left_missing").when(F.col("_r").isNull(), "right_missing").when((F.col("_l") > 1) | (F.col("_r") > 1), "not_unique").otherwise("none")
    return lc.join(rc, key, "full_outer").select(key, error.alias("error"))


def same_keys(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """One row: how many distinct keys only one side has, and whether the sets are equal."""
    both = left.select(*keys).distinct().withColumn("_l", F.lit(1)).join(right.select(*keys).distinct().withColumn("_r", F.lit(1)), list(keys), "full_outer")
    only_left, only_right = F.count_if(F.col("_r").isNull()), F.count_if(F.col("_l").isNull())
    return both.agg(only_left.alias("only_left"), only_right.alias("only_right")).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    return left.exceptAll(right).limit(1).count() == 0 and right.exceptAll(left).limit(1).count() == 0


def reorder(df: DataFrame, key: str, wanted: list) -> DataFrame:
    """New ordinals for an exact permutation of the keys; anything else gives error rows and the old ordinals."""
    spark = df.sparkSession
    order = spark.createDataFrame([(k, i) for i, k in enumerate(wanted)], df.select(key).withColumn("new_ordinal", F.lit(0)).schema)
    joined = df.join(order, key, "full_outer")
    broken = joined.agg(F.count_if(F.col("ordinal").isNull() | F.col("new_ordinal").isNull()).alias("n")).crossJoin(order.agg((F.count("*") - F.countDistinct(key)).alias("m")))
    bad = broken.select(((F.col("n") > 0) | (F.col("m") > 0)).alias("_bad"))
    out = df.join(order.dropDuplicates([key]), key, "left").crossJoin(F.broadcast(bad))  # one row
    return out.select(*[c for c in df.columns if c != "ordinal"], F.when(F.col("_bad"), F.col("ordinal")).otherwise(F.col("new_ordinal")).alias("ordinal"), F.when(F.col("_bad"), "not_a_permutation").otherwise("none").alias("error"))


def ancestry(df: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, ancestors, rooted, error) of a forest of any depth: how many ancestors there are, and whether the last one has no parent.

    Pointers double each round, so rounds are logarithmic in the longest chain. A parent that is no node ends a
    chain that is not rooted. What still has a way to go after as many rounds as nodes allow hangs on a cycle:
    its error is cycle and it has no count.
    """
    own = df.select(F.col(node).alias("node"), F.col(parent).alias("parent"))
    known = own.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    state = own.join(known, "parent", "left").select(
        "node", F.when(F.col("known"), F.col("parent")).alias("at"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("n"), F.when(F.col("known"), True).otherwise(F.col("parent").isNull()).alias("rooted")
    )
    state = checkpointed(state)
    nodes, covered = state.count(), 1
    while covered <= nodes and state.where(F.col("at").isNotNull()).limit(1).count():
        other = state.select(F.col("node").alias("at"), F.col("at").alias("far"), F.col("n").alias("more"), F.col("rooted").alias("last"))
        state = checkpointed(state.join(other, "at", "left").select("node", F.col("far").alias("at"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), (F.col("rooted") & F.coalesce("last", F.lit(True))).alias("rooted")))
        covered *= 2
    loop = F.col("at").isNotNull()
    return state.select("node", F.when(~loop, F.col("n").cast("int")).alias("ancestors"), (F.col("rooted") & ~loop).alias("rooted"), F.when(loop, "cycle").otherwise("none").alias("error"))


def cycle_roots(df: DataFrame, node: str, follow: str) -> DataFrame:
    """(node, root) of a permutation: each cycle's least node. Pointers double each round, so rounds are logarithmic in the longest cycle."""
    state = df.select(F.col(node).alias("node"), F.col(follow).alias("jump"), F.least(F.col(node), F.col(follow)).alias("root"))
    while True:
        state = checkpointed(state)
        other = state.select(F.col("node").alias("jump"), F.col("jump").alias("far"), F.col("root").alias("least"))
        nxt = checkpointed(state.join(other, "jump").select("node", F.col("far").alias("jump"), F.least("root", "least").alias("root")))
        if nxt.join(state.select("node", F.col("root").alias("old")), "node").where("root <> old").limit(1).count() == 0:
            return nxt.select("node", "root")
        state = nxt


def count_violations(df: DataFrame, **rules: Column) -> DataFrame:
    """One row: for each rule the number of rows that break it, all in one pass."""
    return df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
