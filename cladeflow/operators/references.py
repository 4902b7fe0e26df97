"""References to records that do not exist (yet, or any more)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.runtime import materialize, salt_hot


def plain_name(c: Column) -> Column:
    """A name without surrounding blanks and quote marks, in lower case."""
    return F.lower(F.regexp_replace(c, r"""^[ '"]+|[ '"]+$""", ""))


def presence(targets: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint intervals [_from, _to) in which a key is present; _to null: still there.

    Overlapping intervals are merged per key and month of the start, then per key, so that
    the last step sees few rows of a key that is loaded again and again.
    """

    def merged(df: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("_from", "_until")
        before = F.max("_until").over(order.rowsBetween(Window.unboundedPreceding, -1))
        opened = F.when(before.isNull() | (F.col("_from") > before), 1).otherwise(0)
        island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
        return (
            df.withColumn("_new", opened)
            .withColumn("_island", island)
            .groupBy(*by, "_island")
            .agg(F.min("_from").alias("_from"), F.max("_until").alias("_until"))
            .drop("_island")
        )

    never = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    src = (
        targets.select(*keys, F.col("_from"), F.coalesce("_to", never).alias("_until"))
        .where(F.col("_from").isNotNull() & (F.col("_until") > F.col("_from")))
        .distinct()
        .withColumn("_month", F.trunc("_from", "month"))
    )
    out = merged(merged(src, [*keys, "_month"]).drop("_month"), keys)
    return out.select(*keys, "_from", F.when(F.col("_until") < never, F.col("_until")).alias("_to"))


def orphans(
    refs: DataFrame,
    targets: DataFrame,
    keys: list[str],
    ref_id: str | list[str],
    ref_time: str,
    loaded_at: str = "loaded_at",
    deleted_at: str = "deleted_at",
    match: str = "simple",
    rows_per_salt: int = 200_000,
) -> DataFrame:
    """References without a target that is present at their time: ref_id, ref_time, reason.

    reason: missing - no such target at all; deleted - one had been loaded by then; late -
    else. A target is present in [loaded_at, deleted_at). match says what partly null keys
    mean, as in SQL: simple - a reference with a null in any key column refers to nothing;
    partial - it refers to any target that agrees in the other columns (all null: to nothing);
    full - it is an orphan with the reason incomplete (all null: it refers to nothing).
    A null time: the target must exist at some time. The references are grouped by their mask
    of nulls, and each group is anti-joined on the columns that it has. ref_id: one column or
    several. Repeated references are all reported; hot keys are salted. What is lost is written
    once, before its reasons are looked up.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(match)
    ids = [ref_id] if isinstance(ref_id, str) else list(ref_id)
    held, ks = [f"_id{k}" for k in range(len(ids))], [f"_k{k}" for k in range(len(keys))]
    mask = F.concat(*[F.when(F.col(k).isNull(), "0").otherwise("1") for k in keys])
    r = refs.select(*[F.col(c).alias(h) for c, h in zip(ids, held)], F.col(ref_time).alias("_at"), *[F.col(k).alias(n) for k, n in zip(keys, ks)], mask.alias("_mask"))
    t = targets.select(*[F.col(k).alias(n) for k, n in zip(keys, ks)], F.col(loaded_at).alias("_from"), F.col(deleted_at).alias("_to"))
    whole = "1" * len(keys)
    # a mask that no reference has costs nothing further
    masks = [whole] if match == "simple" else sorted(x["_mask"] for x in r.select("_mask").distinct().collect())  # at most 2 ** keys
    found = []
    for m in masks:
        on = [k for k, there in zip(ks, m) if there == "1"]
        some = r.where(F.col("_mask") == m)
        if not on:
            continue
        if match == "full" and m != whole:
            found.append(some.select(*held, "_at", F.lit("incomplete").alias("reason")))
            continue
        here = t.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on]))
        left, right, by = salt_hot(some.select(*held, "_at", *on), presence(here, on), on, held[0], rows_per_salt)
        a, b = left.alias("a"), right.alias("b")
        same = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in by])
        at = F.col("a._at")
        covers = at.isNull() | ((F.col("b._from") <= at) & (F.col("b._to").isNull() | (at < F.col("b._to"))))
        lost = materialize(a.join(b, same & covers, "left_anti").select(*held, "_at", *on), "lost")
        first = here.groupBy(*on).agg(F.min("_from").alias("_first"), F.lit(True).alias("_any"))
        left, right, by = salt_hot(lost, first, on, held[0], rows_per_salt)
        reason = (
            F.when(F.col("_any").isNull(), "missing").when(F.col("_first") <= F.col("_at"), "deleted").otherwise("late")
        )
        found.append(left.join(right, by, "left").select(*held, "_at", reason.alias("reason")))
    if not found:
        found = [r.limit(0).select(*held, "_at", F.lit("").alias("reason"))]
    out = reduce(DataFrame.unionByName, found)
    return out.select(*[F.col(h).alias(c) for h, c in zip(held, ids)], F.col("_at").alias(ref_time), "reason")


def name_orphans(metadata: DataFrame, sequence_names: DataFrame, nodes: DataFrame, match: str = "simple") -> DataFrame:
    """Names in two tables that point to no tip present at that time: table_name, row_id, reason, ref_month.

    The key is (tree_id, name); match says what a null in it means, see orphans.
    """
    tips = nodes.where("is_tip").select("tree_id", plain_name(F.col("name")).alias("_name"), "loaded_at", "deleted_at")
    refs = reduce(
        DataFrame.unionByName,
        [
            df.select(F.lit(label).alias("table_name"), F.col(row_id).cast("bigint").alias("row_id"), F.col(at).alias("_seen"), "tree_id", plain_name(F.col("name")).alias("_name"))
            for label, df, row_id, at in (("metadata", metadata, "meta_id", "received_at"), ("sequence_names", sequence_names, "entry_id", "added_at"))
        ],
    )
    lost = orphans(refs, tips, ["tree_id", "_name"], ["row_id", "table_name"], "_seen", match=match)
    return lost.select("table_name", "row_id", "reason", F.date_format("_seen", "yyyy-MM").alias("ref_month"))
