"""Mutations on branches: recurrence, statistics for rate models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.functions.sequences import poisson

NUC = ["A", "C", "G", "T", "-"]


def branch_mutations(mutations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct mutations on branches that exist: tree_id, node_id, a, pos, d, is_tip; states trimmed, upper case, out of A C G T -."""
    m = mutations.select("tree_id", "node_id", F.upper(F.trim("a")).alias("a"), "pos", F.upper(F.trim("d")).alias("d"))
    m = m.where(F.col("a").isin(NUC) & F.col("d").isin(NUC) & (F.col("a") != F.col("d")) & F.col("pos").isNotNull()).distinct()
    return m.join(nodes.select("tree_id", "node_id", "is_tip", "branch_length"), ["tree_id", "node_id"])


def recurrence(muts: DataFrame, keys: list[str]) -> DataFrame:
    """How often each key occurs on all and on terminal branches: multiplicity, terminal."""
    return muts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("multiplicity"), F.sum(F.col("is_tip").cast("bigint")).alias("terminal")
    )


def recurrence_histogram(counts: DataFrame) -> DataFrame:
    """Number of keys that occur so often."""
    return counts.groupBy("multiplicity").agg(F.count(F.lit(1)).alias("n"))


def poisson_expectation(site_counts: DataFrame, length: int) -> DataFrame:
    """Observed and Poisson-expected numbers of sites hit so often; sites never hit count too."""
    one = site_counts.agg(F.sum("multiplicity").alias("_m"), F.count(F.lit(1)).alias("_s"))
    hist = recurrence_histogram(site_counts).withColumnRenamed("multiplicity", "hits")
    never = one.select(F.lit(0).cast("bigint").alias("hits"), (F.lit(length) - F.col("_s")).alias("n"))
    return hist.unionByName(never).crossJoin(one.select("_m")).select(  # a single row
        "hits", "n", (F.lit(float(length)) * poisson(F.col("hits"), F.col("_m") / F.lit(float(length)))).alias("expected")
    )


def top_recurrent(site_counts: DataFrame, n: int, length: int) -> DataFrame:
    """The n most frequent mutations; ties go to the lower position (count - 0.1 pos / length)."""
    return site_counts.orderBy((F.col("multiplicity") - 0.1 * F.col("pos") / length).desc(), "a", "d").limit(n)


def rate_statistics(muts: DataFrame) -> DataFrame:
    """n_ij and the time terms of mutations per (anc, der): n, half - the time moved from der to anc."""
    return muts.groupBy(F.col("a").alias("anc"), F.col("d").alias("der")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("branch_length") / 2).alias("half")
    )


def path_statistics(events: DataFrame, entity: str, time: str, state: str, tie: str) -> DataFrame:
    """Transitions and dwell times of paths: from_state, to_state, n, dwell_s (seconds spent before the change)."""
    from pyspark.sql import Window

    w = Window.partitionBy(entity).orderBy(time, tie)
    nxt = events.select(
        F.col(state).alias("from_state"), F.lead(state).over(w).alias("to_state"),
        (F.unix_micros(F.lead(F.col(time).cast("timestamp")).over(w)) - F.unix_micros(F.col(time).cast("timestamp"))).alias("_us"),
    )
    return nxt.where("to_state is not null").groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"), (F.sum("_us") / 1e6).alias("dwell_s"))
