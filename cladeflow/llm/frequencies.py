"""How often every distinct value or term occurs, in how many records, and which do not inform."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_frequencies(
    df: DataFrame, record: str, values: list[str], min_records: int = 3, max_share: float = 0.01
) -> DataFrame:
    """Per distinct combination of values: n_rows, n_records and mark (rare, common or null).

    Rows with a null in a value column do not count as occurrences. rare: fewer than min_records
    records; else common: more than max_share of the distinct records of all rows. A null record
    is no record. An empty df gives an empty table. Repeated rows count as rows, once as record.

    Counts per (value, record) come first, combined within each partition before the shuffle;
    their key holds the record, so no value is hot there. The sums per value are again combined
    before their shuffle, which then moves at most one row per value and partition.
    """
    names = [f"_v{i}" for i in range(len(values))]
    src = df.select(F.col(record).alias("_r"), *[F.col(v).alias(n) for v, n in zip(values, names)])
    per_record = src.dropna(subset=names).groupBy(*names, "_r").agg(F.count(F.lit(1)).alias("_n"))
    summed = per_record.groupBy(*names).agg(F.sum("_n").alias("n_rows"), F.count("_r").alias("n_records"))
    total = src.select("_r").dropna().distinct().agg(F.count(F.lit(1)).alias("_t"))  # one row
    mark = F.when(F.col("n_records") < min_records, "rare").when(F.col("n_records") > F.col("_t") * F.lit(max_share), "common")
    return summed.crossJoin(F.broadcast(total)).select(
        *[F.col(n).alias(v) for v, n in zip(values, names)], "n_rows", "n_records", mark.alias("mark")
    )


def term_frequencies(df: DataFrame, record: str, text: str, min_records: int = 3, max_share: float = 0.1) -> DataFrame:
    """value_frequencies of the lower-case words (runs of letters, marks and digits) of a text column."""
    words = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1)))
    src = df.select(F.col(record), F.col(text), F.lit(1).alias("_one"))
    terms = src.select(F.col(record), words.alias("term"))
    # records without any word count in the total
    bare = src.select(F.col(record), F.lit(None).cast("string").alias("term"))
    return value_frequencies(terms.unionByName(bare), record, ["term"], min_records, max_share)


def mutation_frequencies(mutations: DataFrame) -> DataFrame:
    """value_frequencies of trimmed, upper-cased mutations over the nodes that carry them.

    rare: at most 2 nodes; common: more than a hundredth of all nodes of the table.
    """
    clean = mutations.select(
        "node_id", "pos", F.upper(F.trim("a")).alias("a"), F.upper(F.trim("d")).alias("d")
    )
    return value_frequencies(clean, "node_id", ["pos", "a", "d"], min_records=3, max_share=0.01)
