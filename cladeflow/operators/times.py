"""Mixed time formats and zones to one moment in UTC."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeflow.kernels import timestamps as K
from cladeflow.runtime import dimension_join, materialize

_READ = T.ArrayType(
    T.StructType([T.StructField("format", T.StringType()), T.StructField("start_s", T.LongType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])
)
_FOUND = T.StructType([T.StructField("r", _READ), T.StructField("open", T.StringType())])


def _read(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, zones in parts:
        found = [K.readings(t, z) for t, z in zip(texts, zones)]
        yield pd.DataFrame(
            {"r": [[dict(zip(("format", "start_s", "lo", "hi"), x)) for x in f] for f in found], "open": [K.alternatives(f) for f in found]}
        )


def _readings(*cols: str) -> Column:
    return F.pandas_udf(_read, _FOUND)(*cols)


def _mixtures(rows: pd.DataFrame, pseudo: float, odds: float, slip: float) -> pd.DataFrame:
    """The likeliest moment of each set of readings of one source; a row per set, so a bounded group."""
    declared = next((x for x in rows["date_order"] if isinstance(x, str)), None)

    def likelihood(form: str, moment: str) -> float:
        order = form.removesuffix(K.UTC)
        against = (form != order) + (declared is not None and order in ("dmy", "mdy") and order != declared)
        return odds**-against * (slip if moment == "x" else 1.0)

    parsed = [[tuple(x.rsplit(":", 1)) for x in s.split("|")] for s in rows["open"]]
    sets = [(tuple((f, likelihood(f, m)) for f, m in s), float(n)) for s, n in zip(parsed, rows["n"])]
    weight = K.mixture(sets, pseudo)
    out = []
    for original, s, (likes, _) in zip(rows["open"], parsed, sets):
        share = {f: weight[f] * like for f, like in likes}
        moments: dict[str, float] = {}
        for f, m in s:
            moments[m] = moments.get(m, 0.0) + share[f]
        best = max(moments, key=lambda m: (moments[m], m))
        form = max((f for f, m in s if m == best), key=lambda f: (share[f], f))
        out.append((rows["_s"].iloc[0], original, form, moments[best] / sum(moments.values())))
    return pd.DataFrame(out, columns=["_s", "open", "format", "posterior"])


def normalise_times(
    values: DataFrame, sources: DataFrame, value_id: str, source: str, fields: list[str], sure: float = 0.9, pseudo: float = 1.0,
    odds: float = 1e9, slip: float = 1e-3, keep: tuple[str, ...] = (),
) -> DataFrame:
    """One UTC moment per value: value_id, field_name, format, start_s, lo, hi, posterior, status, and the columns keep.

    sources: source, tz, date_order (dmy, mdy or null). start_s: first moment in seconds; lo and hi:
    decimal years of the first and last day as written. status: ok; nonexistent - the likeliest
    reading is a date or local time that does not exist; ambiguous - several moments are possible
    and none has a posterior of at least sure (posterior is the best one's); unreadable - no format
    fits. start_s, lo and hi are null but for ok. Null values give no rows; repeated rows stay.

    Every parse of a value is a component of the mixture of its source: orders of day and month,
    local time or UTC where no zone is written. An expectation-maximisation over all values of the
    source finds the weights of its formats; a value contributes the likelihood of each of its
    parses: 1, or slip where the moment does not exist, divided by odds for each declaration of
    the source (its date_order, its tz) that the parse goes against. Parses of the same moment add
    up, and the posterior decides. Values without a source share one mixture. A source with several
    rows counts by its smallest tz and order.
    """
    labs = sources.groupBy(F.col(source).alias("source")).agg(F.min("tz").alias("tz"), F.min("date_order").alias("date_order"))
    held = [f"_keep{k}" for k in range(len(keep))]
    src = values.select(F.col(value_id).alias("_id"), F.col(source).alias("source"), *[F.col(c).alias(h) for c, h in zip(keep, held)], *[F.col(f).alias(f"_f{k}") for k, f in enumerate(fields)])
    known = dimension_join(src, labs, ["source"], "_id")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"_f{k}").alias("v")) for k, f in enumerate(fields)]))
    read = (
        known.select("_id", "source", "tz", "date_order", *held, each.alias("x"))
        .select("_id", "source", "tz", "date_order", *held, "x.field_name", F.col("x.v").alias("v"))
        .where(F.col("v").isNotNull())
        .select("_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_s"), "date_order", *held, "field_name", _readings("v", "tz").alias("x"))
        .select("_id", "_s", "date_order", *held, "field_name", "x.r", "x.open")
    )
    read = materialize(read, "readings")
    counts = read.where(F.size("r") > 0).groupBy("_s", "open").agg(F.count(F.lit(1)).alias("n"), F.max("date_order").alias("date_order"))
    posteriors = materialize(
        counts.groupBy("_s").applyInPandas(lambda p: _mixtures(p, pseudo, odds, slip), "_s string, open string, format string, posterior double"),
        "posteriors",
    )
    decided = dimension_join(read, posteriors, ["_s", "open"], "_id")
    taken = F.get(F.filter("r", lambda x: x["format"] == F.col("format")), F.lit(0))
    there = taken["start_s"].isNotNull()
    status = (
        F.when(F.col("format").isNull(), "unreadable").when(F.col("posterior") < sure, "ambiguous").when(there, "ok").otherwise("nonexistent")
    )
    out = decided.select("_id", *held, "field_name", "format", taken.alias("t"), "posterior", status.alias("status"))
    shown = [F.when(F.col("status") == "ok", F.col(f"t.{c}")).alias(c) for c in ("start_s", "lo", "hi")]
    return out.select(
        F.col("_id").alias(value_id), *[F.col(h).alias(c) for h, c in zip(held, keep)], "field_name", "format", *shown, F.coalesce("posterior", F.lit(1.0)).alias("posterior"), "status"
    )


def order_evidence(values: DataFrame, sources: DataFrame, value_id: str, source: str, fields: list[str]) -> DataFrame:
    """What the values alone say about each source's order of day and month: source, date_order, n_read, n_decided, n_ambiguous, n_agree.

    The times are normalised as if no order were declared. n_read: values of numbers only;
    n_decided: those with a sure order, n_agree: those of them in the declared one.
    """
    blind = sources.select(source, "tz", F.lit(None).cast("string").alias("date_order"))
    t = normalise_times(values, blind, value_id, source, fields, keep=(source,)).where(F.substring("format", 1, 3).isin("dmy", "mdy"))
    n = t.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n_read"), F.count_if(F.col("status") != "ambiguous").alias("n_decided"), F.count_if(F.col("status") == "ambiguous").alias("n_ambiguous"),
        F.count_if((F.col("status") != "ambiguous") & F.col("format").startswith("dmy")).alias("_dmy"),
    )
    labs = sources.groupBy(F.col(source).alias("source")).agg(F.min("date_order").alias("date_order"))
    agree = F.when(F.col("date_order") == "dmy", F.col("_dmy")).when(F.col("date_order") == "mdy", F.col("n_decided") - F.col("_dmy"))
    return n.join(labs, "source", "left").select("source", "date_order", "n_read", "n_decided", "n_ambiguous", agree.alias("n_agree"))
