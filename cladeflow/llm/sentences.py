"""Sentence units of every document, whatever its language and script.

Dots are ambiguous; each occurrence that is not (before a comma, a lower-case word, the end of
a text, ...) is evidence. A document's own evidence comes first, the counts over all documents
are the fallback. The counts are combined within each partition before their shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm import sentence_rules as R
from cladeflow.runtime import dimension_join, materialize

_FEATURES = ["c", "u", "e", "w"]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ev = R.Evidence()

    def flush() -> pd.DataFrame:
        rows: dict = {}
        for (kind, a, b, f), n in ev.n.items():
            if f not in _FEATURES:
                continue
            rows.setdefault((kind, a, b), dict.fromkeys(_FEATURES, 0))[f] += n
        ev.n.clear()
        return pd.DataFrame([(*k, *v.values()) for k, v in rows.items()], columns=["kind", "a", "b", *_FEATURES])

    for batch in batches:
        for text in batch["text"]:
            if text:
                ev.read(text)
        if len(ev.n) > 200_000:
            yield flush()
    yield flush()


def corpus_evidence(docs: DataFrame) -> DataFrame:
    """Decisions (kind, a, b, decision) from the counts over all documents; only those that say something."""
    counts = (
        docs.select("text")
        .mapInPandas(_count, "kind string, a string, b string, c bigint, u bigint, e bigint, w bigint")
        .groupBy("kind", "a", "b")
        .agg(*[F.sum(f).alias(f) for f in _FEATURES])
    )
    counts = materialize(counts, "evidence")
    starts = counts.where("kind = 's'").select("a", F.col("e").alias("starts"))
    total = F.col("c") + F.col("u") + F.col("e")
    special = counts.where(F.col("kind").isin("d", "e", "f", "n", "q") & (total > 0)).join(starts, "a", "left").fillna(0, ["starts"])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            d = [R.classify(*x) for x in zip(p["kind"], p["a"], p["c"], p["u"], p["e"], p["w"], p["starts"])]
            out = p[["kind", "a", "b"]].assign(decision=d)
            yield out[out["decision"] != ""]

    cols = special.select("kind", "a", "b", *_FEATURES, "starts")
    return materialize(cols.mapInPandas(decide, "kind string, a string, b string, decision string"), "decisions")


def _split(batches: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, starts, ends = [], [], []
        for i, text, own in zip(batch["doc_id"], batch["text"], batch["said"] if "said" in batch else [None] * len(batch)):
            ev = R.Evidence.of(text)
            said = shared if shared is not None else {(x["kind"], x["a"], x["b"]): x["decision"] for x in (own if own is not None else ())}
            if shared is not None:
                said = {k: shared[k] for k in R.wanted(ev) if k in shared}
            for a, b in R.sentences(text, R.merged(ev, said)):
                ids.append(i)
                starts.append(a)
                ends.append(b)
        yield pd.DataFrame({"doc_id": ids, "start_pos": starts, "end_pos": ends}).astype({"doc_id": "int64", "start_pos": "int32", "end_pos": "int32"})


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for i, text in zip(batch["doc_id"], batch["text"]):
            ev = R.Evidence.of(text)
            rows += [(i, *k) for k in R.wanted(ev)]
        yield pd.DataFrame(rows, columns=["doc_id", "kind", "a", "b"])


def sentence_units(docs: DataFrame, broadcast_up_to: int = 300_000) -> DataFrame:
    """doc_id, start_pos, end_pos: code point offsets, end exclusive, one row per sentence.

    docs: doc_id, text; further columns are ignored. Null and empty texts and texts of white
    space have no sentences; a text without any end mark is one; rows with a null doc_id are
    ignored; a repeated doc_id is split once per row. An empty df gives an empty table.
    The corpus decisions are broadcast if there are at most broadcast_up_to of them; beyond
    that each document gets the decisions for its own tokens by joins. Both give the same rows.
    """
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    decisions = corpus_evidence(src)
    schema = "doc_id bigint, start_pos int, end_pos int"
    if decisions.limit(broadcast_up_to + 1).count() <= broadcast_up_to:
        table = {(r[0], r[1], r[2]): r[3] for r in decisions.collect()}
        held = src.sparkSession.sparkContext.broadcast(table)
        return src.mapInPandas(lambda b: _split(b, held.value), schema)
    keys = src.mapInPandas(_keys, "doc_id bigint, kind string, a string, b string").distinct()
    found = dimension_join(keys, decisions, ["kind", "a", "b"], "doc_id", "inner")
    said = found.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "a", "b", "decision")).alias("said"))
    return src.join(said, "doc_id", "left").select("doc_id", "text", "said").mapInPandas(lambda b: _split(b, None), schema)
