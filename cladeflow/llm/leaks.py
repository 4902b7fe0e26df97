"""Evaluation texts inside a training corpus: a distributed positional inverted index.

The corpus is stored as postings (term, document, positions). A phrase of evaluation text is
sought from its rarest terms: their postings are shifted by the terms' places in the item and
intersected, and what is left is compared exactly on the words themselves. Terms are words; in
items of scripts without spaces they are runs of GRAM letters and digits.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.runtime import dimension_join, materialize

GRAM = 4
_WORD = re.compile(r"[^\W_]+")
_SPACELESS = ("zh", "ja")


@functools.cache
def _format_characters() -> dict[int, None]:
    return {c: None for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf"}


def normal(text: str | None) -> str:
    """NFKC, without format characters, lower case."""
    if not text or text.isascii():
        return (text or "").lower()
    return unicodedata.normalize("NFKC", text).translate(_format_characters()).lower()


def words(text: str) -> list[str]:
    return _WORD.findall(text)


def letters(text: str) -> str:
    return "".join(_WORD.findall(text))


def _key(term: str) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(term))))


def _terms(text: str, spaceless: bool) -> list[str]:
    """Words, or the overlapping grams of the letters; a gram is marked, so that it is no word."""
    if spaceless:
        run = letters(text)
        return ["#" + run[i : i + GRAM] for i in range(len(run) - GRAM + 1)]
    return words(text)


def _item_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, lang, text in zip(b["item_id"], b["lang"], b["text"]):
            spaceless = (lang or "").strip().lower()[:2] in _SPACELESS
            rows += [(i, spaceless, k, _key(t), t) for k, t in enumerate(_terms(normal(text), spaceless))]
        yield pd.DataFrame(rows, columns=["item_id", "spaceless", "at", "term", "written"])


_ITEM_TERMS = "item_id bigint, spaceless boolean, at int, term bigint, written string"


def _postings(vocabulary):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = None if vocabulary is None else vocabulary.value
        starts = None if known is None else {t[1] for t in known if t[0] == "#"}
        for b in batches:
            out: list[tuple[int, int, list[int]]] = []
            for i, text in zip(b["doc_id"], b["text"]):
                t = normal(text)
                for spaceless in (False, True):
                    if spaceless and starts is not None and starts.isdisjoint(t):
                        continue
                    at: dict[int, list[int]] = {}
                    for k, term in enumerate(_terms(t, spaceless)):
                        key = _key(term) if known is None else known.get(term)
                        if key is not None:
                            at.setdefault(key, []).append(k)
                    out += [(term, i, p) for term, p in at.items()]
            yield pd.DataFrame(out, columns=["term", "doc_id", "positions"])

    return run


def positional_index(docs: DataFrame, terms: DataFrame, broadcast_up_to: int = 500_000) -> DataFrame:
    """Postings (term, doc_id, positions) of the given terms; written to the shared folder.

    The terms are broadcast if there are at most broadcast_up_to; beyond, all postings are
    made and semi-joined with them.
    """
    schema = "term bigint, doc_id bigint, positions array<int>"
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and length(text) > 0")
    terms = terms.select("term", "written").distinct()
    if terms.limit(broadcast_up_to + 1).count() <= broadcast_up_to:
        known = src.sparkSession.sparkContext.broadcast({r["written"]: r["term"] for r in terms.collect()})
        return materialize(src.mapInPandas(_postings(known), schema), "postings")
    return materialize(src.mapInPandas(_postings(None), schema).join(terms.select("term"), "term", "left_semi"), "postings")


def _anchors(n_words: int, n_letters: int, rarest: int):
    """The rarest terms of each window of an item; a window with a term that the corpus lacks has none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        spaceless = bool(pdf["spaceless"].iloc[0])
        size = n_letters - GRAM + 1 if spaceless else n_words
        df = pdf["df"].fillna(0).to_numpy()
        term = pdf["term"].to_numpy()
        rows = []
        for w in range(len(df) - size + 1):
            part = df[w : w + size]
            if part.min() == 0:
                continue
            seen, order = set(), []
            for k in np.argsort(part, kind="stable"):
                if term[w + k] not in seen:
                    seen.add(term[w + k])
                    order.append(w + k)
                if len(order) == rarest:
                    break
            rows += [(pdf["item_id"].iloc[0], spaceless, w, int(k), term[k], len(order), 1 << min(r, 62)) for r, k in enumerate(order)]
        return pd.DataFrame(rows, columns=["item_id", "spaceless", "window", "at", "term", "of", "bit"])

    return run


_ANCHOR = "item_id bigint, spaceless boolean, window int, at int, term bigint, of int, bit bigint"


def _runs(n_words: int, n_letters: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, doc = None, ([], "")
        cache: dict = {}
        for b in batches:
            longest = []
            for i, item, spaceless, shifts, text, passage in zip(b["doc_id"], b["item_id"], b["spaceless"], b["shifts"], b["text"], b["passage"]):
                if i != last:
                    t = normal(text)
                    last, doc = i, (words(t), letters(t))
                if item not in cache:
                    p = normal(passage)
                    cache[item] = (words(p), letters(p))
                a, q = doc[spaceless], cache[item][spaceless]
                best = 0
                for shift in shifts:
                    n = 0
                    for k in range(max(0, -shift), min(len(q), len(a) - shift)):
                        n = n + 1 if a[k + shift] == q[k] else 0
                        best = max(best, n)
                longest.append(best)
            out = b[["doc_id", "item_id"]].assign(length=longest)
            yield out[out["length"] >= np.where(b["spaceless"], n_letters, n_words)]

    return run


def leaked_passages(docs: DataFrame, items: DataFrame, n_words: int = 12, n_letters: int = 24, rarest: int = 2) -> DataFrame:
    """doc_id, item_id, length: documents and items that share n_words consecutive words.

    length is the longest shared run (in letters and digits, at least n_letters, for items whose
    lang is zh or ja). docs: doc_id, text; items: item_id, lang, text; further columns are
    ignored. Null and empty texts match nothing; a repeated doc_id counts with its greatest
    text, a repeated item_id with its greatest text and that row's lang. An item shorter than
    the least run has no match. Empty tables give an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and length(text) > 0")
    one = F.max(F.struct("text", "lang")).alias("x")
    items = items.where("item_id is not null").groupBy(F.col("item_id").cast("bigint").alias("item_id")).agg(one).select("item_id", "x.text", "x.lang")
    terms = materialize(items.mapInPandas(_item_terms, _ITEM_TERMS), "terms")
    index = positional_index(docs, terms)
    df = index.groupBy("term").agg(F.sum(F.size("positions")).alias("df"))
    rarest = min(rarest, 62)  # one bit each; fewer anchors lose nothing
    anchors = terms.drop("written").join(df, "term", "left").groupBy("item_id").applyInPandas(_anchors(n_words, n_letters, rarest), _ANCHOR)
    anchors = materialize(anchors, "anchors")
    # one lookup per anchor, however many windows share it
    sought = materialize(anchors.select("item_id", "spaceless", "at", "term").distinct(), "sought")
    hits = dimension_join(index, sought, ["term"], "doc_id", "inner").select(
        "doc_id", "item_id", "at", F.explode("positions").alias("p")
    )
    hits = hits.select("doc_id", "item_id", "at", (F.col("p") - F.col("at")).alias("shift"))
    # the shifted lists of the anchors of a window intersect; rows of a repeated doc_id are met once
    met = dimension_join(hits, anchors.select("item_id", "at", "window", "of", "bit"), ["item_id", "at"], "doc_id", "inner")
    full = met.groupBy("doc_id", "item_id", "window", "shift", "of").agg(F.bit_count(F.bit_or("bit")).alias("n")).where("n = of")
    found = full.select("doc_id", "item_id", "shift").distinct().groupBy("doc_id", "item_id").agg(F.collect_set("shift").alias("shifts"))
    kinds = terms.groupBy("item_id").agg(F.first("spaceless").alias("spaceless"))
    passages = materialize(items.join(kinds, "item_id").select("item_id", "spaceless", F.col("text").alias("passage")), "passages")
    # only the texts of documents with candidates travel; few candidates are broadcast, and then none do
    found = materialize(found, "candidates")
    texts = dimension_join(docs, found, ["doc_id"], "text", "inner").groupBy("doc_id", "item_id").agg(F.max("text").alias("text"), F.first("shifts").alias("shifts"))
    checked = dimension_join(texts, passages, ["item_id"], "doc_id", "inner")
    return checked.select("doc_id", "item_id", "spaceless", "shifts", "text", "passage").mapInPandas(
        _runs(n_words, n_letters), "doc_id bigint, item_id bigint, length int"
    )


def _needed(size: int, share: float) -> int:
    return max(2, math.ceil(share * size - 1e-9))


def _sought(n_words: int, n_letters: int, share: float):
    """The places of an item's windows that are looked up: in each window so many of its rarest terms that two of them must be met."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        spaceless = bool(pdf["spaceless"].iloc[0])
        size = n_letters - GRAM + 1 if spaceless else n_words
        df, term = pdf["df"].fillna(0).to_numpy(), pdf["term"].to_numpy()
        enough = size - _needed(size, share) + 2
        chosen: set = set()
        for w in range(len(df) - size + 1):
            chosen.update((w + np.argsort(df[w : w + size], kind="stable")[:enough]).tolist())
        at = [k for k in sorted(chosen) if df[k] > 0]
        return pd.DataFrame({"item_id": pdf["item_id"].iloc[0], "spaceless": spaceless, "at": at, "term": term[at]}).astype({"at": "int32"})

    return run


def best_window(doc_at: dict, item: list, size: int, slop: int, bins: list[int]) -> int:
    """The most terms of any window of an item that lie within slop places of theirs, for one shift out of the bins."""
    best = 0
    for b in bins:
        low = 2 * slop * b - slop
        met = np.zeros((6 * slop + 1, len(item)), bool)
        for k, term in enumerate(item):
            at = doc_at.get(term, ())
            for p in at[bisect.bisect_left(at, k + low - slop) : bisect.bisect_right(at, k + low + 7 * slop)]:
                i = p - k - low
                met[max(0, i - slop) : i + slop + 1, k] = True
        run = np.cumsum(np.pad(met, ((0, 0), (1, 0))), axis=1)
        best = max(best, int((run[:, size:] - run[:, :-size]).max(initial=0)))
    return best


def _near(n_words: int, n_letters: int, share: float, slop: int, passages: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = passages.value
        cache: dict = {}
        for b in batches:
            rows = []
            for i, text, found in zip(b["doc_id"], b["text"], b["found"]):
                t = normal(text)
                places: dict = {}
                for f in found:
                    spaceless, passage = held[f["item_id"]]
                    if f["item_id"] not in cache:
                        cache[f["item_id"]] = _terms(normal(passage), spaceless)
                    if spaceless not in places:
                        at: dict[str, list[int]] = {}
                        for k, term in enumerate(_terms(t, spaceless)):
                            at.setdefault(term, []).append(k)
                        places[spaceless] = at
                    size = n_letters - GRAM + 1 if spaceless else n_words
                    n = best_window(places[spaceless], cache[f["item_id"]], size, slop, list(f["bins"]))
                    if n >= _needed(size, share):
                        rows.append((i, f["item_id"], n))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_terms"]).astype({"n_terms": "int32"})

    return run


def proximity_matches(docs: DataFrame, items: DataFrame, n_words: int = 12, n_letters: int = 24, share: float = 0.8, slop: int = 4, broadcast_up_to: int = 50_000) -> DataFrame:
    """doc_id, item_id, n_terms: documents that hold most of a passage, with words replaced, added or left out.

    A match: for some window of n_words consecutive words of an item and one shift, at least the
    share of the window's words occur in the document within slop places of where the shift
    puts them; n_terms is the most that any window reaches. Items in zh and ja: the grams of
    n_letters letters. All matches are found: of the rarest terms of a window so many are looked
    up in the positional index that two of them must be among the matched ones; documents with
    two in one bin of shifts are then compared in full. What else the corpus holds changes which
    terms are looked up, not what is found. Null, empty and repeated rows as in leaked_passages;
    an item shorter than a window has no match. Of more than broadcast_up_to items the passages
    would not be held whole: that is an error.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and length(text) > 0")
    one = F.max(F.struct("text", "lang")).alias("x")
    items = items.where("item_id is not null").groupBy(F.col("item_id").cast("bigint").alias("item_id")).agg(one).select("item_id", "x.text", "x.lang")
    terms = materialize(items.mapInPandas(_item_terms, _ITEM_TERMS), "terms")
    index = positional_index(docs, terms)
    df = index.groupBy("term").agg(F.sum(F.size("positions")).alias("df"))
    sought = terms.drop("written").join(df, "term", "left").groupBy("item_id").applyInPandas(_sought(n_words, n_letters, share), "item_id bigint, spaceless boolean, at int, term bigint")
    sought = materialize(sought, "sought")
    hits = dimension_join(index, sought.select("item_id", "at", "term"), ["term"], "doc_id", "inner").select("doc_id", "item_id", "at", F.explode("positions").alias("p"))
    # bins of 4 * slop shifts that overlap by half: two terms met under one shift share one
    base = F.floor((F.col("p") - F.col("at")) / (2 * slop)).cast("int")
    near = hits.select("doc_id", "item_id", "at", F.explode(F.array(base, base - 1)).alias("bin"))
    two = near.groupBy("doc_id", "item_id", "bin").agg(F.min("at").alias("a"), F.max("at").alias("b")).where("a < b")
    per_item = two.groupBy("doc_id", "item_id").agg(F.collect_set("bin").alias("bins"))
    found = materialize(per_item.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "bins")).alias("found")), "candidates")
    kinds = terms.groupBy("item_id").agg(F.first("spaceless").alias("spaceless"))
    passages = items.join(kinds, "item_id").select("item_id", "spaceless", "text")
    if passages.limit(broadcast_up_to + 1).count() > broadcast_up_to:
        raise ValueError(f"more than {broadcast_up_to} items: match them in parts")
    held = docs.sparkSession.sparkContext.broadcast({r["item_id"]: (r["spaceless"], r["text"]) for r in passages.collect()})
    texts = dimension_join(docs, found, ["doc_id"], "text", "inner").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("found").alias("found"))
    return texts.mapInPandas(_near(n_words, n_letters, share, slop, held), "doc_id bigint, item_id bigint, n_terms int")
