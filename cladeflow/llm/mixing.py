"""Mixing sources to target shares of all tokens, with a cap on how often a document is used."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.runtime import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
OTHER = ""  # the class of sources without a target
_WORD = re.compile(r"\w+")


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def plain_source(c: Column) -> Column:
    """A source as spelled in the targets: lower case, no blanks around it, words joined by _."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")
    return F.when(F.length(s) > 0, s)


def _features(text: str | None, lang: str | None, size: int) -> np.ndarray:
    at = [xxhash.xxh32_intdigest(w) % size for w in _WORD.findall((text or "").lower())]
    at.append(xxhash.xxh32_intdigest("lang=" + (lang or "").strip().lower()) % size)
    v = np.zeros(size, np.float32)
    np.add.at(v, at, 1)
    v = np.log1p(v)
    return v / max(1e-6, float(np.linalg.norm(v)))


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _fitted(x: np.ndarray, y: np.ndarray, rounds: int) -> np.ndarray:
    weights = np.zeros((x.shape[1], y.shape[1]), np.float32)
    for _ in range(rounds):
        weights -= 2.0 * (x.T @ (_softmax(x @ weights) - y) / len(x) + 1e-3 * weights)
    return weights


def fit_classifier(labelled: DataFrame, classes: list[str], sample: int = 4_000, size: int = 1_024, rounds: int = 150, held_out: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """(softmax weights (size + 1, classes), whether any labelled row has the class, accuracy on held-out rows).

    Fitted to at most ``sample`` labelled rows, the first by a hash of doc_id; all are counted.
    Every held_out-th row is left out of a first fit, whose accuracy on them is given (nan with
    too few rows); the weights come from all rows.
    """
    # a hash range with about twice the sample is cut out first, so that little is sorted
    n = {r["class"]: r["n"] for r in labelled.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    there = np.array([n.get(c, 0) > 0 for c in classes])
    share = min(1.0, 2.0 * sample / max(1, sum(n.values())))
    some = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("text", "lang", "class").collect()
    if not rows:
        return np.zeros((size + 1, len(classes)), np.float32), np.ones(len(classes), bool), float("nan")
    x = np.stack([np.append(_features(r["text"], r["lang"], size), np.float32(1)) for r in rows])
    label = np.array([classes.index(r["class"]) for r in rows])
    y = np.eye(len(classes), dtype=np.float32)[label]
    out = np.arange(len(x)) % held_out == held_out - 1
    right = float((np.argmax(x[out] @ _fitted(x[~out], y[~out], rounds), axis=1) == label[out]).mean()) if out.any() else float("nan")
    return _fitted(x, y, rounds), there, right


def _measure(path: str, weights: np.ndarray, there: np.ndarray, classes: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _tokenizer(path)
        size = len(weights) - 1
        for b in batches:
            n = [len(e.ids) for e in t.encode_batch(b["text"].tolist(), add_special_tokens=False)]
            post = []
            for text, lang, c in zip(b["text"], b["lang"], b["class"]):
                if c is not None:  # the source is known
                    post.append([float(c == k) for k in classes])
                else:
                    z = np.append(_features(text, lang, size), np.float32(1)) @ weights
                    post.append(_softmax(np.where(there, z.astype(float), -np.inf)[None, :])[0].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "class": b["class"], "n_tokens": n, "posterior": post}).astype({"n_tokens": "int64"})

    return run


def fitted_rates(tokens: np.ndarray, caps: np.ndarray, want: np.ndarray, free: np.ndarray, rounds: int = 20_000, tolerance: float = 1e-6, waste: float = 3e-3) -> tuple[np.ndarray, float, int]:
    """(rate per stratum, largest residual as a share of all wanted tokens, rounds) of a least-squares fit by projected gradient steps.

    tokens [stratum, class]: expected tokens of a stratum drawn once; caps: its greatest rate;
    want: tokens per class, free: classes without a target; what a stratum has more of these
    than of the others costs ``waste`` a token. Steps follow the gradient of half the squared
    residuals plus that cost, with momentum, and are projected on 0 <= rate <= cap.
    """
    a = tokens * ~free
    total = max(float(want.sum()), 1e-300)
    scaled, cost = a / total, waste * np.maximum(0.0, tokens[:, free].sum(axis=1) - tokens[:, ~free].sum(axis=1)) / total
    norm = float(np.linalg.norm(scaled, 2)) ** 2 if scaled.size else 0.0
    rate = np.zeros(len(tokens))
    if norm == 0:
        return rate, float(np.abs(want[~free]).max(initial=0.0) / total) if want.sum() > 0 else 0.0, 0
    goal = np.where(free, 0.0, want) / total
    ahead, speed, k = rate.copy(), 1.0, 0
    for k in range(1, rounds + 1):
        new = np.clip(ahead - (scaled @ (scaled.T @ ahead - goal) + cost) / norm, 0.0, caps)
        if (not cost.any() and np.abs(scaled.T @ new - goal).max() <= tolerance) or np.abs(new - rate).max() <= 1e-7:
            rate = new
            break
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead = new + (speed - 1) / faster * (new - rate)
        rate, speed = new, faster
    return rate, float(np.abs(scaled.T @ rate - goal).max()), k


def mix_sources(
    docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER,
    sample: int = 4_000, strata: int = 10, may: float = 0.02,
) -> tuple[DataFrame, DataFrame]:
    """(draws, shares): how often each document is used, and the share that each source reaches.

    docs: doc_id, text, lang, source; targets: source, target_share, max_repeats. draws: doc_id,
    source (as spelled in the targets), n_tokens, rate, repeats - one row per document with a
    doc_id; null and empty texts have 0 tokens and no repeats. shares: source, target_share,
    wanted_share (over the sources that have documents), n_docs, n_tokens, drawn_tokens,
    actual_share, most_repeats, max_repeats, and of the fit: residual (the largest, as a share
    of all tokens), rounds, and the classifier's accuracy on held-out labelled rows.
    A document with a source has the posterior 1 for it: it is observed. Documents without one
    get posteriors over all sources from a classifier that is fitted to a bounded sample of
    labelled rows (sample). Their cap is the least max_repeats of the target sources that they
    are from with a probability of at least may, and at most the least above 0 of all; sources
    without a target are no reason to forbid a document: they weigh against it, as that part of
    its tokens serves no target, and count as drawn tokens of none. Documents known to be of a
    source without a target are not drawn. total_tokens None: the most at which every source
    with documents reaches its share.
    The rates solve a least-squares fit of expected tokens per source to the targets by
    projected gradient steps. Documents of one source, or of one likeliest source, one cap and
    one of ``strata`` ranges of its probability have one rate; their expected tokens per source
    are summed over all documents, so that the steps run on a table of bounded size and fit
    the sums exactly. Rates become whole repeats by a hash of doc_id.
    """
    goal = targets.select(plain_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    goal_rows = sorted(goal.groupBy("source").agg(F.sum("target_share").alias("q"), F.max("max_repeats").alias("m")).collect())
    classes = [r["source"] for r in goal_rows] + [OTHER]
    q = np.array([r["q"] or 0.0 for r in goal_rows] + [0.0])
    caps = np.array([float(r["m"] or 0) for r in goal_rows] + [0.0])
    named = plain_source(F.col("source"))
    src = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), named.alias("source")
    ).where("doc_id is not null")
    src = src.withColumn("class", F.when(F.col("source").isin(*classes[:-1]), F.col("source")).when(F.col("source").isNotNull(), F.lit(OTHER)))
    weights, there, accuracy = fit_classifier(src.where(F.col("class").isNotNull()), classes, sample)
    measured = src.mapInPandas(_measure(tokenizer, weights, there, classes), "doc_id bigint, source string, class string, n_tokens bigint, posterior array<double>")
    cap_list = F.array(*[F.lit(float(c)) for c in caps[:-1]]).cast("array<double>")
    likely = F.filter(F.arrays_zip(F.slice("posterior", 1, len(classes) - 1).alias("p"), cap_list.alias("m")), lambda x: x["p"] >= may)
    least = F.lit(float(min((c for c in caps[:-1] if c > 0), default=0.0)))
    of_class = F.element_at(F.create_map(*[x for c, m in zip(classes, caps) for x in (F.lit(c), F.lit(float(m)))]), F.col("class"))
    unknown = F.least(F.coalesce(F.array_min(F.transform(likely, lambda x: x["m"])), least), least)
    top = (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int")
    part = F.least(F.floor(F.array_max("posterior") * strata), F.lit(strata - 1)).cast("int")
    measured = measured.withColumn("cap", F.when(F.col("class").isNull(), unknown).otherwise(of_class))
    measured = measured.withColumn("stratum", F.concat_ws("/", F.when(F.col("class").isNull(), F.lit("?")).otherwise("="), top.cast("string"), F.when(F.col("class").isNull(), part.cast("string")), F.col("cap").cast("int").cast("string")))
    measured = materialize(measured, "measured")
    sums = measured.groupBy("stratum", "cap").agg(*[F.sum(F.col("n_tokens") * F.col("posterior")[k]).alias(f"c{k}") for k in range(len(classes))])
    rows = sorted(sums.collect())  # at most classes * (1 + strata * caps) rows
    tokens = np.array([[r[f"c{k}"] or 0.0 for k in range(len(classes))] for r in rows]).reshape(len(rows), len(classes))
    cap = np.array([r["cap"] for r in rows], float)
    most = cap @ tokens if len(rows) else np.zeros(len(classes))
    live = (q > 0) & (most > 0)
    wanted = np.where(live, q, 0.0)
    wanted = wanted / wanted.sum() if wanted.sum() > 0 else wanted
    total = float(total_tokens) if total_tokens is not None else float(min((most[k] / wanted[k] for k in np.flatnonzero(live)), default=0.0))
    free = np.zeros(len(classes), bool)
    free[-1] = True
    rates, residual, rounds = fitted_rates(tokens, cap, wanted * total, free)
    plan_rates = {r["stratum"]: float(x) for r, x in zip(rows, rates)}
    rate = F.coalesce(F.element_at(F.create_map(*[x for k, v in plan_rates.items() for x in (F.lit(k), F.lit(v))]), F.col("stratum")), F.lit(0.0)) if plan_rates else F.lit(0.0)
    rated = measured.withColumn("rate", rate)
    # whole repeats: within a stratum the cut through the hashes is where the tokens fit best
    bins = 4096
    u = F.pmod(F.xxhash64("doc_id"), F.lit(bins))
    hist = measured.groupBy("stratum", u.alias("b")).agg(F.sum("n_tokens").alias("t"))
    cut: dict[str, int] = {}
    for c, g in pd.DataFrame([tuple(r) for r in hist.collect()], columns=["c", "b", "t"]).groupby("c"):
        g = g.sort_values("b")
        need = (plan_rates[c] % 1.0) * g["t"].sum()
        reach = np.r_[0, g["t"].cumsum().to_numpy()]
        k = int(np.argmin(np.abs(reach - need)))
        cut[c] = 0 if k == 0 else int(g["b"].iloc[k - 1]) + 1
    cuts = F.coalesce(F.element_at(F.create_map(*[x for k, v in cut.items() for x in (F.lit(k), F.lit(v))]), F.col("stratum")), F.lit(0)) if cut else F.lit(0)
    repeats = F.when(F.col("n_tokens") > 0, F.least(F.floor("rate").cast("int") + (u < cuts).cast("int"), F.col("cap").cast("int"))).otherwise(0)
    draws = rated.select("doc_id", "source", "n_tokens", "posterior", "rate", repeats.alias("repeats"))
    p = lambda k: F.col("posterior")[k]
    aggregates = [
        x
        for k in range(len(classes))
        for x in (
            F.sum(p(k)).alias(f"d{k}"), F.sum(p(k) * F.col("n_tokens")).alias(f"t{k}"), F.sum(p(k) * F.col("n_tokens") * F.col("repeats")).alias(f"r{k}"),
            F.max(F.when(p(k) >= may, F.col("repeats"))).alias(f"m{k}"),
        )
    ]
    plan = [
        F.struct(
            F.lit(c).alias("source"), F.lit(float(q[k])).alias("target_share"), F.lit(float(wanted[k])).alias("wanted_share"), F.coalesce(F.col(f"d{k}"), F.lit(0.0)).alias("n_docs"),
            F.coalesce(F.col(f"t{k}"), F.lit(0.0)).alias("n_tokens"), F.coalesce(F.col(f"r{k}"), F.lit(0.0)).alias("drawn_tokens"),
            F.coalesce(F.col(f"m{k}"), F.lit(0)).alias("most_repeats"), F.lit(int(caps[k])).alias("max_repeats"),
        )
        for k, c in enumerate(classes)
    ]
    shares = draws.agg(*aggregates).select(F.explode(F.array(*plan)).alias("x"), functools.reduce(lambda a, b: a + b, [F.coalesce(F.col(f"r{k}"), F.lit(0.0)) for k in range(len(classes))]).alias("_all"))
    shares = shares.select(
        "x.source", "x.target_share", "x.wanted_share", "x.n_docs", "x.n_tokens", "x.drawn_tokens",
        F.when(F.col("_all") > 0, F.col("x.drawn_tokens") / F.col("_all")).otherwise(0.0).alias("actual_share"), "x.most_repeats", "x.max_repeats",
        F.lit(residual).alias("residual"), F.lit(rounds).alias("rounds"), F.lit(accuracy).alias("accuracy"),
    )
    return draws.drop("posterior"), shares
