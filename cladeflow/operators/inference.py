"""Likelihood inference on trees: numpy kernels, one task per tree or per tree and block of sites.

A tree's passes depend on one another, its sites do not: ancestral states run per (tree, block
of sites), with the tree's nodes copied to each block, so that one large alignment spreads over
many tasks. Clock and time-tree passes run per tree, or per tree and rate.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.kernels import ancestral as A
from cladeflow.kernels import clock as C
from cladeflow.kernels import pipeline as PL
from cladeflow.kernels.coalescent import Coalescent
from cladeflow.kernels.models import Model, SiteModel, infer, named
from cladeflow.kernels.timetree import TimeTree, grid_points
from cladeflow.kernels.tree import Tree
from cladeflow.operators.alignment import usual_lengths
from cladeflow.runtime import dimension_join, materialize, release, spread

NODE_COLUMNS = ["tree_id", "node_id", "parent_id", "child_ix", "name", "branch_length"]


def _trees(p: pd.DataFrame) -> list[Tree]:
    none = lambda c: [None if v is None or v != v else v for v in c]
    return Tree.from_rows(p["node_id"].tolist(), none(p["parent_id"]), none(p["branch_length"]), none(p["name"]), none(p["child_ix"]))


def site_counts(aln: DataFrame) -> DataFrame:
    """tree_id, sites: the number of columns of each tree's alignment."""
    return usual_lengths(aln).select("tree_id", F.col("total").alias("sites"))


def _with_sites(df: DataFrame, sites: int | DataFrame, default: int = 1000) -> DataFrame:
    """df with _sites: one number for all trees or those of site_counts; trees without an alignment get default."""
    if not isinstance(sites, DataFrame):
        return df.withColumn("_sites", F.lit(float(sites)))
    return dimension_join(df, sites.select("tree_id", F.col("sites").cast("double").alias("_sites")), ["tree_id"], "node_id").fillna(float(default), ["_sites"])


def _with_models(df: DataFrame, models: DataFrame | None) -> DataFrame:
    if models is None:
        return df
    return dimension_join(df, models.select("tree_id", "letters", "mu", "pi", "w"), ["tree_id"], "node_id")


def _model_of(p: pd.DataFrame, given: Model | None) -> Model:
    if given is None and "mu" in p and p["mu"].notna().any():
        r = p[p["mu"].notna()].iloc[0]
        return Model(tuple(r["letters"]), float(r["mu"]), list(r["pi"]), [list(x) for x in r["w"]])
    return given or named("jc69", letters="nuc_nogap")


def _tips_of(tree: Tree, seq: dict, model: Model) -> dict[int, np.ndarray]:
    return {int(i): model.profiles(seq[tree.ids[i]]) for i in tree.tips if isinstance(seq[tree.ids[i]], str)}


def _name(tree: Tree, i: int) -> str:
    """Name of a node; those that a rebuilt tree has made are named by their place."""
    return tree.name[i] or f"NODE_X{i:07d}"


def _states(method: str, make: Model | None, sample: int | None, pairs: bool = False):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        model, tree_id = _model_of(p, make), p["tree_id"].iloc[0]
        letters = np.frombuffer("".join(model.letters).encode("ascii"), np.uint8)
        out = []
        seq = dict(zip(p["node_id"], p["block_seq"]))
        start, total = int(p["start"].max()), int(p["total"].max())
        own_parent = dict(zip(p["node_id"], p["node_id"] == p["parent_id"]))
        for tree in _trees(p):
            tips = _tips_of(tree, seq, model)
            if len(tips) < 3:
                continue
            om = 1.0 / total
            if method == "fitch":
                bits = {i: (x @ (1 << np.arange(len(letters)))).astype(np.int64) for i, x in tips.items()}
                changes, st = A.fitch(tree, bits)
                lh = -changes.astype(float)
            elif method == "joint":
                lh, st = A.joint(tree, model, tips, om)
            else:
                lh, post = A.marginal(tree, model, tips, om)
                st = post.argmax(axis=2) if sample is None else A.sampled(post, np.random.default_rng([sample, start, zlib.crc32(f"{tree_id}/{tree.ids[0]}".encode())]))
            if pairs:
                q = len(letters)
                below = np.array([k for k in range(len(tree)) if k or own_parent.get(tree.ids[0])], np.int64)
                key = (np.arange(len(below))[:, None] * q + st[np.maximum(tree.parent[below], 0)]) * q + st[below]
                n = np.bincount(key.ravel(), minlength=len(below) * q * q).reshape(len(below), q * q)
                out += [(tree_id, tree.ids[k], x) for k, x in zip(below, n)]
                continue
            text, width = letters[st].tobytes().decode("ascii"), st.shape[1]
            out += [(tree_id, n, tree.ids[0], start, text[i * width : (i + 1) * width], float(lh.sum()) if i == 0 else None) for i, n in enumerate(tree.ids)]
        if pairs:
            return pd.DataFrame(out, columns=["tree_id", "node_id", "v"])
        return pd.DataFrame(out, columns=["tree_id", "node_id", "root_id", "start", "states", "log_lh"])

    return run


def site_blocks(nodes: DataFrame, aln: DataFrame, block: int = 200, cells: int = 2_000_000) -> DataFrame:
    """Nodes of each tree repeated per block of sites, tips with their letters of the block.

    aln: tree_id, taxon, seq in the columns of their tree, see tree_columns; a tip without a
    sequence, or with one that could not be placed, is wholly ambiguous. Blocks are shorter in
    large trees, so that nodes times sites stay below ``cells``.
    """
    aln = aln.where(F.col("seq").isNotNull())
    usual = usual_lengths(aln)
    odd = aln.join(usual, "tree_id").where(F.length("seq") != F.col("total")).select("tree_id", "taxon").take(1)
    if odd:
        raise ValueError(f"sequence {odd[0]['taxon']!r} is not in the columns of its tree: align it first (tree_columns)")
    size = nodes.groupBy("tree_id").agg(F.count(F.lit(1)).alias("_n"))
    long = F.greatest(F.lit(1), F.least(F.lit(block), (F.lit(cells) / F.col("_n")).cast("int")))
    blocks = usual.join(size, "tree_id").withColumn("len", long).withColumn("start", F.explode(F.sequence(F.lit(0), F.col("total") - 1, F.col("len")))).drop("_n")
    tips = nodes.where("is_tip").join(aln.select("tree_id", F.col("taxon").alias("name"), "seq"), ["tree_id", "name"]).select("tree_id", "node_id", "seq")
    all_nodes = nodes.select(*NODE_COLUMNS).join(tips, ["tree_id", "node_id"], "left")
    return all_nodes.join(blocks, "tree_id").withColumn("block_seq", F.substring(F.col("seq"), F.col("start") + 1, F.col("len"))).drop("seq")


def ancestral_states(
    nodes: DataFrame, aln: DataFrame, method: str = "marginal", model: Model | None = None, block: int = 200, models: DataFrame | None = None, sample: int | None = None,
) -> DataFrame:
    """tree_id, node_id, root_id, start, states, log_lh: most likely letters of every node by block of sites.

    method: marginal, joint or fitch (log_lh: minus the number of changes). model holds for all
    trees, models (see infer_models) has one per tree; without both JC69. sample: a seed - states
    are drawn from the marginal posteriors. log_lh stands at the root's rows. Trees with fewer
    than three sequences are left out.
    """
    schema = "tree_id string, node_id int, root_id int, start int, states string, log_lh double"
    return spread(_with_models(site_blocks(nodes, aln, block), models), "tree_id", "start").groupBy("tree_id", "start").applyInPandas(_states(method, model, sample), schema)


def ancestral_pairs(nodes: DataFrame, aln: DataFrame, method: str = "joint", model: Model | None = None, block: int = 200) -> DataFrame:
    """branch_state_pairs of ancestral_states, counted where the states are made: tree_id, node_id, anc, der, n."""
    letters = (model or named("jc69", letters="nuc_nogap")).letters
    q = len(letters)
    per = spread(site_blocks(nodes, aln, block), "tree_id", "start").groupBy("tree_id", "start").applyInPandas(_states(method, model, None, True), "tree_id string, node_id int, v array<bigint>")
    both = _summed(per, ["tree_id", "node_id"], q * q).select("tree_id", "node_id", F.posexplode("v").alias("k", "n")).where("n > 0")
    name = F.array(*[F.lit(c) for c in letters])
    return both.select("tree_id", "node_id", name[F.floor(F.col("k") / q).cast("int")].alias("anc"), name[F.col("k") % q].alias("der"), "n")


def _summed(blocks: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Arrays of one width summed element by element per key."""
    total = [F.sum(F.col("v")[k]).alias(f"s{k}") for k in range(width)]
    return blocks.groupBy(*keys).agg(*total).select(*keys, F.array(*[F.col(f"s{k}") for k in range(width)]).alias("v"))


def expected_branch_pairs(nodes: DataFrame, aln: DataFrame, model: Model | None = None, models: DataFrame | None = None, block: int = 200) -> DataFrame:
    """tree_id, root_id, node_id, v, log_lh: expected (parent, child) state pairs of each branch, v[parent * q + child], over all sites.

    Runs per tree and block of sites; the blocks' counts are summed. At a root, log_lh is that of
    the tree and v holds the root's expected states as pairs without a change.
    """
    q = len((model or named("jc69", letters="nuc_nogap")).letters) if models is None else len(models.select("letters").first()["letters"])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        m = _model_of(p, model)
        seq, out = dict(zip(p["node_id"], p["block_seq"])), []
        for t in _trees(p):
            tips = _tips_of(t, seq, m)
            if len(tips) < 3:
                continue
            lh, pairs = A.expected_pairs(t, m, tips, 1 / float(p["total"].max()))
            # the root's own states, as pairs without a change
            pairs[0] = np.diag(pairs[t.children[0][0]].reshape(q, q).sum(axis=1)).ravel()
            out += [(p["tree_id"].iloc[0], t.ids[0], t.ids[i], np.r_[pairs[i], lh if i == 0 else 0.0].tolist()) for i in range(len(t))]
        return pd.DataFrame(out, columns=["tree_id", "root_id", "node_id", "v"])

    per = spread(_with_models(site_blocks(nodes, aln, block), models), "tree_id", "start").groupBy("tree_id", "start").applyInPandas(run, "tree_id string, root_id int, node_id int, v array<double>")
    return _summed(per, ["tree_id", "root_id", "node_id"], q * q + 1).select("tree_id", "root_id", "node_id", F.slice("v", 1, q * q).alias("v"), F.get("v", F.lit(q * q)).alias("log_lh"))


_MODEL = "tree_id string, letters array<string>, mu double, pi array<double>, w array<array<double>>, log_lh double, rounds int"


def infer_models(nodes: DataFrame, aln: DataFrame, rounds: int = 5, pc: float = 1.0, letters: str = "nuc", tol: float = 0.1, fixed_pi: list[float] | None = None) -> DataFrame:
    """One time-reversible model per tree: tree_id, letters, mu, pi, w, log_lh, rounds.

    Alternates expected state pairs under the present models (JC69 first) with the models of
    greatest likelihood of these pairs, until no tree's likelihood moves by more than tol.
    """
    start = named("jc69", letters=letters)
    q = len(start.letters)
    models, last = None, None
    for k in range(rounds):
        pairs = expected_branch_pairs(nodes, aln, None if k else start, models)
        par, chi = np.divmod(np.arange(q * q), q)

        def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                v = np.stack(b["v"].to_numpy()) if len(b) else np.empty((0, q * q))
                root = (b["node_id"] == b["root_id"]).to_numpy()[:, None]
                change = np.where(par == chi, 0.0, v)
                half = np.where(root, 0.0, 0.5 * b["branch_length"].to_numpy()[:, None] * v)
                time = np.stack([half[:, par == s].sum(axis=1) + half[:, chi == s].sum(axis=1) for s in range(q)], axis=1)
                yield pd.DataFrame({"tree_id": b["tree_id"], "v": np.hstack([change, time, np.where(root, v[:, par == chi], 0.0), b["log_lh"].to_numpy()[:, None]]).tolist()})

        timed = pairs.join(nodes.select("tree_id", "node_id", "branch_length"), ["tree_id", "node_id"])
        sums = _summed(timed.select("tree_id", "root_id", "node_id", "v", "branch_length", "log_lh").mapInPandas(stats, "tree_id string, v array<double>"), ["tree_id"], q * q + 2 * q + 1)

        def fit(batches: Iterator[pd.DataFrame], k=k) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for tree_id, v in zip(b["tree_id"], b["v"]):
                    v = np.asarray(v, float)
                    m = infer(v[: q * q].reshape(q, q).T, v[q * q : q * q + q], v[q * q + q : -1], letters, fixed_pi, pc)
                    out.append((tree_id, list(m.letters), float(m.mu), m.pi.tolist(), m.w.tolist(), float(v[-1]), k + 1))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _MODEL.split(", ")])

        models = materialize(sums.mapInPandas(fit, _MODEL), "models")
        if last is not None:
            moved = models.join(last.select("tree_id", F.col("log_lh").alias("_l")), "tree_id").where(F.abs(F.col("log_lh") - F.col("_l")) > tol).limit(1).count()
            release(last)
            if not moved:
                break
        last = models
    return models


def infer_site_models(nodes: DataFrame, aln: DataFrame, pc: float = 1.0, model: Model | None = None, block: int = 200) -> DataFrame:
    """Rate and frequencies of every site, with exchange rates shared by a tree's sites: tree_id, pos, mu, pi, w.

    Expected substitutions and times per site come from blocks under the model (JC69); they are
    q * q + 2 q numbers a site, and a tree's fit takes those of all its sites.
    """
    m = model or named("jc69", letters="nuc_nogap")
    q = len(m.letters)

    def stats(p: pd.DataFrame) -> pd.DataFrame:
        seq, out, start = dict(zip(p["node_id"], p["block_seq"])), [], int(p["start"].max())
        for t in _trees(p):
            tips = _tips_of(t, seq, m)
            if len(tips) >= 3:
                n, time, root = A.site_statistics(t, m, tips, 1 / float(p["total"].max()))
                v = np.vstack([n.reshape(q * q, -1), time, root]).T
                out += [(p["tree_id"].iloc[0], start + k, x.tolist()) for k, x in enumerate(v)]
        return pd.DataFrame(out, columns=["tree_id", "pos", "v"])

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos")
        v = np.stack(p["v"].to_numpy())
        site = SiteModel.infer(v[:, : q * q].T.reshape(q, q, -1), v[:, q * q : q * q + q].T, v[:, q * q + q :].T, m.letters, pc)
        w = site.sites[0].w.ravel().tolist()
        return pd.DataFrame({"tree_id": p["tree_id"], "pos": p["pos"], "mu": [s.mu for s in site.sites], "pi": [s.pi.tolist() for s in site.sites], "w": [w] * len(p)})

    per = spread(site_blocks(nodes, aln, block), "tree_id", "start").groupBy("tree_id", "start").applyInPandas(stats, "tree_id string, pos int, v array<double>")
    per = _summed(per, ["tree_id", "pos"], q * q + 2 * q)
    return spread(per, "tree_id").groupBy("tree_id").applyInPandas(fit, "tree_id string, pos int, mu double, pi array<double>, w array<double>")


def _dated(p: pd.DataFrame, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = dict(zip(p["node_id"], p["lo"])), dict(zip(p["node_id"], p["hi"]))
    return np.array([lo.get(i, np.nan) for i in tree.ids], float), np.array([hi.get(i, np.nan) for i in tree.ids], float)


def _with_dates(nodes: DataFrame, dates: DataFrame, sites: int | DataFrame) -> DataFrame:
    d = nodes.select(*NODE_COLUMNS).join(dates.select("tree_id", "node_id", "lo", "hi"), ["tree_id", "node_id"], "left")
    return _with_sites(d, sites)


_CLOCK = "tree_id string, root_id int, node_id int, split double, slope double, intercept double, chisq double, r_val double, n_dates int, rate_std double, root_date double, root_date_std double"


def _best_root(covariation: bool, mode: str | list[str], slope: float | None):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        om = 1 / float(p["_sites"].max())
        for tree in _trees(p):
            lo, hi = _dated(p, tree)
            date, good = (lo + hi) / 2, ~np.isnan(lo)
            if good.sum() < 3 or np.ptp(date[good]) == 0:
                continue
            node, split = PL.root_place(tree, date, good, om, mode, covariation, slope)
            new = tree.reroot(node, split)
            lo2, hi2 = _dated(p, new)
            m = C.clock_model(new, (lo2 + hi2) / 2, ~np.isnan(lo2), C.variances(new, om, covariation), 0.0 if mode == "min_dev" else slope)
            out.append((p["tree_id"].iloc[0], tree.ids[0], tree.ids[node], split, *(m[k] for k in ("slope", "intercept", "chisq", "r_val")), int(good.sum()), m["rate_std"], m["root_date"], m["root_date_std"]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _CLOCK.split(", ")])

    return run


def best_roots(nodes: DataFrame, dates: DataFrame, sites: int | DataFrame = 1000, covariation: bool = False, slope: float | None = None, mode: str | list[str] = "best") -> DataFrame:
    """Per tree the branch (its lower node) and split at which it is rooted, and the clock there.

    mode: best or least-squares; min_dev (slope 0); oldest - at the oldest tip; or names of tips
    or nodes, whose common ancestor becomes the root. nodes with lo and hi from dates (tree_id,
    node_id). One task per tree; root_regressions does the plain regression without that.
    """
    return spread(_with_dates(nodes, dates, sites), "tree_id").groupBy("tree_id").applyInPandas(_best_root(covariation, mode, slope), _CLOCK)


_LOCAL = "tree_id string, node_id int, name string, given_date double, apparent_date double, z double, diagnosis string"


def _local(z_most: float):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        sites = float(p["_sites"].max())
        for tree in _trees(p):
            lo, hi = _dated(p, tree)
            date, good = (lo + hi) / 2, ~np.isnan(lo)
            if good.sum() < 3:
                continue
            node, split = PL.root_place(tree, date, good, 1 / sites, "best", False, None)
            tree = tree.reroot(node, split)
            lo, hi = _dated(p, tree)
            date, good = (lo + hi) / 2, ~np.isnan(lo)
            slope = C.clock_model(tree, date, good, C.variances(tree, 1 / sites, False))["slope"]
            for i, z, tau, why in PL.local_outliers(tree, date, good, slope, sites, z_most):
                out.append((p["tree_id"].iloc[0], tree.ids[i], tree.name[i], date[i], tau, z, why))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _LOCAL.split(", ")])

    return run


def local_outliers(nodes: DataFrame, dates: DataFrame, sites: int | DataFrame = 1000, z_most: float = 3.0) -> DataFrame:
    """Tips whose dates do not fit a local clock on the tree at its best root, with a diagnosis."""
    return spread(_with_dates(nodes, dates, sites), "tree_id").groupBy("tree_id").applyInPandas(_local(z_most), _LOCAL)


_ROOTED = (
    "tree_id string, root_id int, ix int, parent_ix int, node_id int, name string, branch_length double, dist2root double, date double, residual double, "
    "is_outlier boolean, slope double, intercept double, chisq double, r_val double, rate_std double, root_date double, root_date_std double"
)


def _rooted(o: PL.Options):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tree in _trees(p):
            lo, hi = _dated(p, tree)
            r = PL.rooted_tree(tree, lo, hi, float(p["_sites"].max()), o)
            if r is None:
                continue
            m = r.clock()
            depth = r.tree.depth()
            for i, n in enumerate(r.tree.ids):
                date = float(np.mean(r.date[n])) if n in r.date else np.nan
                off = depth[i] - m["intercept"] - m["slope"] * date
                out.append((p["tree_id"].iloc[0], tree.ids[0], i, int(r.tree.parent[i]), n, _name(r.tree, i), r.tree.length[i], depth[i], date, off, n in r.out, *(m[k] for k in ("slope", "intercept", "chisq", "r_val", "rate_std", "root_date", "root_date_std"))))
        f = pd.DataFrame(out, columns=[c.split()[0] for c in _ROOTED.split(", ")])
        f["node_id"] = f["node_id"].astype("Int32")
        return f

    return run


def clock_trees(nodes: DataFrame, dates: DataFrame, sites: int | DataFrame = 1000, **options) -> DataFrame:
    """Trees rerooted, filtered and rerooted without the outliers, with the clock found: one row per node.

    options as in kernels.pipeline.Options: reroot, clock_filter, filter_method, covariation, rate.
    """
    return spread(_with_dates(nodes, dates, sites), "tree_id").groupBy("tree_id").applyInPandas(_rooted(PL.Options(**options)), _ROOTED)


_TIME = (
    "tree_id string, root_id int, ix int, parent_ix int, node_id int, name string, branch_length double, date double, lower double, upper double, "
    "rate_factor double, is_outlier boolean, bad_branch boolean, slope double, log_lh double, info string"
)


def _time(o: PL.Options, model: Model | None):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        m = _model_of(p, model)
        pairs = {i: np.asarray(v, float) for i, v in zip(p["node_id"], p["v"]) if v is not None} if "v" in p else None
        for tree in _trees(p):
            lo, hi = _dated(p, tree)
            r = PL.dated_tree(tree, lo, hi, float(p["_sites"].max()), o, m, pairs)
            if r is None:
                continue
            for i in range(len(r.tree)):
                out.append(
                    (
                        p["tree_id"].iloc[0], tree.ids[0], i, int(r.tree.parent[i]), r.tree.ids[i], _name(r.tree, i), r.tree.length[i], r.times[i], r.lower[i], r.upper[i],
                        r.gamma[i], bool(r.outlier[i]), bool(r.bad[i]), r.slope, r.log_lh if i == 0 else None, json.dumps(r.info) if i == 0 else None,
                    )
                )
        f = pd.DataFrame(out, columns=[c.split()[0] for c in _TIME.split(", ")])
        f["node_id"] = f["node_id"].astype("Int32")
        return f

    return run


def time_trees(
    nodes: DataFrame, dates: DataFrame, sites: int | DataFrame = 1000, marginal: bool = False, rate: float | None = None, grid: int | None = None,
    relax: tuple[float, float] | None = None, coalescent: bool | float | str = False, resolve: bool | str = False, confidence: float = 0.9,
    pairs: DataFrame | None = None, model: Model | None = None, models: DataFrame | None = None, **more,
) -> DataFrame:
    """Dates of all nodes per tree: joint best times, or marginal means with a confidence region.

    The nodes are those of the tree after it was rerooted and resolved: ix and parent_ix are
    their places in it, node_id is null for nodes that were made. Options as in
    kernels.pipeline.Options: relax (slack, coupling) of autocorrelated branch rates; coalescent -
    True for the best constant Tc, a number for that Tc in branch lengths, "skyline" for a
    piecewise linear Tc; resolve - polytomies, True greedily, "stochastic" by a coalescent; more -
    reroot, clock_filter, max_iter, and so on. pairs (expected_branch_pairs, with the model they
    were made with) dates by sequences, else branch lengths count. info (at the root) is JSON
    with the trace of the iterations and the skyline. Trees with fewer than three dated tips are
    left out. One task per tree; memory grows with nodes times grid points.
    """
    o = PL.Options(marginal=marginal, rate=rate, grid=grid, relax=relax, coalescent=coalescent, resolve=resolve, confidence=confidence, **more)
    d = _with_models(_with_dates(nodes, dates, sites), models)
    if pairs is not None:
        d = d.join(pairs.select("tree_id", "node_id", "v"), ["tree_id", "node_id"], "left")
    return spread(d, "tree_id").groupBy("tree_id").applyInPandas(_time(o, model), _TIME)


_COAL = "tree_id string, root_id int, n_nodes int, tc double, log_lh double, sky_t array<double>, sky_tc array<double>, sky_lower array<double>, sky_upper array<double>, seen_t array<double>, seen_tc array<double>"


def _coalescent(points: int, n_std: float):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tree in _trees(p):
            if len(tree) < 4:
                continue
            d = tree.depth()
            co = Coalescent(tree, d.max() - d)
            tc = co.best_tc()
            x = y = lo = hi = np.empty(0)
            if points and len(tree) >= 10 and tc > 0:
                x, y, sd = co.skyline(points)
                lo, hi = y * np.exp(-n_std * sd), y * np.exp(n_std * sd)
            out.append((p["tree_id"].iloc[0], tree.ids[0], len(tree), tc, co.log_lh(max(tc, 1e-12)), x.tolist(), y.tolist(), lo.tolist(), hi.tolist(), *(z.tolist() for z in co.empirical_skyline())))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _COAL.split(", ")])

    return run


def coalescent_fits(nodes: DataFrame, points: int = 0, n_std: float = 2.0) -> DataFrame:
    """Constant Tc of greatest likelihood, its log likelihood and, with points > 0, a skyline with its bounds; seen_t, seen_tc: observed against expected mergers in a sliding window. Time in branch lengths."""
    return spread(nodes.select(*NODE_COLUMNS), "tree_id").groupBy("tree_id").applyInPandas(_coalescent(points, n_std), _COAL)


_TRAIT = "tree_id string, root_id int, node_id int, state string, probability double, rate double, profile map<string,double>, model string"


def _traits(pc: float, rounds: int, bias: float | None, weights: dict | None):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        trait = dict(zip(p["node_id"], p["trait"]))
        for tree in _trees(p):
            known = {int(i): trait[tree.ids[i]] for i in tree.tips if isinstance(trait[tree.ids[i]], str)}
            letters = tuple(sorted(set(known.values())))
            if len(letters) < 2 or len(known) < 3:
                continue
            q = len(letters)
            fixed = None if weights is None else [weights.get(c, np.mean(list(weights.values()))) for c in letters]
            tips = {i: np.eye(q)[[letters.index(known[i])]] if i in known else np.ones((1, q)) for i in map(int, tree.tips)}
            model, om = Model(letters, 1.0, fixed), 1e-3
            for _ in range(rounds):
                _, post = A.marginal(tree, model, tips, om)
                st = post.argmax(axis=2)
                n, t, root = A.statistics(tree, st, q, np.ones(1))
                model = A.best_rate(tree, infer(n, t, root, letters, fixed, pc), tips, om)
            if bias:
                model = Model(letters, model.mu * bias, model.pi, model.w)
            _, post = A.marginal(tree, model, tips, om)
            for i in range(len(tree)):
                k = int(post[i, 0].argmax())
                profile = {c: float(x) for c, x in zip(letters, post[i, 0])}
                out.append((p["tree_id"].iloc[0], tree.ids[0], tree.ids[i], letters[k], float(post[i, 0, k]), model.mu, profile, model.text() if i == 0 else None))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _TRAIT.split(", ")])

    return run


def discrete_traits(nodes: DataFrame, traits: DataFrame, pc: float = 1.0, rounds: int = 5, bias: float | None = None, weights: dict | None = None) -> DataFrame:
    """Most likely trait of every node and its probability; the rates between states are inferred per tree.

    traits: tree_id, node_id, trait (null: unknown). weights: fixed frequencies of states. profile
    has the probabilities of all states; model, at the root, the model as text.
    """
    d = nodes.select(*NODE_COLUMNS).join(traits.select("tree_id", "node_id", "trait"), ["tree_id", "node_id"], "left")
    return spread(d, "tree_id").groupBy("tree_id").applyInPandas(_traits(pc, rounds, bias, weights), _TRAIT)


def branch_state_pairs(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counted (parent, child) letters of each branch: tree_id, node_id, anc, der, n, from ancestral_states."""
    s = states.select("tree_id", "node_id", "start", "states")
    up = s.select("tree_id", F.col("node_id").alias("parent_id"), "start", F.col("states").alias("_up"))
    both = s.join(nodes.select("tree_id", "node_id", "parent_id"), ["tree_id", "node_id"]).join(up, ["tree_id", "parent_id", "start"])
    pair = F.explode(F.arrays_zip(F.split("_up", "").alias("a"), F.split("states", "").alias("d"))).alias("x")
    return both.select("tree_id", "node_id", pair).groupBy("tree_id", "node_id", F.col("x.a").alias("anc"), F.col("x.d").alias("der")).agg(F.count(F.lit(1)).alias("n"))


def counted_pairs(pairs: DataFrame, letters: tuple[str, ...]) -> DataFrame:
    """branch_state_pairs as arrays: tree_id, node_id, v[parent * q + child] over the letters; others are left out."""
    at = F.create_map(*[x for k, c in enumerate(letters) for x in (F.lit(c), F.lit(k))])
    q = len(letters)
    key = at[F.col("anc")] * q + at[F.col("der")]
    m = pairs.withColumn("_k", key).where("_k is not null").groupBy("tree_id", "node_id").agg(F.map_from_entries(F.collect_list(F.struct("_k", F.col("n").cast("double").alias("n")))).alias("_m"))
    return m.select("tree_id", "node_id", F.transform(F.sequence(F.lit(0), F.lit(q * q - 1)), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0))).alias("v"))


def branch_lengths(pairs: DataFrame, model: Model | None = None) -> DataFrame:
    """Branch lengths of greatest likelihood from counted state pairs: tree_id, node_id, length, hamming."""
    m = model or named("jc69", letters="nuc_nogap")
    q = len(m.letters)
    at = {c: k for k, c in enumerate(m.letters)}

    def run(batches):
        par, chi = np.divmod(np.arange(q * q), q)
        for b in batches:
            n = np.zeros((len(b), q * q))
            for r, (keys, values) in enumerate(zip(b["k"], b["n"])):
                for key, v in zip(keys, values):
                    if key[0] in at and key[1] in at:
                        n[r, at[key[0]] * q + at[key[1]]] += v
            total = n.sum(axis=1)
            yield pd.DataFrame({"tree_id": b["tree_id"], "node_id": b["node_id"], "length": A.branch_lengths(m, par, chi, n), "hamming": n[:, par != chi].sum(axis=1) / np.maximum(total, 1)})

    per = pairs.groupBy("tree_id", "node_id").agg(F.collect_list(F.concat("anc", "der")).alias("k"), F.collect_list("n").alias("n"))
    return per.mapInPandas(run, "tree_id string, node_id int, length double, hamming double")


def simulate_alignments(nodes: DataFrame, length: int, model: Model | None = None, seed: int = 1, block: int = 500, inner: bool = False) -> DataFrame:
    """Sequences evolved down each tree: tree_id, node_id, name, start, seq; blocks of sites have seeds of their own."""
    m = model or named("jc69", letters="nuc_nogap")
    blocks = nodes.select(*NODE_COLUMNS).withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(length - 1), F.lit(block))))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        start, out = int(p["start"].iloc[0]), []
        for t in _trees(p):
            rng = np.random.default_rng([seed, start, zlib.crc32(f"{p['tree_id'].iloc[0]}/{t.ids[0]}".encode())])
            st = A.simulate(t, m, min(block, length - start), rng)
            for i in range(len(t)) if inner else t.tips:
                out.append((p["tree_id"].iloc[0], t.ids[i], t.name[i], start, "".join(np.array(m.letters)[st[i]])))
        return pd.DataFrame(out, columns=["tree_id", "node_id", "name", "start", "seq"])

    return spread(blocks, "tree_id", "start").groupBy("tree_id", "start").applyInPandas(run, "tree_id string, node_id int, name string, start int, seq string")


def _rates_once(p: pd.DataFrame, grid: int | None) -> pd.DataFrame:
    at = int(p["factor"].iloc[0])
    out, om = [], 1 / float(p["_sites"].max())
    for tree in _trees(p):
        lo, hi = _dated(p, tree)
        good = ~np.isnan(lo)
        if good.sum() < 3:
            continue
        m = C.clock_model(tree, (lo + hi) / 2, good, C.variances(tree, om, False))
        if not m["slope"] > 0:
            continue
        rate = max(0.1 * m["slope"], m["slope"] + at * m["rate_std"])
        _, t = TimeTree(tree, lo, hi, rate, om, grid or grid_points(1 / om)).joint()
        out += [(p["tree_id"].iloc[0], tree.ids[i], at, t[i]) for i in range(len(tree))]
    return pd.DataFrame(out, columns=["tree_id", "node_id", "factor", "date"])


def rate_susceptibility(nodes: DataFrame, dates: DataFrame, sites: int | DataFrame = 1000, grid: int | None = None) -> DataFrame:
    """Dates at the fitted clock rate and one standard deviation below (at least a tenth of it) and above: tree_id, node_id, date, lower, upper.

    One task per tree and rate.
    """
    each = _with_dates(nodes, dates, sites).withColumn("factor", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    ran = spread(each, "tree_id", "factor").groupBy("tree_id", "factor").applyInPandas(lambda p: _rates_once(p, grid), "tree_id string, node_id int, factor int, date double")
    return ran.groupBy("tree_id", "node_id").agg(
        F.max(F.when(F.col("factor") == 0, F.col("date"))).alias("date"), F.min("date").alias("lower"), F.max("date").alias("upper")
    )


def tree_layout(nodes: DataFrame) -> DataFrame:
    """Plot frame: tree_id, node_id, x (distance from the root), y (tips in order, inner nodes amid their children)."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t in _trees(p):
            y = np.zeros(len(t))
            y[t.tips] = np.arange(1, len(t.tips) + 1)
            for i in t.postorder:
                if t.children[i]:
                    k = y[t.children[i]]
                    y[i] = (k.min() + k.max()) / 2
            x = t.depth()
            out += [(p["tree_id"].iloc[0], t.ids[i], x[i], y[i]) for i in range(len(t))]
        return pd.DataFrame(out, columns=["tree_id", "node_id", "x", "y"])

    return spread(nodes.select(*NODE_COLUMNS), "tree_id").groupBy("tree_id").applyInPandas(run, "tree_id string, node_id int, x double, y double")


def reassortment_clades(nodes: DataFrame, mccs: DataFrame) -> DataFrame:
    """Clade of common history of each node from its tips' (tree_id, name, mcc): tree_id, node_id, mcc, shared (with the parent)."""
    d = nodes.select(*NODE_COLUMNS).join(mccs.select("tree_id", "name", "mcc"), ["tree_id", "name"], "left")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        known, out = dict(zip(p["node_id"], p["mcc"])), []
        for t in _trees(p):
            m = A.mcc_of_nodes(t, {int(i): int(known[t.ids[i]]) for i in t.tips if known[t.ids[i]] == known[t.ids[i]] and known[t.ids[i]] is not None})
            out += [(p["tree_id"].iloc[0], t.ids[i], int(m[i]), bool(i and m[i] >= 0 and m[i] == m[t.parent[i]])) for i in range(len(t))]
        return pd.DataFrame(out, columns=["tree_id", "node_id", "mcc", "shared"])

    return spread(d, "tree_id").groupBy("tree_id").applyInPandas(run, "tree_id string, node_id int, mcc int, shared boolean")


def optimised_trees(nodes: DataFrame, aln: DataFrame, model: Model | None = None, models: DataFrame | None = None, rounds: int = 8, damping: float = 0.75, tol: float = 0.1) -> DataFrame:
    """Branch lengths after alternating expected state pairs and lengths: tree_id, node_id, length, log_lh, rounds.

    The pairs are made per block of sites, the lengths per tree from their sums. A tree whose
    log likelihood moves by no more than tol keeps its lengths; the rest goes on, damped.
    """
    given = None if models is not None else model or named("jc69", letters="nuc_nogap")
    schema = "tree_id string, root_id int, node_id int, length double, log_lh double, rounds int"
    live, rested = materialize(nodes, "live"), []
    before: DataFrame | None = None

    def moved(share: float, k: int):
        def run(p: pd.DataFrame) -> pd.DataFrame:
            out, mine = [], _model_of(p, given)
            v = dict(zip(p["node_id"], p["v"]))
            for t in _trees(p):
                if v[t.ids[0]] is None:
                    continue
                lh = float(p.loc[p["node_id"] == t.ids[0], "log_lh"].iloc[0])
                new = A.damped_lengths(t, mine, np.stack([v[i] for i in t.ids]), share)
                out += [(p["tree_id"].iloc[0], t.ids[0], t.ids[i], float(new[i]), lh, k) for i in range(len(t))]
            return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

        return run

    for k in range(rounds):
        pairs = expected_branch_pairs(live, aln, given, models)
        d = _with_models(live.select(*NODE_COLUMNS).join(pairs, ["tree_id", "node_id"], "left"), models)
        now = materialize(spread(d, "tree_id").groupBy("tree_id").applyInPandas(moved(damping ** (k + 1), k + 1), schema), "lengths")
        if k == rounds - 1:
            rested.append(now)
            break
        going = now
        if before is not None:
            was = before.groupBy("tree_id", "root_id").agg(F.max("log_lh").alias("_l"))
            still = now.select("tree_id", "root_id", "log_lh").distinct().join(was, ["tree_id", "root_id"]).where(F.abs(F.col("log_lh") - F.col("_l")) > tol).select("tree_id").distinct()
            still = materialize(still, "still")
            rested.append(now.join(still, "tree_id", "left_anti"))
            going = now.join(still, "tree_id", "left_semi")
            if still.isEmpty():
                break
        live = materialize(live.join(going.select("tree_id", "node_id", "length"), ["tree_id", "node_id"]).withColumn("branch_length", F.col("length")).drop("length"), "live")
        before = now
    return reduce(DataFrame.unionByName, rested).drop("root_id")
