"""Root search by plain regression with DataFrame operators only: no task holds a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.operators.trees import root_paths, subtree_sums
from cladeflow.runtime import materialize

EPOCH = 2000.0  # dates are taken from here, so that squares stay small


def root_regressions(nodes: DataFrame, dates: DataFrame, slope: float | None = None) -> DataFrame:
    """Per tree and root the point of the tree at which distance on date leaves least: tree_id, root_id, node_id, split, slope, chisq, n_dates.

    The point lies on the branch above node_id, at the share split of it from that node. slope
    given: with that rate (0: least deviation); else only points with a rate of 0 or more count.
    Trees with fewer than three dates or no spread of dates are left out.

    With the root at distance a above a node, the tips below are at their distance from the node
    plus a, all others at their distance minus a, so that the residual is a parabola in a whose
    least point is known. Its coefficients are sums over the tips below the node (n, t, D, ...)
    and over the others; a tip that leaves the path to the node where its depth is d is at
    D + D_node - 2 d, and sums of d are sums over the branches of the path of length times what
    lies below: subtree sums and path sums, both by doubling.
    """
    base = root_paths(nodes.select("tree_id", "node_id", "parent_id", "is_tip", "branch_length"))
    t = dates.where("lo is not null").select("tree_id", "node_id", ((F.col("lo") + F.col("hi")) / 2 - EPOCH).alias("t"))
    tips = base.join(t, ["tree_id", "node_id"], "left")
    d, on = F.col("dist2root"), F.col("t").isNotNull()
    value = lambda c: ("sum", F.when(on, c).otherwise(0.0))
    below = subtree_sums(
        tips.drop("depth", "root_id"),
        {"n": value(F.lit(1.0)), "st": value(F.col("t")), "sd": value(d), "stt": value(F.col("t") * F.col("t")), "std": value(F.col("t") * d), "sdd": value(d * d)},
    )
    ln = F.col("branch_length")
    path = {"l1": ln * F.col("n"), "lt": ln * F.col("st"), "ld": ln * F.col("sd"), "lq": (F.col("far") * F.col("far") - (F.col("far") - ln) * (F.col("far") - ln)) * F.col("n")}
    sums = ["n", "st", "sd", "stt", "std", "sdd"]
    whole = base.select("tree_id", "node_id", "parent_id", "branch_length", F.col("dist2root").alias("far")).join(below, ["tree_id", "node_id"], "left").fillna(0.0, sums)
    p = materialize(root_paths(whole, path), "path_sums")
    root = p.where("depth = 0").select("tree_id", "root_id", *[F.col(c).alias(f"all_{c}") for c in sums])
    x = p.where("depth > 0").join(root, ["tree_id", "root_id"]).where("all_n >= 3 and all_stt - all_st * all_st / all_n > 1e-9 and n > 0 and n < all_n")
    c = F.col
    rest = lambda k: c(f"all_{k}") - c(k)
    # below the node: distance f + a; elsewhere: e - a
    f1, ft, f2 = c("sd") - c("n") * c("far"), c("std") - c("far") * c("st"), c("sdd") - 2 * c("far") * c("sd") + c("n") * c("far") * c("far")
    l1, lt, ld, lq = c("l1") - c("far") * c("n"), c("lt") - c("far") * c("st"), c("ld") - c("far") * c("sd"), c("lq") - c("far") * c("far") * c("n")
    e1, et = rest("sd") + rest("n") * c("far") - 2 * l1, rest("std") + c("far") * rest("st") - 2 * lt
    e2 = rest("sdd") + rest("n") * c("far") * c("far") + 4 * lq + 2 * c("far") * rest("sd") - 4 * ld - 4 * c("far") * l1
    x = x.select(
        "tree_id", "root_id", "node_id", ln.alias("len"), c("all_n").alias("n"), (c("all_stt") - c("all_st") * c("all_st") / c("all_n")).alias("tt"),
        (f1 + e1).alias("b0"), (2 * c("n") - c("all_n")).alias("b1"), (f2 + e2).alias("a0"), (2 * (f1 - e1)).alias("a1"),
        (ft + et - c("all_st") * (f1 + e1) / c("all_n")).alias("u0"), (2 * c("st") - c("all_st") - c("all_st") * (2 * c("n") - c("all_n")) / c("all_n")).alias("u1"),
    )
    q0, q1, q2 = c("a0") - c("b0") * c("b0") / c("n"), c("a1") - 2 * c("b0") * c("b1") / c("n"), c("n") - c("b1") * c("b1") / c("n")
    if slope is None:
        q = (q0 - c("u0") * c("u0") / c("tt"), q1 - 2 * c("u0") * c("u1") / c("tt"), q2 - c("u1") * c("u1") / c("tt"))
        zero = -c("u0") / c("u1")
        lo = F.when(c("u1") > 0, F.greatest(F.lit(0.0), zero)).otherwise(0.0)
        hi = F.when(c("u1") < 0, F.least(c("len"), zero)).otherwise(c("len"))
        possible = (F.when(c("u1") == 0, c("u0") >= 0).otherwise(F.lit(True))) & (lo <= hi)
    else:
        q = (q0 - 2 * slope * c("u0") + slope * slope * c("tt"), q1 - 2 * slope * c("u1"), q2)
        lo, hi, possible = F.lit(0.0), c("len"), F.lit(True)
    x = x.withColumn("lo", lo).withColumn("hi", hi).where(possible)
    least = F.when(q[2] > 1e-12, -q[1] / (2 * q[2])).when(q[1] > 0, c("lo")).otherwise(c("hi"))
    x = x.withColumn("a", F.greatest(c("lo"), F.least(c("hi"), least)))
    chi = 0.5 * (q[0] + q[1] * c("a") + q[2] * c("a") * c("a"))
    rate = (c("u0") + c("u1") * c("a")) / c("tt") if slope is None else F.lit(float(slope))
    found = x.select("tree_id", "root_id", "node_id", F.when(c("len") > 0, c("a") / c("len")).otherwise(0.0).alias("split"), rate.alias("slope"), chi.alias("chisq"), c("n").cast("int").alias("n_dates"))
    best = found.groupBy("tree_id", "root_id").agg(F.min(F.struct(F.round("chisq", 11).alias("k"), "node_id", "split", "slope", "chisq", "n_dates")).alias("x"))
    return best.select("tree_id", "root_id", "x.node_id", "x.split", "x.slope", "x.chisq", "x.n_dates")
