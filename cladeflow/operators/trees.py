"""Relational operators on trees: one row per node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.operators.references import plain_name
from cladeflow.operators.times import normalise_times
from cladeflow.runtime import materialize, release, salt_hot


def current_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node, its latest; tips that are removed now are left out.

    Missing and negative branch lengths count as zero. Columns: tree_id, node_id, parent_id,
    child_ix, name, is_tip, branch_length.
    """
    last = F.max(F.struct("loaded_at", F.coalesce(F.col("deleted_at").isNull(), F.lit(False)).alias("here"), "parent_id", "child_ix", "name", "is_tip", "branch_length"))
    one = nodes.groupBy("tree_id", "node_id").agg(last.alias("x"))
    return one.where("not (x.is_tip and not x.here)").select(
        "tree_id", "node_id", "x.parent_id", "x.child_ix", "x.name", "x.is_tip",
        F.greatest(F.coalesce("x.branch_length", F.lit(0.0)), F.lit(0.0)).alias("branch_length"),
    )


def _open_pointers(at: DataFrame, up: DataFrame, rows_per_salt: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(rows that have reached a root, rows joined to what their pointer has reached); pointers of many rows are salted."""
    left, right, by = salt_hot(at.where("_ptr is not null"), up, ["tree_id", "_ptr"], "node_id", rows_per_salt)
    return at.where("_ptr is null"), left.join(right, by, "left").drop("_cf_salt")


def _parents(nodes: DataFrame) -> DataFrame:
    """nodes with _ptr, the parent where it exists."""
    there = nodes.select("tree_id", F.col("node_id").alias("_ptr"), F.lit(True).alias("_there"))
    done, joined = _open_pointers(nodes.withColumn("_ptr", F.col("parent_id")), there)
    reach = F.when(F.col("_there"), F.col("_ptr"))
    return done.unionByName(joined.withColumn("_ptr", reach).drop("_there"))


def root_paths(nodes: DataFrame, sums: dict | None = None) -> DataFrame:
    """nodes with depth, dist2root and root_id, and with sums (name -> column) taken over the branches up to the root.

    Pointer doubling: each round a node adds the sums of the ancestor it has reached and takes
    over its pointer, so that a tree of depth d takes log2(d) joins of narrow rows; every round
    is written to the shared folder and the one before deleted. A parent that does not exist
    makes a root. A cycle is reported as an error.
    """
    sums = {"depth": F.lit(1), "dist2root": F.col("branch_length"), **(sums or {})}
    keep = [c for c in nodes.columns if c not in ("tree_id", "node_id")]
    far = F.col("_ptr").isNotNull()
    # what belongs to a root's own branch lies above the root
    first = [F.when(far, c).otherwise(F.lit(0) if n == "depth" else F.lit(0.0)).alias(n) for n, c in sums.items()]
    at = materialize(_parents(nodes).select("tree_id", "node_id", *keep, "_ptr", *first, F.coalesce("_ptr", "node_id").alias("root_id")), "paths")
    total = at.count()
    while at.where(far).limit(1).count():
        if at.agg(F.max("depth")).first()[0] > total:
            raise ValueError("the parents of some nodes form a cycle")
        up = at.select("tree_id", F.col("node_id").alias("_ptr"), F.col("_ptr").alias("_next"), F.col("root_id").alias("_r"), *[F.col(n).alias(f"_s_{n}") for n in sums])
        done, joined = _open_pointers(at, up)
        more = [(F.col(n) + F.col(f"_s_{n}")).alias(n) for n in sums]
        moved = joined.select("tree_id", "node_id", *keep, F.col("_next").alias("_ptr"), *more, F.col("_r").alias("root_id"))
        last, at = at, materialize(done.unionByName(moved), "paths")
        release(last)
    return at.drop("_ptr")


#: What subtree_sums can do: how values of one node combine with those of the nodes below.
_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)), "every": (F.every, lambda a, b: F.coalesce(a & b, a, b)),
}


def subtree_sums(nodes: DataFrame, values: dict) -> DataFrame:
    """Aggregates over the tips at or below each node: tree_id, node_id, <name>...; nodes without tips are left out.

    values: name -> (kind, column of a tip), kind one of sum, max, min, every. Doubling: after
    round k a node holds what lies less than 2^k branches below it; the next round adds what
    its descendants exactly 2^k below hold. log2(depth) rounds of narrow rows, combined before
    each shuffle, whatever the shape of the trees.
    """
    names = list(values)
    own = [F.when(F.col("is_tip"), c).alias(n) for n, (_, c) in values.items()]
    at = materialize(_parents(nodes).select("tree_id", "node_id", "_ptr", F.when(F.col("is_tip"), 1).otherwise(0).alias("_tips"), *own), "sums")
    ptr = at.select("tree_id", "node_id", "_ptr")
    while at.where("_ptr is not null").limit(1).count():
        agg = [_COMBINE[values[n][0]][0](n).alias(f"_b_{n}") for n in names]
        below = at.where("_ptr is not null").groupBy("tree_id", F.col("_ptr").alias("node_id")).agg(F.sum("_tips").alias("_b_tips"), *agg)
        both = at.join(below, ["tree_id", "node_id"], "left")
        both = both.select(
            "tree_id", "node_id", "_ptr", (F.col("_tips") + F.coalesce("_b_tips", F.lit(0))).alias("_tips"),
            *[_COMBINE[values[n][0]][1](F.col(n), F.col(f"_b_{n}")).alias(n) for n in names],
        )
        up = ptr.select("tree_id", F.col("node_id").alias("_ptr"), F.col("_ptr").alias("_next"))
        done, joined = _open_pointers(both, up)
        last, at = at, materialize(done.unionByName(joined.withColumn("_ptr", F.col("_next")).drop("_next")), "sums")
        ptr = at.select("tree_id", "node_id", "_ptr")
        release(last)
    return at.where("_tips > 0").select("tree_id", "node_id", *names)


def children_counts(nodes: DataFrame) -> DataFrame:
    """Number of children of each inner node; more than 2: a polytomy."""
    return nodes.where("parent_id is not null").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_children"))


TIME_FIELDS = ["date_str", "raw_date_constraint"]


def tip_dates(nodes: DataFrame, metadata: DataFrame, labs: DataFrame, fields: list[str] = TIME_FIELDS) -> DataFrame:
    """tips with lo and hi decimal years, null where no value of their name denotes a moment.

    Dates come from normalise_times: every value that denotes a moment counts, with the first
    and last day as written. Of one row the first of the fields that has a date counts, of a
    name sent several times the latest row with a date. Names are compared as in orphans.
    """
    t = normalise_times(metadata, labs, "meta_id", "lab_id", fields, keep=("tree_id", "name", "received_at"))
    rank = F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("field_name"))
    best = F.max(F.struct("received_at", "meta_id", (-rank).alias("k"), "lo", "hi"))
    dated = t.where("status = 'ok'").withColumn("_n", plain_name(F.col("name"))).where("_n is not null")
    one = dated.groupBy("tree_id", "_n").agg(best.alias("x")).select("tree_id", "_n", "x.lo", "x.hi")
    out = nodes.where("is_tip").withColumn("_n", plain_name(F.col("name"))).join(one, ["tree_id", "_n"], "left").drop("_n")
    return materialize(out, "dates")


def root_to_tip(paths: DataFrame, dates: DataFrame) -> DataFrame:
    """Dated tips with their distance from the root: tree_id, root_id, node_id, name, date, dist2root, depth."""
    d = dates.where("lo is not null").select("tree_id", "node_id", ((F.col("lo") + F.col("hi")) / 2).alias("date"))
    return paths.where("is_tip").join(d, ["tree_id", "node_id"]).select("tree_id", "root_id", "node_id", "name", "date", "dist2root", "depth")


def clock_regression(rtt: DataFrame, by: list[str]) -> DataFrame:
    """Least squares of distance on date per group: slope, intercept, chisq, r, n; groups with 3 dates and a spread."""
    agg = rtt.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("date").alias("_mt"), F.avg("dist2root").alias("_md"),
        F.var_pop("date").alias("_vt"), F.var_pop("dist2root").alias("_vd"), F.covar_pop("date", "dist2root").alias("_c"),
    )
    slope = F.col("_c") / F.col("_vt")
    return agg.where("n >= 3 and _vt > 1e-12").select(
        *by, slope.alias("slope"), (F.col("_md") - slope * F.col("_mt")).alias("intercept"),
        (0.5 * F.col("n") * (F.col("_vd") - F.col("_c") * F.col("_c") / F.col("_vt"))).alias("chisq"),
        F.when(F.col("_vd") > 0, F.col("_c") / F.sqrt(F.col("_vt") * F.col("_vd"))).alias("r"), "n",
    )


def clock_residuals(rtt: DataFrame, models: DataFrame, by: list[str], n_iqd: float = 3.0) -> DataFrame:
    """Residuals of the tips and whether they are outliers: more than n_iqd interquartile distances.

    Tips at depth 1, the children of the root, are never outliers: their distance depends on the rooting.
    """
    res = rtt.join(models.select(*by, "slope", "intercept"), by).withColumn("residual", F.col("dist2root") - F.col("intercept") - F.col("slope") * F.col("date"))
    iqd = res.groupBy(*by).agg(F.percentile("residual", F.array(F.lit(0.25), F.lit(0.75))).alias("_p"))
    out = res.join(iqd, by).withColumn("outlier", (F.abs("residual") > n_iqd * (F.col("_p")[1] - F.col("_p")[0])) & (F.col("depth") > 1))
    return out.drop("_p", "slope", "intercept")


def lineages(nodes_with_time: DataFrame, by: list[str]) -> DataFrame:
    """Lineages through time: events (children - 1) from the oldest, summed per time, running from 1.

    nodes_with_time: *by, t (decimal year), n_children. Result: *by, t, dn, k after the event.
    """
    ev = nodes_with_time.groupBy(*by, "t").agg(F.sum(F.coalesce("n_children", F.lit(0)) - 1).cast("bigint").alias("dn"))
    w = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ev.withColumn("k", F.lit(1) + F.sum("dn").over(w))


def merger_integral(ltt: DataFrame, by: list[str]) -> DataFrame:
    """ltt with the integral of max(0.5, k - 1) / 2 (Tc = 1) from the oldest event on."""
    order = Window.partitionBy(*by).orderBy("t")
    width, rate = F.col("t") - F.lag("t").over(order), 0.5 * F.greatest(F.lit(0.5), F.lag("k").over(order) - F.lit(1.0))
    area = ltt.withColumn("_a", F.coalesce(width * rate, F.lit(0.0)))
    return area.withColumn("integral", F.sum("_a").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_a")


def kept_ancestor(nodes: DataFrame, drop) -> DataFrame:
    """Re-parents over inner nodes that go: each node that stays gets its nearest ancestor that stays (new_parent_id).

    Only the nodes that go are followed: their pointers skip over one another by doubling.
    """
    p = _parents(nodes)
    goes = drop & ~F.col("is_tip")
    gone = materialize(p.where(goes).select("tree_id", "node_id", "_ptr"), "gone")
    while True:
        up = gone.select("tree_id", F.col("node_id").alias("_ptr"), F.col("_ptr").alias("_next"), F.lit(True).alias("_hop"))
        done, joined = _open_pointers(gone, up)
        hop = materialize(done.withColumn("_hop", F.lit(False)).unionByName(joined.select("tree_id", "node_id", F.when(F.col("_hop"), F.col("_next")).otherwise(F.col("_ptr")).alias("_ptr"), F.coalesce("_hop", F.lit(False)).alias("_hop"))), "gone")
        more = hop.where("_hop").limit(1).count() > 0
        last, gone = gone, hop.drop("_hop")
        if not more:
            break
        release(last)
    left = p.where(~F.coalesce(goes, F.lit(False)))
    done, joined = _open_pointers(left, gone.select("tree_id", F.col("node_id").alias("_ptr"), F.col("_ptr").alias("_next"), F.lit(True).alias("_hop")))
    new = F.when(F.col("_hop"), F.col("_next")).otherwise(F.col("_ptr"))
    return done.withColumn("new_parent_id", F.col("_ptr")).drop("_ptr").unionByName(joined.withColumn("new_parent_id", new).drop("_ptr", "_next", "_hop"))
