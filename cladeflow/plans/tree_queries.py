"""Queries over trees, alignments, dates and mutations, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cladeflow.functions import dates as D
from cladeflow.functions import sequences as S
from cladeflow.kernels.models import infer
from cladeflow.operators import alignment as AL
from cladeflow.operators import inference as I
from cladeflow.operators import mutations as M
from cladeflow.operators import trees as T
from cladeflow.operators.references import plain_name
from cladeflow.operators.rooting import root_regressions
from cladeflow.plans.record_queries import _P4
from cladeflow.runtime import materialize, read

GENOME = 30_000
GROUP = ["tree_id", "root_id"]


def _nodes(spark, d):
    return materialize(T.current_nodes(read(spark, d, "nodes")), "nodes")


def _paths(spark, d):
    return T.root_paths(_nodes(spark, d))


def _dates(spark, d, nodes):
    return T.tip_dates(nodes, read(spark, d, "metadata"), read(spark, d, "labs"))


def tree_current_nodes(spark, d):
    return _nodes(spark, d).select("tree_id", "node_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), "name", "is_tip", F.round("branch_length", 8).alias("branch_length"))


def tree_root_paths(spark, d):
    return _paths(spark, d).select("tree_id", "node_id", "root_id", "depth", F.round("dist2root", 9).alias("dist2root"))


def tree_tip_counts(spark, d):
    s = T.subtree_sums(_paths(spark, d), {"n_tips": ("sum", F.lit(1)), "far": ("max", F.col("dist2root"))})
    return s.select("tree_id", "node_id", "n_tips", F.round("far", 9).alias("far"))


def tree_bad_branches(spark, d):
    n = _nodes(spark, d)
    dated = _dates(spark, d, n).where("lo is not null").select("tree_id", "node_id", F.lit(True).alias("_d"))
    s = T.subtree_sums(n.join(dated, ["tree_id", "node_id"], "left"), {"bad_branch": ("every", F.col("_d").isNull())})
    return s.where("bad_branch").select("tree_id", "node_id")


def tree_polytomies(spark, d):
    return T.children_counts(_nodes(spark, d)).where("n_children > 2")


def tree_pruned_parents(spark, d):
    out = T.kept_ancestor(_paths(spark, d), (F.col("branch_length") < 0.001) & (F.col("depth") > 0))
    return out.select("tree_id", "node_id", F.coalesce("new_parent_id", F.lit(-1)).alias("new_parent_id"))


def tip_date_bounds(spark, d):
    t = _dates(spark, d, _nodes(spark, d)).where("lo is not null")
    return t.select("tree_id", "node_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def _rtt(spark, d):
    n = _nodes(spark, d)
    return T.root_to_tip(T.root_paths(n), _dates(spark, d, n))


def clock_root_to_tip(spark, d):
    return _rtt(spark, d).select("tree_id", "node_id", F.round("date", 6).alias("date"), F.round("dist2root", 9).alias("dist2root"))


def clock_regression(spark, d):
    m = T.clock_regression(_rtt(spark, d), GROUP)
    return m.select(*GROUP, F.round("slope", 6).alias("slope"), F.round("chisq", 6).alias("chisq"), F.round("r", 5).alias("r"), "n")


def clock_outliers(spark, d):
    rtt = materialize(_rtt(spark, d), "rtt")
    res = T.clock_residuals(rtt, T.clock_regression(rtt, GROUP), GROUP, 3.0)
    return res.where("outlier").select("tree_id", "node_id", F.round("residual", 6).alias("residual"))


def numeric_dates(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", D.numeric_date(F.to_date("o_orderdate")).alias("n"))
    return o.select("o_orderkey", F.round("n", 6).alias("numeric_date"), F.date_format(D.date_of(F.col("n")), "yyyy-MM-dd").alias("date_string"))


def _aln(spark, d):
    return AL.clean_alignment(read(spark, d, "aln"))


def aln_clean(spark, d):
    return _aln(spark, d)


def aln_composition(spark, d):
    return AL.composition(_aln(spark, d), ["tree_id"])


def aln_alphabet(spark, d):
    return AL.alphabet_guess(_aln(spark, d), ["tree_id"])


def aln_patterns(spark, d):
    return AL.column_patterns(AL.site_letters(_aln(spark, d))).select("tree_id", "n_sites", F.md5("pattern").alias("pattern"), "variable", "multiplicity", "first_pos")


def aln_differences(spark, d):
    letters = AL.site_letters(_aln(spark, d))
    return AL.differences(letters, AL.majority_reference(letters).drop("n"))


def aln_distances(spark, d):
    a = materialize(_aln(spark, d), "aln")
    w = Window.partitionBy("tree_id").orderBy("taxon")
    pairs = a.select("tree_id", F.lag("taxon").over(w).alias("taxon_1"), F.col("taxon").alias("taxon_2")).where("taxon_1 is not null")
    x = AL.distances(a, pairs)
    return x.select("tree_id", "taxon_1", "taxon_2", F.col("differ").cast("int").alias("differ"), F.col("compared").cast("int").alias("compared"), F.round("distance", 6).alias("distance"))


def aln_unmatched_tips(spark, d):
    tips = _nodes(spark, d).where("is_tip").select("tree_id", "node_id", F.col("name").alias("taxon"))
    return tips.join(_aln(spark, d), ["tree_id", "taxon"], "left_anti").select("tree_id", "node_id")


def aln_common_taxa(spark, d):
    """Names that a tree's tips and its alignment share."""
    tips = _nodes(spark, d).where("is_tip").select("tree_id", F.col("name").alias("taxon"))
    return tips.intersect(_aln(spark, d).select("tree_id", "taxon"))


def _muts(spark, d):
    return M.branch_mutations(read(spark, d, "mutations"), _nodes(spark, d))


def homoplasy_mutations(spark, d):
    return M.recurrence(_muts(spark, d), ["a", "pos", "d"])


def homoplasy_sites(spark, d):
    return M.recurrence(_muts(spark, d), ["pos"])


def homoplasy_top(spark, d):
    return M.top_recurrent(M.recurrence(_muts(spark, d), ["a", "pos", "d"]), 10, GENOME)


def homoplasy_histogram(spark, d):
    return M.recurrence_histogram(M.recurrence(_muts(spark, d), ["a", "pos", "d"]))


def homoplasy_poisson(spark, d):
    sites = materialize(M.recurrence(_muts(spark, d), ["pos"]), "sites")
    return M.poisson_expectation(sites, GENOME).select("hits", "n", F.round("expected", 4).alias("expected"))


def homoplasy_strains(spark, d):
    """Tips with the most mutations that also occur on other branches."""
    m = materialize(_muts(spark, d), "muts")
    again = M.recurrence(m, ["a", "pos", "d"]).where("multiplicity > 1").select("a", "pos", "d")
    return m.where("is_tip").join(again, ["a", "pos", "d"]).groupBy("tree_id", "node_id").agg(F.count(F.lit(1)).alias("n_homoplasies"))


def rate_statistics(spark, d):
    s = M.rate_statistics(_muts(spark, d))
    return s.select("anc", "der", "n", F.round("half", 6).alias("half"))


def gtr_inferred(spark, d):
    """Rate model of all mutations: one row per state with its frequency and rates."""
    import numpy as np

    nodes = materialize(_nodes(spark, d), "nodes")
    rows = M.rate_statistics(M.branch_mutations(read(spark, d, "mutations"), nodes)).collect()  # at most 20 rows
    total = nodes.agg(F.sum("branch_length").alias("l")).first()["l"] or 0.0
    share = {r["state"]: r["n"] for r in AL.composition(_aln(spark, d).withColumn("all", F.lit(1)), ["all"]).collect()}
    at = {c: k for k, c in enumerate("ACGT-")}
    n, t = np.zeros((5, 5)), np.zeros(5)
    seen = sum(v for c, v in share.items() if c in at)
    for c, k in at.items():
        t[k] = total * GENOME * share.get(c, 0) / max(seen, 1)
    for r in rows:
        n[at[r["der"]], at[r["anc"]]] += r["n"]
        t[at[r["anc"]]] += r["half"]
        t[at[r["der"]]] -= r["half"]
    m = infer(n, t, GENOME * np.array([share.get(c, 0) / max(seen, 1) for c in at]), "nuc", pc=5.0)
    return spark.createDataFrame(
        [(c, round(float(m.pi[k]), 6), round(float(m.mu), 9), *(round(float(x), 5) for x in m.w[k])) for c, k in at.items()],
        "state string, pi double, mu double, w_a double, w_c double, w_g double, w_t double, w_gap double",
    )


def path_statistics(spark, d):
    p = M.path_statistics(read(spark, d, "events"), "user_id", "ts", "event_type", "event_id")
    return p.select("from_state", "to_state", "n", F.round("dwell_s", 2).alias("dwell_s"))


def equal_rates_transitions(spark, d):
    n = _nodes(spark, d)
    t = F.col("branch_length")
    return n.select("tree_id", "node_id", F.round(S.equal_rates_p(t, True), 8).alias("p_same"), F.round(S.equal_rates_p(t, False), 8).alias("p_other"))


def _events(spark, d):
    p = _paths(spark, d)
    kids = T.children_counts(p)
    return p.join(kids, ["tree_id", "node_id"], "left").select(*GROUP, F.round("dist2root", 8).alias("t"), "n_children")


def lineages_through_time(spark, d):
    return T.lineages(_events(spark, d), GROUP)


def merger_rate_integral(spark, d):
    x = T.merger_integral(T.lineages(_events(spark, d), GROUP), GROUP)
    return x.select(*GROUP, "t", "k", F.round("integral", 11).alias("integral"))


def trait_states(spark, d):
    """Countries as numbered states per tree, by name."""
    m = read(spark, d, "metadata").where("country is not null").select("tree_id", "country").distinct()
    return m.select("tree_id", "country", F.dense_rank().over(Window.partitionBy("tree_id").orderBy("country")).alias("state"))


def _columns(spark, d):
    """Sequences in the columns of their trees."""
    return AL.tree_columns(_aln(spark, d)).where("seq is not null").select("tree_id", "taxon", "seq")


def _sites(spark, d):
    """Numbers of columns of the trees."""
    return materialize(I.site_counts(_aln(spark, d)), "sites")


def aln_columns(spark, d):
    """What became of the sequences whose length is not their tree's usual one."""
    return AL.tree_columns(_aln(spark, d)).where("status <> 'as is'").select("tree_id", "taxon", "status", "n_inserted", F.round("identity", 6).alias("identity"))


def aln_lengths(spark, d):
    """Sequences whose length is not their tree's usual one, and how far off it is."""
    a = _aln(spark, d)
    return a.join(AL.usual_lengths(a), "tree_id").where(F.length("seq") != F.col("total")).select("tree_id", "taxon", (F.length("seq") - F.col("total")).alias("longer_by"))


def aln_full_length(spark, d):
    """Patterns of alignments that stand for genomes of 600 sites."""
    p = AL.with_constant_sites(AL.column_patterns(AL.site_letters(_aln(spark, d))), 600)
    return p.where("not variable").select("tree_id", "n_sites", F.md5("pattern").alias("pattern"), F.round("multiplicity", 6).alias("multiplicity"))


def aln_position_kinds(spark, d):
    """What the differences to the most frequent letters make of each column."""
    letters = materialize(AL.site_letters(_aln(spark, d)), "letters")
    diff = AL.differences(letters, AL.majority_reference(letters).drop("n")).join(_aln(spark, d).select("tree_id", "taxon", F.length("seq").alias("n_sites")), ["tree_id", "taxon"])
    taxa = _aln(spark, d).groupBy("tree_id", F.length("seq").alias("n_sites")).agg(F.count(F.lit(1)).alias("n_taxa"))
    return AL.sparse_positions(diff, taxa, ["tree_id", "n_sites"]).select("tree_id", "n_sites", "pos", "kind", F.array_join("states", "").alias("states"), "n")


def site_models(spark, d):
    return I.infer_site_models(_nodes(spark, d), _columns(spark, d))


def tips_undated(spark, d):
    """Tips without a date: their name has no metadata, or no value there denotes a moment."""
    n = _nodes(spark, d)
    names = read(spark, d, "metadata").select("tree_id", plain_name(F.col("name")).alias("_n")).where("_n is not null").distinct().withColumn("_sent", F.lit(True))
    t = _dates(spark, d, n).where("lo is null").withColumn("_n", plain_name(F.col("name"))).join(names, ["tree_id", "_n"], "left")
    return t.select("tree_id", "node_id", F.when(F.col("_sent"), "no date").otherwise("no metadata").alias("reason"))


def ancestral_marginal(spark, d):
    return I.ancestral_states(_nodes(spark, d), _columns(spark, d), "marginal")


def ancestral_joint(spark, d):
    return I.ancestral_states(_nodes(spark, d), _columns(spark, d), "joint")


def ancestral_fitch(spark, d):
    return I.ancestral_states(_nodes(spark, d), _columns(spark, d), "fitch")


def ancestral_inferred(spark, d):
    """Under a model of five states that is inferred for each tree."""
    n, aln = _nodes(spark, d), _columns(spark, d)
    return I.ancestral_states(n, aln, "marginal", models=I.infer_models(n, aln))


def models_inferred(spark, d):
    return I.infer_models(_nodes(spark, d), _columns(spark, d))


def clock_best_root(spark, d):
    n = _nodes(spark, d)
    x = root_regressions(n, _dates(spark, d, n))
    return x.select(*GROUP, F.round("slope", 7).alias("slope"), F.round("chisq", 7).alias("chisq"), "n_dates")


def clock_min_deviation_root(spark, d):
    n = _nodes(spark, d)
    return root_regressions(n, _dates(spark, d, n), 0.0).select(*GROUP, F.round("chisq", 7).alias("chisq"), "n_dates")


def clock_covariation_root(spark, d):
    """Roots with variances that grow along the branches; the rate's deviation and the root's date."""
    n = _nodes(spark, d)
    return I.best_roots(n, _dates(spark, d, n), _sites(spark, d), covariation=True)


def clock_oldest_root(spark, d):
    n = _nodes(spark, d)
    x = I.best_roots(n, _dates(spark, d, n), _sites(spark, d), mode="oldest")
    return x.select(*GROUP, "node_id", F.round("slope", 6).alias("slope"), F.round("chisq", 6).alias("chisq"), F.round("r_val", 5).alias("r_val"), "n_dates")


def clock_local_outliers(spark, d):
    n = _nodes(spark, d)
    return I.local_outliers(n, _dates(spark, d, n), _sites(spark, d), 2.0)


def timetree_joint(spark, d):
    n = _nodes(spark, d)
    return I.time_trees(n, _dates(spark, d, n), _sites(spark, d))


def timetree_marginal(spark, d):
    n = _nodes(spark, d)
    return I.time_trees(n, _dates(spark, d, n), _sites(spark, d), marginal=True, vary_rate=True)


def timetree_adaptive(spark, d):
    """Marginal dates with a grid for each branch."""
    n = _nodes(spark, d)
    return I.time_trees(n, _dates(spark, d, n), _sites(spark, d), marginal=True, adaptive=True)


def timetree_full(spark, d):
    """All of it: inferred models, sequences, best roots, outliers, polytomies, relaxed rates, a coalescent, confidence."""
    n = _nodes(spark, d)
    aln, sites = _columns(spark, d), _sites(spark, d)
    models = I.infer_models(n, aln, 3)
    pairs = materialize(I.expected_branch_pairs(n, aln, models=models), "pairs")
    return I.time_trees(
        n, _dates(spark, d, n), sites, True, pairs=pairs, models=models, relax=(1.0, 1.0), coalescent=True, resolve=True,
        reroot="best", clock_filter=4.0, max_iter=3, vary_rate=True,
    )


def timetree_skyline(spark, d):
    """Effective time scale through time of the dated trees: date, Tc and its bounds."""
    n = _nodes(spark, d)
    t = I.time_trees(n, _dates(spark, d, n), _sites(spark, d), coalescent="skyline", resolve=True, reroot="best").where("info is not null")
    sky = F.from_json(F.get_json_object("info", "$.skyline"), "array<array<double>>")
    x = t.select(*GROUP, F.explode(sky).alias("x"))
    return x.select(*GROUP, *[F.col("x")[k].alias(c) for k, c in enumerate(("date", "tc", "lower", "upper"))])


def coalescent_tc(spark, d):
    return I.coalescent_fits(_nodes(spark, d)).select("tree_id", "root_id", "n_nodes", F.round("tc", 7).alias("tc"))


def traits_inferred(spark, d):
    n = _nodes(spark, d)
    m = read(spark, d, "metadata")
    c = m.where("country is not null").groupBy("tree_id", plain_name(F.col("name")).alias("_n")).agg(F.max_by("country", F.struct("received_at", "meta_id")).alias("trait"))
    t = n.where("is_tip").withColumn("_n", plain_name(F.col("name"))).join(c, ["tree_id", "_n"])
    return I.discrete_traits(n, t)


def branch_state_pairs(spark, d):
    return I.ancestral_pairs(_nodes(spark, d), _columns(spark, d), "joint")


def branch_lengths(spark, d):
    return I.branch_lengths(branch_state_pairs(spark, d))


def optimised_trees(spark, d):
    return I.optimised_trees(_nodes(spark, d), _columns(spark, d))


def simulated_alignments(spark, d):
    return I.simulate_alignments(_nodes(spark, d), 200)


def rate_susceptibility(spark, d):
    n = _nodes(spark, d)
    return I.rate_susceptibility(n, _dates(spark, d, n), _sites(spark, d))


def tree_layout(spark, d):
    x = I.tree_layout(_nodes(spark, d))
    return x.select("tree_id", "node_id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


def coalescent_skyline(spark, d):
    return I.coalescent_fits(_nodes(spark, d), 20).where(F.size("sky_t") > 0)


def reassortment_clades(spark, d):
    """Labs' countries stand for clades of common history."""
    n = _nodes(spark, d)
    m = read(spark, d, "metadata").where("country is not null and name is not null").groupBy("tree_id", "name").agg(F.min("country").alias("c"))
    m = m.select("tree_id", "name", F.dense_rank().over(Window.partitionBy("tree_id").orderBy("c")).alias("mcc"))
    return I.reassortment_clades(n, m)


def tree_newick(spark, d):
    from cladeflow.sources.sinks import tree_texts

    return tree_texts(_nodes(spark, d))


def tree_nested_json(spark, d):
    from cladeflow.sources.sinks import tree_texts

    return tree_texts(_nodes(spark, d), "json")


_CUR = """
cur as (
  select tree_id, node_id, parent_id, child_ix, name, is_tip, greatest(coalesce(branch_length, 0), 0) as branch_length from (
    select *, row_number() over (partition by tree_id, node_id order by loaded_at desc, (deleted_at is null) desc,
      parent_id desc nulls last, child_ix desc nulls last, name desc nulls last, is_tip desc nulls last, branch_length desc nulls last) as rn
    from nodes) where rn = 1 and not (is_tip and deleted_at is not null)
)"""
_WALK = (
    "with recursive"
    + _CUR
    + """, up as (
  select c.*, case when p.node_id is not null then c.parent_id end as par from cur c
  left join cur p on p.tree_id = c.tree_id and p.node_id = c.parent_id
), walk as (
  select tree_id, node_id, parent_id, name, is_tip, branch_length, node_id as root_id, 0 as depth, 0.0::double as dist2root from up where par is null
  union all
  select u.tree_id, u.node_id, u.parent_id, u.name, u.is_tip, u.branch_length, w.root_id, w.depth + 1, w.dist2root + u.branch_length
  from up u join walk w on u.tree_id = w.tree_id and u.par = w.node_id
), above as (
  select tree_id, node_id, node_id as anc, 0 as steps, par from up
  union all
  select a.tree_id, a.node_id, u.node_id, a.steps + 1, u.par from above a join up u on u.tree_id = a.tree_id and u.node_id = a.par
)"""
)
_DATES = _P4.replace("\nwith ", "\n, ", 1) + """
, dated as (
  select tree_id, n, lo, hi from (
    select tree_id, lower(trim(name, ' \'\'"')) as n, lo, hi, row_number() over (partition by tree_id, lower(trim(name, ' \'\'"')) order by received_at desc, meta_id desc, field_name) as rn
    from metadata join times using (meta_id) where name is not null) where rn = 1
), tipdates as (
  select c.tree_id, c.node_id, lo, hi from cur c join dated d on d.tree_id = c.tree_id and d.n = lower(trim(c.name, ' \'\'"')) where c.is_tip
)"""
_RTT = _WALK + _DATES + """
, rtt as (select w.tree_id, w.root_id, w.node_id, (lo + hi) / 2 as date, dist2root, depth from walk w join tipdates t on t.tree_id = w.tree_id and t.node_id = w.node_id where w.is_tip),
reg as (
  select tree_id, root_id, count(*) as n, covar_pop(dist2root, date) / var_pop(date) as slope,
    avg(dist2root) - covar_pop(dist2root, date) / var_pop(date) * avg(date) as intercept,
    0.5 * count(*) * (var_pop(dist2root) - covar_pop(dist2root, date) ** 2 / var_pop(date)) as chisq,
    case when var_pop(dist2root) > 0 then covar_pop(dist2root, date) / sqrt(var_pop(dist2root) * var_pop(date)) end as r
  from rtt group by tree_id, root_id having count(*) >= 3 and var_pop(date) > 1e-12
)"""
_ALN = r"""
a1 as (
  select tree_id, taxon, aln_id, translate(upper(regexp_replace(seq, '\s', '', 'g')), 'U', 'T') as s from aln where taxon is not null
), a2 as (
  select tree_id, taxon, arg_min(s, aln_id) as s from a1 where length(s) > 0 group by tree_id, taxon
), al as (
  select tree_id, taxon, repeat('N', length(s) - length(ltrim(s, '-'))) || trim(s, '-') ||
    case when length(ltrim(s, '-')) = 0 then '' else repeat('N', length(s) - length(rtrim(s, '-'))) end as seq from a2
)"""
_SITES = "with" + _ALN + """, let as (
  select tree_id, n_sites, taxon, i - 1 as pos, seq[i] as state from (select tree_id, length(seq)::int as n_sites, taxon, seq, unnest(range(1, length(seq) + 1)) as i from al)
)"""
_MUT = "with" + _CUR + """, mu as (
  select m.*, c.is_tip, c.branch_length from (
    select distinct tree_id, node_id, upper(trim(a, ' ')) as a, pos, upper(trim(d, ' ')) as d from mutations) m
  join cur c on c.tree_id = m.tree_id and c.node_id = m.node_id
  where a in ('A','C','G','T','-') and d in ('A','C','G','T','-') and a <> d and pos is not null
)"""
_EVENTS = _WALK + """, kids as (select tree_id, parent_id as node_id, count(*) as n_children from cur where parent_id is not null group by 1, 2),
ev as (
  select w.tree_id, w.root_id, round(dist2root, 8) as t, sum(coalesce(n_children, 0) - 1)::bigint as dn
  from walk w left join kids k on k.tree_id = w.tree_id and k.node_id = w.node_id group by 1, 2, 3
), ltt as (select *, 1 + sum(dn) over (partition by tree_id, root_id order by t) as k from ev)"""

# preorder: the ranks of a node and of those above it; lengths as %.10g
_ORDER = """, ranked as (
  select *, row_number() over (partition by tree_id, par order by child_ix, node_id) as r from up where par is not null
), pre as (
  select u.tree_id, u.node_id, u.name, u.node_id as root_id, 0 as depth, [1::bigint] as key, printf('%.10g', u.branch_length) as num, printf('%.10g', u.branch_length) as root_length from up u where par is null
  union all
  select r.tree_id, r.node_id, r.name, p.root_id, p.depth + 1, list_append(p.key, r.r), printf('%.10g', r.branch_length), p.root_length from ranked r join pre p on p.tree_id = r.tree_id and p.node_id = r.par
)"""
# every branch (above node v) against every dated tip: distances from the lower end, with a sign for the side
_ROOTS = _WALK + _DATES + """
, tip as (select w.tree_id, w.root_id, w.node_id, w.dist2root as d, (lo + hi) / 2 - 2000 as t from walk w join tipdates x on x.tree_id = w.tree_id and x.node_id = w.node_id where w.is_tip),
pairs as (
  select v.tree_id, v.root_id, v.node_id as v, v.branch_length as len, v.dist2root as dv, tip.node_id as j, tip.d, tip.t, max(anc.dist2root) as meet, bool_or(a1.anc = v.node_id) as below
  from walk v join tip on tip.tree_id = v.tree_id and tip.root_id = v.root_id
  join above a1 on a1.tree_id = tip.tree_id and a1.node_id = tip.node_id
  join above a2 on a2.tree_id = v.tree_id and a2.node_id = v.node_id and a2.anc = a1.anc
  join walk anc on anc.tree_id = a1.tree_id and anc.node_id = a1.anc
  where v.depth > 0 group by all
), dist as (select *, d + dv - 2 * meet as e, case when below then 1 else -1 end as s from pairs),
m as (
  select tree_id, root_id, v, len, count(*)::double as n, sum(t * t) - sum(t) ** 2 / count(*) as tt, sum(e * e) - sum(e) ** 2 / count(*) as q0, 2 * sum(s * e) - 2 * sum(e) * sum(s) / count(*) as q1,
    count(*) - sum(s)::double ** 2 / count(*) as q2, sum(t * e) - sum(t) * sum(e) / count(*) as u0, sum(t * s) - sum(t) * sum(s) / count(*) as u1
  from dist group by all having count(*) >= 3 and abs(sum(s)) < count(*)
)"""


def _least_sql(c0: str, c1: str, c2: str, lo: str, hi: str, possible: str) -> str:
    return f"""
, par as (select *, {c0} as c0, {c1} as c1, {c2} as c2, {lo} as lo, {hi} as hi from m where tt > 1e-9 and {possible}),
pt as (select *, greatest(lo, least(hi, case when c2 > 1e-12 then -c1 / (2 * c2) when c1 > 0 then lo else hi end)) as a from par where lo <= hi),
best as (select *, 0.5 * (c0 + c1 * a + c2 * a * a) as chi, row_number() over (partition by tree_id, root_id order by round(0.5 * (c0 + c1 * a + c2 * a * a), 11), v) as rn from pt)
"""


SQL = {
    "tree_current_nodes": "with" + _CUR + " select tree_id, node_id, coalesce(parent_id, -1)::int as parent_id, name, is_tip, round(branch_length, 8) as branch_length from cur",
    "tree_root_paths": _WALK + " select tree_id, node_id, root_id, depth, round(dist2root, 9) as dist2root from walk",
    "tree_tip_counts": _WALK + " select a.tree_id, a.anc as node_id, count(*) as n_tips, round(max(w.dist2root), 9) as far from above a join walk w on w.tree_id = a.tree_id and w.node_id = a.node_id where w.is_tip group by 1, 2",
    "tree_bad_branches": _WALK + _DATES + " select a.tree_id, a.anc as node_id from above a join cur c on c.tree_id = a.tree_id and c.node_id = a.node_id left join tipdates t on t.tree_id = a.tree_id and t.node_id = a.node_id where c.is_tip group by 1, 2 having bool_and(t.lo is null)",
    "tree_polytomies": "with" + _CUR + " select tree_id, parent_id as node_id, count(*) as n_children from cur where parent_id is not null group by 1, 2 having count(*) > 2",
    "tree_pruned_parents": _WALK + """, gone as (select tree_id, node_id from walk where branch_length < 0.001 and depth > 0 and not is_tip)
        select w.tree_id, w.node_id, coalesce((select arg_min(a.anc, a.steps) from above a where a.tree_id = w.tree_id and a.node_id = w.node_id and a.steps > 0
          and not exists (select 1 from gone g where g.tree_id = a.tree_id and g.node_id = a.anc)), -1)::int as new_parent_id
        from walk w where not exists (select 1 from gone g where g.tree_id = w.tree_id and g.node_id = w.node_id)""",
    "tip_date_bounds": "with" + _CUR + _DATES + " select tree_id, node_id, round(lo, 6) as lo, round(hi, 6) as hi from tipdates",
    "clock_root_to_tip": _RTT + " select tree_id, node_id, round(date, 6) as date, round(dist2root, 9) as dist2root from rtt",
    "clock_regression": _RTT + " select tree_id, root_id, round(slope, 6) + 0.0 as slope, round(chisq, 6) + 0.0 as chisq, round(r, 5) + 0.0 as r, n from reg",
    "clock_outliers": _RTT + """, res as (select rtt.*, dist2root - intercept - slope * date as residual from rtt join reg using (tree_id, root_id)),
        iqd as (select tree_id, root_id, quantile_cont(residual, 0.75) - quantile_cont(residual, 0.25) as w from res group by 1, 2)
        select tree_id, node_id, round(residual, 6) as residual from res join iqd using (tree_id, root_id) where abs(residual) > 3 * w and depth > 1""",
    "numeric_dates": """with n as (select o_orderkey, o_orderdate::date as d, year(o_orderdate) as y, case when dayofyear(make_date(year(o_orderdate), 12, 31)) = 366 then 366 else 365 end as days from orders)
        select o_orderkey, round(y + (dayofyear(d) - 0.5) / days, 6) as numeric_date, strftime(d, '%Y-%m-%d') as date_string from n""",
    "aln_clean": "with" + _ALN + " select tree_id, taxon, seq from al",
    "aln_composition": "with" + _ALN + " select tree_id, state, count(*) as n from (select tree_id, unnest(string_split(seq, '')) as state from al where length(seq) > 0) group by 1, 2",
    "aln_alphabet": "with" + _ALN + " select tree_id, sum(length(seq) - length(regexp_replace(seq, '[ACGTacgtN-]', '', 'g')))::bigint as n_nuc, sum(length(seq))::bigint as n_all, case when sum(length(seq) - length(regexp_replace(seq, '[ACGTacgtN-]', '', 'g'))) > 0.9 * sum(length(seq)) then 'nuc' else 'aa' end as alphabet from al group by 1",
    "aln_patterns": _SITES + """, col as (
        select tree_id, n_sites, pos, string_agg(state, '' order by taxon) as pattern, count(distinct state) filter (where state <> 'N') as ns, min(state) filter (where state <> 'N') as one from let group by 1, 2, 3),
        k as (select tree_id, n_sites, pos, ns > 1 as variable, case when ns > 1 then pattern else repeat(coalesce(one, 'N'), length(pattern)) end as pattern from col)
        select tree_id, n_sites, md5(pattern) as pattern, variable, count(*) as multiplicity, min(pos) as first_pos from k group by tree_id, n_sites, pattern, variable, case when variable then pos end""",
    "aln_differences": _SITES + """, ref as (select tree_id, n_sites, pos, state as ref from (select tree_id, n_sites, pos, state, row_number() over (partition by tree_id, n_sites, pos order by count(*) desc, state) as rn from let group by 1, 2, 3, 4) where rn = 1)
        select tree_id, taxon, ref, pos, state from let join ref using (tree_id, n_sites, pos) where state <> ref""",
    "aln_distances": "with" + _ALN + """, pairs as (select tree_id, lag(taxon) over w as taxon_1, taxon as taxon_2, lag(seq) over w as s1, seq as s2 from al window w as (partition by tree_id order by taxon)),
        x as (select tree_id, taxon_1, taxon_2, (select count(*) from range(1, length(s1) + 1) r(i) where s1[i] not in ('N', '-') and s2[i] not in ('N', '-') and s1[i] <> s2[i])::int as differ,
          (select count(*) from range(1, length(s1) + 1) r(i) where s1[i] not in ('N', '-') and s2[i] not in ('N', '-'))::int as compared from pairs where taxon_1 is not null and length(s1) = length(s2))
        select tree_id, taxon_1, taxon_2, differ, compared, case when compared > 0 and differ / compared < 0.75 then round(-0.75 * ln(1 - differ / compared / 0.75), 6) + 0.0 end as distance from x""",
    "aln_unmatched_tips": "with" + _CUR + "," + _ALN + " select tree_id, node_id from cur where is_tip and not exists (select 1 from al where al.tree_id = cur.tree_id and al.taxon = cur.name)",
    "aln_common_taxa": "with" + _CUR + "," + _ALN + " select tree_id, name as taxon from cur where is_tip intersect select tree_id, taxon from al",
    "homoplasy_mutations": _MUT + " select a, pos, d, count(*) as multiplicity, sum(is_tip::int)::bigint as terminal from mu group by 1, 2, 3",
    "homoplasy_sites": _MUT + " select pos, count(*) as multiplicity, sum(is_tip::int)::bigint as terminal from mu group by 1",
    "homoplasy_top": _MUT + " select a, pos, d, count(*) as multiplicity, sum(is_tip::int)::bigint as terminal from mu group by 1, 2, 3 order by count(*) - 0.1 * pos / 30000 desc, a, d limit 10",
    "homoplasy_histogram": _MUT + ", c as (select a, pos, d, count(*) as multiplicity from mu group by 1, 2, 3) select multiplicity, count(*) as n from c group by 1",
    "homoplasy_poisson": _MUT + """, c as (select pos, count(*) as m from mu group by 1), t as (select sum(m) / 30000.0 as mean, count(*) as s from c),
        h as (select m as hits, count(*) as n from c group by 1 union all select 0, 30000 - s from t)
        select hits::bigint as hits, n::bigint as n, round(30000 * exp(hits * ln(mean) - mean - lgamma(hits + 1)), 4) as expected from h, t""",
    "homoplasy_strains": _MUT + ", c as (select a, pos, d from mu group by 1, 2, 3 having count(*) > 1) select tree_id, node_id, count(*) as n_homoplasies from mu join c using (a, pos, d) where is_tip group by 1, 2",
    "rate_statistics": _MUT + " select a as anc, d as der, count(*) as n, round(sum(branch_length / 2), 6) as half from mu group by 1, 2",
    # the fixed point in steps: exchange rates, their norm, what each state reaches, frequencies, overall rate
    "gtr_inferred": _MUT.replace("with", "with recursive", 1) + ", " + _ALN.strip() + """, st as (select ['A', 'C', 'G', 'T', '-'] as l),
        share as (select list_position(l, x) as k, count(*)::double as c from (select unnest(string_split(seq, '')) as x from al where length(seq) > 0), st where list_contains(l, x) group by 1),
        sh as (select list(coalesce(c, 0) order by i) as f from (select unnest(range(1, 6)) as i) left join share on share.k = i),
        cells as (select list_position(l, d) as i, list_position(l, a) as j, count(*)::double as n, sum(branch_length / 2) as half from mu, st group by 1, 2),
        total as (select sum(branch_length) as t from cur),
        inp as (
          select (select list(coalesce(n, 0) order by (x - 1) // 5, (x - 1) % 5) from (select unnest(range(1, 26)) as x) left join cells on i = (x - 1) // 5 + 1 and j = (x - 1) % 5 + 1) as n,
            list_transform(range(1, 6), lambda k: 30000 * f[k] / list_sum(f)) as root,
            (select list(30000 * t * f[x] / list_sum(f) + coalesce((select sum(half) from cells where j = x), 0) - coalesce((select sum(half) from cells where i = x), 0) order by x) from (select unnest(range(1, 6)) as x), total) as t
          from sh
        ), it as (
          select 0 as step, [0.2, 0.2, 0.2, 0.2, 0.2]::double[] as pi, (list_sum(list_transform(range(1, 26), lambda x: case when (x - 1) // 5 = (x - 1) % 5 then 0 else n[x] end)) + 5) / (list_sum(t) + 5) as mu, []::double[] as w, 1.0::double as moved from inp
          union all
          select step + 1, new_pi, (big + 5) / (list_sum(list_transform(range(1, 6), lambda k: new_pi[k] * reach[k])) + 5), w, list_max(list_transform(range(1, 6), lambda k: abs(new_pi[k] - pi[k]))) from (
            select *, list_transform(raw_pi, lambda p: p / list_sum(raw_pi)) as new_pi from (
              select *, list_transform(range(1, 6), lambda k: (list_sum(list_transform(range(1, 6), lambda j: case when j = k then 0 else n[(k - 1) * 5 + j] end)) + root[k] + 20) / (mu * reach[k] + list_sum(root) + 20 + 1e-12)) as raw_pi from (
                select *, list_transform(range(1, 6), lambda k: list_sum(list_transform(range(1, 6), lambda j: w[(k - 1) * 5 + j] * t[j]))) as reach from (
                  select step, pi, mu, n, t, root, big, list_transform(w0, lambda v: v / scale) as w from (
                    select *, (list_sum(list_transform(range(1, 26), lambda x: pi[(x - 1) // 5 + 1] * w0[x] * pi[(x - 1) % 5 + 1])) - list_sum(list_transform(range(1, 6), lambda k: pi[k] * w0[(k - 1) * 5 + 5])) * pi[5]) / (1 - pi[5]) as scale from (
                      select step, pi, mu, n, t, root, list_sum(list_transform(range(1, 26), lambda x: case when (x - 1) // 5 = (x - 1) % 5 then 0 else n[x] end)) as big,
                        list_transform(range(1, 26), lambda x: case when (x - 1) // 5 = (x - 1) % 5 then 0.0 else
                          (n[x] + n[((x - 1) % 5) * 5 + (x - 1) // 5 + 1] + 10) / (mu * (pi[(x - 1) // 5 + 1] * t[(x - 1) % 5 + 1] + pi[(x - 1) % 5 + 1] * t[(x - 1) // 5 + 1]) + 1e-12 + 10 * mu) end) as w0
                      from it, inp where step < 40 and moved >= 1e-5))))))
        ), fit as (select mu, w, list_transform(list_concat(pi[1:4], [0.01]), lambda p: p / (list_sum(pi[1:4]) + 0.01)) as pi from it order by step desc limit 1),
        nrm as (select *, (list_sum(list_transform(range(1, 26), lambda x: pi[(x - 1) // 5 + 1] * w[x] * pi[(x - 1) % 5 + 1])) - list_sum(list_transform(range(1, 6), lambda k: pi[k] * w[(k - 1) * 5 + 5])) * pi[5]) / (1 - pi[5]) as scale from fit)
        select l[k] as state, round(pi[k], 6) as pi, round(mu, 9) as mu, round(w[k * 5 - 4] / scale, 5) as w_a, round(w[k * 5 - 3] / scale, 5) as w_c, round(w[k * 5 - 2] / scale, 5) as w_g, round(w[k * 5 - 1] / scale, 5) as w_t, round(w[k * 5] / scale, 5) as w_gap
        from nrm, st, (select unnest(range(1, 6)) as k)""",
    "path_statistics": """with e as (select event_type as from_state, lead(event_type) over w as to_state, epoch_us(lead(ts) over w) - epoch_us(ts) as us from events window w as (partition by user_id order by ts, event_id))
        select from_state, to_state, count(*) as n, round(sum(us) / 1e6, 2) as dwell_s from e where to_state is not null group by 1, 2""",
    "equal_rates_transitions": "with" + _CUR + " select tree_id, node_id, round(0.25 + 0.75 * exp(-branch_length / 0.75), 8) as p_same, round(0.25 - 0.25 * exp(-branch_length / 0.75), 8) as p_other from cur",
    "lineages_through_time": _EVENTS + " select tree_id, root_id, t, dn, k::bigint as k from ltt",
    "merger_rate_integral": _EVENTS + """, x as (select *, coalesce((t - lag(t) over w) * 0.5 * greatest(0.5, lag(k) over w - 1), 0) as a from ltt window w as (partition by tree_id, root_id order by t))
        select tree_id, root_id, t, k::bigint as k, round(sum(a) over (partition by tree_id, root_id order by t), 11) as integral from x""",
    "aln_lengths": "with" + _ALN + """, u as (select tree_id, len from (select tree_id, length(seq) as len, row_number() over (partition by tree_id order by count(*) desc, length(seq) desc) as rn from al group by tree_id, length(seq)) where rn = 1)
        select tree_id, taxon, (length(seq) - len)::int as longer_by from al join u using (tree_id) where length(seq) <> len""",
    "aln_full_length": _SITES + """, col as (
        select tree_id, n_sites, pos, count(*) as taxa, count(distinct state) filter (where state <> 'N') as ns, min(state) filter (where state <> 'N') as one from let group by 1, 2, 3),
        k as (select tree_id, n_sites, repeat(coalesce(one, 'N'), taxa::int) as pattern, coalesce(one, 'N') in ('A', 'C', 'G', 'T') as real, count(*) as m from col where ns < 2 group by all)
        select tree_id, n_sites, md5(pattern) as pattern, round(m + greatest(600 - n_sites, 0) * coalesce(case when real then m end / sum(case when real then m end) over (partition by tree_id, n_sites), 0), 6) as multiplicity from k""",
    "aln_position_kinds": _SITES + """, ref as (select tree_id, n_sites, pos, state as ref from (select tree_id, n_sites, pos, state, row_number() over (partition by tree_id, n_sites, pos order by count(*) desc, state) as rn from let group by 1, 2, 3, 4) where rn = 1),
        taxa as (select tree_id, length(seq) as n_sites, count(*) as n_taxa from al group by 1, 2),
        g as (select tree_id, n_sites, pos, string_agg(distinct state, '' order by state) as states, count(distinct state) filter (where state <> 'N') as sure, count(distinct state) as every, count(*) as n from let join ref using (tree_id, n_sites, pos) where state <> ref group by 1, 2, 3)
        select tree_id, n_sites, pos, case when sure + (n < n_taxa)::int > 1 then 'variable' when sure < every then 'ambiguous' else 'constant' end as kind, states, n from g join taxa using (tree_id, n_sites)""",
    "tree_nested_json": _WALK + _ORDER + """, n as (select p.*, w.dist2root, exists (select 1 from up c where c.tree_id = p.tree_id and c.par = p.node_id) as inner_ from pre p join walk w using (tree_id, node_id)),
        tok as (
          select tree_id, root_id, key, (case when len(key) > 1 and key[len(key)] > 1 then ', ' else '' end) || '{"name": ' || coalesce(to_json(name)::varchar, 'null') || ', "node_attrs": {"div": ' || (round(dist2root, 9) + 0.0)::varchar || '}' || (case when inner_ then ', "children": [' else '' end) as s from n
          union all
          select tree_id, root_id, list_append(key, 2147483647), (case when inner_ then ']}' else '}' end) from n
        )
        select tree_id, '{"version": "v2", "meta": {}, "tree": ' || string_agg(s, '' order by key) || '}' as text from tok group by tree_id, root_id""",
    "tips_undated": "with" + _CUR + _DATES + """ select c.tree_id, c.node_id, case when exists (select 1 from metadata m where m.tree_id = c.tree_id and lower(trim(m.name, ' \'\'"')) = lower(trim(c.name, ' \'\'"'))) then 'no date' else 'no metadata' end as reason
        from cur c where c.is_tip and not exists (select 1 from tipdates t where t.tree_id = c.tree_id and t.node_id = c.node_id)""",
    "clock_best_root": _ROOTS + _least_sql("q0 - u0 * u0 / tt", "q1 - 2 * u0 * u1 / tt", "q2 - u1 * u1 / tt", "case when u1 > 0 then greatest(0, -u0 / u1) else 0 end", "case when u1 < 0 then least(len, -u0 / u1) else len end", "(u1 <> 0 or u0 >= 0)")
        + "select tree_id, root_id, round((u0 + u1 * a) / tt, 7) as slope, round(chi, 7) as chisq, n::int as n_dates from best where rn = 1",
    "clock_oldest_root": _ROOTS + _ORDER + """, old as (
          select tip.tree_id, tip.root_id, tip.node_id as v, row_number() over (partition by tip.tree_id, tip.root_id order by t, key) as rn from tip join pre using (tree_id, node_id)),
        z as (select m.tree_id, m.root_id, m.v, m.n, m.tt, q0 + q1 * len / 2 + q2 * len * len / 4 as dd, u0 + u1 * len / 2 as td from m join old on old.tree_id = m.tree_id and old.v = m.v and rn = 1 where tt > 1e-9)
        select tree_id, root_id, v as node_id, round(td / tt, 6) + 0.0 as slope, round(0.5 * (dd - td * td / tt), 6) + 0.0 as chisq, round(td / sqrt(tt * dd), 5) + 0.0 as r_val, n::int as n_dates from z""",
    "reassortment_clades": _WALK + """, md as (
          select tree_id, name, (dense_rank() over (partition by tree_id order by c))::int as mcc from (select tree_id, name, min(country) as c from metadata where country is not null and name is not null group by 1, 2)),
        hi as (select tree_id, anc as node_id, max(steps) as h from above group by 1, 2), top as (select max(h) as h from hi),
        sets as (
          select 0 as h, u.tree_id, u.node_id, u.par, case when md.mcc is null then []::int[] else [md.mcc] end as s from up u join hi on hi.tree_id = u.tree_id and hi.node_id = u.node_id and hi.h = 0 left join md on md.tree_id = u.tree_id and md.name = u.name
          union all
          select h, tree_id, node_id, par, s from (
            select sets.h + 1 as h, tree_id, node_id, par, s from sets, top where sets.h < top.h
            union all
            select h, tree_id, node_id, par, case when len(both_) > 0 then both_ else list_sort(list_distinct(flatten(coalesce(kids, [])))) end as s from (
              select sets.h + 1 as h, u.tree_id, u.node_id, any_value(u.par) as par, list(sets.s) filter (where len(sets.s) > 0) as kids, coalesce(list_reduce(list(sets.s) filter (where len(sets.s) > 0), lambda a, b: list_intersect(a, b)), []::int[]) as both_
              from sets join up u on u.tree_id = sets.tree_id and u.node_id = sets.par join hi on hi.tree_id = u.tree_id and hi.node_id = u.node_id and hi.h = sets.h + 1 group by all)
          )
        ), fin as (select sets.* from sets join top on sets.h = top.h),
        down as (
          select tree_id, node_id, case when len(s) = 1 then s[1] else -1 end as mcc, false as shared from fin where par is null
          union all
          select f.tree_id, f.node_id, case when list_contains(f.s, d.mcc) then d.mcc when len(f.s) = 1 then f.s[1] else -1 end, coalesce(list_contains(f.s, d.mcc), false) from fin f join down d on d.tree_id = f.tree_id and d.node_id = f.par
        )
        select tree_id, node_id, mcc, shared from down""",
    "clock_min_deviation_root": _ROOTS + _least_sql("q0", "q1", "q2", "0", "len", "true") + "select tree_id, root_id, round(chi, 7) as chisq, n::int as n_dates from best where rn = 1",
    "coalescent_tc": _EVENTS + """, e1 as (select *, lag(k) over w as above, lag(t) over w as before from ltt window w as (partition by tree_id, root_id order by t)),
        seg as (select tree_id, root_id, before as a, t as b, 0.5 * greatest(0.5, above - 1) as rate from e1 where before is not null),
        br as (select w.tree_id, w.root_id, w.node_id, p.dist2root as a, w.dist2root as b from walk w join up u on u.tree_id = w.tree_id and u.node_id = w.node_id join walk p on p.tree_id = w.tree_id and p.node_id = u.par),
        ar as (select br.tree_id, br.root_id, sum(coalesce(greatest(0, least(seg.b, br.b) - greatest(seg.a, br.a)) * rate, 0)) as s from br left join seg on seg.tree_id = br.tree_id and seg.root_id = br.root_id and seg.a < br.b and seg.b > br.a group by 1, 2),
        nn as (select tree_id, root_id, count(*) as n from walk group by 1, 2)
        select tree_id, root_id, n::int as n_nodes, round(2 * s / (n - 1), 7) as tc from nn join ar using (tree_id, root_id) where n >= 4""",
    "tree_layout": _WALK + _ORDER + """, kid as (select tree_id, par, node_id, row_number() over (partition by tree_id, par order by child_ix, node_id) as r, count(*) over (partition by tree_id, par) as k from up where par is not null),
        tipy as (select tree_id, node_id, row_number() over (partition by tree_id, root_id order by key) as y from pre where not exists (select 1 from kid where kid.tree_id = pre.tree_id and kid.par = pre.node_id)),
        edge as (select tree_id, node_id as top, node_id, 1.0::double as w from up union all
          select e.tree_id, e.top, kid.node_id, e.w * (case when k = 1 then 1.0 else 0.5 end) from edge e join kid on kid.tree_id = e.tree_id and kid.par = e.node_id where r = 1 or r = k)
        select e.tree_id, e.top as node_id, round(any_value(p.dist2root), 9) as x, round(sum(w * y), 9) as y from edge e join tipy using (tree_id, node_id) join walk p on p.tree_id = e.tree_id and p.node_id = e.top group by 1, 2""",
    "tree_newick": _WALK + _ORDER + """, n as (select p.*, exists (select 1 from up c where c.tree_id = p.tree_id and c.par = p.node_id) as inner_ from pre p),
        tok as (
          select tree_id, root_id, key, (case when len(key) > 1 and key[len(key)] > 1 then ',' else '' end) || (case when inner_ then '(' else '' end) as s from n
          union all
          select tree_id, root_id, list_append(key, 2147483647), (case when inner_ then ')' else '' end) || (case when regexp_matches(coalesce(name, ''), '[\\s()\\[\\],:;]') or contains(coalesce(name, ''), chr(39)) then chr(39) || replace(name, chr(39), chr(39) || chr(39)) || chr(39) else coalesce(name, '') end) || ':' || (case when depth = 0 then root_length else num end) from n
        )
        select tree_id, string_agg(s, '' order by key) || ';' as text from tok group by tree_id, root_id""",
    "trait_states": "select tree_id, country, dense_rank() over (partition by tree_id order by country)::int as state from (select distinct tree_id, country from metadata where country is not null)",
}
QUERIES = {
    f.__name__: f
    for f in (
        tree_current_nodes, tree_root_paths, tree_tip_counts, tree_bad_branches, tree_polytomies, tree_pruned_parents, tip_date_bounds,
        clock_root_to_tip, clock_regression, clock_outliers, numeric_dates, aln_clean, aln_composition, aln_alphabet, aln_patterns,
        aln_differences, aln_distances, aln_unmatched_tips, aln_common_taxa, homoplasy_mutations, homoplasy_sites, homoplasy_top,
        homoplasy_histogram, homoplasy_poisson, homoplasy_strains, rate_statistics, gtr_inferred, path_statistics, equal_rates_transitions,
        lineages_through_time, merger_rate_integral, trait_states, aln_columns, aln_lengths, aln_full_length, aln_position_kinds, site_models, tips_undated,
        ancestral_marginal, ancestral_joint, ancestral_fitch, ancestral_inferred, models_inferred, clock_best_root, clock_min_deviation_root,
        clock_covariation_root, clock_oldest_root, clock_local_outliers, timetree_joint, timetree_marginal, timetree_adaptive, timetree_full, timetree_skyline, coalescent_tc, traits_inferred,
        branch_state_pairs, branch_lengths, optimised_trees, simulated_alignments, rate_susceptibility, tree_layout, coalescent_skyline,
        reassortment_clades, tree_newick, tree_nested_json,
    )
}
