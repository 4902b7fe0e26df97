"""The analyses as jobs from files to files; also the command line."""

from __future__ import annotations

import argparse
import datetime
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.functions import sequences as S
from cladeflow.functions.dates import date_of_distance
from cladeflow.kernels.coalescent import effective_size
from cladeflow.kernels.models import Model, from_exchangeabilities, named
from cladeflow.operators import alignment as AL
from cladeflow.operators import inference as I
from cladeflow.operators import mutations as M
from cladeflow.operators import trees as T
from cladeflow.operators.bad_rows import parse_records
from cladeflow.operators.times import normalise_times
from cladeflow.runtime import get_spark, materialize
from cladeflow.sources import files, sinks


def _out(a, name: str) -> str:
    return os.path.join(a.outdir, name)


def model_given(a) -> Model | None:
    """The model of --custom-gtr, --aa-model or --gtr with --gtr-params; None: it is to be inferred."""
    if a.custom_gtr:
        return files.read_model(a.custom_gtr)
    if a.aa_model:
        with open(a.aa_model) as f:
            return from_exchangeabilities(f.read())
    if a.gtr == "infer":
        return None
    params: dict = {}
    for x in a.gtr_params or ():
        key, value = x.split("=", 1)
        params[key] = [float(v) for v in value.split(",")] if "," in value else float(value)
    return named(a.gtr, letters="aa" if a.aa else "nuc", **params)


def _nodes(spark: SparkSession, a, path: str | None = None) -> DataFrame:
    n = files.read_trees(spark, path or a.tree).withColumn("loaded_at", F.lit(0)).withColumn("deleted_at", F.lit(None).cast("int"))
    return materialize(T.current_nodes(n), "nodes")


def _aln(spark: SparkSession, a, nodes: DataFrame, path: str | None = None) -> DataFrame:
    """tree_id, taxon, seq of the tips of all trees; sequences of differing lengths are an error unless --align is given."""
    path = path or a.aln
    if path.endswith((".vcf", ".vcf.gz")):
        v = files.read_vcf(spark, path)
        raw = files.dense_sequences(v["variants"], v["samples"], files.read_reference(spark, a.vcf_reference))
    else:
        raw = files.read_alignment(spark, path)
    seq = S.clean(F.col("seq"))
    if a.aa:
        seq = F.upper(F.regexp_replace("seq", r"\s", ""))
    raw = raw.select("taxon", (seq if a.keep_overhangs else S.fill_overhangs(seq, "X" if a.aa else "N")).alias("seq")).where("length(seq) > 0").dropDuplicates(["taxon"])
    tips = nodes.where("is_tip")
    aln = materialize(tips.select("tree_id", F.col("name").alias("taxon")).join(raw, "taxon"), "alignment")
    lacking = tips.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n")).join(aln.groupBy("tree_id").agg(F.count(F.lit(1)).alias("k")), "tree_id", "left")
    bad = lacking.where("coalesce(k, 0) * 3 < n * 2").take(1)
    if bad:
        raise SystemExit(f"tree {bad[0]['tree_id']}: more than a third of the tips have no sequence")
    if aln.groupBy("tree_id").agg(F.countDistinct(F.length("seq")).alias("n")).where("n > 1").limit(1).count():
        if not a.align:
            raise SystemExit("the sequences differ in length: align them or give --align")
        placed = AL.tree_columns(aln)
        sinks.write_table(placed.where("status <> 'as is'").select("tree_id", "taxon", "status", "n_inserted", "identity"), _out(a, "aligned"))
        aln = placed.where("seq is not null").select("tree_id", "taxon", "seq")
    return aln


def _models(a, nodes: DataFrame, aln: DataFrame) -> tuple[Model | None, DataFrame | None]:
    """(one model for all trees, None) or (None, the models inferred for each), written as text."""
    given = model_given(a)
    if given is not None:
        with open(os.path.join(_made(a), "sequence_evolution_model.txt"), "w") as f:
            f.write(given.text())
        given.save(os.path.join(a.outdir, "sequence_evolution_model.npz"))
        return given, None
    fixed = None
    if getattr(a, "vcf_reference", None) and a.aln and a.aln.endswith((".vcf", ".vcf.gz")):
        # the sites that vary tell little about frequencies: those of the reference count, with a little for gaps
        ref = files.read_reference(nodes.sparkSession, a.vcf_reference)
        share = [ref.count(c) / len(ref) for c in "ACGT"] + [0.0]
        fixed = [s - 0.01 for s in share[:4]] + [0.04]
    models = I.infer_models(nodes, aln, letters="aa" if a.aa else "nuc", fixed_pi=fixed)
    text = F.concat(F.lit("mu "), F.col("mu").cast("string"), F.lit("; pi "), F.concat_ws(" ", F.col("pi").cast("array<string>")))
    sinks.write_table(models.select("tree_id", text.alias("model"), "log_lh", "rounds"), _out(a, "sequence_evolution_models"))
    return None, models


def _made(a) -> str:
    os.makedirs(a.outdir, exist_ok=True)
    return a.outdir


def _dates(spark: SparkSession, a, nodes: DataFrame) -> DataFrame:
    """Dates of the tips by name, in any form that normalise_times reads; rows that cannot be used are written with the reason."""
    rows = materialize(parse_records(files.read_metadata(spark, a.dates)), "records")
    named_rows = rows.where("(reason is null or reason = 'date') and date is not null").select("line_id", "name", "date", F.lit(None).cast("int").alias("lab_id"))
    none = spark.createDataFrame([], "lab_id int, tz string, date_order string")
    t = materialize(normalise_times(named_rows, none, "line_id", "lab_id", ["date"], keep=("name",)), "read_dates")
    bad = rows.where("reason <> 'date'").select("line_id", "reason", "detail").unionByName(t.where("status <> 'ok'").select("line_id", F.concat(F.lit("date "), "status").alias("reason"), F.col("name").alias("detail")))
    sinks.write_table(bad, _out(a, "unread_metadata"))
    d = t.where("status = 'ok'").groupBy("name").agg(F.min(F.struct("line_id", "lo", "hi")).alias("x")).select("name", "x.lo", "x.hi")
    return materialize(nodes.where("is_tip").join(d, "name").select("tree_id", "node_id", "name", "lo", "hi"), "dates")


def _whole(states: DataFrame) -> DataFrame:
    """tree_id, node_id, seq from blocks of states."""
    blocks = F.array_sort(F.collect_list(F.struct("start", "states")))
    return states.groupBy("tree_id", "node_id").agg(F.array_join(F.transform(blocks, lambda x: x["states"]), "").alias("seq"))


def _shown_sequences(a, whole: DataFrame, nodes: DataFrame, aln: DataFrame) -> DataFrame:
    """Sequences of all nodes with names and parents; tips keep their input letters unless --reconstruct-tip-states."""
    n = whole.join(nodes.select("tree_id", "node_id", "parent_id", "name", "is_tip"), ["tree_id", "node_id"])
    given = aln.select("tree_id", F.col("taxon").alias("name"), F.col("seq").alias("_given"))
    both = n.join(given, ["tree_id", "name"], "left")
    keep = F.lit(False) if a.reconstruct_tip_states else F.col("is_tip") & F.col("_given").isNotNull()
    return both.select("tree_id", "node_id", "parent_id", "name", "is_tip", F.when(keep, F.col("_given")).otherwise(F.col("seq")).alias("seq"))


def _branch_mutations(seqs: DataFrame) -> DataFrame:
    """tree_id, node_id, name, is_tip, a, p (from 0), d where a node differs from its parent; ambiguous letters are no states."""
    up = seqs.select("tree_id", F.col("node_id").alias("parent_id"), F.col("seq").alias("up"))
    site = F.posexplode(F.arrays_zip(F.split("up", "").alias("a"), F.split("seq", "").alias("d"))).alias("p", "x")
    m = seqs.join(up, ["tree_id", "parent_id"]).select("tree_id", "node_id", "name", "is_tip", site).where("x.a <> x.d")
    return m.select("tree_id", "node_id", "name", "is_tip", F.col("x.a").alias("a"), "p", F.col("x.d").alias("d")).where("not (a in ('N', 'X') or d in ('N', 'X'))")


def _states(a, nodes: DataFrame, aln: DataFrame) -> DataFrame:
    model, models = _models(a, nodes, aln)
    method = "fitch" if a.method_anc in ("fitch", "parsimony") else "marginal" if a.marginal else "joint"
    return materialize(_whole(I.ancestral_states(nodes, aln, method, model, models=models)), "states")


def run_ancestral(spark: SparkSession, a) -> None:
    nodes = _nodes(spark, a)
    aln = _aln(spark, a, nodes)
    seqs = materialize(_shown_sequences(a, _states(a, nodes, aln), nodes, aln), "sequences")
    if a.aln.endswith((".vcf", ".vcf.gz")):
        ref = files.read_reference(spark, a.vcf_reference)
        v = seqs.select(F.col("name").alias("taxon"), F.posexplode(F.split("seq", "")).alias("pos", "state")).where(F.col("state") != F.substring(F.lit(ref), F.col("pos") + 1, F.lit(1)))
        sinks.write_vcf(v, seqs.select(F.col("name").alias("taxon")), ref, _out(a, "ancestral_sequences_vcf"))
    sinks.write_fasta(seqs.select(F.col("name").alias("taxon"), "seq"), _out(a, "ancestral_sequences"))
    muts = materialize(_branch_mutations(seqs), "mutations")
    shift = 0 if a.zero_based else 1
    sinks.write_table(muts.select(F.col("name").alias("node"), F.col("a").alias("state1"), (F.col("p") + shift).alias("pos"), F.col("d").alias("state2")).orderBy("node", "pos"), _out(a, "branch_mutations"))
    text = F.concat("a", (F.col("p") + shift).cast("string"), "d")
    listed = muts.groupBy("tree_id", "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", text.alias("t")))), lambda x: x["t"]).alias("mutations"))
    shown = nodes.join(listed, ["tree_id", "node_id"], "left")
    for kind, name in (("nexus", "annotated_tree"), ("json", "tree_json")):
        sinks.tree_texts(shown, kind, ["mutations"]).select("text").write.mode("overwrite").text(_out(a, name))


def _sites(a, aln: DataFrame | None) -> int | DataFrame:
    return a.sequence_length or (1000 if aln is None else I.site_counts(aln))


def _reroot(a) -> str | list[str] | None:
    return None if a.keep_root else a.reroot if len(a.reroot) > 1 else a.reroot[0]


def run_clock(spark: SparkSession, a) -> None:
    nodes = _nodes(spark, a)
    aln = _aln(spark, a, nodes) if a.aln else None
    rate = 0.0 if not a.allow_negative_rate and a.reroot == ["min_dev"] else a.clock_rate
    t = I.clock_trees(nodes, _dates(spark, a, nodes), _sites(a, aln), reroot=_reroot(a), clock_filter=a.clock_filter, filter_method=a.clock_filter_method, covariation=a.covariation, rate=rate or None)
    t = materialize(t, "clock")
    model = t.where("parent_ix < 0").select("tree_id", "slope", "rate_std", "intercept", "root_date", "root_date_std", "r_val", "chisq")
    sinks.write_table(model, _out(a, "molecular_clock"))
    rtt = t.where("date is not null").select("name", "date", F.col("dist2root").alias("root-to-tip distance"), F.col("residual").alias("clock-deviation"), F.col("is_outlier").alias("outlier"))
    sinks.write_table(rtt, _out(a, "rtt"), ",")
    sinks.write_table(t.where("is_outlier").select("name", F.col("date").alias("given_date"), date_of_distance(F.col("dist2root"), F.col("slope"), F.col("intercept")).alias("apparent_date"), "residual"), _out(a, "outliers"))
    sinks.tree_texts(_as_nodes(t)).select("text").write.mode("overwrite").text(_out(a, "rerooted"))


def _as_nodes(t: DataFrame) -> DataFrame:
    """Nodes of a tree that was rebuilt, by their places in it."""
    t = t.withColumnRenamed("node_id", "given_node_id")
    up = F.when(F.col("parent_ix") >= 0, F.col("parent_ix"))
    return t.withColumns({"node_id": F.col("ix"), "parent_id": up, "child_ix": F.col("ix")}).drop("ix", "parent_ix")


def coalescent_model(given: str) -> bool | float | str:
    """What --coalescent asks for: none, the best constant Tc (const, opt), skyline or a Tc in branch lengths."""
    if given in ("", "const", "opt"):
        return bool(given)
    if given == "skyline":
        return given
    try:
        tc = float(given)
    except ValueError:
        tc = float("nan")
    if tc == 0:
        return False
    if not 0 < tc < float("inf"):
        raise SystemExit(f"--coalescent {given}: const, opt, skyline or a Tc is needed, 0 for none")
    return tc


def branch_length_mode(a, nodes: DataFrame) -> str:
    """input, joint or marginal; auto: input without an alignment or where a branch is longer than 0.1, else joint."""
    if a.branch_length_mode != "auto":
        return a.branch_length_mode if a.aln else "input"
    longest = nodes.agg(F.max("branch_length").alias("m")).first()["m"]
    return "input" if not a.aln or (longest or 0) > 0.1 else "joint"


def run_timetree(spark: SparkSession, a) -> None:
    nodes = _nodes(spark, a)
    dates = _dates(spark, a, nodes)
    aln = _aln(spark, a, nodes) if a.aln else None
    mode = branch_length_mode(a, nodes)
    model = models = pairs = muts = None
    if aln is not None:
        model, models = _models(a, nodes, aln)
        if mode != "input":
            better = I.optimised_trees(nodes, aln, model, models).select("tree_id", "node_id", "length")
            nodes = materialize(nodes.join(better, ["tree_id", "node_id"], "left").withColumn("branch_length", F.coalesce("length", "branch_length")).drop("length"), "nodes")
            if mode == "marginal":
                pairs = I.expected_branch_pairs(nodes, aln, model, models)
            else:
                pairs = I.counted_pairs(I.branch_state_pairs(I.ancestral_states(nodes, aln, "joint", model, models=models), nodes), model.letters if model else tuple("ACGT-"))
            pairs = materialize(pairs, "pairs")
        seqs = _shown_sequences(a, _whole(I.ancestral_states(nodes, aln, "marginal" if mode == "marginal" else "joint", model, models=models)), nodes, aln)
        m = _branch_mutations(materialize(seqs, "sequences"))
        text = F.concat("a", (F.col("p") + 1).cast("string"), "d")
        muts = m.groupBy("tree_id", "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", text.alias("t")))), lambda x: x["t"]).alias("mutations"))
    t = I.time_trees(
        nodes, dates, _sites(a, aln), a.confidence or mode == "marginal", a.clock_rate, relax=tuple(a.relax) if a.relax else None,
        coalescent=coalescent_model(a.coalescent), resolve=False if a.keep_polytomies else "stochastic" if a.stochastic_resolve else True,
        stretched_only=not a.greedy_resolve, pairs=pairs, model=model, models=models, reroot=_reroot(a), clock_filter=a.clock_filter,
        filter_method=a.clock_filter_method, covariation=a.covariation, max_iter=a.max_iter, vary_rate=a.vary_rate or a.confidence, rate_std=a.clock_std_dev,
        skyline_points=a.n_skyline,
    )
    t = materialize(t, "times")
    day = F.date_format(F.date_add(F.make_date(F.floor("date").cast("int"), F.lit(1), F.lit(1)), F.floor((F.col("date") - F.floor("date")) * 365.2425).cast("int")), "yyyy-MM-dd")
    sinks.write_table(t.select(F.col("name").alias("node"), F.col("date").alias("numeric date"), "lower", "upper", day.alias("calendar date")), _out(a, "dates"))
    root = t.where("info is not null")
    trace = F.explode(F.from_json(F.get_json_object("info", "$.trace"), "array<array<double>>")).alias("x")
    sinks.write_table(root.select("tree_id", trace).select("tree_id", F.col("x")[0].cast("int").alias("round"), F.col("x")[1].alias("log_lh"), F.col("x")[2].alias("moved")), _out(a, "trace"))
    clock = [F.get_json_object("info", f"$.clock.{k}").alias(k) for k in ("slope", "rate_std", "intercept", "r_val", "root_date", "root_date_std")]
    sinks.write_table(root.select("tree_id", *clock, F.col("slope").alias("rate_used"), "log_lh"), _out(a, "molecular_clock"))
    sinks.write_table(t.where("is_outlier").select("tree_id", "name", "date"), _out(a, "outliers"))
    sky = F.explode(F.from_json(F.get_json_object("info", "$.skyline"), "array<array<double>>")).alias("x")
    # years times the generations in one are the effective size
    size = lambda c: (c * float(effective_size(1.0, 1.0, a.gen_per_year))).alias
    sinks.write_table(root.select("tree_id", sky).select("tree_id", F.col("x")[0].alias("date"), *[size(F.col("x")[k])(n) for k, n in ((1, "N_e"), (2, "lower"), (3, "upper"))]), _out(a, "skyline"))
    shown, extra = t, ["date", "lower", "upper", "bad_branch"]
    if muts is not None:
        shown, extra = t.join(muts, ["tree_id", "node_id"], "left"), [*extra, "mutations"]
    tree = materialize(_as_nodes(shown), "dated")
    sinks.tree_texts(tree, "nexus", ["mutations"] if muts is not None else []).select("text").write.mode("overwrite").text(_out(a, "divergence_tree"))
    years = tree.join(tree.select("tree_id", F.col("node_id").alias("parent_id"), F.col("date").alias("_up")), ["tree_id", "parent_id"], "left").withColumn("branch_length", F.coalesce(F.col("date") - F.col("_up"), F.lit(0.0)))
    sinks.tree_texts(years, "nexus", ["date", *(["mutations"] if muts is not None else [])]).select("text").write.mode("overwrite").text(_out(a, "timetree"))
    sinks.tree_texts(tree, "json", extra).select("text").write.mode("overwrite").text(_out(a, "tree_json"))


def run_mugration(spark: SparkSession, a) -> None:
    nodes = _nodes(spark, a)
    rows = spark.read.csv(a.states, header=True, sep="\t" if a.states.endswith(".tsv") else ",")
    name = a.name_column or next(c for c in rows.columns if c.lower() in ("name", "strain", "accession"))
    trait = a.attribute or next(c for c in rows.columns if c != name)
    t = rows.select(F.col(name).alias("name"), F.when(F.col(trait) != a.missing_data, F.col(trait)).alias("trait")).dropDuplicates(["name"])
    weights = {r["state"]: r["weight"] for r in files.read_weights(spark, a.weights).collect()} if a.weights else None  # one row per state
    out = materialize(I.discrete_traits(nodes, nodes.join(t, "name"), a.pc, 5, a.sampling_bias_correction, weights), "traits")
    shown = out.join(nodes.select("tree_id", "node_id", "name"), ["tree_id", "node_id"])
    sinks.write_table(shown.select("name", F.explode("profile").alias("state", "probability")) if a.confidence else shown.select("name", "state", "probability"), _out(a, "confidence"), ",")
    out.where("model is not null").select("model").write.mode("overwrite").text(_out(a, "GTR"))
    tree = nodes.join(out.select("tree_id", "node_id", F.col("state").alias(trait)), ["tree_id", "node_id"], "left")
    sinks.tree_texts(tree, "nexus", [trait]).select("text").write.mode("overwrite").text(_out(a, "annotated_tree"))


def run_homoplasy(spark: SparkSession, a) -> None:
    nodes = _nodes(spark, a)
    aln = _aln(spark, a, nodes)
    seqs = materialize(_shown_sequences(a, _states(a, nodes, aln), nodes, aln), "sequences")
    m = _branch_mutations(seqs).select("tree_id", "node_id", "is_tip", "a", (F.col("p") + 1).alias("pos"), "d")
    m = materialize(m.where(F.col("a").isin(M.NUC) & F.col("d").isin(M.NUC)), "mutations")
    counts = materialize(M.recurrence(m, ["a", "pos", "d"]), "counts")
    length = aln.agg(F.max(F.length("seq"))).first()[0] + a.const
    top = M.top_recurrent(counts, a.n, length)
    if a.drms:
        d = files.read_resistance(spark, a.drms).withColumn("pos", F.col("pos") + 1).withColumnRenamed("alt_base", "d")
        top = top.join(d, ["pos", "d"], "left")
    sinks.write_table(top, _out(a, "top_mutations"))
    sinks.write_table(M.recurrence_histogram(counts), _out(a, "multiplicities"))
    sinks.write_table(M.poisson_expectation(M.recurrence(m, ["pos"]), length), _out(a, "poisson"))
    again = counts.where("multiplicity > 1").select("a", "pos", "d")
    tips = m.where("is_tip").join(again, ["a", "pos", "d"]).groupBy("tree_id", "node_id").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_table(tips.join(nodes.select("tree_id", "node_id", "name"), ["tree_id", "node_id"]).orderBy(F.col("n").desc(), "name").limit(a.n).select("name", "n"), _out(a, "strains"))


def run_arg(spark: SparkSession, a) -> None:
    """Time trees of two segments: branches within a clade of common history are dated by both alignments, others by their own."""
    if not (a.trees and a.alignments and len(a.trees) == len(a.alignments) == 2 and a.mccs):
        raise SystemExit("two --trees, two --alignments and --mccs are needed")
    trees = [_nodes(spark, a, t) for t in a.trees]
    mccs = files.read_mccs(spark, a.mccs).withColumn("mcc", F.dense_rank().over(_by_mcc()) - 1)
    for k, nodes in enumerate(trees):
        alns = [_aln(spark, a, nodes, p) for p in a.alignments]
        common = alns[0].select("tree_id", "taxon").intersect(alns[1].select("tree_id", "taxon"))
        alns = [materialize(x.join(common, ["tree_id", "taxon"]), "segment") for x in alns]
        model = model_given(a) or named("jc69")
        own, other = (I.expected_branch_pairs(nodes, alns[j], model) for j in (k, 1 - k))
        clades = I.reassortment_clades(nodes, nodes.where("is_tip").select("tree_id", "name").join(mccs, F.col("name") == F.col("taxon")).select("tree_id", "name", "mcc"))
        both = own.alias("x").join(other.select("tree_id", "node_id", F.col("v").alias("w")), ["tree_id", "node_id"]).join(clades.select("tree_id", "node_id", "shared"), ["tree_id", "node_id"])
        pairs = both.select("tree_id", "node_id", F.when(F.col("shared"), F.zip_with("v", "w", lambda x, y: x + y)).otherwise(F.col("v")).alias("v"))
        sites = I.site_counts(alns[0]).unionByName(I.site_counts(alns[1])).groupBy("tree_id").agg(F.sum("sites").alias("sites"))
        t = materialize(I.time_trees(nodes, _dates(spark, a, nodes), sites, a.confidence, a.clock_rate, pairs=materialize(pairs, "pairs"), model=model, resolve=False, max_iter=a.max_iter), "times")
        sinks.write_table(t.select(F.col("name").alias("node"), F.col("date").alias("numeric date"), "lower", "upper"), _out(a, f"dates_{k + 1}"))
        sinks.tree_texts(_as_nodes(t), "nexus", ["date"]).select("text").write.mode("overwrite").text(_out(a, f"timetree_{k + 1}"))


def _by_mcc():
    from pyspark.sql import Window

    return Window.orderBy("mcc")  # one row per clade of two trees


JOBS = {"ancestral": run_ancestral, "clock": run_clock, "timetree": run_timetree, "mugration": run_mugration, "homoplasy": run_homoplasy, "arg": run_arg}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cladeflow")
    p.add_argument("job", nargs="?", default="timetree", choices=[*JOBS, "version"])
    p.add_argument("--tree")
    p.add_argument("--outdir", help="default: a new folder named by the date and the job")
    p.add_argument("--aln")
    p.add_argument("--align", action="store_true", help="put sequences of differing lengths into the columns of their tree")
    p.add_argument("--aa", action="store_true")
    p.add_argument("--aa-model", help="file with exchangeabilities and frequencies of amino acids")
    p.add_argument("--vcf-reference")
    p.add_argument("--dates")
    p.add_argument("--sequence-length", type=int)
    p.add_argument("--gtr", default="infer")
    p.add_argument("--gtr-params", nargs="+", metavar="KEY=VALUE")
    p.add_argument("--custom-gtr")
    p.add_argument("--method-anc", default="probabilistic", choices=["parsimony", "fitch", "probabilistic", "ml"])
    p.add_argument("--marginal", action="store_true")
    p.add_argument("--reconstruct-tip-states", action="store_true")
    p.add_argument("--keep-overhangs", action="store_true")
    p.add_argument("--zero-based", action="store_true")
    p.add_argument("--clock-filter", type=float, default=4.0)
    p.add_argument("--clock-filter-method", default="residual", choices=["residual", "local"])
    p.add_argument("--clock-rate", type=float)
    p.add_argument("--clock-std-dev", type=float)
    p.add_argument("--covariation", action="store_true")
    p.add_argument("--reroot", nargs="+", default=["best"], help="best, least-squares, min_dev, oldest, or names of tips or nodes")
    p.add_argument("--keep-root", action="store_true")
    p.add_argument("--allow-negative-rate", action="store_true")
    p.add_argument("--branch-length-mode", default="auto", choices=["auto", "input", "joint", "marginal"])
    p.add_argument("--max-iter", type=int, default=2)
    p.add_argument("--keep-polytomies", action="store_true")
    p.add_argument("--stochastic-resolve", action="store_true")
    p.add_argument("--greedy-resolve", action="store_true")
    p.add_argument("--confidence", action="store_true")
    p.add_argument("--vary-rate", action="store_true")
    p.add_argument("--relax", nargs=2, type=float)
    p.add_argument("--coalescent", default="")
    p.add_argument("--n-skyline", type=int, default=20)
    p.add_argument("--gen-per-year", type=float, default=50.0)
    p.add_argument("--states")
    p.add_argument("--weights")
    p.add_argument("--attribute")
    p.add_argument("--name-column")
    p.add_argument("--missing-data", default="?")
    p.add_argument("--pc", type=float, default=1.0)
    p.add_argument("--sampling-bias-correction", type=float)
    p.add_argument("--const", type=int, default=0)
    p.add_argument("-n", type=int, default=10)
    p.add_argument("--drms")
    p.add_argument("--trees", nargs=2)
    p.add_argument("--alignments", nargs=2)
    p.add_argument("--mccs")
    return p


def fresh_folder(job: str, today: datetime.date | None = None) -> str:
    """<date>_<job>, with a counter where that is taken."""
    base, k = f"{today or datetime.date.today():%Y-%m-%d}_{job}", 0
    while os.path.exists(name := base if not k else f"{base}-{k:04d}"):
        k += 1
    return name


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.job == "version":
        from cladeflow import __version__

        print(__version__)
        return 0
    if not a.tree and a.job != "arg":
        raise SystemExit("--tree is needed: trees are not built here")
    if not a.aln and a.job in ("ancestral", "homoplasy"):
        raise SystemExit("--aln is needed")
    a.outdir = a.outdir or fresh_folder(a.job)
    JOBS[a.job](spark or get_spark(), a)
    return 0
