import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow.functions import sequences as S
from cladeflow.functions.dates import date_bounds, date_of, numeric_date
from cladeflow.kernels.distribution import Distribution
from cladeflow.operators import alignment as AL
from cladeflow.operators import inference as I
from cladeflow.operators import trees as T
from cladeflow.plans import jobs, tree_queries
from cladeflow.runtime import dimension_join, read, salt_hot
from cladeflow.sources import files, sinks
from cladeflow.streaming.accumulate import event_windows, mutation_counts, sessions

SLOW = {"optimised_trees", "ancestral_inferred", "timetree_full"}  # covered by the job tests


@pytest.mark.parametrize("name", sorted(tree_queries.SQL))
def test_tree_sql(compare, name):
    compare(tree_queries.QUERIES[name], tree_queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(tree_queries.QUERIES) - set(tree_queries.SQL) - SLOW))
def test_tree_queries_run(spark, small, name):
    assert tree_queries.QUERIES[name](spark, small).count() >= 0


def test_paths_of_a_deep_tree(spark):
    rows = [("t", i, i - 1 if i else None, 0, f"n{i}", i == 70, 1.0) for i in range(71)] + [("t", 100, 99, 0, "lost", True, 2.0)]
    n = spark.createDataFrame(rows, "tree_id string, node_id int, parent_id int, child_ix int, name string, is_tip boolean, branch_length double")
    p = {r["node_id"]: r for r in T.root_paths(n).collect()}
    assert p[70]["depth"] == 70 and p[70]["dist2root"] == 70.0 and p[70]["root_id"] == 0
    assert p[100]["depth"] == 0 and p[100]["root_id"] == 100
    loop = n.where("node_id < 2").withColumn("parent_id", 1 - F.col("node_id"))
    with pytest.raises(ValueError):
        T.root_paths(loop)
    assert T.root_paths(n.limit(0)).count() == 0


def test_skew_helpers(spark):
    left = spark.range(200).select("id", F.when(F.col("id") < 150, 1).otherwise(F.col("id")).alias("k"))
    dim = spark.range(1, 200).select(F.col("id").cast("long").alias("k"), (F.col("id") * 2).alias("v"))
    want = left.join(dim, "k", "left").count()
    assert dimension_join(left, dim, ["k"], "id").count() == want
    wide = dim.crossJoin(spark.range(400)).select("k", "v", F.col("id").alias("w"))  # too large to broadcast
    assert dimension_join(left, wide, ["k"], "id").count() == left.join(wide, "k", "left").count()
    a, b, by = salt_hot(left, dim, ["k"], "id", 10)
    assert a.join(b, by, "left").count() == want and a.select("_cf_salt").distinct().count() > 5


def test_dates(spark):
    rows = ["2017-08-25", "2017.56", "[2013.45:2015.56]", "2017-02-XX", "2017-XX-XX", "x", None, "2017-13-XX", "2017-02-30"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    lo, hi = date_bounds(F.col("t"))
    got = {r["t"]: (r["lo"], r["hi"]) for r in df.select("t", lo.alias("lo"), hi.alias("hi")).collect()}
    assert got["2017.56"] == (2017.56, 2017.56) and got["[2013.45:2015.56]"] == (2013.45, 2015.56)
    assert got["2017-02-XX"][1] == pytest.approx(2017 + (31 + 28 - 0.5) / 365) and got["2017-XX-XX"][0] == pytest.approx(2017 + 0.5 / 365)
    assert all(got[k] == (None, None) for k in ("x", None, "2017-13-XX", "2017-02-30"))
    d = df.select(F.to_date(F.lit("2020-12-31")).alias("d")).limit(1).select("d", date_of(numeric_date(F.col("d"))).alias("e")).first()
    assert d["d"] == d["e"]


def test_sequences(spark):
    df = spark.createDataFrame([("--AC-GT--",), ("----",), ("ACGT",), ("",)], "s string")
    assert [r[0] for r in df.select(S.fill_overhangs(F.col("s"))).collect()] == ["NNAC-GTNN", "NNNN", "ACGT", ""]
    k = spark.createDataFrame([(0,), (5,), (40,)], "k int").select(S.log_factorial(F.col("k"))).collect()
    import math

    assert [r[0] for r in k] == pytest.approx([0.0, math.lgamma(6), math.lgamma(41)], abs=1e-6)


def test_ancestral_blocks_agree(spark):
    nodes = spark.createDataFrame(
        [("t", 0, None, 0, "r", False, 0.0), ("t", 1, 0, 0, "x", False, 0.1), ("t", 2, 1, 0, "A", True, 0.1), ("t", 3, 1, 1, "B", True, 0.1), ("t", 4, 0, 1, "C", True, 0.2)],
        "tree_id string, node_id int, parent_id int, child_ix int, name string, is_tip boolean, branch_length double",
    )
    sim = I.simulate_alignments(nodes, 90, seed=3)
    aln = sim.select("tree_id", F.col("name").alias("taxon"), "seq")
    one, many = I.ancestral_states(nodes, aln, "joint"), I.ancestral_states(nodes, aln, "joint", block=20)
    join = lambda d: {r["node_id"]: r["s"] for r in d.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "states"))), lambda x: x["states"]), "").alias("s")).collect()}
    assert join(one) == join(many) and len(join(one)[0]) == 90
    pairs = I.branch_state_pairs(one, nodes)
    assert pairs.groupBy("node_id").agg(F.sum("n").alias("n")).where("n <> 90").count() == 0
    got = {r["node_id"]: r for r in I.branch_lengths(pairs).collect()}
    for r in got.values():
        if 0 < r["hamming"] < 0.6:
            assert r["length"] == pytest.approx(-0.75 * np.log(1 - r["hamming"] / 0.75), rel=1e-3)


def test_patterns_keep_variable_columns(spark):
    aln = spark.createDataFrame([("t", "a", "AACAN"), ("t", "b", "AACCA"), ("t", "c", "AACAA")], "tree_id string, taxon string, seq string")
    patterns = AL.column_patterns(AL.site_letters(aln))
    p = {r["pattern"]: r["multiplicity"] for r in patterns.collect()}
    assert p == {"AAA": 3, "CCC": 1, "ACA": 1}
    longer = {r["pattern"]: r["multiplicity"] for r in AL.with_constant_sites(patterns, 13).collect()}
    assert longer == {"AAA": 9, "CCC": 3, "ACA": 1}
    odd = aln.unionByName(aln.limit(1).select("tree_id", F.lit("d").alias("taxon"), F.lit("AAT").alias("seq")))
    assert AL.column_patterns(AL.site_letters(odd)).where("n_sites = 3").count() == 2  # no sequence is left out
    a = spark.createDataFrame([("k", 1, "C"), ("k", 2, "G")], "key string, pos int, state string")
    b = spark.createDataFrame([("k", 2, "G"), ("k", 3, "T")], "key string, pos int, state string")
    ref = spark.createDataFrame([(i, "A") for i in range(5)], "pos int, ref string")
    assert {tuple(r) for r in AL.sparse_differences(a, b, ref).collect()} == {("k", 1, "C", "A"), ("k", 3, "A", "T")}


def test_distributions():
    x = np.linspace(-8, 8, 801)
    g = lambda m, s: Distribution(x, (x - m) ** 2 / (2 * s * s) + np.log(s * np.sqrt(2 * np.pi)))
    a, b = g(0, 1), g(1, 0.5)
    assert a.integral() == pytest.approx(1, abs=1e-3) and a.fwhm() == pytest.approx(2.355, abs=0.05)
    c = a.convolved(b)
    assert c.peak_pos == pytest.approx(1, abs=0.05) and c.fwhm() == pytest.approx(2.355 * np.sqrt(1.25), abs=0.1) and c.integral() == pytest.approx(1, abs=0.02)
    p = Distribution.product([a, b])
    assert p.peak_pos == pytest.approx(0.8, abs=0.05) and np.allclose(p.over(b).prob(0.3), a.prob(0.3), rtol=1e-6)
    d = Distribution.delta(2.0)
    assert Distribution.product([a, d]).is_delta and a.convolved(d).peak_pos == pytest.approx(2) and a.scaled(-2).fwhm() == pytest.approx(4.71, abs=0.1)
    assert a.max_convolved(b).peak_pos == pytest.approx(1, abs=0.1) and len(a.thinned().x) < 801
    assert a.quantile(0.5) == pytest.approx(0, abs=0.02)


# files
HEAD = "##fileformat=VCFv4.3\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"


def _vcf(tmp_path, samples, lines, head=HEAD):
    p = tmp_path / "x.vcf"
    p.write_text(head + "\t".join(samples) + "\n" + "".join(f"{c}\t{pos}\t.\t{ref}\t{alt}\t.\t.\t.\tGT\t" + "\t".join(map(str, g)) + "\n" for c, pos, ref, alt, *g in lines))
    return str(p)


def _shown(df, value):
    out = {}
    for r in df.orderBy("taxon", "pos").collect():
        out.setdefault(r["taxon"], []).append(f"{r['pos'] + 1}{r[value]}")
    return out


@pytest.mark.parametrize(
    "lines,variants,insertions",
    [
        ([(1, 5, "T", "C", 1, 1, 1), (1, 7, "T", "G", 1, 1, 0), (1, 28, "A", "N", 0, 0, 1), (1, 33, "A", "C,G", 1, 2, 0)], {"A": ["5C", "7G", "33C"], "B": ["5C", "7G", "33G"], "C": ["5C", "28N"]}, {}),
        ([(1, 2, "T", "A", ".", 1, 0), (1, 4, "GA", "C", ".", 1, 0)], {"A": ["2N", "4N", "5N"], "B": ["2A", "4C", "5-"]}, {}),
        ([(1, 3, "C", "*,G", 1, 2, 0), (1, 4, "GA", ".,*", 0, 0, 2)], {"A": ["3N"], "B": ["3G"], "C": ["4N", "5N"]}, {}),
        ([(20, 3, "C", "G", 1, 0, 0), (20, 2, "TC", "T,TCA", 0, 1, 2)], {"A": ["3G"], "B": ["3-"]}, {"C": ["3CA"]}),
        ([(20, 2, "TCG", "TG,T,TCAG", 1, 2, 3)], {"A": ["3G", "4-"], "B": ["3-", "4-"], "C": ["4A"]}, {"C": ["4AG"]}),
        ([(20, 3, "C", "CTAG", 1, 0, 0), (20, 4, "A", "G", 0, 1, 0)], {"B": ["4G"]}, {"A": ["3CTAG"]}),
        ([(1, 2, "T", "GA", 1, 0, 0), (1, 3, "CGA", "NTTTA,CCGT", 1, 2, 0)], {"A": ["2G", "3N", "4T", "5T"], "B": ["4C", "5G"]}, {"A": ["2GA", "5TTA"], "B": ["5GT"]}),
        ([(1, 2, "GCC", "G", "1/1", "0/1", "./."), (1, 9, "A", "T", "0/1", "1|1", "0/0")], {"A": ["3-", "4-", "9N"], "B": ["3N", "4N", "9T"], "C": ["2N", "3N", "4N"]}, {}),
    ],
)
def test_vcf_calls(spark, tmp_path, lines, variants, insertions):
    v = files.read_vcf(spark, _vcf(tmp_path, "ABC", lines))
    assert _shown(v["variants"], "state") == variants and _shown(v["insertions"], "bases") == insertions
    assert v["samples"].count() == 3


@pytest.mark.parametrize(
    "samples,lines,head",
    [("A", [(1, 2, "T", "A", 1)], "##x\n"), ("A", [(1, 2, "T", "A", 1, 1)], HEAD), ("A", [], HEAD), ("AB", [(1, 2, "T", "A", "1/1", "1")], HEAD), ("A", [(1, 2, "T", "A", 1), (2, 2, "T", "A", 1)], HEAD), ("A", [(1, 2, "T", "C*", 1)], HEAD)],
)
def test_malformed_vcf(spark, tmp_path, samples, lines, head):
    with pytest.raises(ValueError):
        files.read_vcf(spark, _vcf(tmp_path, samples, lines, head))


def test_vcf_roundtrip(spark, tmp_path):
    ref = "ATCGACC"
    v = spark.createDataFrame([("A", 1, "G"), ("A", 3, "-"), ("A", 4, "-"), ("B", 6, "-"), ("B", 1, "C")], "taxon string, pos int, state string")
    s = spark.createDataFrame([("A",), ("B",)], "taxon string")
    sinks.write_vcf(v, s, ref, str(tmp_path / "out"))
    text = "\n".join(r["value"] for r in sinks.vcf_lines(v, s, ref).orderBy("key", "n").collect())
    (tmp_path / "again.vcf").write_text(text + "\n")
    back = files.read_vcf(spark, str(tmp_path / "again.vcf"))
    assert {tuple(r) for r in back["variants"].collect()} == {tuple(r) for r in v.collect()}
    dense = {r["taxon"]: r["seq"] for r in files.dense_sequences(back["variants"], back["samples"], ref).collect()}
    assert dense == {"A": "AGC--CC", "B": "ACCGAC-"}


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">x one\nACGT\nAC\n>y\nGG\r\n>z\n")
    assert {r["taxon"]: r["seq"] for r in files.read_fasta(spark, str(tmp_path / "a.fasta")).collect()} == {"x": "ACGTAC", "y": "GG", "z": ""}
    (tmp_path / "a.phy").write_text("2 4\nx  AC GT\ny ACGA\n")
    assert {r["taxon"]: r["seq"] for r in files.read_phylip(spark, str(tmp_path / "a.phy")).collect()} == {"x": "ACGT", "y": "ACGA"}
    (tmp_path / "t.nwk").write_text("((A:1,B:2):1,C:3);")
    n = files.read_trees(spark, str(tmp_path / "t.nwk"))
    assert n.count() == 5 and n.where("name = 'NODE_0000000' and parent_id is null").count() == 1
    (tmp_path / "m.txt").write_text("A,B\nC\n")
    assert files.read_mccs(spark, str(tmp_path / "m.txt")).groupBy("mcc").count().count() == 2
    (tmp_path / "meta.csv").write_text('name,date,note\nA,2001.5,"two\nlines"\nB,bad,\n')
    assert files.read_metadata(spark, str(tmp_path / "meta.csv")).count() == 3
    clade = n.where("is_tip").select("tree_id", "name", F.when(F.col("name") == "C", 2).otherwise(1).alias("mcc"))
    shared = I.reassortment_clades(n, clade).where("shared").count()
    assert shared == 2
    tree = json.loads(sinks.tree_texts(n, "json").first()["text"])["tree"]
    assert {c["name"] for c in tree["children"]} == {"NODE_0000001", "C"}
    assert "Begin Trees" in sinks.tree_texts(n, "nexus", ["level"]).first()["text"]


def test_coalescent_option(spark, tmp_path):
    (tmp_path / "t.nwk").write_text("(((A:0.02,B:0.03):0.01,C:0.05):0.01,(D:0.06,E:0.08):0.01);")
    (tmp_path / "d.csv").write_text("name,date\nA,2003\nB,2004\nC,2005.4\nD,2006.5\nE,2008.5\n")
    arg = ["timetree", "--tree", str(tmp_path / "t.nwk"), "--dates", str(tmp_path / "d.csv"), "--sequence-length", "200", "--keep-polytomies"]
    dates = {}
    for given in ("", "opt", "0.001", "5", "skyline"):
        out = tmp_path / f"c{given}"
        assert jobs.main([*arg, "--outdir", str(out), "--coalescent", given], spark) == 0
        dates[given] = sorted(tuple(r) for r in spark.read.csv(str(out / "dates"), header=True, sep="\t").collect())
    assert dates["0.001"] != dates["5"] and dates["0.001"] != dates["opt"]  # the given Tc counts
    root = lambda k: min(float(r[1]) for r in dates[k])
    assert root("0.001") > root("5")  # a small Tc draws mergers together
    assert jobs.coalescent_model("0.0") is False and jobs.coalescent_model("opt") is True and jobs.coalescent_model("skyline") == "skyline"
    for wrong in ("x", "-1", "nan", "inf"):
        with pytest.raises(SystemExit):
            jobs.coalescent_model(wrong)


def _job_files(tmp_path):
    rng = np.random.default_rng(1)
    base = "".join(rng.choice(list("ACGT"), 200))
    mutate = lambda s, k: "".join(c if i not in set(rng.choice(200, k)) else "ACGT"[("ACGT".index(c) + 1) % 4] for i, c in enumerate(s))
    seqs = {t: mutate(base, 4 + 2 * i) for i, t in enumerate("ABCDE")}
    (tmp_path / "t.nwk").write_text("(((A:0.02,B:0.03):0.01,C:0.05):0.01,(D:0.06,E:0.08):0.01);")
    (tmp_path / "a.fasta").write_text("".join(f">{k}\n{v}\n" for k, v in seqs.items()))
    (tmp_path / "d.csv").write_text("name,date,country\nA,2003,x\nB,25 Jan 2004,x\nC,2005-06-01T10:00:00Z,y\nD,2006.5,y\nE,2008-XX-XX,?\n")
    (tmp_path / "m.txt").write_text("A,B,C\nD,E\n")
    return ["--tree", str(tmp_path / "t.nwk"), "--aln", str(tmp_path / "a.fasta"), "--dates", str(tmp_path / "d.csv"), "--states", str(tmp_path / "d.csv"), "--attribute", "country", "--sequence-length", "200"]


def _table(spark, path, sep="\t"):
    return spark.read.csv(str(path), header=True, sep=sep)


def test_jobs(spark, tmp_path):
    arg = _job_files(tmp_path)
    two = ["--trees", str(tmp_path / "t.nwk"), str(tmp_path / "t.nwk"), "--alignments", str(tmp_path / "a.fasta"), str(tmp_path / "a.fasta"), "--mccs", str(tmp_path / "m.txt")]
    for job in jobs.JOBS:
        out = tmp_path / job
        assert jobs.main([job, *arg, *two, "--outdir", str(out), "--gtr", "jc69"], spark) == 0
        assert any(out.iterdir())
    assert _table(spark, tmp_path / "timetree/dates").where("node in ('A', 'B', 'C', 'D', 'E')").count() == 5
    assert {"round", "log_lh", "moved"} <= set(_table(spark, tmp_path / "timetree/trace").columns)
    tree = json.loads(spark.read.text(str(tmp_path / "timetree/tree_json")).first()[0])["tree"]
    tip = tree
    while "children" in tip:
        tip = tip["children"][0]
    assert tip["node_attrs"]["num_date"]["value"] > 2002 and "mutations" in tip["branch_attrs"] and tip["node_attrs"]["bad_branch"]["value"] == "No"
    assert jobs.main(["clock", *arg, "--keep-root", "--outdir", str(tmp_path / "kept")], spark) == 0
    assert _table(spark, tmp_path / "kept/rtt", ",").count() == 5
    assert _table(spark, tmp_path / "arg/dates_1").count() == 9
    kept = spark.read.text(str(tmp_path / "ancestral/ancestral_sequences")).where("value like '>%'").count()
    assert kept == 9


def test_job_options_have_effects(spark, tmp_path):
    arg = _job_files(tmp_path)

    def dates(name, *more):
        out = tmp_path / name
        assert jobs.main(["timetree", *arg, "--outdir", str(out), *more], spark) == 0
        return sorted(tuple(r) for r in _table(spark, out / "dates").collect())

    plain = dates("plain", "--gtr", "jc69", "--keep-root")
    assert dates("inferred", "--keep-root") != plain  # the model is inferred
    assert _table(spark, tmp_path / "inferred/sequence_evolution_models").count() == 1
    assert dates("input", "--gtr", "jc69", "--keep-root", "--branch-length-mode", "input") != plain
    sky = dates("sky", "--gtr", "jc69", "--keep-root", "--coalescent", "skyline", "--confidence", "--n-skyline", "5")
    assert all(r[2] is not None for r in sky) and _table(spark, tmp_path / "sky/skyline").count() == 5
    assert jobs.fresh_folder("x").endswith("_x")
    short = tmp_path / "short.fasta"
    short.write_text((tmp_path / "a.fasta").read_text().replace(">E\n", ">E\nACG"))
    with pytest.raises(SystemExit):
        jobs.main(["ancestral", *arg, "--aln", str(short), "--outdir", str(tmp_path / "no")], spark)
    assert jobs.main(["ancestral", *arg, "--aln", str(short), "--align", "--gtr", "jc69", "--outdir", str(tmp_path / "yes")], spark) == 0
    assert _table(spark, tmp_path / "yes/aligned").first()["status"] == "aligned"


def test_streams(spark, small, tmp_path):
    m = read(spark, small, "mutations")
    m.write.parquet(str(tmp_path / "m"))
    read(spark, small, "events").write.parquet(str(tmp_path / "e"))

    def drain(df, name):
        q = df.writeStream.outputMode("complete" if name != "sessions" else "append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c_{name}")).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    stream = lambda d, t: spark.readStream.schema(t.schema).parquet(str(tmp_path / d))
    assert drain(mutation_counts(stream("m", m), late="3650 days"), "muts").agg(F.sum("n")).first()[0] == m.count()
    e = read(spark, small, "events")
    assert drain(event_windows(stream("e", e)), "events_w").agg(F.sum("n")).first()[0] == e.count()
    assert drain(sessions(stream("e", e)), "sessions").count() >= 0


def test_sparse_positions(spark):
    v = spark.createDataFrame([("a", 1, "C"), ("b", 1, "C"), ("c", 1, "C"), ("a", 2, "G"), ("a", 3, "N"), ("b", 4, "T"), ("c", 4, "N")], "taxon string, pos int, state string")
    assert {r["pos"]: r["kind"] for r in AL.sparse_positions(v.withColumn("k", F.lit(1)), spark.createDataFrame([(1, 3)], "k int, n_taxa int"), ["k"]).collect()} == {1: "constant", 2: "variable", 3: "ambiguous", 4: "variable"}
    s = spark.createDataFrame([("a", 0, "A"), ("a", 1, "C")], "taxon string, cpos int, state string")
    p = spark.createDataFrame([(0, [0, 2]), (1, [1])], "cpos int, positions array<int>")
    assert {tuple(r) for r in AL.expand_patterns(s, p).collect()} == {("a", 0, "A"), ("a", 1, "C"), ("a", 2, "A")}


_NODES = "tree_id string, node_id int, parent_id int, child_ix int, name string, is_tip boolean, branch_length double"


def _random_nodes(spark, n=60, seed=2, rate=0.01):
    rng = np.random.default_rng(seed)
    par = [None] + [int(rng.integers(0, k)) for k in range(1, n)]
    inner = set(par)
    when = [2000.0]
    for i in range(1, n):
        when.append(when[par[i]] + float(rng.exponential(1.5)))
    rows = [("t", i, par[i], 0, f"n{i}", i not in inner, 0.0 if i == 0 else float(rng.gamma(20, 1 / 20) * rate * (when[i] - when[par[i]]))) for i in range(n)]
    dates = [("t", i, when[i], when[i]) for i in range(n) if i not in inner]
    return spark.createDataFrame(rows, _NODES), spark.createDataFrame(dates, "tree_id string, node_id int, lo double, hi double")


def test_root_regressions_agree_with_the_search(spark):
    from cladeflow.operators.rooting import root_regressions

    nodes, dates = _random_nodes(spark)
    closed = root_regressions(nodes, dates).collect()
    searched = I.best_roots(nodes, dates, 1000).first()
    assert len(closed) == 1 and closed[0]["chisq"] == pytest.approx(searched["chisq"], rel=1e-3) and closed[0]["slope"] == pytest.approx(searched["slope"], rel=0.02)
    flat = root_regressions(nodes, dates, 0.0).first()
    assert flat["slope"] == 0 and flat["chisq"] >= closed[0]["chisq"]
    assert root_regressions(nodes, dates.limit(2)).count() == 0 and root_regressions(nodes.limit(0), dates).count() == 0


def test_subtree_sums_and_skipping_on_a_ladder(spark):
    n = 150
    rows = [("t", i, i - 1 if i else None, 0, f"n{i}", False, 1.0) for i in range(n)] + [("t", 1000 + i, i, 1, f"t{i}", True, 1.0) for i in range(n)]
    ladder = spark.createDataFrame(rows, _NODES).repartition(7)
    s = {r["node_id"]: r for r in T.subtree_sums(ladder, {"n": ("sum", F.lit(1)), "far": ("max", F.col("node_id")), "near": ("min", F.col("node_id")), "all": ("every", F.col("node_id") > 1010)}).collect()}
    assert s[0]["n"] == n and s[140]["n"] == 10 and s[140]["far"] == 1149 and s[20]["near"] == 1020 and s[11]["all"] and not s[10]["all"] and s[1003]["n"] == 1
    kept = {r["node_id"]: r["new_parent_id"] for r in T.kept_ancestor(ladder, (F.col("node_id") % 10 != 0) & (F.col("node_id") < 1000)).collect()}
    assert kept[1149] == 140 and kept[140] == 130 and kept[0] is None and 141 not in kept
    assert T.subtree_sums(ladder.limit(0), {"n": ("sum", F.lit(1))}).count() == 0


def test_tree_columns(spark):
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("ACGT"), 120))
    other = "".join(rng.choice(list("ACGT"), 130))
    rows = [("t", c, base) for c in "abcd"] + [("t", "longer", base[:50] + "ACG" + base[50:]), ("t", "shorter", base[:70] + base[75:]), ("t", "stranger", other), ("t", "tiny", "ACG"), ("u", "only", "ACGT")]
    aln = spark.createDataFrame(rows, "tree_id string, taxon string, seq string").withColumn("ref", F.lit("clash")).withColumn("n_other", F.lit(9))
    got = {(r["tree_id"], r["taxon"]): r for r in AL.tree_columns(aln, least=0.7).collect()}
    assert len(got) == len(rows)
    assert got["t", "longer"]["seq"] == base and got["t", "longer"]["n_inserted"] == 3 and got["t", "longer"]["status"] == "aligned"
    assert len(got["t", "shorter"]["seq"]) == 120 and got["t", "shorter"]["seq"].count("-") == 5
    assert got["t", "stranger"]["status"] == got["t", "tiny"]["status"] == "left out" and got["t", "tiny"]["seq"] is None
    assert got["u", "only"]["status"] == got["t", "a"]["status"] == "as is"
    assert AL.tree_columns(aln.limit(0)).count() == 0
    with pytest.raises(ValueError):
        I.site_blocks(_random_nodes(spark)[0], aln.select("tree_id", "taxon", "seq"))


def test_models_are_recovered(spark):
    from cladeflow.kernels.models import Model

    true = Model("nuc_nogap", 1.0, [0.4, 0.1, 0.15, 0.35], [[0, 1, 4, 1], [1, 0, 1, 4], [4, 1, 0, 1], [1, 4, 1, 0]])
    nodes, _ = _random_nodes(spark, 80, 5, 0.05)
    sim = I.simulate_alignments(nodes, 1500, true, seed=4, block=1500)
    aln = sim.select("tree_id", F.col("name").alias("taxon"), "seq")
    m = I.infer_models(nodes, aln, rounds=6, letters="nuc_nogap").first()
    assert np.allclose(m["pi"], true.pi, atol=0.05) and m["mu"] == pytest.approx(1.0, rel=0.15) and m["w"][0][2] > 2 * m["w"][0][1]
    states = I.ancestral_states(nodes, aln, "marginal", models=I.infer_models(nodes, aln, rounds=1, letters="nuc_nogap"))
    assert states.select("node_id").distinct().count() == 80
    drawn = I.ancestral_states(nodes, aln, "marginal", true, sample=1)
    assert drawn.exceptAll(I.ancestral_states(nodes, aln, "marginal", true, sample=1)).count() == 0  # a seed draws the same
    sites = I.infer_site_models(nodes, aln.withColumn("seq", F.substring("seq", 1, 60)))
    assert sites.count() == 60 and sites.where("mu > 0").count() == 60


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace as N

    from cladeflow.runtime import shared_dir

    def session(master, checkpoint=None):
        option = N(isDefined=lambda: checkpoint is not None, get=lambda: checkpoint)
        sc = N(getConf=lambda: N(get=lambda k: None), _jsc=N(sc=lambda: N(getCheckpointDir=lambda: option)), master=master, applicationId="x")
        return N(conf=N(get=lambda k, d=None: None), sparkContext=sc)

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))
    assert shared_dir(session("yarn", "hdfs:/shared")) == "hdfs:/shared" and shared_dir(session("local[4]")).startswith("file:")


def test_pairs_counted_with_the_states(spark, small):
    from cladeflow.operators import inference as I
    from cladeflow.plans import tree_queries as Q

    n, aln = Q._nodes(spark, small), Q._columns(spark, small)
    rows = lambda df: sorted(map(tuple, df.select("tree_id", "node_id", "anc", "der", "n").collect()))
    got = rows(I.ancestral_pairs(n, aln))
    assert got and got == rows(I.branch_state_pairs(I.ancestral_states(n, aln, "joint"), n))


def test_references_prefer_letters(spark):
    from cladeflow.operators import alignment as AL

    aln = spark.createDataFrame([("a", str(k), s) for k, s in enumerate(["NC-T", "NA-T", "-ANG", "-CNN"])] + [("b", "0", "ACGTN")], "tree_id string, taxon string, seq string")
    assert {r["tree_id"]: r["ref"] for r in AL.references(aln).collect()} == {"a": "-A-T", "b": "ACGTN"}
