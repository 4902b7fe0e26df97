"""Readers of trees, alignments, variant calls and metadata files into DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.kernels import records as K
from cladeflow.kernels.models import Model
from cladeflow.kernels.tree import parse_tree

_NODES = "tree_id string, node_id int, parent_id int, child_ix int, name string, level int, is_tip boolean, branch_length double"
_HEADER = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"


def _whole(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_trees(spark: SparkSession, path) -> DataFrame:
    """nodes of newick or nexus files, one tree per file; tree_id is the file's name.

    Fewer than three tips are an error. Inner nodes without a name are named NODE_0000000, ...
    in preorder, over names that are taken.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, text in zip(b["file"], b["text"]):
                t = parse_tree(text)
                if len(t.tips) < 3:
                    raise ValueError(f"{file}: a tree needs three tips")
                taken, k, level, rank = {n for n in t.name if n}, 0, [0] * len(t), [0] * len(t)
                for i in range(len(t)):
                    for c, j in enumerate(t.children[i]):
                        level[j], rank[j] = level[i] + 1, c
                    if not t.name[i] and t.children[i]:
                        while f"NODE_{k:07d}" in taken:
                            k += 1
                        t.name[i] = f"NODE_{k:07d}"
                        k += 1
                yield pd.DataFrame(
                    {
                        "tree_id": file.rsplit("/", 1)[-1], "node_id": range(len(t)), "parent_id": pd.array([None if p < 0 else int(p) for p in t.parent], "Int32"),
                        "child_ix": rank, "name": t.name, "level": level, "is_tip": [not c for c in t.children], "branch_length": t.length,
                    }
                )

    return _whole(spark, path).mapInPandas(run, _NODES)


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """taxon (the header up to its first blank), description, seq; records are split in the scan."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r"))
    head = F.regexp_replace(F.substring_index("r", "\n", 1), "\r$", "")
    body = F.when(F.instr("r", "\n") > 0, F.regexp_replace(F.expr("substring(r, instr(r, '\n') + 1)"), r"\s", "")).otherwise("")
    out = rows.select(F.substring_index(head, " ", 1).alias("taxon"), head.alias("description"), body.alias("seq"))
    return out.where(F.length("taxon") > 0)


def read_phylip(spark: SparkSession, path) -> DataFrame:
    """taxon, seq of relaxed sequential phylip files: a line of two numbers, then name and letters."""
    rows = spark.read.text(path).select(F.trim("value").alias("v")).where(~F.col("v").rlike(r"^\d+\s+\d+$") & (F.length("v") > 0))
    return rows.select(F.regexp_extract("v", r"^(\S+)", 1).alias("taxon"), F.regexp_replace(F.regexp_extract("v", r"^\S+\s+(.*)$", 1), r"\s", "").alias("seq"))


def read_nexus_alignment(spark: SparkSession, path) -> DataFrame:
    """taxon, seq of nexus files: the rows of their matrix, interleaved or not; quotes around names go."""
    body = F.regexp_extract("text", r"(?is)\\bmatrix\\b(.*?);", 1)
    rows = _whole(spark, path).select(F.posexplode(F.split(F.regexp_replace(body, r"\\[[^\\]]*\\]", ""), "\n")).alias("at", "v")).select("at", F.trim("v").alias("v"))
    part = rows.where("length(v) > 0").select("at", F.regexp_extract("v", r"^('[^']*'|\\S+)\\s+", 1).alias("taxon"), F.regexp_replace(F.regexp_replace("v", r"^('[^']*'|\\S+)\\s+", ""), r"\\s", "").alias("s"))
    parts = F.array_sort(F.collect_list(F.struct("at", "s")))
    return part.groupBy(F.regexp_replace("taxon", "^'|'$", "").alias("taxon")).agg(F.array_join(F.transform(parts, lambda x: x["s"]), "").alias("seq"))


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """taxon, seq of a fasta, relaxed phylip or nexus file, told apart by the file's first line."""
    first = next((r["value"].strip() for r in spark.read.text(path).limit(20).collect() if r["value"].strip()), "")
    if first.lower().startswith("#nexus"):
        return read_nexus_alignment(spark, path)
    return (read_fasta(spark, path) if first.startswith(">") else read_phylip(spark, path)).select("taxon", "seq")


def read_reference(spark: SparkSession, given: str) -> str:
    """A reference sequence, upper case: the first of a fasta file, the origin of a genbank file, or the letters themselves."""
    if re.fullmatch(r"[A-Za-z*-]+", given):
        return given.upper()
    first = spark.read.text(given).limit(1).collect()
    if first and first[0]["value"].startswith("LOCUS"):
        text = _whole(spark, given).first()["text"]
        return re.sub(r"[^A-Za-z]", "", re.search(r"(?ms)^ORIGIN(.*?)^//", text)[1]).upper()
    return read_fasta(spark, given).first()["seq"].upper()


def read_metadata(spark: SparkSession, path) -> DataFrame:
    """Records of csv and tsv files before parsing (line_id, file_name, line_no, raw_line), quotes kept whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, text in zip(b["file"], b["text"]):
                name = file.rsplit("/", 1)[-1]
                recs = list(K.assemble(text.removesuffix("\n").split("\n"), K.separator(name)))
                yield pd.DataFrame({"file_name": name, "line_no": range(1, len(recs) + 1), "raw_line": recs})

    lines = _whole(spark, path).mapInPandas(run, "file_name string, line_no int, raw_line string")
    return lines.select(F.xxhash64("file_name", "line_no").alias("line_id"), "file_name", "line_no", "raw_line")


def read_weights(spark: SparkSession, path) -> DataFrame:
    """state, weight of a csv file with a header."""
    rows = spark.read.csv(path, header=True)
    a, b = rows.columns[:2]
    return rows.select(F.trim(a).alias("state"), F.col(b).try_cast("double").alias("weight"))


def read_resistance(spark: SparkSession, path) -> DataFrame:
    """pos (from 0), alt_base, drug, gene, substitution of a tab-separated table of resistance mutations."""
    r = spark.read.csv(path, header=True, sep="\t")
    return r.select((F.col("GENOMIC_POSITION").cast("int") - 1).alias("pos"), F.upper("ALT_BASE").alias("alt_base"), F.col("DRUG").alias("drug"), F.col("GENE").alias("gene"), F.col("SUBSTITUTION").alias("substitution"))


def read_mccs(spark: SparkSession, path) -> DataFrame:
    """mcc, taxon: one comma-separated list of taxa per line."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).withColumn("mcc", F.monotonically_increasing_id())
    return lines.select("mcc", F.explode(F.split("value", ",")).alias("taxon")).select("mcc", F.trim("taxon").alias("taxon"))


def read_model(path: str) -> Model:
    """Model from a text dump."""
    with open(path) as f:
        return Model.from_text(f.read())


def read_vcf(spark: SparkSession, path) -> dict[str, DataFrame]:
    """variants (taxon, pos from 0, state), insertions (taxon, pos, bases), samples (taxon), meta (line).

    Plain or gzipped. Heterozygous and missing calls are N; a deletion is - per base; * and .
    alleles are N over the REF; other ALT texts than bases are left out. Malformed files are
    errors: no or a wrong header, meta lines or data before or after their place, differing
    numbers of calls or ploidy, several chromosomes, nothing that could be read.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("_at"), F.regexp_replace("value", r"[\r\n]+$", "").alias("v"))
    meta, head = lines.where("v like '##%'"), lines.where("v like '#%' and v not like '##%'")
    data = lines.where("v not like '#%' and length(trim(v)) > 0")
    # the names stay in the header's row, which is joined where they are needed
    top = head.select("_at", F.col("v").startswith(_HEADER).alias("ok"), (F.size(F.split(F.trim("v"), "\t")) - 9).alias("n")).orderBy("_at").limit(2).collect()
    if len(top) != 1 or not top[0]["ok"]:
        raise ValueError(f"{path}: the header line must be there once and begin with {_HEADER!r}")
    n_samples = top[0]["n"]
    names = head.select(F.transform(F.slice(F.split(F.trim("v"), "\t"), F.lit(10), F.lit(max(n_samples, 1))), F.trim).alias("names"))
    if meta.where(F.col("_at") > top[0]["_at"]).limit(1).count() or data.where(F.col("_at") < top[0]["_at"]).limit(1).count():
        raise ValueError(f"{path}: meta lines come first, then the header, then data")
    f = F.split("v", "\t")
    rows = data.select(
        f[0].alias("chrom"), (f[1].cast("int") - 1).alias("pos"), F.upper(f[3]).alias("ref"), F.split(f[4], ",").alias("alts"),
        f[8].alias("format"), F.slice(f, F.lit(10), F.greatest(F.size(f) - 9, F.lit(0))).alias("calls"),
    )
    gt = rows.where("format like 'GT%'").select("pos", "ref", "alts", F.posexplode("calls").alias("_k", "_c"))
    gt = gt.crossJoin(F.broadcast(names)).select("pos", "ref", "alts", F.get("names", F.col("_k")).alias("taxon"), F.trim(F.split("_c", ":")[0]).alias("g"))
    gt = gt.withColumn("parts", F.split("g", r"[|/]"))
    facts = rows.agg(F.countDistinct("chrom").alias("chroms"), F.max(F.size("calls")).alias("hi"), F.min(F.size("calls")).alias("lo")).first()
    ploidy = gt.agg(F.min(F.size("parts")).alias("lo"), F.max(F.size("parts")).alias("hi")).first()
    if facts["chroms"] and facts["chroms"] > 1:
        raise ValueError(f"{path}: several chromosomes")
    if facts["hi"] is not None and (facts["hi"] != n_samples or facts["lo"] != n_samples):
        raise ValueError(f"{path}: numbers of calls and of samples differ")
    if ploidy["lo"] != ploidy["hi"]:
        raise ValueError(f"{path}: mixed ploidy")
    one = F.when(F.size(F.array_distinct("parts")) == 1, F.get("parts", F.lit(0)))
    gt = gt.withColumn("one", one).where("one is null or one <> '0'")
    pick = lambda k: F.get("alts", k.try_cast("int") - 1)
    n_ref = F.length("ref")
    allele = F.upper(pick(F.col("one")))
    star = F.repeat(F.lit("N"), n_ref)
    called = F.when(allele.isin("*", "."), star).when(allele.rlike("^[ACGTN]+$"), allele)
    first, second = F.get("parts", F.lit(0)), F.get("parts", F.lit(1))
    seen = F.upper(pick(second))
    pad = lambda s: F.rpad(F.regexp_replace(s, r"\.", "N"), n_ref, "N")
    het = (
        F.when((n_ref > 1) & (first == "0"), F.when(F.length(seen) >= n_ref, F.substring(seen, F.lit(1), n_ref)).otherwise(pad(seen)))
        .when((n_ref > 1) & (first == "."), pad(F.substring("ref", 1, 1)))
        .when((n_ref == 1) & (first == "0"), F.when(F.length(seen) == 1, "N"))
        .when((n_ref == 1) & (F.size(F.filter("alts", lambda a: F.length(a) > 1)) == 0), "N")
    )
    text = F.when(F.col("one") == ".", star).when(F.col("one").isNotNull(), called).otherwise(het)
    gt = gt.select("taxon", "pos", "ref", "one", text.alias("new")).where("new is not null").withColumn("n", F.length("ref"))
    each = gt.select("taxon", "pos", "ref", "new", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    state = F.when(F.col("i") < F.length("new"), F.substring(F.col("new"), F.col("i") + 1, F.lit(1))).otherwise("-")
    base = F.substring(F.col("ref"), F.col("i") + 1, F.lit(1))
    variants = each.where(state != base).select("taxon", (F.col("pos") + F.col("i")).alias("pos"), state.alias("state")).distinct()
    longer = gt.where((F.length("new") > F.col("n")) & F.col("one").isNotNull())
    insertions = longer.select("taxon", (F.col("pos") + F.col("n") - 1).alias("pos"), F.expr("substring(new, n)").alias("bases")).distinct()
    if not variants.limit(1).count() and not insertions.limit(1).count():
        raise ValueError(f"{path}: no genotypes could be read")
    return {
        "variants": variants, "insertions": insertions,
        "samples": names.select(F.explode("names").alias("taxon")), "meta": meta.select(F.trim("v").alias("line")),
    }


def dense_sequences(variants: DataFrame, samples: DataFrame, reference: str) -> DataFrame:
    """taxon, seq: the reference with each sample's variants put in."""
    v = variants.groupBy("taxon").agg(F.map_from_entries(F.collect_list(F.struct("pos", "state"))).alias("m"))
    letters = F.array(*[F.lit(c) for c in reference]) if len(reference) <= 1000 else F.split(F.lit(reference), "")
    put = F.transform(letters, lambda c, i: F.coalesce(F.try_element_at("m", i), c))
    return samples.join(v, "taxon", "left").select("taxon", F.when(F.col("m").isNull(), F.lit(reference)).otherwise(F.array_join(put, "")).alias("seq"))
