"""Writers: fasta, variant calls, newick, nexus, nested tree JSON, tables."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.operators.inference import NODE_COLUMNS, _trees
from cladeflow.runtime import spread


def write_fasta(aln: DataFrame, path: str, width: int = 80) -> None:
    """Records >taxon and letters in lines of the given width."""
    lines = F.concat(F.lit(">"), "taxon", F.lit("\n"), F.regexp_replace("seq", f"(.{{{width}}})(?!$)", "$1\n"))
    aln.select(lines.alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Tables such as dates, outliers, skylines and rates as text with a header."""
    df.write.mode("overwrite").csv(path, sep=sep, header=True)


def vcf_lines(variants: DataFrame, samples: DataFrame, reference: str, chrom: str = "1") -> DataFrame:
    """Lines of a variant-call file: order key and text. Runs of deleted bases of a sample are one call with the base before.

    The samples are one row of the plan, as they are one line of the file; positions are distributed.
    """
    names = samples.agg(F.array_sort(F.collect_list("taxon")).alias("names"))  # one row, as the header is one line
    snp = variants.where("state <> '-'").select("taxon", "pos", F.lit(1).alias("n"), F.col("state").alias("alt"))
    w = Window.partitionBy("taxon").orderBy("pos")
    runs = variants.where("state = '-'").withColumn("_g", F.col("pos") - F.row_number().over(w)).groupBy("taxon", "_g").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).cast("int").alias("n"))
    ref = F.lit(reference)
    # a run at the very start keeps the base after it
    dele = runs.select(
        "taxon", F.greatest(F.col("pos") - 1, F.lit(0)).alias("pos"), (F.col("n") + 1).alias("n"),
        F.when(F.col("pos") > 0, F.substring(ref, F.col("pos"), F.lit(1))).otherwise(F.substring(ref, F.col("n") + 1, F.lit(1))).alias("alt"),
    )
    calls = snp.unionByName(dele).groupBy("pos", "n").agg(F.array_sort(F.collect_set("alt")).alias("alts"), F.map_from_entries(F.collect_list(F.struct("taxon", "alt"))).alias("m"))
    gt = F.array_join(F.transform("names", lambda s: F.coalesce(F.array_position("alts", F.try_element_at("m", s)), F.lit(0)).cast("string")), "\t")
    text = F.concat_ws("\t", F.lit(chrom), (F.col("pos") + 1).cast("string"), F.lit("."), F.substring(ref, F.col("pos") + 1, F.col("n")), F.array_join("alts", ","), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), gt)
    body = calls.crossJoin(F.broadcast(names)).select((F.col("pos") + 1).cast("bigint").alias("key"), "n", text.alias("value"))
    key = lambda k: [F.lit(k).cast("bigint").alias("key"), F.lit(0).alias("n")]
    version = names.select(*key(-1), F.lit("##fileformat=VCFv4.3").alias("value"))
    columns = F.array(*[F.lit(c) for c in ("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")])
    return version.unionByName(names.select(*key(0), F.array_join(F.concat(columns, "names"), "\t").alias("value"))).unionByName(body)


def write_vcf(variants: DataFrame, samples: DataFrame, reference: str, path: str, chrom: str = "1") -> None:
    vcf_lines(variants, samples, reference, chrom).orderBy("key", "n").select("value").write.mode("overwrite").text(path)


def _given(extra: dict, column: str, node) -> object | None:
    """An attribute of a node; None where it is missing."""
    v = extra[column].get(node) if column in extra else None
    return None if v is None or (isinstance(v, float) and v != v) else v


def _nested(t, extra: dict) -> dict:
    """Nodes of a tree inside one another: name, divergence, attributes, and mutations on the branch.

    date becomes num_date, with lower and upper as its confidence; bad_branch Yes or No;
    mutations (a list of texts) go to branch_attrs, with the support that their number gives.
    """
    made: dict = {}
    depth = t.depth()
    for i in t.postorder:
        get = lambda c, n=t.ids[i]: _given(extra, c, n)
        attrs: dict = {"div": round(float(depth[i]), 9)}
        for c in extra:
            if c not in ("date", "lower", "upper", "mutations", "bad_branch") and get(c) is not None:
                attrs[c] = {"value": get(c)}
        if get("date") is not None:
            attrs["num_date"] = {"value": round(float(get("date")), 6)}
            if get("lower") is not None:
                attrs["num_date"]["confidence"] = [round(float(get("lower")), 6), round(float(get("upper")), 6)]
        if get("bad_branch") is not None:
            attrs["bad_branch"] = {"value": "Yes" if get("bad_branch") else "No"}
        made[i] = {"name": t.name[i], "node_attrs": attrs}
        if get("mutations") is not None:
            muts = list(get("mutations"))
            made[i]["branch_attrs"] = {"mutations": {"nuc": muts}}
            attrs["bootstrap"] = {"value": pseudo_bootstrap(len(muts))}
        if t.children[i]:
            made[i]["children"] = [made.pop(c) for c in t.children[i]]
    return made[0]


def tree_texts(nodes: DataFrame, kind: str = "newick", attributes: list[str] = ()) -> DataFrame:
    """tree_id, text: newick, nexus (attributes as comments) or nested JSON per tree."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        extra = {c: dict(zip(p["node_id"], p[c])) for c in attributes}
        for t in _trees(p):
            if kind == "json":
                out.append((p["tree_id"].iloc[0], json.dumps({"version": "v2", "meta": {}, "tree": _nested(t, extra)}, default=str, ensure_ascii=False)))
                continue
            if kind == "nexus":
                plain = list(t.name)
                text: dict = {}
                for i in t.postorder:
                    a = ",".join(f'{c}="{_shown(_given(extra, c, t.ids[i]))}"' for c in attributes if _given(extra, c, t.ids[i]) is not None)
                    inner = "(" + ",".join(text.pop(c) for c in t.children[i]) + ")" if t.children[i] else ""
                    text[i] = f"{inner}{plain[i] or ''}:{t.length[i]:.10g}" + (f"[&{a}]" if a else "")
                names = " ".join(str(plain[i]) for i in t.tips)
                out.append((p["tree_id"].iloc[0], f"#NEXUS\nBegin Taxa;\n Dimensions NTax={len(t.tips)};\n TaxLabels {names};\nEnd;\nBegin Trees;\n Tree tree1={text[0]};\nEnd;\n"))
                continue
            out.append((p["tree_id"].iloc[0], t.newick()))
        return pd.DataFrame(out, columns=["tree_id", "text"])

    return spread(nodes.select(*NODE_COLUMNS, *attributes), "tree_id").groupBy("tree_id").applyInPandas(run, "tree_id string, text string")


def _shown(v) -> str:
    return ",".join(map(str, v)) if hasattr(v, "__len__") and not isinstance(v, str) else f"{v:.6f}" if isinstance(v, float) else str(v)


def pseudo_bootstrap(n_mutations: int) -> float:
    return round(1 - math.exp(-n_mutations), 3)
