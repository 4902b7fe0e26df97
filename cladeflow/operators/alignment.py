"""Alignments: letters by site, column patterns, differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.functions import sequences as S
from cladeflow.kernels.pairwise import into_columns
from cladeflow.runtime import dimension_join, materialize, spread


def clean_alignment(aln: DataFrame, overhangs: bool = True) -> DataFrame:
    """One sequence per (tree_id, taxon): the one of the smallest aln_id that has letters; terminal gaps become N."""
    seq = S.clean(F.col("seq"))
    c = aln.select("tree_id", "taxon", "aln_id", seq.alias("seq")).where("taxon is not null and length(seq) > 0")
    one = c.groupBy("tree_id", "taxon").agg(F.min_by("seq", "aln_id").alias("seq"))
    return one.withColumn("seq", S.fill_overhangs(F.col("seq"))) if overhangs else one


def composition(aln: DataFrame, by: list[str]) -> DataFrame:
    """Number of each letter; counted per sequence before the shuffle."""
    letters = aln.select(*by, F.explode(S.states(F.col("seq"))).alias("state"))
    return letters.groupBy(*by, "state").agg(F.count(F.lit(1)).alias("n"))


def alphabet_guess(aln: DataFrame, by: list[str]) -> DataFrame:
    """nuc if more than 90 % of the letters are of A C G T - N, else aa."""
    g = aln.groupBy(*by).agg(F.sum(S.nucleotide_letters(F.col("seq"))).alias("n_nuc"), F.sum(F.length("seq")).alias("n_all"))
    return g.withColumn("alphabet", F.when(F.col("n_nuc") > 0.9 * F.col("n_all"), "nuc").otherwise("aa"))


def site_letters(aln: DataFrame) -> DataFrame:
    """tree_id, n_sites, taxon, pos (from 0), state of all sequences; columns belong to the sequences of one tree and length."""
    return aln.select("tree_id", F.length("seq").alias("n_sites"), "taxon", F.posexplode(S.states(F.col("seq"))).alias("pos", "state"))


def usual_lengths(aln: DataFrame) -> DataFrame:
    """tree_id, total, n_other: the most common length of a tree's sequences, the greatest of equals, and how many have another."""
    n = aln.groupBy("tree_id", F.length("seq").alias("_len")).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy("tree_id").agg(F.max(F.struct("_n", "_len")).alias("x"), F.sum("_n").alias("_all")).select("tree_id", F.col("x._len").alias("total"), (F.col("_all") - F.col("x._n")).alias("n_other"))


def _into(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["ref"].str.len()
            fit = b["seq"].str.len().between(size / 2, 2 * size).to_numpy()
            found = [("", 0, 0.0)] * len(b)
            for k, x in zip(np.flatnonzero(fit), into_columns(b["ref"][fit].tolist(), b["seq"][fit].tolist())):
                found[k] = x
            yield pd.DataFrame(
                {
                    "tree_id": b["tree_id"], "taxon": b["taxon"], "seq": [x[0] if x[2] >= least else None for x in found],
                    "status": ["aligned" if x[2] >= least else "left out" for x in found], "n_inserted": [x[1] for x in found], "identity": [x[2] for x in found],
                }
            ).astype({"n_inserted": "int32"})

    return run


def _letter_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for tree, g in b.groupby("tree_id", sort=False)["seq"]:
            rows = max(1, 4_000_000 // max(1, len(g.iloc[0])))
            for at in range(0, len(g), rows):
                some = g.iloc[at : at + rows]
                x = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).reshape(len(some), -1)
                out += [(tree, int(c), (x == c).sum(axis=0)) for c in np.unique(x)]
        yield pd.DataFrame(out, columns=["tree_id", "state", "n"])


def _most_frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def top(seen: dict[int, np.ndarray]) -> str:
        # N and - only where no other letter is; of equally frequent letters the first
        codes = sorted(seen)
        n = np.stack([seen[c] for c in codes])
        sure = n * np.array([chr(c) not in "N-" for c in codes])[:, None]
        n = np.where(sure.any(axis=0), sure, n)
        return "".join(np.array([chr(c) for c in codes])[n.argmax(axis=0)])

    tree, seen = None, {}
    for b in batches:
        out = []
        for t, c, n in zip(b["tree_id"], b["state"], b["n"]):
            if t != tree and seen:
                out.append((tree, top(seen)))
                seen = {}
            tree = t
            seen[c] = seen.get(c, 0) + np.asarray(n, np.int64)
        yield pd.DataFrame(out, columns=["tree_id", "ref"])
    if seen:
        yield pd.DataFrame([(tree, top(seen))], columns=["tree_id", "ref"])


def references(aln: DataFrame) -> DataFrame:
    """tree_id, ref: the most frequent letter of each column of sequences (tree_id, taxon, seq) that are equally long in a tree; N and - only where there is no other.

    Letters are counted per batch of sequences, so that a tree's rows may be in several tasks.
    """
    part = F.pmod(F.xxhash64("taxon"), F.lit(16))
    big = aln.groupBy("tree_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 20000").select("tree_id", F.lit(True).alias("_big"))
    split = dimension_join(aln, materialize(big, "big"), ["tree_id"], "taxon").withColumn("_part", F.when(F.col("_big"), part).otherwise(F.lit(0)))
    n = spread(split, "tree_id", "_part").sortWithinPartitions("tree_id").select("tree_id", "seq").mapInPandas(_letter_counts, "tree_id string, state int, n array<bigint>")
    return spread(n, "tree_id").sortWithinPartitions("tree_id").mapInPandas(_most_frequent, "tree_id string, ref string")


def tree_columns(aln: DataFrame, least: float = 0.5) -> DataFrame:
    """Every sequence in the columns of its tree: tree_id, taxon, seq, status, n_inserted, identity.

    A tree's columns are those of its most common length, and its reference the most frequent
    letter of each. Sequences of that length stay as they are (status as is). Others are aligned
    to the reference: gaps where they lack letters, N beyond their ends; letters without a
    column are left out of seq and counted in n_inserted. Where fewer than the share ``least``
    of letters are equal to the reference, or the length is less than half or more than twice
    that of the reference, the sequence cannot be placed: status left out, seq is null.
    """
    aln = materialize(aln.select("tree_id", "taxon", "seq"), "aln")  # read five times below
    usual = materialize(usual_lengths(aln), "usual")
    sized = dimension_join(aln, usual, ["tree_id"], "taxon", "inner")
    fit = sized.where(F.length("seq") == F.col("total"))
    ref = references(fit.select("tree_id", "taxon", "seq"))
    ref = materialize(ref, "references")
    # many of one tree are aligned at once, but no more than some hundreds in one task
    part = F.pmod(F.xxhash64("taxon"), F.ceil(F.col("n_other") / 300)).alias("part")
    other = sized.where(F.length("seq") != F.col("total")).select("tree_id", "taxon", "seq", part)
    other = spread(dimension_join(other, ref, ["tree_id"], "taxon", "inner"), "tree_id", "part").sortWithinPartitions("tree_id", "part")
    put = other.mapInPandas(_into(least), "tree_id string, taxon string, seq string, status string, n_inserted int, identity double")
    same = fit.select("tree_id", "taxon", "seq", F.lit("as is").alias("status"), F.lit(0).alias("n_inserted"), F.lit(None).cast("double").alias("identity"))
    return materialize(same.unionByName(put), "columns")


def column_patterns(letters: DataFrame) -> DataFrame:
    """tree_id, n_sites, pattern, variable, multiplicity, first_pos: equal constant columns merge, variable ones stay apart.

    The pattern of a column lists its letters by taxon; a column whose only ambiguous letters
    stand beside one state counts as constant.
    """
    by = ["tree_id", "n_sites"]
    col = letters.groupBy(*by, "pos").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("taxon", "state"))), lambda x: x["state"]), "").alias("pattern"),
        F.array_sort(F.collect_set(F.when(F.col("state") != "N", F.col("state")))).alias("_s"),
    )
    variable = F.size("_s") > 1
    shown = F.when(variable, F.col("pattern")).otherwise(F.repeat(F.coalesce(F.get("_s", F.lit(0)), F.lit("N")), F.length("pattern")))
    key = col.select(*by, "pos", shown.alias("pattern"), variable.alias("variable"), F.when(variable, F.col("pos")).alias("_own"))
    return key.groupBy(*by, "pattern", "variable", "_own").agg(F.count(F.lit(1)).alias("multiplicity"), F.min("pos").alias("first_pos")).drop("_own")


def with_constant_sites(patterns: DataFrame, full_length: int) -> DataFrame:
    """column_patterns with the sites that the alignment lacks up to full_length, given to the constant letters in proportion.

    Only constant columns of A, C, G or T take part; without any, all four letters would have
    equal shares, which no pattern can hold, so multiplicities stay.
    """
    letter = F.substring("pattern", 1, 1)
    constant = ~F.col("variable") & letter.isin("A", "C", "G", "T")
    w = Window.partitionBy("tree_id", "n_sites")
    extra = F.greatest(F.lit(full_length) - F.col("n_sites"), F.lit(0))
    share = F.when(constant, F.col("multiplicity") / F.sum(F.when(constant, F.col("multiplicity"))).over(w)).otherwise(0.0)
    return patterns.withColumn("multiplicity", F.col("multiplicity") + extra * F.coalesce(share, F.lit(0.0)))


def differences(letters: DataFrame, reference: DataFrame) -> DataFrame:
    """Sites at which a sequence differs from its tree's reference: tree_id, taxon, ref, pos, state."""
    r = reference.select("tree_id", "n_sites", "pos", F.col("state").alias("ref"))
    return letters.join(r, ["tree_id", "n_sites", "pos"]).where("state <> ref").select("tree_id", "taxon", "ref", "pos", "state")


def sparse_differences(a: DataFrame, b: DataFrame, reference: DataFrame) -> DataFrame:
    """Differences of two sparse sequences (key, pos, state): full outer join, absent means reference."""
    x, y = a.withColumnRenamed("state", "state_1"), b.withColumnRenamed("state", "state_2")
    both = x.join(y, ["key", "pos"], "full_outer").join(reference.select("pos", "ref"), "pos", "left")
    out = both.select("key", "pos", F.coalesce("state_1", "ref").alias("state_1"), F.coalesce("state_2", "ref").alias("state_2"))
    return out.where("state_1 <> state_2")


def majority_reference(letters: DataFrame) -> DataFrame:
    """Most frequent letter of each site, the first of equals: tree_id, n_sites, pos, state, n."""
    n = letters.groupBy("tree_id", "n_sites", "pos", "state").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("tree_id", "n_sites", "pos").agg(F.min(F.struct((-F.col("n")).alias("m"), "state")).alias("x"))
    return best.select("tree_id", "n_sites", "pos", "x.state", (-F.col("x.m")).alias("n"))


def distances(letters_wide: DataFrame, pairs: DataFrame) -> DataFrame:
    """Differing and compared sites and Jukes-Cantor distance of given pairs (tree_id, taxon_1, taxon_2) of equal length."""
    s1 = letters_wide.select("tree_id", F.col("taxon").alias("taxon_1"), F.col("seq").alias("_s1"))
    s2 = letters_wide.select("tree_id", F.col("taxon").alias("taxon_2"), F.col("seq").alias("_s2"))
    h = S.hamming(S.states(F.col("_s1")), S.states(F.col("_s2")))
    both = pairs.join(s1, ["tree_id", "taxon_1"]).join(s2, ["tree_id", "taxon_2"]).where(F.length("_s1") == F.length("_s2")).withColumn("h", h)
    d = F.when(F.col("h.compared") > 0, F.col("h.differ") / F.col("h.compared"))
    return both.select("tree_id", "taxon_1", "taxon_2", "h.differ", "h.compared", S.jukes_cantor(d).alias("distance"))


def sparse_positions(variants: DataFrame, n_taxa: DataFrame, by: list[str], ambiguous: str = "N") -> DataFrame:
    """Kind of each position of sparse sequences (*by, taxon, pos, state): *by, pos, kind, states, n.

    variable: two or more states occur, the reference counting where some taxon has it;
    constant: all taxa have the same other state; ambiguous: beside one state there are only
    ambiguous letters. n_taxa: *by, n_taxa.
    """
    p = variants.groupBy(*by, "pos").agg(F.array_sort(F.collect_set("state")).alias("states"), F.count(F.lit(1)).alias("n")).join(n_taxa, by)
    sure = F.filter("states", lambda s: s != ambiguous)
    seen = F.size(sure) + F.when(F.col("n") < F.col("n_taxa"), 1).otherwise(0)
    kind = F.when(seen > 1, "variable").when(F.size(sure) < F.size("states"), "ambiguous").otherwise("constant")
    return p.select(*by, "pos", kind.alias("kind"), "states", "n")


def expand_patterns(sequences: DataFrame, patterns: DataFrame) -> DataFrame:
    """Compressed letters (taxon, cpos, state) to all positions of their patterns (cpos, positions)."""
    return sequences.join(patterns.select("cpos", F.explode("positions").alias("pos")), "cpos").select("taxon", "pos", "state")
