"""Near-duplicate texts by signature trees.

A text is the set of its distinct n-letter substrings (grams). Exact copies of a set are one
class from the start. Each class representative goes, with its text at two bits a letter, to the
buckets of the ``sketch`` grams of its set that come first in a fixed pseudo-random order. In a
pair of similarity J each of the first ``sketch`` grams of the union is shared with probability
J, so a pair meets in no bucket with probability (1 - J) ** sketch at most: 1e-6 at J = 0.5 and
20 grams, less for anything more alike.

Buckets are brought together in rounds, each for some of the grams; a round's shuffle files are
removed once its links are written, so that what is on disk at a time is about a table of the
packed texts and one round.

Grams of a bucket are shared by chance as well, the more the more rows there are. So with a row
travel short marks of the grams before and after the bucket's in its order. In a bucket stay the
rows that share two of the next ``further`` grams with a row whose first common gram with them is
the bucket's (see ``_alike`` for what this can lose); this also makes every pair the matter of one
bucket. Bitmaps are made for these rows only, from their texts.

Within a bucket the rows form a signature tree: sorted so that rows with the same next grams
are neighbours, nodes hold the OR of their rows' bitmaps, the range of the set sizes and the
largest slack (grams that share a bit with another). Two nodes share at most
popcount(OR1 & OR2) + min(slack) grams, so the dual traversal drops a pair of nodes where this,
or the size ranges, can't reach the threshold. Nodes above the rows have bitmaps ``widen`` times
as long, which are folded for the rows: ORs of unlike rows fill short ones up. All buckets of a
task are traversed together, level by level, as arrays. Buckets with more rows than ``block`` are
cut into blocks, and each pair of blocks is a task of its own. Row pairs that are left are
compared exactly, in the same task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.runtime import dimension_join, is_small, materialize, release, salt_hot

_MULT = np.uint64(0x9E3779B97F4A7C15)


def clean_sequence(c: Column) -> Column:
    """Upper case, letters A-Z only, U read as T."""
    return F.translate(F.regexp_replace(F.upper(c), "[^A-Z]", ""), "U", "T")


def grams(text: str, n: int) -> np.ndarray:
    """Sorted distinct codes of the n-letter substrings of a text over A-Z (exact up to n = 13)."""
    a = np.frombuffer(text.encode("ascii"), dtype=np.uint8).astype(np.uint64) - np.uint64(65)
    if len(a) < n:
        return np.empty(0, np.uint64)
    code = np.zeros(len(a) - n + 1, np.uint64)
    for k in range(n):
        code = code * np.uint64(26) + a[k : k + len(code)]
    return np.unique(code)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit codes."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x *= _MULT
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return x


def _windows(letters: np.ndarray, lens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scrambled codes of the n-letter substrings at every place of texts (letters 0-25, one text after the other), and where each text's begin and end."""

    def codes(k: int) -> np.ndarray:
        if k == 1:
            return letters.astype(np.uint64)
        if k % 2:
            return codes(k - 1)[:-1] * np.uint64(26) + letters[k - 1 :]
        half = codes(k // 2)
        return half[: -(k // 2)] * np.uint64(26 ** (k // 2)) + half[k // 2 :]

    start, count = np.cumsum(lens) - lens, np.maximum(lens - n + 1, 0)
    if not count.any():
        return np.empty(0, np.uint64), start, start
    return mix(codes(n)), start, start + count


_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
_FOUR = np.frombuffer(b"ACGT", np.uint8)[np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3]
_RUN = np.dtype([("at", "<u4"), ("n", "<u4"), ("letter", "u1")])
_PLAIN = 0xFFFFFFFF


def pack(texts: list[str]) -> list[bytes]:
    """Texts over A-Z at two bits a letter: length, number of runs of letters other than ACGT, the letters, the runs.

    Where the runs would be longer than the text it stands as it is.
    """
    buf = np.frombuffer("".join(texts).encode("ascii"), np.uint8)
    lens = np.array([len(t) for t in texts], np.int64)
    quads = -(-lens // 4)
    at, of = np.cumsum(quads) - quads, np.repeat(np.arange(len(lens)), lens)
    code = _CODE[buf]
    two = np.zeros(4 * int(quads.sum()), np.uint8)
    two[np.arange(len(buf)) - (np.cumsum(lens) - lens)[of] + 4 * at[of]] = code & 3
    two = two.reshape(-1, 4)
    body = two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6
    odd = np.flatnonzero(code == 4)
    new = np.flatnonzero(np.r_[True, (np.diff(odd) != 1) | (np.diff(buf[odd]) != 0) | (np.diff(of[odd]) != 0)][: len(odd)])
    first = odd[new]
    runs = np.empty(len(first), _RUN)
    runs["at"], runs["n"], runs["letter"] = first - (np.cumsum(lens) - lens)[of[first]], np.diff(np.r_[new, len(odd)]), buf[first]
    n_runs = np.bincount(of[first], minlength=len(lens))
    upto = np.cumsum(n_runs)
    out = []
    for t, n, r, u, a, q in zip(texts, lens.tolist(), n_runs.tolist(), upto.tolist(), at.tolist(), quads.tolist()):
        if r * _RUN.itemsize > n - q:
            out.append(struct.pack("<II", n, _PLAIN) + t.encode("ascii"))
        else:
            out.append(struct.pack("<II", n, r) + body[a : a + q].tobytes() + runs[u - r : u].tobytes())
    return out


def unpack(packs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The letters (ASCII) of packed texts, one text after the other, and their lengths."""
    head = np.frombuffer(b"".join(p[:8] for p in packs), "<u4").reshape(-1, 2).astype(np.int64)
    lens, n_runs = head[:, 0], head[:, 1]
    quads = -(-lens // 4)
    body = b"".join(p[8 : 8 + q].ljust(q, b"\0") for p, q in zip(packs, quads.tolist()))
    four = _FOUR[np.frombuffer(body, np.uint8)].ravel()
    at = 4 * (np.cumsum(quads) - quads)
    letters = four[_spread(at, at + lens)[0]]
    start = np.cumsum(lens) - lens
    for k in np.flatnonzero(n_runs).tolist():
        s = int(start[k])
        if n_runs[k] == _PLAIN:
            letters[s : s + lens[k]] = np.frombuffer(packs[k], np.uint8, offset=8)
        else:
            for a, n, letter in np.frombuffer(packs[k], _RUN, offset=8 + int(quads[k])).tolist():
                letters[s + a : s + a + n] = letter
    return letters, lens


def _cuts(weights: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Neighbouring items in ranges of at most about ``most`` weight."""
    upto = np.cumsum(weights)
    ends = np.unique(np.r_[np.flatnonzero(np.diff(upto // most)) + 1, len(weights)]).tolist()
    return [(a, b) for a, b in zip([0, *ends[:-1]], ends) if b > a]


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def _grams_of(packs: list[bytes], n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, and their _windows) for ranges of packed rows, some 400,000 letters at a time."""
    for a, b in _cuts(4 * np.array([len(p) for p in packs], np.int64), 400_000):
        letters, lens = unpack(packs[a:b])
        yield a, b, *_windows(letters - np.uint8(65), lens, n)


def _sets(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[np.ndarray]:
    """Every row's sorted distinct scrambled grams."""
    for x, y in zip(start.tolist(), end.tolist()):
        yield _distinct(h[x:y])


def _sets_of(packs: list[bytes], n: int) -> Iterator[np.ndarray]:
    for _, _, h, start, end in _grams_of(packs, n):
        yield from _sets(h, start, end)


def _packed(n: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            b = b[b["text"].str.len() >= least]
            texts = b["text"].tolist()
            for x, y in _cuts(np.array([len(t) for t in texts], np.int64), 400_000):
                letters = np.frombuffer("".join(texts[x:y]).encode("ascii"), np.uint8) - np.uint8(65)
                h, start, end = _windows(letters, np.array([len(t) for t in texts[x:y]], np.int64), n)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in _sets(h, start, end)]
                out = {"id": b["id"].to_numpy()[x:y], "digest": digests, "windows": (end - start).astype(np.int32), "packed": pack(texts[x:y])}
                yield pd.DataFrame(out)

    return run


def _sketches(n: int, sketch: int, further: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes, tokens, leads, marks = [], [], [], []
            for s in _sets_of(b["packed"].tolist(), n):
                first = s[:sketch].astype("<u4")
                sizes.append(len(s))
                tokens.append(first.view(np.int32))
                leads.append(first.tobytes())
                marks.append(s[: sketch + further].astype("<u2").tobytes())
            out = {"id": b["id"], "size": sizes, "tokens": tokens, "leads": leads, "marks": marks, "packed": b["packed"]}
            yield pd.DataFrame(out).astype({"size": "int32"})

    return run


def _bitmaps(packs: list[bytes], n: int, bits: int) -> np.ndarray:
    out = np.empty((len(packs), bits // 64), np.uint64)
    for a, b, h, start, end in _grams_of(packs, n):
        rows = max(1, 16_000_000 // bits)
        for x in range(0, b - a, rows):
            y = min(x + rows, b - a)
            flags = np.zeros((y - x, bits), bool)
            at, of = _spread(start[x:y], end[x:y])
            flags[of, (h[at] & np.uint64(bits - 1)).astype(np.int64)] = True
            out[a + x : a + y] = np.packbits(flags, axis=1, bitorder="little").view(np.uint64)
    return out


def _table(column: pa.ChunkedArray, width: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as the rows of a table of numbers, and how many each has."""
    column = pa.concat_arrays(column.cast(pa.large_binary()).chunks or [pa.array([], pa.large_binary())])
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    lens = np.diff(ends) // np.dtype(kind).itemsize
    out = np.zeros((len(lens), width), kind)
    out[np.arange(width) < lens[:, None]] = data.view(kind)
    return out, lens


def _lead_table(column: pa.ChunkedArray, sketch: int) -> np.ndarray:
    """The grams of rows that come before their bucket's, by 32 bits; -1 where there are no more."""
    out, lens = _table(column, sketch, "<u4")
    out = out.astype(np.int64)
    out[np.arange(sketch) >= lens[:, None]] = -1
    return out


def _first_here(leads: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pairs of rows of a bucket have no common gram before the bucket's: they are decided in this one only."""
    here = np.zeros(len(i), bool)
    for s in range(0, len(i), 20_000):
        x, y = leads[i[s : s + 20_000]], leads[j[s : s + 20_000]]
        wide = max(1, int((x >= 0).sum(axis=1).max()))
        common = np.zeros(len(x), bool)
        for k in range(wide):
            common |= ((y == x[:, k, None]) & (y >= 0)).any(axis=1)
        here[s : s + 20_000] = ~common
    return here


def _alike(group: np.ndarray, marks: np.ndarray, short: np.ndarray, leads: np.ndarray, cap: int = 100) -> np.ndarray:
    """Rows that share at least two of the further grams after their bucket's gram with a row that first meets them in this bucket.

    group: sorted bucket numbers. Of the next 30 grams of the union of a pair of similarity J each is
    shared with probability J, and a shared one is among the next 30 of either row: fewer than two
    are with probability 3e-8 at J = 0.5. Grams stand here by 16 bits, so that some rows stay that
    don't share them. Buckets with a row that has no so many grams left, and buckets in which rows
    share more than ``cap`` marks on average, stay whole.
    leads: 32 bits of the grams before the bucket's; two unlike ones are taken for the same with
    probability 2e-10 for each pair of them, and a pair has few before its first common gram.
    """
    keep = np.zeros(len(group), bool)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    counts = np.diff(np.r_[starts, len(group)])
    whole = np.logical_or.reduceat(short, starts)
    keep |= np.repeat(whole, counts)
    for a, b in _cuts(counts, 50_000):
        left, right = starts[a], starts[b - 1] + counts[b - 1]
        at = np.arange(left, right)[~keep[left:right]]
        if len(at) == 0:
            continue
        _, local = np.unique(group[at], return_inverse=True)
        mark = marks[at].astype(np.uint64)
        rows = np.arange(len(at), dtype=np.uint64)
        key = np.sort(((local.astype(np.uint64) << np.uint64(44))[:, None] | mark << np.uint64(28) | rows[:, None]).ravel())
        of, row = key >> np.uint64(28), (key & np.uint64((1 << 28) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        n = np.diff(np.r_[first, len(of)])
        first, n = first[n > 1], n[n > 1]
        run_group = local[row[first]]
        listed = np.bincount(run_group, weights=n * (n - 1) // 2, minlength=local[-1] + 1) <= cap * np.bincount(local)
        keep[at[~listed[local]]] = True
        first, n = first[listed[run_group]], n[listed[run_group]]
        i, in_run = _spread(first, first + n)
        j, of = _spread(i + 1, (first + n)[in_run])
        i, j = row[i[of]], row[j]
        pair = np.sort((i << 28 | j)[i != j])
        twice = np.unique(pair[1:][pair[1:] == pair[:-1]])
        i, j = at[twice >> 28], at[twice & ((1 << 28) - 1)]
        here = _first_here(leads, i, j)
        keep[i[here]] = True
        keep[j[here]] = True
    return keep


def _folded(bitmaps: np.ndarray, times: int) -> np.ndarray:
    """Bitmaps a ``times``-th as long: the position of a gram is taken modulo the shorter length."""
    return np.bitwise_or.reduce(bitmaps.reshape(len(bitmaps), times, -1), axis=1)


def _build(groups: np.ndarray, bitmaps: np.ndarray, sizes: np.ndarray, fan: int, fold: int = 1) -> list[dict]:
    """Levels of the signature trees of all groups (sorted ids); level 0 holds the rows, with folded bitmaps."""
    slack = lambda b: sizes - np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    short = _folded(bitmaps, fold)
    levels = [{"or": short, "lo": sizes, "hi": sizes, "slack": slack(short), "group": groups}]
    low = {"or": bitmaps, "lo": sizes, "hi": sizes, "slack": slack(bitmaps), "group": groups}
    while True:
        g = low["group"]
        start = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1]
        count = np.diff(np.r_[start, len(g)])
        if len(levels) > 1 and (count == 1).all():
            return levels
        parts = -(-count // fan)
        of = np.repeat(np.arange(len(start)), parts)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = start[of] + within * fan
        low = (
            {
                "or": np.bitwise_or.reduceat(low["or"], first, axis=0),
                "lo": np.minimum.reduceat(low["lo"], first),
                "hi": np.maximum.reduceat(low["hi"], first),
                "slack": np.maximum.reduceat(low["slack"], first),
                "group": g[first],
                "first": first,
                "last": np.r_[first[1:], len(g)],
            }
        )
        levels.append(low)


def _keep(a: dict, i: np.ndarray, b: dict, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether node pairs can hold a pair with shared / union >= num / den."""
    lo1, hi1, lo2, hi2 = a["lo"][i], a["hi"][i], b["lo"][j], b["hi"][j]
    ok = (hi1 * den >= lo2 * num) & (hi2 * den >= lo1 * num)
    at = np.flatnonzero(ok)
    for s in range(0, len(at), 65536):
        k = at[s : s + 65536]
        shared = np.bitwise_count(a["or"][i[k]] & b["or"][j[k]]).sum(axis=1, dtype=np.int64) + np.minimum(a["slack"][i[k]], b["slack"][j[k]])
        shared = np.minimum(shared, np.minimum(hi1[k], hi2[k]))
        # shared / (|A| + |B| - shared) >= num / den
        ok[k] = shared * (num + den) >= (lo1[k] + lo2[k]) * num
    return ok


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of ranges, and the range each is from."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[of], of


def _dual(a: list[dict], b: list[dict] | None, num: int, den: int, most_pairs: int = 4_000_000, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of the same group left by the dual traversal of trees a and b (None: a with itself).

    Groups are traversed together as long as they hold at most about most_pairs row pairs. seen:
    gets the node pairs compared and dropped per level, level 0 being the rows.
    """
    own = b is None
    b = a if own else b
    top = max(len(a), len(b))
    for t in (a, b):
        while len(t) < top:  # a single-row group's tree has no further levels
            low = t[-1]
            n = np.arange(len(low["group"]))
            t.append({k: v for k, v in low.items() if k not in ("first", "last")} | {"first": n, "last": n + 1})
    x, y = a[-1], b[-1]
    # at the top there is one node for each group
    i, j = np.flatnonzero(np.isin(x["group"], y["group"])), np.flatnonzero(np.isin(y["group"], x["group"]))
    rows = [np.diff(np.r_[np.searchsorted(t[0]["group"], t[-1]["group"]), len(t[0]["group"])]) for t in (a, b)]
    work = np.cumsum(rows[0][i].astype(np.int64) * rows[1][j])
    found = []
    for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(work // most_pairs)) + 1):
        found.append(_descend(a, b, i[part], j[part], own, num, den, seen))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _descend(a: list[dict], b: list[dict], i: np.ndarray, j: np.ndarray, own: bool, num: int, den: int, seen: dict | None) -> tuple[np.ndarray, np.ndarray]:
    def count(level: int, keep: np.ndarray, other: np.ndarray) -> None:
        if seen is not None:
            was = seen.get(level, (0, 0))
            seen[level] = (was[0] + int(other.sum()), was[1] + int((other & ~keep).sum()))

    for level in range(len(a) - 1, 0, -1):
        # a node and itself cannot be dropped
        keep = _keep(a[level], i, b[level], j, num, den)
        count(level, keep, (i != j) if own else np.ones(len(i), bool))
        if own:
            keep |= i == j
        i, j = i[keep], j[keep]
        ci, of = _spread(a[level]["first"][i], a[level]["last"][i])
        j = j[of]
        cj, of = _spread(b[level]["first"][j], b[level]["last"][j])
        i, j = ci[of], cj
        if own:
            up = i <= j
            i, j = i[up], j[up]
    if own:
        i, j = i[i < j], j[i < j]
    keep = _keep(a[0], i, b[0], j, num, den)
    count(0, keep, np.ones(len(i), bool))
    return i[keep], j[keep]


def _tree(rows: pd.DataFrame, bitmaps: np.ndarray, fan: int, fold: int) -> tuple[np.ndarray, list[dict]]:
    """(places of the rows, signature tree) of rows with the columns group, size, marks and id."""
    # like rows are neighbours: by the grams that come next, then by size
    lead = np.frombuffer(b"".join(m[:8].ljust(8, b"\0") for m in rows["marks"]), "<u2").reshape(-1, 4)
    size, group = rows["size"].to_numpy().astype(np.int64), rows["group"].to_numpy()
    order = np.lexsort((rows["id"].to_numpy(), size, lead[:, 3], lead[:, 2], lead[:, 1], lead[:, 0], group))
    return order, _build(group[order], bitmaps[order], size[order], fan, fold)


def _linked(one: pd.DataFrame, two: pd.DataFrame | None, n: int, num: int, den: int, sketch: int, bits: int, fan: int, fold: int) -> pd.DataFrame:
    """Links between rows of the same group, of one table or of two: left by the trees, in the bucket of their first common gram, and exact."""
    p, tree = _tree(one, _bitmaps(one["packed"].tolist(), n, bits), fan, fold)
    q, other = (p, None) if two is None else _tree(two, _bitmaps(two["packed"].tolist(), n, bits), fan, fold)
    i, j = _dual(tree, other, num, den)
    del tree, other
    rows, i, j = (one, p[i], q[j]) if two is None else (pd.concat([one, two], ignore_index=True), p[i], q[j] + len(one))
    ids, packs = rows["id"].to_numpy(), rows["packed"].tolist()
    # a pair that meets in several buckets is decided in that of its first common gram
    here = _first_here(_lead_table(pa.chunked_array([pa.array(rows["leads"], pa.large_binary())]), sketch), i, j)
    i, j = i[here], j[here]
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    shared, union = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    # of so many pairs at a time that their rows' grams take some 100 MB
    weight = np.array([len(x) for x in packs], np.int64)
    for a, b in _cuts(4 * (weight[i] + weight[j]), 10_000_000):
        used, at = np.unique(np.r_[i[a:b], j[a:b]], return_inverse=True)
        held = list(_sets_of([packs[u] for u in used.tolist()], n))
        for k, (x, y) in enumerate(zip(at[: b - a].tolist(), at[b - a :].tolist()), a):
            both = np.sort(np.concatenate((held[x], held[y])), kind="stable")
            shared[k] = np.count_nonzero(both[1:] == both[:-1])
            union[k] = len(both) - shared[k]
    ok = shared * den >= union * num
    a, b = ids[i[ok]], ids[j[ok]]
    out = pd.DataFrame({"id_1": np.minimum(a, b), "id_2": np.maximum(a, b), "similarity": shared[ok] / np.maximum(union[ok], 1)})
    # two grams of a row may have the same 32 bits, so that it is in the bucket twice
    return out[out["id_1"] < out["id_2"]].drop_duplicates()


def _met(n: int, num: int, den: int, sketch: int, further: int, bits: int, fan: int, fold: int):
    """Links of all buckets of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        every = pa.Table.from_batches(batches)
        token = every["token"].to_numpy()
        order = np.argsort(token, kind="stable")
        token = token[order]
        same = token[1:] == token[:-1]
        order = order[np.r_[False, same] | np.r_[same, False]]
        if len(order) == 0:
            return
        rows = every.select(["token", "marks", "leads"]).take(order)
        token = rows["token"].to_numpy()
        group = np.cumsum(np.r_[0, token[1:] != token[:-1]])
        marks, lens = _table(rows["marks"], further, "<u2")
        keep = np.flatnonzero(_alike(group, marks, lens < further, _lead_table(rows["leads"], sketch)))
        if len(keep) == 0:
            return
        rows = every.take(order[keep]).to_pandas()
        rows["group"] = group = group[keep]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        counts = np.diff(np.r_[starts, len(group)])
        for a, b in _cuts(counts * (bits // 8), 16_000_000):
            links = _linked(rows.iloc[starts[a] : starts[b - 1] + counts[b - 1]].reset_index(drop=True), None, n, num, den, sketch, bits, fan, fold)
            yield pa.RecordBatch.from_pandas(links, preserve_index=False)

    return run


def _met_blocks(n: int, num: int, den: int, sketch: int, bits: int, fan: int, fold: int):
    """Links of a pair of blocks of a hot bucket, or of a block with itself."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["group"] = 0
        one, two = (x.reset_index(drop=True) for _, x in ((s, pdf[(pdf["side"] == 2) == s]) for s in (False, True)))
        if len(one) == 0 or (len(two) == 0 and pdf["two_sided"].iloc[0]):
            return pd.DataFrame({"id_1": np.empty(0, np.int64), "id_2": np.empty(0, np.int64), "similarity": np.empty(0)})
        return _linked(one, two if len(two) else None, n, num, den, sketch, bits, fan, fold)

    return run


def near_duplicates(
    df: DataFrame,
    id_col: str,
    text_col: str,
    n: int = 12,
    threshold: tuple[int, int] = (1, 2),
    min_letters: int = 100,
    sketch: int = 20,
    bits: int | None = None,
    shard_rows: int = 20_000,
    block: int = 2_000,
    fan: int = 2,
    widen: int = 4,
    further: int = 30,
    round_bytes: int = 256_000_000,
    most_rounds: int = 12,
) -> tuple[DataFrame, DataFrame]:
    """(links, members): links between class representatives, and the class of every row.

    links: id_1, id_2 (id_1 < id_2, both representatives), similarity. members: id, class_id (the
    smallest id with the same set of grams), one row per text with at least min_letters clean
    letters; null, empty and shorter texts are not compared and have no class. Rows with a null
    id are ignored, a repeated id counts once (its greatest text). Further columns are ignored;
    an empty df gives empty tables. threshold is the least shared / union as a fraction.
    bits: length of the rows' bitmaps; None: the power of two at or above 1.5 times the mean number
    of substrings. Inner nodes have bitmaps of widen (a power of two) times that length.
    Buckets are dealt to rounds of about round_bytes shuffled bytes, at most most_rounds of them.
    """
    num, den = threshold
    spark = df.sparkSession
    sent = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    # only repeated ids need their texts brought together
    repeated = materialize(sent.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id"), "repeated", keep_shuffles=False)
    # rows with too few letters are left out after this, where the text is clean once
    clean = sent.where("text is not null").withColumn("text", clean_sequence(F.col("text")))
    if not repeated.isEmpty():
        few = F.broadcast(repeated) if is_small(repeated) else repeated
        again = clean.where(F.length("text") >= max(min_letters, n)).join(few, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
        clean = clean.join(few, "id", "left_anti").unionByName(again)
    every = materialize(clean.mapInPandas(_packed(n, max(min_letters, n)), "id bigint, digest binary, windows int, packed binary"), "packed", keep_shuffles=False)
    facts = every.agg(F.avg("windows").alias("m"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("packed")), F.lit(0)).alias("b")).first()
    if bits is None:
        bits = 1 << max(8, int(np.ceil(np.log2(1.5 * (facts["m"] or 1)))))
    classes = every.groupBy("digest").agg(F.min("id").alias("class_id"))
    left, right, by = salt_hot(every.select("id", "digest"), classes, ["digest"], "id")
    members = materialize(left.join(right, by).select("id", "class_id"), "members", keep_shuffles=False)
    copies = members.where("id <> class_id").select("id")
    copies = F.broadcast(copies) if is_small(copies) else copies
    kinds = "id bigint, size int, tokens array<int>, leads binary, marks binary, packed binary"
    sig = every.select("id", "packed").join(copies, "id", "left_anti").mapInPandas(_sketches(n, sketch, further), kinds)
    sig = materialize(sig, "signatures", keep_shuffles=False)
    release(every)
    # each round brings together the rows of some of the grams, and leaves no more than its links
    sent_bytes = sketch * (facts["b"] + (2 * further + 2 * sketch + 40) * facts["n"])
    rounds = max(1, min(most_rounds, -(-sent_bytes // round_bytes)))
    shards = max(8, int(facts["n"] * sketch / rounds / shard_rows) + 1)
    # hot buckets, estimated from some of the rows: one that is missed is one task's, but whole
    rate = max(1, min(32, block // 16))
    some = sig.where(F.pmod(F.xxhash64("id"), F.lit(rate)) == 0) if facts["n"] > block else sig.limit(0)
    hot = some.select(F.explode("tokens").alias("token")).groupBy("token").agg((F.count(F.lit(1)) * rate).alias("c")).where(F.col("c") > block)
    hot = materialize(hot, "hot_buckets", keep_shuffles=False)
    any_hot = not hot.isEmpty()
    result, found = "id_1 bigint, id_2 bigint, similarity double", []
    for r in range(rounds):
        at = sig.select("id", "size", "packed", "leads", "marks", F.posexplode("tokens").alias("p", "token")).where(F.pmod("token", F.lit(rounds)) == r)
        at = at.withColumn("marks", F.expr(f"substring(marks, 2 * p + 3, {2 * further})")).withColumn("leads", F.expr("substring(leads, 1, 4 * p)")).drop("p")
        if any_hot:
            at = dimension_join(at, hot, ["token"], "id")
            plain = at.where("c is null").drop("c")
        else:
            plain = at
        links = plain.repartition(shards, "token").mapInArrow(_met(n, num, den, sketch, further, bits * widen, fan, widen), result)
        if any_hot:
            # a hot bucket: its blocks are paired, and each row goes to the pairs of its block
            blocks = F.ceil(F.col("c") / F.lit(float(block))).cast("int")
            mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
            paired = at.where("c is not null").withColumn("blocks", blocks).withColumn("mine", mine)
            paired = paired.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            paired = paired.select(
                F.concat_ws("/", "token", F.least("mine", "other"), F.greatest("mine", "other")).alias("shard"),
                "id", "size", "packed", "leads", "marks", "token",
                F.when(F.col("mine") > F.col("other"), 2).otherwise(1).alias("side"),
                (F.col("mine") != F.col("other")).alias("two_sided"),
            )
            links = links.unionByName(paired.groupBy("shard").applyInPandas(_met_blocks(n, num, den, sketch, bits * widen, fan, widen), result))
        found.append(materialize(links, "links", keep_shuffles=False))
    release(sig)
    return spark.read.schema(found[0].schema).parquet(*[f._cladeflow_path for f in found]), members


def all_pairs(links: DataFrame, members: DataFrame, expand_up_to: int = 1_000) -> DataFrame:
    """Pairs of rows (id_1 < id_2): the links with their classes expanded, and the pairs within a class.

    A class of more than expand_up_to exact copies is not expanded into all pairs: each copy is
    paired with the representative, and links of the class are those of its representative.
    """
    big = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > expand_up_to).select("class_id")
    small = members.join(big, "class_id", "left_anti")
    star = members.join(big, "class_id", "left_semi").where("id <> class_id").select(F.col("class_id").alias("a"), F.col("id").alias("b"))
    shown = small.unionByName(big.select(F.col("class_id").alias("id"), "class_id"))
    m1 = shown.select(F.col("id").alias("a"), F.col("class_id").alias("id_1"))
    m2 = shown.select(F.col("id").alias("b"), F.col("class_id").alias("id_2"))
    between = links.select("id_1", "id_2").join(m1, "id_1").join(m2, "id_2").select("a", "b")
    copies = small.alias("x").join(small.alias("y"), F.expr("x.class_id = y.class_id and x.id < y.id"))
    every = between.unionByName(copies.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))).unionByName(star)
    return every.select(F.least("a", "b").alias("id_1"), F.greatest("a", "b").alias("id_2"))
