"""Matches of windows counted where a region is, without a row of the index or of the matches in any shuffle.

A region's matches depend on its own letters only: which k-mers it holds once, which windows
ask for them, which allele alone hits it. Windows that ask the same question (the k-mer
without its tested base, and the tested place) are one pattern; there are k * 4**(k - 1) at
most. So one shuffle brings the letters of a region together (rows that share a key are one
region), and each task returns one row a pattern and allele: counts and sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from . import index as index_, matching

MOST_PATTERNS = 60_000  # numbers of some hundred bytes each, held by every task
LETTERS_AT_ONCE = 200_000
COVARIATES = ("lp", "sl", "cpg_oe", "y")
PAIRS = [(i, j) for i in range(len(COVARIATES)) for j in range(i + 1)]
_CODES = np.full(256, 4, np.int64)
for _i, _b in enumerate("ACGT"):
    _CODES[ord(_b)] = _CODES[ord(_b.lower())] = _i


def pattern_of(kmer: Column | str, j: Column | str) -> Column:
    """The k-mer with '.' at its 0-based place j."""
    return S.replaced(kmer, F.col(j) if isinstance(j, str) else j, ".")


def once(seqs: list[list[str]], k: int, kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(region number, number of the k-mer, offset from 1) of the k-mers (sorted numbers) that a region holds once."""
    pieces = [s for group in seqs for s in group]
    sizes = np.array([len(s) + 1 for s in pieces], np.int64)
    d = _CODES[np.frombuffer(("\n".join(pieces) + "\n").encode("ascii", "replace"), np.uint8)]
    n = len(d) - k + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return none, none, none
    code, good = np.zeros(n, np.int64), np.ones(n, bool)
    for p in range(k):
        code = code * 4 + d[p : p + n]
        good &= d[p : p + n] < 4
    at = np.flatnonzero(good)
    kmer = np.searchsorted(kmers, code[at])
    kmer[kmer == len(kmers)] = 0
    known = kmers[kmer] == code[at]
    at, kmer = at[known], kmer[known]
    if not len(at):
        return none, none, none
    owner = np.repeat(np.arange(len(seqs)), [len(g) for g in seqs])
    piece = np.repeat(np.arange(len(pieces)), sizes)[at]
    key = np.sort((owner[piece] * len(kmers) + kmer) * len(at) + np.arange(len(at)))
    key, i = np.divmod(key, len(at))
    new = np.concatenate([[True], key[1:] != key[:-1], [True]])
    i = i[new[:-1] & new[1:]]
    return owner[piece[i]], kmer[i], at[i] - (np.cumsum(sizes) - sizes)[piece[i]] + 1


class Asked:
    """The probes of sorted patterns by k-mer: for k-mer number ``id`` the entries start[id] to start[id + 1]."""

    def __init__(self, patterns: list[str], k: int, palindrome: str, last_strand: bool):
        self.k, self.n, self.last = k, len(patterns), last_strand
        letters = np.frombuffer("".join(patterns).encode(), np.uint8).reshape(self.n, k)
        j = (letters == ord(".")).argmax(axis=1)
        digits = np.where(letters == ord("."), 0, _CODES[letters])
        up, down = 4 ** np.arange(k - 1, -1, -1), 4 ** np.arange(k)
        rows = []
        for a in range(4):
            filled = digits.copy()
            filled[np.arange(self.n), j] = a
            forward, reverse = filled @ up, (3 - filled) @ down
            own = forward == reverse
            for code, is_reverse, asked in ((forward, 0, ~own if palindrome == "reverse" else own | True), (reverse, 1, ~own if palindrome == "forward" else own | True)):
                at = np.flatnonzero(asked)
                rows.append((code[at], at, np.full(len(at), a), np.full(len(at), is_reverse), j[at]))
        code, self.pattern, self.allele, self.is_reverse, self.j = (np.concatenate(x) for x in zip(*rows))
        order = np.argsort(code, kind="stable")
        self.pattern, self.allele, self.is_reverse, self.j = (x[order] for x in (self.pattern, self.allele, self.is_reverse, self.j))
        self.kmers, first = np.unique(code[order], return_index=True)
        self.start = np.append(first, len(order))

    def found(self, seqs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(region number, pattern, allele, place, whether the allele alone hits the region), by region and pattern."""
        region, kmer, offset = once(seqs, self.k, self.kmers)
        many = self.start[kmer + 1] - self.start[kmer]
        total = int(many.sum())
        if not total:
            return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, bool),)
        hit = np.repeat(np.arange(len(kmer)), many)
        probe = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + self.start[kmer][hit]
        strand = self.is_reverse[probe]
        key = ((region[hit] * self.n + self.pattern[probe]) * 4 + self.allele[probe]) * 2 + (1 - strand if self.last else strand)
        key, i = np.divmod(np.sort(key * total + np.arange(total)), total)
        key >>= 1
        first = np.concatenate([[True], key[1:] != key[:-1]])
        key, i = key[first], i[first]
        hit, probe = hit[i], probe[i]
        place = np.where(self.is_reverse[probe] == 1, offset[hit] + self.k - 1 - self.j[probe], offset[hit] + self.j[probe])
        group = key >> 2
        new = np.concatenate([[True], group[1:] != group[:-1], [True]])
        return region[hit], self.pattern[probe], self.allele[probe], place, new[:-1] & new[1:]


def asked_patterns(windows: DataFrame) -> list[str] | None:
    """The distinct patterns of windows(kmer, j), or None where they are too many or hold other letters."""
    rows = windows.select(pattern_of("kmer", "j").alias("p")).distinct().limit(MOST_PATTERNS + 1).collect()
    found = sorted(r["p"] for r in rows)
    return found if len(found) <= MOST_PATTERNS and not set("".join(found)) - set("ACGT.") else None


def _parts(seqs: pd.Series) -> Iterator[tuple[int, int]]:
    size = np.cumsum([sum(map(len, s)) for s in seqs])
    start = 0
    while start < len(seqs):
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + LETTERS_AT_ONCE)))
        yield start, end
        start = end


def cells(regions: DataFrame, patterns: list[str], k: int, *, alone: bool, last_strand: bool = False, palindrome: str = "reverse", moments: bool = False) -> DataFrame:
    """pattern, allele, n, places [, sums]: the matched regions of each pattern and allele, and the sum of their places.

    alone: only regions that one allele of the pattern hits. moments: regions(region, seq, y,
    cpg_oe) are rows of a regression, and rows that share a key each count; n are rows, sums
    are those of COVARIATES and then of their PAIRS.
    """
    asked = Asked(patterns, k, palindrome, last_strand)
    values = ["y", "cpg_oe"] if moments else []
    sums = [F.sum(c).alias(f"_{c}") for c in values] + [F.sum(F.col(a) * F.col(b)).alias(f"_{a}_{b}") for a, b in (("y", "y"), ("cpg_oe", "cpg_oe"), ("cpg_oe", "y")) if moments]
    whole = regions.select("region", F.coalesce("seq", F.lit("")).alias("seq"), *values).groupBy("region").agg(F.collect_list("seq").alias("seqs"), F.count("*").cast("double").alias("_m"), *sums)
    whole = whole.withColumn("_sl", S.region_length("region").cast("double"))
    size = 4 * asked.n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2 + (len(COVARIATES) + len(PAIRS)) * moments, size))
        for batch in batches:
            given = {c: batch[c].to_numpy(float) for c in batch.columns if c.startswith("_")}
            for a, b in _parts(batch["seqs"]):
                region, pattern, allele, place, single = asked.found([list(s) for s in batch["seqs"].iloc[a:b]])
                if alone:
                    region, pattern, allele, place = (x[single] for x in (region, pattern, allele, place))
                cell = pattern * 4 + allele
                add = lambda i, w: np.add(total[i], np.bincount(cell, w, size), out=total[i])
                v = {c: x[a:b][region] for c, x in given.items()}
                m = v["_m"] if moments else None
                add(0, m)
                add(1, place.astype(float))
                if moments:
                    lp, sl = place / v["_sl"], v["_sl"]
                    lp = np.where(lp > 0.5, 1 - lp, lp)
                    y, c = v["_y"], v["_cpg_oe"]
                    parts = (lp * m, sl * m, c, y, lp * lp * m, sl * lp * m, sl * sl * m, c * lp, c * sl, v["_cpg_oe_cpg_oe"], y * lp, y * sl, v["_cpg_oe_y"], v["_y_y"])
                    for i, w in enumerate(parts, 2):
                        add(i, w)
        at = np.flatnonzero(total[0])
        yield pd.DataFrame({"pattern": at // 4, "allele": at % 4, "n": total[0, at].astype(np.int64), "places": total[1, at].astype(np.int64), "sums": list(total[2:, at].T)})

    rows = whole.mapInPandas(run, "pattern int, allele int, n long, places long, sums array<double>")
    n = (len(COVARIATES) + len(PAIRS)) * moments
    out = rows.groupBy("pattern", "allele").agg(F.sum("n").alias("n"), F.sum("places").alias("places"), F.array(*[F.sum(F.col("sums")[i]) for i in range(n)]).cast("array<double>").alias("sums"))
    names = regions.sparkSession.createDataFrame(list(enumerate(patterns)), "pattern int, _name string")
    out = out.join(F.broadcast(names), "pattern").select(F.col("_name").alias("pattern"), S.base_of(F.col("allele") + 1).alias("allele"), "n", "places", "sums")
    return out if moments else out.drop("sums")


def counts(windows: DataFrame, regions: DataFrame, k: int, by: list[str], index, *, alone: bool, last_strand: bool = False, palindrome: str = "reverse") -> DataFrame:
    """by..., allele, n, places of the windows' matches; beyond MOST_PATTERNS from the matches with index(), in shuffles."""
    patterns = asked_patterns(windows)
    if patterns is None:
        found = matching.match(windows, index(), k, by, last_strand=last_strand, palindrome=palindrome)
        found = matching.unambiguous(found, by) if alone else found
        return found.groupBy(*by, "allele").agg(F.count("*").alias("n"), F.sum("place").alias("places"))
    found = cells(regions, patterns, k, alone=alone, last_strand=last_strand, palindrome=palindrome)
    return windows.select(*by, pattern_of("kmer", "j").alias("pattern")).distinct().join(found, "pattern").select(*by, "allele", "n", "places")


def design_moments(windows: DataFrame, regions: DataFrame, patterns: list[str], k: int, by: list[str], covariates: tuple[str, ...], *, last_strand: bool = False, palindrome: str = "reverse") -> DataFrame:
    """by..., n, s, c, counts, ref, alt of windows(by..., kmer, j, ref): what fits.affinity() solves, of the rows of matching.design()."""
    found = cells(regions, patterns, k, alone=True, last_strand=last_strand, palindrome=palindrome, moments=True)
    cells_ = found.groupBy("pattern").agg(F.collect_list(F.struct("allele", "n", "sums")).alias("cells"))
    rows = windows.select(*by, "ref", pattern_of("kmer", "j").alias("pattern")).distinct().join(cells_, "pattern").drop("pattern")
    use = [COVARIATES.index(c) for c in (*covariates, "y")]
    pair = {p: i for i, p in enumerate(PAIRS)}
    lower = np.tril_indices(4 + len(use))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                n_of, sums = np.zeros(4), np.zeros((4, len(COVARIATES) + len(PAIRS)))
                for cell in row.cells:
                    i = "ACGT".index(cell["allele"])
                    n_of[i], sums[i] = cell["n"], cell["sums"]
                n, all_ = n_of.sum(), sums.sum(axis=0)
                hot = np.where([b == row.ref for b in "ACGT"], 0.0, n_of)
                mean = np.concatenate([hot, all_[use]]) / n
                c = np.zeros((4 + len(use),) * 2)
                c[:4, :4] = np.diag(hot)
                c[4:, :4] = np.where((hot > 0)[None, :], sums[:, use].T, 0.0)
                c[4:, 4:] = [[all_[len(COVARIATES) + pair[max(a, b), min(a, b)]] for b in use] for a in use]
                c -= n * np.outer(mean, mean)
                out.append((*row[: len(by)], int(n), mean.tolist(), c[lower].tolist(), n_of.astype(int).tolist(), row.ref, int(any(m and b != row.ref for m, b in zip(n_of, "ACGT")))))
            yield pd.DataFrame(out, columns=[*by, "n", "s", "c", "counts", "ref", "alt"])

    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in (rows.schema[b] for b in by))
    return rows.mapInPandas(run, keys + "n long, s array<double>, c array<double>, counts array<long>, ref string, alt int")


def sample_candidates(windows: DataFrame, regions: DataFrame, k: int, by: list[str], cap: int, seed: int = 0) -> DataFrame | None:
    """by..., allele, region, place: of each window's and allele's matches at least the ``cap`` first in text order of (seed, by, region).

    A task keeps so many of its own; the first 8 bytes of the MD5 decide, and ties of these all
    stay. None where the windows or their patterns are too many to hold.
    """
    patterns = asked_patterns(windows)
    held = windows.select(*by, pattern_of("kmer", "j").alias("pattern")).distinct().limit(MOST_PATTERNS + 1).collect()
    if patterns is None or len(held) > MOST_PATTERNS:
        return None
    asked = Asked(patterns, k, "reverse", False)
    number = {p: i for i, p in enumerate(patterns)}
    held.sort(key=lambda r: number[r["pattern"]])
    first = np.searchsorted([number[r["pattern"]] for r in held], np.arange(len(patterns) + 1))
    starts = ["|".join(map(str, [seed, *(r[b] for b in by)])).encode() + b"|" for r in held]
    whole = regions.select("region", F.coalesce("seq", F.lit("")).alias("seq")).groupBy("region").agg(F.collect_list("seq").alias("seqs"))

    def least(cell: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((key, cell))
        c, x = cell[order], key[order]
        begin = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        size = np.diff(np.append(begin, len(c)))
        last = np.repeat(x[begin + np.minimum(size, cap) - 1], size)
        full = np.full(4 * len(held), np.iinfo(np.uint64).max)
        full[c[begin[size >= cap]]] = x[begin[size >= cap] + cap - 1]
        return order[x <= last], full

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells_, keys, places, names = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)
        most = np.full(4 * len(held), np.iinfo(np.uint64).max)
        for batch in batches:
            for a, b in _parts(batch["seqs"]):
                label = batch["region"].iloc[a:b].to_numpy(object)
                region, pattern, allele, place, _ = asked.found([list(s) for s in batch["seqs"].iloc[a:b]])
                many = first[pattern + 1] - first[pattern]
                if not many.sum():
                    continue
                row = np.repeat(np.arange(len(many)), many)
                window = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[pattern][row]
                text = [r.encode() for r in label]
                digests = b"".join([hashlib.md5(starts[w] + text[i]).digest()[:8] for w, i in zip(window.tolist(), region[row].tolist())])
                key, cell = np.frombuffer(digests, ">u8").astype(np.uint64), window * 4 + allele[row]
                good = key <= most[cell]
                cells_, keys = np.concatenate([cells_, cell[good]]), np.concatenate([keys, key[good]])
                places, names = np.concatenate([places, place[row][good]]), np.concatenate([names, label[region[row][good]]])
                stay, most = least(cells_, keys)
                cells_, keys, places, names = cells_[stay], keys[stay], places[stay], names[stay]
        yield pd.DataFrame({"_w": cells_ // 4, "_a": cells_ % 4 + 1, "region": names, "place": places})

    rows = whole.mapInPandas(run, "_w int, _a int, region string, place long")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in (windows.schema[b] for b in by))
    table = regions.sparkSession.createDataFrame([(*(r[b] for b in by), i) for i, r in enumerate(held)], kinds + "_w int")
    return rows.join(F.broadcast(table), "_w").select(*by, S.base_of(F.col("_a")).alias("allele"), "region", "place")


def masked_hits(regions: DataFrame, mask: str, targets: DataFrame, *, by_strand: bool) -> DataFrame:
    """index.masked_hits() where a region is: its letters are shuffled, none of its signatures."""
    wanted = targets.select("code").distinct().limit(MOST_PATTERNS + 1).collect()
    if len(wanted) > MOST_PATTERNS:
        return index_.masked_hits(regions, mask, targets, by_strand=by_strand)
    known = np.array(sorted(r["code"] for r in wanted if r["code"] is not None), np.int64)
    ones, span = S.informative(mask), len(mask)
    whole = regions.select("region", F.coalesce("seq", F.lit("")).alias("seq")).groupBy("region").agg(F.collect_list("seq").alias("seqs"))

    def single(seqs: list[list[str]]) -> tuple[np.ndarray, ...]:
        """(region number, number of the code, offset from 1, strand) of the known codes that a region holds once."""
        pieces = [s for group in seqs for s in group]
        sizes = np.array([len(s) + 1 for s in pieces], np.int64)
        d = _CODES[np.frombuffer(("\n".join(pieces) + "\n").encode("ascii", "replace"), np.uint8)]
        n = max(len(d) - span + 1, 0)
        first = np.cumsum(sizes) - sizes
        piece = np.repeat(np.arange(len(pieces)), sizes)[:n]
        whole_ = np.arange(n) + span <= (first + sizes - 1)[piece]  # spacers may be any letter, but of the same piece
        owner = np.repeat(np.arange(len(seqs)), [len(g) for g in seqs])[piece]
        keys = []
        for strand in (0, 1):
            code, good = np.zeros(n, np.int64), whole_.copy()
            for p in ones:
                digit = d[span - 1 - p :][:n] if strand else d[p:][:n]
                good &= digit < 4
                code = code * 4 + (3 - digit if strand else digit)
            low = np.minimum(np.searchsorted(known, code), len(known) - 1)
            at = np.flatnonzero(good & (known[low] == code))
            offset = at - first[piece[at]] + 1
            keys.append(np.stack([owner[at] * len(known) + low[at], offset, np.full(len(at), strand)]))
        cell, offset, strand = np.concatenate(keys, axis=1)
        order = np.lexsort((strand, offset, cell))
        cell, offset, strand = cell[order], offset[order], strand[order]
        if not len(cell):
            return (cell,) * 4
        begin = np.concatenate([[True], cell[1:] != cell[:-1]])
        other = (offset[1:] != offset[:-1]) | (strand[1:] != strand[:-1]) if by_strand else offset[1:] != offset[:-1]
        new = begin | np.concatenate([[True], other])  # an occurrence that rows of one region share counts once
        at = np.flatnonzero(begin)
        once_ = at[np.add.reduceat(new.astype(np.int64), at) == 1]
        return cell[once_] // len(known), cell[once_] % len(known), offset[once_], strand[once_]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches if len(known) else ():
            for a, b in _parts(batch["seqs"]):
                region, code, offset, strand = single([list(s) for s in batch["seqs"].iloc[a:b]])
                if len(region):
                    yield pd.DataFrame({"code": known[code], "region": batch["region"].iloc[a:b].to_numpy(object)[region], "offset": offset, "is_reverse": strand == 1})

    return whole.mapInPandas(run, "code long, region string, offset long, is_reverse boolean")
