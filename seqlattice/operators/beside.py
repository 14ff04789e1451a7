"""Backgrounds, fits against them and pooled fits, counted where a region is as in local.py.

What a variant needs of a region is little: whether one of its windows hits it (a bit), the
cross products of the rows that it gives to a fit, its score in a pooled fit. Each task adds
these up over its regions, so that neither the index nor its matches are shuffled; the letters
of a region are, and one row a region (its first place and the bits of the variants).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S
from . import background, fits, local

MOST_VARIANTS = 2_000  # a bit each beside every region
BLOCKS = 512  # of the ring, whose free regions are counted by variant
ROWS_AT_ONCE = 2_000
VALUES = ("lp", "sl", "y")
PAIRS = [(i, j) for i in range(len(VALUES)) for j in range(i + 1)]


class Held:
    """The windows (variant, motif_pos, ref) of a table by the number of their pattern; None of them is a row of a shuffle."""

    def __init__(self, rows: list, patterns: list[str]):
        number = {p: i for i, p in enumerate(patterns)}
        self.rows = sorted(rows, key=lambda r: (number[r["pattern"]], r["variant"], r["motif_pos"]))
        self.variants = sorted({r["variant"] for r in rows})
        at = {v: i for i, v in enumerate(self.variants)}
        self.patterns = patterns
        self.owner = np.array([at[r["variant"]] for r in self.rows], np.int64)
        self.first = np.searchsorted([number[r["pattern"]] for r in self.rows], np.arange(len(patterns) + 1))

    def expanded(self, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of pattern, window) of all windows that ask for each pattern."""
        many = self.first[pattern + 1] - self.first[pattern]
        row = np.repeat(np.arange(len(many)), many)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + self.first[pattern][row]


def held(windows: DataFrame) -> Held | None:
    """The windows(variant, motif_pos, ref, kmer, j), or None where they or their patterns are too many to hold."""
    patterns = local.asked_patterns(windows)
    rows = windows.select("variant", "motif_pos", "ref", local.pattern_of("kmer", "j").alias("pattern")).distinct().limit(local.MOST_PATTERNS + 1).collect()
    out = None if patterns is None or len(rows) > local.MOST_PATTERNS else Held(rows, patterns)
    return out if out and len(out.variants) <= MOST_VARIANTS else None


def gathered(regions: DataFrame, *values) -> DataFrame:
    """region, seqs and aggregates of regions: rows that share a key are one region."""
    return regions.select("region", F.coalesce("seq", F.lit("")).alias("seq"), *[c for c in regions.columns if c not in ("region", "seq")]).groupBy("region").agg(F.collect_list("seq").alias("seqs"), *values)


def _pieces(batch: pd.DataFrame) -> Iterator[tuple[int, int, list[list[str]]]]:
    for a, b in local._parts(batch["seqs"]):
        yield a, b, [list(s) for s in batch["seqs"].iloc[a:b]]


# -- the sampler ---------------------------------------------------------------


def places(regions: DataFrame, asked_: Held, k: int) -> DataFrame:
    """region, offset (of the first k-mer that it holds once), matched (a bit a variant) of the regions with such a k-mer."""
    asked, every = local.Asked(asked_.patterns, k, "reverse", False), np.arange(4**k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, seqs in _pieces(batch):
                region, _, offset = local.once(seqs, k, every)
                first = np.full(b - a, np.iinfo(np.int64).max)
                np.minimum.at(first, region, offset)
                region, pattern, *_ = asked.found(seqs)
                row, window = asked_.expanded(pattern)
                hit = np.zeros((b - a, len(asked_.variants)), bool)
                hit[region[row], asked_.owner[window]] = True
                have = first < np.iinfo(np.int64).max
                yield pd.DataFrame({"region": batch["region"].iloc[a:b].to_numpy(object)[have], "offset": first[have], "matched": [x.tobytes() for x in np.packbits(hit[have], axis=1)]})

    return gathered(regions.select("region", "seq")).mapInPandas(run, "region string, offset long, matched binary")


def sample(places_: DataFrame, variants: list[str], k: int, n: int, seed: int = 0) -> DataFrame:
    """background.sample_background() of places(region, offset, matched), read twice: variant, motif_pos, region, offset.

    The free regions of each variant are counted by blocks of the ring; a variant then takes
    those up to the block in which it has enough, and the first of these in the ring's order.
    """
    size, width, most = places_.count(), len(variants), n * k
    spark = places_.sparkSession
    if not size or not width:
        return spark.createDataFrame([], "variant string, motif_pos int, region string, offset long")
    ring = background.text_rank(places_, size, seed, "region")
    start = np.array([int(hashlib.md5(f"{seed + 1}|{v}".encode()).hexdigest()[:15], 16) % size for v in variants])

    def free(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        for batch in batches:
            for a in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.iloc[a : a + ROWS_AT_ONCE]
                bits = np.frombuffer(b"".join(part["matched"]), np.uint8).reshape(len(part), -1)
                yield part, np.unpackbits(bits, axis=1)[:, :width] == 0

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for part, is_free in free(batches):
            block = part["rank"].to_numpy(np.int64) * BLOCKS // size
            for b in np.unique(block).tolist():
                total[b] = total.get(b, 0) + is_free[block == b].sum(axis=0)
        if total:  # an empty task would give a column without a type
            yield pd.DataFrame({"block": list(total), "free": [x.tolist() for x in total.values()]})

    counts = np.zeros((BLOCKS, width), np.int64)
    for r in ring.select("rank", "matched").mapInPandas(count, "block int, free array<long>").toLocalIterator():
        counts[r["block"]] += np.array(r["free"])
    own = start * BLOCKS // size
    order = (own[:, None] + 1 + np.arange(BLOCKS)) % BLOCKS  # the own block, begun in its midst, comes last
    enough = np.cumsum(counts[order, np.arange(width)[:, None]], axis=1) >= most
    enough[:, -1] = True
    last = order[np.arange(width), enough.argmax(axis=1)]
    reach = np.where(last == own, size, (((last + 1) * size + BLOCKS - 1) // BLOCKS - 1 - start) % size)  # the way to its last rank

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, is_free in free(batches):
            way = (part["rank"].to_numpy(np.int64)[:, None] - start) % size
            row, v = np.nonzero(is_free & (way <= reach))
            yield pd.DataFrame({"_v": v, "_at": way[row, v], "region": part["region"].to_numpy(object)[row], "offset": part["offset"].to_numpy(np.int64)[row]})

    taken = ring.select("rank", "region", "offset", "matched").mapInPandas(take, "_v int, _at long, region string, offset long")
    placed = taken.withColumn("_no", F.row_number().over(W.partitionBy("_v").orderBy("_at")) - 1).where(F.col("_no") < most)
    names = spark.createDataFrame(list(enumerate(variants)), "_v int, variant string")
    return placed.join(F.broadcast(names), "_v").select("variant", F.floor(F.col("_no") / n).cast("int").alias("motif_pos"), "region", "offset")


# -- fits against the background ---------------------------------------------------


def _folded(place: np.ndarray, size: np.ndarray) -> np.ndarray:
    p = place / size
    return np.where(p > 0.5, 1 - p, p)


def _sums(cell: np.ndarray, size: int, m: np.ndarray, lp: np.ndarray, sl: np.ndarray, y: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """n, sums of VALUES and of their PAIRS by cell, of m rows each whose responses add to y and their squares to yy."""
    parts = (m, lp * m, sl * m, y, lp * lp * m, sl * lp * m, sl * sl * m, lp * y, sl * y, yy)
    return np.array([np.bincount(cell, w, size) for w in parts])


def hit_sums(regions: DataFrame, patterns: list[str], k: int) -> DataFrame:
    """pattern, bits, sums (n, VALUES, PAIRS) of the rows of the hit regions(region, seq, y): bit a for allele a, the first one's place.

    A region without a finite y has no rows.
    """
    asked = local.Asked(patterns, k, "reverse", False)
    good = F.when(F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") < float("inf")), F.col("y"))
    whole = gathered(regions.select("region", "seq", good.alias("y")), F.count("y").cast("double").alias("_m"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("_y"), F.coalesce(F.sum(F.col("y") * F.col("y")), F.lit(0.0)).alias("_yy")).withColumn("_sl", S.region_length("region").cast("double"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = 16 * asked.n
        total = np.zeros((1 + len(VALUES) + len(PAIRS), size))
        for batch in batches:
            given = {c: batch[c].to_numpy(float) for c in ("_m", "_y", "_yy", "_sl")}
            for a, b, seqs in _pieces(batch):
                region, pattern, allele, place, _ = asked.found(seqs)
                if not len(region):
                    continue
                begin = np.flatnonzero(np.concatenate([[True], (region[1:] != region[:-1]) | (pattern[1:] != pattern[:-1])]))
                bits = np.bitwise_or.reduceat(1 << allele, begin)
                region, pattern, place = region[begin], pattern[begin], place[begin]
                m, y, yy, sl = (given[c][a:b][region] for c in ("_m", "_y", "_yy", "_sl"))
                total += _sums(pattern * 16 + bits, size, m, _folded(place, sl), sl, y, yy)
        at = np.flatnonzero(total[0])
        if len(at):
            yield pd.DataFrame({"pattern": at // 16, "bits": at % 16, "sums": list(total[:, at].T)})

    return _added(whole.mapInPandas(run, "pattern int, bits int, sums array<double>"), ["pattern", "bits"], patterns)


def _added(rows: DataFrame, by: list[str], patterns: list[str]) -> DataFrame:
    n = 1 + len(VALUES) + len(PAIRS)
    out = rows.groupBy(*by).agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(n)]).alias("sums"))
    names = rows.sparkSession.createDataFrame(list(enumerate(patterns)), "pattern int, _name string")
    return out.join(F.broadcast(names), "pattern").drop("pattern").withColumnRenamed("_name", "pattern")


def _row_sums() -> object:
    """The sums of rows(lp, sl, y)."""
    each = [F.lit(1.0), *map(F.col, VALUES), *[F.col(VALUES[i]) * F.col(VALUES[j]) for i, j in PAIRS]]
    return F.array(*[F.sum(x) for x in each])


def _cross(hot: np.ndarray, sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, means, centred cross products) of the columns of hot (a row a cell, 0 or 1) and then VALUES."""
    n, p = sums[:, 0].sum(), hot.shape[1]
    raw = np.zeros((p + len(VALUES),) * 2)
    raw[:p, :p] = hot.T @ (hot * sums[:, :1])
    raw[p:, :p] = sums[:, 1 : 1 + len(VALUES)].T @ hot
    raw[:p, p:] = raw[p:, :p].T
    for at, (i, j) in enumerate(PAIRS):
        raw[p + i, p + j] = raw[p + j, p + i] = sums[:, 1 + len(VALUES) + at].sum()
    mean = np.concatenate([hot.T @ sums[:, 0], sums[:, 1 : 1 + len(VALUES)].sum(axis=0)]) / n
    c = raw - n * np.outer(mean, mean)
    still = np.diag(c) <= 1e-13 * np.diag(raw)  # a column that doesn't vary, but for the rounding of its sums
    c[still, :] = c[:, still] = 0
    return n, mean, c


def against_background(windows: DataFrame, regions: DataFrame, drawn: DataFrame, patterns: list[str], k: int, by: list[str], least: int = 10) -> DataFrame:
    """background.against_background() by least squares, of windows(by..., kmer, j), regions(region, seq, y) and drawn(by..., region, place)."""
    rounded = regions.withColumn("y", F.rint("y"))
    hit = windows.select(*by, local.pattern_of("kmer", "j").alias("pattern")).distinct().join(hit_sums(rounded, patterns, k), "pattern").select(*by, "bits", "sums")
    size = S.region_length("region")
    good = F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") < float("inf"))
    rows = drawn.select(*by, "region", "place").join(rounded.select("region", "y").where(good), "region")
    rows = rows.select(*by, "y", S.folded_place(F.col("place"), size).alias("lp"), size.cast("double").alias("sl"))
    rows = rows.groupBy(*by).agg(_row_sums().alias("sums")).select(*by, F.lit(0).alias("bits"), "sums")
    cells = hit.unionByName(rows).groupBy(*by).agg(F.collect_list(F.struct("bits", "sums")).alias("cells"))
    columns = [*S.BASES, "lp", "sl"]
    lower = np.tril_indices(len(columns) + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                ordered = sorted(row.cells, key=lambda c: c["bits"])
                hot = np.array([[c["bits"] >> a & 1 for a in range(4)] for c in ordered], float)
                sums = np.array([c["sums"] for c in ordered], float)
                n, mean, c = _cross(hot, sums)
                out.append((*row[: len(by)], int(n), mean.tolist(), c[lower].tolist(), (hot.T @ sums[:, 0]).astype(int).tolist()))
            yield pd.DataFrame(out, columns=[*by, "n", "s", "c", "hit"])

    groups = cells.mapInPandas(run, fits._keys(cells, by) + "n long, s array<double>, c array<double>, hit array<long>")
    return background.against_moments(groups.where(F.col("n") >= least), drawn, by, columns)


# -- pooled fits ----------------------------------------------------------------------


def pooled(asked_: Held, regions: DataFrame, k: int, drawn: DataFrame | None = None) -> DataFrame:
    """fits.pooled() of the rows of matching.design(), by variant, of regions(region, seq, y), and of drawn(variant, motif_pos, region, place).

    Two readings of the letters: moments, then scores. With drawn regions, which the variant
    doesn't hit, these are the baseline of all alleles.
    """
    spark = regions.sparkSession
    regions = regions.select("region", "seq", F.log1p("y").alias("y"))
    asked = local.Asked(asked_.patterns, k, "reverse", False)
    whole = gathered(regions, F.count("*").cast("double").alias("_m"), F.sum("y").alias("_y"), F.sum(F.col("y") * F.col("y")).alias("_yy")).withColumn("_sl", S.region_length("region").cast("double"))

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            given = {c: batch[c].to_numpy(float) for c in ("_m", "_y", "_yy", "_sl")}
            for a, b, seqs in _pieces(batch):
                region, pattern, allele, place, single = asked.found(seqs)
                region, pattern, allele, place = (x[single] for x in (region, pattern, allele, place))
                m, y, yy, sl = (given[c][a:b][region] for c in ("_m", "_y", "_yy", "_sl"))
                yield region, pattern, allele, m, _folded(place, sl), sl, y, yy

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = 4 * asked.n
        total = np.zeros((1 + len(VALUES) + len(PAIRS), size))
        for _, pattern, allele, *values in alone(batches):
            total += _sums(pattern * 4 + allele, size, *values)
        at = np.flatnonzero(total[0])
        if len(at):
            yield pd.DataFrame({"pattern": at // 4, "allele": at % 4, "sums": list(total[:, at].T)})

    windows = spark.createDataFrame([(r["variant"], r["motif_pos"], r["ref"], r["pattern"]) for r in asked_.rows], "variant string, motif_pos int, ref string, pattern string")
    found = _added(whole.mapInPandas(moments, "pattern int, allele int, sums array<double>"), ["pattern", "allele"], asked_.patterns)
    cells = windows.join(found, "pattern").select("variant", "motif_pos", "ref", "allele", "sums")
    rows = None
    if drawn is not None:
        length = S.region_length("region")
        rows = drawn.join(regions.select("region", "y"), "region").select("variant", "motif_pos", "region", "y", S.folded_place(F.col("place"), length).alias("lp"), length.cast("double").alias("sl")).persist()
        background_ = rows.groupBy("variant", "motif_pos").agg(_row_sums().alias("sums"))
        cells = cells.withColumn("ref", F.lit("none")).unionByName(background_.select("variant", "motif_pos", F.lit("none").alias("ref"), F.lit(4).alias("allele"), "sums"))
    every = cells.groupBy("variant", "ref").agg(F.collect_list(F.struct("motif_pos", "allele", "sums")).alias("cells"))
    names = [*S.BASES, "lp", "sl"]
    p = len(names)
    lower = np.tril_indices(p + 1)

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                n, c, means = 0.0, np.zeros((p + 1, p + 1)), {}
                for at in sorted({x["motif_pos"] for x in row.cells}):
                    own = sorted((x for x in row.cells if x["motif_pos"] == at), key=lambda x: x["allele"])
                    hot = np.array([[x["allele"] == a and S.BASES[a] != row.ref for a in range(4)] for x in own], float)
                    size, mean, cross = _cross(hot, np.array([x["sums"] for x in own], float))
                    n, c, means[at] = n + size, c + cross, mean.tolist()
                out.append((row.variant, int(n), c[lower].tolist(), len(means), row.ref, means))
            yield pd.DataFrame(out, columns=["variant", "n", "c", "windows", "ref", "means"])

    made = every.mapInPandas(within, "variant string, n long, c array<double>, windows long, ref string, means map<int,array<double>>").persist()
    fitted = fits.pooled_slopes(made.drop("means"), ["variant"], names).persist()
    means = {r["variant"]: r["means"] for r in made.select("variant", "means").collect()}
    solved = {r["variant"]: r for r in fitted.collect()}
    width = len(asked_.variants)
    mean, slope, inverse = np.zeros((len(asked_.rows), p + 1)), np.zeros((width, p)), np.zeros((width, 4, p))
    hot = np.zeros((len(asked_.rows), 4))
    for v, name in enumerate(asked_.variants):
        if name in solved:
            slope[v], inverse[v] = solved[name]["slope"], np.array(solved[name]["inverse"]).reshape(4, p)
    for w, r in enumerate(asked_.rows):
        mean[w] = means.get(r["variant"], {}).get(r["motif_pos"], mean[w])
        hot[w] = [drawn is not None or b != r["ref"] for b in S.BASES]

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((5, width))
        for region, pattern, allele, m, lp, sl, y, _ in alone(batches):
            row, window = asked_.expanded(pattern)
            if not len(row):
                continue
            v = asked_.owner[window]
            x = np.zeros((len(row), p))
            x[np.arange(len(row)), allele[row]] = hot[window, allele[row]]
            x[:, 4], x[:, 5] = lp[row], sl[row]
            x -= mean[window, :p]
            rest = y[row] - m[row] * (mean[window, p] + np.einsum("ij,ij->i", x, slope[v]))
            key, cluster = np.unique(region[row] * width + v, return_inverse=True)
            total[4] += np.bincount(key % width, minlength=width)
            for j in range(4):
                each = np.bincount(cluster, rest * np.einsum("ij,ij->i", x, inverse[v, j]))
                total[j] += np.bincount(key % width, each * each, width)
        at = np.flatnonzero(total[4])
        if len(at):
            yield pd.DataFrame({"_v": at, "g": total[4, at].astype(np.int64), "meat": list(total[:4, at].T)})

    names_ = F.broadcast(spark.createDataFrame(list(enumerate(asked_.variants)), "_v int, variant string"))
    clusters = whole.mapInPandas(scores, "_v int, g long, meat array<double>").join(names_, "_v").select("variant", "g", "meat")
    if rows is not None:
        at_ = F.broadcast(spark.createDataFrame([(v, w, x) for v, by in means.items() for w, x in by.items()], "variant string, motif_pos int, _mean array<double>"))
        centred = rows.join(at_, ["variant", "motif_pos"]).join(fitted.select("variant", "slope", "inverse"), "variant")
        x = [F.lit(0.0) - F.col("_mean")[i] for i in range(4)] + [F.col(c) - F.col("_mean")[i] for i, c in enumerate(("lp", "sl"), 4)]
        rest = F.col("y") - F.col("_mean")[p] - sum((F.col("slope")[i] * x[i] for i in range(1, p)), F.col("slope")[0] * x[0])
        each = [F.sum(rest * sum((F.col("inverse")[j * p + i] * x[i] for i in range(1, p)), F.col("inverse")[j * p] * x[0])).alias(f"_s{j}") for j in range(4)]
        own = centred.groupBy("variant", "region").agg(*each).groupBy("variant").agg(F.count("*").alias("g"), F.array(*[F.sum(F.col(f"_s{j}") * F.col(f"_s{j}")) for j in range(4)]).alias("meat"))
        clusters = clusters.unionByName(own)
    meat = clusters.groupBy("variant").agg(F.sum("g").alias("g"), F.array(*[F.sum(F.col("meat")[j]) for j in range(4)]).alias("meat"))
    return fits.pooled_tests(fitted, meat, ["variant"])


# -- spaced masks -----------------------------------------------------------------------


def masked_places(regions: DataFrame, mask: str, tested: list[tuple[str, int]], variants: list[str]) -> DataFrame:
    """places() by the signatures of a mask: the first forward signature that a region holds once, and the variants one
    of whose tested(variant, code) it holds once, the strands of a window being two."""
    ones, span = S.informative(mask), len(mask)
    codes, at = 4 ** len(ones), {v: i for i, v in enumerate(variants)}
    ordered = sorted({(code, at[v]) for v, code in tested})
    known = np.array([c for c, _ in ordered], np.int64)
    owner_of = np.array([v for _, v in ordered], np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, seqs in _pieces(batch):
                pieces = [s for group in seqs for s in group]
                sizes = np.array([len(s) for s in pieces], np.int64)
                d = local._CODES[np.frombuffer("".join(pieces).encode("ascii", "replace"), np.uint8)]
                starts = np.repeat(np.cumsum(sizes) - sizes, np.maximum(sizes - span + 1, 0))
                many = np.maximum(sizes - span + 1, 0)
                off = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                owner = np.repeat(np.repeat(np.arange(len(seqs)), [len(g) for g in seqs]), many)
                code, good = np.zeros((2, len(off)), np.int64), np.ones((2, len(off)), bool)
                for p in ones:
                    for strand, digit in ((0, d[starts + off + p]), (1, d[starts + off + span - 1 - p])):
                        good[strand] &= digit < 4
                        code[strand] = code[strand] * 4 + (3 - digit if strand else digit)
                use = np.flatnonzero(good[0])
                _, first_at, count = np.unique(owner[use] * codes + code[0, use], return_index=True, return_counts=True)
                once = use[first_at[count == 1]]
                first = np.full(b - a, np.iinfo(np.int64).max)
                np.minimum.at(first, owner[once], off[once] + 1)
                keys = []
                for strand in (0, 1):
                    mine = np.flatnonzero(good[strand])
                    low = np.searchsorted(known, code[strand, mine])
                    mine = mine[(low < len(known)) & (known[np.minimum(low, len(known) - 1)] == code[strand, mine])] if len(known) else mine[:0]
                    keys.append((((owner[mine] * codes) + code[strand, mine]) * (sizes.max(initial=0) + 1) + off[mine]) * 2 + strand)
                every = np.unique(np.concatenate(keys)) // (2 * (sizes.max(initial=0) + 1))
                cell, count = np.unique(every, return_counts=True)
                region, hit_code = np.divmod(cell[count == 1], codes)
                low, high = np.searchsorted(known, hit_code), np.searchsorted(known, hit_code, "right")
                row = np.repeat(np.arange(len(region)), high - low)
                window = np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[row]
                hit = np.zeros((b - a, len(variants)), bool)
                hit[region[row], owner_of[window]] = True
                have = first < np.iinfo(np.int64).max
                yield pd.DataFrame({"region": batch["region"].iloc[a:b].to_numpy(object)[have], "offset": first[have], "matched": [x.tobytes() for x in np.packbits(hit[have], axis=1)]})

    return gathered(regions.select("region", "seq")).mapInPandas(run, "region string, offset long, matched binary")


# -- sums of design rows -------------------------------------------------------------------

SLICES = 64  # of the covariate's values, in which a pattern's median is looked for


def design_sums(regions: DataFrame, patterns: list[str], k: int) -> DataFrame:
    """pattern, allele, n, y, lp, sl, cpg_oe: sums of matching.design()'s rows of regions(region, seq, y, c), c or its pattern's median.

    Two readings of the letters: sums and counts by slices of c, then the values of the slice
    that holds a pattern's middle. Of rows that share a region each meets each, as in the join.
    """
    spark = regions.sparkSession
    asked = local.Asked(patterns, k, "reverse", False)
    clean = regions.select("region", "seq", "y", F.when(~F.isnan("c"), F.col("c")).alias("c"))
    cuts = clean.agg(F.percentile_approx("c", [i / SLICES for i in range(1, SLICES)], 10_000).alias("q")).first()["q"]
    bounds = np.array(sorted(set(cuts or [])), float)
    slices = len(bounds) + 1
    whole = gathered(clean, F.count("*").cast("double").alias("_m"), F.sum("y").alias("_y"), F.collect_list("c").alias("cs")).withColumn("_sl", S.region_length("region").cast("double"))

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            given = {c: batch[c].to_numpy(float) for c in ("_m", "_y", "_sl")}
            for a, b, seqs in _pieces(batch):
                region, pattern, allele, place, single = asked.found(seqs)
                region, pattern, allele, place = (x[single] for x in (region, pattern, allele, place))
                cs = [list(x) for x in batch["cs"].iloc[a:b]]
                sizes = np.array([len(x) for x in cs], np.int64)
                flat = np.array([v for x in cs for v in x], float)
                many = sizes[region]
                row = np.repeat(np.arange(len(region)), many)
                value = flat[np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + (np.cumsum(sizes) - sizes)[region][row]]
                m, y, sl = (given[c][a:b][region] for c in ("_m", "_y", "_sl"))
                yield pattern, allele, place, m, y, sl, many, pattern[row], value, m[row], allele[row]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = 4 * asked.n
        total, held_ = np.zeros((6, size)), np.zeros(asked.n * slices)
        for pattern, allele, place, m, y, sl, many, of, value, weight, own in alone(batches):
            cell = pattern * 4 + allele
            for i, w in enumerate((m * m, m * y, m * m * _folded(place, sl), m * m * sl, m * (m - many))):
                total[i] += np.bincount(cell, w, size)
            total[5] += np.bincount(of * 4 + own, weight * value, size)
            held_ += np.bincount(of * slices + np.searchsorted(bounds, value, "right"), weight, asked.n * slices)
        at = np.flatnonzero(total[0])
        if len(at):
            yield pd.DataFrame({"pattern": at // 4, "allele": at % 4, "sums": list(total[:, at].T)})
            some = np.unique(at // 4)
            yield pd.DataFrame({"pattern": some, "allele": np.full(len(some), -1), "sums": list(held_.reshape(asked.n, slices)[some])})

    rows = whole.mapInPandas(add, "pattern int, allele int, sums array<double>").groupBy("pattern", "allele").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(max(6, slices))]).alias("sums")).collect()
    cells = {(r["pattern"], r["allele"]): r["sums"][:6] for r in rows if r["allele"] >= 0}
    wanted, before = np.zeros((asked.n, slices), bool), {}
    for r in rows:
        if r["allele"] < 0 and any(cells.get((r["pattern"], a), [0] * 6)[4] for a in range(4)):
            run = np.cumsum(np.array(r["sums"][:slices], float))
            if run[-1]:
                low, high = (int(np.searchsorted(run, p, "right")) for p in ((run[-1] - 1) // 2, run[-1] // 2))
                wanted[r["pattern"], low : high + 1] = True
                before[r["pattern"]] = (run[low - 1] if low else 0.0, run[-1])

    def middle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for *_, of, value, weight, _ in alone(batches):
            use = wanted[of, np.searchsorted(bounds, value, "right")]
            yield pd.DataFrame({"pattern": of[use], "value": value[use], "w": weight[use]}).groupby(["pattern", "value"], as_index=False).sum()

    medians: dict[int, float] = {}
    if before:
        near = whole.mapInPandas(middle, "pattern int, value double, w double").groupBy("pattern", "value").agg(F.sum("w").alias("w"))
        run_ = near.withColumn("_run", F.sum("w").over(W.partitionBy("pattern").orderBy("value").rowsBetween(W.unboundedPreceding, 0)))
        ends = spark.createDataFrame([(p, float(b), float(n)) for p, (b, n) in before.items()], "pattern int, _b double, _n double")
        at = run_.join(F.broadcast(ends), "pattern").groupBy("pattern")
        here = F.col("_run") + F.col("_b")
        ends_ = at.agg(F.min(F.when(here > F.floor((F.col("_n") - 1) / 2), F.col("value"))).alias("a"), F.min(F.when(here > F.floor(F.col("_n") / 2), F.col("value"))).alias("b"))
        medians = {r["pattern"]: r["a"] + (r["b"] - r["a"]) / 2 for r in ends_.collect()}
    out = [(patterns[p], S.BASES[a], int(s[0]), s[1], s[2], s[3], s[5] + s[4] * medians.get(p, 0.0)) for (p, a), s in cells.items()]
    return spark.createDataFrame(out, "pattern string, allele string, n long, y double, lp double, sl double, cpg_oe double")
