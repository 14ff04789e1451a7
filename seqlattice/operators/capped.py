"""Cap curves of families whose design rows stay where a region is.

A repeat of a cap reads some ten of a family's rows, by their places among each allele's regions
in text order. So the regions are sorted once; each task counts its rows by family and allele,
the counts give every task the place of its first row, and in a second reading a task returns
the rows at drawn places only. The fits on all rows are made from sums (local.cells()).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from . import calibrate, local
from .background import seeded_places


class SummedDesign(calibrate.FamilyDesign):
    """A FamilyDesign known by the sums of each allele's rows (n, then local.COVARIATES and local.PAIRS); it holds drawn rows only."""

    def __init__(self, n: np.ndarray, sums: np.ndarray):
        self.counts = {b: int(m) for b, m in zip(S.BASES, n) if m}
        self.present = list(self.counts)
        self.ref = min(self.present, key=lambda a: (-self.counts[a], a))
        self.n = int(n.sum())
        at = {c: i for i, c in enumerate(local.COVARIATES)}
        pair = {p: len(at) + i for i, p in enumerate(local.PAIRS)}
        total = sums.sum(axis=0)
        mean = {c: total[at[c]] / self.n for c in ("lp", "sl", "y")}

        def centred(a: str, b: str) -> float:
            i, j = sorted((at[a], at[b]), reverse=True)
            return total[pair[i, j]] - self.n * mean[a] * mean[b]

        sd = {c: np.sqrt(max(centred(c, c), 0.0) / self.n) if centred(c, c) > 1e-12 * total[pair[at[c], at[c]]] else 0.0 for c in mean}
        self.y_sd = float(sd["y"]) if np.isfinite(sd["y"]) and sd["y"] > 1e-12 else 1.0
        self.scale = {c: (mean[c], sd[c]) for c in ("lp", "sl") if np.isfinite(sd[c]) and sd[c] > 0}
        self.at = {b: i for i, b in enumerate((b for b in self.present if b != self.ref), 1)}
        p = 1 + len(self.at) + len(self.scale)
        self.xx, self.xy = np.zeros((p, p)), np.zeros(p)  # of y less its mean
        self.xx[0, 0] = self.n
        for b, i in self.at.items():
            k = S.BASES.index(b)
            self.xx[i, i] = self.xx[0, i] = self.xx[i, 0] = n[k]
            self.xy[i] = sums[k, at["y"]] - n[k] * mean["y"]
            for j, (c, (m, s)) in enumerate(self.scale.items(), 1 + len(self.at)):
                self.xx[i, j] = self.xx[j, i] = (sums[k, at[c]] - n[k] * m) / s
        for i, (c, (_, s)) in enumerate(self.scale.items(), 1 + len(self.at)):
            self.xy[i] = centred(c, "y") / s
            for j, (d, (_, t)) in enumerate(self.scale.items(), 1 + len(self.at)):
                self.xx[i, j] = centred(c, d) / (s * t)
        self.yy, self.y_mean = max(centred("y", "y"), 0.0), mean["y"]
        self._contrasts(p)

    def fit(self, at: np.ndarray | None = None):
        if at is not None:
            return super().fit(at)
        if self.n <= len(self.xy) + 1:
            return None
        beta, _, rank, _ = np.linalg.lstsq(self.xx, self.xy, rcond=None)
        df = self.n - rank
        if rank < 2 or df <= 0:
            return None
        rest = max(self.yy - float(beta @ self.xy), 0.0)
        beta[0] += self.y_mean
        return beta, rest / df * np.linalg.pinv(self.xx), df

    def residual_ratio(self, fit) -> float:
        return math.sqrt(max(self.yy - float(fit[0] @ self.xy), 0.0) / self.n) / self.y_sd  # the intercept's part of xy is 0

    def hold(self, rows: pd.DataFrame) -> None:
        """The drawn rows(allele 0 to 3, at, lp, sl, y), at: the place among the allele's rows."""
        rows = rows.sort_values(["allele", "at"])
        code = rows["allele"].to_numpy()
        self.first = {b: int(np.searchsorted(code, S.BASES.index(b))) for b in self.present}
        self.places = {b: rows["at"].to_numpy()[code == S.BASES.index(b)] for b in self.present}
        columns = [np.ones(len(rows)), *[(code == S.BASES.index(b)).astype(float) for b in self.at]]
        columns += [(rows[c].to_numpy(float) - m) / s for c, (m, s) in self.scale.items()]
        self.x, self.y = np.column_stack(columns), rows["y"].to_numpy(float)

    def rows_at(self, drawn: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([self.first[a] + np.searchsorted(self.places[a], x) for a, x in drawn.items()])


def full_effects(regions: DataFrame, patterns: list[str], k: int, *, least: int = 30, doubles: bool = False) -> DataFrame:
    """calibrate.full_effects() of the families (patterns) of ``least`` rows and two alleles at least, of regions(region, seq, y).

    Fits of sums: no row of a design is shuffled or held.
    """
    found = local.cells(regions.withColumn("cpg_oe", F.lit(0.0)), patterns, k, alone=True, palindrome="forward", moments=True)
    cells = found.groupBy("pattern").agg(F.sum("n").alias("n"), F.collect_list(F.struct("allele", "n", "sums")).alias("cells"))
    cells = cells.where((F.col("n") >= least) & (F.size("cells") > 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                n, sums = np.zeros(4, np.int64), np.zeros((4, len(local.COVARIATES) + len(local.PAIRS)))
                for cell in row.cells:
                    i = S.BASES.index(cell["allele"])
                    n[i], sums[i] = cell["n"], cell["sums"]
                d = SummedDesign(n, sums)
                fit = d.fit()
                full = d.full(fit, doubles) if fit is not None else {}
                out += [(row.pattern, k, d.n, e, abs(e) / d.y_sd, log, d.y_sd, d.residual_ratio(fit)) for k, (e, log) in full.items()]
            yield pd.DataFrame(out, columns=["family", *(c.split()[0] for c in calibrate.FULL.split(", "))])

    return cells.mapInPandas(run, f"family string, {calibrate.FULL}")


def curves(regions: DataFrame, patterns: list[str], k: int, caps: list[int], *, least: int = 20, repeats: int = 50, seed: int = 1) -> DataFrame:
    """calibrate.curves() of the families (patterns) of ``least`` rows and two alleles at least, of regions(region, seq, y).

    Rows that share a key are one region and a row of the design each, in the order of y.
    """
    asked = local.Asked(patterns, k, "forward", False)
    found = local.cells(regions.withColumn("cpg_oe", F.lit(0.0)), patterns, k, alone=True, palindrome="forward", moments=True)
    number = {p: i for i, p in enumerate(patterns)}
    size = np.zeros((len(patterns), 4), np.int64)
    sums = np.zeros((len(patterns), 4, len(local.COVARIATES) + len(local.PAIRS)))
    for r in found.toLocalIterator():
        cell = number[r["pattern"]], S.BASES.index(r["allele"])
        size[cell], sums[cell] = r["n"], r["sums"]
    able = [p for p in range(len(patterns)) if size[p].sum() >= least and (size[p] > 0).sum() > 1]
    if not able:
        return regions.sparkSession.createDataFrame([], f"family string, {calibrate.CURVES}")
    whole = in_order(regions)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, part = np.zeros(4 * asked.n, np.int64), None
        for batch in batches:
            part = int(batch["_part"].iloc[0]) if len(batch) else part
            for cell, *_ in _rows_of(asked, batch):
                total += np.bincount(cell, minlength=len(total))
        if part is not None:
            yield pd.DataFrame({"part": [part], "counts": [total.astype(np.int32).tobytes()]})

    counted = {r["part"]: np.frombuffer(r["counts"], np.int32) for r in whole.mapInPandas(count, "part int, counts binary").toLocalIterator()}
    return _resampled(whole, asked, patterns, size, sums, able, counted, caps, repeats, seed)


def in_order(regions: DataFrame) -> DataFrame:
    """One row a region (its letters, its responses, its length, its task) of regions(region, seq, y), kept in text order."""
    whole = regions.select("region", F.coalesce("seq", F.lit("")).alias("seq"), "y").groupBy("region").agg(F.collect_list("seq").alias("seqs"), F.sort_array(F.collect_list("y")).alias("ys"))
    return whole.repartitionByRange("region").sortWithinPartitions("region").withColumn("_sl", S.region_length("region").cast("double")).withColumn("_part", F.spark_partition_id()).persist()


def _rows_of(asked, batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, ...]]:
    """(cell, lp, sl, y) of the design rows of in_order() rows, regions ascending."""
    length = batch["_sl"].to_numpy(float)
    for a, b in local._parts(batch["seqs"]):
        region, pattern, allele, place, single = asked.found([list(s) for s in batch["seqs"].iloc[a:b]])
        region, cell, place = region[single], (pattern * 4 + allele)[single], place[single]
        ys = [np.asarray(y, float) for y in batch["ys"].iloc[a:b]]
        many = np.array([len(y) for y in ys], np.int64)
        row = np.repeat(np.arange(len(region)), many[region])
        nth = np.arange(len(row)) - np.repeat(np.cumsum(many[region]) - many[region], many[region])
        y = np.concatenate(ys)[(np.cumsum(many) - many)[region[row]] + nth]
        sl = length[a:b][region[row]]
        lp = place[row] / sl
        yield cell[row], np.where(lp > 0.5, 1 - lp, lp), sl, y


def _resampled(whole: DataFrame, asked, names: list[str], size: np.ndarray, sums: np.ndarray, able: list[int], counted: dict[int, np.ndarray], caps: list[int], repeats: int, seed: int) -> DataFrame:
    """The curves of the able families of in_order() rows; size, sums: of their cells, counted: the rows by cell of each task."""
    spark, empty = whole.sparkSession, f"family string, {calibrate.CURVES}"
    if not able:
        return spark.createDataFrame([], empty)
    wanted = [np.zeros((2, 0), np.int64)]
    for p in able:
        sizes = {b: int(m) for b, m in zip(S.BASES, size[p]) if m}
        drawn = [seeded_places(sizes, cap, seed, (calibrate.CONTEXT, names[p], cap, i)) for cap in caps if size[p].sum() >= cap for i in range(repeats)]
        for b in sizes:
            at = np.unique(np.concatenate([d[b] for d in drawn])) if drawn else np.zeros(0, np.int64)
            wanted.append(np.stack([np.full(len(at), p * 4 + S.BASES.index(b)), at]))
    cell_of, place_of = np.concatenate(wanted, axis=1)
    starts, so_far = {}, np.zeros(4 * len(names), np.int64)
    for part in sorted(counted):
        starts[part] = so_far
        so_far = so_far + counted[part]

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start = None
        for batch in batches:
            if not len(batch):
                continue
            start = starts[int(batch["_part"].iloc[0])].copy() if start is None else start
            for cell, lp, sl, y in _rows_of(asked, batch):
                order = np.argsort(cell, kind="stable")
                c = cell[order]
                many = np.bincount(c, minlength=len(start))
                at = start[c] + np.arange(len(c)) - (np.cumsum(many) - many)[c]
                start += many
                here = _among(c, at, cell_of, place_of)
                use = order[here]
                if len(use):
                    yield pd.DataFrame({"pattern": c[here] // 4, "allele": c[here] % 4, "at": at[here], "lp": lp[use], "sl": sl[use], "y": y[use]})

    columns = [c.split()[0] for c in calibrate.CURVES.split(", ")]

    def evaluated(rows: pd.DataFrame) -> pd.DataFrame:
        p = int(rows["pattern"].iloc[0])
        d = SummedDesign(size[p], sums[p])
        fit = d.fit()
        full = d.full(fit) if fit is not None else {}
        d.hold(rows)
        out = [calibrate.evaluate(d.n, d, full, names[p], cap, repeats, seed) for cap in caps] if full else []
        return pd.DataFrame([(names[p], *(x[0][c] for c in columns)) for x in out if x], columns=["family", *columns]).astype(object)

    drawn = whole.mapInPandas(take, "pattern int, allele int, at long, lp double, sl double, y double")
    cores = spark.sparkContext.defaultParallelism  # a number of its own, as few bytes mean many fits
    return drawn.repartition(2 * cores, "pattern").groupBy("pattern").applyInPandas(evaluated, empty)


class MaskFamilies:
    """Families of spaced signatures with found(), as local.Asked has it of patterns; of rows (family, tested, allele, code), family: 'mask|shown'."""

    def __init__(self, rows: list[tuple[str, int, str, int]]):
        self.names = sorted({r[0] for r in rows})
        self.n, number = len(self.names), {f: i for i, f in enumerate(self.names)}
        by_mask: dict[str, list] = {}
        for family, tested, allele, code in rows:
            by_mask.setdefault(family.split("|")[0], []).append((code, number[family], S.BASES.index(allele), tested))
        self.masks = []
        for mask, asked in by_mask.items():
            code, *entries = np.array(sorted(asked), np.int64).T
            known, first = np.unique(code, return_index=True)
            self.masks.append((mask, known, np.append(first, len(code)), *entries))

    def found(self, seqs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(region number, family, allele, place, whether the allele alone hits the region), by region and family."""
        pieces = [s for group in seqs for s in group]
        sizes = np.array([len(s) + 1 for s in pieces], np.int64)
        d = local._CODES[np.frombuffer(("\n".join(pieces) + "\n").encode("ascii", "replace"), np.uint8)].astype(np.int32)
        first, several = np.cumsum(sizes) - sizes, np.array([len(g) > 1 for g in seqs], bool)
        owner_of = np.repeat(np.arange(len(seqs)), [len(g) for g in seqs])
        piece_at = np.repeat(np.arange(len(pieces)), sizes)
        left = np.repeat(first + sizes - 1, sizes) - np.arange(len(d))  # letters of the piece from here on
        parts = [(np.zeros(0, np.int64),) * 4]
        for mask, known, start, family, allele, tested in self.masks:
            cell, offset, strand = self._single(mask, known, d, left, first, piece_at, owner_of, several)
            region, code = np.divmod(cell, len(known))
            many = start[code + 1] - start[code]
            hit = np.repeat(np.arange(len(code)), many)
            entry = np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many) + start[code][hit]
            place = offset[hit] + np.where(strand[hit] == 1, len(mask) - 1 - tested[entry], tested[entry])
            parts.append((region[hit], family[entry], allele[entry], place))
        region, family, allele, place = (np.concatenate(x) for x in zip(*parts))
        group = region * self.n + family
        order = np.argsort(group, kind="stable")
        group = group[order]
        new = np.concatenate([[True], group[1:] != group[:-1], [True]]) if len(group) else np.ones(1, bool)
        return region[order], family[order], allele[order], place[order], new[:-1] & new[1:]

    @staticmethod
    def _single(mask, known, d, left, first, piece_at, owner_of, several):
        """(region number * codes + number of the code, offset from 1, strand) of the known codes that a region holds once."""
        ones, span = S.informative(mask), len(mask)
        n, width = max(len(d) - span + 1, 0), 4 ** len(ones)
        table = np.full(width, -1, np.int32) if width <= 1 << 20 else None
        if table is not None:
            table[known] = np.arange(len(known))
        rows = []
        for strand in (0, 1):
            code, good = np.zeros(n, np.int32 if len(ones) < 16 else np.int64), left[:n] >= span  # spacers may be any letter, but of the same piece
            for p in ones:
                digit = d[span - 1 - p :][:n] if strand else d[p:][:n]
                good &= digit < 4
                code = code * 4 + (3 - digit if strand else digit)
            at = np.flatnonzero(good)
            code = code[at]
            if table is not None:
                number = table[code]
                here = number >= 0
            else:
                number = np.minimum(np.searchsorted(known, code), len(known) - 1)
                here = known[number] == code
            at, piece = at[here], piece_at[at[here]]
            rows.append((owner_of[piece] * len(known) + number[here], at - first[piece] + 1, np.full(len(at), strand)))
        cell, offset, strand = (np.concatenate(x) for x in zip(*rows))
        shared = several[cell // len(known)]
        if shared.any():  # an occurrence that rows of one region share counts once
            same = np.unique(np.stack([cell[shared], offset[shared], strand[shared]]), axis=1)
            cell, offset, strand = (np.concatenate([x[~shared], y]) for x, y in zip((cell, offset, strand), same))
        once = np.bincount(cell)[cell] == 1
        return cell[once], offset[once], strand[once]


def mask_curves(regions: DataFrame, masks: list[str], n: int, *, least: int = 30, repeats: int = 50, seed: int = 1) -> tuple[pd.DataFrame, DataFrame]:
    """(one row a family, its curve at ``least`` less one rows) of n families of each mask, of regions(region, seq, y).

    As calibrate.minor_fraction(), full_effects() and curves() of the joined design rows give
    them, in two readings of the letters for all masks; no row but the drawn ones is shuffled.
    """
    whole = in_order(regions)
    given = whole.select("region", F.explode("seqs").alias("seq"))
    picked = reduce(DataFrame.unionByName, (calibrate.mask_families(given, m, n, seed) for m in masks))
    asked = MaskFamilies([tuple(r) for r in picked.select("family", "tested", "allele", "code").collect()])
    cells, width = 4 * asked.n, len(local.COVARIATES) + len(local.PAIRS)
    at = {c: i for i, c in enumerate(local.COVARIATES)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, sums, part = np.zeros(cells, np.int64), np.zeros((width, cells)), None
        for batch in batches:
            part = int(batch["_part"].iloc[0]) if len(batch) else part
            for cell, lp, sl, y in _rows_of(asked, batch):
                total += np.bincount(cell, minlength=cells)
                v = {"lp": lp, "sl": sl, "y": y}
                for c, x in v.items():
                    sums[at[c]] += np.bincount(cell, x, cells)
                for i, (a, b) in enumerate(local.PAIRS, len(at)):
                    a, b = local.COVARIATES[a], local.COVARIATES[b]
                    if a in v and b in v:
                        sums[i] += np.bincount(cell, v[a] * v[b], cells)
        here = np.flatnonzero(total)
        yield pd.DataFrame({"part": np.full(len(here), -1 if part is None else part), "cell": here, "n": total[here], "sums": list(sums[:, here].T)})

    each = whole.mapInPandas(count, "part int, cell int, n long, sums array<double>").persist()
    size, sums = np.zeros(cells, np.int64), np.zeros((cells, width))
    for r in each.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")).collect() if cells else ():
        size[r["cell"]], sums[r["cell"]] = r["n"], r["sums"]
    size, sums = size.reshape(-1, 4), sums.reshape(-1, 4, width)
    counted: dict[int, np.ndarray] = {r["_part"]: np.zeros(cells, np.int64) for r in whole.select("_part").distinct().collect()}
    for part, cell, m in each.select("part", "cell", "n").toPandas().itertuples(index=False):
        counted[part][cell] = m
    rows, able = [], []
    for p, name in enumerate(asked.names):
        d = SummedDesign(size[p], sums[p]) if size[p].any() else None
        fit = d.fit() if d else None
        ratio = d.residual_ratio(fit) if fit is not None and d.full(fit) else math.nan
        own = size[p][size[p] > 0]
        if d and d.n >= least and len(own) > 1 and not math.isnan(ratio):
            able.append(p)
        rows.append((name.split("|")[0], name, int(size[p].sum()), len(own), own.min() / own.sum() if len(own) > 1 else math.nan, ratio, able[-1:] == [p]))
    out = pd.DataFrame(rows, columns=["mask", "family", "n_probes", "n_alleles", "minor_allele_fraction", "residual_sd_ratio", "eligible"])
    return out, _resampled(whole, asked, asked.names, size, sums, able, counted, [least - 1], repeats, seed)


def _among(cell: np.ndarray, at: np.ndarray, cell_of: np.ndarray, place_of: np.ndarray) -> np.ndarray:
    """Which (cell, at) stand in the sorted pairs (cell_of, place_of)."""
    if not len(cell) or not len(cell_of):
        return np.zeros(0, np.int64)
    width = int(max(at.max(), place_of.max())) + 1
    key, known = cell * width + at, cell_of * width + place_of
    low = np.minimum(np.searchsorted(known, key), len(known) - 1)
    return np.flatnonzero(known[low] == key)
