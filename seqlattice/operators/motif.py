"""Motif discovery: wobble the seed, extend its flanks, stitch a probability matrix.

The sets of regions behind a pattern are DataFrames; a wobble of all positions is one job, and
an extension step is one job over the cached pairs (k-mer, region). What comes back to the
driver is a handful of rows a step: four bases with counts and scores.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.stats import normal_two_sided
from .ranking import disjoint, reduced_scores

BASES = S.BASES


@dataclass
class Settings:
    min_per_base: int = 20
    min_support: int = 1
    pseudocount: float = 0.0
    beta: float = 10.0
    max_gaps: int = 3
    max_steps: int = 20
    ic_stop_threshold: float = 0.2
    ic_stop_consecutive: int = 2


@dataclass
class Motif:
    """ppm: place -> probabilities of A, C, G, T; reduced: rows of the score table."""

    ppm: dict[int, list[float]] = field(default_factory=dict)
    reduced: list[dict] = field(default_factory=list)

    @property
    def consensus(self) -> str:
        return "".join(BASES[int(np.argmax(self.ppm[p]))] for p in sorted(self.ppm))


def reverse_complement(s: str) -> str:
    return s.translate(str.maketrans("ACGTacgt", "TGCAtgca"))[::-1]


def information(p: list[float], eps: float = 1e-12) -> float:
    """1 less the entropy over its maximum."""
    v = np.clip(np.asarray(p, float), eps, 1.0)
    v = v / v.sum()
    return float(1 + (v * np.log(v)).sum() / math.log(4))


def softmax(scores: list[float], beta: float) -> list[float]:
    x = beta * np.asarray(scores, float)
    w = np.exp(x - np.nanmax(x))
    return (w / w.sum()).tolist()


def bits(ppm: dict[int, list[float]], eps: float = 1e-12) -> dict[int, list[float]]:
    """Letter heights in bits: p x (2 - entropy)."""
    out = {}
    for place, p in ppm.items():
        v = np.asarray(p, float)
        v = np.clip(v / v.sum() if v.sum() else v * math.nan, eps, 1.0)
        out[place] = (v * (2 + (v * np.log2(v)).sum())).tolist()
    return out


def reversed_ppm(ppm: dict[int, list[float]]) -> dict[int, list[float]]:
    """The matrix of the other strand, from place 0."""
    return {i: ppm[p][::-1] for i, p in enumerate(sorted(ppm, reverse=True))}


def reversed_reduced(rows: list[dict]) -> list[dict]:
    """The score table of the other strand: the i-th smallest place becomes the i-th largest."""
    places = sorted({r["pos"] for r in rows})
    to, base = dict(zip(places, reversed(places))), dict(zip(BASES, reversed(BASES)))
    return sorted(({**r, "pos": to[r["pos"]], "base": base.get(r["base"], r["base"])} for r in rows), key=lambda r: (r["pos"], str(r.get("side", "")), r["base"]))


def _pattern_sets(sets: DataFrame, patterns: dict[tuple[int, str], str], both_strands: bool) -> DataFrame:
    """group, base, region of the regions whose k-mer (or its reverse complement) fits each pattern."""
    spark = sets.sparkSession
    asked = []
    for (group, base), p in patterns.items():
        for q in {p, reverse_complement(p)} if both_strands else {p}:
            asked.append((group, base, "".join("1" if c != "." else "0" for c in q), q))
    out = None
    for shape in sorted({a[2] for a in asked}):  # patterns of one shape are one equality join
        fixed = tuple(i for i, c in enumerate(shape) if c == "1")
        wanted = F.broadcast(spark.createDataFrame([(g, b, q) for g, b, s, q in asked if s == shape], "group int, base string, pattern string"))
        part = sets.withColumn("pattern", S.gapped("kmer", fixed, len(shape))).join(wanted, "pattern").select("group", "base", "region")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _scores(sets: DataFrame, ranks: DataFrame, patterns: dict[tuple[int, str], str], both_strands: bool, least: int) -> dict[int, dict[str, dict]]:
    """group -> base -> F, B, E_reduced, p."""
    found = reduced_scores(disjoint(_pattern_sets(sets, patterns, both_strands), ["group"]), ranks, ["group"], least).collect()
    out: dict[int, dict[str, dict]] = {g: {b: {"F": 0, "B": 0, "E_reduced": math.nan, "p": math.nan} for b in BASES} for g, _ in patterns}
    for r in found:
        e = out[r["group"]][r["base"]]
        e["F"] = r["F"]
        if r["E_reduced"] is not None:
            e |= {"B": r["B"], "E_reduced": r["E_reduced"], "p": float(normal_two_sided(np.array([r["z"]]))[0])}
    return out


def probabilities(scores: dict[str, dict], seed_base: str | None, s: Settings) -> list[float]:
    """Softmax over the bases with a score; without two supported ones, the only supported base, the seed's, or even."""
    good = [b for b in BASES if scores[b]["F"] >= s.min_per_base]
    if len(good) >= 2:
        es = [scores[b]["E_reduced"] if math.isfinite(scores[b]["E_reduced"]) else -0.5 for b in BASES]
        p = [x if math.isfinite(scores[b]["E_reduced"]) else 0.0 for b, x in zip(BASES, softmax(es, s.beta))]
    else:
        p = [0.0] * 4
    if sum(p) > 0:
        p = [x / sum(p) for x in p]
    else:
        some = [b for b in BASES if scores[b]["F"] >= s.min_support]
        one = some[0] if len(some) == 1 else seed_base
        p = [float(b == one) for b in BASES] if one in BASES else [0.25] * 4
    if s.pseudocount > 0:
        p = [x + s.pseudocount for x in p]
        p = [x / sum(p) for x in p]
    return p


def wobble(seed: str, sets: DataFrame, ranks: DataFrame, s: Settings) -> Motif:
    """The matrix of the seed, all places in one job. A seed without gaps asks for the literal
    variant only; one with gaps for either strand.
    """
    patterns = {(i, b): seed[:i] + b + seed[i + 1 :] for i in range(len(seed)) for b in BASES}
    found = _scores(sets, ranks, patterns, "." in seed, s.min_per_base)
    out = Motif()
    for i in range(len(seed)):
        supported = sum(found[i][b]["F"] >= s.min_per_base for b in BASES) >= 2
        for b in BASES:
            e = found[i][b]
            has = supported and e["F"] >= s.min_per_base
            out.reduced.append({"pos": i, "base": b, "variant": patterns[i, b], "E_reduced": e["E_reduced"] if has else math.nan, "p": e["p"] if has else math.nan, "F": e["F"], "B": e["B"] if has else 0})
            if not has:
                e["E_reduced"] = math.nan
        out.ppm[i] = probabilities(found[i], seed[i], s)
    return out


def extend(window: str, probs: list[list[float]], sets: DataFrame, ranks: DataFrame, side: str, s: Settings, steps: int) -> tuple[list[list[float]], list[dict]]:
    """(probabilities from the core outward, score rows) of one flank.

    A step adds a base; the least informative places of the rest become gaps, as few as give
    every base its support. All numbers of gaps are asked in one job. It ends without support,
    or at the ic_stop_consecutive-th step in a row of too little information.
    """
    flank: list[list[float]] = []
    rows: list[dict] = []
    low = 0
    for step in range(steps):
        anchor, known = (window[1:], probs[1:]) if side == "right" else (window[:-1], probs[:-1])
        order = sorted(range(len(anchor)), key=lambda i: information(known[i]))
        most = min(s.max_gaps, len(anchor))
        patterns = {}
        for gaps in range(most + 1):
            a = "".join("." if i in order[:gaps] else c for i, c in enumerate(anchor))
            patterns |= {(gaps, b): a + b if side == "right" else b + a for b in BASES}
        found = _scores(sets, ranks, patterns, True, 1)
        gaps = next((g for g in range(most + 1) if all(found[g][b]["F"] >= s.min_per_base for b in BASES)), None)
        if gaps is None:
            break
        p = softmax([found[gaps][b]["E_reduced"] for b in BASES], s.beta)
        ic = information(p)
        if ic < s.ic_stop_threshold:
            low += 1
            if low >= s.ic_stop_consecutive:
                break
        else:
            low = 0
        flank.append(p)
        rows += [{"step": step, "side": side, "gaps_used": gaps, "base": b, "variant": patterns[gaps, b], "E_reduced": found[gaps][b]["E_reduced"], "p": found[gaps][b]["p"], "F": found[gaps][b]["F"], "B": found[gaps][b]["B"], "IC": ic} for b in BASES]
        best = BASES[int(np.argmax(p))]
        window, probs = (anchor + best, known + [p]) if side == "right" else (best + anchor, [p] + known)
    return flank, rows


def build(seed: str, sets: DataFrame, ranks: DataFrame, s: Settings, left: int = -1, right: int = -1) -> Motif:
    """Core and flanks; left and right are numbers of steps, -1 for as far as support goes."""
    core = wobble(seed, sets, ranks, s)
    k, window, probs = len(seed), core.consensus, [core.ppm[i] for i in range(len(seed))]
    out = Motif(dict(core.ppm), [dict(r, side="core", step=r["pos"], gaps_used=seed.count(".")) for r in core.reduced])
    for side, steps in (("left", left), ("right", right)):
        if not steps:
            continue
        flank, rows = extend(window, probs, sets, ranks, side, s, s.max_steps if steps < 0 else steps)
        place = {i: -1 - i if side == "left" else k + i for i in range(len(flank))}
        out.ppm |= {place[i]: p for i, p in enumerate(flank)}
        rows = [dict(r, pos=place[r["step"]]) for r in rows]
        out.reduced = rows + out.reduced if side == "left" else out.reduced + rows
    return out


def greedy_flank(seed: str, sets: DataFrame, ranks: DataFrame, side: str, s: Settings, steps: int, combine_revcomp: bool = True) -> tuple[list[list[float]], str]:
    """(probabilities from the core outward, last window) by exact k-mers only."""
    window, flank = seed, []
    for _ in range(steps):
        names = {b: b + window[:-1] if side == "left" else window[1:] + b for b in BASES}
        key = {b: min(n, reverse_complement(n)) if combine_revcomp else n for b, n in names.items()}
        found = _scores(sets, ranks, {(0, b): key[b] for b in BASES}, False, 1)[0]
        if any(found[b]["F"] < s.min_per_base for b in BASES):
            break
        flank.append(softmax([found[b]["E_reduced"] for b in BASES], s.beta))
        window = names[BASES[int(np.argmax(flank[-1]))]]
    return flank, window


# -- spaced masks -----------------------------------------------------------


def mask_candidates(tokens: DataFrame, ranks: DataFrame, top: int, most: int) -> DataFrame:
    """code, n of the signatures that occur in most of the ``top`` first regions; ties by code."""
    best = ranks.where(F.col("rank") < max(1, top)).select("region")
    return tokens.select("region", "code").distinct().join(best, "region").groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(max(1, most))


def mask_seeds(hits: DataFrame, ranks: DataFrame, mask: str, min_f: int) -> DataFrame:
    """kmer, code, E, F, gaps of candidate signatures, for ordering by E, F and pattern."""
    from .ranking import scored

    out = scored(hits, ranks, ["code"], min_f)
    return out.select(S.signature_pattern("code", mask).alias("kmer"), "code", "E", "F", F.lit(len(mask) - len(S.informative(mask))).alias("gaps"))


def mask_wobble(seed: str, hits_of, ranks: DataFrame, mask: str, s: Settings) -> Motif:
    """The matrix of a masked seed: ones are wobbled, spacers are even.

    seed: the ones' bases; hits_of(codes DataFrame) gives (code, region) of single hits.
    """
    ones = S.informative(mask)
    digit = {b: i for i, b in enumerate(BASES)}

    def code(text: str) -> int:
        return sum(digit[c] << 2 * (len(text) - 1 - i) for i, c in enumerate(text))

    variants = [(i, b, code(seed[:i] + b + seed[i + 1 :])) for i in range(len(ones)) for b in BASES]
    asked = ranks.sparkSession.createDataFrame(variants, "group int, base string, code long")
    sets = hits_of(asked).select("code", "region").join(F.broadcast(asked), "code").select("group", "base", "region")
    found: dict[int, dict[str, dict]] = {i: {b: {"F": 0, "B": 0, "E_reduced": math.nan, "p": math.nan} for b in BASES} for i in range(len(ones))}
    for r in reduced_scores(disjoint(sets, ["group"]), ranks, ["group"], s.min_per_base).collect():
        e = found[r["group"]][r["base"]]
        e["F"] = r["F"]
        if r["E_reduced"] is not None:
            e |= {"B": r["B"], "E_reduced": r["E_reduced"], "p": float(normal_two_sided(np.array([r["z"]]))[0])}
    out = Motif()
    for place in range(len(mask)):
        if place not in ones:
            out.ppm[place] = [0.25] * 4
            out.reduced += [{"pos": place, "base": b, "variant": mask, "E_reduced": 0.0, "p": math.nan, "F": 0, "B": 0, "masked_spacer": True} for b in BASES]
            continue
        i = ones.index(place)
        supported = sum(found[i][b]["F"] >= s.min_per_base for b in BASES) >= 2
        for b in BASES:
            e = found[i][b]
            has = supported and e["F"] >= s.min_per_base
            shown = ["."] * len(mask)
            for j, c in zip(ones, seed[:i] + b + seed[i + 1 :]):
                shown[j] = c
            out.reduced.append({"pos": place, "base": b, "variant": "".join(shown), "E_reduced": e["E_reduced"] if has else math.nan, "p": e["p"] if has else math.nan, "F": e["F"], "B": e["B"] if has else 0, "masked_spacer": False})
            if not has:
                e["E_reduced"] = math.nan
        out.ppm[place] = probabilities(found[i], seed[i], s)
    return out
