"""The tasks over files: array, intensities, snv, scan, motifs, calibrate.

Each task is a typed set of options and a function (spark, options) that returns the text of
its report, or writes its files. Everything but the formatting of a report is a dataflow.
Seeded sampling (``rng="seeded"``) reproduces draws by key order and needs the k-mer index on
every worker, so it is refused beyond ``SEEDED_PAIRS`` pairs; ``rng="hash"`` has no bound.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sequence as S
from .operators import background, calibrate, fits, index, matching, motif, ranking, selection, signal
from .sources import bigwig, formats

SEEDED_PAIRS = 5_000_000
WINDOW = ["variant", "motif_pos"]


class OptionError(ValueError):
    """Options that don't fit together."""


@dataclass
class Options:
    def __post_init__(self) -> None:
        kinds = {f.name: str(f.type) for f in fields(self)}
        for name, kind in kinds.items():
            value = getattr(self, name)
            if isinstance(value, str) and value and kind.startswith(("int", "float")):
                setattr(self, name, float(value) if kind.startswith("float") else int(value))
            if kind.startswith("int") and isinstance(value, bool):
                raise OptionError(f"{name} is a number")
        self.check()

    def need(self, *names: str) -> None:
        if missing := [n for n in names if not getattr(self, n)]:
            raise OptionError("missing: " + ", ".join(missing))

    def one_of(self, name: str, *values: str) -> None:
        if getattr(self, name) not in values:
            raise OptionError(f"{name} is one of {', '.join(values)}, not {getattr(self, name)}")

    def check(self) -> None: ...


@dataclass
class ArrayOptions(Options):
    bed: str | None = None
    genome: str | None = None
    output: str | None = None
    kmer_size: int = 8

    def check(self) -> None:
        self.need("bed", "genome", "output")


@dataclass
class IntensityOptions(Options):
    bed: str | None = None
    signal: str | None = None
    output: str | None = None
    genome: str | None = None
    summary: str = "max"
    window_bp: int = 100
    no_residualize: bool = False
    resid_use_length: bool = False
    resid_open: str = "off"
    resid_output: str = "resid_log"

    def check(self) -> None:
        self.need("bed", "signal", "output")
        self.one_of("summary", *signal.SUMMARIES)
        self.one_of("resid_open", "auto", "off", "force")
        self.one_of("resid_output", "resid_log", "log_corrected", "intensity_like")
        if not self.no_residualize and not self.genome:
            raise OptionError("a genome is needed unless no_residualize is set")


@dataclass
class MatchOptions(Options):
    intensities: str | None = None
    array: str | None = None
    genome: str | None = None
    kmer_size: int = 8
    mode: str = "ols"
    rand_n: int = 500
    no_rand: bool = False
    best_pval: bool = False
    holm: bool = False
    diagnostics: bool = False
    no_covariates: bool = False
    no_cpg_covariate: bool = False
    raw_lp: bool = False
    seed: int = 0
    max_probes: int | None = None
    rng: str = "seeded"

    def check(self) -> None:
        self.need("intensities", "genome")
        self.one_of("mode", "ols", "nb")
        self.one_of("rng", "seeded", "hash")
        if self.diagnostics and not self.best_pval:
            raise OptionError("diagnostics needs best_pval")
        if self.max_probes is not None and self.max_probes <= 0:
            raise OptionError("max_probes is positive")

    @property
    def covariates(self) -> tuple[str, ...]:
        return () if self.no_covariates else ("lp", "sl") if self.no_cpg_covariate else ("lp", "sl", "cpg_oe")


@dataclass
class VariantOptions(MatchOptions):
    snv_list: str | None = None
    snv_list_file: str | None = None
    mask: str | None = None

    def check(self) -> None:
        super().check()
        if bool(self.snv_list) == bool(self.snv_list_file):
            raise OptionError("one of snv_list and snv_list_file is needed")
        if self.mask:
            S.informative(self.mask)
        else:
            self.need("array")


@dataclass
class ScanOptions(MatchOptions):
    region: str | None = None
    reverse: bool = False
    pooled: bool = False

    def check(self) -> None:
        super().check()
        self.need("array", "region")
        if self.holm and (self.pooled or not self.best_pval):
            raise OptionError("holm needs best_pval and excludes pooled")


@dataclass
class MotifOptions(Options):
    intensities: str | None = None
    array: str | None = None
    genome: str | None = None
    mask: str | None = None
    seed: str | None = None
    kmer_size: int = 8
    combine_revcomp: bool = True
    min_F: int = 20
    max_gaps: int = 3
    min_per_base: int = 20
    min_support: int = 1
    pseudocount: float = 0.0
    beta: float = 10.0
    auto_max_steps: int = 20
    extend_left: int = -1
    extend_right: int = -1
    ic_stop_threshold: float = 0.2
    ic_stop_consecutive: int = 2
    mask_candidate_probes: int = 5000
    mask_max_candidates: int = 10000
    top_n_report: int = 50

    def check(self) -> None:
        self.need("intensities", "genome" if self.mask else "array")
        if self.mask:
            S.informative(self.mask)


@dataclass
class CapOptions(Options):
    intensities: str | None = None
    array: str | None = None
    kmer_size: int = 8
    caps: str = "100,200,400,600,800,1000,1250,1500,2000,2500"
    n_families: int = 100
    repeats: int = 50
    seed: int = 1
    min_probes: int = 50
    max_effect_sd: float = 0.1
    max_effect_bias: float = 0.1
    min_eligible_fraction: float = 0.5
    borderline_tolerance: float = 0.05
    no_covariates: bool = False

    def check(self) -> None:
        self.need("intensities", "array")
        formats.parse_caps(self.caps)


@dataclass
class MaskOptions(Options):
    intensities: str | None = None
    genome: str | None = None
    masks: str | None = None
    control_masks: str = ""
    random_controls: int = 0
    n_families: int = 500
    repeats: int = 50
    seed: int = 1
    min_probes: int = 50
    stability_probes: int = 100
    candidate_multiplier: int = 5
    min_eligible_fraction: float = 0.5
    near_optimal_tolerance: float = 0.05
    no_covariates: bool = False

    def check(self) -> None:
        self.need("intensities", "genome", "masks")
        formats.parse_masks(self.masks)
        if self.stability_probes < 10:
            raise OptionError("stability_probes is 10 at least")


# -- array and intensities ------------------------------------------------------


def run_array(spark: SparkSession, o: ArrayOptions) -> DataFrame:
    """Writes the k-mer array of a BED file's regions; returns the k-mers that it lacks."""
    rows = formats.bed(formats.read_lines(spark, o.bed))
    once = rows.groupBy("chrom", "start", "end").agg(F.min("ord").alias("ord"))
    regions = formats.sequences(once, formats.fasta(spark, o.genome)).withColumn("region", F.concat("chrom", F.lit(":"), "start", F.lit("-"), "end"))
    table = index.inverted_index(regions, o.kmer_size)
    text = index.index_text(table, regions.select("region", "ord"))
    text.select(F.concat("kmer", F.lit("\t"), "entries").alias("value")).coalesce(1).write.mode("overwrite").text(o.output)
    return index.missing_kmers(table, o.kmer_size)


def run_intensities(spark: SparkSession, o: IntensityOptions) -> DataFrame:
    """region, value of a BED file's regions under a signal track; written to the output."""
    rows = formats.bed_once(formats.read_lines(spark, o.bed))
    packed = bigwig.is_bigwig(o.signal)
    track = bigwig.read_bigwig(spark, o.signal) if packed else formats.bedgraph(formats.read_lines(spark, o.signal))
    found = signal.summarise(rows.select("chrom", "start", "end"), track, o.summary, o.window_bp, weighted=packed)
    out = found.withColumn("region", F.concat("chrom", F.lit(":"), "start", F.lit("-"), "end"))
    if not o.no_residualize:
        out = formats.sequences(out, formats.fasta(spark, o.genome)).withColumn("gc", S.gc_fraction("seq"))
        covariates = ["gc"]
        if o.resid_use_length:
            out, covariates = out.withColumn("length", (F.col("end") - F.col("start")).cast("double")), ["gc", "length"]
            if o.resid_open != "off":
                opened, name = formats.openness(rows)
                out = out.join(opened.groupBy("region").agg(F.last("open").alias("_open")), "region", "left").withColumn("open", F.log1p(F.greatest("_open", F.lit(0.0))))
                whole = name is not None and out.where("open is null or isnan(open)").isEmpty()
                if whole:
                    covariates.append("open")
                elif o.resid_open == "force":
                    raise OptionError("the openness column is missing or incomplete")
        out = fits.residualize(out, covariates, o.resid_output).withColumn("value", F.col("corrected"))
    out = out.select("chrom", "start", "end", "region", "value").orderBy("chrom", "start", "end").select("region", "value")
    out.coalesce(1).write.mode("overwrite").option("sep", "\t").csv(o.output)
    return out


# -- variants -------------------------------------------------------------------------


def variant_windows(spark: SparkSession, named: DataFrame, genome: DataFrame, k: int) -> DataFrame:
    """variant, ord, seq (2k-1 bases), at, ref, alt, strand checked; variants that fit neither strand are left out."""
    parts = S.parse_variant("variant")
    rows = named.select("ord", "variant", *[c.alias(n) for n, c in parts.items()]).where("pos is not null")
    at = rows.withColumn("start", F.col("pos") - k).withColumn("end", F.col("pos") + k - 1).where("start >= 0")
    found = formats.sequences(at, genome).where(F.length("seq") == 2 * k - 1)
    flipped = S.reverse_complement("seq")
    fits_ = F.when(F.substring("seq", k, 1) == F.col("ref"), F.col("seq")).when(F.substring(flipped, k, 1) == F.col("ref"), flipped)
    return found.withColumn("seq", fits_).where("seq is not null").select("ord", "variant", "seq", F.lit(k - 1).alias("at"), "ref", "alt")


def _universe(spark: SparkSession, path: str) -> list[tuple[str, list[tuple[str, int]]]]:
    """The array's k-mers with their single occurrences, in file order."""
    out = []
    for row in formats.read_lines(spark, path).orderBy("ord").toLocalIterator():
        kmer, _, entries = row["line"].strip().partition("\t")
        single = [(p[0], int(p[2])) for p in (e.split(";") for e in entries.split(",")) if len(p) == 3 and p[1] == "1"]
        if single:
            out.append((kmer, single))
        if sum(len(s) for _, s in out[-1:]) and len(out) % 4096 == 0 and sum(len(s) for _, s in out) > SEEDED_PAIRS:
            raise OptionError("the array is too large for seeded sampling; use rng: hash")
    return out


def _cut(matches: DataFrame, names: DataFrame, o: MatchOptions, context) -> DataFrame:
    """matches, subsampled to max_probes a window if that is set. context(key, row of names) names the draw."""
    if o.max_probes is None:
        return matches
    if o.rng == "hash":
        return background.stratified_subsample(matches, WINDOW, o.max_probes, o.seed)

    columns, cap, seed = list(matches.columns), o.max_probes, o.seed

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        lookup: dict[str, dict[str, int]] = {}
        for a, r, p in zip(group["allele"], group["region"], group["place"]):
            lookup.setdefault(a, {})[r] = int(p)
        kept = background.seeded_subsample(lookup, cap, seed, context(group.iloc[0]))
        return group[[r in kept.get(a, {}) for a, r in zip(group["allele"], group["region"])]][columns]

    return matches.join(names, WINDOW).groupBy(*WINDOW).applyInPandas(draw, matches.schema)


class Analysis:
    """Affinity and background rows of variants(variant, ord, seq, at, ref, alt)."""

    def __init__(self, spark: SparkSession, o: MatchOptions, mask: str | None = None):
        self.spark, self.o, self.mask = spark, o, mask
        self.k = len(mask) if mask else o.kmer_size
        self.intensity = formats.intensities(formats.read_lines(spark, o.intensities)).persist()
        self.genome = formats.fasta(spark, o.genome).persist()
        self.index = None if mask else formats.kmer_array(formats.read_lines(spark, o.array)).persist()

    def regions(self) -> DataFrame:
        parts = self.intensity.select("region", "ord", *[S.region_part("region", p).alias(p) for p in ("chrom", "start", "end")]).where("start is not null")
        return formats.sequences(parts, self.genome).select("region", "ord", "seq")

    def context(self) -> DataFrame | None:
        return self.regions().select("region", S.cpg_observed_expected("seq").alias("cpg_oe")) if "cpg_oe" in self.o.covariates else None

    def design(self, found: DataFrame, by: list[str]) -> DataFrame:
        out = matching.design(found, by, self.intensity, self.context())
        if self.o.raw_lp:
            out = out.join(matching.unambiguous(found, by).select(*by, "region", "place"), [*by, "region"]).withColumn("lp", F.col("place") / F.col("sl")).drop("place")
        return out

    def affinity(self, variants: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rows, matches, design) of the windows over each variant's base."""
        windows = matching.variant_windows(variants, self.k)
        found = matching.masked_match(windows, self.regions(), self.mask, WINDOW) if self.mask else matching.match(windows, self.index, self.k, WINDOW)
        found = found.persist()
        names = windows.select(*WINDOW, "seq", "j").distinct()
        cut = _cut(found, names, self.o, lambda r: ("AFF", r["seq"], int(r["motif_pos"]), int(r["j"])))
        design = self.design(cut, WINDOW).join(variants.select("variant", "ref"), "variant").persist()
        rows = fits.affinity(design, WINDOW, F.col("ref"), covariates=self.o.covariates, mode=self.o.mode)
        shown = S.masked_display("kmer", self.mask, F.col("j")) if self.mask else S.replaced("kmer", F.col("j"), ".")
        return rows.join(windows.select(*WINDOW, shown.alias("wildcard_kmer")), WINDOW), found, design

    def background(self, variants: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rows, hits, background) of every window's regression against sampled regions."""
        o, k = self.o, self.k
        cut = _cut(found, found.select(*WINDOW).distinct(), o, lambda r: ("RAND", r["variant"], int(r["motif_pos"])))
        if o.rng == "seeded" and not self.mask:
            universe = self.spark.sparkContext.broadcast(_universe(self.spark, o.array))

            def draw(group: pd.DataFrame) -> pd.DataFrame:
                name = group["variant"].iloc[0]
                drawn = background.seeded_background(universe.value, list(range(k)), set(group["region"].dropna()), name, o.rand_n)
                return pd.DataFrame([(name, p, r, off + p) for p, regions in drawn.items() for r, off in regions.items()], columns=["variant", "motif_pos", "region", "place"])

            asked = variants.select("variant").distinct().join(found.select("variant", "region").distinct(), "variant", "left")
            bg = asked.groupBy("variant").applyInPandas(draw, "variant string, motif_pos int, region string, place int")
        else:
            tokens = index.masked_tokens(self.regions(), self.mask).where("not is_reverse").withColumnRenamed("code", "key") if self.mask else self.index.withColumnRenamed("kmer", "key")
            places = tokens.groupBy("region").agg(F.min_by("offset", F.xxhash64("key")).alias("offset"))
            drawn = background.sample_background(variants, found, places, k, o.rand_n, o.seed)
            tested = matching.variant_windows(variants, k).select(*WINDOW, "j") if self.mask else None
            bg = drawn.join(tested, WINDOW).select(*WINDOW, "region", (F.col("offset") + F.col("j")).alias("place")) if self.mask else drawn.select(*WINDOW, "region", (F.col("offset") + F.col("motif_pos")).alias("place"))
        bg = bg.persist()
        return background.against_background(cut, bg, WINDOW, self.intensity, mode=o.mode), cut, bg

    def rows(self, variants: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(AFF and RAND rows with alleles and adjusted p, diagnostics by window, label and allele)."""
        aff, found, design = self.affinity(variants)
        names = variants.select("variant", "ord", "ref", "alt")
        out = aff.select(*WINDOW, "allele", "coef", "pval", "wildcard_kmer", F.lit("AFF").alias("label"))
        counts = design.groupBy(*WINDOW, "allele").agg(F.count("*").alias("n_allele"))
        diagnostics = counts.join(design.groupBy(*WINDOW).agg(F.count("*").alias("n_probes")), WINDOW).withColumn("label", F.lit("AFF"))
        if not self.o.no_rand and self.o.rand_n > 0:
            rand, hits, bg = self.background(variants, found)
            out = out.unionByName(rand.select(*WINDOW, "allele", "coef", "pval", F.lit(None).cast("string").alias("wildcard_kmer"), F.lit("RAND").alias("label")))
            value = self.intensity.where(selection.finite("value").isNotNull()).select("region")
            single = matching.unambiguous(hits, WINDOW).join(value, "region")
            plain = bg.join(hits.select(*WINDOW, "region").distinct(), [*WINDOW, "region"], "left_anti").join(value, "region")
            total = single.select(*WINDOW, "region").unionByName(plain.select(*WINDOW, "region")).groupBy(*WINDOW).agg(F.count("*").alias("n_probes"))
            per = single.groupBy(*WINDOW, "allele").agg(F.count("*").alias("n_allele"))
            alleles = total.withColumn("allele", F.explode(F.array(*map(F.lit, S.BASES))))
            diagnostics = diagnostics.unionByName(alleles.join(per, [*WINDOW, "allele"], "left").select(*WINDOW, "allele", F.coalesce("n_allele", F.lit(0)).alias("n_allele"), "n_probes", F.lit("RAND").alias("label")))
        return selection.holm_within_variant(out.join(names, "variant")), diagnostics


def _p(x: float | None) -> str:
    return "NA" if x is None or not math.isfinite(x) else "<1e-300" if x <= 0 else f"{x:.3e}"


def report_windows(rows: DataFrame, holm: bool) -> str:
    """One line a variant, kind, allele and window."""
    kind = F.when((F.col("label") == "AFF") & (F.col("allele") == F.col("alt")), 0).when((F.col("label") == "RAND") & (F.col("allele") == F.col("ref")), 1).when((F.col("label") == "RAND") & (F.col("allele") == F.col("alt")), 2)
    lines = ["snv\ttype\tallele\tmotif_pos\twildcard_kmer\teffect\tpval" + "\traw_pval" * holm]
    for r in rows.withColumn("_kind", kind).where("_kind is not null").orderBy("ord", "_kind", "motif_pos").toLocalIterator():
        coef = "NA" if r["coef"] is None or not math.isfinite(r["coef"]) else f"{r['coef']:.7g}"
        p = [_p(r["pval_holm"]), _p(r["pval"])] if holm else [_p(r["pval"])]
        lines.append("\t".join([r["variant"], r["label"], r["allele"], str(r["motif_pos"]), r["wildcard_kmer"] or "NA", coef, *p]))
    return "\n".join(lines) + "\n"


def report_best(rows: DataFrame, diagnostics: DataFrame | None, o: MatchOptions) -> str:
    """Three lines a variant at its best window."""
    out = selection.summary_rows(rows, o.holm)
    shown = rows.where("label = 'AFF'").groupBy(*WINDOW).agg(F.first("wildcard_kmer").alias("wildcard_kmer"))
    out = out.join(shown, WINDOW, "left").join(rows.select("variant", "ord").distinct(), "variant")
    if o.diagnostics:
        out = out.join(diagnostics, [*WINDOW, "label", "allele"], "left")
    lines = ["snv\ttype\tallele\teffect\tpval" + "\traw_pval" * o.holm + "\tmotif_pos\twildcard_kmer\tn_probes\tn_allele" * o.diagnostics]
    for r in out.orderBy("ord", "line").toLocalIterator():
        if r["label"] == "RAND" and o.no_rand:
            continue
        parts = [r["variant"], r["label"], r["allele"], repr(r["effect"]) if r["effect"] is not None else "nan", _p(r["pval"])]
        parts += [_p(r["raw_pval"])] if o.holm else []
        parts += [str(r["motif_pos"]), r["wildcard_kmer"] or "NA", *("NA" if r[c] is None else str(r[c]) for c in ("n_probes", "n_allele"))] if o.diagnostics else []
        lines.append("\t".join(parts))
    return "\n".join(lines) + "\n"


def run_variants(spark: SparkSession, o: VariantOptions) -> str:
    a = Analysis(spark, o, o.mask)
    lines = formats.read_lines(spark, o.snv_list_file) if o.snv_list_file else spark.createDataFrame(list(enumerate(o.snv_list.split(","))), "ord long, line string")
    named = formats.variant_list(lines)
    if named.isEmpty():
        raise OptionError("the list of variants is empty")
    variants = variant_windows(spark, named, a.genome, a.k).persist()
    rows, diagnostics = a.rows(variants)
    return report_best(rows, diagnostics, o) if o.best_pval else report_windows(rows, o.holm)


SCAN_COLUMNS = ["wildcard_kmer", "filled_kmer", "window_index", "snp_index", "type", "allele", "coef", "pval", "absolute_pos", "method"]


def run_scan(spark: SparkSession, o: ScanOptions) -> str:
    a = Analysis(spark, o)
    chrom, start, end = (spark.range(1).select(S.region_part(F.lit(o.region), p).alias("v")).first()["v"] for p in ("chrom", "start", "end"))
    asked = spark.createDataFrame([(chrom, start - 1, end)], "chrom string, start long, end long")
    seq = formats.sequences(asked, a.genome).first()["seq"]
    if o.reverse:
        seq = motif.reverse_complement(seq)
    if o.holm:
        return _holm_scan(spark, o, a, chrom, start, end, seq)
    interval = spark.createDataFrame([(o.region, seq)], "interval string, seq string")
    windows = matching.interval_windows(interval, o.kmer_size).persist()
    by = ["motif_pos", "j"]
    found = matching.match(windows, a.index, o.kmer_size, by, last_strand=True, palindrome="both")
    design = a.design(found, by).join(windows.select(*by, "kmer"), by).withColumn("ref", F.substring(F.col("kmer"), F.col("j") + 1, F.lit(1)))
    if o.pooled:
        rows = design.withColumn("position", F.col("motif_pos") + F.col("j")).withColumn("window", F.format_string("(%d, %d)", "motif_pos", "j"))
        fitted = fits.pooled(rows, ["position"], covariates=() if o.no_covariates else ("lp", "sl"), mode=o.mode)
        first = windows.groupBy((F.col("motif_pos") + F.col("j")).alias("position")).agg(F.min(F.struct(*by, "kmer")).alias("w"))
        out = fitted.join(first, "position").select(S.replaced("w.kmer", F.col("w.j"), ".").alias("wildcard_kmer"), F.col("w.kmer").alias("filled_kmer"), F.col("position").alias("window_index"), F.lit(0).alias("snp_index"), F.lit("AFF").alias("type"), "allele", F.coalesce("effect", F.lit(math.nan)).alias("coef"), F.coalesce("pval", F.lit(math.nan)).alias("pval"), F.col("position").alias("absolute_pos"), F.lit(f"pooled_{o.mode}").alias("method"))
        order = ["window_index", "allele"]
    else:
        fitted = fits.affinity(design.drop("kmer"), by, F.col("ref"), covariates=o.covariates, mode=o.mode).join(windows.select(*by, "kmer"), by)
        if o.best_pval:
            fitted = selection.best_p(fitted.withColumn("position", F.col("motif_pos") + F.col("j") + 1), ["position", "allele"])
        out = fitted.select(S.replaced("kmer", F.col("j"), ".").alias("wildcard_kmer"), S.replaced("kmer", F.col("j"), F.col("allele")).alias("filled_kmer"), F.col("motif_pos").alias("window_index"), F.col("j").alias("snp_index"), F.lit("AFF").alias("type"), "allele", "coef", "pval", (F.col("motif_pos") + F.col("j")).alias("absolute_pos"), "method")
        order = ["absolute_pos", "allele"] if o.best_pval else ["window_index", "snp_index", "allele"]
    lines = ["\t".join(SCAN_COLUMNS)]
    for r in out.orderBy(*order).toLocalIterator():
        lines.append("\t".join("NA" if r[c] is None else "NaN" if isinstance(r[c], float) and math.isnan(r[c]) else str(r[c]) for c in SCAN_COLUMNS))
    return "\n".join(lines) + "\n\n"


def _holm_scan(spark: SparkSession, o: ScanOptions, a: Analysis, chrom: str, start: int, end: int, seq: str) -> str:
    named = [(f"{chrom}:{end - i if o.reverse else start + i}:{ref}>{alt}",) for i, ref in enumerate(seq) if ref in S.BASES for alt in S.BASES if alt != ref]
    rows = spark.createDataFrame([(i, *n) for i, n in enumerate(named)], "ord long, variant string")
    variants = variant_windows(spark, rows, a.genome, o.kmer_size).persist()
    if variants.count() < len(named):
        raise OptionError("a scanned base has too little sequence around it")
    found, diagnostics = a.rows(variants)
    return report_best(found, diagnostics, o)


# -- motifs and calibration ----------------------------------------------------------------


def run_motifs(spark: SparkSession, o: MotifOptions) -> dict[str, pd.DataFrame | str]:
    """ppm, reduced_full, top_escores (without a given seed), meme, consensus."""
    values = formats.wide_intensities(formats.read_lines(spark, o.intensities)).persist()
    ranks = ranking.global_rank(values, "value", "ord").persist()
    s = motif.Settings(o.min_per_base, o.min_support, o.pseudocount, o.beta, o.max_gaps, o.auto_max_steps, o.ic_stop_threshold, o.ic_stop_consecutive)
    out: dict[str, pd.DataFrame | str] = {}
    order = [F.desc("E"), "gaps", F.desc("F"), "kmer"]
    if o.mask:
        parts = values.select("region", *[S.region_part("region", p).alias(p) for p in ("chrom", "start", "end")])
        regions = formats.sequences(parts, formats.fasta(spark, o.genome)).select("region", "seq").persist()
        hits_of = lambda asked: index.masked_hits(regions, o.mask, asked, by_strand=False)
        if o.seed is None:
            codes = motif.mask_candidates(index.masked_tokens(regions, o.mask), ranks, o.mask_candidate_probes, o.mask_max_candidates)
            top = motif.mask_seeds(hits_of(codes), ranks, o.mask, o.min_F).where("E is not null").orderBy(F.desc("E"), F.desc("F"), "kmer")
            out["top_escores"] = top.limit(o.top_n_report).toPandas()
            if not len(out["top_escores"]):
                raise OptionError("no masked candidate has enough regions")
            seed = out["top_escores"]["kmer"][0].replace(".", "")
        else:
            ones, raw = S.informative(o.mask), o.seed.strip().upper()
            seed = raw if len(raw) == len(ones) else "".join(raw[i] for i in ones) if len(raw) == len(o.mask) else ""
            if not seed or set(seed) - set(S.BASES):
                raise OptionError("a masked seed has A, C, G or T at every one of the mask")
        found = motif.mask_wobble(seed, hits_of, ranks, o.mask, s)
        found.reduced = [dict(r, side="core", step=r["pos"], gaps_used=o.mask.count("0")) for r in found.reduced]
    else:
        table = formats.kmer_array(formats.read_lines(spark, o.array), strict=True).where(F.length("kmer") == o.kmer_size)
        sets = ranking.probe_sets(table, o.combine_revcomp).join(values.select("region"), "region", "left_semi").select("kmer", "region").persist()
        seed = o.seed.strip().upper() if o.seed else None
        if seed is None:
            top = ranking.choose_seed(sets, ranks, o.kmer_size, min_f=o.min_F, max_gaps=o.max_gaps).orderBy(*order)
            out["top_escores"] = top.limit(o.top_n_report).toPandas()
            if not len(out["top_escores"]):
                raise OptionError("no k-mer has enough regions")
            seed = out["top_escores"]["kmer"][0]
        s.max_gaps = max(0, min(o.max_gaps, o.kmer_size - 1))
        found = motif.build(seed, sets, ranks, s, o.extend_left, o.extend_right)
    out["ppm"] = pd.DataFrame([(p, *found.ppm[p]) for p in sorted(found.ppm)], columns=["pos", *S.BASES])
    out["reduced_full"] = pd.DataFrame(found.reduced)
    out["consensus"] = "".join(c if not o.mask or o.mask[i] == "1" else "." for i, c in enumerate(found.consensus))
    out["meme"] = meme(found.ppm, out["consensus"])
    return out


def meme(ppm: dict[int, list[float]], name: str) -> str:
    """The matrix in the MEME text format, version 4."""
    lines = ["MEME version 4", "", "ALPHABET= ACGT", "", "strands: + -", "", "Background letter frequencies", "A 0.25 C 0.25 G 0.25 T 0.25", "", f"MOTIF {name}", f"letter-probability matrix: alength= 4 w= {len(ppm)} nsites= {len(ppm)} E= 0"]
    return "\n".join([*lines, *(" ".join(f"{x:.6f}" for x in ppm[p]) for p in sorted(ppm))]) + "\n"


def run_caps(spark: SparkSession, o: CapOptions) -> dict[str, pd.DataFrame]:
    """recommendation, summary, family_curves, contrasts, pvalue_quartiles."""
    caps = formats.parse_caps(o.caps)
    table = formats.kmer_array(formats.read_lines(spark, o.array)).persist()
    values = formats.intensities(formats.read_lines(spark, o.intensities))
    names = sorted(r["family"] for r in calibrate.families(table, o.kmer_size).toLocalIterator())  # k 4**(k-1) at most
    import numpy as np

    np.random.default_rng(o.seed).shuffle(names)
    order = spark.createDataFrame(list(enumerate(names)), "at long, family string")
    found = calibrate.family_matches(order, table, o.kmer_size)
    single = matching.unambiguous(found, ["family"]).join(values.select("region", F.col("value").alias("y")), "region").where(S.region_part("region", "end").isNotNull())
    size = S.region_length("region")
    design = single.select("family", "region", "allele", "place", "y", S.folded_place(F.col("place"), size).alias("lp"), size.cast("double").alias("sl"))
    able = design.groupBy("family").agg(F.count("*").alias("n_probes_available"), F.count_distinct("allele").alias("n")).where((F.col("n_probes_available") >= o.min_probes) & (F.col("n") > 1))
    full = calibrate.full_effects(design.join(able.select("family"), "family", "left_semi"), covariates=not o.no_covariates).persist()
    chosen = able.join(full.select("family").distinct(), "family").join(order, "family").orderBy("at").limit(o.n_families).persist()
    if chosen.isEmpty():
        raise OptionError("no family has enough regions")
    curves, contrasts = calibrate.curves(design.join(F.broadcast(chosen.select("family")), "family"), caps, repeats=o.repeats, seed=o.seed, covariates=not o.no_covariates, keep=True)
    summary = calibrate.cap_summary(curves, chosen, caps)
    recommended = calibrate.recommend_cap(summary, o.max_effect_sd, o.max_effect_bias, o.min_eligible_fraction, o.borderline_tolerance)
    kept = full.join(chosen.select("family", "at"), "family").orderBy("at", "contrast").drop("at", "y_sd", "residual_sd_ratio")
    limits = {"borderline_relative_tolerance": o.borderline_tolerance, "max_effect_sd_norm_p90": o.max_effect_sd, "max_effect_bias_norm_p90": o.max_effect_bias, "min_eligible_fraction": o.min_eligible_fraction}
    return {"recommendation": recommended.toPandas().assign(**limits), "summary": summary.orderBy("cap_probes").toPandas(), "family_curves": curves.join(chosen.select("family", "at"), "family").orderBy("at", "cap_probes").drop("at").toPandas(), "contrasts": kept.toPandas(), "pvalue_quartiles": calibrate.quartile_summary(contrasts).orderBy("effect_quartile", "cap_probes").toPandas()}


def run_masks(spark: SparkSession, o: MaskOptions) -> dict[str, pd.DataFrame | dict]:
    """recommendation, summary, families, family_curves of candidate, control and matched random masks."""
    a = MatchOptions(intensities=o.intensities, genome=o.genome)
    values = formats.intensities(formats.read_lines(spark, a.intensities)).persist()
    parts = values.select("region", *[S.region_part("region", p).alias(p) for p in ("chrom", "start", "end")])
    regions = formats.sequences(parts, formats.fasta(spark, o.genome)).select("region", "seq").persist()
    candidates = formats.parse_masks(o.masks)
    controls = formats.controls_without(formats.parse_masks(o.control_masks), candidates) if o.control_masks.strip() else []
    families_, curves_ = [], []

    def evaluate(masks: list[str], role: str, source: str, first: int) -> None:
        for no, mask in enumerate(masks, first):
            asked = calibrate.mask_families(regions, mask, max(o.n_families * o.candidate_multiplier, o.n_families + 50), o.seed + no * 100003).persist()
            hits = index.masked_hits(regions, mask, asked, by_strand=True)
            found = asked.join(hits, "code").select("family", "allele", "region", S.wildcard_place(F.col("offset"), F.col("tested"), len(mask), F.col("is_reverse")).alias("place"))
            size = S.region_length("region")
            design = matching.unambiguous(found, ["family"]).join(values.select("region", F.col("value").alias("y")), "region").select("family", "region", "allele", "place", "y", S.folded_place(F.col("place"), size).alias("lp"), size.cast("double").alias("sl")).persist()
            full = calibrate.full_effects(design, covariates=not o.no_covariates).groupBy("family").agg(F.max("residual_sd_ratio").alias("residual_sd_ratio"))
            rows = asked.select("family", "tested").distinct().join(calibrate.minor_fraction(design, ["family"]), "family", "left").join(full, "family", "left")
            ok = (F.col("n_probes") >= max(o.min_probes, o.stability_probes + 1)) & (F.col("n_alleles") > 1) & F.col("residual_sd_ratio").isNotNull()
            rows = rows.withColumn("eligible", F.coalesce(ok, F.lit(False))).persist()
            use = rows.where("eligible").orderBy("family").limit(o.n_families).select("family")
            curves = calibrate.curves(design.join(F.broadcast(use), "family"), [o.stability_probes], repeats=o.repeats, seed=o.seed, covariates=not o.no_covariates)[0]
            named = {"mask": mask, "mask_role": role, "control_source": source}
            families_.append(rows.withColumnRenamed("n_probes", "n_probes_available").toPandas().assign(**named))
            curves_.append(curves.toPandas().assign(**named))
            for d in (asked, design, rows):
                d.unpersist()

    evaluate(candidates, "candidate", "candidate", 1)
    evaluate(controls, "control", "explicit", 1 + len(candidates))
    judge = lambda: calibrate.recommend_mask(calibrate.mask_summary(pd.concat(families_), pd.concat(curves_)), o.min_eligible_fraction, o.near_optimal_tolerance)
    summary, best = judge()
    if o.random_controls and best["recommended_mask"]:
        drawn = calibrate.random_masks(best["recommended_mask"], o.random_controls, o.seed + 700001, tuple(candidates + controls))
        evaluate(drawn, "control", "random", 1 + len(candidates) + len(controls))
        summary, best = judge()
    return {"recommendation": best, "summary": summary, "families": pd.concat(families_), "family_curves": pd.concat(curves_)}
