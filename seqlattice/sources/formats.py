"""Readers of the text formats, as projections of lines(ord, line); bad lines are skipped.

ord is the line's place in its file, which decides between lines of one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequence import informative


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """ord, line of a text file; ord follows the file, as splits are numbered in file order."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.col("value").alias("line"))


def _content(lines: DataFrame, comments: bool = True) -> DataFrame:
    rows = lines.where(F.trim(F.regexp_replace("line", r"\s", "")) != "")
    return rows.where(~F.ltrim("line").startswith("#")) if comments else rows


def _parts(lines: DataFrame, sep: str = r"\s+") -> DataFrame:
    text = F.regexp_replace("line", r"^\s+|\s+$", "") if sep == r"\s+" else F.regexp_replace("line", r"[\r\n]+$", "")
    return lines.withColumn("p", F.split(text, sep, -1))


def _double(c):
    """A floating-point number in text, null where it isn't one."""
    t = F.lower(F.trim(c))
    plain = t.rlike(r"^[+-]?(\d+\.?\d*([e][+-]?\d+)?|\.\d+([e][+-]?\d+)?|inf(inity)?|nan)$")
    word = F.regexp_replace(F.regexp_replace(t, "^[+]", ""), "inf(inity)?", "Infinity")
    return F.when(plain, F.when(t.rlike("nan"), F.lit(float("nan"))).otherwise(word.try_cast("double")))


def _long(c):
    t = F.trim(c)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("long"))


def bed(lines: DataFrame) -> DataFrame:
    """ord, chrom, start, end: the first three fields, split at any white space; # lines are comments."""
    rows = _parts(_content(lines)).where(F.size("p") >= 3)
    out = rows.select("ord", F.col("p")[0].alias("chrom"), _long(F.col("p")[1]).alias("start"), _long(F.col("p")[2]).alias("end"))
    return out.where("start is not null and end is not null")


def bed_once(lines: DataFrame) -> DataFrame:
    """ord, chrom, start, end, fields of tab-split lines, the first line of each key."""
    rows = _parts(_content(lines), "\t").where(F.size("p") >= 3)
    keyed = rows.select("ord", F.col("p")[0].alias("chrom"), F.col("p")[1].alias("start"), F.col("p")[2].alias("end"), F.col("p").alias("fields"))
    first = F.row_number().over(W.partitionBy("chrom", "start", "end").orderBy("ord"))
    return keyed.withColumn("_at", first).where("_at = 1").select("ord", "chrom", _long(F.col("start")).alias("start"), _long(F.col("end")).alias("end"), "fields").where("start is not null and end is not null")


def _last(rows: DataFrame) -> DataFrame:
    """region, value, ord: the last value of a region, in the place of its first line."""
    return rows.groupBy("region").agg(F.max_by("value", "ord").alias("value"), F.min("ord").alias("ord"))


def intensities(lines: DataFrame) -> DataFrame:
    """region, value, ord of 'region value' lines."""
    rows = _parts(_content(lines, False)).where(F.size("p") >= 2)
    return _last(rows.select("ord", F.col("p")[0].alias("region"), _double(F.col("p")[1]).alias("value")).where("value is not null"))


def wide_intensities(lines: DataFrame) -> DataFrame:
    """intensities() that also takes 'chrom start end value' lines and # comments."""
    rows = _parts(lines.where(~F.col("line").startswith("#") & (F.trim(F.regexp_replace("line", r"\s", "")) != ""))).where(F.size("p") >= 2)
    keyed = F.col("p")[0].contains(":") & F.col("p")[0].contains("-")
    region = F.when(keyed, F.col("p")[0]).when(F.size("p") >= 4, F.concat(F.col("p")[0], F.lit(":"), F.col("p")[1], F.lit("-"), F.col("p")[2]))
    value = F.when(keyed, _double(F.col("p")[1])).when(F.size("p") >= 4, _double(F.get("p", F.lit(3))))
    return _last(rows.select("ord", region.alias("region"), value.alias("value")).where("region is not null and value is not null"))


def kmer_array(lines: DataFrame, strict: bool = False) -> DataFrame:
    """kmer, region, offset of the entries 'region;1;offset' of 'kmer<TAB>entry,entry,...' lines.

    Entries of other counts are dropped. strict: lines of exactly one tab, entries of exactly one offset.
    """
    rows = lines.withColumn("p", F.split(F.trim("line"), "\t", -1 if strict else 2)).where(F.size("p") == 2)
    entries = rows.select("ord", F.col("p")[0].alias("kmer"), F.explode(F.split(F.col("p")[1], ",")).alias("e")).where("e <> ''")
    parts = entries.withColumn("e", F.split("e", ";")).where(F.size("e") == 3)
    offset = F.trim(F.col("e")[2])
    found = parts.select("ord", "kmer", F.col("e")[0].alias("region"), _long(F.col("e")[1]).alias("n"), _long(offset).cast("int").alias("offset")).where("n = 1 and offset is not null")
    return found.groupBy("kmer", "region").agg(F.max_by("offset", "ord").alias("offset"))


def bedgraph(lines: DataFrame) -> DataFrame:
    """chrom, start, end, value of bedGraph lines; track and browser lines are skipped, '.' is 0."""
    rows = _parts(_content(lines).where(~F.col("line").rlike("^(track|browser)"))).where(F.size("p") >= 4)
    value = F.when(F.col("p")[3] == ".", F.lit(0.0)).otherwise(_double(F.col("p")[3]))
    out = rows.select(F.col("p")[0].alias("chrom"), _long(F.col("p")[1]).alias("start"), _long(F.col("p")[2]).alias("end"), value.alias("value"))
    return out.where("start is not null and end is not null and value is not null")


def openness(rows: DataFrame) -> tuple[DataFrame, str | None]:
    """(region, open) of bed_once() rows and the name of the column it is read from, None if none serves.

    Eight fields: the eighth; ten or more: the seventh; else of the fields from the fourth on
    the one that is most often a number, in 80 % of the lines at least, the leftmost of equals.
    One aggregate decides.
    """
    first = rows.orderBy("ord").select(F.size("fields").alias("n")).first()
    n = first["n"] if first else 0
    at, name = (7, "smoothed_peak_height") if n == 8 else (6, "signalValue") if n >= 10 else (None, None)
    if at is None:
        if n < 4:
            return rows.select(F.lit(None).cast("string").alias("region"), F.lit(None).cast("double").alias("open")).limit(0), None
        rates = rows.agg(*[(F.count(_double(F.get("fields", F.lit(j)))) / F.sum((F.size("fields") > j).cast("int"))).alias(str(j)) for j in range(3, n)]).first()
        best = max(range(3, n), key=lambda j: (rates[str(j)] or 0.0, -j))
        if (rates[str(best)] or 0.0) < 0.8:
            return rows.select(F.lit(None).cast("string").alias("region"), F.lit(None).cast("double").alias("open")).limit(0), None
        at, name = best, f"col{best + 1}"
    region = F.concat("chrom", F.lit(":"), "start", F.lit("-"), "end")
    return rows.select(region.alias("region"), _double(F.get("fields", F.lit(at))).alias("open")).where("open is not null"), name


def variant_list(lines: DataFrame) -> DataFrame:
    """ord, variant: trimmed, not blank, in order."""
    return lines.select("ord", F.trim("line").alias("variant")).where("variant <> ''")


def fasta(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """chrom, start (0-based), seq (upper case): contigs in chunks of a fixed length."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    name = F.regexp_extract("value", r"^\s*(\S+)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", ""))
    rows = records.select(name.alias("chrom"), seq.alias("s"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("s") - 1), F.lit(chunk))
    return rows.withColumn("start", F.explode(starts)).select("chrom", F.col("start").cast("long").alias("start"), F.substring(F.col("s"), F.col("start") + 1, F.lit(chunk)).alias("seq"))


def sequences(intervals: DataFrame, genome: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """intervals(chrom, start, end, ...) with seq, the bases of [start, end), short at a contig's ends.

    An interval is joined to the chunks that it touches, by equality.
    """
    keys = intervals.select("chrom", "start", "end").distinct()
    touched = F.sequence(F.floor(F.greatest(F.lit(0), F.col("start")) / chunk), F.greatest(F.floor(F.greatest(F.lit(0), F.col("start")) / chunk), F.floor((F.col("end") - 1) / chunk)))
    rows = keys.withColumn("_chunk", F.explode(touched)).join(genome.select("chrom", F.floor(F.col("start") / chunk).alias("_chunk"), F.col("start").alias("_from"), F.col("seq").alias("_s")), ["chrom", "_chunk"])
    first = F.greatest(F.col("start"), F.col("_from")) - F.col("_from")
    size = F.least(F.col("end"), F.col("_from") + F.length("_s")) - F.greatest(F.col("start"), F.col("_from"))
    part = F.substring(F.col("_s"), first.cast("int") + 1, F.greatest(F.lit(0), size).cast("int"))
    joined = rows.select("chrom", "start", "end", F.struct("_chunk", part.alias("s")).alias("p")).groupBy("chrom", "start", "end").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return intervals.join(joined.select("chrom", "start", "end", F.concat_ws("", F.transform("p", lambda x: x["s"])).alias("seq")), ["chrom", "start", "end"])


def parse_masks(text: str) -> list[str]:
    """Masks of a comma, space or line separated text with # comments, in order, each once."""
    items = [x for line in text.splitlines() for x in line.split("#")[0].replace(",", " ").split()]
    for m in items:
        informative(m)
    out = list(dict.fromkeys(items))
    if not out:
        raise ValueError("at least one mask is needed")
    return out


def controls_without(controls: list[str], candidates: list[str]) -> list[str]:
    return [m for m in dict.fromkeys(controls) if m not in set(candidates)]


def parse_caps(text: str) -> list[int]:
    caps = sorted({int(x) for x in text.split(",") if x.strip()})
    if not caps or caps[0] < 10:
        raise ValueError("caps are integers of 10 or more")
    return caps
