"""Column functions on base strings."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_order(*parts: Column | str | int) -> Column:
    """A text that orders rows at random but alike everywhere: the MD5 of the parts joined by '|'."""
    return F.md5(F.concat_ws("|", *[F.lit(str(x)) if isinstance(x, int) else _col(x).cast("string") for x in parts]))


def text_number(*parts: Column | str | int) -> Column:
    """The first 15 hex digits of text_order() as a long below 2**60."""
    return F.conv(F.substring(text_order(*parts), 1, 15), 16, 10).cast("long")


def reverse_complement(seq: Column | str) -> Column:
    """Reversed complement; case is kept and other characters pass through."""
    return F.reverse(F.translate(_col(seq), "ACGTacgt", "TGCAtgca"))


def canonical(kmer: Column | str) -> Column:
    """The smaller of a k-mer (or one-wildcard pattern) and its reverse complement."""
    return F.least(_col(kmer), reverse_complement(kmer))


def windows(seq: Column | str, k: int) -> Column:
    """array<struct<offset,kmer>> of all windows of k characters; offsets are 1-based."""
    s = _col(seq)
    starts = F.when(F.length(s) >= k, F.sequence(F.lit(1), F.length(s) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("offset"), F.substring(s, i, F.lit(k)).alias("kmer")))


def kmers(seq: Column | str, k: int) -> Column:
    """windows() of the upper-case sequence that hold A, C, G and T only; offsets count dropped windows too."""
    return F.filter(windows(F.upper(_col(seq)), k), lambda w: w["kmer"].rlike("^[ACGT]+$"))


def replaced(kmer: Column | str, place: Column | int, base: Column | str) -> Column:
    """kmer with the character at 0-based place replaced."""
    at = F.lit(place) if isinstance(place, int) else place
    with_ = F.lit(base) if isinstance(base, str) else base
    return F.concat(F.substring(_col(kmer), F.lit(1), at), with_, F.substring(_col(kmer), at + 2, F.length(_col(kmer))))


def gap_masks(k: int, gaps: int) -> list[tuple[int, ...]]:
    """The places left fixed by every choice of that many gaps among k places."""
    return [tuple(i for i in range(k) if i not in gone) for gone in combinations(range(k), gaps)]


def gapped(kmer: Column | str, fixed: tuple[int, ...], k: int) -> Column:
    """kmer with '.' at all places but the fixed ones."""
    return F.concat(*[F.substring(_col(kmer), i + 1, 1) if i in fixed else F.lit(".") for i in range(k)])


def gc_fraction(seq: Column | str) -> Column:
    """(C + G) / (A + C + G + T), 0 where there is none; other letters don't count."""
    s = F.upper(_col(seq))
    good, of = (F.regexp_count(s, F.lit(p)) for p in ("[CG]", "[ACGT]"))
    return F.when(of > 0, good / of).otherwise(F.lit(0.0))


def cpg_observed_expected(seq: Column | str) -> Column:
    """Occurrences of CG x length / (C x G), 0 without C or without G; the length counts all letters."""
    s = F.upper(_col(seq))
    cg, c, g = (F.regexp_count(s, F.lit(p)) for p in ("CG", "C", "G"))
    return F.when((c > 0) & (g > 0), cg * F.length(s) / (c * g)).otherwise(F.lit(0.0))


def region_part(region: Column | str, part: str) -> Column:
    """chrom, start or end of 'chrom:start-end'; null where it can't be read. The chromosome may hold a colon."""
    found = F.regexp_extract(_col(region), r"^(.*):(-?\d+)-(-?\d+)$", {"chrom": 1, "start": 2, "end": 3}[part])
    found = F.when(found != "", found)
    return found if part == "chrom" else found.cast("long")


def region_length(region: Column | str, otherwise: int = 200) -> Column:
    """end - start, 1 at least; a fixed value where the key can't be read."""
    size = region_part(region, "end") - region_part(region, "start")
    return F.when(size.isNull(), F.lit(otherwise).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), size))


def folded_place(place: Column, length: Column) -> Column:
    """place / length, folded around one half."""
    p = place / length
    return F.when(p > 0.5, 1.0 - p).otherwise(p)


def wildcard_place(offset: Column, j: Column | int, k: int, is_reverse: Column) -> Column:
    """Place of wildcard j of a k-mer that begins at offset, on either strand."""
    j = F.lit(j) if isinstance(j, int) else j
    return F.when(is_reverse, offset + (k - 1) - j).otherwise(offset + j)


def base_code(base: Column | str) -> Column:
    """1 to 4 of A, C, G, T, 0 of others: a number, so that its minimum is a hash aggregate."""
    return F.instr(F.lit("ACGT"), _col(base))


def base_of(code: Column) -> Column:
    return F.substring(F.lit("ACGT"), code, F.lit(1))


def one_hot(value: Column | str, levels: tuple[str, ...] = BASES, prefix: str = "") -> list[Column]:
    return [(_col(value) == F.lit(v)).cast("double").alias(f"{prefix}{v}") for v in levels]


def parse_variant(text: Column | str) -> dict[str, Column]:
    """chrom, pos, ref, alt of 'chrom:pos:ref>alt', alleles in upper case; null where it can't be read."""
    pattern = r"^([^:]*):(\d+):([^>]*)>(.*)$"
    parts = {n: F.regexp_extract(_col(text), pattern, i) for i, n in enumerate(("chrom", "pos", "ref", "alt"), 1)}
    good = F.coalesce(_col(text).rlike(pattern), F.lit(False))
    out = {n: F.when(good, c) for n, c in parts.items()}
    out["pos"] = out["pos"].cast("long")
    out["ref"], out["alt"] = F.upper(F.trim(out["ref"])), F.upper(F.trim(out["alt"]))
    return out


# -- spaced masks ---------------------------------------------------------


def informative(mask: str) -> tuple[int, ...]:
    """Places of the ones of a mask of 2 to 31 ones."""
    mask = mask.strip()
    if not mask or set(mask) - {"0", "1"}:
        raise ValueError("a mask holds 0 and 1 only, and at least one of them")
    ones = tuple(i for i, c in enumerate(mask) if c == "1")
    if not 2 <= len(ones) <= 31:
        raise ValueError("a mask has 2 to 31 ones")
    return ones


def signature(window: Column | str, mask: str) -> Column:
    """The ones' bases as 2 bits each (A 0, C 1, G 2, T 3), first base highest; null if one of them is another letter."""
    at = set(informative(mask))
    digits = F.translate(F.upper(_col(window)), "ACGT0123", "0123....")
    shape = "".join("(.)" if p in at else "." for p in range(len(mask)))
    ones = F.regexp_replace(digits, f"^{shape}$", "".join(f"${i + 1}" for i in range(len(at))))
    good = (F.length(_col(window)) == len(mask)) & ones.rlike("^[0-3]+$")
    return F.when(good, F.conv(ones, 4, 10).cast("long"))


def signature_pattern(code: Column | str, mask: str) -> Column:
    """A signature as a pattern of the mask's span, '.' at spacers."""
    ones = informative(mask)
    at = {p: len(ones) - 1 - i for i, p in enumerate(ones)}
    letters = F.array(*map(F.lit, BASES))
    parts = [F.element_at(letters, (F.shiftright(_col(code), 2 * at[p]).bitwiseAND(F.lit(3).cast("long")) + 1).cast("int")) if p in at else F.lit(".") for p in range(len(mask))]
    return F.when(_col(code).isNotNull(), F.concat(*parts))


def masked_display(window: Column | str, mask: str, tested: Column | int, allele: Column | str | None = None) -> Column:
    """The window with x at spacers and the tested place as '.' or as the allele."""
    j = F.lit(tested) if isinstance(tested, int) else tested
    shown = F.lit(".") if allele is None else F.lit(allele) if isinstance(allele, str) else allele
    ones = set(informative(mask))
    return F.concat(*[F.when(j == p, shown).otherwise(F.substring(_col(window), p + 1, 1)) if p in ones else F.lit("x") for p in range(len(mask))])
