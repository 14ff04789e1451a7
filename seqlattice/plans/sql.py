"""Pieces of DuckDB SQL that the oracles share: the data model over the warehouse tables."""

from __future__ import annotations

LETTERS = "upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g'))"

REGIONS = f"""docs as (select doc_id as ord, {LETTERS} as seq, cast(coalesce(n_chars, 0) as double) as value from documents),
regions as (select 'doc' || ord || ':0-' || length(seq) as region, seq, ord, value from docs)"""


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGTacgt', 'TGCAtgca'))"


def canonical(x: str) -> str:
    return f"least({x}, {rc(x)})"


def tokens(k: int, source: str = "regions", name: str = "tok", keys: str = "region, ord") -> str:
    return f"{name} as (select {keys}, off, substr(seq, off, {k}) as kmer from (select {keys}, seq, unnest(range(1, greatest(length(seq) - {k} + 2, 1))) as off from {source}))"


UNIQUE = "idx as (select kmer, region, min(off) as off from tok group by kmer, region having count(*) = 1)"

RANKS = "ranks as (select region, ord, value, row_number() over (order by value desc, ord) - 1 as rank, count(*) over () as n_total from regions)"


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def index(k: int) -> str:
    return ",\n".join((REGIONS, tokens(k), UNIQUE))


def variants(k: int) -> str:
    return f"""items as (select item_id, {LETTERS} as s from benchmark),
variants as (
    select 'item' || item_id || ':' || (length(s) // 2 + 1) || ':' || substr(s, length(s) // 2 + 1, 1) || '>' || translate(substr(s, length(s) // 2 + 1, 1), 'ACGT', 'CGTA') as variant,
        substr(s, length(s) // 2 - {k} + 2, {2 * k - 1}) as seq, {k - 1} as ctr, substr(s, length(s) // 2 + 1, 1) as ref, translate(substr(s, length(s) // 2 + 1, 1), 'ACGT', 'CGTA') as alt
    from items where length(s) >= {2 * k}
),
windows as (select variant, ref, alt, seq, mp as motif_pos, ctr - mp as j, substr(seq, mp + 1, {k}) as kmer from (select *, unnest(range(0, {k})) as mp from variants))"""


def text_number(x: str) -> str:
    return f"cast('0x' || substr(md5({x}), 1, 15) as bigint)"


ALLELES = "(values ('A'), ('C'), ('G'), ('T')) al(allele)"


def probes(source: str, by: str, palindrome: str = "reverse") -> str:
    """asked(by, j, allele, probe, is_reverse) of windows source(by, j, kmer)."""
    filled = "substr(kmer, 1, j) || allele || substr(kmer, j + 2)"
    keep_forward = "filled <> rcf" if palindrome == "reverse" else "true"
    keep_reverse = "filled <> rcf" if palindrome == "forward" else "true"
    return f"""filled as (select distinct {by}, j, allele, {filled} as filled, {rc(filled)} as rcf from {source}, {ALLELES}),
asked as (
    select {by}, j, allele, filled as probe, false as is_reverse from filled where {keep_forward}
    union all select {by}, j, allele, rcf, true from filled where {keep_reverse}
)"""


def matches(by: str, k: int, last: bool = False) -> str:
    """found(by, allele, region, place)."""
    pick = "max_by" if last else "min_by"
    return f"""found as (
    select {by}, allele, region, {pick}(case when is_reverse then off + {k - 1} - j else off + j end, is_reverse) as place
    from asked join idx on idx.kmer = asked.probe group by {by}, allele, region
)"""


def unambiguous(by: str) -> str:
    return f"single as (select {by}, region, min(allele) as allele, min(place) as place from found group by {by}, region having count(distinct allele) = 1)"


def signature(window: str, mask: str) -> str:
    """The signature of a window of A, C, G, T as an integer expression."""
    ones = [i for i, c in enumerate(mask) if c == "1"]
    digits = [f"(instr('ACGT', substr({window}, {p + 1}, 1)) - 1) * {4 ** (len(ones) - 1 - i)}::bigint" for i, p in enumerate(ones)]
    return "(" + " + ".join(digits) + ")"


def masked_tokens(mask: str) -> str:
    return f"""{tokens(len(mask))},
codes as (
    select region, ord, off, false as is_reverse, {signature('kmer', mask)} as code from tok
    union all select region, ord, off, true, {signature(rc('kmer'), mask)} from tok
)"""


def two_sided_t(t: str, df: str, rounds: int = 150) -> str:
    """P(|T| > |t|) of Student's t: the incomplete beta by its continued fraction, from the last of so many terms inwards."""
    x, a, b = f"({df} / ({df} + {t} * {t}))", f"({df} / 2.0)", "0.5"
    rest = f"({t} * {t} / ({df} + {t} * {t}))"

    def beta(p: str, q: str, z: str, one_less_z: str) -> str:
        odd = f"(1 - ({p} + m) * ({p} + {q} + m) * {z} / (({p} + 2 * m) * ({p} + 2 * m + 1)) / acc)"
        inward = f"list_reduce(cast(range({rounds}, 0, -1) as double[]), lambda acc, m: 1 + m * ({q} - m) * {z} / (({p} + 2 * m - 1) * ({p} + 2 * m)) / {odd}, cast(1 as double))"
        front = f"exp({p} * ln({z}) + {q} * ln({one_less_z}) + lgamma({p} + {q}) - lgamma({p}) - lgamma({q})) / {p}"
        return f"{front} / (1 - ({p} + {q}) * {z} / ({p} + 1) / {inward})"

    return f"case when {t} is null then null when {t} = 0 then 1.0 when {x} > ({a} + 1) / ({a} + {b} + 2) then 1 - {beta(b, a, rest, x)} else {beta(a, b, x, rest)} end"


def two_sided_normal(z: str, rounds: int = 60) -> str:
    """P(|Z| > |z|): by its power series near 0, by the continued fraction of the tail beyond."""
    x = f"(abs({z}) / sqrt(cast(2 as double)))"
    series = f"1 - 2 / sqrt(pi()) * {x} * exp(-{x} * {x}) * list_reduce(cast(range({rounds}, 0, -1) as double[]), lambda acc, m: 1 + 2 * {x} * {x} / (2 * m + 1) * acc, cast(1 as double))"
    tail = f"exp(-{x} * {x}) / sqrt(pi()) / list_reduce(cast(range({3 * rounds}, 0, -1) as double[]), lambda acc, m: {x} + m / 2 / acc, cast({x} as double))"
    return f"case when {z} is null then null when {x} < 2 then {series} else {tail} end"


def least_squares(source: str, by: str, columns: list[str], y: str, having: str = "true", extra: str = "", tag: str = "") -> str:
    """swept(by, n, df, extra..., m): m holds, after a sweep over all columns that vary, the inverse
    of their centred cross products, the slopes in the last column and the residual sum in the corner.

    For designs of full rank.
    """
    names = [*columns, y]
    p = len(columns)
    rows = ", ".join("[" + ", ".join(f"count(*) * covar_pop({a}, {b})" for b in names) + "]" for a in names)
    parts = [f"{tag}sums as (select {by}, cast(count(*) as double) as n{extra}, [{rows}] as m from {source} group by {by} having {having})"]
    parts.append(f"{tag}s0 as (select * exclude (m), m, list_transform(range(1, {p + 1}), lambda i: m[i][i] / n > 1e-18) as varies from {tag}sums)")
    for k in range(1, p + 1):
        cell = f"case when i = {k} and j = {k} then 1 / m[{k}][{k}] when i = {k} then m[i][j] / m[{k}][{k}] when j = {k} then -m[i][j] / m[{k}][{k}] else m[i][j] - m[i][{k}] * m[{k}][j] / m[{k}][{k}] end"
        parts.append(f"{tag}s{k} as (select * exclude (m), case when varies[{k}] then list_transform(range(1, {p + 2}), lambda i: list_transform(range(1, {p + 2}), lambda j: {cell})) else m end as m from {tag}s{k - 1})")
    parts.append(f"{tag}swept as (select *, n - 1 - list_sum(list_transform(varies, lambda v: cast(v as integer))) as df from {tag}s{p})")
    return ",\n".join(parts)


def pooled(source: str, by: str) -> str:
    """pooled(by, allele, effect, pval) of source(by, window, region, allele, ref, y, lp, sl): fixed effects of windows, errors clustered by region."""
    columns = ["a_", "c_", "g_", "t_", "lp", "sl"]
    hot = ", ".join(f"cast(allele = '{b}' and ref <> '{b}' as double) as {b.lower()}_" for b in "ACGT")
    less = ", ".join(f"{c} - avg({c}) over (partition by {by}, win) as {c}" for c in [*columns, "y"])
    rest = "y" + "".join(f" - m[{i}][7] * {c}" for i, c in enumerate(columns, 1))
    scores = ", ".join(f"sum(({rest}) * ({' + '.join(f'm[{k}][{i}] * {c}' for i, c in enumerate(columns, 1))})) as s{k}_" for k in range(1, 5))
    each = " union all ".join(f"select {by}, '{b}' as allele, case when ref <> '{b}' then m[{k}][7] end as effect, case when ref <> '{b}' and varies[{k}] then m[{k}][7] / sqrt(v{k} * g / (g - 1) * (n - 1) / (n - wins - 5)) end as t, g - 1 as gdf from fitted" for k, b in enumerate("ACGT", 1))
    return f"""hot as (select {by}, "window" as win, region, ref, ln(1 + y) as y, lp, sl, {hot} from {source}),
within as (select {by}, win, region, ref, {less} from hot),
{least_squares("within", by, columns, "y", extra=", count(distinct win) as wins, min(ref) as ref")},
clusters as (select {by}, region, {scores} from within join (select {by}, m from swept) using ({by}) group by {by}, region),
meat as (select {by}, count(*) as g, {", ".join(f"sum(s{k}_ * s{k}_) as v{k}" for k in range(1, 5))} from clusters group by {by}),
fitted as (select * from swept join meat using ({by})),
pooled as (select {by}, allele, effect, t, gdf from ({each}))"""


def term(k: int, p: int) -> tuple[str, str]:
    """(slope, t) of column k of swept with p columns."""
    slope = f"m[{k}][{p + 1}]"
    return slope, f"{slope} / sqrt(m[{p + 1}][{p + 1}] / df * m[{k}][{k}])"
