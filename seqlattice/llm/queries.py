"""The queries of the text operators, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extraction, jaccard_join, packing, paragraph_dedup, quality_rules, sentence_pieces, sharding, suffix_dedup, top_k, toxicity
from .common import MIX_1, MIX_2, read_table


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_paths())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = quality_rules.result(docs, quality_rules.fit(docs, read_table(spark, sf_dir, "labels")))
    return out.withColumn("llr", F.round("llr", 5))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def learnable(id_col: str) -> Column:
    """Whether a row's labels may be learnt from; the others are held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) != 1


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels"), learnable("id")))
    return scored.select("doc_id", (~learnable("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), "spans")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents")).drop("source")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = sentence_pieces.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    docs = read_table(spark, sf_dir, "documents")
    out = sentence_pieces.transcode(docs, pieces)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), F.char_length("decoded").cast("long").alias("decoded_chars"))


def op9_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paragraph_dedup.removals(read_table(spark, sf_dir, "documents"))
    words = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return out.select("doc_id", "n_paragraphs", F.size("removed").cast("long").alias("n_removed"), words.alias("n_removed_words"), "removed", "kept_in")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_quality_rules, op3_jaccard_join, op4_html_extraction, op5_toxicity, op6_sharding, op7_top_k, op8_sentence_pieces, op9_paragraph_dedup, op10_suffix_dedup)}

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]'), lambda w: w <> '')"

_RULES = quality_rules.Rules()


def _mixed(x: str) -> str:
    """common.mix() of a UBIGINT."""
    times = lambda a, m: f"cast(cast({a} as uhugeint) * {m}::uhugeint % 18446744073709551616::uhugeint as ubigint)"
    one = times(f"xor({x}, {x} >> 30)", MIX_1)
    return f"(select xor(c, c >> 31) from (select {times('xor(b, b >> 27)', MIX_2)} as c from (select {one} as b)))"


_CRC_ROW = "i"
for _ in range(8):
    _CRC_ROW = f"(select case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end from (select {_CRC_ROW} as v))"

ORACLE_SQL = {
    "op2_quality_rules": f"""
        with docs as (select doc_id, row_number() over () as rid, coalesce(text, '') as t, hex(encode(coalesce(text, ''))) as h from documents),
        w as (select rid, {_WORDS.replace("coalesce(text, '')", "t")} as w from docs),
        windows as (select rid, i, array_to_string(w[i:i + 4], ' ') as g from (select rid, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
        again as (select rid, g from windows group by rid, g having count(*) > 1),
        covered as (select rid, count(distinct i + k) as n from windows semi join again using (rid, g), range(5) o(k) group by rid),
        lines as (select rid, unnest(string_split(t, chr(10))) as line from docs),
        dup as (select rid, count(*) - count(distinct line) as n from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by rid),
        grams as (select rid, substr(h, 2 * i + 1, 6) as g, count(*) as n from (select rid, h, unnest(range(0, greatest(length(h) // 2 - 2, 0))) as i from docs) group by 1, 2),
        codes as (select g, cast(((('0x' || substr(g, 1, 2))::bigint + 1) * 257 + ('0x' || substr(g, 3, 2))::bigint + 1) * 257 + ('0x' || substr(g, 5, 2))::bigint + 1 as ubigint) as x from (select distinct g from grams)),
        buckets as (select g, {_mixed("x")} >> {64 - _RULES.bits} as bucket from codes),
        trusted as (select distinct doc_id from labels where quality = 1 and doc_id is not null),
        counted as (select bucket, sum(n) as raw, coalesce(sum(n) filter (trusted.doc_id is not null), 0) as target from grams join buckets using (g) join docs using (rid) left join trusted using (doc_id) group by bucket),
        ratio as (select bucket, cast(ln((target + {_RULES.prior}) / (raw * (select sum(target) / greatest(sum(raw), 1) from counted) + {_RULES.prior})) as float) as r from counted),
        llr as (select rid, sum(n * cast(r as double)) / sum(n) as llr from grams join buckets using (g) join ratio using (bucket) group by rid),
        base as (
            select doc_id, rid, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
                length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(dup.n, 0) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words, coalesce(llr, 0) as llr
            from docs join w using (rid) left join dup using (rid) left join covered using (rid) left join llr using (rid)
        )
        select * exclude (rid, llr), n_words < {_RULES.least_words} or 100 * n_repeat_words > {_RULES.most_repeat_percent} * n_words as base_failed, not base_failed and llr >= {_RULES.threshold} as kept, round(llr, 5) as llr from base
    """,
    "op6_sharding": f"""
        with crc as (select list({_CRC_ROW} order by i) as rows from range(256) t(i)),
        docs as (select doc_id, source, octet_length(encode(coalesce(text, ''))) + 16 as size, hex(encode(coalesce(text, ''))) as h from documents),
        sums as (select doc_id, source, size, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint), lambda c, b: xor(c // 256, rows[xor(c % 256, b) + 1]), 4294967295), 4294967295) as text_crc32 from docs, crc),
        copies as (select *, row_number() over (partition by doc_id, source, size, text_crc32) as copy from sums),
        keyed as (select *, md5(concat_ws('|', '20240', doc_id, text_crc32, size, copy)) as k from copies),
        ranked as (select *, (row_number() over (partition by source order by k, doc_id, text_crc32, size, copy) - 0.5::double) / count(*) over (partition by source) as share from keyed),
        placed as (select *, row_number() over (order by share, k, source is null, coalesce(source, ''), doc_id, text_crc32, size, copy) - 1 as place, count(*) over () as n from ranked)
        select doc_id, cast(size as bigint) as size, text_crc32, 'rows' as law, cast(place * 40 // n as integer) as shard, place - (place * 40 // n * n + 39) // 40 as slot, cast(null as integer) as grown_shard from placed
    """,
    "op3_jaccard_join": f"""
        with texts as (select coalesce(text, '') as t, min(doc_id) as first, count(*) as n_copies from documents group by 1),
        numbered as (select *, row_number() over (order by t) as id from texts),
        w as (select id, {_WORDS.replace("coalesce(text, '')", "t")} as w from numbered),
        grams as (select distinct id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as g from w where len(w) >= 5),
        sizes as (select id, count(*) as n from grams group by id),
        links as (
            select a.id as u, b.id as v from grams a join grams b on a.g = b.g and a.id <> b.id
            join sizes x on x.id = a.id join sizes y on y.id = b.id
            group by a.id, b.id, x.n, y.n having count(*) >= 0.8 * (x.n + y.n - count(*))
        ),
        reach as (with recursive r as (select u as id, v as other from links union select r.id, l.v from r join links l on l.u = r.other) select id, other from r),
        class as (select n.id, least(n.first, min(o.first)) as class_id from numbered n left join reach using (id) left join numbered o on o.id = reach.other group by n.id, n.first),
        degree as (select u as id, count(*) as n_links from links group by u)
        select doc_id, class_id, coalesce(n_links, 0) as n_links, n_copies
        from documents d join numbered n on n.t = coalesce(d.text, '') join class using (id) left join degree using (id)
    """,
    "op10_suffix_dedup": """
        with docs as (select doc_id, row_number() over () as rid, hex(encode(coalesce(text, ''))) as h from documents),
        starts as (select rid, unnest(range(0, greatest(length(h) // 2 - 199, 0))) as at_, h from docs),
        strings as (select rid, at_, md5(substr(h, 2 * at_ + 1, 400)) as s from starts),
        twice as (select s from strings group by s having count(*) > 1),
        hits as (select rid, at_ from strings semi join twice using (s)),
        heads as (select *, coalesce(at_ > 200 + lag(at_) over (partition by rid order by at_), true) as new from hits),
        runs as (select rid, min(at_) as a, max(at_) + 200 as b from (select *, sum(cast(new as integer)) over (partition by rid order by at_) as run from heads) group by rid, run),
        cuts as (select rid, count(*) as n_spans, cast(sum(b - a) as bigint) as n_removed, list(a order by a) as a, list(b order by a) as b from runs group by rid)
        select doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
            sha256(unhex(case when a is null then h else array_to_string(list_transform(range(0, len(a) + 1), lambda i: substr(h, 2 * case when i = 0 then 0 else b[i] end + 1, 2 * (case when i = len(a) then length(h) // 2 else a[i + 1] end - case when i = 0 then 0 else b[i] end))), '') end)) as kept_sha256
        from docs left join cuts using (rid)
    """,
    "op7_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as w
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        s as (
            select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.w, c.w) as bigint) as score
            from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
        )
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
        from s
        qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
    """,
}
