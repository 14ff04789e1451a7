"""The text operators against brute force, on small tables with the awkward cases."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlattice.llm import html_extraction, induced_sorting, jaccard_join, neardup, packing, paragraph_dedup, quality_rules, sentence_pieces, sharding, suffix_dedup, top_k, toxicity
from seqlattice.llm.common import text_groups
from seqlattice.llm.queries import learnable, tokenizer_paths

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("key", T.IntegerType())])


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    passage = words(1, 60)
    texts = [None, "", " ", "one", words(2, 9), words(3, 40), words(3, 40), passage, f"{words(4, 30)}\n{passage}\n{words(5, 30)}", f"{words(6, 30)}\n{passage}", "x " * 300, "é" * 150 + " 日本語のテキスト " + "🤖" * 20, words(7, 20000), "a\n\na\nb\na", "<|endoftext|> and more text", " ".join(f"{w}%%%" for w in words(8, 80).split()), "q" * 3000]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 2}", None if t is None else len(t), "x", i) for i, t in enumerate(texts)]
    rows += [rows[5], rows[8], (None, words(9, 30), None, None, None, None, None), (None, None, None, None, None, None, None)]
    near = words(10, 100).split()
    for k in range(5):
        copy = near.copy()
        copy[10 * k] = "changed"
        rows.append((100 + k, " ".join(copy), "en", "s1", None, None, None))
    return spark.createDataFrame(rows, DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# -- 1 packing ---------------------------------------------------------------


@pytest.mark.parametrize("window,opened", [(64, 3), (2048, 64)])
def test_packing_places_each_id_once(spark, window, opened):
    from tokenizers import Tokenizer

    docs = awkward(spark).repartition(3)
    pieces = packing.pack(docs, tokenizer_paths(), window=window, open_windows=opened, merge_partitions=2).collect()
    tokenizer = Tokenizer.from_file(tokenizer_paths()[1])
    want = Counter()
    for r in docs.collect():
        want[(r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]))] += 1
    by_sequence, by_doc = {}, {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], np.uint32)
        assert len(ids) == p["length"] > 0
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        by_doc.setdefault(p["doc_id"], []).append((p["start"], tuple(ids.tolist()), p["doc_tokens"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    total = sum(n for parts in by_sequence.values() for _, n in parts)
    assert sum(1 for parts in by_sequence.values() if sum(n for _, n in parts) < window) <= 2
    assert total == sum(len(ids) * n for (_, ids), n in want.items())
    for doc, parts in by_doc.items():
        texts = [(ids, n) for (d, ids), n in want.items() if d == doc]
        if len(texts) == 1 and texts[0][1] == 1:
            joined = [i for _, ids, _ in sorted(parts) for i in ids]
            assert joined == list(texts[0][0]) and {t for *_, t in parts} == {len(joined)}


def test_packer_prefers_the_best_fit():
    out = []
    p = packing.Packer(10, 2, out.append)
    for doc, n in (("a", 4), ("b", 7), ("c", 3), ("d", 5), ("e", 9)):
        p.add(doc, 0, np.arange(n, dtype=np.uint32), n)
    assert [[(x[0], len(x[2])) for x in w.pieces] for w in out][0] == [("b", 7), ("c", 3)]
    assert sum(len(x[2]) for w in [*out, *p.leftovers()] for x in w.pieces) == 28


# -- 2 quality rules -----------------------------------------------------------


def plain_counts(text: str | None) -> tuple:
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    covered = {j for i in range(len(found) - 4) if grams[tuple(found[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    failed = len(found) < 10 or 100 * len(covered) > 20 * len(found)
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), twice, len(covered), failed


def test_quality_counts_are_the_plain_ones(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(i, int(i != 15), 0) for i in range(17)], "doc_id long, quality int, toxic int")
    model = quality_rules.fit(docs, labels)
    out = quality_rules.result(docs, model)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows_of(out, "doc_id", *names) == sorted(((r["doc_id"], *plain_counts(r["text"])) for r in docs.collect()), key=str)
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert kept[15] is False and kept[5] is True
    left = quality_rules.keep(docs, model)
    assert left.columns == docs.columns and left.count() == out.where("kept").count()


def test_quality_ratio_is_the_plain_one(spark):
    docs = spark.createDataFrame([(0, "abcd abce"), (1, "abcx #%#%"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    model = quality_rules.fit(docs, labels)
    rules, counts = model.rules, {}
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        for i in range(len(raw) - rules.order + 1):
            n = counts.setdefault(raw[i : i + rules.order], [0, 0])
            n[0] += r["doc_id"] == 0
            n[1] += 1
    target, every = (sum(n[k] for n in counts.values()) for k in (0, 1))
    for r in quality_rules.result(docs, model).collect():
        raw = (["abcd abce", "abcx #%#%", ""][r["doc_id"]]).encode()
        grams = [raw[i : i + rules.order] for i in range(len(raw) - rules.order + 1)]
        want = sum(math.log((counts[g][0] + rules.prior) / (counts[g][1] * target / every + rules.prior)) for g in grams) / max(len(grams), 1)
        assert r["llr"] == pytest.approx(want, abs=1e-5)


# -- 3 n-gram Jaccard join -------------------------------------------------------


def shingle_set(text: str | None, n: int = 5) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def plain_join(rows, threshold=0.8):
    """(doc_id, class id, links) of every row by comparing all pairs."""
    texts = sorted({r["text"] or "" for r in rows})
    sets = [shingle_set(t) for t in texts]
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both):
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    least = {}
    for r in rows:
        k = find(texts.index(r["text"] or ""))
        if r["doc_id"] is not None:
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    return sorted(((r["doc_id"], least.get(find(texts.index(r["text"] or ""))), links[texts.index(r["text"] or "")]) for r in rows), key=str)


@pytest.mark.parametrize("limit", [3, 1000])
def test_join_equals_all_pairs(spark, limit):
    rng = random.Random(limit)
    rows = [tuple(r) for r in awkward(spark).collect()]
    for g in range(6):
        base = words(200 + g, 60).split()
        for k in range(8):
            copy = base.copy()
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(1000)}"
            rows.append((None if k == 3 else 1000 + 10 * g + k, " ".join(copy), None, None, None, None, None))
    docs = spark.createDataFrame(rows, DOCS)
    out = jaccard_join.join(docs, limit=limit, depth=3, recall=0.9999)
    assert rows_of(out, "doc_id", "class_id", "n_links") == plain_join(docs.collect())


def test_join_of_an_empty_table(spark):
    assert jaccard_join.join(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_reach_the_recall():
    assert jaccard_join.runs_for(0.8, 0.999) > jaccard_join.runs_for(0.8, 0.9)


@pytest.mark.parametrize("n_sets,depth", [(800, 2), (800, 5)])
def test_pairs_in_large_nodes_meet(spark, n_sets, depth):
    """Pairs that agree in 0.8 of a sketch's coordinates on average, other sets that share the rest and keep their nodes large."""
    rng = np.random.default_rng(depth)
    hub = rng.integers(1, 1 << 31, 64, dtype=np.uint32)
    left = np.where(rng.random((n_sets, 64)) < 0.97, hub, rng.integers(1, 1 << 31, (n_sets, 64), dtype=np.uint32))
    right = np.where(rng.random((n_sets, 64)) < 0.8, left, rng.integers(1, 1 << 31, (n_sets, 64), dtype=np.uint32))
    rows = [(k, bytes(x.astype(np.uint32).tobytes())) for k, x in enumerate(np.concatenate([left, right]))]
    sets = spark.createDataFrame(rows, "id long, sketch binary")
    found = jaccard_join._buckets(sets, 0.8, 0.999, 64, 20, depth, 11).toPandas()
    members = found.groupby("id")["key"].agg(set)
    missed = sum(not (members.get(k, set()) & members.get(k + n_sets, set())) for k in range(n_sets))
    assert missed <= 4  # 0.8 of 800 at the recall of 0.999


def test_runs_hold_for_the_levels_and_the_sketch():
    rng = np.random.default_rng(3)
    for levels in (2, 5):
        runs = jaccard_join.runs_for(0.8, 0.999, levels)
        same = rng.random((20000, 64)) < 0.8
        missed = np.ones(len(same), bool)
        for _ in range(runs):
            here = np.ones(len(same), np.int64)
            for _ in range(levels):  # a node's paths that the pair shares; one is enough
                some = np.zeros(len(same), np.int64)
                for path in range(int(here.max(initial=0))):
                    two = rng.random(len(same)) < 0.25
                    a = rng.integers(0, 64, len(same))
                    b = (a + rng.integers(1, 64, len(same))) % 64
                    every = np.arange(len(same))
                    some += (path < here) * (same[every, a].astype(int) + (two & same[every, b]))
                here = some
            missed &= here == 0
        assert missed.mean() <= 0.0015


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (300, 200), (7, 7)]
    out = {r["u"]: r["v"] for r in neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**{i: 1 for i in range(2, 61)}, 200: 100, 300: 100}


# -- 4 HTML extraction ---------------------------------------------------------------


PAGE = '<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>a<li>b</ul></nav><div class="cookie-notice">We use</div>%s<aside>More</aside><form>Mail <input></form><footer>&copy; f</footer></body></html>'


def test_article_without_its_surroundings(spark):
    article = "<article><h1>Title &amp; more</h1><p>One <b>two</b>\n  three<p>Four<br>five<script>x</script><div class='comments'><article class='comment'><p>bad</p></article></div></article>"
    plain = "<div id='content'><p>Shared line</p><p>Only %d here &lt;b&gt;</p></div>"
    rows = [(0, "http://a.com/x/1", PAGE % article), (1, "http://a.com/x/2", PAGE % article), (2, "http://b.com/y/1", PAGE % (plain % 1)), (3, "http://b.com/y/2", PAGE % ("<p>extra</p>" + plain % 2)), (4, None, None), (5, "http://c.com", ""), (5, "http://c.com", ""), (None, "::bad::", "loose text"), (6, "http://d.com/1", PAGE % (plain % 9)), (7, "http://d.com/2", PAGE % (plain % 9))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = rows_of(html_extraction.extract(pages), "page_id", "text")
    full = "Title & more\n\nOne two three\n\nFour five"
    assert out == sorted([(0, full), (1, full), (2, "Only 1 here <b>"), (3, "extra\n\nOnly 2 here <b>"), (4, ""), (5, ""), (5, ""), (None, "loose text"), (6, "Shared line\n\nOnly 9 here <b>"), (7, "Shared line\n\nOnly 9 here <b>")], key=str)


def text_of(blocks):
    places, article = html_extraction.candidates(blocks)
    return "\n\n".join(blocks[k][0] for k in places), article


def test_wrappers_of_the_article_are_not_beside_it():
    html = "<body><div class='page header-fixed'><div class='no-sidebar'><main><div class='post-header'><h1>T</h1></div><p>a</p></main></div><div class='sidebar'>b</div></div><div class='comments'><article><p>c</p></article></div>"
    assert text_of(html_extraction.blocks_of(html)) == ("T\n\na", True)


def test_adverts_within_a_line_go():
    html = "<article><p>Six <span class='ad'><b>buy</b> <span>now</span></span>seven<p>eight <span class='ad'>never closed<p>nine</article>"
    assert text_of(html_extraction.blocks_of(html))[0] == "Six seven\n\neight\n\nnine"


def test_slugs_of_headings_stay():
    page = PAGE % '<article><h2 id="related-work">Related work</h2><h2 id="search">Search</h2><section id="social-policy"><p class="form-of-verse">Policy</p></section><div class="share-buttons">Tell</div><div id="comments">Said</div><div class="related-posts">More</div><p class="google-ad">Buy</p></article>'
    assert text_of(html_extraction.blocks_of(page))[0].split("\n\n") == ["Related work", "Search", "Policy"]


def test_common_lines_are_longest():
    rng = random.Random(0)
    for _ in range(500):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        found, rest = html_extraction.common_lines(a, b), iter(b)
        assert len(found) == table[-1][-1] and all(a[i] in rest for i in found)


def plain_extract(rows, least_pages=4):
    """The whole operator by plain loops: sorted pages, nearest neighbour, LCS by table, common lines by counting."""
    pages = []
    for k, (_, url, html) in enumerate(rows):
        blocks = html_extraction.blocks_of(html or "")
        places, article = html_extraction.candidates(blocks)
        pages.append((*html_extraction.host_and_path(url), k, blocks, places, article))
    order, out = sorted(range(len(pages)), key=lambda i: pages[i][:2]), [None] * len(rows)
    for at, i in enumerate(order):
        host, path, _, blocks, places, article = pages[i]
        near = [pages[order[j]] if 0 <= j < len(order) and pages[order[j]][0] == host else None for j in (at - 1, at + 1)]
        side = html_extraction.nearer(path, *(x and x[1] for x in near))
        lines, gone = [b for b, _, _ in blocks], set()
        if side and lines:
            other = [b for b, _, _ in near[side > 0][3]]
            table = [[0] * (len(other) + 1) for _ in range(len(lines) + 1)]
            for x, y in itertools.product(range(len(lines)), range(len(other))):
                table[x + 1][y + 1] = table[x][y] + 1 if lines[x] == other[y] else max(table[x][y + 1], table[x + 1][y])
            x, y = len(lines), len(other)
            while x and y:
                if lines[x - 1] == other[y - 1]:
                    x, y = x - 1, y - 1
                    gone.add(x)
                elif table[x - 1][y] >= table[x][y - 1]:
                    x -= 1
                else:
                    y -= 1
            size = [0 if aside else len(b) for b, _, aside in blocks]
            if sum(size[k] for k in gone) > sum(size) / 2:
                gone = set()
            if article:
                of = [p for p in pages if p[0] == host]
                on = lambda line: sum(p[5] and line in {p[3][k][0] for k in p[4]} for p in of)
                gone = {k for k in gone if on(lines[k]) >= least_pages and 2 * on(lines[k]) > len(of)}
        out[i] = "\n\n".join(lines[k] for k in places if k not in gone)
    return out


def test_only_differencing_finds_the_template_in_the_article(spark):
    """Boilerplate inside the marked article that no name gives away; a quotation that two articles share stays."""
    body = "<html><body><nav>Menu</nav><article><p>By our staff</p><h1>%s</h1><p>%s</p>%s<p>All rights reserved here</p></article></body></html>"
    quote = "<p>" + words(555, 12) + "</p>"
    rows = [(i, f"http://news.org/2024/story-{i:02d}", body % (words(600 + i, 4), words(700 + i, 40), quote if i in (4, 5) else "")) for i in range(9)]
    rows += [(20 + i, f"http://few.org/{i}", body % (words(800 + i, 4), words(900 + i, 40), "")) for i in range(3)]
    rows += [(30 + i, f"http://loose.org/a/{i}", f"<body><div>Top line</div><p>{words(950 + i, 20)}</p><div>Bottom line</div></body>") for i in range(5)]
    rows += [(40 + i, "http://copy.org/same", body % ("One", words(970, 40), "")) for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(pages).collect()}
    assert got == dict(zip([r[0] for r in rows], plain_extract(rows)))
    assert got[3] == f"{words(603, 4)}\n\n{words(703, 40)}" and words(555, 12) in got[4] and words(555, 12) in got[5]
    assert "By our staff" in got[20] and got[31] == words(951, 20) and "By our staff" in got[40]


def test_extraction_equals_plain_loops(spark):
    rng, rows = random.Random(8), []
    for i in range(60):
        lines = [f"<p>{words(k, 3)}</p>" for k in sorted(rng.sample(range(30), rng.randint(0, 9)))]  # in one order, so that the longest subsequence is one
        mark = rng.choice(["article", "div"])
        rows.append((i, f"http://h{i % 3}.org/{rng.randrange(40):02d}/{i}", f"<body><nav>{words(1, 2)}</nav><{mark}>{''.join(lines)}</{mark}><p>Foot</p></body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(pages, least_pages=2).collect()}
    want = plain_extract(rows, 2)
    assert sum(got[i] == want[i] for i in range(60)) == 60
    assert any(len(got[i].split("\n\n")) < rows[i][2].count("<p>") - 1 for i in range(60))


HOSTILE = ["<b x='" * 160000 + '"', "<div>" * 200000, "<span class=ad>" + "<b>" * 100000 + "</i>" * 100000, "<div>" * 100000 + "<nav><body>" * 50000, "<p " + "a  " * 300000, "<a href='" * 50000 + '<a href="' * 50000, "</p>" * 250000]


@pytest.mark.parametrize("html", HOSTILE, ids=range(len(HOSTILE)))
def test_a_megabyte_of_broken_markup_is_read_in_linear_time(html):
    began = time.process_time()
    html_extraction.blocks_of(html)
    assert time.process_time() - began < 10


def test_neighbours_across_partitions(spark):
    lines = [(i, "h", f"/{i:03d}", [7, i] if i % 2 else [7, i, 9], [3, 8] if i % 2 else [3, 8, 2], [0, 1] if i % 2 else [0, 1, 2], False) for i in range(40)]
    df = spark.createDataFrame(lines, "key long, host string, path string, lines array<long>, sizes array<int>, places array<int>, article boolean")
    whole = rows_of(html_extraction.difference(df, 0.5), "key", "shared")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert whole == rows_of(html_extraction.difference(df, 0.5), "key", "shared") and len(whole) == 39  # page 9 is all in its neighbour: copies
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


# -- 5 toxicity ------------------------------------------------------------------------


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(0)
    chain = toxicity.Chain(np.zeros(2), rng.normal(size=(2, 2)), 0.3, 0.0)
    sizes = [1, 4, 6, 0, 3]
    emission, at = rng.normal(size=sum(sizes)), np.cumsum([0, *sizes])
    got = chain.marginals(emission, at)[0]
    for a, b in zip(at[:-1], at[1:]):
        total, toxic = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=b - a):
            score = sum(emission[a + t] * v for t, v in enumerate(y)) + (chain.start * y[0] if y else 0) + sum(chain.transition[u, v] for u, v in zip(y, y[1:]))
            total += math.exp(score)
            toxic += math.exp(score) * np.array(y)
        assert np.allclose(got[a:b], toxic / total)


def test_toxic_words_are_learnt_and_held_out_rows_scored(spark):
    rng, rows, labels = random.Random(3), [], []
    for i in range(300):
        text = words(i, rng.randint(15, 60)).split()
        bad = i % 4 == 0
        if bad:
            for w in rng.sample(["zorkly", "vexmoid", "vexling", "vexton"], 2):
                text.insert(rng.randrange(len(text)), w + rng.choice(["", ",", "."]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    rows += [(400, None), (401, ""), (None, "plain words here"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    known = spark.createDataFrame(labels + [(402, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known, learnable("id"))
    out = toxicity.score(docs, model).collect()
    truth = dict(labels)
    unseen = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 300 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(unseen) > 50 and np.mean([(r["score"] >= 0.7) == bool(truth[r["doc_id"]]) for r in unseen]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in out) and len(out) == len(rows)
    text = dict(rows)
    for r in out:
        if r["doc_id"] is not None and r["doc_id"] < 300 and truth[r["doc_id"]] and r["spans"]:
            raw = text[r["doc_id"]].encode()
            assert all(raw[s["start"] : s["end"]].decode().startswith(("zork", "vex")) for s in r["spans"])
    assert toxicity.keep(docs, model).columns == docs.columns


def test_one_class_gives_a_constant(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, None)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(0, 0)], "doc_id long, toxic int"), F.lit(True))
    assert rows_of(toxicity.score(docs, model), "doc_id", "score") == [(0, 0.0), (1, 0.0)]


# -- 6 sharding --------------------------------------------------------------------------


def plain_shards(rows, shards):
    """The interleaving by plain sorting; the hash comes with the rows."""
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    order = []
    for source, part in by.items():
        part.sort(key=lambda r: (r["h"], str(r["doc_id"]), r["text_crc32"], r["size"]))
        order += [((i + 0.5) / len(part), r) for i, r in enumerate(part)]
    order.sort(key=lambda x: x[0])
    n = len(order)
    return Counter(i * shards // n for i in range(n)), {s: [x[0] for x in order if x[1]["source"] == s] for s in by}


def test_shards_are_even_and_mixed(spark):
    rows = [(i, f"t{i % 50}" if i % 7 else None, None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 5}") for i in range(997)] + [(5, "same", "hot")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("place", F.lit("clash"))
    out = sharding.shard(docs, shards=7, buckets=16).collect()
    assert len(out) == 1000
    counts = Counter(r["shard"] for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(7))
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(n))
    for source in {r["source"] for r in out}:
        per = Counter(r["shard"] for r in out if r["source"] == source)
        share = sum(per.values()) / 7
        assert all(abs(per[k] - share) <= 2 for k in range(7))
    texts = {r[0]: r[1] for r in rows[:997]}
    for r in out:
        if r["doc_id"] != 5:
            raw = (texts[r["doc_id"]] or "").encode()
            assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
    again = sharding.shard(docs.repartition(5), shards=7, buckets=64).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_fewer_rows_than_shards(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (2, None, None)], "doc_id long, text string, source string")
    out = sharding.shard(docs).collect()
    assert len({r["shard"] for r in out}) == 2 and all(r["slot"] == 0 for r in out)
    assert sharding.shard(docs.where("doc_id > 5")).count() == 0


# -- 7 exact top-k search ------------------------------------------------------------------


def test_search_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, rng.uniform(-3, 3), 0.25]) for _ in range(6)]) for i in range(120)]
    rows += [(120, None), (121, [1.0, None]), (122, [float("nan")]), (123, [float("inf"), 1.0]), (124, []), (125, [1.0]), rows[10], rows[10], (None, [1.0] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    got = top_k.search(vectors.drop("id"), F.col("id") % 5 == 0, block_rows=16, query_lines=3)
    assert rows_of(top_k.search(vectors, F.col("id") % 5 == 0, query_chunk=4), "query_id", "rank", "vec_id", "score") == rows_of(got, "query_id", "rank", "vec_id", "score")
    used = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, _ in used if i % 5 == 0}):
        mine = next(v for i, v in used if i == q)
        best = sorted(((-sum(a * b for a, b in zip(mine, v)), i) for i, v in used if i != q))[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=str)


def test_search_of_an_empty_table(spark):
    assert top_k.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 5 == 0).count() == 0


# -- 8 SentencePiece -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers

    return sentence_pieces.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))


TEXTS = [None, "", " ", "  two  spaces ", "the cat\n\tsat", "x" * 300 + "é" * 80, "日本語のテキスト 𝔘 ▁mark", "\x00 nul", "🤖" * 30, words(1, 200), "ab" * 40 + " " + "ab" * 33]


def test_encoding_round_trips(spark, pieces):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(1, "")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    both = sentence_pieces.transcode(docs, pieces)
    for r in both.collect():
        assert r["decoded"] == (TEXTS[r["doc_id"]] or "").replace("▁", " ")
    decoded = sentence_pieces.transcode(both.select("doc_id", "ids"), pieces, encode=False)
    assert rows_of(decoded, "doc_id", "decoded") == rows_of(both, "doc_id", "decoded")


def _field(number: int, kind: int, value: bytes) -> bytes:
    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return varint(number << 3 | kind) + (varint(len(value)) + value if kind == 2 else value)


def test_segmentation_scores_as_the_library(pieces):
    """A unigram model file of the same pieces and scores, read by the library."""
    import public_tokenizers
    import sentencepiece

    bpe = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    model = b""
    for i in range(bpe.vocab_size()):
        kind = 6 if bpe.is_byte(i) else 2 if bpe.is_unknown(i) else 3 if bpe.is_control(i) else 1
        model += _field(1, 2, _field(1, 2, bpe.id_to_piece(i).encode()) + _field(2, 5, struct.pack("<f", pieces.score[i])) + _field(3, 0, bytes([kind])))
    model += _field(2, 2, _field(3, 0, b"\1") + _field(35, 0, b"\1")) + _field(3, 2, _field(1, 2, b"identity") + _field(3, 0, b"\1") + _field(4, 0, b"\0") + _field(5, 0, b"\1"))
    unigram = sentencepiece.SentencePieceProcessor(model_proto=model)
    for first, after, data, at in text_groups(pa.array([t or "" for t in TEXTS])):
        ids, where, _ = sentence_pieces.encode_group(pieces, data, at)
        for k in range(first, after):
            mine, theirs = ids[where[k - first] : where[k - first + 1]].tolist(), unigram.encode(TEXTS[k] or "")
            assert unigram.decode(mine) == unigram.decode(theirs)
            assert sum(pieces.score[i] for i in mine) == pytest.approx(sum(pieces.score[i] for i in theirs), rel=1e-4)


def test_trie_holds_its_keys():
    keys = {bytes(k): i for i, k in enumerate(sorted({tuple(random.Random(i).randrange(256) for _ in range(random.Random(i).randint(1, 4))) for i in range(500)}))}
    t = sentence_pieces.DoubleArray.build(keys)
    for key, number in keys.items():
        node = 0
        for c in key:
            after = t.base[node] + c
            assert t.check[after] == node
            node = after
        assert t.value[node] == number


# -- 9 paragraph dedup ---------------------------------------------------------------------------


def plain_paragraphs(rows, least=25, threshold=0.8):
    """The component of each long line, by comparing all pairs."""
    lines = sorted({line for r in rows for line in (r["text"] or "").split("\n") if len(line.split()) >= least})
    sets, root = [shingle_set(t) for t in lines], list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(lines)), 2):
        both = len(sets[i] & sets[j])
        if both >= threshold * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    return {line: find(i) for i, line in enumerate(lines)}


def windows(texts, n):
    return Counter(w for t in texts for w in {tuple(x[i : i + n]) for x in [re.findall(r"[^\x20\x09-\x0D]+", t or "")] for i in range(len(x) - n + 1)})


def test_one_paragraph_of_each_component_stays(spark):
    docs = awkward(spark).where("doc_id is not null")
    rows = docs.collect()
    component = plain_paragraphs(rows)
    out = paragraph_dedup.removals(docs)
    text = {r["doc_id"]: r["text"] or "" for r in rows}
    gone = {r["doc_id"]: {k for x in r["removed"] for k in range(x["start"], x["end"])} for r in out.collect()}
    left = Counter()
    for doc, t in text.items():
        at = 0
        for line in t.split("\n"):
            n = len(line.split())
            if n >= 25 and not set(range(at, at + n)) & gone[doc]:
                left[component[line]] += 1
            at += n
    assert set(left) == set(component.values()) - {component[text[10]]} and set(left.values()) == {1}  # 300 equal words repeat within
    assert {r["doc_id"]: r["kept_in"] for r in out.collect()}[9] == [7]
    cleaned = {r["doc_id"]: r["text"] for r in paragraph_dedup.apply(docs, out).collect()}
    assert cleaned[9] == words(6, 30) and cleaned[0] is None and cleaned[7] == words(1, 60) and cleaned[8] == f"{words(4, 30)}\n{words(5, 30)}"
    assert paragraph_dedup.removals(spark.createDataFrame([], DOCS)).count() == 0


def test_no_two_texts_share_a_long_passage_afterwards(spark):
    """Passages within lines, across lines and of short lines; those of 51 words at least are all found, and nothing else goes."""
    rng, rows = random.Random(4), []
    passages = [words(3000 + k, rng.randint(51, 90)).split() for k in range(12)]
    for d in range(60):
        own = words(4000 + d, rng.randint(30, 120)).split()
        if d % 2:
            at = rng.randrange(len(own))
            own[at:at] = passages[rng.randrange(12)]
        own = [w + (rng.choice(["\n", "\n\n", " \t"]) if rng.random() < 0.12 else " ") for w in own]
        rows.append((d, "".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = paragraph_dedup.removals(docs)
    removed = {r["doc_id"]: r["removed"] for r in out.collect()}
    cleaned = [r["text"] for r in paragraph_dedup.apply(docs, out).collect()]
    assert max(windows([t for _, t in rows], 51).values()) > 1 and max(windows(cleaned, 51).values()) == 1
    assert not any(removed[d] for d in range(0, 60, 2))
    seen = windows([t for _, t in rows], 25)
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        for r in removed[d]:  # every removed word is part of a passage of 25 that stands elsewhere too
            assert all(any(seen[tuple(w[i : i + 25])] > 1 for i in range(max(0, k - 24), k + 1)) for k in range(r["start"], r["end"]))
    assert Counter(len(r) > 0 for r in removed.values())[True] == sum(n - 1 for n in Counter(next(k for k, p in enumerate(passages) if " ".join(p) in " ".join(t.split())) for d, t in rows if d % 2).values())


def test_removed_lines_take_no_last_copy_of_a_passage(spark):
    """A passage whose first place goes with a near copy of another line stays at its next place."""
    line, passage = words(5000, 200).split(), words(5001, 30).split()
    near = line[:100] + passage[:30] + line[100:]
    rows = [(0, " ".join(line)), (1, " ".join(near)), (2, words(5002, 40) + " " + " ".join(passage) + " " + words(5003, 40))]
    out = paragraph_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string"))
    removed = {r["doc_id"]: r["removed"] for r in out.collect()}
    assert removed[0] == [] and removed[2] == [] and [(r["start"], r["end"]) for r in removed[1]] == [(0, 230)]


def test_near_lines_are_compared_by_their_words(spark):
    rng = random.Random(9)
    lines, rows = [words(300 + k, rng.randint(25, 60)).split() for k in range(25)], []
    for d in range(40):
        some = [list(x) for x in rng.sample(lines, 4)]
        some[0][-1] = rng.choice(["changed", some[0][-1]])
        rows.append({"doc_id": d, "text": "\n".join(" ".join(x) for x in some)})
    component = plain_paragraphs(rows)
    gone = {r["doc_id"]: {k for x in r["removed"] for k in range(x["start"], x["end"])} for r in paragraph_dedup.removals(spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")).collect()}
    left = Counter()
    for r in rows:
        at = 0
        for line in r["text"].split("\n"):
            n = len(line.split())
            if not set(range(at, at + n)) & gone[r["doc_id"]]:
                left[component[line]] += 1
            at += n
    assert set(left) == set(component.values()) and set(left.values()) == {1}


def test_bands_reach_the_recall():
    for hashes, recall in ((32, 0.999), (64, 0.995)):
        b, r = paragraph_dedup.tune(hashes, 0.8, recall)
        assert b * r <= hashes and 1 - (1 - 0.8**r) ** b >= recall


# -- 10 suffix-array dedup ---------------------------------------------------------------------------


def plain_suffix(rows, length=200):
    raws = [(r["doc_id"], (r["text"] or "").encode()) for r in rows]
    count = Counter(raw[k : k + length] for _, raw in raws for k in range(len(raw) - length + 1))
    out = []
    for doc, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if count[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return rows_of(df.select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).alias("gone"), F.size("spans").alias("runs"), F.sha2("kept", 256).alias("sha")), "doc_id", "n_bytes", "gone", "runs", "sha")


@pytest.mark.parametrize("shard_bytes", [500, 1 << 20])
def test_suffix_dedup_equals_counting_all_strings(spark, shard_bytes):
    rng = random.Random(1)
    base = words(50, 400)
    rows = [tuple(r) for r in awkward(spark).where("doc_id is null or doc_id <> 12").collect()]
    for k in range(12):
        a = rng.randrange(1500)
        cut = base[a : a + rng.randrange(150, 700)]
        rows.append((500 + k, words(60 + k, 20) + cut + words(80 + k, 20) + (cut[:230] if k % 3 == 0 else ""), None, None, None, None, None))
    docs = spark.createDataFrame(rows, DOCS)
    assert digest(suffix_dedup.dedup(docs, shard_bytes=shard_bytes, chunk=10_000)) == plain_suffix(docs.collect())
    cleaned = suffix_dedup.clean(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    assert suffix_dedup.dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_a_hot_anchor_is_counted_and_long_texts_are_cut(spark):
    """One phrase of 100 bytes in many surroundings is more than a shard; results are those of counting all strings."""
    phrase = words(31, 40)[:100]
    sides = [words(6000 + k, 30)[:110] for k in range(6)]
    rng = random.Random(3)
    rows = [(k, words(7000 + k, 4) + sides[rng.randrange(6)][-rng.randint(40, 110) :] + phrase + sides[rng.randrange(6)][: rng.randint(40, 110)]) for k in range(80)]
    docs = spark.createDataFrame(rows + [(200, rows[0][1]), (201, "z" * 900), (202, words(9000, 30_000)), (203, words(9000, 30_000)[500:])], "doc_id long, text string")
    for shard_bytes in (1000, 1 << 20):
        assert digest(suffix_dedup.dedup(docs, shard_bytes=shard_bytes, chunk=10_000)) == plain_suffix(docs.collect())


def test_sorted_suffixes_and_common_prefixes(monkeypatch, tmp_path):
    rng = np.random.default_rng(0)
    for round_ in range(300):
        monkeypatch.setattr(induced_sorting, "BYTE_LIKE", int(rng.choice([1, 3, 1000])))
        monkeypatch.setattr(induced_sorting, "CHUNK", int(rng.choice([2, 5, 65536])))
        letters = int(rng.integers(2, 6))
        n = int(rng.integers(1, 60))
        text = rng.integers(1, letters, n) if round_ % 3 else np.tile(rng.integers(1, letters, int(rng.integers(1, 5))), 20)[:n]
        text = np.r_[text, 0].astype(np.uint16)
        got = list(induced_sorting.sort_suffixes(text, letters + 1, str(tmp_path), int(rng.choice([1, 4, 1000]))))
        order, flat = np.concatenate([a for a, _ in got]).tolist()[::-1], text.tolist()
        assert order == sorted(range(len(flat)), key=lambda i: flat[i:])
        prefixes = np.concatenate([b for _, b in got]).tolist()[::-1]
        for a, b, k in zip(order, order[1:], prefixes[1:]):
            want = next((i for i in range(min(len(flat) - a, len(flat) - b)) if flat[a + i] != flat[b + i]), min(len(flat) - a, len(flat) - b))
            assert k == min(want, induced_sorting.CAP)


# -- the pipeline ----------------------------------------------------------------------------------------


def test_each_stage_works_on_what_was_kept(spark, tmp_path):
    import corpus_pipeline

    rng, rows, labels = random.Random(9), [], []
    for i in range(160):
        text = words(i, 60)
        if i % 8 == 0:
            text += " zorkly vexmoid"
        if i % 20 == 3:
            text = " ".join(w + "%%%" for w in text.split())
        if i % 16 == 5:
            text = words(7777, 60) + f" tail{i}"
        if i % 16 == 9:
            text += "\n" + words(999, 60)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(i % 20 != 3), int(i % 8 == 0)))
    rows += [(200, None, None, None, None), (201, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept.append({r["doc_id"]: r for r in docs.collect()})
    clean = {i for i in range(160) if i % 20 != 3}
    assert set(kept[0]) == clean
    assert set(kept[1]) == {i for i in clean if i % 8}
    near = sorted(i for i in kept[1] if i % 16 == 5)
    assert set(kept[2]) == set(kept[1]) - set(near[1:]) and len(near) > 2
    passage = words(999, 60)
    assert all(passage not in r["text"] for r in kept[3].values()) and set(kept[3]) == set(kept[2])
    assert all(r["n_chars"] == len(r["text"]) for r in kept[3].values())
    assert set(kept[4]) == set(kept[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
