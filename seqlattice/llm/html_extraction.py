"""HTML extraction: nearest-URL page differencing over the blocks of each page.

A page is read into text blocks ("lines"); a block knows whether it stands in an article and
whether an element around it is a menu, header, footer, sidebar, notice, advert, form or
reader comment. Pages of a host are then set in the order of their URL paths, each is paired
with the nearer of its two neighbours, the pair's lines are aligned by longest common
subsequence, and the lines that both share are deleted from the candidates: the blocks of the
article, or of the page where it marks none.

What differencing may delete is bounded by what it can know. A pair that shares over half of
its text is a pair of copies, which says nothing of the template, and deletes nothing. Within
an element that the page itself marks as its article a shared line goes only if it stands
within the article on more than half of the host's pages and on ``least_pages`` at least, as
two articles may quote the same passage; elsewhere every shared line goes.

A page is parsed once; its candidate blocks are written to the shared folder. Only hashes of
lines are sorted by host and path, so that a host with a third of all pages is many
partitions; the rows at the ends of a partition are sent to its neighbours as well, and the
driver learns only which partitions hold rows.

Edge cases: null or empty html gives an empty text; a null or odd URL is a host of its own
and a path as it stands. Repeated rows are pages of their own, and copies of each other.
An empty table gives an empty result. Only the named columns are read. Pages of any size are
read whole, in time linear in their length but for the alignment (lines squared / 64); a quote
that is never closed ends with its tag.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, stored

# Element names by their part in a page.
RAW = "script style noscript template iframe textarea title svg math canvas object select datalist audio video noframes noembed".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup td th time tt u var wbr".split())
ASIDE = set("nav header footer aside form button dialog menu fieldset head".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist tooltip".split())
# Words of a class or id that mark an element as not of the article.
HINTS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar topbar "
    "header masthead footer sidebar aside widget widgets "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall "
    "form search login signup subscribe subscription newsletter "
    "comment comments disqus replies respond share sharing social related recommended recommendations".split()
)

# Hints that are also words of a text's subject. Within an article, where ids and classes
# may be slugs of a heading, such a name counts only if no word but hints and parts of a page is in it.
SUBJECTS = set(
    "header banner menu search form social notice notices notification alert comment comments replies respond share sharing "
    "related recommended recommendations widget widgets login signup subscribe subscription navigation pagination consent".split()
)
PARTS = set("area articles bar block box button buttons container count icon icons inner item items link links list panel posts section slot stories wrap wrapper".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())

# Words that say what a page has around its article, not what an element is.
NOT_OF = {"has", "with", "no", "without", "layout"}

# No alternative can fail after its name, so nothing is scanned twice; a quote that is never closed ends at the next >.
REST = r"""(?:[^>"']++|"[^"]*"|'[^']*')*+"""
CLOSE = r"""(?:>|\Z|["'][^>]*+(?:>|\Z))"""
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])" + REST + CLOSE + r".*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>" + REST + ")" + CLOSE,
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def is_aside(name: str, attrs: str, in_article: bool) -> bool:
    """Whether the element holds no text of the article."""
    if name in ASIDE and not (name == "header" and in_article):
        return True
    if not attrs:
        return False
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True
    if name in ("html", "body", "main") or name == "article" and not in_article:
        return False
    for kind in ("class", "id"):
        if in_article and kind == "id" and name in HEADINGS:
            continue
        for one in found.get(kind, "").split():
            said = [w.lower() for w in WORD.findall(one)]
            whole = all(w in HINTS or w in PARTS for w in said)
            hints = {w for w in said if w in HINTS and not (in_article and w == "header")}
            if in_article and not whole:
                hints -= HINTS if kind == "id" else SUBJECTS
            if NOT_OF.isdisjoint(said) and hints:
                return True
    return False


class Open:
    """The open elements that are not inline, innermost last; each step takes constant time."""

    BESIDE = ("nav", "header", "footer", "head", "menu", "form", "button")

    def __init__(self):
        self.names: list[str] = []
        self.own: list[bool] = []  # whether the element itself is beside the article
        self.aside: list[bool] = []  # whether it or one around it is
        self.article: list[int] = []
        self.count: dict[str, int] = {}
        self.beside: list[int] = []  # places of the elements that no article stands in

    def push(self, name: str, off: bool, article: int) -> None:
        if name in self.BESIDE:
            self.beside.append(len(self.names))
        self.names.append(name)
        self.own.append(off)
        self.aside.append(off or self.in_aside)
        self.article.append(article)
        self.count[name] = self.count.get(name, 0) + 1

    def cut(self, k: int) -> None:
        """Closes the elements from place k on."""
        for name in self.names[k:]:
            self.count[name] -= 1
        for x in (self.names, self.own, self.aside, self.article):
            del x[k:]
        while self.beside and self.beside[-1] >= k:
            self.beside.pop()

    def close(self, name: str) -> None:
        if self.count.get(name):
            k = len(self.names) - 1
            while self.names[k] != name:
                k -= 1
            self.cut(k)

    def only_named(self) -> None:
        """What an element's class or id said no longer counts, only its name."""
        self.own = [x and n in ASIDE for n, x in zip(self.names, self.own)]
        self.aside, below = [], False
        for x in self.own:
            below = below or x
            self.aside.append(below)

    @property
    def last(self) -> str:
        return self.names[-1] if self.names else ""

    @property
    def in_aside(self) -> bool:
        return bool(self.aside) and self.aside[-1]

    @property
    def in_article(self) -> int:
        return self.article[-1] if self.article else 0


def blocks_of(html: str) -> list[tuple[str, int, bool]]:
    """(text, number of the outermost article or main it stands in or 0, aside) of each block, in page order."""
    out: list[tuple[str, int, bool]] = []
    text: list[str] = []
    stack = Open()
    articles, last = 0, 0

    held: list[list[str]] = []  # the text before each open inline element that is beside the article
    inline: list[tuple[str, bool]] = []  # inline elements open since the first of those
    inside: dict[str, int] = {}  # how many of them have a name

    def flush() -> None:
        if held:  # such an element ends with its block at the latest
            text[:] = held[0]
            held.clear()
            inline.clear()
            inside.clear()
        if text:
            if block := " ".join(unescape("".join(text)).split()):
                out.append((block, stack.in_article, stack.in_aside))
            text.clear()

    for m in TAG.finditer(html):
        if m.start() > last:
            text.append(html[last : m.start()])
        last = m.end()
        name = m["name"]
        if name is None:
            if m["raw"] and m["raw"].lower() not in ("textarea", "select", "title", "svg", "math"):
                continue
            text.append(" " if m["raw"] else "")
            continue
        name = name.lower()
        if name in VOID or name in INLINE:
            if name in ("br", "td", "th", "img"):
                text.append(" ")
            elif name == "hr":
                flush()
            elif name in VOID:
                pass
            elif m["end"]:
                if inside.get(name):
                    gone, ended = 0, ""
                    while ended != name:
                        ended, off = inline.pop()
                        inside[ended] -= 1
                        gone += off
                    if gone:
                        text[:] = held[-gone]
                        del held[-gone:]
            elif not m["attrs"].endswith("/"):
                off = bool(m["attrs"]) and is_aside(name, m["attrs"], stack.in_article > 0)
                if off:
                    held.append(list(text))
                    text.clear()
                if held:
                    inline.append((name, off))
                    inside[name] = inside.get(name, 0) + 1
            continue
        flush()
        if m["end"]:
            stack.close(name)
            continue
        if stack.last == "p":  # a block ends a paragraph, an item the one before it
            stack.cut(len(stack.names) - 1)
        if stack.last == name and name in ("li", "dt", "dd", "tr"):
            stack.cut(len(stack.names) - 1)
        if name in ("article", "main", "body") and not stack.in_article and stack.beside:
            stack.cut(stack.beside[0])  # an unclosed menu or header doesn't reach into the article
        if m["attrs"].endswith("/"):
            continue
        off = is_aside(name, m["attrs"], stack.in_article > 0)
        article = stack.in_article
        if name in ("article", "main") and not articles and not off:  # what holds the first article is not beside it
            stack.only_named()
        if name in ("article", "main") and not article and not off and not stack.in_aside:
            articles += 1
            article = articles
        stack.push(name, off, article)
    text.append(html[last:])
    flush()
    return out


def marked(blocks: list[tuple[str, int, bool]]) -> set[int]:
    """The numbers of the articles that count: the longest, and the others where none holds half of the text."""
    sizes: dict[int, int] = {}
    for block, article, aside in blocks:
        if article and not aside:
            sizes[article] = sizes.get(article, 0) + len(block)
    if not sizes:
        return set()
    longest = max(sizes, key=lambda k: (sizes[k], -k))
    return {longest} if 2 * sizes[longest] >= sum(sizes.values()) else set(sizes)


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """The places in a of one longest common subsequence of a and b (bit-parallel rows)."""
    n, m, low = len(a), len(b), 0
    while low < min(n, m) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(n, m) - low and a[n - 1 - high] == b[m - 1 - high]:
        high += 1
    found = [*range(low), *range(n - high, n)]
    a, b = a[low : n - high], b[low : m - high]
    if a and b:
        places: dict[int, int] = {}
        for j, x in enumerate(b):
            places[x] = places.get(x, 0) | 1 << j
        full = (1 << len(b)) - 1
        row, rows = full, []
        for x in a:
            hit = row & places.get(x, 0)
            row = ((row + hit) | (row - hit)) & full
            rows.append(row)
        i, j = len(a), len(b)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                found.append(low + i)
    return sorted(found)


def host_and_path(url: str | None) -> tuple[str, str]:
    """(host, path with numbers padded so that near numbers are near)."""
    try:
        parts = urlsplit(url or "")
        host, path = parts.hostname or "", parts.path
    except ValueError:
        host, path = "", url or ""
    return host, re.sub(r"\d+", lambda m: m[0].lstrip("0").rjust(20, "0"), path.rstrip("/"))


def nearer(path: str, before: str | None, after: str | None) -> int:
    """-1 or 1 for the neighbour whose path shares the longer prefix (the first one if equal), 0 if there is none."""

    def shared(other: str | None) -> int:
        if other is None:
            return -1
        n = min(len(path), len(other))
        return next((i for i in range(n) if path[i] != other[i]), n)

    x, y = shared(before), shared(after)
    return 0 if x < 0 and y < 0 else -1 if x >= y else 1


def candidates(blocks: list[tuple[str, int, bool]]) -> tuple[list[int], bool]:
    """(places of the blocks that may be the page's text, whether the page marks its article)."""
    own = marked(blocks)
    if own:
        return [k for k, (_, article, aside) in enumerate(blocks) if article in own and not aside], True
    return [k for k, (_, _, aside) in enumerate(blocks) if not aside], False


def line_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows(page_id, url, key, html) the columns of PARSED: lines and sizes (0 beside the article) of
    all blocks, the places and texts of the candidates, whether the page marks its article."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS_PARSED):
            part = batch.slice(first, ROWS_PARSED)
            out: list[tuple] = []
            for key, url, html in zip(*(part.column(k).to_pylist() for k in (2, 1, 3))):
                blocks = blocks_of(html)
                places, article = candidates(blocks)
                out.append((key, *host_and_path(url), [line_hash(b) for b, _, _ in blocks], [0 if aside else len(b) for b, _, aside in blocks], places, [blocks[k][0] for k in places], article))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["page_id", "url", "key", "host", "path", "lines", "sizes", "places", "texts", "article"])


ROWS_PARSED = 1024
PARSED = "page_id {}, url string, key long, host string, path string, lines array<long>, sizes array<int>, places array<int>, texts array<string>, article boolean"
LINES = ["key", "host", "path", "lines", "sizes", "places", "article"]


def shared_lines(before: tuple | None, row: tuple, after: tuple | None, copies: float) -> list[int]:
    """The places of row's lines that its nearest page shares; rows are of LINES and common."""
    before = before if before and before[1] == row[1] else None
    after = after if after and after[1] == row[1] else None
    side = nearer(row[2], before and before[2], after and after[2])
    if not side or not row[3]:
        return []
    found = common_lines(row[3], (before if side < 0 else after)[3])
    if sum(row[4][k] for k in found) > copies * sum(row[4]):
        return []
    may = set(row[5])
    if row[6]:
        common = set(row[7] or ())
        may = {k for k in may if row[3][k] in common}
    return [k for k in found if k in may]


def common_in_host(lines: DataFrame, least_pages: int) -> DataFrame:
    """host, common: the lines within marked articles of over half of a host's pages, and of least_pages at least.

    They are at most twice the lines of the host's mean page.
    """
    pages = lines.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    own = F.array_distinct(F.transform("places", lambda k: F.get("lines", k)))
    counts = lines.where("article").select("host", F.explode(own).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    return counts.join(pages, "host").where("2 * n > pages").groupBy("host").agg(F.collect_list("line").alias("common"))


def difference(lines: DataFrame, copies: float, least_pages: int = 4) -> DataFrame:
    """key, shared (places of candidate lines to delete, one at least) of rows of LINES."""
    common = cut_lineage(common_in_host(lines, least_pages))  # written first, so that the join stands alone and a hot host is split
    lines = lines.select(*LINES).join(common, "host", "left").select(*LINES, "common")
    kinds = "key long, host string, path string, lines array<long>, sizes array<int>, places array<int>, article boolean, common array<long>"

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            yield batch.append_column("part", pa.array(np.full(batch.num_rows, part, np.int32)))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = first or batch.slice(0, 1)
                last = batch.slice(batch.num_rows - 1)
        if first:
            yield from (first.append_column("last", pa.array([False])), last.append_column("last", pa.array([True])))

    ordered = cut_lineage(lines.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key").mapInArrow(numbered, kinds + ", part int"))
    edge = cut_lineage(ordered.mapInArrow(ends, kinds + ", part int, last boolean"))
    order = sorted(r["part"] for r in edge.where("last").select("part").collect())
    if len(order) > 1:
        to = {(p, last): order[k + (1 if last else -1)] for k, p in enumerate(order) for last in (False, True) if 0 <= k + (1 if last else -1) < len(order)}
        sent = lines.sparkSession.createDataFrame([(p, last, q) for (p, last), q in to.items()], "part int, last boolean, to int")
        ghosts = edge.join(F.broadcast(sent), ["part", "last"]).drop("part", "last").withColumnRenamed("to", "part").withColumn("ghost", F.lit(True))
        ordered = ordered.withColumn("ghost", F.lit(False)).unionByName(ghosts).repartition("part").sortWithinPartitions("part", "host", "path", "key", "ghost")
    else:
        ordered = ordered.withColumn("ghost", F.lit(False)).sortWithinPartitions("part", "host", "path", "key")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = row = None
        out: list[tuple] = []

        def judge(after: tuple | None) -> None:
            if row and not row[9]:
                around = (x if x and x[8] == row[8] else None for x in (before, after))
                if found := shared_lines(next(around), row, next(around), copies):
                    out.append((row[0], found))

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([s for _, s in out], pa.list_(pa.int32()))], ["key", "shared"])

        for batch in batches:
            for then in zip(*(c.to_pylist() for c in batch.columns)):
                judge(then)
                before, row = row, then
            yield batch_of()
            out.clear()
        judge(None)
        yield batch_of()

    return ordered.mapInArrow(pair, "key long, shared array<int>").groupBy("key").agg(F.min("shared").alias("shared"))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", copies: float = 0.5, least_pages: int = 4) -> DataFrame:
    """id, url, text of every row of pages. copies: the share of text above which a pair is of copies."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.xxhash64("page_id", F.col("page_id").isNull(), "url", F.col("url").isNull(), "html"))
    parsed = stored(rows.select("page_id", "url", "key", "html").mapInArrow(_parsed, PARSED.format(kind)))
    masks = cut_lineage(difference(parsed.select(*LINES), copies, least_pages))
    if masks.isEmpty():
        kept = F.col("texts")
    else:
        parsed = parsed.join(masks, "key", "left")
        kept = F.when(F.col("shared").isNull(), F.col("texts")).otherwise(F.filter("texts", lambda _, k: ~F.array_contains("shared", F.get("places", k))))
    return parsed.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), F.array_join(kept, "\n\n").alias("text"))
