"""Main text of pages: markup first, then differencing against the page with the nearest URL.

A page is read into lines, one per block, each either in an article, open, or marked as boilerplate by its
element or by a word in an ancestor's class, id or role. Pages of a host are sorted by URL path, and each
is paired with the page before it whose lines differ (the first with the one after). The lines
outside articles of both are aligned by their longest common subsequence, and shared lines are deleted.

The text is the article's lines; on a page without an article, the open lines (inside a main
element, if there is one) that are not shared. Lines inside an article are never deleted:
syndicated articles share them, too.

Html is shuffled once, by host. A host with more than ``MOST`` pages, and more than one in
``PARTS`` of all, is cut into ranges of its sorted pages at quantiles of a sample; there are fewer than PARTS such
hosts, and their cuts are what is broadcast. A page whose pair lies in another range gets a copy of that page:
digests of the lines of a large host's pages tell, for each range, the nearest page before it (for the pages that begin the host,
after it) with other lines. So the pairs are those of the whole host, however it is cut. A task streams its
sorted pages and holds two pages' lines at a time.

Defined cases: a null html is empty, and so is its text; a missing or odd URL counts as an empty host and path; pages of
one URL are ordered by page_id, then by a hash of the html; pages with
the same lines do not erase each other; repeated rows each give their row; unclosed and stray tags
are closed or ignored as the next block begins; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from html.parser import HTMLParser
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weblog.llm.common import pick, table

MOST, PARTS = 1000, 4096
#: Rows of a large host's sample for each range, and the order of a host's pages.
SAMPLE, KEY = 32, ["path_", "page_id", "hash_"]

BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section
    summary table tbody tfoot thead title tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text, and those that don't outside of an article.
NEVER = set("""head script style noscript template nav footer aside form menu dialog iframe object svg canvas audio video button
    select textarea input datalist search""".split())
OUTSIDE = {"header"}
#: Words of class, id or role that mark boilerplate anywhere, and outside of an article only.
WORDS = set("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice
    notices popup modal newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer
    comment comments commentlist respond disqus reply replies share sharing social related recommended widget pagination pager
    login signup paywall contentinfo complementary alert""".split())
OUTSIDE_WORDS = set("header banner masthead topbar toolbar search logo copyright".split())
#: Such ancestors keep an article in them dropped; of others (a layout named after its sidebar) it breaks free.
FIRM = set("comment comments commentlist respond disqus reply replies related recommended".split())
#: What follows one of these in a name (with-sidebar, no-menu) says how a page is laid out, not what the element is.
LAYOUT = set("with without has no".split())
#: Ids of headings are slugs of their text, and so are those of these elements in main text.
HEADINGS, SLUGGED = set("h1 h2 h3 h4 h5 h6".split()), set("section p li dt dd a blockquote pre".split())
ARTICLE, MAIN, OPEN, BOILERPLATE = range(4)


def marking(tag: str, named: dict, content: bool, inside: bool) -> set[str]:
    """Words of an element's class, id and role; ``content``: it is an article, ``inside``: it lies in main text."""
    words: set[str] = set()
    for name in ("class", "id", "role"):
        own: set[str] = set()
        for token in (named.get(name) or "").lower().split():
            own.update(takewhile(lambda w: w not in LAYOUT, re.findall("[a-z]+", token)))
        if name == "id":
            if tag in HEADINGS:
                continue
            section = tag in SLUGGED or tag == "div" and "section" in (named.get("class") or "").lower().split()
            if (content or inside and section) and not own <= FIRM:
                continue
        words |= own
    return words


class Lines(HTMLParser):
    """Lines of a page and their kinds.

    Where all lines of a page would be boilerplate, the words of an element that holds more than half of its text don't
    count (of such elements, from the outermost to the first that then leaves a line).
    """

    def __init__(self, html: str, free: frozenset = frozenset()):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[int, str]] = []
        # Tag, kind, firm, the innermost element (by its number) that a word marks: 0 none; below 0 what is dropped
        # whatever words say (-2: and isn't counted as the page's text).
        self.stack: list[tuple[str, int, bool, int]] = []
        self.held: list[str] = []
        self.free, self.elements, self.size = free, 0, 0
        self.marks: list[int] = []  # of each line
        self.held_by: dict[int, int] = {}  # characters of lines before a marked element, then in it
        self.feed(html)
        self.close()
        self._cut(0)
        if not free and self.lines and all(kind == BOILERPLATE for kind, _ in self.lines):
            wide = {i for i, size in self.held_by.items() if 2 * size > self.size}
            first = min(wide.intersection(self.marks), default=0)
            if first:
                self.lines = Lines(html, frozenset(i for i in wide if i <= first)).lines

    def _kind(self) -> int:
        return self.stack[-1][1] if self.stack else OPEN

    def _end(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held.clear()
        if text:
            self.lines.append((self._kind(), text))
            self.marks.append(self.stack[-1][3] if self.stack else 0)
            if self.marks[-1] > -2:
                self.size += len(text)

    def _cut(self, at: int) -> None:
        self._end()
        self._leave(at)

    def _leave(self, at: int) -> None:
        """Take elements from the stack; of those that a word marks, keep how much text they hold."""
        for i in range(at, len(self.stack)):
            mark = self.stack[i][3]
            if mark > 0 and (i == 0 or self.stack[i - 1][3] != mark):
                self.held_by[mark] = self.size - self.held_by[mark]
        del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end()
            for i in range(len(self.stack) - 1, -1, -1):  # a block closes an open paragraph, a list item its neighbour
                if self.stack[i][0] == "p" or self.stack[i][0] == tag and tag in ("li", "tr", "dd", "dt", "option"):
                    self._cut(i)
                    break
                if self.stack[i][0] in BLOCKS:
                    break
        elif tag in ("br", "td", "th"):
            self.held.append(" ")
        if tag in VOID:
            return
        kind, firm, mark = self._kind(), bool(self.stack) and self.stack[-1][2], self.stack[-1][3] if self.stack else 0
        self.elements += 1
        named = dict(attrs)
        content = tag == "article" or named.get("itemprop") == "articleBody"
        words = marking(tag, named, content, kind in (ARTICLE, MAIN))
        if tag in ("body", "html") or self.elements in self.free:
            words -= WORDS | OUTSIDE_WORDS
        if tag in NEVER or "hidden" in named:
            kind, firm, mark = BOILERPLATE, True, -2
        elif words & WORDS:
            kind, firm = BOILERPLATE, firm or bool(words & FIRM)
            mark = min(mark, -1) if firm or mark < 0 else self.elements
        elif content and not firm:
            kind, mark = ARTICLE, 0
        elif kind in (OPEN, MAIN) and (tag in OUTSIDE or words & OUTSIDE_WORDS):
            kind, mark = BOILERPLATE, -1 if tag in OUTSIDE else self.elements
        elif kind != ARTICLE and not firm and (tag == "main" or "main" in words and named.get("role") == "main"):
            kind, mark = MAIN, 0
        elif kind == BOILERPLATE and mark >= 0 and (tag in OUTSIDE or words & OUTSIDE_WORDS):
            mark = -1 if tag in OUTSIDE else self.elements
        if kind != self._kind():
            self._end()
        self.stack.append((tag, kind, firm, mark))
        if mark == self.elements:
            self.held_by[mark] = self.size

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self._end()
        elif tag in VOID:
            self.held.append(" " if tag == "br" else "")

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag in BLOCKS or self.stack[i][1] != (self.stack[i - 1][1] if i else OPEN):
                    self._cut(i)
                else:
                    self._leave(i)
                return
            if tag not in BLOCKS and self.stack[i][0] in BLOCKS:
                return  # a stray inline end tag
        if tag in BLOCKS:
            self._end()

    def handle_data(self, data):
        self.held.append(data)


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence of both (by matches in rising order of ``b``)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    shared = {*range(head), *range(len(a) - tail, len(a))}
    places: dict[str, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []  # least end in b of a common subsequence of each length
    links: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        shared.add(link[0])
        link = link[1]
    return shared


def main_text(lines: list[tuple[int, str]], other: list[tuple[int, str]] | None) -> tuple[str, int]:
    """Text of a page, and the number of lines that it shares with the paired page's."""
    outside = [i for i, (kind, _) in enumerate(lines) if kind != ARTICLE]
    shared = set()
    if other is not None:
        shared = {outside[i] for i in common_lines([lines[i][1] for i in outside], [t for k, t in other if k != ARTICLE])}
    kinds = {kind for kind, _ in lines}
    wanted = ARTICLE if ARTICLE in kinds else MAIN if MAIN in kinds else OPEN
    return "\n".join(t for i, (kind, t) in enumerate(lines) if kind == wanted and i not in shared), len(shared)


def located(pages: DataFrame) -> DataFrame:
    """page_id, url, html with host_ and the key of a page's place in it: path_, page_id and hash_."""
    p = pick(pages, page_id="page_id", url="url", html="html")
    return p.withColumns({
        "page_id": F.col("page_id").cast("long"),
        "host_": F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit("")),
        "path_": F.concat_ws("?", F.try_parse_url("url", F.lit("PATH")), F.try_parse_url("url", F.lit("QUERY"))),
        "hash_": F.xxhash64("html")})


def large_cuts(p: DataFrame) -> list[tuple]:
    """Host and the rising keys at which it is cut, for each large host."""
    most = max(MOST, p.count() // PARTS)
    # Fewer than PARTS hosts can have more than that, and the sample holds about SAMPLE rows for each range.
    hosts = p.groupBy("host_").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).collect()
    if not hosts:
        return []
    large = p.sparkSession.createDataFrame([(r.host_,) for r in hosts], "host_ string")
    keys: dict[str, list] = {r.host_: [] for r in hosts}
    sample = p.join(F.broadcast(large), "host_").where(F.rand(7) < SAMPLE / most).select("host_", *KEY)
    for r in sample.orderBy("host_", *KEY).collect():
        keys[r.host_].append(tuple(r)[1:])
    out = []
    for r in hosts:
        found, parts = keys[r.host_], -(-r.n // most)
        cuts = [found[i * len(found) // parts] for i in range(1, parts)] if found else []
        out.append((r.host_, list(dict.fromkeys(cuts))))
    return out


def in_ranges(p: DataFrame, cuts: list[tuple]) -> DataFrame:
    """``p`` with group_, the range of a large host that a page lies in, and large_."""
    at = p.sparkSession.createDataFrame(
        cuts, "large_host_ string, cuts_ array<struct<path_: string, page_id: bigint, hash_: bigint>>")
    p = p.join(F.broadcast(at), F.col("host_") == F.col("large_host_"), "left")
    group = F.size(F.filter("cuts_", lambda c: c <= F.struct(*KEY)))
    return p.withColumns({"group_": F.when(F.col("cuts_").isNull(), 0).otherwise(group),
                          "large_": F.col("cuts_").isNotNull()}).drop("large_host_", "cuts_")


def range_ends(rows: DataFrame) -> dict[str, list[tuple]]:
    """Of each large host, its ranges in order: the first two and the last two different pages, from the range's ends inwards.

    A page is given by the digest of its lines and its key.
    """
    def run(batches):
        for batch in batches:
            lines = [hashlib.blake2b(repr(Lines(h or "").lines).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                     for h in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], pa.array(lines, pa.binary())],
                                             ["host_", "group_", *KEY, "lines_"])

    found = rows.where("large_").select("host_", "group_", *KEY, "html").mapInArrow(
        run, "host_ string, group_ int, path_ string, page_id long, hash_ long, lines_ binary")
    # All pages that don't look like the last one end before it, so the last of them precedes the run that ends the range.
    found = found.groupBy("host_", "group_", "lines_").agg(
        F.min(F.struct(*KEY)).alias("first_"), F.max(F.struct(*KEY)).alias("last_"))
    by = Window.partitionBy("host_", "group_")
    found = found.withColumns({"up_": F.row_number().over(by.orderBy("first_")),
                               "down_": F.row_number().over(by.orderBy(F.desc("last_")))})
    ends: dict[tuple, tuple] = {}
    for r in found.where("up_ <= 2 OR down_ <= 2").collect():  # at most four rows for each range
        first, last = ends.setdefault((r.host_, r.group_), ({}, {}))
        first[r.up_] = (bytes(r.lines_), tuple(r.first_))
        last[r.down_] = (bytes(r.lines_), tuple(r.last_))
    hosts: dict[str, list[tuple]] = {}
    for (host, group), (first, last) in sorted(ends.items()):
        hosts.setdefault(host, []).append((group, *[[x[k] for k in (1, 2) if k in x] for x in (first, last)]))
    return hosts


def bordering(ranges: list[tuple]) -> list[tuple]:
    """group, side and key of the pages that a host's ranges need from other ranges.

    Side 0 is the nearest page before the range that differs from its first page. Where there is none and the
    range's pages are all the same, side 2 is the nearest one after it that differs.
    """
    def walk(ranges):
        run = other = None  # the page that ends what was passed, and the last that differs from it
        for group, near, far in ranges:
            yield group, other if run and run[0] == near[0][0] else run
            if len(far) > 1:
                run, other = far[0], far[1]
            else:
                run, other = far[0], other if run and run[0] == far[0][0] else run

    before = dict(walk(ranges))
    after = dict(walk([(group, last, first) for group, first, last in reversed(ranges)]))
    out = []
    for group, first, _ in ranges:
        if before[group]:
            out.append((group, 0, before[group][1]))
        elif len(first) == 1 and after[group]:
            out.append((group, 2, after[group][1]))
    return out


def grouped(pages: DataFrame) -> DataFrame:
    """Located pages with group_ (the range of a large host) and side_: 1, or 0 and 2 for copies from before and after the range."""
    p = located(pages)
    cuts = large_cuts(p)
    if not cuts:
        return p.withColumns({"group_": F.lit(0), "side_": F.lit(1)})
    rows = in_ranges(p, cuts)
    wanted = [(host, *key, group, side) for host, ranges in range_ends(rows).items()
              for group, side, key in bordering(ranges)]
    rows = rows.drop("large_").withColumn("side_", F.lit(1))
    if not wanted:
        return rows
    wanted = p.sparkSession.createDataFrame(
        wanted, "h_ string, p_ string, i_ long, x_ long, group_ int, side_ int")
    same = ((F.col("host_") == F.col("h_")) & (F.col("path_") == F.col("p_")) & F.col("page_id").eqNullSafe(F.col("i_"))
            & (F.col("hash_") == F.col("x_")))
    keys = wanted.select("h_", "p_", "i_", "x_").distinct()
    copies = p.join(F.broadcast(keys), same, "left_semi").dropDuplicates(["host_", *KEY])
    copies = copies.join(F.broadcast(wanted), same).select(*rows.columns)
    return rows.unionByName(copies)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_shared (lines outside the article shared with its pair)."""
    rows = grouped(pages).repartition("host_", "group_").sortWithinPartitions("host_", "group_", "side_", *KEY, "html")

    def run(batches):
        group, waiting = None, []  # pages that begin a group, all with the same lines, wait for one with other lines
        last, before = None, None  # lines of the page before, and of the last one that differs from it
        html_before = None
        done, size = [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names)

        def put(found, lines, other):
            nonlocal done, size
            text, shared = main_text(lines, other)
            for row in found:
                done.append((*row, text, len(text), shared))
                size += len(text) + 64
                if size > 1 << 21:
                    yield made()
                    done, size = [], 0

        for batch in batches:
            for page_id, url, html, host, part, side in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if group != (host, part):
                    if waiting:
                        yield from put(waiting, last, None)
                    group, waiting, last, before = (host, part), [], None, None
                lines = last if last is not None and html == html_before else Lines(html or "").lines
                html_before = html
                if last is not None and lines != last:
                    before = last
                    if waiting:
                        yield from put(waiting, last, lines)
                    waiting = []
                last = lines
                if side == 1 and before is None:
                    waiting.append((page_id, url))
                elif side == 1:
                    yield from put([(page_id, url)], lines, before)
        if waiting:
            yield from put(waiting, last, None)
        if done:
            yield made()

    names = ["page_id", "url", "text", "n_chars", "n_shared"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return rows.select("page_id", "url", "html", "host_", "group_", "side_").mapInArrow(
        run, "page_id long, url string, text string, n_chars long, n_shared long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).drop("n_shared")


#: For the tables' pages, whose main text is their one article: its blocks by regular expressions.
ORACLE = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS html FROM pages),
b AS (
  SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(html, '</?(?:p|h1|h2|ul|li|div)\b[^>]*>'),
    lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'),
        '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))),
    lambda x: x <> '') AS lines
  FROM a)
SELECT page_id, url, array_to_string(lines, chr(10)) AS text, length(array_to_string(lines, chr(10))) AS n_chars FROM b
"""
