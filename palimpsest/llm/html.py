"""Main text of web pages, with site templates removed by counting element subtrees per host (operator 8).

A page is read into blocks of text and the elements around them, inline ones too. Each element subtree (its tag and text,
whatever its names say) is hashed and counted over the distinct pages of a host, and of a section of it (the first part
of the path). Pages are told apart by their main text outside the subtree: its longest, second and third longest block,
and the greatest of the three counts holds. So copies of an article count once, also where they differ in a date, and a
long notice doesn't hide a menu. What stands in an article or main element is the article's own, unless nearly all pages
(``NEARLY``, ``COPIES`` at least) of the host or section have it there. Elsewhere, also in pages without such an element, a subtree is template
from ``MIN_PAGES`` distinct pages and ``SHARE`` of those of its host or section on. One of ``LONG`` words or more that is
no main text (in a footer, say) on ``COPIES`` distinct pages or more is template by that alone, however large the host,
and goes wherever it stands; a shorter one, which may be a table's "yes" or a heading, goes only in the place where it is
counted. So a sentence that many articles of a host share stays. Templates are deleted from all pages of the host.

Of what is left scripts, styles, menus, headers, footers, sidebars, notices, adverts, forms and reader comments go by
their tags, roles and names (but not where they wrap the article or most of the page's text); if the page has an article
(else a main element), only what is in it stays.

Subtrees on fewer pages than any template go first. The counts are grouped per (host, section, subtree, page) first, so a
host with a third of all pages meets in no task. The template table is broadcast by host if it is small (``MAX_TEMPLATES``
rows), else it is joined by host and subtree and gathered per page. Pages are read again rather than stored between.

Nulls: a null html is empty, a null url has the host ''. Repeated pages each give a row; an empty table an empty
result; other columns aren't read.
"""

from __future__ import annotations

import re
import uuid
from html import unescape
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import as_long, bounded, materialise, shared_folder

MIN_PAGES, SHARE, NEARLY = 3, 0.5, 0.9
LONG, COPIES = 8, 8
OTHERS = 3
#: Where a subtree stands: in an article; elsewhere; long and no main text.
IN_ARTICLE, ELSEWHERE, LONG_OUTSIDE = 0, 1, 2
MAX_TEMPLATES = 200_000
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
#: Hold text up to their own end tag, whatever it looks like; CODE also where that is missing, as in browsers.
CODE = frozenset("script style".split())
RAW = CODE | frozenset("textarea title".split())
END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE) for tag in RAW}
NEXT = {tag: re.compile(rf"<(/?){tag}\b", re.IGNORECASE) for tag in RAW}
#: Elements within lines that are dropped; those of the second kind hold none of their kind.
INLINE = frozenset("noscript template svg math iframe object canvas select button".split())
FLAT = frozenset("noscript iframe canvas select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Other elements within lines, which are elements like any other but begin no block.
PHRASES = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav header footer aside form head menu dialog fieldset".split())
DROPPED_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert gdpr sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination footer masthead topbar toolbar comment comments disqus respond reply replies newsletter subscribe signup login share sharing social related recommended popup modal overlay widget".split()
)
#: Readers' words may be most of a page's text and are still not the page's own.
READERS = frozenset("comment comments disqus respond reply replies".split())
#: Parts of a name that say nothing; a name is one of the above if all its other parts are.
NEUTRAL = frozenset("wrapper wrap container box bar list block area section site global top bottom left right".split())
#: These wrap a whole page now and then, form and fieldset in earnest and the others by mistake.
WRAPPERS, RARE_WRAPPERS = frozenset(("form", "fieldset")), frozenset(("header", "footer", "aside"))
HEADINGS = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: A tag that opens closes an open element of these, up to the nearest of the second.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
NOT_IN_P = BLOCKS - {"html", "body", "option"}


class Page:
    """Blocks of a page's text, and its elements as ranges of them."""

    def __init__(self, html: str):
        self.parts: list[tuple[int, str]] = []  # block number, text
        self.elements: list[list] = []  # tag, first part, end part, dropped by a tag, by a name (see named)
        self.cut: dict[int, int] = {}  # for open elements of INLINE the part at which a block began in them
        self.line: dict[int, int] = {}  # block in which elements of INLINE began; it goes on after them
        self.block = 0
        self.open: list[int] = []
        at, match, endless = 0, TOKEN.match, set()
        while m := match(html, at):
            at, tag = m.end(), m[2]
            if tag is None:
                if html[m.start()] != "<" or at == m.start() + 1:
                    self.parts.append((self.block, m[0]))
                continue
            tag = tag.lower()
            if m[1]:
                self.close(tag)
            elif tag in RAW:
                if tag in endless or m[3].endswith("/") and ((ahead := NEXT[tag].search(html, at)) is None or not ahead[1]):
                    continue
                if end := END[tag].search(html, at):
                    at = end.end()
                elif tag in CODE:
                    break
                else:
                    endless.add(tag)
            elif tag in INLINE:
                if not m[3].endswith("/"):
                    self.start_inline(tag, True, 0)
            elif tag in PHRASES:
                if not m[3].endswith("/"):
                    self.start_inline(tag, False, self.named(m[3], False) if m[3] else 0)
            elif tag == "br":
                self.parts.append((self.block, " "))
            elif tag in BLOCKS and tag not in VOID:
                self.start(tag, m[3])
            elif tag == "hr":
                self.block += 1
        self.end_down_to(0)

    def end_down_to(self, level: int) -> None:
        """Ends open elements; one of INLINE without an end tag of its own reaches to the first block in it only."""
        for at in self.open[level:]:
            self.elements[at][2] = self.cut.pop(at, len(self.parts))
        del self.open[level:]
        self.block += 1

    def start_inline(self, tag: str, by_tag: bool, by_name: int) -> None:
        if tag in FLAT:
            for level in range(len(self.open) - 1, -1, -1):
                at = self.open[level]
                if self.elements[at][0] == tag:
                    self.elements[at][2] = self.cut.pop(at, len(self.parts))
                    del self.open[level]
                    break
        self.line[len(self.elements)] = self.block
        self.open.append(len(self.elements))
        self.elements.append([tag, len(self.parts), None, by_tag, by_name])

    def start(self, tag: str, attributes: str) -> None:
        closed, within = (("p",), ("article", "section", "div", "td", "blockquote", "li", "body")) if tag in NOT_IN_P else ((), ())
        rules = [(closed, within)] + ([CLOSES[tag]] if tag in CLOSES else [])
        for names, stop in rules:
            for level in range(len(self.open) - 1, -1, -1):
                name = self.elements[self.open[level]][0]
                if name in names:
                    self.end_down_to(level)
                    break
                if name in stop:
                    break
        by_tag, by_name = tag in DROPPED, 0
        if attributes and tag not in ("html", "body", "main"):
            by_name = self.named(attributes, tag in HEADINGS)
        if tag == "header" and any(self.elements[at][0] == "article" for at in self.open):
            by_tag = False  # an article's own head
        self.block += 1
        if tag != "option":
            for at in self.open:
                if self.elements[at][0] in INLINE or self.elements[at][0] in PHRASES:
                    self.cut.setdefault(at, len(self.parts))
        self.open.append(len(self.elements))
        self.elements.append([tag, len(self.parts), None, by_tag, by_name])

    @staticmethod
    def named(attributes: str, heading: bool) -> int:
        """0 if nothing tells that an element is no main text, 2 if it is readers' words by its name, else 1.

        Class names count whole, an id too; an id of a heading or paragraph is a link's target and doesn't count."""
        told = 0
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "class" or key == "id" and not heading:
                for name in value.split():
                    parts = {x for x in re.split(r"[^a-z0-9]+", name) if x and not x.isdigit()} - NEUTRAL
                    if parts and parts <= DROPPED_NAMES:
                        told = 2 if told == 2 or parts & READERS else 1
            elif key == "role" and value in DROPPED_ROLES or key == "aria-hidden" and value == "true" or key == "hidden" and value != "false":
                told = told or 1
            elif key == "style" and re.search(r"display\s*:\s*none", value):
                told = told or 1
        return told

    def close(self, tag: str) -> None:
        for level in range(len(self.open) - 1, -1, -1):
            if self.elements[self.open[level]][0] == tag:
                self.cut.pop(self.open[level], None)
                line = self.line.get(self.open[level])
                self.end_down_to(level)
                if line is not None:
                    self.block = line
                return
        if tag in BLOCKS:
            self.block += 1

    def kept(self) -> bytearray:
        """For each part, 1 if it belongs to the main text as far as tags and names tell."""
        keep = bytearray(b"\x01" * len(self.parts))
        loose = []
        for e in self.elements:
            if e[3] and e[0] not in WRAPPERS and e[0] not in RARE_WRAPPERS:
                keep[e[1] : e[2]] = bytes(e[2] - e[1])
            elif e[3] or e[4]:
                loose.append(e)
        mains = [e for e in self.elements if e[0] in ("article", "main") and not e[4]]
        if loose:
            # Characters before each part, without those that are gone already.
            sizes = [0, *accumulate(len(t.strip()) if k else 0 for (_, t), k in zip(self.parts, keep, strict=True))]
            for tag, first, end, by_tag, by_name in loose:
                most = by_name < 2 and 2 * (sizes[end] - sizes[first]) > sizes[-1]
                holds = any(first <= e[1] and e[2] <= end and e[1] < e[2] for e in mains)
                if not (most and holds if by_tag and tag in RARE_WRAPPERS else most or holds):
                    keep[first:end] = bytes(end - first)
        inside = bytearray(len(self.parts))
        wanted = [e for e in mains if e[0] == "article" and any(keep[e[1] : e[2]])] or [e for e in mains if any(keep[e[1] : e[2]])]
        #: Whether the main text is what an article or main element holds.
        self.in_article = bool(wanted)
        for e in wanted:
            inside[e[1] : e[2]] = b"\x01" * (e[2] - e[1])
        return bytearray(a & b for a, b in zip(keep, inside, strict=True)) if wanted else keep

    def subtrees(self, keep: bytearray) -> list[tuple[int, int, int, int]]:
        """(hash, first, end, place) of the elements that have text. Short ones within the main text (``keep``) and
        elsewhere differ."""
        clean = [" ".join(t.split()) for _, t in self.parts]
        found = []
        for tag, first, end, *_ in self.elements:
            body = "\x1f".join(x for x in clean[first:end] if x)
            if body:
                long, main = body.count(" ") + body.count("\x1f") + 1 >= LONG, any(keep[first:end])
                place = LONG_OUTSIDE if long and not main else IN_ARTICLE if main and self.in_article else ELSEWHERE
                zone = "" if long else "\x1e1" if main else "\x1e0"
                found.append((as_long(xxhash.xxh64_intdigest(f"{tag}\x1e{body}{zone}")), first, end, place))
        return found

    def text(self, keep: bytearray) -> str:
        blocks: dict[int, list[str]] = {}
        for (block, text), k in zip(self.parts, keep, strict=True):
            if k:
                blocks.setdefault(block, []).append(text)
        lines = (" ".join(unescape("".join(x)).split()) for x in blocks.values())
        return "\n".join(x for x in lines if x)


def host() -> Column:
    """The lower-case host of ``url``, without user and port, as a hash; '' for a null or relative url."""
    name = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1)
    return F.xxhash64(F.lower(name)).alias("host")


def section() -> Column:
    """The first part of the path of ``url``, with a slash, if more of the path follows it; as a hash."""
    return F.xxhash64(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*/([^/?#]+/)", 1)).alias("section")


#: Stands for the page itself among its subtrees, and for the host among its sections.
WHOLE = 0
PAGES = [f"page{k}" for k in range(OTHERS)]


def others(page: Page, keep: bytearray) -> list[tuple[int, int]]:
    """(hash, block number) of the blocks of the text that stays, longest first."""
    blocks: dict[int, list[str]] = {}
    for (block, text), k in zip(page.parts, keep, strict=True):
        if k:
            blocks.setdefault(block, []).append(text)
    joined = sorted(((" ".join("".join(x).split()), block) for block, x in blocks.items()), key=lambda x: (-len(x[0]), x[0]))
    return [(as_long(xxhash.xxh64_intdigest(text)), block) for text, block in joined if text]


def hashed(pages: DataFrame) -> DataFrame:
    """``host``, ``section``, ``subtree`` (hash), ``place`` and, in PAGES, what tells pages apart: each subtree of a page
    once in each place, and the page."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, part, html in zip(batch.column("host").to_pylist(), batch.column("section").to_pylist(), batch.column("html"), strict=True):
                page = Page(html.as_py() or "")
                keep = page.kept()
                blocks = others(page, keep)
                rows.append((name, part, WHOLE, IN_ARTICLE, *([h for h, _ in blocks[:OTHERS]] + [None] * OTHERS)[:OTHERS]))
                done = set()
                for h, first, end, place in page.subtrees(keep):
                    if (h, place) in done:
                        continue
                    done.add((h, place))
                    rest, inside = [], {block for block, _ in page.parts[first:end]}
                    for other, block in blocks:
                        if block not in inside:
                            rest.append(other)
                            if len(rest) == OTHERS:
                                break
                    if rest:
                        rows.append((name, part, h, place, *rest, *[None] * (OTHERS - len(rest))))
            columns = zip(*rows, strict=True) if rows else [()] * (4 + OTHERS)
            names = ["host", "section", "subtree", "place", *PAGES]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if n == "place" else pa.int64()) for n, x in zip(names, columns, strict=True)], names=names)

    types = "host long, section long, subtree long, place int, " + ", ".join(f"{x} long" for x in PAGES)
    path = f"{shared_folder(pages.sparkSession)}/subtrees-{uuid.uuid4().hex}"
    pages.select(host(), section(), "html").mapInArrow(run, types).write.parquet(path)
    return pages.sparkSession.read.schema(types).parquet(path)


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """``host`` and ``subtree`` (hashes) of the subtrees that are template."""
    rows = hashed(pages)
    is_page = F.col("subtree") == WHOLE
    sizes = counted(rows.where(is_page)).select("host", "section", F.col("n").alias("pages"))
    sizes = bounded(sizes, MAX_TEMPLATES)
    # Most subtrees are on too few pages of their host or section, whatever these are, and go before the wider rows are
    # shuffled: a count of rows is never below one of distinct pages.
    trees = rows.where(~is_page)
    plain = trees.groupBy("host", "section", "subtree", "place").agg(F.count("*").alias("n"))
    whole = F.lit(WHOLE).cast("long").alias("section")
    plain = plain.unionByName(plain.groupBy("host", whole, "subtree", "place").agg(F.sum("n").alias("n")))
    many = plain.where(F.col("n") >= min_pages).join(sizes, ["host", "section"]).where(template(share)).select("host", "subtree").distinct()
    counts = counted(trees.join(bounded(many, MAX_TEMPLATES), ["host", "subtree"])).where(F.col("n") >= min_pages)
    return counts.join(sizes, ["host", "section"]).where(template(share)).select("host", "subtree").distinct()


def template(share: float) -> Column:
    """Whether a subtree (in a ``place`` of ``n`` pages) of a host's ``section`` with ``pages`` in all is template."""
    least = F.when(F.col("place") == IN_ARTICLE, F.greatest(F.lit(COPIES), max(share, NEARLY) * F.col("pages"))).otherwise(share * F.col("pages"))
    return (F.col("n") >= least) | ((F.col("place") == LONG_OUTSIDE) & (F.col("section") == WHOLE) & (F.col("n") >= COPIES))


def counted(rows: DataFrame) -> DataFrame:
    """``n``, the distinct pages of each ``host``, ``section`` (WHOLE: all), ``subtree`` and ``place``."""
    by = ["host", "section", "subtree", "place"]
    rows = rows.withColumn("section", F.explode(F.array(F.lit(WHOLE).cast("long"), "section")))
    told = rows.select(*by, F.posexplode(F.array(*PAGES)).alias("k", "page")).where("page IS NOT NULL")
    counts = told.distinct().groupBy(*by, "k").agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.max("n").alias("n"))


def listed(batches):
    """The subtrees of each page."""
    for batch in batches:
        found = []
        for name, body, html in zip(batch.column("host").to_pylist(), batch.column("body").to_pylist(), batch.column("html"), strict=True):
            page = Page(html.as_py() or "")
            found += [(name, body, h) for h in {h for h, *_ in page.subtrees(page.kept())}]
        columns = zip(*found, strict=True) if found else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["host", "body", "subtree"])


def extracted(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """``page_id``, ``url`` and ``text`` (the main text; empty if none) of each page."""
    found = materialise(templates(pages, min_pages, share))
    rows = pages.select("page_id", "url", "html", host())
    if found.limit(MAX_TEMPLATES + 1).count() <= MAX_TEMPLATES:
        rows = rows.join(F.broadcast(found.groupBy("host").agg(F.collect_list("subtree").alias("trees"))), "host", "left")
    else:
        body = F.xxhash64("host", "html").alias("body")
        trees = rows.select("host", "html", body).mapInArrow(listed, "host long, body long, subtree long").distinct()
        lists = trees.join(found, ["host", "subtree"]).groupBy("body").agg(F.collect_list("subtree").alias("trees"))
        rows = rows.withColumn("body", body).join(lists, "body", "left")
    rows = rows.select("page_id", "url", "html", "trees")

    def run(batches):
        for batch in batches:
            texts = []
            for html, trees in zip(batch.column("html"), batch.column("trees"), strict=True):
                page = Page(html.as_py() or "")
                keep, template = page.kept(), set(trees.as_py() or ())
                if template:
                    for h, first, end, _ in page.subtrees(keep):
                        if h in template:
                            keep[first:end] = bytes(end - first)
                texts.append(page.text(keep))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType())]))
