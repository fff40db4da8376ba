"""HTML extraction: the text of a page's article, by removal of what a site repeats.

Element subtrees are hashed from the bottom up, by tags and text (not attributes), and counted per host over the different
contents that they appear beside, so a page's copies count once. Subtrees that recur are templates and their blocks go: of
containers outside an article those beside MIN_PAGES contents and SHARE of the host's; of paragraphs outside an article, and
of containers inside one, those beside BODY_SHARE of them, since documents quote each other. Paragraphs inside an article
always stay. Hosts of few pages repeat nothing, so elements whose tag, role or name says what they are (menus, notices,
adverts, comments ...) go as well, on every page. What is left of the articles is the text; of a page without an <article>
that of <main>, or else of the whole body.

Blocks are runs of text between block tags; <br> is white space. Broken markup is read leniently: what is never closed ends
with its parent, paragraphs and list items end where the next begins, an <article> ends menus or forms left open before it.

Defined cases: null html is an empty text, so is a page whose text all goes. A null url, or one without a host, belongs to
the host ''. Repeated rows, null ids, and further columns of any name pass through. Nothing is capped; a page's memory is
some times its size. Empty tables give no rows.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from helixmill.llm.common import fresh, keep, map_in_arrow
from helixmill.llm.url_filter import host_and_path

MIN_PAGES, SHARE, BODY_SHARE = 5, 0.05, 0.5
#: Templates that every task may hold, at most; beyond that they are joined to the pages.
BROADCAST_TEMPLATES = 1 << 19
#: A host with more than this part of all pages is divided for that join.
HOT_PART = 1 / 2000

# Elements of HTML by what they do.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dt dd td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset("html body article main".split())
IN_HEAD = frozenset("title style script meta link base noscript template".split())
#: What the start of an element ends, and the elements that this doesn't reach beyond.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "body": ("head", "html")}
ENDS = {tag: (frozenset(ended.split()), WHOLE.union(limit.split())) for tag, (ended, limit) in ENDS.items()}
NOT_INLINE: frozenset[str] = frozenset(("",))  # as a limit: the innermost block
DROPPED_TAGS = frozenset("nav header footer aside form head script style title noscript template iframe noembed noframes object svg canvas audio video button select textarea dialog menu".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class names and ids that say what an element is, and words that may stand beside them.
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion banner banners cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal overlay"
    " sidebar sidebars aside menu menus nav navs navbar navigation breadcrumb breadcrumbs footer footers masthead comment comments disqus replies respond discussion share shares sharing social newsletter subscribe subscription related recommended recommendations"
    " widget widgets toolbar pagination pager login signin signup register search form forms disclaimer".split()
)
BESIDE_NAMES = frozenset("site page global main top bottom left right upper lower middle center box block container wrapper wrap area section list item items bar primary secondary inner outer content text slot unit region link links panel body group row col column reader readers user users article post entry thread and the of for sub sticky fixed floating mobile desktop header title head legal policy message privacy my by js".split())
HEADER_NAMES = frozenset(("header", "site-header", "page-header", "main-header", "top-header", "global-header"))

TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
UNENDED = re.compile(r"<[a-zA-Z/!?]")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ARTICLE_BODY = re.compile(r"itemprop\s*=\s*[\"']?articleBody", re.I)
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def says_dropped(attributes: str) -> bool:
    """Whether an element's role, class or id says that it isn't part of an article."""
    low = attributes.lower()
    return ("class" in low or "id" in low or "role" in low) and (_says_dropped(attributes) if len(attributes) < 500 else _says_dropped.__wrapped__(attributes))


@lru_cache(1 << 14)
def _says_dropped(attributes: str) -> bool:
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "role" and value.strip().lower() in DROPPED_ROLES:
            return True
        for own in value.split() if name in ("class", "id") else ():
            words = [w.lower() for w in WORD.findall(own) if not w.isdigit()]
            if own.lower() in HEADER_NAMES or any(w in DROPPED_NAMES for w in words) and all(w in DROPPED_NAMES or w in BESIDE_NAMES for w in words):
                return True
    return False


class Element:
    __slots__ = ("tag", "dropped", "scope", "parts", "first", "inline")

    def __init__(self, tag: str, dropped: bool, scope: int, first: int, inline: bool):
        self.tag, self.dropped, self.scope, self.first, self.inline, self.parts = tag, dropped, scope, first, inline, []


class Page:
    """blocks: (text, dropped, scope: 2 in an article, 1 in main, 0 elsewhere); subtrees: (digest, first block, end, kind)."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool, int]] = []
        self.subtrees: list[tuple[int, int, int, int]] = []
        self.stack = [Element("", False, 0, 0, False)]
        self.open: dict[str, int] = {}
        self.text, self.hidden, self.articles = [], 0, 0
        self._read(source)

    def _read(self, source: str) -> None:
        at, last, unclosed = 0, source.rfind(">"), set()
        while at <= last and (found := TAG.search(source, at)) is not None:
            self._say(source[at : found.start()])
            slash, tag, attributes = found[1], found[2], found[3]
            at = found.end()
            if tag is None:
                continue
            tag = tag.lower()
            if attributes and (quote := _open_quote(attributes)):  # a > inside quotes
                while quote and quote not in unclosed:
                    close = source.find(quote, at)
                    end = source.find(">", close) if close >= 0 else -1
                    if end < 0:
                        unclosed.add(quote)
                        break
                    quote, at = _open_quote(source[close + 1 : end]), end + 1
                attributes = source[found.start(3) : at - 1]
            if slash:
                self._end(tag)
            elif tag in ("br", "wbr"):
                self.text.append(" " if tag == "br" else "")
            elif tag == "hr":
                self._flush()
            elif tag not in VOID:
                self._start(tag, attributes)
                if tag in RAW:  # its text is no markup
                    close = RAW_ENDS[tag].search(source, at)
                    if tag == "xmp":
                        self.text.append(source[at : close.start() if close else len(source)])
                    at = close.end() if close else len(source)
                    self._close()
        rest = source[at:] if at < len(source) else ""
        self._say(rest[: unended.start()] if (unended := UNENDED.search(rest)) else rest)
        while len(self.stack) > 1:
            self._close()
        self._flush()

    def _say(self, text: str) -> None:
        if text and not self.hidden:
            if self.stack[-1].tag == "head" and text.strip():
                self._close()
            self.text.append(entities.unescape(text) if "&" in text else text)

    def _flush(self) -> None:
        if not self.text:
            return
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            top = next(e for e in reversed(self.stack) if not e.inline)
            self.blocks.append((text, top.dropped, top.scope))
            top.parts.append(text)

    def _start(self, tag: str, attributes: str) -> None:
        dropped = tag in DROPPED_TAGS or bool(attributes) and tag not in ("html", "body", "main") and says_dropped(attributes)
        if self.stack[-1].tag == "head" and tag not in IN_HEAD:
            self._close()
        if tag in INLINE:
            if dropped:
                self._push(Element(tag, True, self.stack[-1].scope, len(self.blocks), True))
            return
        self._flush()
        begins = tag in ("article", "main") and not dropped
        if begins and not self.articles and self.stack[-1].dropped:
            while self.stack[-1].dropped:
                self._close()
        if tag in ENDS:
            self._close_to(*ENDS[tag])
        if self.open.get("p"):
            self._close_to(("p",), NOT_INLINE)
        top = self.stack[-1]
        scope = top.scope
        if begins:
            self.articles += tag == "article"
            scope = max(scope, 2 if tag == "article" else 1)
        elif attributes and ARTICLE_BODY.search(attributes):
            scope = 2
        if tag == "header" and top.scope == 2 and not top.dropped:  # an article's own header: its headings stay
            self._push(Element(tag, True, 2, len(self.blocks), False))
        elif top.tag == "header" and top.scope == 2 and tag in HEADINGS and not any(e.dropped for e in self.stack[:-1]):
            self._push(Element(tag, False, 2, len(self.blocks), False))
        else:
            self._push(Element(tag, dropped or top.dropped, scope, len(self.blocks), False))

    def _push(self, element: Element) -> None:
        self.hidden += element.inline
        self.open[element.tag] = self.open.get(element.tag, 0) + 1
        self.stack.append(element)

    def _end(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        if self.open.get(tag):
            if self.stack[-1].tag == tag:
                self._close()
            else:
                self._close_to({tag}, WHOLE if tag not in WHOLE else frozenset())

    def _close_to(self, tags, limit) -> None:
        """Ends the innermost open element of tags and what is open inside it, unless one of limit comes first."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                while len(self.stack) > i:
                    self._close()
                return
            if self.stack[i].tag in limit or limit is NOT_INLINE and not self.stack[i].inline:
                return

    def _close(self) -> None:
        if not self.stack[-1].inline:
            self._flush()
        element = self.stack.pop()
        self.open[element.tag] -= 1
        self.hidden -= element.inline
        if not element.parts:
            return
        digest = blake2b("\x1f".join([element.tag, *element.parts]).encode("utf-8", "surrogatepass"), digest_size=8).digest()
        self.stack[-1].parts.append("\x1e" + digest.hex())
        prose = element.tag in PROSE
        if element.tag not in WHOLE and not (prose and element.scope == 2):
            self.subtrees.append((int.from_bytes(digest, "little", signed=True), element.first, len(self.blocks), int(prose or element.scope == 2)))

    def main(self, templates=frozenset()) -> str:
        """The text of what neither is a template nor says that it goes."""
        gone = bytearray(len(self.blocks))
        if templates:
            for digest, first, end, _ in self.subtrees:
                if digest in templates:
                    gone[first:end] = b"\1" * (end - first)
        left = [(text, scope) for (text, dropped, scope), x in zip(self.blocks, gone) if not (dropped or x)]
        scope = max((s for _, dropped, s in self.blocks if not dropped), default=0)
        return "\n\n".join(text for text, s in left if s >= scope)


def _open_quote(attributes: str) -> str:
    """The quote that is still open at the end."""
    quote = ""
    if '"' in attributes or "'" in attributes:
        for c in re.findall("[\"']", attributes):
            quote = "" if c == quote else quote or c
    return quote


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


# ---- subtrees of a site ----


def subtrees(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, content, subtree, kind): a page's different subtrees beside the digest of its text, and a row without a subtree."""

    def run(batches):
        for batch in batches:
            hosts, sources = batch.column("host"), batch.column("html")
            out = ([], [], [], [])
            for i in range(len(batch)):
                page = Page(sources[i].as_py() or "")
                content, own = _hash(page.main()), {d: kind for d, _, _, kind in page.subtrees}
                for values, more in zip(out, ([hosts[i].as_py()] * (len(own) + 1), [content] * (len(own) + 1), [None, *own], [0, *own.values()])):
                    values.extend(more)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.int32()))], names=["host", "content", "subtree", "kind"])

    return pages.select(host_and_path(F.col(f"`{url}`"))[0].alias("host"), F.col(f"`{html}`").alias("html")).mapInArrow(run, "host string, content long, subtree long, kind int")


def site_templates(pages: DataFrame, html: str = "html", url: str = "url", min_pages: int = MIN_PAGES, share: float = SHARE, body_share: float = BODY_SHARE) -> DataFrame:
    """(host, subtree, n, kind): subtrees that recur beside n different contents of their host, and enough of all."""
    beside = subtrees(pages, html, url).groupBy("host", "subtree", "content").agg(F.max("kind").alias("kind"))
    counted = keep(beside.groupBy("host", "subtree").agg(F.count("*").alias("n"), F.max("kind").alias("kind")).where((F.col("n") >= min_pages) | F.col("subtree").isNull()), "subtrees")
    contents = counted.where("subtree is null").select("host", F.col("n").alias("contents"))
    often = F.col("n") >= F.col("contents") * F.when(F.col("kind") == 1, F.lit(body_share)).otherwise(F.lit(share))
    return counted.where("subtree is not null").join(contents, "host").where(often).select("host", "subtree", "n", "kind")


# ---- texts ----


def extract(pages: DataFrame, html: str = "html", url: str = "url", into: str = "main_text", templates: DataFrame | None = None, broadcast_templates: int = BROADCAST_TEMPLATES) -> DataFrame:
    """pages with the article's text; a column of the name `into` is replaced. templates: as site_templates() gives them, e.g. of earlier pages."""
    templates = keep((site_templates(pages, html, url) if templates is None else templates).select("host", "subtree"), "templates")
    kept = [c for c in pages.columns if c.lower() != into.lower()]
    host, source, own = fresh([*kept, into], "__host", "__html", "__templates")
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], host_and_path(F.col(f"`{url}`"))[0].alias(host), F.col(f"`{html}`").alias(source))
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField(into, T.StringType())])
    if templates.count() <= broadcast_templates:
        held: dict[str, set[int]] = {}
        for h, digest in templates.toLocalIterator():
            held.setdefault(h, set()).add(digest)
        shared = pages.sparkSession.sparkContext.broadcast(held)
        return map_in_arrow(rows, _texts(kept, into, host, source, lambda batch, i, h: shared.value.get(h, ())), schema)
    joined = _beside_templates(rows, templates, host, source, own)
    return map_in_arrow(joined, _texts(kept, into, host, source, lambda batch, i, h: batch.column(own)[i].as_py() or ()), schema)


def _texts(kept: list[str], into: str, host: str, source: str, templates_of):
    def run(batches):
        for batch in batches:
            hosts, sources = batch.column(host), batch.column(source)
            made = [Page(sources[i].as_py() or "").main(frozenset(templates_of(batch, i, hosts[i].as_py()))) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(made, pa.string())], names=[*kept, into])

    return run


def _beside_templates(rows: DataFrame, templates: DataFrame, host: str, source: str, own: str) -> DataFrame:
    """rows with the templates of their host as an array. Hosts with many pages, of which there can be few, are divided."""
    salt, salts, of = fresh(rows.columns, "__salt", "__salts", "__of")
    counts = keep(rows.groupBy(F.col(host).alias(of)).agg(F.count("*").alias(salts)), "pages-of-hosts")
    most = max(1, int((counts.agg(F.sum(salts)).first()[0] or 0) * HOT_PART))
    hot = F.broadcast(counts.where(F.col(salts) > most).withColumn(salts, F.ceil(F.col(salts) / most)))  # 1 / HOT_PART rows at most
    n = F.coalesce(F.col(salts), F.lit(1))
    lists = templates.groupBy(F.col("host").alias(of)).agg(F.collect_list("subtree").alias(own)).join(hot, of, "left")
    lists = lists.withColumn(salt + "_", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumnRenamed(of, of + "_").drop(salts)
    dealt = rows.join(hot, F.col(host) == F.col(of), "left").withColumn(salt, F.pmod(F.xxhash64(source), n)).drop(of, salts)
    return dealt.join(lists, (F.col(host) == F.col(of + "_")) & (F.col(salt) == F.col(salt + "_")), "left").drop(of + "_", salt, salt + "_")


def extraction_report(pages: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return extract(pages.select("page_id", "url", "html"), into="text").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
