"""Main text of web pages by template deduction over pages of one host.

Tokens are tags with their path from the root and text runs with their path. A token's occurrence vector
is how often each page of the host holds it; tokens with one vector form an equivalence class. Vectors
are never built: two sums of content hashes, weighted by the counts, stand for one, so classes are
found by partial aggregation however many pages a host has; pages of one content count once. A class is
valid if it has enough tokens and pages and its tokens come in the same order on every page. The valid
classes make the host's template: their tags nest by their paths and leave slots, of which the innermost
one that is on each page once and holds most of the free text is the main slot; their text runs are
boilerplate. A page then gives the text of the main slot, of which <article> elements are a hint, without
the template's text runs in blocks that name themselves there, and without the blocks whose elements name
themselves menus, notices, adverts, forms or comments. Pages of hosts without a template give their
articles, else their main element, else everything, without such blocks.

Pages are read in one pass, of whatever length and depth they are.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, durable, durable_at
from .words import pieces

MIN_CLASS = 3  # tokens of a class
MIN_PAGES = 3  # pages of a host, else it has no template
MAIN_SHARE = 0.7  # of a host's free text, held by its main slot
BROADCAST_BYTES = 64 << 20
HOSTS_READY = 256  # hosts whose template a worker keeps unpacked

# A tag whose quoted values end; what stands in quotes only counts after an equals sign.
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=[>=])))*+)>")
BROKEN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")  # any other ends at the next mark
NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|$)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?", re.I)
# HTML's element kinds and words by which elements name themselves.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg canvas textarea object math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var".split())
SKIPPED = frozenset("head title nav aside footer form button select option dialog menu input datalist".split())
SKIP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar widget widgets related recommended share sharing social comment comments reply replies respond "
    "disqus discussion newsletter subscribe subscription login signup signin search footer masthead skip toolbar pagination pager".split()
)
CLOSES_P = BLOCK - {"body", "html"}


def _hash(s: str) -> int:
    return int.from_bytes(blake2b(s.encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Node:
    """An element: ``path`` is a number of the names from the root, ``free`` the text below that is neither skipped nor a link."""

    __slots__ = ("tag", "parent", "path", "skip", "link", "free", "depth", "words")

    def __init__(self, tag: str, parent: Node | None, words: str, skip: bool):
        self.tag, self.parent, self.words = tag, parent, words
        self.path = _hash(f"{parent.path}/{tag}.{words}" if parent else "/")
        self.depth = parent.depth + 1 if parent else 0
        self.skip = skip
        self.link = tag == "a" or bool(parent and parent.link)
        self.free = 0

    def run(self, words: str) -> int:
        """The token of a text run here."""
        return _hash(f"{self.path} {words}")


def _named(attributes: str, chapter: bool = False) -> tuple[str, bool]:
    """Words of class, id and role, and whether the element hides or names itself as no content; an article's chapter may be a discussion."""
    words, hidden = [], False
    for m in NAMED.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            hidden = True
        elif name in ("class", "id", "role"):
            words += re.split(r"[^a-z0-9]+", value)
    words = [w for w in words if w and not w.isdigit()]
    return " ".join(words), hidden or any(w in SKIP_WORDS and not (chapter and w == "discussion") for w in words)


# Which open elements a tag ends, and which ones keep it from doing so.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
_STOPS = {"li": ("ul", "ol", "menu"), "tr": ("table", "tbody", "thead", "tfoot")}


class Stack:
    """Open elements, with the places of each kind and of blocks, so that no step looks through all of them."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks = [root], {}, []

    def top(self) -> Node:
        return self.nodes[-1]

    def last(self, tag: str) -> int:
        """The place of the innermost open element of a kind; 0 if there is none, as the root has no kind."""
        own = self.places.get(tag)
        return own[-1] if own else 0

    def push(self, node: Node) -> None:
        place = len(self.nodes)
        self.nodes.append(node)
        self.places.setdefault(node.tag, []).append(place)
        if node.tag in BLOCK:
            self.blocks.append(place)

    def close(self, place: int) -> None:
        """Ends the element at a place and all inside it."""
        while len(self.nodes) > place:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def end(self, tag: str) -> None:
        """An end tag; an inline one closes no block."""
        place = self.last(tag)
        if place and (tag in BLOCK or not self.blocks or self.blocks[-1] < place):
            self.close(place)

    def before(self, tag: str) -> None:
        """A paragraph ends where a block begins, a list item or cell where its next one does."""
        if tag in CLOSES_P and self.blocks and self.top_block() == "p":
            self.close(self.blocks[-1])
        ends = max((self.last(t) for t in _ENDS.get(tag, ())), default=0)
        if ends > max(self.last(t) for t in _STOPS.get(tag, ("table", "dl"))):
            self.close(ends)

    def top_block(self) -> str:
        return self.nodes[self.blocks[-1]].tag


class Page:
    """Elements and text runs of a page: nodes, and runs of (node, block number, text)."""

    def __init__(self, source: str):
        root = Node("", None, "", False)
        self.nodes, self.runs = [root], []
        stack, block, at, n = Stack(root), 0, 0, len(source)
        last_mark, tag_form = source.rfind(">"), TAG
        raw_ends: dict[str, bool] = {}
        while at < n:
            start, begin = at, source.find("<", at)
            # A mark that opens nothing is text.
            while 0 <= begin < last_mark and not (source[begin + 1].isascii() and (source[begin + 1].isalpha() or source[begin + 1] in "/!?")):
                begin = source.find("<", begin + 1)
            if begin < 0 or (begin > last_mark and not source.startswith("<!--", begin)):
                self._text(stack.top(), block, source[start:])
                break
            if source.startswith("<!--", begin):
                self._text(stack.top(), block, source[start:begin])
                end = source.find("-->", begin + 4)
                at = end + 3 if end >= 0 else n
                continue
            if source[begin + 1] in "!?":
                self._text(stack.top(), block, source[start:begin])
                at = source.find(">", begin) + 1
                continue
            m = tag_form.match(source, begin)
            if m is None and tag_form is TAG and (m := BROKEN_TAG.match(source, begin)) is not None:
                tag_form = BROKEN_TAG  # quotes say nothing from here on
            if m is None:  # an end mark without a name
                self._text(stack.top(), block, source[start : begin + 1])
                at = begin + 1
                continue
            if begin > start:
                self._text(stack.top(), block, source[start:begin])
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                if tag in BLOCK:
                    block += 1
                stack.end(tag)
                continue
            if tag in RAW:
                if not m[3].rstrip().endswith("/"):
                    close = None if raw_ends.get(tag) else re.compile("</" + re.escape(tag) + r"\b[^>]*>", re.I).search(source, at)
                    raw_ends[tag] = close is None  # then there is none later either
                    at = close.end() if close else n
                continue
            if tag in VOID:
                if tag == "hr":
                    block += 1
                elif tag in ("br", "img", "input"):
                    self._text(stack.top(), block, " ")
                continue
            if tag in BLOCK:
                block += 1
                stack.before(tag)
            in_article = bool(stack.last("article"))
            words, named = _named(m[3], tag == "section" and in_article) if m[3] else ("", False)
            parent = stack.top()
            skip = parent.skip or tag in SKIPPED or named or ((tag == "header" or "header" in words.split()) and not in_article)
            if tag in ("article", "main") and not named and not any(stack.last(t) for t in SKIPPED):
                skip = False  # a container that is named after its sidebar, say, still holds the article
            node = Node(tag, parent, words, skip)
            self.nodes.append(node)
            if not (m[3] and m[3].rstrip().endswith("/") and tag not in BLOCK | INLINE):
                stack.push(node)
        for node in reversed(self.nodes):  # an element comes after the one it is in
            if node.parent is not None:
                node.parent.free += node.free

    def _text(self, node: Node, block: int, raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        if text:
            self.runs.append((node, block, text))
            if not node.skip and not node.link:
                node.free += len(text.strip())

    def _outermost(self, tag: str, top: Node) -> list[Node]:
        """Unskipped elements of a kind below ``top``, without those inside another of them."""
        found, state = [], {top: True}  # whether an element is below the top and in none of those found
        for node in self.nodes:
            if node is not top and state.get(node.parent):
                if node.tag == tag and not node.skip:
                    found.append(node)
                else:
                    state[node] = True
        return found

    def containers(self, main: int | None) -> list[Node]:
        """The template's main slot, else all articles, else the largest main element, else all.

        Articles are a hint: one around the slot widens it to the page's articles, and ones that hold most of
        a slot stand for it.
        """
        root = self.nodes[0]
        articles = self._outermost("article", root)
        own = [x for x in self.nodes if x.path == main] if main is not None else []
        if own:
            slot, around = max(own, key=lambda x: x.free), set(articles)
            up: Node | None = slot
            while up is not None:
                if up in around:
                    return articles
                up = up.parent
            inner = self._outermost("article", slot)
            return inner if inner and sum(x.free for x in inner) >= MAIN_SHARE * slot.free else [slot]
        mains = [] if articles else [x for x in self.nodes if x.tag == "main" and not x.skip]
        return articles or ([max(mains, key=lambda x: x.free)] if mains else [root])

    def text(self, main: int | None = None, boilerplate: frozenset[int] = frozenset()) -> str:
        # Elements in the containers, and whether a block there that names itself is around: the paragraphs of
        # a main slot itself are never the template's. Without a slot all text may be.
        inside = {x: x.parent is None for x in self.containers(main)}
        for node in self.nodes:
            if node not in inside and node.parent in inside:
                inside[node] = inside[node.parent] or bool(node.words and node.tag in BLOCK)
        own = [x for x in self.runs if not x[0].skip and x[0] in inside]
        free = [x for x in own if not (boilerplate and inside[x[0]] and x[2].strip() and x[0].run(" ".join(x[2].split())) in boilerplate)]
        blocks: dict[int, list[str]] = {}
        # A page of nothing but its template's text keeps that.
        for _, block, text in free if any(x[2].strip() for x in free) else own:
            blocks.setdefault(block, []).append(text)
        joined = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
        return "\n\n".join(x for x in joined if x)


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", url or "")
    return m[1].lower() if m else ""


TOKENS = "host string, token long, is_text boolean, depth int, first int, n long, free long, a long, b long"


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, token, is_text, depth, first, n, free, a, b) for each page and token.

    n is its count there, first its first place, a and b are hashes of the page's content. The root is a token
    too, so that its vector counts a host's different contents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows: list[tuple] = []
            for url, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page, host = Page(source or ""), host_of(url)
                key = _hash(page.text())
                a, b = key & 0x7FFFFFFF, key >> 32 & 0x7FFFFFFF
                seen: dict[int, list] = {}
                for place, node in enumerate(page.nodes):
                    own = seen.setdefault(node.path, [False, node.depth, place, 0, 0])
                    own[3] += 1
                    own[4] += node.free
                for place, (node, _, text) in enumerate(page.runs):
                    words = " ".join(text.split())
                    if words:
                        seen.setdefault(node.run(words), [True, node.depth, place, 0, 0])[3] += 1
                rows += [(host, t, *own, a, b) for t, own in seen.items()]
                if len(rows) > 50_000:
                    yield _token_batch(rows)
                    rows = []
            if rows:
                yield _token_batch(rows)

    return pages.select("url", "html").mapInArrow(run, TOKENS)


def _token_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in TOKENS.split(", ")])


def valid_classes(pages: DataFrame, written: list[str] | None = None) -> DataFrame:
    """(host, va, vb, token, is_text, depth, support, n, free, pages, total) of the tokens of each host's valid classes.

    ``written`` gets the tables that the result is read from, for who wants to remove them.
    """
    written = [] if written is None else written
    # Copies of a content are one page, or their paragraphs would pass for the template's.
    once = page_tokens(pages).groupBy("host", "token", "a", "b").agg(
        F.first("is_text").alias("is_text"), F.max("depth").alias("depth"), F.min("first").alias("first"), F.max("n").alias("n"), F.max("free").alias("free")
    )
    once, path = durable_at(once, "tokens")
    written.append(path)
    vectors = once.groupBy("host", "token").agg(
        F.first("is_text").alias("is_text"), F.max("depth").alias("depth"), F.count("*").alias("support"), F.sum("n").alias("n"), F.sum("free").alias("free"),
        F.sum(F.col("a") * F.col("n")).alias("va"), F.sum(F.col("b") * F.col("n")).alias("vb"),
    )
    # Most text runs are on one page only; they go before rows meet by host.
    vectors = vectors.where(F.col("support") >= MIN_PAGES)
    sizes = vectors.where(F.col("token") == F.lit(_hash("/"))).select("host", F.col("support").alias("pages"), F.col("free").alias("total"))
    frequent, path = durable_at(vectors.join(sizes, "host").where(2 * F.col("support") >= F.col("pages")), "frequent")
    written.append(path)
    large = frequent.groupBy("host", "va", "vb").agg(F.count("*").alias("size")).where(F.col("size") >= MIN_CLASS)
    # The order of a class's tags, and that of its text runs, on each page that has them.
    members = frequent.join(large.select("host", "va", "vb"), ["host", "va", "vb"], "left_semi").select("host", "token", "va", "vb")
    orders = once.join(members, ["host", "token"]).groupBy("host", "va", "vb", "is_text", "a", "b").agg(F.sort_array(F.collect_list(F.struct("first", "token"))).alias("x"))
    seen = orders.select("host", "va", "vb", "is_text", F.xxhash64(F.transform("x", lambda t: t.token)).alias("order"))
    mixed = seen.groupBy("host", "va", "vb", "is_text").agg(F.min("order").alias("least"), F.max("order").alias("most")).where("least != most").select("host", "va", "vb").distinct()
    return frequent.join(large, ["host", "va", "vb"]).drop("size").join(mixed, ["host", "va", "vb"], "left_anti")


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, boilerplate) of each host with enough pages of different content.

    A host's template tokens are on half of its pages at least, so there are at most twice as many as
    tokens on its mean page, and the array is bounded by a page's size.
    """
    written: list[str] = []
    slot = ~F.col("is_text") & (F.col("support") == F.col("pages")) & (F.col("n") == F.col("pages")) & (F.col("free") >= MAIN_SHARE * F.col("total"))
    found = valid_classes(pages, written).groupBy("host").agg(
        F.max_by("token", F.when(slot, F.struct(F.col("depth"), F.col("free"), F.col("token")))).alias("main"),
        F.sort_array(F.collect_list(F.when(F.col("is_text"), F.col("token")))).alias("boilerplate"),
    )
    found = durable(found, "templates")
    for path in written:
        discard(pages.sparkSession, path)
    return found


class Templates:
    """Templates of all hosts, as they are broadcast: eight bytes a token; those of some hosts are unpacked at a time."""

    def __init__(self, rows: list):
        self.own = {r.host: (r.main, np.array(r.boilerplate, np.int64).tobytes()) for r in rows}
        self.ready: dict[str, tuple] = {}

    def of(self, host: str) -> tuple[int | None, frozenset[int]]:
        if host not in self.ready:
            if len(self.ready) >= HOSTS_READY:
                self.ready.clear()
            main, tokens = self.own.get(host, (None, b""))
            self.ready[host] = main, frozenset(np.frombuffer(tokens, np.int64).tolist())
        return self.ready[host]


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of each row.

    Null html counts as empty and gives the empty text; a null url belongs to the host "". Each row is
    a page of its own, repeated ids too; empty tables give no rows, and other columns are ignored. Pages may
    be of any length. The templates are broadcast if their counted size allows it, else pages are joined with
    them on the host, where the skew join splits large hosts; both give the same rows.
    """
    found = templates(pages)
    # A row takes its tokens' bytes, and less than 400 more for its objects and its host's name.
    size = found.agg(F.coalesce(F.sum(F.lit(400) + 4 * F.length("host") + 8 * F.size("boilerplate")), F.lit(0))).first()[0]
    slim = pages.select("page_id", "url", "html")
    schema = "page_id long, url string, text string, n_chars long"
    if size <= broadcast_bytes:
        shared = pages.sparkSession.sparkContext.broadcast(Templates(found.collect()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                urls, sources = (batch.column(k).to_pylist() for k in (1, 2))
                yield _extracted(batch, [Page(s or "").text(*shared.value.of(host_of(u))) for u, s in zip(urls, sources, strict=True)])

        return slim.mapInArrow(run, schema)

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sources, mains, lists = (batch.column(k).to_pylist() for k in (2, 3, 4))
            yield _extracted(batch, [Page(s or "").text(m, frozenset(b or ())) for s, m, b in zip(sources, mains, lists, strict=True)])

    url = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))
    joined = slim.withColumn("host", url).join(found, "host", "left").select("page_id", "url", "html", "main", "boilerplate")
    return joined.mapInArrow(run_joined, schema)


def _extracted(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    texts = [t.encode("utf-8", "replace").decode() for t in texts]  # a reference to a lone surrogate
    return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
