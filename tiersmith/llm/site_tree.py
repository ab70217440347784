"""Main text of web pages by site style trees.

The block elements of all pages of a host are merged into one tree: a node is
a path of element names with their classes. For every node two entropies are
taken over the distinct pages that have it. *Presentation*: how much the
sequence of its child elements varies, -sum p log_m p. *Content*: one minus the
entropy of the pages over which each of its texts is spread, 1 - sum k/m log_m k.
An inner node with l children has importance (1-g^l) presentation + g^l content,
a leaf its content alone. A branch is noise if its importance and that of all
below it is low, which holds when its whole text comes back on page after page;
such branches are removed from each page.

Inside ``article`` and ``main`` a branch is noise only if its content is of much
lower importance, as pages of a host in few near copies repeat their paragraphs
too. An element whose own text stands on more than half of a host's pages goes
wherever it is, also where it shares its node with elements of other texts.
``article`` and ``main`` themselves stay.

Branches whose element or class says what they are (navigation, adverts,
comments and so on, by a fixed list) are removed as well, so that hosts with few
pages come out right and menus and adverts that differ on every page go. If the style tree would leave nothing of a page, it is not applied to it.

Exact copies of a page count once in a host's tree. Counts are pre-aggregated;
a host with a third of all pages is never gathered. Null and empty pages have
an empty text, pages without a host have no tree. Unclosed, misnested and very
long pages are read in one pass over the whole text; repeated rows come out
alike. Columns to carry may have any name.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.frames import written

#: Element names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
SILENT = "script|style|noscript|template|iframe|textarea|select|svg|math|object|audio|video|canvas|title|button"
#: A start tag of the key ends an open element of the value.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
NOISE_TAGS = frozenset("nav footer aside form menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion popup modal overlay "
    "cookie cookies consent gdpr notice notices alert warning newsletter subscribe subscription signup login sidebar widget "
    "related recommended recommendations share sharing social comment comments commentlist reply replies respond disqus "
    "breadcrumb breadcrumbs pagination pager nav navbar navigation menu toolbar footer masthead copyright search".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<silent>{SILENT})(?=[\s/>])[^>]*+>.*?(?:</(?P=silent)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>(?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-z/!?][^>]*+>", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
DIGITS = re.compile(r"\d{2,}")  # numbers of posts and the like
WORD = re.compile(r"[a-z]+")

DAMPING = 0.9
LEAST_PAGES = 3
#: A text that stands on m**0.2 of m pages is at this importance.
LEAST_IMPORTANCE = 0.8
#: The same inside article and main: a text that stands on m**0.5 of m pages.
LEAST_INSIDE = 0.5
#: Mark the noisy nodes of inside, and the pairs of a node and a text, in one table with the other noisy nodes.
INSIDE, REPEATED = 0x3C6EF372FE94F82B, 0x1F83D9ABFB41BD6B
#: Noisy nodes are broadcast up to this number (some 100 MB); beyond, they are joined by host.
BROADCAST_NODES = 1_000_000

_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Element:
    """An open block element: its node in the tree and what has been seen below it."""

    __slots__ = ("name", "node", "named", "inside", "low", "first", "content", "style", "children")

    def __init__(self, name: str, node: int, named: bool, inside: bool, low: bool, first: int):
        self.name, self.node, self.named, self.inside, self.low, self.first = name, node, named, inside, low, first
        self.content = self.style = self.children = 0


def _names_noise(name: str, attrs: dict[str, str], inside: bool) -> bool:
    if name in NOISE_TAGS or (name == "header" and not inside):
        return True
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attrs.get("style", "")):
        return True
    if name in MAIN_TAGS or name in ("body", "html"):
        return False
    if attrs.get("role", "").lower() in NOISE_ROLES:
        return True
    words = WORD.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())
    return not NOISE_WORDS.isdisjoint(words)


def parse(page: str, noisy: frozenset[int] = frozenset()) -> tuple[list[tuple[str, bool]], list[tuple[int, int, int, int]]]:
    """Blocks of text outside named noise, each with whether it lies in a noisy node; nodes (path, content, style, children)."""
    blocks: list[tuple[str, bool]] = []
    nodes: list[tuple[int, int, int, int]] = []
    root = Element("", 1, False, False, False, 0)
    stack, text = [root], []

    def flush() -> None:
        if text:
            line = " ".join("".join(text).split())
            text.clear()
            if line:
                top = stack[-1]
                top.content = (top.content * _STEP + _hash(line)) & _MASK
                if not top.named:
                    blocks.append((line, top.low))

    def close(depth: int) -> None:
        flush()
        while len(stack) > depth:
            done = stack.pop()
            nodes.append((done.node, done.content, done.style, done.children))
            if noisy and done.name not in MAIN_TAGS and _signed(done.node ^ done.content ^ REPEATED) in noisy:
                blocks[done.first:] = [(line, True) for line, _ in blocks[done.first:]]
            if done.content:
                stack[-1].content = (stack[-1].content * _STEP + done.content) & _MASK

    def ends(names: tuple[str, ...], within: frozenset[str]) -> None:
        """Close the innermost open element of these names, unless it is outside of one of ``within``."""
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name in names:
                return close(depth)
            if stack[depth].name in within:
                return None

    at, scope = 0, frozenset("table ul ol dl article section main body div".split())
    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at:m.start()]
            text.append(html.unescape(piece) if "&" in piece else piece)
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name not in BLOCKS:
            if name == "br" or name == "img" or name == "input":
                text.append(" ")
            continue
        if m["end"]:
            flush()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    close(depth)
                    break
            continue
        flush()
        if name == "hr":
            continue
        ends(("p",), scope)  # a block ends a paragraph
        if name in CLOSES:
            ends(CLOSES[name], scope - {"div"})
        attrs = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(m["attrs"])} if m["attrs"] else {}
        top = stack[-1]
        inside = top.inside or name in MAIN_TAGS
        label = f"{name}.{DIGITS.sub('', attrs.get('class', ''))}#{DIGITS.sub('', attrs.get('id', ''))}".lower()
        sign = _hash(label)
        top.style, top.children = (top.style * _STEP + sign) & _MASK, top.children + 1
        node = ((top.node ^ sign) * _STEP + 1) & _MASK
        named = top.named or _names_noise(name, attrs, top.inside)
        low = top.low or (name not in MAIN_TAGS and _signed(node ^ INSIDE if inside else node) in noisy)
        stack.append(Element(name, node, named, inside, low, len(blocks)))
    if at < len(page):
        text.append(html.unescape(page[at:]))
    close(1)
    return blocks, nodes


def main_text(page: str, noisy: frozenset[int] = frozenset()) -> str:
    blocks, _ = parse(page, noisy)
    kept = [line for line, low in blocks if not low] or [line for line, _ in blocks]
    return "\n".join(kept)


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def noisy_nodes(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, node): nodes of the site style trees whose importance is low, those that are noise inside too, and repeated texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                cols: list[list] = [[] for _ in range(6)]
                part = batch.slice(lo, 500)
                for host, text in zip(part.column("host").to_pylist(), part.column("page").to_pylist()):
                    _, nodes = parse(text)
                    whole = _signed(nodes[-1][1] if nodes else 0)
                    for node, content, style, children in set(nodes):
                        if content:
                            for col, v in zip(cols, (host, whole, _signed(node), _signed(content), _signed(style), children)):
                                col.append(v)
                yield pa.record_batch([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                                      names=["host", "whole", "node", "content", "style", "children"])

    taken = pages.select(host_of(F.col(url)).alias("host"), F.col(page).alias("page")).where("host is not null and page is not null")
    seen = taken.mapInArrow(run, "host string, whole long, node long, content long, style long, children long").distinct()
    pairs = seen.groupBy("host", "node", "content", "style").agg(F.count("*").alias("k"), F.sum("children").alias("children"))
    # contents and styles of a node, counted in one pass each over the pre-aggregated rows
    by_text = pairs.groupBy("host", "node", "content").agg(F.sum("k").alias("k"), F.sum("children").alias("children"))
    texts = by_text.groupBy("host", "node").agg(
        F.sum("k").alias("m"), F.sum(F.col("k") * F.ln("k")).alias("text_sum"), F.sum("children").alias("children"))
    styles = pairs.groupBy("host", "node", "style").agg(F.sum("k").alias("k")).groupBy("host", "node").agg(
        F.sum(F.col("k") * F.ln("k")).alias("style_sum"))
    both = texts.where(F.col("m") >= LEAST_PAGES).join(styles, ["host", "node"])
    content = 1 - F.col("text_sum") / (F.col("m") * F.ln("m"))
    presentation = 1 - F.col("style_sum") / (F.col("m") * F.ln("m"))
    damped = F.pow(F.lit(DAMPING), F.col("children") / F.col("m"))
    low = (content < LEAST_IMPORTANCE) & ((1 - damped) * presentation + damped * content < LEAST_IMPORTANCE)
    inside = both.where(low & (content < LEAST_INSIDE)).select("host", F.col("node").bitwiseXOR(F.lit(INSIDE)).alias("node"))
    sizes = seen.select("host", "whole").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    repeated = by_text.where(F.col("k") >= LEAST_PAGES).join(sizes, "host").where(2 * F.col("k") > F.col("pages")).select(
        "host", F.col("node").bitwiseXOR(F.col("content")).bitwiseXOR(F.lit(REPEATED)).alias("node"))
    return both.where(low).select("host", "node").unionByName(inside).unionByName(repeated)


def extract(pages: DataFrame, url: str = "url", page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` and text, the main text of every page, blocks joined by line ends."""
    noisy = written(noisy_nodes(pages, url, page), "noisy")
    by_host = noisy.groupBy("host").agg(F.collect_set("node").alias("noisy"))
    if noisy.count() <= BROADCAST_NODES:
        by_host = F.broadcast(by_host)
    taken = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(page).alias("page"), host_of(F.col(url)).alias("host"))
    carried = "".join(f"`k{i}` {f.dataType.simpleString()}, " for i, f in enumerate(taken.schema.fields[:-2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple, frozenset[int]] = {}
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part, out = batch.slice(lo, 500), []
                for text, nodes in zip(part.column("page").to_pylist(), part.column("noisy").to_pylist()):
                    key = tuple(nodes or ())
                    if key not in sets:
                        if len(sets) > 1000:
                            sets.clear()
                        sets[key] = frozenset(key)
                    out.append(main_text(text or "", sets[key]))
                yield pa.record_batch([*[part.column(c) for c in part.schema.names if c[0] == "k"], pa.array(out, pa.string())],
                                      names=[*[c for c in part.schema.names if c[0] == "k"], "text"])

    done = taken.join(by_host, "host", "left").select(*[f"k{i}" for i in range(len(keep))], "page", "noisy").mapInArrow(
        run, carried + "text string")
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text")
