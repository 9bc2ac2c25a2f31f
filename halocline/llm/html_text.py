"""HTML extraction: the maximum-scoring contiguous region of a page.

A page is a sequence of words and tags. Words score positive and tags negative; one linear scan finds the contiguous
region of the largest sum. Weights are learned from labelled pages, those that mark their main text with exactly one
article or main element: a kind's weight is the log-ratio of how often it is seen inside and outside, held positive for
words and not for tags. The names in a tag's class, id and role are learned as tokens of their own and add to its score;
a name that is hardly ever seen inside leaves out what its element holds, as do the elements that never hold main text.
What is left out scores nothing as words and is not in the result.

Structure only completes what the scan found: a block that the region cuts is taken whole, and blocks beside it in the
same container, then in the containers around, join it from the region outwards until one scores too low (menus and
lists of links do). An article or main element bounds this.

Cases: null and empty pages, and pages without a word outside scripts and the like, give an empty text. Cut-off,
unclosed and crossing tags are repaired as they come, in time linear in the page whatever its markup. Without labelled
pages the prior weights are used. Repeated rows give equal texts. Nothing is cut from long pages. A column named text is
replaced; others, of any name, pass through.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table

#: A tag whose quoted values hold no angle brackets; tried at each "<", it reads no further than the next bracket.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
_START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_PLAIN = re.compile(r"[^>\"']*+")
_NAMES = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# fixed values: elements and naming words of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img del".split())
RAW = frozenset("script style noscript template svg textarea select iframe object".split())
LEFT_OUT = frozenset("head title nav header footer aside form button script style noscript template svg menu dialog input option select textarea iframe object".split())
NAMED_OUT = frozenset("ad ads advert adverts advertisement sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar aside comments replies respond disqus cookie cookies consent notice popup modal newsletter subscribe sharing social related recommended widget pagination pager complementary contentinfo search login signup toolbar".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES_SAME = {"li": ("li",), "option": ("option",), "tr": ("tr",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("ul ol dl table div article section".split())
CONTAINERS = frozenset("#root html body article main div section td".split())
BOUNDS = frozenset("#root html body article main".split())
TEXT_BLOCKS = frozenset("p br h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr td th hr".split())


@dataclass(frozen=True)
class HtmlParameters:
    sample_pages: int = 2048  # the bound on labelled pages that weights are learned from
    least_pages: int = 3  # of them that a kind must be in; rarer ones keep their prior weights
    least: float = 0.1  # the smallest score of a word, and of a tag below 0


# prior weights
WORD, TAG, TEXT_TAG, INLINE_TAG, NAME_OUT = 0.7, -2.0, -0.5, -0.1, -4.0
#: A name of this weight or less leaves out its element; a block of this score or less ends the widening.
OUT, SLACK = -3.0, -8.0


def weight(weights: dict[str, float], kind: str) -> float:
    """The weight of "word", a tag's name (closing ones with a slash) or, with a dot before, a name in its attributes."""
    if kind in weights:
        return weights[kind]
    if kind == "word":
        return WORD
    if kind[0] == ".":
        return NAME_OUT if kind[1:] in NAMED_OUT else 0.0
    name = kind.lstrip("/")
    return INLINE_TAG if name in INLINE and name != "a" else TEXT_TAG if name in TEXT_BLOCKS else TAG


@dataclass
class Node:
    name: str
    parent: Node | None
    depth: int = 0
    names: tuple[str, ...] = ()
    out: bool = False  # by its own or an ancestor's element name
    inside: bool = False  # an article or main
    first: int = 0  # span of tokens within
    last: int = 0
    end: int = 0  # behind its closing tag
    children: list[Node] = field(default_factory=list)


@dataclass
class Page:
    root: Node
    tokens: list[tuple[str, Node, str]] = field(default_factory=list)  # kind, where it stands, text
    opened: dict[int, Node] = field(default_factory=dict)  # place of an opening tag: its element


def _tags(text: str):
    """start, end, slash, name and attributes of each tag; comments and raw elements come without a name.

    Linear: a quote without its partner, and a bracket without one, are looked for once, as none follow later either.
    """
    at, quotes, n = 0, True, len(text)
    while True:
        start = text.find("<", at)
        if start < 0:
            return
        m = _TAG.match(text, start)
        if m:
            end, attributes = m.end(), m[3]
        elif text.startswith("<!--", start):
            end = text.find("-->", start + 4)
            at = n if end < 0 else end + 3
            yield start, at, "", "", ""
            continue
        else:
            m = _START.match(text, start)
            if not m:
                if text[start + 1 : start + 2] in ("!", "?"):
                    end = text.find(">", start)
                    if end >= 0:
                        yield start, end + 1, "", "", ""
                        at = end + 1
                        continue
                at = start + 1
                continue
            end = m.end()
            while quotes:
                end = _PLAIN.match(text, end).end()
                if end >= n or text[end] == ">":
                    break
                end = text.find(text[end], end + 1) + 1
                if not end:
                    break
            if not quotes or not end or end >= n:
                quotes = False
                end = text.find(">", m.end())
                if end < 0:
                    return  # what follows is text
            end += 1
            attributes = text[m.end() : end - 1]
        name = m[2].lower()
        if name in RAW and not m[1] and not attributes.endswith("/"):
            close = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(text, end)
            at = close.end() if close else n
            yield start, at, "", "", ""
            continue
        yield start, end, m[1], name, attributes
        at = end


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    return tuple(f".{x}" for groups in _NAMES.findall(attributes) for x in "".join(groups).lower().split())


def parsed(text: str) -> Page:
    root = node = Node("#root", None)
    page, tokens = Page(root), []
    page.tokens = tokens
    open_by_name: dict[str, list[Node]] = {}
    blocks, scopes = [root], [root]  # open elements that are not inline, and those that bound lists and cells
    at = 0

    def close(until: Node) -> None:
        nonlocal node
        while True:
            node.last = node.end = len(tokens)
            gone, node = node, node.parent
            if gone is not root:
                open_by_name[gone.name].pop()
                if blocks[-1] is gone:
                    blocks.pop()
                if scopes[-1] is gone:
                    scopes.pop()
            if gone is until:
                return

    def words(a: int, b: int) -> None:
        piece = text[a:b]
        if piece.strip():
            tokens.append(("word", node, html.unescape(piece) if "&" in piece else piece))
        elif piece and tokens:
            tokens.append(("space", node, " "))

    for start, end, slash, name, attributes in _tags(text):
        if start > at:
            words(at, start)
        at = end
        if not name:
            continue
        if slash:
            held = open_by_name.get(name)
            if held and not (name in INLINE and blocks[-1].depth > held[-1].depth):
                gone = held[-1]
                close(gone)
                tokens.append((f"/{name}", node, ""))
                gone.end = len(tokens)
            else:
                tokens.append((f"/{name}", node, ""))
            continue
        if name in CLOSES_P:
            if blocks[-1].name == "p":
                close(blocks[-1])
        elif name in CLOSES_SAME:
            same = max((open_by_name[x][-1] for x in CLOSES_SAME[name] if open_by_name.get(x)), key=lambda x: x.depth, default=None)
            if same is not None and same.depth > scopes[-1].depth:
                close(same)
        tokens.append((name, node, ""))
        names = _names(attributes)
        new = Node(name, node, node.depth + 1, names, node.out or name in LEFT_OUT, node.inside or name in ("article", "main"), len(tokens))
        page.opened[len(tokens) - 1] = new
        if name in VOID or attributes.rstrip().endswith("/"):
            new.last = new.end = len(tokens)
            continue
        node.children.append(new)
        node = new
        open_by_name.setdefault(name, []).append(new)
        if name not in INLINE:
            blocks.append(new)
        if name in SCOPES:
            scopes.append(new)
    if at < len(text):
        words(at, len(text))
    close(root)
    return page


def learn(pages: DataFrame, p: HtmlParameters, column: str = "html") -> dict[str, float]:
    """Weights from pages with exactly one article or main element, by what the scan has to tell apart: not left out."""
    marked = pages.where(F.regexp_count(F.col(column), F.lit(r"(?i)<(?:article|main)\b")) == 1).select(column)
    # any labelled pages serve equally; those of the smallest hashes make reruns agree
    n = marked.count()
    sample = marked.where(F.pmod(F.xxhash64(column), F.lit(1 << 30)) < min(1.0, p.sample_pages / max(n, 1)) * (1 << 30))

    def count(batches):
        inside, outside, seen = Counter(), Counter(), Counter()
        for _, texts in slices(batches, column):
            for text in texts:
                page, kinds = parsed(text), set()
                for at, (kind, node, words) in enumerate(page.tokens):
                    own = page.opened.get(at)
                    if kind == "space" or node.out or (own is not None and own.out):
                        continue
                    for k in (kind, *(own.names if own is not None else ())):
                        (inside if node.inside else outside)[k] += len(words.split()) if k == "word" else 1
                        kinds.add(k)
                seen.update(kinds)
        names = sorted(seen)
        yield pa.RecordBatch.from_pydict({"kind": pa.array(names, pa.string()), "i": pa.array([inside[k] for k in names], pa.int64()), "o": pa.array([outside[k] for k in names], pa.int64()), "pages": pa.array([seen[k] for k in names], pa.int64())})

    sums = sample.mapInArrow(count, "kind string, i long, o long, pages long").groupBy("kind").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.sum("pages").alias("pages"))
    rows = sums.where(F.col("pages") >= p.least_pages).collect()  # kinds that several pages of the sample share
    if not rows:
        return {}
    a, b = sum(r.i for r in rows) + len(rows), sum(r.o for r in rows) + len(rows)
    weights = {}
    for r in rows:
        w = math.log((r.i + 1) / a) - math.log((r.o + 1) / b)
        weights[r.kind] = max(w, p.least) if r.kind == "word" else min(w, 0.0 if r.kind[0] == "." else -p.least)
    return weights


def extract(text: str | None, weights: dict[str, float]) -> str:
    if not text:
        return ""
    page = parsed(text)
    tokens = page.tokens
    known: dict[str, float] = {}

    def of(kind: str) -> float:
        if kind not in known:
            known[kind] = weight(weights, kind)
        return known[kind]

    # sums[i]: score of the tokens before i. Elements come in order, so what a name leaves out reaches all below it
    sums, word = [0.0], of("word")
    best, total, start, span = 0.0, 0.0, 0, None
    for i, (kind, node, words) in enumerate(tokens):
        if kind == "word":
            value = 0.0 if node.out else word * len(words.split())
        elif kind == "space":
            value = 0.0
        else:
            value = of(kind)
            own = page.opened.get(i)
            if own is not None:
                value += sum(map(of, own.names))
                own.out = own.out or node.out or (own.name not in BOUNDS and any(of(x) <= OUT for x in own.names))
        sums.append(sums[-1] + value)
        if total <= 0:
            if kind == "space":
                continue
            total, start = 0.0, i
        total += value
        if total > best:
            best, span = total, (start, i + 1)
    if span is None:
        return ""
    first, last = _completed(page, *span, sums)
    blocks, line = [], []

    def end() -> None:
        joined = " ".join("".join(line).split())
        if joined:
            blocks.append(joined)
        line.clear()

    for kind, node, words in tokens[first:last]:
        name = kind.lstrip("/")
        if kind in ("word", "space"):
            if not node.out:
                line.append(words)
        elif name not in INLINE or name == "wbr":
            if name == "br":
                line.append(" ")
            elif name != "wbr":
                end()
    end()
    return "\n".join(blocks)


def _completed(page: Page, first: int, last: int, sums: list[float]) -> tuple[int, int]:
    """The region with the blocks that it cuts and those beside it that score enough."""
    holder = page.tokens[first][1]
    while holder.parent is not None and not (holder.first <= first and last <= holder.last):
        holder = holder.parent
    left = right = True
    while True:
        if holder.name not in CONTAINERS:
            first, last = min(first, holder.first), max(last, holder.last)
        else:
            spans = [(c.first - 1, c.end, c.out) for c in holder.children]
            before = [s for s in spans if s[0] < first]
            for a, b, out in reversed(before):
                if b > first:
                    first = a  # cut by the region
                elif left:
                    if out or sums[first] - sums[a] > SLACK:
                        first = a
                    else:
                        left = False
            after = [s for s in spans if s[1] > last]
            for a, b, out in after:
                if a < last:
                    last = b
                elif right:
                    if out or sums[b] - sums[last] > SLACK:
                        last = b
                    else:
                        right = False
            # loose words at the ends of the container
            if left:
                first = min(first, holder.first)
            if right:
                last = max(last, holder.last)
        if holder.name in BOUNDS or holder.parent is None or not (left or right):
            return first, last
        holder = holder.parent


def main_texts(pages: DataFrame, weights: dict[str, float], column: str = "html") -> DataFrame:
    """pages with text, in place of any column of that name; every other column passes through."""
    pages = pages.drop("text")
    shared = pages.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType())])

    def run(batches):
        for part, texts in slices(batches, column):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([extract(t, shared.value) for t in texts], pa.string())], names=[f.name for f in schema])

    return pages.mapInArrow(run, schema)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = main_texts(pages, learn(pages, HtmlParameters()))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
