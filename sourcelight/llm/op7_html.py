"""Main text of web pages: the maximum-scoring subsequence of a page's tokens.

A page is a sequence of words and tags. Words score positive and tags negative; words inside furniture score nothing.
What is furniture, what a tag costs and what a word of a link is worth is learned from a bounded sample of pages that
label themselves (exactly one ``article`` element): log-ratios of words and tags inside and outside that element, by
element and by class, id and role. One linear scan finds the best contiguous region. Blocks inside it that are known
as furniture are taken out and the rest is joined. At prediction an ``article`` element is a tag like any other.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelight.llm import common

SAMPLE_PAGES = 2000
LEAST_PAGES = 2  # a name or tag of fewer sampled pages is not learned
FURNITURE_RATIO = -2.0
SMOOTHING = 10.0
PRIOR_WORDS = 500.0

# Element names of the HTML standard by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
UNSEEN = frozenset("script style head title noscript template iframe object canvas audio video svg math textarea select option datalist".split())
ROLES = frozenset("nav header footer aside form menu dialog button fieldset label".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
ITEMS = frozenset("li ul ol dl dt dd tr td th table tbody thead br img hr input".split())
# Names that start as furniture, with the weight of PRIOR_WORDS words, until labelled pages say otherwise.
PRIOR_NAMES = frozenset("ad ads advert advertisement sidebar breadcrumbs comment comments cookies notice newsletter".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def names_of(name: str, attrs: str) -> list[str]:
    """The class, id and role values of a block element, as keys. Paragraphs, headings and inline elements have none."""
    if not attrs or name in INLINE or name in ("html", "body", "p", "h1", "h2", "h3", "h4", "h5", "h6"):
        return []
    return ["." + w for found in _ATTR.finditer(attrs) for w in (found[1] or found[2] or found[3] or "").lower().split()]


def suspect(key: str) -> bool:
    """Whether a role, or a name by its last part (``cookie-notice``: notice), starts as furniture."""
    return key in ROLES or key == "header@top" or key[0] == "." and re.split(r"[-_]+", key[1:])[-1] in PRIOR_NAMES | ROLES


@dataclass
class Piece:
    """A run of text or a tag. ``out``: inside furniture; ``link``: inside a link; ``chain``: keys of the elements
    around a text and ``article``: inside an article, both for learning only."""

    text: str | None
    name: str = ""
    close: bool = False
    out: bool = False
    link: bool = False
    named: bool = False
    article: bool = False
    chain: tuple[str, ...] = ()


@dataclass
class Weights:
    """Worth of a word and of a word in a link, cost of each tag (``other``: not seen), further cost of a block with a
    class, id or role (``named``), and log-ratios of words by element role and name."""

    word: float = 1.0
    link: float = 0.5
    tags: dict[str, float] = field(default_factory=dict)
    other: float = -0.2
    named: float = -0.5
    ratios: dict[str, float] = field(default_factory=dict)

    def of(self, piece: Piece) -> float:
        if piece.text is not None:
            return 0.0 if piece.out else len(piece.text.split()) * (self.link if piece.link else self.word)
        if piece.out:
            return -0.02
        return self.tags.get(piece.name, self.other) + (self.named if piece.named else 0.0)

    def furniture(self, name: str, names: list[str], attrs: str) -> bool:
        if name in UNSEEN or attrs and _HIDDEN.search(attrs):
            return True
        keys = names + [name] if name.split("@")[0] in ROLES else names
        if name == "header@in":
            keys = [k for k in keys if k != ".header"]
        # Names and roles of labelled pages decide; those never seen there count as what they start as.
        return any((self.ratios[k] if k in self.ratios else -3.0 if suspect(k) else 0.0) <= FURNITURE_RATIO for k in keys)


def pieces(page: str, weights: Weights | None, learn: bool = False) -> list[Piece]:
    """A page as text runs and tags, each marked with whether it lies inside furniture."""
    result: list[Piece] = []
    stack: list[tuple[str, bool, list[str], str]] = []
    out = link = article = 0
    chain: Counter = Counter()

    def pop(i: int) -> None:
        nonlocal out, link, article
        while len(stack) > i:
            name, was, keys, _ = stack.pop()
            out, link, article = out - was, link - (name == "a"), article - (name == "article")
            chain.subtract(keys)

    position, length = 0, len(page)
    while position < length:
        found = _TOKEN.search(page, position)
        end = found.start() if found else length
        if end > position:
            text = page[position:end]
            if found is None:  # a tag that the end of the page cuts off is markup
                tail = re.search(r"<[a-zA-Z/!?]", text)
                text = text[:tail.start()] if tail else text
            if text:
                result.append(Piece(text, out=out > 0, link=link > 0, article=article > 0, chain=tuple(k for k, n in chain.items() if n > 0) if learn else ()))
        if found is None:
            break
        position = found.end()
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        if found["close"]:
            named, was_out = False, out > 0
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    named = bool(stack[i][3])
                    pop(i)
                    break
            result.append(Piece(None, name, True, was_out, link > 0, named, article > 0))
            continue
        attrs = found["attrs"]
        names = names_of(name, attrs)
        # A header that opens the page is the site's, one further inside may be the article's own.
        role = ("header@in" if any(n not in ("html", "body") for n, *_ in stack) else "header@top") if name == "header" else name
        is_out = name in UNSEEN or role in ROLES or role == "header@top" if weights is None else weights.furniture(role, names, attrs)
        result.append(Piece(None, name, False, out > 0 or is_out, link > 0, bool(names), article > 0))
        if name in RAW:  # no markup inside
            stop = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(page, position)
            position = stop.end() if stop else length
        elif name not in VOID and not attrs.endswith("/"):
            if name in ("p", "li", "tr", "td", "th", "option", "dt", "dd") and stack and stack[-1][0] == name:
                pop(len(stack) - 1)
            keys = (names + [role] if role.split("@")[0] in ROLES else names) if learn else []
            stack.append((name, is_out, keys, "named" if names else ""))
            out, link, article = out + is_out, link + (name == "a"), article + (name == "article")
            chain.update(keys)
    return result


def region(run: list[Piece], weights: Weights) -> tuple[int, int]:
    """First and one-past-last piece of the contiguous region with the greatest score (the first one of equals)."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, piece in enumerate(run):
        if total <= 0:
            total, start = 0.0, i
        total += weights.of(piece)
        if total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def joined(run: list[Piece]) -> str:
    """The text of a region without its furniture; blocks and furniture part words, inline elements do not."""
    parts: list[str] = []
    for piece in run:
        if piece.text is None:
            parts.append("" if piece.name in INLINE else " ")
        else:
            parts.append(" " if piece.out else html.unescape(piece.text))
    return " ".join("".join(parts).split())


def main_text(page: str, weights: Weights) -> str:
    run = pieces(page, weights)
    first, last = region(run, weights)
    return joined(run[first:last])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside, outside, pages = Counter(), Counter(), Counter()
    for batch in common.chunks(batches, "html"):
        for page in common.texts(batch, "html"):
            run = pieces(page, None, learn=True)
            if sum(p.name == "article" and not p.close for p in run) != 1:
                continue
            seen = set()
            for p in run:
                target = inside if p.article and not p.out else outside
                if p.text is None:
                    keys, n = ["<" + p.name] + ["<named"] * p.named, 1
                else:
                    keys, n = ["#word", *p.chain] + ["#link"] * p.link, len(p.text.split())
                for k in keys:
                    target[k] += n
                seen.update(keys)
            pages.update(seen)
    names = sorted(pages)
    counts = [pa.array([c[n] for n in names], pa.int64()) for c in (inside, outside, pages)]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *counts], ["name", "inside", "outside", "pages"])


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> Weights:
    """Weights from at most ``sample`` pages with exactly one ``article`` element (smallest hash of the key first).

    A word is worth 1. A tag costs its log-ratio (inside to outside articles) less 0.2, at least 0.05 and at most 0.5
    for inline elements, 1 for parts of lists and tables, 4 for others. A word of a link is worth less the more rarely
    links stand inside articles. Names and tags of fewer than ``LEAST_PAGES`` sampled pages are not learned, so what comes
    to the driver is bounded by the sample. Without labelled pages plain defaults hold.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).filter("id is not null and html is not null")
    chosen = rows.select("id").orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample).distinct()
    counted = rows.join(F.broadcast(chosen), "id", "left_semi").select("html").mapInArrow(_count, "name string, inside long, outside long, pages long")
    found = {r.name: (r.i, r.o) for r in counted.groupBy("name").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"), F.sum("pages").alias("n"))
             .filter((F.col("n") >= LEAST_PAGES) | F.col("name").startswith("#")).collect()}
    if not found:
        return Weights()
    weights = Weights()
    words_in, words_out = (n + 1.0 for n in found.get("#word", (0, 0)))
    share = words_in / (words_in + words_out)

    def ratio(i: float, o: float) -> float:
        return math.log((i + SMOOTHING * share) / (o + SMOOTHING * (1 - share))) - math.log(words_in / words_out)

    tags = {n[1:]: c for n, c in found.items() if n.startswith("<")}
    tags_in, tags_out = (1.0 + sum(c[k] for n, c in tags.items() if n != "named") for k in (0, 1))
    for name, (i, o) in tags.items():
        part = tags_in / (tags_in + tags_out)
        score = math.log((i + SMOOTHING * part) / (o + SMOOTHING * (1 - part))) - math.log(tags_in / tags_out)
        if name == "named":
            weights.named = min(0.0, max(-4.0, score))
        else:
            weights.tags[name] = min(-0.05, max(-0.5 if name in INLINE else -1.0 if name in ITEMS else -4.0, score - 0.2))
    for name, (i, o) in found.items():
        if name[0] not in "#<":
            weights.ratios[name] = ratio(i, o + (PRIOR_WORDS if suspect(name) else 0.0))
    weights.link = min(1.0, max(0.0, 1.0 + ratio(*found.get("#link", (0, 0))) / 4.0))
    return weights


def _extract(weights: Weights) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "html"):
            found = [main_text(page, weights) for page in common.texts(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["key", "text", "n_chars"])

    return run


def extract(pages: DataFrame, weights: Weights, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """Main text of every page: ``key``, ``text`` ("" if none), ``n_chars`` (code points).

    One row per input row. Null and empty pages give an empty text; a page of plain text is its own article.
    ``key`` may be a struct that carries further columns. No shuffle.
    """
    fields = [T.StructField("key", pages.schema[key].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    rows = pages.select(F.col(key).alias("key"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract(weights), T.StructType(fields)).withColumnRenamed("key", key)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    found = extract(pages.select("html", F.struct("page_id", "url").alias("page")), fit(pages), key="page")
    return found.select("page.page_id", "page.url", "text", "n_chars")
