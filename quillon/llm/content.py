"""HTML extraction by the maximum-scoring contiguous region."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import as_bytes, bounded_sample, table, with_columns

#: Elements whose content is never text of a page.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object")
#: Elements that hold no part of an article.
BOILERPLATE = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "button", "select"))
#: Words of a class, id or role that say the same of any element.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|banner|breadcrumbs?|comments?|cookies?|"
    r"footer|header|menu|nav|navbar|navigation|newsletter|notice|popup|promo|related|reply|replies|"
    r"share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|widget|contentinfo|complementary|search|"
    r"advertising|alert|consent|discussion|disqus|gdpr|masthead|pagination|promoted|recommended|responses|teaser|topbar)"
    r"(?=$|[\s_-])", re.I)  # fmt: skip
#: Elements within a block; all others end one.
INLINE = frozenset(
    ("a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "dfn", "del", "em", "font", "i", "ins",
     "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
     "tt", "u", "var", "wbr")
)
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: What follows a name up to the end of the tag; ``>`` may stand in quotes. Possessive, so one pass.
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")
#: A word's score, what a tag costs that is never seen in an article, and what an element costs that is
#: no part of one, whatever it holds.
WORD, COST, OUTSIDE = 1.0, 8.0, 1.0
#: How often a tag is taken to stand outside before any is seen, as if FIRST had been, and of other tags.
FIRST, OTHER = 10, 0.25
USUAL = {
    name: share for share, names in (
        (0.02, "p h1 h2 h3 h4 h5 h6 br b i em strong u s q cite code pre blockquote sub sup mark small time abbr article main"),
        (0.05, "div section span ul ol li dl dt dd table thead tbody tr td th figure figcaption img picture hr"),
    ) for name in names.split()
}
#: How many labelled pages a fit takes at most, and how often it must see a word of a class to learn it.
SAMPLE_PAGES, SEEN = 2_000, 5


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, value, attributes)`` in page order: a text piece, or a tag as its name with a leading slash
    if it closes. Comments, declarations and elements of RAW are left out. One pass over the page: an
    open quote can only once send the scan to the page's end; from then on tags end at the next ``>``."""
    at, size, loose = 0, len(page), False
    while at < size:
        j = page.find("<", at)
        if j < 0:
            yield "text", page[at:], ""
            return
        if j > at:
            yield "text", page[at:j], ""
        if page.startswith("<!--", j):
            at = end + 3 if (end := page.find("-->", j + 4)) >= 0 else size
        elif page[j + 1 : j + 2] in ("!", "?"):
            at = end + 1 if (end := page.find(">", j)) >= 0 else size
        elif (m := NAME.match(page, j)) is None:
            yield "text", "<", ""
            at = j + 1
        else:
            rest = None if loose else REST.match(page, m.end())
            if rest is None:
                loose = True
                if (end := page.find(">", m.end())) < 0:
                    return
            at = rest.end() if rest else end + 1
            name, attributes = m[1].lower(), page[m.end() : at - 1]
            closes = page[j + 1] == "/"
            if name not in CLOSE:
                yield "tag", "/" * closes + name, attributes
            elif not closes and not (attributes.endswith("/") and name in ("svg", "object")):
                at = end.end() if (end := CLOSE[name].search(page, at)) else size


@dataclass(slots=True)
class Item:
    """A text piece with its number of words, or a tag. ``outside``: it lies in an element that holds no
    part of an article; ``border``: it opens such an element."""

    text: bool
    value: str
    words: int = 0
    marks: str = ""
    outside: bool = False
    border: bool = False


def pieces(page: str) -> list[Item]:
    """The items of a page in order.

    Marks of html and body don't count, and of article and main only a whole word of the class. Nor
    do those of an element with over half of the page's words that holds every article there is."""
    items: list[Item] = []
    home: list[int] = []  # the innermost element of each item
    parent, hard, marked, words, named = [-1], [False], [False], [0], [0]
    stack, names, opened = [0], [""], Counter()
    for kind, value, attributes in tokens(page):
        at = stack[-1]
        if kind == "text":
            n = len(value.split())
            items.append(Item(True, value, n))
            home.append(at)
            words[at] += 0 if hard[at] else n
        elif value[0] == "/":
            items.append(Item(False, value))
            home.append(at)
            if opened[value[1:]]:
                name = ""
                while name != value[1:]:
                    stack.pop()
                    name = names.pop()
                    opened[name] -= 1
        else:
            marks = " ".join(filter(None, (x for a in ATTRIBUTE.findall(attributes) for x in a)))
            block = value not in VOID and value not in INLINE and not attributes.endswith("/")
            if value == "p":  # a paragraph ends where the next begins
                while names[-1] == "p":
                    stack.pop()
                    opened[names.pop()] -= 1
                at = stack[-1]
            if value in ("article", "main"):
                mark = any(MARKED.fullmatch(x) for x in marks.split())
            else:
                mark = bool(marks) and value not in ("html", "body") and bool(MARKED.search(CAMEL.sub("-", marks)))
            if block:
                parent.append(at)
                hard.append(hard[at] or value in BOILERPLATE)
                marked.append(mark)
                words.append(0)
                named.append(int(value in ("article", "main") and not hard[-1]))
                at = len(parent) - 1
                stack.append(at)
                names.append(value)
                opened[value] += 1
            items.append(Item(False, value, 0, marks.lower()))
            home.append(at)
    for e in range(len(parent) - 1, 0, -1):
        words[parent[e]] += words[e]
        named[parent[e]] += named[e]
    out = [False]
    for e in range(1, len(parent)):
        wide = 2 * words[e] > words[0] and named[e] == named[0]
        out.append(out[parent[e]] or hard[e] or (marked[e] and not wide))
    last = 0
    for x, e in zip(items, home, strict=True):
        x.outside, x.border = out[e], e > last and out[e] and not out[parent[e]]
        last = max(last, e)
    return items


def score(x: Item, weights: dict[str, float]) -> float:
    """Words score, tags cost: as their name does, or a word of their class that costs more. What lies
    outside neither scores nor costs, but for the element itself."""
    if x.outside:
        return -OUTSIDE if x.border else 0.0
    if x.text:
        return WORD * x.words
    cost = weights.get(x.value)
    if cost is None:
        cost = -COST * USUAL.get(x.value.removeprefix("/"), OTHER)
    return min([cost, *(weights[k] for w in x.marks.split() if (k := f".{w}") in weights)]) if x.marks else cost


def region(items: list[Item], weights: dict[str, float]) -> tuple[int, int]:
    """The first of the best contiguous runs of ``items`` by :func:`score`. One linear scan; (0, 0) if no
    run has a positive sum."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(items):
        if total <= 0:
            total, start = 0.0, i
        total += score(x, weights)
        if total > best:
            best, span = total, (start, i + 1)
    return span


def text_of(items: Iterable[Item]) -> str:
    """Blocks of the items in page order, joined by one space."""
    blocks, block = [], []
    for x in items:
        if x.text:
            if not x.outside:
                block.append(x.value)
        elif x.value.removeprefix("/") not in INLINE:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    clean = (SPACE.sub(" ", html.unescape(b)).strip() for b in blocks)
    return " ".join(b for b in clean if b)


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of a page: what the best run holds of an article; empty if there is none."""
    items = pieces(page) if page else []
    start, end = region(items, weights)
    return text_of(items[start:end])


def counts(page: str) -> tuple[Counter, Counter]:
    """How often each tag, and each word of a class (with a dot), stands inside an article and outside."""
    inside, outside, deep = Counter(), Counter(), 0
    for x in pieces(page):
        if not x.text:
            deep += x.value == "article"
            (inside if deep else outside).update([x.value, *(f".{w}" for w in set(x.marks.split()))])
            deep -= x.value == "/article" and deep > 0
    return inside, outside


def fit(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """What each tag costs, and each word of a class, learned from pages that label their content with
    ``article`` themselves: COST by the share of those seen that stand outside. Tags seen seldom cost
    about what is usual of them.

    ``sample_pages`` bounds the labelled pages, those with the smallest hash of the id; every task sends
    one count a tag, and all of them are used. Without labelled pages nothing is learned."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for b in batches:
            for t in as_bytes(b.column(0)):
                inside, outside = counts((t or b"").decode("utf-8", "replace"))
                total.update({(k, True): n for k, n in inside.items()})
                total.update({(k, False): n for k, n in outside.items()})
        cols = [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.bool_()), pa.array(total.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["tag", "inside", "n"])

    known = pages.where(F.contains(F.col(html_col), F.lit("<article"))).select(id_col)
    ids = bounded_sample(known.distinct(), id_col, sample_pages)
    known = pages.join(F.broadcast(ids), id_col).select(html_col)
    made = known.mapInArrow(counted, "tag string, inside boolean, n long")
    rows = made.groupBy("tag").agg(F.sum(F.expr("if(inside, n, 0)")).alias("a"), F.sum(F.expr("if(inside, 0, n)")).alias("b")).collect()
    usual = lambda tag: USUAL.get(tag.removeprefix("/"), OTHER)
    return {
        r.tag: -COST * (r.b + FIRST * usual(r.tag)) / (r.a + r.b + FIRST)
        for r in rows if not r.tag.startswith(".") or r.a + r.b >= SEEN
    }


def with_text(df: DataFrame, weights: dict[str, float], *, html_col: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the main text of each page; null html is empty, like a page without text."""
    made = lambda texts: [[extract((t or b"").decode("utf-8", "replace"), weights) for t in texts]]
    return with_columns(df, html_col, [(out, T.StringType(), pa.string())], made)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all ``pages``."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = with_text(pages, fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


ORACLE_SQL = r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '') AS body FROM pages),
b AS (SELECT page_id, url, replace(replace(replace(
        regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;', '&'), '&amp', '&') AS body FROM a)
SELECT page_id, url, trim(regexp_replace(body, '\s+', ' ', 'g')) AS text,
       CAST(length(trim(regexp_replace(body, '\s+', ' ', 'g'))) AS BIGINT) AS n_chars FROM b
"""
