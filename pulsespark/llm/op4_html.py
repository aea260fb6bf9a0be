"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pulsespark.llm._common import documents, schema_with, slices

#: Tags whose content is never text.
HIDDEN = "script|style|noscript|template|svg|math|iframe|object|canvas|video|audio|select|textarea|button|title"
#: Tags that mark what surrounds an article.
BOILER_TAGS = frozenset("nav header footer aside form menu dialog".split())
#: Words that mark it in a class, id or role: a whole name, its last part, or one of two parts.
BOILER = re.compile(r"(?:ads?|advert\w*|banner|sponsor\w*|cookies?|consent|popup|modal|nav\w*|menu|breadcrumbs?|sidebar|widget|footer|masthead|toolbar|related|recommend\w*|comments?|disqus|newsletter|subscribe|pagination|pager|copyright|complementary|contentinfo)", re.I)
#: Words that do so only as a whole name, or outside an article as one of two parts.
WEAK = re.compile(r"(?:promo\w*|notice|side|header|share|social|reply|replies|login|signup|legal|hidden|skip)", re.I)
COMMENT = re.compile(r"(?:comments?|reply|replies|disqus)", re.I)
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Windows of so many lines; a surge needs so many characters in one.
WINDOW = 3
SURGE = 80

_NAME = re.compile(r"[a-zA-Z][\w:-]*")
_HIDDEN = frozenset(HIDDEN.split("|"))
_ATTRIBUTE = re.compile(r"[\s/]*([^\s=>/]+)(?:\s*=\s*)?", re.S)
_BARE = re.compile(r"[^\s>]*")
_BLOCK_END = re.compile(r"</(?:" + "|".join(sorted(BLOCK_TAGS)) + r")(?=[\s/>])")
#: Blocks of running text; a name marks one only if it is a whole class, not a part of one ("share", but not "share-price").
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())


def is_boiler(names: str, tag: str, in_article: bool) -> bool:
    """Whether a class, id or role names what surrounds an article."""
    for name in names.split():
        parts = [x for x in re.split("[_-]+", name) if x]
        if BOILER.fullmatch(name) or WEAK.fullmatch(name):
            return True
        if tag in RUNNING or not parts:
            continue
        if BOILER.fullmatch(parts[-1]) or (len(parts) == 2 and BOILER.fullmatch(parts[0])):
            return True
        if not in_article and len(parts) == 2 and (WEAK.fullmatch(parts[0]) or WEAK.fullmatch(parts[1])):
            return True
    return False


def markup(page: str):
    """(start, end, tag, closes, closed, names) of all markup in order, names being its class, id and role; tag is empty for
    comments, declarations and hidden elements, which end where they are closed, or where the block around them is if they
    never are, or at the end of the page.

    One pass: every search either moves on behind what it found, or is not made again as nothing was found up to the end.
    """
    lower = page.lower() if len(page.lower()) == len(page) else "".join(c.lower() if c.isascii() else c for c in page)
    n, at = len(page), 0
    gone = {'"': n, "'": n}  # from here on there is no such quote
    unclosed: set[str] = set()  # hidden tags that are closed nowhere further on

    def find(what: str, start: int) -> int:
        end = lower.find(what, start)
        return n if end < 0 else end + len(what)

    while (start := page.find("<", at)) >= 0:
        at = start + 1
        head = page[at : at + 1]
        if head in ("!", "?"):
            at = find("-->", start + 4) if page.startswith("<!--", start) else find("]]>", start + 9) if lower.startswith("<![cdata[", start) else find(">", at)
            yield start, at, "", False, False, ""
            continue
        closes = head == "/"
        name = _NAME.match(page, at + closes)
        if not name:
            continue
        tag, at, names = name[0].lower(), name.end(), []
        while at < n:
            found = _ATTRIBUTE.match(page, at)
            if not found:
                break
            key, at = found[1].lower(), found.end()
            if "=" in page[found.end(1) : at]:
                quote = page[at : at + 1]
                close = page.find(quote, at + 1) if quote in gone and at < gone[quote] else -1
                if quote in gone and close < 0:
                    gone[quote] = min(gone[quote], at)
                first, last = (at + 1, close) if close >= 0 else (at, _BARE.match(page, at).end())
                at = close + 1 if close >= 0 else last
                if key in ("class", "id", "role"):
                    names.append(page[first:last])
        end = page.find(">", at)
        if end < 0:  # not closed: no more markup
            yield start, n, "", False, False, ""
            return
        closed = page[end - 1] == "/"
        at = end + 1
        if tag in _HIDDEN and not closes and not closed:
            close = -1 if tag in unclosed else lower.find("</" + tag, at)
            if close >= 0:
                at = find(">", close)
            else:
                unclosed.add(tag)
                block = _BLOCK_END.search(lower, at)
                at = block.start() if block else n
            yield start, at, "", False, False, ""
            continue
        yield start, at, tag, closes, closed, " ".join(names)


def lines(page: str) -> list[tuple[str, bool, bool]]:
    """Lines (blocks) of a page in order, without what is marked as boilerplate: (text, inside an article, an entry of a
    list that is nothing but links).

    Boilerplate is left out piece by piece, so an advert inside a line goes and the line stays. A closing tag that
    nothing opened costs nothing; one that closes an element closes all that is open inside it.
    """
    out: list[tuple[str, bool, bool]] = []
    held: list[str] = []
    linked = solid = 0
    stack: list[tuple[str, bool, bool]] = []  # tag, opens an article, opens boilerplate
    blocks: list[int] = []  # places of block tags in the stack
    open_tags: dict[str, int] = {}
    depth = {"article": 0, "boiler": 0}
    at = 0

    def flush():
        nonlocal linked, solid
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((text, depth["article"] > 0, linked == solid and open_tags.get("li", 0) > 0))
            held.clear()
        linked = solid = 0

    def text(piece: str):
        nonlocal linked, solid
        if depth["boiler"]:
            return
        held.append(piece)
        n = len(piece.strip())
        solid += n
        if open_tags.get("a"):
            linked += n

    def close_to(size: int):
        while len(stack) > size:
            tag, article, boiler = stack.pop()
            open_tags[tag] -= 1
            depth["article"] -= article
            depth["boiler"] -= boiler
        while blocks and blocks[-1] >= size:
            blocks.pop()

    for start, end, tag, closes, closed, names in markup(page):
        if start > at:
            text(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
        if closes:
            if open_tags.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close_to(k)
        elif tag not in VOID_TAGS and not closed:
            if tag in BLOCK_TAGS:  # the head ends where the body begins, a paragraph or entry where the next does
                if blocks and (stack[blocks[-1]][0] == "p" or stack[blocks[-1]][0] == tag == "li"):
                    close_to(blocks[-1])
                if open_tags.get("head"):
                    close_to(next(i for i, x in enumerate(stack) if x[0] == "head"))
            article = tag in ("article", "main")
            if article:
                boiler = any(COMMENT.fullmatch(x) for x in re.split(r"[\s_-]+", names))
            else:
                boiler = tag in BOILER_TAGS or tag == "head" or (tag not in ("body", "html") and bool(names) and is_boiler(names, tag, depth["article"] > 0))
            article = article and not boiler and not depth["boiler"]
            if tag in BLOCK_TAGS:
                blocks.append(len(stack))
            stack.append((tag, article, boiler))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            depth["article"] += article
            depth["boiler"] += boiler
    if at < len(page):
        text(page[at:])
    flush()
    return out


def text_span(weight: np.ndarray) -> tuple[int, int]:
    """First and end line of the text, by the lines' weights.

    Weights are summed over windows of WINDOW lines. A window surges with SURGE characters or more (or with the page's
    most, if that is less); the text reaches from the first line with weight to the dive after the last surge, where a window
    sums to nought, or to the end.
    """
    sums = np.convolve(weight, np.ones(WINDOW, np.int64))[WINDOW - 1 :]
    surges = np.flatnonzero((sums >= min(SURGE, sums.max())) & (weight > 0))
    if not len(surges):
        return 0, 0
    dives = np.flatnonzero(sums[surges[-1] :] == 0)
    return int(np.flatnonzero(weight)[0]), int(surges[-1] + dives[0]) if len(dives) else len(weight)


def main_text(page: str | None) -> str:
    """Text of the article: blocks joined by two line feeds; empty if there is none.

    Lines are those that nothing marks as boilerplate, and of a page that marks an article only its lines. A line weighs
    its length; an entry of a list that is nothing but links weighs nought outside a marked article. The text is every
    line with weight in `text_span`. Ties between windows don't matter, as the first and last surge count.
    """
    got = lines(page or "")
    marked = any(article for _, article, _ in got)
    kept = [(t, 0 if links and not marked else len(t)) for t, article, links in got if article or not marked]
    if not kept:
        return ""
    first, end = text_span(np.array([w for _, w in kept]))
    return "\n\n".join(t for t, w in kept[first:end] if w)


def extract(pages: DataFrame, source: str = "html", target: str = "text") -> DataFrame:
    """pages with `target`, the main text of `source` (null counts as empty), and n_chars, its code points.

    Columns of those names that pages already has are replaced; `source` is dropped, all others stay. One pass over the
    rows, no shuffle.
    """
    rest = [c for c in pages.columns if c not in (source, target, "n_chars")]
    schema = schema_with(pages.select(*rest), **{target: "string", "n_chars": "long"})

    def run(batches):
        for batch in batches:
            for part in slices(batch, source):
                texts = [main_text(h) for h in part.column(source).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest, target, "n_chars"])

    return pages.select(*rest, source).mapInArrow(run, schema)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages; see extract and main_text. Repeated rows are pages of their own; an empty table gives none."""
    return extract(documents(spark, sf_dir, "pages").select("page_id", "url", "html"))
