"""Main text of web pages by tag-path ratios.

A page is read as a list of text blocks, each with the path of block-level tags from the root.
Text length, punctuation and link text are added up per path.  A path's text ratio is its
length outside links per block, its punctuation ratio the punctuation per block; both are
smoothed over neighbouring paths in page order and fused as a product.  Paths above a threshold are
content.  The element that holds them (article, main or the nearest container) keeps its other
blocks too, and paragraphs and headings of sibling containers that come before the last content
stay, so that a heading, lead or short paragraph is not lost.

Blocks in menus, forms, adverts, notices, comments and the like (by tag, role or class) are never
content.  Classes that may hold prose as well (``DOUBTFUL``) lower the score of their path, and
such blocks stay only if their own ratios are those of content.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import text_or_empty

# Tag and class names.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset(
    "nav header footer aside form head script style noscript template iframe svg math button select "
    "option textarea title dialog menu object canvas audio video map fieldset".split()
)
BLOCKS = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol optgroup p pre "
    "search section summary table tbody td tfoot th thead tr ul caption button select option textarea "
    "title script style noscript template iframe svg math object canvas audio video map".split()
)
CLOSES_P = BLOCKS - frozenset("button select option textarea script style noscript template iframe svg math object canvas audio video map html head body".split())
SELF_CLOSING = {
    "li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)),
    "tbody": ("tbody thead tfoot tr td th", ("table",)), "tfoot": ("tbody thead tfoot tr td th", ("table",)),
    "option": ("option", ("select",)),
}
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored promo "
    "promotion sidebar sidebars sidenav nav navbar navigation navi menu menus menubar breadcrumb breadcrumbs "
    "footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations trending comment comments commentlist disqus reply replies respond "
    "pagination pager search searchform copyright toast aside".split()
)
DOUBTFUL = frozenset("discussion widget widgets legal disclaimer skip".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
HOLDERS = frozenset("article main section div td body".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status".split())
PUNCTUATION = re.compile(r"[.,;:!?…、。¿¡]")
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^'\">=]|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[='\"])*+)(?:>|\Z)"
    r"|</[^a-zA-Z>][^>]*>",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
THRESHOLD = 0.2  # of the strongest path
DOUBT = 0.3  # weight of a path with a doubtful class
ELSEWHERE = 0.05  # weight of a path outside the article or main element that a page has
LINKED = 0.6  # share of link text from which a block is a list of links


def attributes(text: str) -> dict[str, str]:
    """Attributes of a tag; the first of a name counts."""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), entities.unescape(value.strip("\"'")) if value else "")
    return found


def marks(own: dict[str, str]) -> set[str]:
    """Words of class and id."""
    return set(re.split(r"[^a-z]+", HUMP.sub(" ", own.get("class", "") + " " + own.get("id", "")).lower()))


def is_outside(tag: str, own: dict[str, str]) -> bool:
    """Whether an element is a menu, form, advert or the like, or is hidden."""
    if tag in ("html", "body", "main"):
        return False
    if tag in OUTSIDE or own.get("role", "").lower() in ROLES or "hidden" in own:
        return True
    if own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", own.get("style", ""), re.I):
        return True
    return not BOILERPLATE.isdisjoint(marks(own))


class Block:
    """Text of one block, its path, its link text, and whether its place is outside the content
    or doubtful."""

    __slots__ = ("doubtful", "link", "outside", "path", "text")

    def __init__(self, path: tuple[str, ...], outside: bool, doubtful: bool, text: str, link: int):
        self.path, self.outside, self.doubtful, self.text, self.link = path, outside, doubtful, text, link


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order; works on broken markup as well."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, bool]] = []  # tag, name in the path, outside, doubtful
    pieces: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        nonlocal pieces
        if pieces:
            text = " ".join("".join(p for p, _ in pieces).split())
            if text:
                link = sum(len(" ".join(p.split())) for p, in_link in pieces if in_link)
                outside, doubtful = stack[-1][2:] if stack else (False, False)
                out.append(Block(tuple(s[1] for s in stack), outside, doubtful, text, link))
            pieces = []

    def pop_to(names: set[str], stops: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in stops:
                return

    at, size = 0, len(page)
    while at < size:
        found = TAG.search(page, at)
        end = found.start() if found else size
        if end > at:
            pieces.append((entities.unescape(page[at:end]), links > 0))
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if tag == "br":
            pieces.append((" ", links > 0))
            continue
        if tag == "a":
            links = 0 if found[1] else 1
            continue
        if tag not in BLOCKS:
            continue
        flush()
        if found[1]:
            if any(s[0] == tag for s in stack):
                pop_to({tag}, ())
                if tag not in ("p", "li"):
                    links = 0
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            pop_to({"p"}, ("article", "section", "div", "td", "th", "li", "main", "aside", "nav", "body", "button"))
        if tag in SELF_CLOSING:
            names, stops = SELF_CLOSING[tag]
            pop_to(set(names.split()), stops)
        own = attributes(found[3])
        inside = bool(stack) and stack[-1][2]
        outside = inside or is_outside(tag, own)
        if tag == "header" and not inside and any(s[0] in ("article", "main") for s in stack):
            outside = False  # the heading of the article itself
        name = tag + "".join("." + c for c in sorted(own.get("class", "").split()))
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if found[3].rstrip().endswith("/") and tag in ("svg", "math"):
            continue
        doubtful = (bool(stack) and stack[-1][3]) or (tag not in ("html", "body", "main") and not DOUBTFUL.isdisjoint(marks(own)))
        stack.append((tag, name, outside, doubtful))
    flush()
    return out


def _smooth(values: list[float]) -> list[float]:
    if len(values) < 3:
        return values
    padded = [values[0], *values, values[-1]]
    return [0.15 * a + 0.7 * b + 0.15 * c for a, b, c in zip(padded, padded[1:], padded[2:], strict=False)]


def _tag(name: str) -> str:
    return name.split(".")[0]


def _holder(path: tuple[str, ...]) -> tuple[str, ...]:
    """The article or main element around a path, else its nearest container."""
    for tags in (("article", "main"), HOLDERS):
        for i in range(len(path) - 1, -1, -1):
            if _tag(path[i]) in tags:
                return path[: i + 1]
    return ()


def _parent(holder: tuple[str, ...]) -> tuple[str, ...]:
    return holder if not holder or _tag(holder[-1]) == "body" else holder[:-1]


def path_ratios(found: list[Block]) -> dict[tuple[str, ...], tuple[float, float]]:
    """Per path, in page order: product of its smoothed ratios, and that product weighted by
    the amount of text, the place and doubtful classes."""
    totals: dict[tuple[str, ...], list[float]] = {}
    for b in found:
        sums = totals.setdefault(b.path, [0, 0, 0, 1.0])
        sums[0] += max(0, len(b.text) - b.link)
        sums[1] += len(PUNCTUATION.findall(b.text))
        sums[2] += 1
        sums[3] = DOUBT if b.doubtful else sums[3]
    text = _smooth([s[0] / s[2] for s in totals.values()])
    points = _smooth([(s[1] + 0.5) / s[2] for s in totals.values()])
    inside = [any(_tag(t) in ("article", "main") for t in path) for path in totals]
    out = {}
    for (path, sums), t, p, own in zip(totals.items(), text, points, inside, strict=True):
        place = 1.0 if own or not any(inside) else ELSEWHERE
        out[path] = (t * p, t * p * sums[0] ** 0.5 * place * sums[3])
    return out


def main_text(page: str) -> str:
    """Blocks of the article joined by one line feed; empty if there are none."""
    found = [b for b in blocks(page) if not b.outside]
    if not found:
        return ""
    ratios = path_ratios(found)
    limit = THRESHOLD * max(weighted for _, weighted in ratios.values())
    content = {path for path, (_, weighted) in ratios.items() if weighted >= limit and weighted > 0}
    if not content:
        content = set(ratios)
    least = THRESHOLD * max(ratios[path][0] for path in content)
    holders = {_holder(path) for path in content}
    named = {h for h in holders if h and _tag(h[-1]) in ("article", "main")}
    parents = {_parent(h) for h in holders - named}
    last = max(i for i, b in enumerate(found) if b.path in content)

    def stays(i: int, b: Block) -> bool:
        if b.path in content:
            return True
        if b.doubtful and ratios[b.path][0] < least:
            return False
        holder = _holder(b.path)
        if holder in named:
            return True
        if b.link >= LINKED * len(b.text):
            return False
        sibling = i < last and bool(b.path) and _tag(b.path[-1]) in PROSE and (holder in parents or _parent(holder) in parents)
        return holder in holders or (sibling and not named)

    return "\n".join(b.text for i, b in enumerate(found) if stays(i, b))


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``id_col, url_col, text, n_chars`` per page, in one pass without a shuffle.

    Null pages count as empty; a page without content has the empty text.  Very long pages are
    read whole.  Repeated rows give equal texts; no rows give no rows; other columns are ignored.
    """

    @F.arrow_udf("string")
    def take(batch: pa.Array) -> pa.Array:
        return pa.array([main_text(page) for page in batch.to_pylist()], pa.string())

    got = pages.select(F.col(id_col), F.col(url_col), take(text_or_empty(html_col)).alias("text"))
    return got.withColumn("n_chars", F.char_length("text").cast("long"))


