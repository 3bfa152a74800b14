"""HTML extraction by tag-path ratios.

A page is cut into blocks of text. For every path of tags from the root to a block's element, text lengths (less those
of links) and punctuation are added up over the page: content paths hold much punctuated text, navigation, notices and
footers little. Both ratios of a path are given to its blocks, smoothed over neighbours in page order, fused to one
number, and averaged by path again; the same is done with the ratios by node. A path whose fused ratio reaches a share
of the page's mean, weighted by text, passes. The lowest element that holds all that passes is the article's, and in it
the paths that pass by node join, and short parts of the running text beside them.

Elements that HTML itself sets apart (nav, footer, aside, form ...) and hidden ones are no candidates. Names in class,
id or role are only a prior: they lower the ratios below them, which decides nothing where all of a page's text is
below such a name. Every step is linear in the page, however deep it is nested.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*'|["'])*+)>?|[!?/][^>]*>?)""", re.DOTALL)
MARK = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)

#: Fixed names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title select noframes xmp plaintext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input".split())
NOT_CONTENT = frozenset("nav footer aside form button menu dialog fieldset head".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Elements that are parts of a running text, whatever their length.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 hgroup li dt dd blockquote pre td th caption figcaption summary".split())
#: Elements that are never entered alone: parts of a text, and what holds such parts.
WITHIN_TEXT = PROSE | frozenset("ul ol dl table tbody thead tfoot tr figure details address".split())
LANDMARKS = frozenset(("article", "main"))
#: An element of the first ends open ones of the second, up to one of the third.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tr", "td", "th", "thead", "tbody"), ("table",)), "thead": (("tr", "td", "th", "tbody"), ("table",)), "tfoot": (("tr", "td", "th", "tbody", "thead"), ("table",)),
}
#: Words in class, id or role that make what is below them less likely.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promos promotion banner banners sidebar sidebars side aside menu menus nav navbar navigation breadcrumb breadcrumbs "
    "header masthead topbar footer foot comment comments comentarios commentlist disqus respond reply replies notice notices cookie cookies consent gdpr alert alerts popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations widget widgets pager pagination search form skip toolbar legal copyright contentinfo complementary".split()
)
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")
CUT = re.compile(r"[^a-z0-9]+")


@dataclass(frozen=True)
class Settings:
    """``window``: neighbours on each side that smooth a block's ratios; ``share``: part of the mean ratio that a path
    must reach; ``node_share``: the same by node, within the article's element; ``named``: factor of the ratios below an element with a boilerplate name; ``landmark``: factor of those
    in article and main."""

    window: int = 1
    share: float = 0.7
    node_share: float = 0.6
    named: float = 0.25
    landmark: float = 1.5


@dataclass(slots=True)
class Block:
    """``path``: number of its tag path; ``element``: of its element; ``links``: length of its links; ``prior``: factor
    of its ratios, 0 if HTML rules it out."""

    path: int
    element: int
    tag: str
    text: str
    links: int
    prior: float


def _boilerplate_name(attributes: str) -> bool:
    for m in MARK.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            if any(w in BOILERPLATE for w in CUT.split(re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())):
                return True
    return False


def _classes(attributes: str) -> str:
    found = CLASS.search(attributes) if "class" in attributes.lower() else None
    return "." + (found[1] or found[2] or found[3] or "") if found else ""


def parse(page: str, settings: Settings = Settings()) -> tuple[list[Block], list[int], list[str]]:
    """The blocks by page order; the parent of each block element, and its tag. Element 0 is the page."""
    out: list[Block] = []
    parents, tags = [-1], [""]
    paths: dict[tuple[int, str], int] = {}  # a tag path is its parent's number and a tag, of boxes with their class
    # open elements: tag, path, block element, prior, whether in a link, whether in a landmark
    stack: list[tuple[str, int, int, float, bool, bool]] = [("", 0, 0, 1.0, False, False)]
    open_: Counter = Counter()
    text: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                _, path, element, prior, _, _ = stack[-1]
                out.append(Block(path, element, tags[element], joined, links, prior))
            text.clear()
        links = 0

    def pop_to(n: int) -> None:
        if any(x[0] not in INLINE for x in stack[n:]):
            flush()
        for x in stack[n:]:
            open_[x[0]] -= 1
        del stack[n:]

    at, low = 0, None
    while True:
        found = MARKUP.search(page, at)
        chunk = page[at : found.start() if found else len(page)]
        if chunk:
            text.append(chunk)
            if stack[-1][4]:
                links += len(chunk.strip())
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            if open_[tag]:
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n][0] == tag:
                        pop_to(n)
                        break
                    if tag in INLINE and stack[n][0] not in INLINE:
                        break
            elif tag == "p":
                flush()
            continue
        if tag in RAW:
            if tag not in INLINE:
                flush()
            if not found[3].endswith("/") or tag not in ("svg", "math"):
                low = low if low is not None else page.lower() if page.lower().isascii() or len(page.lower()) == len(page) else page
                end = low.find(f"</{tag}", at)
                close = page.find(">", end) if end >= 0 else -1
                at = close + 1 if close >= 0 else len(page)
            continue
        if tag in VOID:
            if tag == "hr":
                if open_["p"]:
                    pop_to(next(n for n in range(len(stack)) if stack[n][0] == "p"))
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        if tag == "body" and open_["head"]:
            pop_to(next(n for n in range(len(stack)) if stack[n][0] == "head"))
        if tag in ENDS_PARAGRAPH and open_["p"]:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n][0] == "p":
                    pop_to(n)
                    break
                if stack[n][0] not in INLINE:
                    break
        if tag in ENDS:
            own, limit = ENDS[tag]
            if any(open_[x] for x in own):
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n][0] in limit:
                        break
                    if stack[n][0] in own:
                        pop_to(n)
                        if tag in ("li", "dt", "dd", "option"):
                            break
        if tag not in INLINE:
            flush()
        _, path, element, prior, link, landmark = stack[-1]
        if tag in NOT_CONTENT or tag == "header" and not landmark or "hidden" in found[3].lower() and HIDDEN.search(found[3]) or "none" in found[3] and HIDDEN.search(found[3]):
            prior = 0.0
        elif prior:
            if tag in LANDMARKS and not landmark:  # names around it say nothing of it
                prior, landmark = settings.landmark, True
            if found[3] and "=" in found[3] and tag not in ("html", "body", "main") and _boilerplate_name(found[3]):
                prior *= settings.named
        if found[3].endswith("/") and tag in INLINE:
            continue
        if tag not in INLINE:
            path = paths.setdefault((path, tag if tag in WITHIN_TEXT else tag + _classes(found[3])), len(paths) + 1)
            parents.append(element)
            tags.append(tag)
            element = len(tags) - 1
        stack.append((tag, path, element, prior, link or tag == "a", landmark))
        open_[tag] += 1
    flush()
    return out, parents, tags


def path_ratios(found: list[Block], settings: Settings) -> dict[int, tuple[float, float]]:
    """Two fused ratios of each path: of its text and punctuation in all, and by node."""
    length, marks, nodes = Counter(), Counter(), Counter()
    for x in found:
        length[x.path] += len(x.text) - min(len(x.text), 2 * x.links)
        marks[x.path] += len(PUNCTUATION.findall(x.text))
        nodes[x.path] += 1
    out = []
    for of in (Counter(dict.fromkeys(nodes, 1)), nodes):
        raw = [(math.log1p(length[x.path] / of[x.path]), math.log1p(marks[x.path] / of[x.path])) for x in found]
        fused = dict.fromkeys(nodes, 0.0)
        for i, x in enumerate(found):
            near = raw[max(0, i - settings.window) : i + settings.window + 1]
            # a block's own ratios and those smoothed over its neighbours weigh alike
            a = (raw[i][0] + sum(a for a, _ in near) / len(near)) / 2
            b = (raw[i][1] + sum(b for _, b in near) / len(near)) / 2
            fused[x.path] += a * (1 + b) * x.prior / nodes[x.path]
        out.append(fused)
    return {p: (out[0][p], out[1][p]) for p in nodes}


def passing_blocks(found: list[Block], ratio: dict[int, tuple[float, float]], settings: Settings) -> tuple[list[bool], list[bool]]:
    """By each of the two ratios: whether a block's path reaches the threshold and the block is no list of links. By
    the first all candidates if none."""
    weight = [(len(x.text) - min(len(x.text), 2 * x.links)) * (x.prior > 0) for x in found]
    out = []
    for k, share in enumerate((settings.share, settings.node_share)):
        mean = sum(ratio[x.path][k] * w for x, w in zip(found, weight)) / max(1, sum(weight))
        out.append([x.prior > 0 and ratio[x.path][k] >= share * mean and 2 * x.links <= len(x.text) for x in found])
    return (out[0] if any(out[0]) else [x.prior > 0 for x in found]), out[1]


def container(found: list[Block], passing: list[bool], parents: list[int], tags: list[str]) -> int:
    """The lowest box that holds all passing blocks, but none within the outermost article or main."""
    count = [0] * len(tags)
    for x, ok in zip(found, passing):
        count[x.element] += ok
    for e in range(len(tags) - 1, 0, -1):  # a parent comes before its children
        count[parents[e]] += count[e]
    top = 0
    for e in range(1, len(tags)):
        if count[e] == count[0] and tags[e] not in WITHIN_TEXT:
            top = e
            if tags[e] in LANDMARKS:
                break
    return top


def extract_text(page: str | None, settings: Settings = Settings(), ratios=path_ratios) -> str:
    """The main text; blocks joined by two line feeds."""
    found, parents, tags = parse(page or "", settings)
    if not any(x.prior for x in found):
        return ""
    total, by_node = passing_blocks(found, ratios(found, settings), settings)
    top = container(found, total, parents, tags)
    inside, box = [e == top for e in range(len(tags))], list(range(len(tags)))
    for e in range(top + 1, len(tags)):
        inside[e] = inside[parents[e]]
        box[e] = box[parents[e]] if tags[e] in WITHIN_TEXT else e
    # inside, a path may pass by either ratio; and running text in a box with text that passes stays, however short,
    # unless it is links or a name speaks against it
    chosen = [inside[x.element] and (a or b) for x, a, b in zip(found, total, by_node)]
    holds = {box[x.element] for x, ok in zip(found, chosen) if ok}
    prior = min(1.0, max(x.prior for x in found))
    return "\n\n".join(x.text for x, ok in zip(found, chosen) if ok or inside[x.element] and box[x.element] in holds and x.tag in PROSE and x.prior >= prior and 2 * x.links <= len(x.text))


def text_column(page: Column, settings: Settings = Settings()) -> Column:
    return F.pandas_udf(lambda pages: pd.Series([extract_text(x, settings) for x in pages], dtype=object), "string")(page)


def extract_main_text(df: DataFrame, html_col: str = "html", keys: tuple[str, ...] = ("page_id", "url"), settings: Settings = Settings()) -> DataFrame:
    """One row per input row: the keys and ``text``.

    Defined cases: null, empty and text-less pages give an empty text; markup that is cut off or never closed ends
    with the page; pages nested tens of thousands deep take time in proportion to their length; repeated rows give a
    row each; an empty table gives an empty table.
    """
    return df.select(*keys, text_column(F.col(html_col), settings).alias("text"))
