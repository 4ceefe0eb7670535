"""Main text of web pages by tag-path ratios.

A page becomes a sequence of blocks, each with the path of block elements above it. Per path the
text outside links, the punctuation and the blocks are added up; the ratios are smoothed over the
sequence of blocks and fused to one weight per path. The weights choose the content, ``article`` and
``main`` or else the container with the mass of the weight, of which every block stays, however short; outside
it paths under a threshold are left out. Elements that are never main text (navigation, footers) weigh
nothing. Nor do those whose class, id or role names an advert, a sidebar, comments and the like, unless
they hold the only ``article`` or ``main`` or most of the page's weight; nor forms, menus and hidden elements,
unless such a one is wrapped around the page. Time and memory grow with the page, however deep it nests.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A path outside the content is kept if its weight is at least this part of the mean weight, by text length, of all paths.
THRESHOLD = 0.35
#: The content is in the innermost container with more than this part of the weight.
MASS = 0.6
_SMOOTH = (0.25, 0.5, 0.25)

#: A form, menu or hidden element is only taken for a wrapper if a block under it has at least so many characters outside links.
PASSAGE = 80

_START = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
#: A tag with a quote that nothing closes ends at the next angle.
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+")
_MARKS = re.compile(r"[.,;:!?、。，！？]")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("script style noscript template textarea title svg math iframe object select button head canvas audio video".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
_BLOCK = frozenset(
    "html body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th section article aside nav header footer "
    "main form fieldset legend blockquote pre figure figcaption address details summary hr dialog menu center hgroup search option".split()
)
_CLOSES_P = _BLOCK - frozenset("html body td th tr thead tbody tfoot caption option".split())
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, set()), "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
_ASIDE = frozenset("nav footer aside dialog search".split())
#: Not main text as such, but sometimes wrapped around a whole page, as hidden elements are.
_WRAPPERS = frozenset("form menu fieldset".split())
_WRAPPER = frozenset(["(wrapper)"])
_MAIN = frozenset("article main".split())
_CONTAINER = frozenset("html body div section article main center td figure blockquote".split())
_ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar sidenav rail footer masthead topbar comment comments reply replies respond disqus cookie cookies consent gdpr notice "
    "notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget search "
    "pagination pager toolbar copyright legal skip tags hidden contentinfo complementary header".split()
)


_TALK = frozenset("comment comments reply replies respond disqus".split())
#: A class with one of these parts tells a state of the page, as no-sidebar or menu-open.
_STATE = frozenset("no not non has have with without is free open opened close closed collapsed expanded enabled disabled fixed sticky on off ready".split())
#: Names that mean what they say only as a whole class or before a dash, not as in overflow-hidden.
_NOT_LAST = frozenset("hidden widget overlay skip tags legal header copyright alert modal rail".split())


def _is_aside(tag: str, in_main: bool) -> bool:
    """Whether an element and all in it is never main text."""
    return tag in _ASIDE or tag in _UNSEEN or (tag == "header" and not in_main)


def _is_wrapper(tag: str, attributes: str) -> bool:
    """Whether an element is a form, a menu or hidden, which is main text only if it is around the page."""
    if tag in _WRAPPERS:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
    return False


def _aside_names(tag: str, attributes: str, in_main: bool) -> frozenset[str]:
    """The names of an element's class, id and role by which it isn't main text, if nothing else tells that it is; _WRAPPER is one."""
    if _is_wrapper(tag, attributes):
        return _WRAPPER
    if not attributes or tag in ("html", "body"):
        return frozenset()
    names = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for token in "".join(values).lower().split():
                parts = _NAME.findall(token)
                if parts and not _STATE & set(parts):
                    names.add(parts[0])
                    if not in_main and parts[-1] not in _NOT_LAST:
                        names.add(parts[-1])
    if tag in _MAIN:
        return frozenset(names & {"comment", "comments", "reply", "ad", "advert"})
    return frozenset(names & (_ASIDE_NAMES - {"header", "tags"} if in_main else _ASIDE_NAMES))


class _Open:
    """An open block element (or an element whose text isn't shown); ``path`` numbers its tag path."""

    __slots__ = ("tag", "path", "depth", "aside", "main", "above", "names")

    def __init__(self, tag: str, path: int, aside: bool, main: bool, above: _Open | None = None, names: frozenset[str] = frozenset()):
        self.tag, self.path, self.aside, self.main, self.above, self.names = tag, path, aside, main, above, names
        self.depth = above.depth + 1 if above else 0


def _elements(found: list[tuple[_Open, bool, str, int]]) -> list[_Open]:
    """The elements of all blocks and those above them, each after the one above it."""
    out: list[_Open] = []
    seen: set[_Open] = set()
    for element, *_ in found:
        line = []
        while element is not None and element not in seen:
            seen.add(element)
            line.append(element)
            element = element.above
        out.extend(reversed(line))
    return out


def _sums(elements: list[_Open], parts: list[tuple[_Open, float]]) -> dict[_Open, float]:
    """Per element the sum of the parts at or under it."""
    out = dict.fromkeys(elements, 0.0)
    for element, part in parts:
        out[element] += part
    for element in reversed(elements):
        if element.above is not None:
            out[element.above] += out[element]
    return out


def _containers(elements: list[_Open]) -> dict[_Open, _Open]:
    """The container that each element is or is in."""
    out: dict[_Open, _Open] = {}
    for element in elements:
        out[element] = element if element.above is None or element.tag in _CONTAINER else out[element.above]
    return out


def blocks(page: str) -> list[tuple[_Open, bool, str, int]]:
    """(element, under article or main, text, characters inside links) of every block that can be main text, in page order."""
    out: list[tuple[_Open, bool, str, int]] = []
    stack = [_Open("", 0, False, False)]
    is_open: defaultdict[str, int] = defaultdict(int)
    paths: dict[tuple[int, str], int] = {}
    parts: list[str] = []
    links = link_size = place = at = loose = 0
    last = page.rfind(">")

    def flush() -> None:
        nonlocal link_size
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and not stack[-1].aside:
                out.append((stack[-1], stack[-1].main, text, min(link_size, len(text))))
            parts.clear()
        link_size = 0

    def push(tag: str, aside: bool, main: bool, names: frozenset[str]) -> None:
        path = paths.setdefault((stack[-1].path, tag), len(paths) + 1)
        stack.append(_Open(tag, path, aside, main, stack[-1], names))
        is_open[tag] += 1

    def close(until: int) -> None:
        flush()
        for element in stack[until:]:
            is_open[element.tag] -= 1
        del stack[until:]

    size = len(page)
    while place < size:
        start = _START.search(page, at)
        found = None
        if start:
            at = start.start()
            if at < last or page[at + 1] in "!?":  # a tag after the last angle never ends, so it is text
                found = (_LOOSE if at < loose else _TAG).match(page, at)
                if not found:
                    loose = max(page.rfind('"'), page.rfind("'"))
                    found = _LOOSE.match(page, at)
            if not found:
                at = start.end()
                continue
        text = page[place : found.start()] if found else page[place:]
        if text:
            parts.append(text)
            link_size += len(text) if links else 0
        if not found:
            break
        place = at = found.end()
        if not found[2]:
            continue
        tag, ending = found[2].lower(), bool(found[1])
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            links = max(0, links + (-1 if ending else 1)) if ending else 1
        elif tag in _VOID and tag != "hr":
            continue
        elif tag not in _BLOCK and tag not in _UNSEEN:
            names = frozenset() if ending or found[3].endswith("/") else _aside_names(tag, found[3], stack[-1].main)
            if names:
                flush()
                push(tag, stack[-1].aside, stack[-1].main, names)
            elif ending and stack[-1].tag == tag:
                close(len(stack) - 1)
        elif ending:
            if is_open[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
                links = 0
            else:
                flush()
        else:
            flush()
            if tag in _CLOSES_P and is_open["p"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in ("td", "th", "table", "button", "object"):
                        break
            if tag in _SIBLINGS:
                own, limit = _SIBLINGS[tag]
                for k in range(len(stack) - 1, 0, -1) if any(is_open[t] for t in own) else ():
                    if stack[k].tag in own:
                        close(k)
                        break
                    if stack[k].tag in limit:
                        break
            links = 0
            if tag == "hr":
                continue
            top = stack[-1]
            aside = top.aside or _is_aside(tag, top.main)
            names = frozenset() if aside else _aside_names(tag, found[3], top.main)
            push(tag, aside, top.main or (tag in _MAIN and not aside), names)
            if tag in _RAW:
                end = re.compile(f"</{tag}", re.I).search(page, place)
                place = at = end.start() if end else size
                if end is None:
                    break
    close(1)
    return out


def _weights(found: list[tuple[_Open, bool, str, int]]) -> list[float]:
    """Fused ratios of each block: text outside links, and punctuation, both also smoothed over the neighbours."""
    plain = [math.log1p(len(text) - linked) for _, _, text, linked in found]
    marks = [math.log1p(len(_MARKS.findall(text))) for _, _, text, _ in found]

    def smooth(values: list[float]) -> list[float]:
        padded = [values[0], *values, values[-1]]
        return [sum(w * v for w, v in zip(_SMOOTH, padded[k : k + 3], strict=True)) for k in range(len(values))]

    fused = [p + s + m + 0.5 * t for p, s, m, t in zip(plain, smooth(plain), marks, smooth(marks), strict=True)]
    return [weight if linked < 0.6 * len(text) else 0.0 for weight, (_, _, text, linked) in zip(fused, found, strict=True)]


def _without_named(found: list[tuple[_Open, bool, str, int]]) -> list[tuple[_Open, bool, str, int]]:
    """The blocks not under an element that its names make no main text.

    Names don't count if the page's only ``article`` or ``main`` with text is under the element or if most of the
    weight is; comments need to be all there is. Forms, menus and hidden elements don't count if they are around
    the page: no ``article`` or ``main`` is outside them, and most of the weight is under them, with an ``article``,
    a ``main`` or a whole passage. Elements under one whose names don't count are judged in turn.
    """
    fused, ignored, elements = _weights(found), set(), _elements(found)
    if not any(element.names for element in elements):
        return found

    while True:
        outermost: dict[_Open | None, _Open | None] = {None: None}
        for element in elements:
            outermost[element] = outermost[element.above] or (element if element.names and element not in ignored else None)
        named = [outermost[element] for element, *_ in found]
        clear = [block for block, top in zip(found, named, strict=True) if top is None]
        main = any(block[1] for block in clear)
        weight: dict[_Open, float] = {}
        with_main, with_passage = set(), set()
        for (_, in_main, text, linked), top, w in zip(found, named, fused, strict=True):
            if top is not None:
                weight[top] = weight.get(top, 0.0) + w
                if in_main:
                    with_main.add(top)
                if len(text) - linked >= PASSAGE:
                    with_passage.add(top)
        half = 0.5 * sum(fused)

        def is_content(top: _Open, w: float) -> bool:
            if top.names is _WRAPPER:
                return not main and w > half and (top in with_main or top in with_passage)
            return (not clear or not top.names & _TALK) and ((top in with_main and not main) or w > half)

        content = {top for top, w in weight.items() if is_content(top, w)}
        if not content:
            return clear
        ignored |= content


def main_text(page: str | None, threshold: float = THRESHOLD) -> str:
    """The blocks of the content and of other kept paths, joined by blank lines; null and empty pages give an empty text."""
    found = blocks(page or "")
    if found:
        found = _without_named(found)
    if not found:
        return ""
    fused = _weights(found)
    total_weight = sum(fused)
    if sum(weight for (_, main, _, _), weight in zip(found, fused, strict=True) if main) > 0.5 * total_weight:
        return "\n\n".join(text for _, main, text, _ in found if main)
    by_path: dict[int, list[float]] = {}
    for (element, _, text, _), weight in zip(found, fused, strict=True):
        total = by_path.setdefault(element.path, [0.0, 0, 0])
        total[0] += weight
        total[1] += 1
        total[2] += len(text)
    weights = {path: total / n for path, (total, n, _) in by_path.items()}
    mean = sum(weights[path] * size for path, (_, _, size) in by_path.items()) / sum(size for _, _, size in by_path.values())
    elements = _elements(found)
    containers = _containers(elements)
    under = _sums(elements, [(element, weight) for (element, *_), weight in zip(found, fused, strict=True)])
    # Elements on one line down from the root hold more than half, so the innermost is the deepest.
    heavy = [e for e, weight in under.items() if weight > MASS * total_weight and (e.tag in _CONTAINER or e.above is None)]
    root = max(heavy, key=lambda e: e.depth) if heavy else None

    in_root: dict[_Open | None, bool] = {None: False}
    for element in elements:
        in_root[element] = element is root or in_root[element.above]

    def kept(element: _Open, text: str, linked: int) -> bool:
        # Links alone in a container are a menu; with other text beside them they belong to it.
        if in_root[element] and (linked < 0.6 * len(text) or under[containers[element]] > 0):
            return True
        return weights[element.path] >= threshold * mean and weights[element.path] > 0

    return "\n\n".join(text for element, _, text, linked in found if kept(element, text, linked))


def extract(pages: DataFrame, html_column: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` without the html but with ``text`` and ``n_chars`` (code points).

    Every row is returned, repeated rows as often as they come. Null, empty and text-free pages have an
    empty text. Whole pages are read, whatever their length; broken markup is read as far as it makes
    sense and never fails. Columns named ``text`` or ``n_chars`` are replaced. No shuffle.
    """
    base = pages.select(*(c for c in pages.columns if c not in ("text", "n_chars", html_column)), html_column)
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, threshold) for page in batch.column(len(names) - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*names[:-1], "text"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.schema.fields[:-1])
    return base.mapInArrow(run, f"{kinds}text string").withColumn("n_chars", F.char_length("text").cast("long"))
