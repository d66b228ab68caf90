"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each at its root-to-leaf path of tags (with class names, id and role). Inline elements belong to the block they stand in.
Text length, punctuation and link text are summed per path and fused into one ratio. Ratios are smoothed in two ways: a path shares
in its container's sum, so that a short heading or line goes with its neighbours, and a path inside an article or main element shares in the
sums of the elements between, by a factor of ``DECAY`` a level. Paths inside an article or main element weigh ``MAIN`` times. Paths at or above ``SHARE`` of
the page's best ratio are content, wherever they stand.

Paths through menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments are left out first: by their tag, or by
a class, id or role that is such a name as a whole. A name doesn't count on an article, main or body element. On a page without these a
layout name (as of a header or sidebar) doesn't count either where its element holds more than half of the page's text.

The reader is linear in the page's length, whatever is left open. Line breaks are blanks; character references are decoded.
Null and empty pages, and pages without content, give an empty text. Repeated rows give repeated results, an empty table an empty one;
columns other than the id, the address and the html are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SHARE, MAIN, DECAY = 0.25, 2.0, 0.9
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = frozenset("script style textarea title noscript template svg iframe object math".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th tr tbody thead tfoot ul ol dl table blockquote pre figure figcaption".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES_SAME = frozenset("li dd dt td th tr option".split())
_BOUND = frozenset("html body div section article main aside nav header footer form table td th ul ol dl blockquote".split())
_NEVER = frozenset("head nav header footer aside form script style noscript button select option label input menu dialog title textarea template iframe svg".split())
_WHOLE = frozenset({"html", "body", "article", "main"})
_PLACE = "site|page|main|top|bottom|global|left|right|post|article"
_PART = "header|footer|nav|navbar|navigation|menu|sidebar|masthead"
_OTHER = "ads?|adverts?|advertisements?|advertising|banner|breadcrumbs?|comments?|cookies?|consent|disqus|newsletter|notice|pagination|popup|promos?|promotion|related|share|sharing|social|sponsor(?:ed)?|subscribe|widgets?|search"
_SIGN = re.compile(
    rf"(?:(?:{_PLACE})[-_])?(?:{_PART})|(?:{_OTHER})|(?:{_PART}|{_OTHER})[-_](?:list|box|bar|wrap|wrapper|container|area|section|block|links?|banner|notice|popup|inner|unit|slot|form|thread|body|item|\d+)|complementary|contentinfo", re.I
)
_LAYOUT = re.compile(rf"(?:(?:{_PLACE})[-_])?(?:{_PART}).*|(?:comments?|widgets?|related|search).*|complementary|contentinfo", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?]")
_SPACE = re.compile(r"\s+")


class _Paths:
    """The page's paths as a tree; every path knows its container, its article and what marks it as no content."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.parent, self.tag, self.block, self.box, self.main, self.depth = [-1], [""], [0], [0], [-1], [0]
        self.never, self.sign, self.linked, self.layout = [False], [-1], [False], [False]

    def child(self, parent: int, tag: str, names: str) -> int:
        key = (parent, tag, names)
        at = self.known.get(key)
        if at is not None:
            return at
        at = self.known[key] = len(self.parent)
        inline = tag in _INLINE
        self.parent.append(parent)
        self.tag.append(tag)
        self.block.append(self.block[parent] if inline else at)
        self.box.append(self.box[parent] if inline or tag in _LEAF else at)
        self.main.append(self.main[parent] if self.main[parent] >= 0 or tag not in ("article", "main") else at)
        self.depth.append(self.depth[parent] + 1)
        self.never.append(self.never[parent] or tag in _NEVER)
        signs = [n for n in names.split() if _SIGN.fullmatch(n)] if tag not in _WHOLE else []
        signed = bool(signs)
        self.layout.append(all(_LAYOUT.fullmatch(n) for n in signs) and (self.sign[parent] < 0 or self.layout[parent]))
        self.sign.append(at if self.sign[parent] < 0 and signed else self.sign[parent])
        self.linked.append(self.linked[parent] or tag == "a")
        return at


def _tag_end(page: str, at: int) -> int:
    """Place after the tag that begins before ``at``; quoted parts may hold >. -1 if the page ends first."""
    while True:
        stop = _STOP.search(page, at)
        if stop is None:
            return -1
        if stop.group() == ">":
            return stop.end()
        close = page.find(stop.group(), stop.end())
        at = stop.end() if close < 0 else close + 1


def nodes(page: str) -> tuple[_Paths, list[tuple[int, int, str]]]:
    """The page's paths, and (path, block number, decoded text) of each text node."""
    paths, out = _Paths(), []
    stack: list[tuple[str, int]] = []
    open_at: dict[str, list[int]] = defaultdict(list)
    bounds: list[int] = []
    block, at, here = 0, 0, 0

    def cut(depth: int) -> None:
        nonlocal here
        while len(stack) > depth:
            name, _ = stack.pop()
            open_at[name].pop()
            if name in _BOUND:
                bounds.pop()
        here = stack[-1][1] if stack else 0

    while at < len(page):
        less = page.find("<", at)
        if less != at:
            less = len(page) if less < 0 else less
            out.append((here, block, entities.unescape(page[at:less])))
            at = less
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            out.append((here, block, page[at + 9 : len(page) if end < 0 else end]))
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
            continue
        found = _NAME.match(page, at + 1)
        end = _tag_end(page, found.end()) if found else -1
        if end < 0:
            # A sign, or an unfinished tag at the end of the page: text.
            stop = at + 1 if found is None else len(page)
            out.append((here, block, entities.unescape(page[at:stop])))
            at = stop
            continue
        name, closing = found.group(1).lower(), page[at + 1] == "/"
        inner, at = page[found.end() : end - 1], end
        if name == "br":
            out.append((here, block, " "))
        elif name not in _INLINE:
            block += 1
        if closing:
            if open_at[name]:
                last = open_at[name][-1]
                # An end tag of an inner element doesn't reach across its container.
                if name in _BOUND or not bounds or bounds[-1] <= last:
                    cut(last)
            continue
        bound = bounds[-1] if bounds else -1
        if name in _CLOSES_P and open_at["p"] and open_at["p"][-1] > bound:
            cut(open_at["p"][-1])
        if name in _CLOSES_SAME and open_at[name] and open_at[name][-1] >= bound:
            cut(open_at[name][-1])
        if name in _RAW:
            # What stands in a raw element isn't markup, only its own end tag is looked for.
            stop = _RAW_END[name].search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if name in _VOID or inner.endswith("/"):
            continue
        names = " ".join(x for m in _NAMES.finditer(inner) for x in m.groups() if x) if "=" in inner else ""
        here = paths.child(here, name, names)
        open_at[name].append(len(stack))
        if name in _BOUND:
            bounds.append(len(stack))
        stack.append((name, here))
    return paths, out


def path_ratios(paths: _Paths, found: list[tuple[int, int, str]]) -> dict[int, float]:
    """The smoothed and fused ratio of each block path that may be content."""
    length, marks, linked, signed = (defaultdict(int) for _ in range(4))
    for path, _, text in found:
        if not paths.never[path] and (n := len(text.strip())):
            own = paths.block[path]
            length[own] += n
            marks[own] += len(_PUNCTUATION.findall(text))
            linked[own] += n * paths.linked[path]
    total = sum(n for p, n in length.items() if paths.sign[p] < 0 or paths.layout[p])
    for own, n in length.items():
        if paths.sign[own] >= 0:
            signed[paths.sign[own]] += n
    plain = all(m < 0 for m in paths.main)
    length = {p: n for p, n in length.items() if paths.sign[p] < 0 or plain and paths.layout[p] and 2 * signed[paths.sign[p]] > total}
    ratio = {p: (n - linked[p]) * (1 + min(1.0, 10 * marks[p] / n)) for p, n in length.items()}
    whole: dict[int, float] = defaultdict(float)
    for p, value in ratio.items():
        whole[paths.box[p]] += value
    # Inside an article or main element sums go on upwards, deepest elements first, and shares come back down.
    inside = {p for p in ratio if paths.main[p] >= 0}
    chain: set[int] = set()
    for p in inside:
        box = paths.box[p]
        while box not in chain:
            chain.add(box)
            if box == paths.main[p]:
                break
            box = paths.parent[box]
    for box in sorted(chain, key=lambda b: -paths.depth[b]):
        if box != paths.main[box]:
            whole[paths.parent[box]] += whole[box]
    shared: dict[int, float] = {}
    for box in sorted(chain, key=lambda b: paths.depth[b]):
        up = shared.get(paths.parent[box], 0.0) if box != paths.main[box] else 0.0
        shared[box] = max(whole[box], DECAY * up)
    return {p: MAIN * max((v + whole[paths.box[p]]) / 2, shared[paths.box[p]]) if p in inside else (v + whole[paths.box[p]]) / 2 for p, v in ratio.items()}


def extract(page: str | None) -> str:
    """Blocks of the content paths in page order, one per line."""
    paths, found = nodes(page or "")
    fused = path_ratios(paths, found)
    if not fused:
        return ""
    least = SHARE * max(fused.values())
    content = {p for p, v in fused.items() if v >= least}
    blocks: dict[int, list[str]] = {}
    for path, block, text in found:
        if paths.block[path] in content and not paths.never[path]:
            blocks.setdefault(block, []).append(text)
    lines = (_SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
