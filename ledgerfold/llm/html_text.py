"""Main text of web pages by tree scoring.

A page becomes a tree of elements and text blocks, in one pass that never looks
back, so that broken markup costs no more than other text. Elements that are
never article text (by tag, role or hidden) are left out, menus, headers, asides and
forms unless the article stands in them; for their class or id
only if the article isn't in them, and, where such a word is but a part of the name
(`share-price`), only if they don't read as text. Each block passes points for its
length and commas to its ancestors, halved at each level; an ancestor's points
are discounted by the share of its text that stands in links. The best container
is kept, with what reads like text beside it and beside the elements around it,
up to the article's own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import tidy

#: Elements of the HTML language by their part in a page.
NEVER = set("script style noscript template head title footer button select textarea input iframe object svg canvas menu dialog audio video".split())
SOFT = set("nav header aside form".split())  # no article text, unless the article stands in them
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
ROLES = set("navigation banner contentinfo complementary search menu menubar dialog alert".split())
BOILERPLATE = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer header masthead comment comments disqus respond reply replies cookie cookies consent notice alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended widget toolbar pagination pager copyright legal".split()
)
READERS = set("comment comments disqus respond reply replies".split())  # may hold more text than the article
#: A name with a word of each speaks of what readers wrote.
WHOSE, SAID = set("user users customer customers reader readers guest guests visitor visitors".split()), set("review reviews opinion opinions feedback rating ratings".split())
#: Words that add nothing to a name: with these alone beside it, a word of BOILERPLATE names the whole element.
PLAIN = set("area bar block bottom box button buttons center column container content div group holder inner item items left link links list main outer page panel post posts right row section site slot stories text top unit wrap wrapper".split())
KEPT_TAGS = {"html", "body", "article", "main"}
ALONE = {"p", "#text", "blockquote", "pre", "ul", "ol", "table"}  # part of an article without a container
LONG = 80  # characters from which text reads as a paragraph wherever it stands

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)>")
_GAP = re.compile(r"[\s/]*")
_KEY = re.compile(r"[^\s=>/<\"']+")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_WORD = re.compile(r"[a-z]+")
_MODIFIER = re.compile(r"(?<![a-z])(?:has|no|with|without)[-_]\S*")
_HEADING = re.compile(r"h[1-6]$")


class _Node:
    __slots__ = ("tag", "parent", "children", "text", "out", "soft", "named", "partly", "points", "chars", "linked")

    def __init__(self, tag: str, parent: _Node | None, out: bool, named: frozenset[str] = frozenset(), partly: bool = False) -> None:
        self.tag, self.parent, self.out = tag, parent, out
        self.soft = tag in SOFT
        self.named = named  # words of its own class and id that speak against it
        self.partly = partly  # they are but parts of longer names
        self.children: list[_Node] = []
        self.text = ""  # of a block of text; elements have none of their own
        self.points, self.chars, self.linked = 0.0, 0, 0
        if parent is not None:
            parent.children.append(self)


def _judged(tag: str, found: dict[str, str]) -> tuple[bool, frozenset[str], bool]:
    """Whether an element is left out for its tag, role or style, the words of its class and id that speak against it, and whether they are but parts of names."""
    if tag in NEVER:
        return True, frozenset(), False
    if tag in KEPT_TAGS and tag != "article" or not found:
        return False, frozenset(), False
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True, frozenset(), False
    if tag in SOFT:
        return False, frozenset(), False
    names = _MODIFIER.sub(" ", f"{found.get('class', '')} {found.get('id', '')}".lower()).split()
    parts = [frozenset(_WORD.findall(n)) for n in names]
    parts = [x | {"comments"} if x & WHOSE and x & SAID else x for x in parts]
    against = BOILERPLATE.intersection(*[frozenset().union(*parts)])
    whole = any(x & BOILERPLATE and (x <= BOILERPLATE | PLAIN or x & READERS) for x in parts)
    return found.get("role", "").lower() in ROLES, against, bool(against) and not whole


class _Scanner:
    """Tags of a page from left to right; whatever is read is never read again."""

    def __init__(self, page: str) -> None:
        self.page, self.at = page, 0
        self.last = {q: page.rfind(q) for q in "\"'"}
        self.missing: set[str] = set()

    def next(self) -> tuple[str, bool, str, dict[str, str]] | None:
        """(text before it, whether it closes, name, attributes) of the next tag; without a name for comments, declarations and the page's end."""
        page, at, n = self.page, self.at, len(self.page)
        if at >= n:
            return None
        start = at
        while True:
            mark = page.find("<", at)
            if mark < 0:
                self.at = n
                return page[start:], False, "", {}
            plain = _PLAIN_TAG.match(page, mark)
            if plain:
                self.at = plain.end()
                return page[start:mark], bool(plain[1]), plain[2].lower(), {}
            ahead = page[mark + 1 : mark + 2]
            if ahead in ("!", "?") and ahead:
                end = page.find("-->", mark + 4) if page.startswith("<!--", mark) else page.find(">", mark)
                self.at = n if end < 0 else end + (3 if page.startswith("<!--", mark) else 1)
                return page[start:mark], False, "", {}
            closing = ahead == "/"
            name = _NAME.match(page, mark + 1 + closing)
            if name:
                self.at, found = self._attributes(name.end())
                return page[start:mark], closing, name[0].lower(), found
            at = mark + 1  # a mere character

    def _attributes(self, at: int) -> tuple[int, dict[str, str]]:
        """The attributes from `at` to the tag's end, or to the next tag's beginning if it has none."""
        page, n, found = self.page, len(self.page), {}
        while True:
            if page.startswith(">", at):
                return at + 1, found
            at = _GAP.match(page, at).end()
            if at >= n or page[at] == "<":
                return at, found
            if page[at] == ">":
                return at + 1, found
            key = _KEY.match(page, at)
            if key is None:  # a stray quote or equals sign
                at += 1
                continue
            at, value = key.end(), ""
            equals = _EQUALS.match(page, at)
            if equals:
                at = equals.end()
                quote = page[at : at + 1]
                if quote and quote in "\"'" and self.last[quote] > at:
                    end = page.index(quote, at + 1)
                    value, at = page[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(page, at)
                    value, at = bare[0], bare.end()
            found.setdefault(key[0].lower(), value)

    def skip_to(self, tag: str, past: bool) -> bool:
        """Go to (or past) the next end tag of that name, if there is one."""
        if tag not in self.missing:
            m = re.compile(rf"</{re.escape(tag)}(?![\w:-])[^>]*>?", re.I).search(self.page, self.at)
            if m:
                self.at = m.end() if past else m.start()
                return True
            self.missing.add(tag)
        return False


#: What an opening tag closes without being inside it.
_ENDS = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}


def _tree(page: str, by_name: bool) -> _Node:
    root = _Node("html", None, False)
    stack = [root]
    depth: dict[str, int] = {}  # open elements by tag, but the root
    inline: list[str] = []  # text of the block being read, and whether each part stands in a link
    links: list[bool] = []
    link = 0

    def end_block() -> None:
        if inline:
            text = " ".join(html.unescape("".join(inline)).split())
            if text:
                block = _Node("#text", stack[-1], stack[-1].out)
                block.text = text
                size = sum(map(len, inline)) or 1
                block.chars = len(text)
                block.linked = round(len(text) * sum(len(t) for t, in_link in zip(inline, links, strict=True) if in_link) / size)
            inline.clear()
            links.clear()

    def pop() -> str:
        tag = stack.pop().tag
        depth[tag] -= 1
        return tag

    scanner = _Scanner(page)
    while (step := scanner.next()) is not None:
        before, closing, tag, found = step
        if before:
            inline.append(before)
            links.append(link > 0)
        if not tag:  # a comment or declaration
            continue
        if tag in INLINE:
            link = max(0, link + (-1 if closing else 1)) if tag == "a" else link
            if tag == "br":
                inline.append(" ")
                links.append(link > 0)
            if closing or tag in VOID:
                continue
            out, named, partly = _judged(tag, found)
            if out or by_name and named and not partly:  # a hidden phrase
                link -= tag == "a" and link > 0
                scanner.skip_to(tag, past=True)
            continue
        end_block()
        link = 0
        if tag in VOID:
            continue
        if closing:
            if depth.get(tag):
                while pop() != tag:
                    pass
            continue
        if stack[-1].tag == "p" or stack[-1].tag in _ENDS.get(tag, ()):
            pop()
        if tag == "tr" and stack[-1].tag == "tr":
            pop()
        out, named, partly = _judged(tag, found)
        stack.append(_Node(tag, stack[-1], stack[-1].out or out, named if by_name else frozenset(), partly))
        depth[tag] = depth.get(tag, 0) + 1
        if tag in RAW and not scanner.skip_to(tag, past=False):
            break
    end_block()
    return root


def _walk(node: _Node) -> Iterator[_Node]:
    held = [node]
    while held:
        x = held.pop()
        yield x
        held.extend(reversed(x.children))


def _plain(x: _Node) -> bool:
    """Whether a block reads as a paragraph."""
    return not _HEADING.match(x.parent.tag) and x.linked < 0.3 * x.chars and (x.chars >= LONG or x.parent.tag in ("p", "blockquote", "pre"))


def _leave_out_soft(walk: list[_Node]) -> None:
    """Leave out menus, headers, asides and forms, but for those that the article stands in.

    A header within article or main is the article's own if it has a heading or a
    paragraph and isn't mostly links. Any other stays if it holds most of the
    page's paragraphs, or (but for an aside) an article or main with some: it
    wraps the page, or was never closed. Of such a one its link lists and short texts go.
    """
    if not any(x.soft for x in walk):
        return
    prose, heads, said, linked, holds = ({id(x): 0 for x in walk} for _ in range(5))
    for x in reversed(walk):
        i = id(x)
        if x.text and not x.out:
            said[i], linked[i], prose[i] = x.chars, x.linked, x.chars if _plain(x) else 0
        heads[i] += bool(_HEADING.match(x.tag))
        holds[i] += x.tag in ("article", "main") and prose[i] > 0
        if x.parent is not None:
            for of in (prose, heads, said, linked, holds):
                of[id(x.parent)] += of[i]
    total, never = prose[id(walk[0])], {id(x) for x in walk if x.out}
    inside: dict[int, bool] = {}
    wraps: set[int] = set()
    for x in walk:
        i, up = id(x), x.parent
        inside[i] = x.tag in ("article", "main") or up is not None and inside[id(up)]
        if up is not None and up.out:
            x.out = True
        elif up is not None and id(up) in wraps:
            x.out |= not _plain(x) if x.text else not (x.soft or prose[i] or heads[i]) and 2 * linked[i] >= said[i]
        if x.soft and not x.out:
            own = x.tag == "header" and inside[i] and (heads[i] or prose[i]) and 2 * linked[i] < said[i]
            if 2 * prose[i] > total or x.tag != "aside" and holds[i]:
                wraps.add(i)
            elif not own:
                x.out = True
    if total and not any(x.text and not x.out and _plain(x) for x in walk):  # none holds most of them: that with the most stays
        most = max((x for x in walk if x.soft and not x.parent.out), key=lambda x: prose[id(x)])
        back = {id(most)}
        most.out = False
        for x in walk:
            if id(x.parent) in back and not x.soft and id(x) not in never:
                back.add(id(x))
                x.out = False


def _leave_out_named(walk: list[_Node]) -> None:
    """Leave out elements for their class or id, but for those that hold the article.

    An element holds it with most of the page's text (what readers wrote aside;
    most by far if there is an article elsewhere), with the only article or main and
    a quarter of that text, or with an h1 within one of these. Its text is what stands in elements of it.
    """
    order = [x for x in walk if not x.out]
    if not any(x.named for x in order):
        return
    root = order[0]
    # of each element: text without links, its h1 and main, and its articles and mains that bear no such name
    text, heads, holders, theirs, within, said, prose = ({id(x): 0 for x in order} for _ in range(7))
    readers = {id(x) for x in order if x.named & READERS and (x.tag != "article" or "comment" in x.named)}
    for x in reversed(order):
        i = id(x)
        text[i] += x.chars - x.linked if x.text and not x.parent.named else 0
        said[i] += x.chars if x.text else 0
        prose[i] += x.chars if x.text and _plain(x) else 0
        heads[i] += x.tag in ("h1", "main")
        holders[i] += x.tag in ("article", "main") and not x.named
        if i in readers and heads[i]:
            readers.discard(i)
        theirs[i] = text[i] if i in readers else theirs[i]
        if x.parent is not None:
            up = id(x.parent)
            for of in (text, heads, holders, theirs, said, prose):
                of[up] += of[i]
    total = text[id(root)] - theirs[id(root)]
    for x in order:
        i = id(x)
        up = x.parent
        within[i] = 0 if up is None else within[id(up)] + (up.tag in ("article", "main") and not up.named)
        if up is not None and up.out:
            x.out = True
        elif x.named and x.partly and 0 < said[i] <= 2 * prose[i]:
            continue
        elif x.named:
            own = 0 if i in readers else text[i] - theirs[i]
            elsewhere = holders[id(root)] > holders[i] + within[i]
            most = 5 * own > 4 * total if elsewhere else 2 * own > total
            x.out = not (most or i not in readers and (holders[id(root)] == 1 == holders[i] and 4 * own >= total or heads[i] and within[i]))


def _score(walk: list[_Node], blocks: list[_Node]) -> None:
    """Points, characters and linked characters of every element, in one pass from the leaves up."""
    for b in blocks:
        # a paragraph's own element is no container
        paragraph = b.parent.parent is not None and (b.parent.tag in ("p", "li", "td", "blockquote", "pre") or _HEADING.match(b.parent.tag))
        (b.parent.parent if paragraph else b.parent).points += 1 + b.text.count(",") + min(b.chars / 100, 3)
    for x in reversed(walk):
        if x.parent is not None and not x.out:
            x.parent.chars += x.chars
            x.parent.linked += x.linked
            x.parent.points += x.points / 2


def main_text(page: str | None) -> str:
    """The page's article, a line for each block of text; empty if there is none."""
    walk = list(_walk(_tree(page or "", True)))
    _leave_out_soft(walk)
    before = [x for x in walk if x.text and not x.out]
    _leave_out_named(walk)
    blocks = [x for x in before if not x.out]
    if len(blocks) < len(before) and (not blocks or not any(map(_plain, blocks)) and any(map(_plain, before))) or not blocks:
        walk = list(_walk(_tree(page or "", False)))
        _leave_out_soft(walk)
        blocks = [x for x in walk if x.text and not x.out]
    _score(walk, blocks)
    if not blocks:
        return ""

    def score(x: _Node) -> float:
        return x.points * (1 - x.linked / x.chars) if x.chars else 0.0

    best = max((x for x in walk if x.points), key=score)
    kept = _article(best, 0.2 * score(best), score)
    lines, held = [], [walk[0]]
    while held:
        x = held.pop()
        if id(x) in kept:
            lines += [b.text for b in _walk(x) if b.text and not b.out]
        else:
            held.extend(reversed(x.children))
    return "\n".join(lines)


def _article(best: _Node, least: float, score: Callable[[_Node], float]) -> set[int]:
    """Ids of the elements that make up the article: the best container and what reads as text beside it and further up.

    Up to the enclosing article (or main), all that isn't mostly links belongs to
    it. Elsewhere it goes up while half of what stands beside reads as paragraphs.
    """
    kept = {id(best)}
    above = []
    x = best
    while x is not None:
        above.append(x)
        x = x.parent
    bound = next((i for tag in ("article", "main") for i, x in enumerate(above) if x.tag == tag), None)
    for i, x in enumerate(above[1:]):
        beside = [c for c in x.children if c is not above[i] and not c.out and c.chars]
        texts = [c for c in beside if c.linked < 0.3 * c.chars]
        if bound is None or i >= bound:  # not inside: headings, paragraphs and what scores like the best
            texts = [c for c in texts if c.tag in ALONE or c.tag == "header" or _HEADING.match(c.tag) or bound is None and _prose(c) or score(c) >= least]
        kept.update(map(id, texts))
        if bound is not None and i >= bound or bound is None and 2 * sum(c.chars for c in texts) < sum(c.chars for c in beside):
            break
    return kept


def _prose(x: _Node) -> bool:
    """Whether at least half of an element's text reads as paragraphs."""
    return 2 * sum(b.chars for b in _walk(x) if b.text and not b.out and _plain(b)) >= x.chars


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text, n_chars.

    A null or empty page, or one without text, has empty text. Pages of any length
    are read whole, in time that grows with it. Rows that repeat an id, or all
    columns, each get a row; null ids and urls stay null. Other columns are not read.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["id", "url", "text", "n_chars"],
            )

    picked = [F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")]
    return pages.select(*picked).mapInArrow(rows, f"id {kind}, url string, text string, n_chars long")
