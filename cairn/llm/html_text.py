"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element, with an empty line for every container that begins
or ends between two of them. A line weighs as many characters as stand outside of links; lines of elements
that hold no article (scripts, menus, forms, adverts and the like) and, where a page has an article or main
element, lines outside of it weigh nothing. Weights summed over sliding windows show where text surges, where
a sum reaches a threshold taken from the page's own distribution, and where it dives, where a sum falls under it.
Lines between a surge and its dive are the text; with them stay short lines of text beside them in the same element.
"""

from __future__ import annotations

import html
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import small

#: Elements by their part in a page.
DROPPED = frozenset("head script style noscript template iframe svg math canvas object audio video select textarea button".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
TEXTUAL = frozenset(HEADINGS) | frozenset("p blockquote pre li dt dd td th caption figcaption summary address center".split())
CONTAINERS = frozenset("article body div dl fieldset figure header hgroup main ol section table ul details html tbody thead tfoot tr".split())
BLOCKS = TEXTUAL | CONTAINERS | BOILERPLATE | DROPPED | {"hr", "legend"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style iframe textarea noscript xmp noembed".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
#: Elements that end where the next one of a kind begins, and the elements that this doesn't reach out of.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",), "a": ("a",)}
SCOPES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "option": ("select",), "a": ("table", "td", "th")}
GROUPS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "td": ("table",), "th": ("table",)}
#: Names in class or id that mark what isn't an article, names that may stand beside them in a hyphenated one, and roles.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
BESIDE = frozenset("a article articles banner bar block bottom box buttons container content form global header inner item items left link links list main news outer page panel post posts primary right secondary section site slot top unit wrap wrapper".split())
#: Names in class or id of an element that holds an article as a whole.
HOLDING = frozenset("article article-body article-content articlebody content entry entry-content hentry main main-content page-content post post-body post-content story story-body".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Stands for elements that hold an article among the names of open elements.
HELD = "#"
#: Most characters that a surge asks for, and its share of the window sum that half of a page's text reaches.
SURGE_CHARS, SURGE_SHARE = 100, 0.25

_NAME = regex.compile(r"[a-zA-Z][^\s/>]*+")
_STOP = regex.compile(r">|=\s*+[\"']")
_MARK = regex.compile(r"(?<![^\s\"'])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", regex.I)
_PART = regex.compile(r"[^a-z0-9]+")
_SPACE = regex.compile(r"\s+")
_END_OF = {name: regex.compile(rf"</{name}(?=[\s/>])", regex.I) for name in RAW}


@dataclass
class Line:
    """One block's text. weight: its characters outside of links; off: in an element that holds no article; inside: in an
    article element. article: the innermost one of these, or one whose name says that it holds an article, or 0. tag: the element that holds it ("" for text beside elements); parent: the element that this is
    in, for an entry that of its list or table; gap: containers that begin or end between it and the line before; shared: the
    innermost element that holds both of these, and at which depth."""

    text: str
    weight: int
    off: bool
    inside: bool
    article: int
    tag: str
    parent: int
    gap: int
    shared: tuple[int, int]


def holding(attributes: str) -> bool:
    """Whether class or id say that an element holds an article."""
    return "=" in attributes and any(m[1].lower() != "role" and HOLDING.intersection((m[2] or m[3] or m[4] or "").lower().split()) for m in _MARK.finditer(attributes))


def marked(attributes: str) -> bool:
    """Whether class, id or role say that an element is no article.

    A name does if it is one of MARKS; a hyphenated one if all its parts are of MARKS or BESIDE and one of MARKS is among
    them: "related-posts" does, "related-work" and "ad-hoc" don't.
    """
    for m in _MARK.finditer(attributes) if "=" in attributes else ():
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            if m[1].lower() == "role":
                if name in ROLES:
                    return True
            elif name in MARKS:
                return True
            elif len(parts := [p for p in _PART.split(name) if p]) > 1 and MARKS.intersection(parts) and MARKS.union(BESIDE).issuperset(parts):
                return True
    return False


def tags(page: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(begin, end, lower-case name, attributes, whether it closes) of each tag; comments and the content of RAW elements are
    part of a tag without a name. Each character is looked at a bounded number of times, also where nothing is ever closed."""
    at, n = 0, len(page)
    unclosed: set[str] = set()
    while (begin := page.find("<", at)) >= 0:
        first = page[begin + 1 : begin + 2]
        if first in ("!", "?"):
            stop = "-->" if page.startswith("<!--", begin) else ">"
            end = page.find(stop, begin + 2)
            at = n if end < 0 else end + len(stop)
            yield begin, at, "", "", False
            continue
        closes = first == "/"
        m = _NAME.match(page, begin + 1 + closes)
        if m is None:
            at = begin + 1
            continue
        end = m.end()
        while (stop := _STOP.search(page, end)) and stop[0] != ">":
            quote, end = stop[0][-1], stop.end()
            if quote not in unclosed:
                other = page.find(quote, end)
                if other < 0:
                    unclosed.add(quote)
                else:
                    end = other + 1
        if stop is None:
            # the page ends inside a tag
            yield begin, n, "", "", False
            return
        at, name = stop.end(), m[0].lower()
        yield begin, at, name, page[m.end() : stop.start()], closes
        if name in RAW and not closes:
            ended = _END_OF[name].search(page, at)
            end = n if ended is None else ended.start()
            yield at, end, "", "", False
            at = end


class Tree:
    """The open elements of a page while its tags go by, each with a number and whether it empties its lines."""

    def __init__(self):
        self.open: list[tuple[str, int, bool]] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        #: Of each numbered element, its parent and its name; 0 is outside of all.
        self.parents, self.names = [0], [""]
        self.off = self.low = self.gap = 0

    def last(self, *names: str) -> int:
        return max((self.at[n][-1] for n in names if self.at[n]), default=-1)

    def push(self, name: str, drops: bool, holds: bool = False) -> None:
        # only blocks have numbers of their own
        number = self.open[-1][1] if self.open else 0
        if name in BLOCKS:
            self.parents.append(number)
            self.names.append(name)
            number = len(self.parents) - 1
            self.gap += name in CONTAINERS
        self.at[name].append(len(self.open))
        if holds:
            self.at[HELD].append(len(self.open))
        self.open.append((name, number, drops))
        self.off += drops

    def cut(self, size: int) -> None:
        while len(self.open) > size:
            name, _, drops = self.open.pop()
            self.at[name].pop()
            if self.at[HELD] and self.at[HELD][-1] == len(self.open):
                self.at[HELD].pop()
            self.off -= drops
            self.gap += name in CONTAINERS
        self.low = min(self.low, size)

    def begins(self, name: str) -> None:
        """End what the beginning of an element ends."""
        if self.at["head"] and name not in IN_HEAD:
            self.cut(self.at["head"][-1])
        if name in BLOCKS and (p := self.last("p")) >= 0 and p > self.last("table", "td", "th", "button"):
            self.cut(p)
        if name in ENDED_BY and (i := self.last(*ENDED_BY[name])) > self.last(*SCOPES[name]):
            self.cut(i)

    def ends(self, name: str) -> None:
        if self.at[name]:
            self.cut(self.at[name][-1])

    def number(self, index: int) -> int:
        return self.open[index][1] if index >= 0 else 0


def lines(page: str) -> tuple[list[Line], list[int], list[str]]:
    """Blocks of a page in order, with character references decoded and white space runs as one space, and each element's parent and name."""
    out: list[Line] = []
    held: list[tuple[str, bool]] = []
    tree = Tree()

    def end() -> None:
        text = _SPACE.sub(" ", html.unescape("".join([t for t, _ in held]))).strip()
        if text:
            if any(link for _, link in held):
                weight = len(_SPACE.sub(" ", html.unescape(" ".join([t for t, link in held if not link]))).strip())
            else:
                weight = len(text)
            off = tree.off > 0
            own = tree.number(len(tree.open) - 1)
            tag = tree.names[own]
            if tag in TEXTUAL:
                group = tree.last(*GROUPS[tag]) if tag in GROUPS else -1
                parent = tree.parents[tree.open[group][1] if group >= 0 else own]
            elif tag == "div":
                parent = tree.parents[own]
            else:
                tag, parent = "", own
            low = min(tree.low, len(tree.open))
            inside = tree.last("article", "main")
            article = tree.number(max(inside, tree.last(HELD)))
            out.append(Line(text, 0 if off else weight, off, inside >= 0, article, tag, parent, tree.gap, (low, tree.number(low - 1))))
            tree.low, tree.gap = len(tree.open), 0
        held.clear()

    at = 0
    for begin, stop, name, attributes, closes in tags(page):
        if begin > at:
            held.append((page[at:begin], bool(tree.at["a"])))
        at = stop
        if not name:
            continue
        if name == "br":
            held.append(("\n", False))
        if name in BLOCKS:
            end()
        if closes:
            if name not in BLOCKS and tree.at[name] and tree.open[tree.at[name][-1]][2]:
                end()
            tree.ends(name)
        elif name not in VOID:
            tree.begins(name)
            drops = name in DROPPED or name in BOILERPLATE or (name == "header" and tree.last("article", "main") < 0) or (name not in ("html", "body", "main") and marked(attributes))
            if drops and name not in BLOCKS:
                end()
            tree.push(name, drops, name in CONTAINERS and name not in ("html", "body") and holding(attributes))
    held.append((page[at:], bool(tree.at["a"])))
    end()
    return out, tree.parents, tree.names


def threshold(sums: list[int]) -> float:
    """What a surge asks for: a share of the window sum that half of the text reaches, SURGE_CHARS at most."""
    half, rest = sum(sums) / 2, 0
    for s in sorted(sums):
        rest += s
        if rest >= half:
            return max(1.0, min(SURGE_CHARS, SURGE_SHARE * s))
    return 1.0


def surges(weights: list[int], window: int) -> list[tuple[int, int]]:
    """Stretches [begin, end) between a surge and its dive. The sum of a window is that of `window` lines from its place on."""
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    if not any(sums):
        return []
    least = threshold(sums)
    out, begin = [], None
    for i, s in enumerate([*sums, 0]):
        if s >= least and begin is None:
            begin = i
        elif s < least and begin is not None:
            out.append((begin, i))
            begin = None
    return out


def main_text(page: str | None, window: int = 3) -> str:
    """The article's blocks in order, joined by newlines: lines between a surge of text and its dive, and with them
    lines with text outside of links, and headings, that stand in an element which holds such lines.

    That is the one that a line stands in, the innermost that two lines in a row share, or an article element or one named as holding
    an article around a line. In it count paragraphs,
    headings, entries and cells at any depth, and elements of the kind found; directly in `body`, paragraphs and headings
    only. If no line has text outside of links, links count as text.
    """
    found, parents, names = lines(page or "")
    inside = any(x.inside and x.weight for x in found)
    open_to = [not x.off and (x.inside or not inside) for x in found]
    weights = [x.weight if ok else 0 for x, ok in zip(found, open_to)]
    if not any(weights):
        weights = [len(x.text) if ok else 0 for x, ok in zip(found, open_to)]
    slots, place = [], []
    for x, w in zip(found, weights):
        slots += [0] * min(x.gap, window)
        place.append(len(slots))
        slots.append(w)
    core = [False] * len(found)
    for begin, end in surges(slots, window):
        rising = True
        for i in range(bisect_left(place, begin), bisect_left(place, end)):
            rising = rising and not weights[i] and found[i].tag not in HEADINGS
            core[i] = open_to[i] and not rising
    kept = completed(found, core, open_to, weights, parents, names)
    return "\n".join(x.text for x, keep in zip(found, kept) if keep)


def completed(found: list[Line], core: list[bool], open_to: list[bool], weights: list[int], parents: list[int], names: list[str]) -> list[bool]:
    """The lines of `core`, and those that main_text() keeps with them."""
    kinds = {(x.tag, x.parent) for x, ok in zip(found, core) if ok}
    holders = {parent for _, parent in kinds} | {x.article for x, ok in zip(found, core) if ok and x.article}
    shared, begun = None, False
    for x, ok in zip(found, core):
        shared = x.shared if shared is None else min(shared, x.shared)
        if ok:
            if begun:
                holders.add(shared[1])
            shared, begun = None, True
    # outermost elements hold everything, which says nothing of what stands deeper in them
    outer = {n for n in holders if names[n] in ("", "html", "body")}
    within = [False] * len(parents)
    for n, parent in enumerate(parents):
        within[n] = n not in outer and (n in holders or within[parent])
    out = []
    for x, ok, opened, w in zip(found, core, open_to, weights):
        if not ok and opened and (w or x.tag in HEADINGS):
            if within[x.parent]:
                ok = x.tag in TEXTUAL or (x.parent in holders and x.tag == "") or (x.tag, x.parent) in kinds
            else:
                ok = x.parent in outer and x.tag in ("", "p", "blockquote", "pre", *HEADINGS)
        out.append(ok)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html), in one pass without a shuffle.

    Null and empty pages and pages without text give an empty text. Repeated rows, null ids and null urls are kept as
    they are; other columns are ignored. One page is held at a time, and what it costs grows with its length, also where
    nothing is ever closed.
    """

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(arrow, "html"):
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
