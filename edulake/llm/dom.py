"""Block trees of HTML pages, and their alignment with the tree of a site by simple tree matching.

Only block-level elements are nodes; inline elements are part of their block's text.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg head select button".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr "
    "ul caption center".split()
)
#: Elements that never hold main text, unless the article stands inside them.
ASIDE = frozenset("nav footer aside menu dialog search".split())
MAIN = frozenset(("article", "main"))
#: Containers whose class, id or role may mark them; not the page, the article, or single paragraphs and headings.
MARKED = frozenset("div section ul ol dl table details fieldset center address form header".split())
#: Classes, ids and roles, as whole words, of menus, notices, adverts, side matter and readers' comments.
MARKS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices "
    "popup promo related reply respond search share sharing sidebar skyscraper social sponsor sponsored subscribe "
    "toolbar widget".split()
)

_OPENING = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_SPECIAL = re.compile("[>\"']")
#: A tag that ends before the next ``<``, as nearly all do.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^<>\"]*+\"|'[^<>']*+')*+)>")
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: Children of one key are aligned only with those whose number among them, from either end, differs by so many at most.
BAND = 8
#: Deeper elements count as parts of the element at this depth, so alignment stays within the stack.
DEEPEST = 80

#: Open elements that a new one ends, and what shields them.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}


class Node:
    __slots__ = ("tag", "key", "children", "aside", "marked", "main", "slot")

    def __init__(self, tag: str, key: str, aside: bool, marked: bool, main: bool):
        self.tag, self.key, self.aside, self.marked, self.main = tag, key, aside, marked, main
        self.children: list[Node] = []
        self.slot = ""


def _node(tag: str, attributes: str, parent: Node) -> Node:
    named, words = "", set()
    if "=" in attributes:
        for name, a, b, c in _NAMED.findall(attributes):
            value = (a or b or c).lower()
            own = _WORD.findall(value)
            words.update(value.split())
            if name.lower() != "role":
                named += "." + "-".join(own)
            elif "main" in own:
                return Node(tag, tag + named, False, False, True)
    main = parent.main or tag in MAIN
    # A form may wrap the whole page, as a marked container may.
    marked = tag == "form" or (tag in MARKED and not words.isdisjoint(MARKS))
    return Node(tag, tag + named, tag in ASIDE or (tag == "header" and not parent.main), marked, main)


def _inherit(root: Node) -> None:
    """Hand ``aside`` and ``marked`` down, but from elements that hold the page's first article."""
    path: list[Node] = []

    def find(node: Node) -> bool:
        if node.main:
            path.append(node)
            return True
        if any(map(find, node.children)):
            path.append(node)
            return True
        return False

    find(root)
    for node in path:
        node.aside = node.marked = False
    waiting = [root]
    while waiting:
        node = waiting.pop()
        for child in node.children:
            child.aside, child.marked = child.aside or node.aside, child.marked or node.marked
        waiting += node.children


class _Tags:
    """The tags of a page in order, found in time linear in its length, whatever is left open.

    A tag ends at the first ``>`` outside of quotes, or at the first one at all if a quote is not closed or no such
    ``>`` follows. Where the search from an opening quote ends is remembered, as the searches of several tags run into
    the same quotes; and what is absent from a place on is not looked for again behind it.
    """

    def __init__(self, page: str):
        self.page = page
        self.ends: dict[int, int] = {}
        self.next: dict[str, int] = {}
        self.special = -1

    def find(self, mark: str, at: int) -> int:
        """The next place of ``mark`` from ``at`` on, or -1. Places asked for never go back."""
        known = self.next.get(mark, -2)
        if known == -2 or -1 < known < at:
            known = self.next[mark] = self.page.find(mark, at)
        return known

    def _next_special(self, at: int) -> int:
        found = _SPECIAL.search(self.page, at)
        return found.start() if found else len(self.page)

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose attributes begin at ``at``, or -1."""
        if self.special < at:
            self.special = self._next_special(at)
        place, passed = self.special, []
        while True:
            if place == len(self.page):
                found = -1
            elif self.page[place] == ">":
                found = place
            elif place in self.ends:
                found = self.ends[place]
            else:
                passed.append(place)
                closing = self.page.find(self.page[place], place + 1)
                if closing >= 0:
                    place = self._next_special(closing + 1)
                    continue
                found = -1
            break
        for place in passed:
            self.ends[place] = found
        return found if found >= 0 else self.find(">", at)

    def __iter__(self) -> Iterator[tuple[int, int, bool, str | None, str]]:
        """Begin and end of each tag, whether it closes an element, its name (None for comments) and attributes.

        Send a place to go on from there.
        """
        page, at = self.page, 0
        while True:
            at = page.find("<", at)
            if at < 0:
                return
            plain = _PLAIN.match(page, at)
            if plain:
                found = (at, plain.end(), plain[1] != "", plain[2].lower(), plain[3])
            elif page.startswith("<!--", at):
                close = page.find("-->", at + 4)
                end = close + 3 if close >= 0 else len(page)
                found = (at, end, False, None, "")
            elif page.startswith(("<!", "<?"), at):
                close = self.find(">", at)
                if close < 0:
                    at += 1
                    continue
                found = (at, close + 1, False, None, "")
            else:
                begin = _OPENING.match(page, at)
                close = self.end(begin.end()) if begin else -1
                if close < 0:
                    at += 1
                    continue
                found = (at, close + 1, bool(begin.group(1)), begin.group(2).lower(), page[begin.end() : close])
            at = found[1]
            further = yield found
            at = at if further is None else further


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The block tree of a page, and its texts in order, each with the block that holds it."""
    root = Node("", "", False, False, False)
    stack, blocks, held = [root], [], []
    unended: set[str] = set()

    def flush() -> None:
        if not held:
            return
        text = "".join(held)
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        held.clear()
        if text:
            blocks.append((stack[-1], text))

    at, size = 0, len(page)
    tags = iter(_Tags(page))
    found = next(tags, None)
    while found is not None:
        begin, end, close, tag, attributes = found
        if begin > at:
            held.append(page[at:begin])
        at = end
        if tag in RAW and not close:
            ended = None if tag in unended else re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
            if ended:
                at = ended.end()
            else:
                unended.add(tag)
                if tag in ("script", "style"):
                    at = size
        elif tag == "br":
            held.append(" ")
        elif tag in BLOCK:
            flush()
            _nest(stack, tag, close, attributes)
        try:
            found = tags.send(at)
        except StopIteration:
            found = None
    held.append(page[at:])
    flush()
    _inherit(root)
    return root, blocks


def _nest(stack: list[Node], tag: str, close: bool, attributes: str) -> None:
    """Close or open a block element."""
    if close:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag == tag:
                del stack[depth:]
                break
        return
    if stack[-1].tag == "p":
        stack.pop()
    if tag in _ENDS:
        ended_tags, shields = _ENDS[tag]
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in shields:
                break
            if stack[depth].tag in ended_tags:
                del stack[depth:]
                break
    node = _node(tag, attributes, stack[-1])
    if tag in VOID or len(stack) > DEEPEST:
        return
    stack[-1].children.append(node)
    stack.append(node)


def runs(children: list[Node]) -> list[list[Node]]:
    """Siblings in runs of one key: the items of a list, the paragraphs of an article."""
    found: list[list[Node]] = []
    for child in children:
        if found and found[-1][0].key == child.key:
            found[-1].append(child)
        else:
            found.append([child])
    return found


def skeleton(root: Node) -> str:
    """The tree without texts, each run of siblings once, as JSON."""

    def shape(node: Node) -> list:
        return [node.key, [shape(run[0]) for run in runs(node.children)]]

    return json.dumps(shape(root), ensure_ascii=False)


def aligned(left: list[str], right: list[str], gain: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """Pairs of equal keys in the order of both lists with the greatest sum of ``gain``.

    Only pairs of equal keys are looked at, and of a key that repeats those in a band (``BAND``), so the work follows the
    lists' lengths: the best sum that ends before a place comes from a tree of prefix maxima.
    """
    if not left or not right:
        return []
    if left == right and len(set(left)) == len(left):
        return [(i, i) for i in range(len(left))]
    places: dict[str, list[int]] = defaultdict(list)
    for j, key in enumerate(right):
        places[key].append(j)
    totals = Counter(key for key in left if key in places)
    seen: Counter = Counter()
    size = len(right)
    # Per node of the tree the best sum and its last pair; pairs as (i, j, the pair before).
    best: list[tuple[int, int]] = [(0, -1)] * (size + 1)
    pairs: list[tuple[int, int, int]] = []
    for i, key in enumerate(left):
        if key not in places:
            continue
        own, number = places[key], seen[key]
        seen[key] += 1
        near = set()
        for middle in (number, len(own) - totals[key] + number):
            near.update(range(max(0, middle - BAND), min(len(own), middle + BAND + 1)))
        new = []
        for k in near:
            j, top = own[k], (0, -1)
            at = j
            while at > 0:
                if best[at][0] > top[0]:
                    top = best[at]
                at -= at & -at
            new.append((j, top[0] + gain(i, j), top[1]))
        for j, total, before in new:
            pairs.append((i, j, before))
            entry, at = (total, len(pairs) - 1), j + 1
            while at <= size:
                if best[at][0] < total:
                    best[at] = entry
                at += at & -at
    top, at = (0, -1), size
    while at > 0:
        if best[at][0] > top[0]:
            top = best[at]
        at -= at & -at
    found, last = [], top[1]
    while last >= 0:
        i, j, last = pairs[last]
        found.append((i, j))
    return found[::-1]


class Template:
    """The tree of a site: a skeleton with numbered nodes."""

    def __init__(self, text: str):
        numbers = iter(range(1 << 30))

        def build(own: list) -> dict:
            number = next(numbers)
            return {"key": own[0], "slot": str(number), "children": [build(x) for x in own[1]]}

        self.root = build(json.loads(text))

    def align(self, root: Node) -> None:
        """Give every node of a page the slot of the template node it matches.

        Simple tree matching: nodes of one key match, and their children in order so that most nodes match. A node
        without a match takes a slot named after its path below the last match.
        """
        known: dict[tuple[int, int], int] = {}

        def partners(groups: list[list[Node]], own: dict) -> list[tuple[int, int]]:
            right = own["children"]
            return aligned(
                [run[0].key for run in groups], [x["key"] for x in right], lambda i, j: matched(groups[i][0], right[j])
            )

        def matched(node: Node, own: dict) -> int:
            """Pairs of nodes in the best match of two nodes of one key."""
            at = (id(node), id(own))
            if at not in known:
                groups = runs(node.children)
                known[at] = 1 + sum(matched(groups[i][0], own["children"][j]) for i, j in partners(groups, own))
            return known[at]

        def place(node: Node, own: dict) -> None:
            node.slot = own["slot"]
            groups = runs(node.children)
            partner = {i: own["children"][j] for i, j in partners(groups, own)}
            for k, run in enumerate(groups):
                for child in run:
                    if k in partner:
                        place(child, partner[k])
                    else:
                        stray(child, node.slot)

        def stray(node: Node, above: str) -> None:
            node.slot = f"{above}/{node.key}"
            for child in node.children:
                stray(child, node.slot)

        place(root, self.root)
