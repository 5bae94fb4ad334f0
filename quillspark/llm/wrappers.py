"""Union-free regular expressions over block tags: folding a page's tokens, aligning two expressions, naming slots.

An expression is a list of items. A plain item is a block tag or T, the place of a text; a group is a list of items
that repeats. Any item may be optional. Written down, items stand between blanks, groups are "( ... )+", and a ? marks
what is optional.
"""

import html
import re
from functools import lru_cache

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=[a-zA-Z/])[^<]*$|[^<]+|<", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# What HTML elements and usual names of page parts mean.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("head iframe noscript object script style svg template textarea title".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("aside button datalist dialog fieldset footer form input label menu nav select".split())
INSIDE = frozenset("article main".split())
OUTSIDE_NAMES = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|alert|banner|breadcrumbs?|comments?|consent|cookies?|footer|header|login|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|popup|promo\w*|related|remark\w*|repl(?:y|ies)|search|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|tags?|widget)(?=$|[\s_-])", re.I)
INSIDE_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|entry|main|post|story)(?=$|[\s_-])", re.I)

OWN_INSIDE, OWN_REST = -2, -3  #: a T that no slot of the host's wrapper is, in an article element of its own page, or elsewhere outside menus and the like
LONGEST = 12  #: items of a repeated group as it is first found


def page_blocks(page: str) -> tuple[list[str], list[str], list[int]]:
    """(items, text of each T, characters of links in it). Text of one block is one T, white space in it one blank."""
    items: list[str] = []
    texts: list[str] = []
    links: list[int] = []
    now: list[str] = []
    in_link, link_chars, at, size, in_p = 0, 0, 0, len(page), False

    def close() -> None:
        nonlocal link_chars
        text = " ".join(html.unescape("".join(now)).split())
        if text:
            items.append("T")
            texts.append(text)
            links.append(min(len(text), link_chars))
        now.clear()
        link_chars = 0

    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if not tag:
            if page[m.start()] != "<" or m.end() - m.start() == 1:  # text, not a comment or the like
                now.append(m[0])
                link_chars += len(m[0]) if in_link else 0
            continue
        tag, end = tag.lower(), bool(m[1])
        if tag in HIDDEN:
            if not end and not m[3].endswith("/"):
                at = _hidden_end(page, at, tag)
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = max(0, in_link + (-1 if end else 1))
            elif tag == "br":
                now.append(" ")
            continue
        close()
        in_link = 0
        if in_p:  # the next block ends a paragraph, with or without its end tag
            items.append("/p")
        in_p = tag == "p" and not end
        if end:
            if tag != "p":
                items.append(f"/{tag}")
        else:
            names = " ".join(filter(None, (x for n in _NAMES.finditer(m[3]) for x in n.groups()))) if m[3] else ""
            items.append(tag + ("!" if OUTSIDE_NAMES.search(names) else "*" if INSIDE_NAMES.search(names) else ""))
    close()
    return items + ["/p"] * in_p, texts, links


def _hidden_end(page: str, at: int, tag: str) -> int:
    """Where an element ends whose content isn't shown. Without an end tag: a head ends at the body, a script and the like at the page's end, anything else at once."""
    found = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
    if found:
        return found.end()
    body = re.compile("<body", re.I).search(page, at) if tag == "head" else None
    return body.start() if body else len(page) if tag in RAW else at


class Item:
    """name: tag or T; body: items of a repeated group; slots: the T of the source that it stands for."""

    __slots__ = ("body", "key", "name", "optional", "slots")

    def __init__(self, name: str = "", body: list["Item"] | None = None, optional: bool = False, slots: tuple[int, ...] = ()):
        self.name, self.body, self.optional, self.slots = name, body, optional, slots
        self.key = name if body is None else "( " + " ".join(x.key for x in body) + " )+"

    def text(self) -> str:
        return (self.name if self.body is None else "( " + " ".join(x.text() for x in self.body) + " )+") + "?" * self.optional


def write(items: list[Item]) -> str:
    return " ".join(x.text() for x in items)


def read(text: str) -> list[Item]:
    """Items of a written expression; every T gets its number as slot."""
    stack: list[list[Item]] = [[]]
    slot = 0
    for word in text.split():
        optional, word = word.endswith("?"), word.removesuffix("?")
        if word == "(":
            stack.append([])
        elif word == ")+":
            body = stack.pop()
            stack[-1].append(Item(body=body, optional=optional))
        else:
            stack[-1].append(Item(word, optional=optional, slots=(slot,) if word == "T" else ()))
            slot += word == "T"
    return stack[0]


def absorb(one: Item, other: Item) -> Item:
    """The first with the second's slots; both have the same key."""
    if one.body is None:
        return Item(one.name, optional=one.optional or other.optional, slots=one.slots + other.slots)
    return Item(body=[absorb(x, y) for x, y in zip(one.body, other.body)], optional=one.optional or other.optional)


def fold(items: list[Item]) -> list[Item]:
    """Repeats next to each other become groups, again and again."""
    while True:
        keys, out, i, changed = [x.key for x in items], [], 0, False
        while i < len(items):
            for n in range(1, min(LONGEST, (len(items) - i) // 2) + 1):
                if keys[i] == keys[i + n] and keys[i : i + n] == keys[i + n : i + 2 * n]:
                    body, j = items[i : i + n], i + n
                    while keys[j : j + n] == keys[i : i + n] and j + n <= len(items):
                        body = [absorb(x, y) for x, y in zip(body, items[j : j + n])]
                        j += n
                    out.append(body[0] if n == 1 and body[0].body is not None else Item(body=body))
                    i, changed = j, True
                    break
            else:
                out.append(items[i])
                i += 1
        items = gather_groups(out)
        if not changed:
            return items


def gather_groups(items: list[Item], others: list[Item] = ()) -> list[Item]:
    """What stands once next to (or, for groups of other expressions, anywhere as) a group's body becomes that group."""
    for group in [x for x in [*items, *others] if x.body is not None]:
        keys, n, out, i = [x.key for x in group.body], len(group.body), [], 0
        foreign = not any(x.key == group.key for x in items)
        while i < len(items):
            run = items[i : i + n]
            near = foreign or (out and out[-1].key == group.key) or (i + n < len(items) and items[i + n].key == group.key)
            if near and [x.key for x in run] == keys:
                new, step = Item(body=run, optional=any(x.optional for x in run)), n
            else:
                new, step = items[i], 1
            if out and new.body is not None and out[-1].key == new.key:
                out[-1] = absorb(out[-1], new)
            else:
                out.append(new)
            i += step
        items = out
    return items


def merge(a: list[Item], b: list[Item]) -> list[Item]:
    """An expression for what either describes: aligned items stay, groups with one first item are merged inside, the rest is optional."""
    groups = lambda items: [x for x in items if x.body is not None]
    a, b = gather_groups(a, groups(b)), gather_groups(b, groups(a))
    out = []
    for x, y in align(a, b):
        if x and y:
            same = x.body is None or x.key == y.key
            new = absorb(x, y) if same else Item(body=fold(merge(x.body, y.body)))
            new.optional = x.optional or y.optional
            out.append(new)
        else:
            one = x or y
            out.append(Item(one.name, one.body, True, one.slots))
    return fold(out)


def align(a: list[Item], b: list[Item]) -> list[tuple[Item | None, Item | None]]:
    """Items of both in order, with the most weight matched: T 1, tags 2, groups 3."""
    n, m = len(a), len(b)

    def fit(x: Item, y: Item) -> int:
        if (x.body is None) != (y.body is None):
            return 0
        if x.body is None:
            return (1 if x.name == "T" else 2) if x.name == y.name else 0
        return 4 if x.key == y.key else 3 if x.body[0].key == y.body[0].key else 0

    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            w = fit(a[i], b[j])
            row[j] = max(below[j], row[j + 1], w and w + below[j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        w = fit(a[i], b[j]) if i < n and j < m else 0
        if w and best[i][j] == w + best[i + 1][j + 1]:
            out.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif i < n and (j == m or best[i][j] == best[i + 1][j]):
            out.append((a[i], None))
            i += 1
        else:
            out.append((None, b[j]))
            j += 1
    return out


@lru_cache(100_000)
def skeleton(flat: str) -> tuple[str, tuple[int, ...]]:
    """(folded expression, for each T of the page the number of its T there). flat: a page's items between blanks."""
    slot, items = 0, []
    for name in flat.split():
        items.append(Item(name, slots=(slot,) if name == "T" else ()))
        slot += name == "T"
    folded = fold(items)
    place, number = [0] * slot, 0

    def visit(items: list[Item]) -> None:
        nonlocal number
        for x in items:
            if x.body is not None:
                visit(x.body)
            elif x.name == "T":
                for s in x.slots:
                    place[s] = number
                number += 1

    visit(folded)
    return write(folded), tuple(place)


def infer(expressions: list[str]) -> str:
    """One wrapper for all expressions, aligned one after another, the longest first."""
    order = sorted(set(expressions), key=lambda x: (-len(x), x))
    out = read(order[0])
    for x in order[1:]:
        out = merge(out, read(x))
    return write(out)


@lru_cache(20_000)
def slots(expression: str, wrapper: str) -> tuple[int, ...]:
    """For each T of the expression the number of the wrapper's T that it is.

    What stands once where the wrapper has a group is aligned inside the group, item by item, as often as some of it fits.
    A T that fits nowhere gets OWN_INSIDE, OWN_REST or -1, by the part of its own page that it is in.
    """
    out = [-1] * expression.split().count("T")

    def visit(a: list[Item], b: list[Item]) -> None:
        left: list[Item] = []  # of the expression, since the last items that fit
        groups: list[Item] = []  # of the wrapper, since then
        for x, y in [*align(gather_groups(a, [z for z in b if z.body is not None]), b), (None, None)]:
            if x and not y:
                left.append(x)
            elif y and not x:
                groups += [y] * (y.body is not None)
            else:
                inside(left, groups)
                left, groups = [], []
                if x and x.body is not None:
                    visit(x.body, y.body)
                elif x:
                    for s in x.slots:
                        out[s] = y.slots[0]

    def inside(run: list[Item], groups: list[Item]) -> None:
        for group in groups:
            while run:
                pairs = [(x, y) for x, y in align(run, group.body) if x]
                own = {id(x) for x, y in pairs if y}
                if all(x.name == "T" for x, y in pairs if y):  # a text alone fits anywhere
                    # A group inside the run may still hold what the group's body holds.
                    for x in run:
                        if x.body is not None and any(out[s] == -1 for s in _slots_of(x)):
                            visit(x.body, group.body)
                    break
                visit([x for x in run if id(x) in own], group.body)
                run = [x for x in run if id(x) not in own]

    visit(read(expression), read(wrapper))
    if -1 in out:
        own = {1: OWN_INSIDE, 0: OWN_REST, -1: -1}
        out = [own[zone] if s == -1 else s for s, zone in zip(out, slot_zones(expression))]
    return tuple(out)


def _slots_of(item: Item) -> tuple[int, ...]:
    return item.slots if item.body is None else tuple(s for x in item.body for s in _slots_of(x))


def slot_zones(expression: str) -> list[int]:
    """For each T: -1 in a part that is never the article, 1 in an article element, 0 elsewhere."""
    stack: list[str] = []
    out = []
    for word in expression.split():
        word = word.rstrip("?")
        if word in ("(", ")+"):
            continue
        if word == "T":
            inner = max((k for k, x in enumerate(stack) if x.rstrip("!*") in INSIDE or x.endswith("*")), default=-1)
            bad = any(x.rstrip("!*") in OUTSIDE or x.endswith("!") or (x == "header" and inner < 0) for x in stack)
            out.append(-1 if bad else int(inner >= 0))
        elif word[0] == "/":
            names = [x.rstrip("!*") for x in stack]
            if word[1:] in names:
                del stack[len(names) - 1 - names[::-1].index(word[1:]) :]
        elif word.rstrip("!*") not in VOID:
            if word == "p" and stack and stack[-1] == "p":
                stack.pop()
            stack.append(word)
    return out
