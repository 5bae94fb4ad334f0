"""Full-text expressions: words, phrases, prefixes, NEAR, column filters, AND, OR, NOT; their matches with BM25 scores, and snippets.

An expression is parsed once on the driver. Each of its words gives an array of positions for each column of a row, from
the row's text or from the postings of a kept index; phrases, NEAR and the operators are then array functions and
conditions on these columns, so a match is one scan or one aggregation of postings, whatever the expression.
"""

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import ACCENTED, PLAIN, without_accents

# Constants of the ranking function, floor of a phrase's weight, tokens between phrases that are near, and
# what a snippet's words and a sentence's beginning count.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
NEAR_TOKENS = 10
NEW_PHRASE, AGAIN, SENTENCE, BEGINNING = 1000, 1, 100, 120

WORD = r"[\p{L}\p{N}]+"
_SIGNS = "(){}:+,*-^"


@dataclass(frozen=True)
class Phrase:
    """Consecutive words, each with whether it is a prefix. first: only at a column's beginning. columns: None for all."""

    words: tuple[tuple[str, bool], ...]
    first: bool = False
    columns: frozenset[str] | None = None


@dataclass(frozen=True)
class Near:
    """Phrases with at most `distance` tokens between them; one phrase stands for itself, none matches nothing."""

    phrases: tuple[Phrase, ...]
    distance: int = NEAR_TOKENS


@dataclass(frozen=True)
class Both:
    left: "Node"
    right: "Node"


@dataclass(frozen=True)
class Either:
    left: "Node"
    right: "Node"


@dataclass(frozen=True)
class Without:
    left: "Node"
    right: "Node"


Node = Near | Both | Either | Without


class Malformed(ValueError):
    """The query isn't an expression."""


def plain_words(text: str) -> list[str]:
    """A text's tokens as the search sees them."""
    return [w.lower() for w in re.findall(r"[^\W_]+", text.translate(str.maketrans(ACCENTED, PLAIN)))]


def _lexemes(query: str) -> list[tuple[str, str]]:
    """(kind, value): "text" for what is in quotes, "word" for bare words, else the sign itself."""
    out, at = [], 0
    while at < len(query):
        c = query[at]
        if c.isspace():
            at += 1
        elif c == '"':
            found = re.compile(r'"((?:[^"]|"")*)"').match(query, at)
            if not found:
                raise Malformed("a quote isn't closed")
            out.append(("text", found[1].replace('""', '"')))
            at = found.end()
        elif found := re.compile(r"[A-Za-z0-9_\x1a\x80-\U0010ffff]+").match(query, at):
            out.append(("word", found[0]))
            at = found.end()
        elif c in _SIGNS:
            out.append((c, c))
            at += 1
        else:
            raise Malformed(f"{c} can't stand outside quotes")
    return out


class _Reader:
    """Recursive descent: OR binds least, then AND, then NOT; adjacent phrases bind most."""

    def __init__(self, query: str, columns: list[str]):
        self.left, self.columns = _lexemes(query), [c.lower() for c in columns]
        self.named = dict(zip(self.columns, columns))

    def kind(self, k: int = 0) -> str:
        return self.left[k][0] if len(self.left) > k else ""

    def keyword(self, name: str) -> bool:
        return bool(self.left) and self.left[0] == ("word", name)

    def take(self, kind: str) -> str:
        if self.kind() != kind:
            raise Malformed(f"{kind} is missing")
        return self.left.pop(0)[1]

    def either(self) -> Node:
        node = self.both()
        while self.keyword("OR"):
            self.take("word")
            other = self.both()
            node = node if other == Near(()) else other if node == Near(()) else Either(node, other)
        return node

    def both(self) -> Node:
        node = self.without()
        while self.keyword("AND"):
            self.take("word")
            node = Both(node, self.without())
        return node

    def without(self) -> Node:
        node = self.item()
        while self.keyword("NOT"):
            self.take("word")
            other = self.item()
            node = node if other == Near(()) else Without(node, other)
        return node

    def item(self) -> Node:
        if self.kind() == "(":
            return self.inside()
        columns = self.column_set()
        if columns is not None and self.kind() == "(":
            return _within(self.inside(), columns)
        parts = [self.group(columns)]
        while self.kind() in ("word", "text", "^", "-", "{") and not (self.keyword("AND") or self.keyword("OR") or self.keyword("NOT")):
            parts.append(self.group(self.column_set()))
        full = [p for p in parts if p.phrases]
        return reduce(Both, full) if full else Near(())

    def inside(self) -> Node:
        self.take("(")
        node = self.either()
        self.take(")")
        return node

    def column_set(self) -> frozenset[str] | None:
        """The columns before a colon, if there are some: a name, several in braces, or all others after a minus."""
        at = 1 if self.kind() == "-" else 0
        if self.kind(at) == "{":
            end = next((k for k in range(at + 1, len(self.left)) if self.kind(k) == "}"), 0)
            if end <= at + 1 or self.kind(end + 1) != ":":
                raise Malformed("braces hold columns and stand before a colon")
            names, size = [self.left[k] for k in range(at + 1, end)], end + 2
        elif self.kind(at) in ("word", "text") and self.kind(at + 1) == ":":
            names, size = [self.left[at]], at + 2
        elif at:
            raise Malformed("a minus stands before columns")
        else:
            return None
        for kind, name in names:
            if kind not in ("word", "text") or name.lower() not in self.named:
                raise Malformed(f"there is no column {name}")
        del self.left[:size]
        found = {name.lower() for _, name in names}
        return frozenset(self.named[c] for c in self.columns if (c in found) != bool(at))

    def group(self, columns: frozenset[str] | None) -> Near:
        if self.keyword("NEAR") and self.kind(1) == "(":
            del self.left[:2]
            phrases, distance = [], NEAR_TOKENS
            while self.kind() in ("word", "text", "^"):
                phrases.append(self.phrase(columns))
            if self.kind() == ",":
                self.take(",")
                number = self.take("word")
                if not number.isdigit():
                    raise Malformed("a distance is a number")
                distance = int(number)
            self.take(")")
            if not phrases:
                raise Malformed("NEAR needs phrases")
        else:
            phrases, distance = [self.phrase(columns)], NEAR_TOKENS
        return Near(tuple(p for p in phrases if p.words), distance)

    def phrase(self, columns: frozenset[str] | None) -> Phrase:
        first = self.kind() == "^"
        if first:
            self.take("^")
        words: list[tuple[str, bool]] = []
        while True:
            if self.kind() not in ("word", "text") or (not words and any(map(self.keyword, ("AND", "OR", "NOT")))):
                raise Malformed("a phrase is missing")
            words += [(w, False) for w in plain_words(self.left.pop(0)[1])]
            if self.kind() == "*":
                self.take("*")
                words[-1:] = [(w, True) for w, _ in words[-1:]]
            if self.kind() != "+":
                return Phrase(tuple(words), first, columns)
            self.take("+")


def _within(node: Node, columns: frozenset[str]) -> Node:
    if isinstance(node, Near):
        narrow = lambda p: replace(p, columns=columns if p.columns is None else p.columns & columns)
        return replace(node, phrases=tuple(map(narrow, node.phrases)))
    return type(node)(_within(node.left, columns), _within(node.right, columns))


def parse(query: str, columns: list[str]) -> Node | None:
    """The expression of a query over the named columns; None if it isn't one, which finds nothing."""
    try:
        reader = _Reader(query, columns)
        node = reader.either()
    except (Malformed, RecursionError):
        return None
    return None if reader.left else node


def leaves(node: Node) -> list[Near]:
    return [node] if isinstance(node, Near) else leaves(node.left) + leaves(node.right)


def slots(node: Node) -> list[tuple[str, bool]]:
    """The distinct words of an expression, with whether they are prefixes."""
    return list(dict.fromkeys(w for leaf in leaves(node) for p in leaf.phrases for w in p.words))


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, accents stripped."""
    return F.regexp_extract_all(F.lower(without_accents(F.coalesce(text, F.lit("")))), F.lit(f"({WORD})"), 1)


def is_word(token: Column, word: str, prefix: bool) -> Column:
    return token.startswith(word) if prefix else token == word


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _occurrences(phrase: Phrase, at: Callable[[int], Column], places: dict[tuple[str, bool], int]) -> Column:
    """Where the phrase begins, of the positions `at` of each word's slot."""
    found = at(places[phrase.words[0]])
    for k, word in enumerate(phrase.words[1:], 1):
        found = _followed(found, at(places[word]), k)
    return F.filter(found, lambda x: x == 0) if phrase.first else found


def _followed(found: Column, others: Column, by: int) -> Column:
    return F.filter(found, lambda x: F.array_contains(others, x + by))


def _near(occurrences: list[Column], sizes: list[int], distance: int) -> list[Column]:
    """The occurrences of each phrase that have all others near: ends and beginnings at most `distance` tokens apart."""

    def reached(own: Column, last: Column, n: int) -> Column:
        return F.exists(own, lambda x: (x <= last) & (x >= last - n - distance))

    def kept(own: Column, n: int) -> Column:
        return F.filter(own, lambda x: F.exists(last, lambda m: (x <= m) & (x >= m - n - distance)))

    last = F.filter(reduce(F.array_union, occurrences), lambda m: reduce(lambda a, b: a & b, (reached(o, m, n) for o, n in zip(occurrences, sizes))))
    return [kept(o, n) for o, n in zip(occurrences, sizes)]


@dataclass
class Expression:
    """A parsed query over weighed columns, evaluated on a table of positions.

    The table has columns __s{slot}_{column} (sorted positions of each distinct word in each searched column) and
    __length (tokens of all columns).
    """

    node: Node
    weights: Mapping[str, float]

    def __post_init__(self):
        self.names = list(self.weights)
        self.words = slots(self.node)
        self.place = {w: k for k, w in enumerate(self.words)}
        self.leaves = leaves(self.node)
        self.phrases = [(i, p) for i, leaf in enumerate(self.leaves) for p in leaf.phrases]

    def slot(self, k: int, column: int) -> str:
        return f"__s{k}_{column}"

    def searched(self, phrase: Phrase) -> list[int]:
        return [c for c, name in enumerate(self.names) if phrase.columns is None or name in phrase.columns]

    def placed(self, rows: DataFrame) -> DataFrame:
        """The rows with the table's columns, from their texts."""
        read = rows.select("*", *(tokens(F.col(n)).alias(f"__t{c}") for c, n in enumerate(self.names)))
        length = reduce(lambda a, b: a + b, (F.size(f"__t{c}") for c in range(len(self.names))))
        where = lambda c, w: F.filter(F.transform(f"__t{c}", lambda x, i: F.when(is_word(x, *w), i)), lambda x: x.isNotNull())
        found = read.select("*", length.alias("__length"), *(where(c, w).alias(self.slot(k, c)) for k, w in enumerate(self.words) for c in range(len(self.names))))
        return found.drop(*(f"__t{c}" for c in range(len(self.names))))

    def occurring(self, placed: DataFrame) -> DataFrame:
        """With __o{phrase}_{column}, where each phrase begins, and __n{phrase}_{column}, those that are near enough."""
        raw = [_occurrences(p, lambda k, c=c: F.col(self.slot(k, c)), self.place).alias(f"__o{q}_{c}") for q, (_, p) in enumerate(self.phrases) for c in self.searched(p)]
        rows = placed.select("*", *raw)
        trimmed = []
        for i, leaf in enumerate(self.leaves):
            own = [q for q, (k, _) in enumerate(self.phrases) if k == i]
            for c in range(len(self.names)):
                here = [q for q in own if c in self.searched(self.phrases[q][1])]
                if len(here) < len(own):
                    continue  # some phrase can't be in this column
                each = [F.col(f"__o{q}_{c}") for q in here]
                near = _near(each, [len(self.phrases[q][1].words) for q in here], leaf.distance) if len(here) > 1 else each
                trimmed += [x.alias(f"__n{q}_{c}") for q, x in zip(here, near)]
        return rows.select("*", *trimmed)

    def _held(self, rows: DataFrame, q: int, kind: str) -> list[Column]:
        return [F.size(f"__{kind}{q}_{c}") for c in range(len(self.names)) if f"__{kind}{q}_{c}" in rows.columns]

    def judged(self, rows: DataFrame) -> tuple[DataFrame, Column]:
        """With __d{phrase} (whether the row has it at all) and __f{phrase} (its weighed count where it counts), and whether the row matches.

        A phrase counts where all parts of the expression around it match.
        """
        truth = {}

        def judge(node: Node) -> Column:
            if isinstance(node, Near):
                i = next(k for k, leaf in enumerate(self.leaves) if leaf is node)
                own = next((q for q, (k, _) in enumerate(self.phrases) if k == i), None)
                truth[id(node)] = F.lit(False) if own is None else _any([n > 0 for n in self._held(rows, own, "n")])
            else:
                a, b = judge(node.left), judge(node.right)
                truth[id(node)] = a & b if isinstance(node, Both) else a | b if isinstance(node, Either) else a & ~b
            return truth[id(node)]

        matched = judge(self.node)
        active = {}

        def spread(node: Node, around: Column) -> None:
            here = around & truth[id(node)]
            if isinstance(node, Near):
                active[id(node)] = here
            else:
                spread(node.left, here)
                spread(node.right, F.lit(False) if isinstance(node, Without) else here)

        spread(self.node, F.lit(True))
        each = []
        for q, (i, _) in enumerate(self.phrases):
            counts = [F.size(f"__n{q}_{c}") * F.lit(float(self.weights[n])) for c, n in enumerate(self.names) if f"__n{q}_{c}" in rows.columns]
            total = reduce(lambda a, b: a + b, counts, F.lit(0.0))
            each += [_any([n > 0 for n in self._held(rows, q, "o")]).alias(f"__d{q}"), F.when(active[id(self.leaves[i])], total).otherwise(F.lit(0.0)).alias(f"__f{q}")]
        return rows.select("*", *each), matched

    def score(self, judged: DataFrame, matched: Column, totals: DataFrame | None = None) -> DataFrame:
        """The matching rows with `score`, smaller for better ones. totals: one row (n, mean) of all rows' count and mean length, where the table holds candidates only."""
        many = range(len(self.phrases))
        counts = [F.count(F.when(F.col(f"__d{q}"), 1)).alias(f"__n{q}") for q in many]
        stats = judged.agg(*counts) if totals is not None else judged.agg(F.count("*").alias("__n"), F.avg("__length").alias("__mean"), *counts)
        if totals is not None:
            stats = stats.crossJoin(totals.select(F.col("n").alias("__n"), F.col("mean").alias("__mean")))
        joined = judged.where(matched).crossJoin(F.broadcast(stats))  # one row of statistics
        parts = []
        for q in many:
            idf = F.ln((F.col("__n") - F.col(f"__n{q}") + 0.5) / (F.col(f"__n{q}") + 0.5))
            f = F.col(f"__f{q}")
            parts.append(F.when(idf <= 0, IDF_FLOOR).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__length") / F.col("__mean"))))
        total = -reduce(lambda a, b: a + b, parts, F.lit(0.0))
        scored = joined.withColumn("score", total)
        return scored.drop(*(c for c in scored.columns if re.fullmatch(r"__([sondf]\d+(_\d+)?|n|mean|length)", c)))


def matches(corpus: DataFrame, node: Node, weights: Mapping[str, float]) -> DataFrame:
    """The rows of the corpus that match, with `score` (smaller is better), by one scan; statistics are those of all rows, so filters belong after this."""
    e = Expression(node, weights)
    return e.score(*e.judged(e.occurring(e.placed(corpus))))


def snippets(rows: DataFrame, node: Node, weights: Mapping[str, float], column: str = "text", size: int = 20, name: str = "snippet", marks: tuple[str, str] = ('<span class="highlighted">', "</span>"), gap: str = "...") -> DataFrame:
    """The rows with a column `name`: the `size` tokens of a column that hold most different phrases, phrases marked.

    Windows begin so that their phrases are in the middle, or where the sentence around a phrase does, which counts a
    little; of equal windows the first is taken. A column without a phrase shows its beginning, null reads as empty.
    """
    e = Expression(node, weights)
    at = e.names.index(column)
    found = e.occurring(e.placed(rows))
    judged, _ = e.judged(found)
    text = F.coalesce(F.col(column), F.lit(""))
    item = lambda q, p: F.transform(F.when(F.col(f"__f{q}") > 0, F.col(f"__n{q}_{at}")).otherwise(F.array().cast("array<int>")), lambda x: F.struct(x.alias("at"), F.lit(q).alias("phrase"), F.lit(len(p.words)).alias("size")))
    held = [item(q, p) for q, (_, p) in enumerate(e.phrases) if f"__n{q}_{at}" in judged.columns]
    empty = F.array().cast("array<struct<at:int,phrase:int,size:int>>")
    cut = judged.select("*", F.array_sort(F.flatten(F.array(empty, *held))).alias("__hits"), F.regexp_extract_all(text, F.lit(f"({WORD})"), 1).alias("__words"), F.split(text, WORD, -1).alias("__between"))
    many = F.size("__words")
    sentence = F.filter(F.transform("__between", lambda x, i: F.when((i == 0) | ((i < many) & x.rlike(r"[.:][ \t\r\n]+$")), i)), lambda x: x.isNotNull())
    cut = cut.withColumn("__many", many).withColumn("__sentences", F.when(many > size, sentence).otherwise(F.array().cast("array<int>")))
    inside = lambda begin: F.filter("__hits", lambda h: (h["at"] >= begin) & (h["at"] < begin + size))

    def worth(begin: Column) -> Column:
        here = inside(begin)
        return F.size(F.array_distinct(F.transform(here, lambda h: h["phrase"]))) * (NEW_PHRASE - AGAIN) + F.size(here) * AGAIN

    def centred(begin: Column) -> Column:
        here = inside(begin)
        last = F.element_at(here, -1)
        wide = last["at"] + last["size"] - here[0]["at"]
        start = here[0]["at"] - ((F.lit(size) - wide) / 2).cast("int")
        return F.greatest(F.lit(0), F.least(start, F.col("__many") - size))

    def of_hit(h: Column, k: Column) -> Column:
        own = F.struct(worth(h["at"]).alias("worth"), (-2 * k).alias("turn"), centred(h["at"]).cast("int").alias("begin"))
        before = F.array_max(F.filter("__sentences", lambda s: s < h["at"]))
        # A hit that begins a sentence has no window of its own there; the last sentence begins no window.
        exact = F.array_contains("__sentences", h["at"])
        other = F.struct((worth(before) + F.when(before == 0, BEGINNING).otherwise(SENTENCE)).alias("worth"), (-2 * k - 1).alias("turn"), before.cast("int").alias("begin"))
        return F.array(own, F.when(before.isNotNull() & ~exact, other).otherwise(own))

    best = F.array_max(F.flatten(F.transform("__hits", of_hit)))["begin"]
    cut = cut.withColumn("__begin", F.coalesce(best, F.lit(0)))
    # Overlapping phrases are marked as one.
    spans = F.aggregate("__hits", F.array().cast("array<struct<first:int,last:int>>"), _joined)
    cut = cut.withColumn("__spans", spans)
    to = F.least(F.col("__begin") + size, F.col("__many"))
    opens = lambda i: F.exists("__spans", lambda s: (s["first"] == i) | ((i == F.col("__begin")) & (s["first"] < i) & (s["last"] >= i)))
    closes = lambda i: F.exists("__spans", lambda s: (s["last"] == i) | ((i == to - 1) & (s["first"] <= i) & (s["last"] > i)))
    lead = lambda i: F.when((i == F.col("__begin")) & (i > 0), F.lit("")).otherwise(F.get("__between", i))
    shown = lambda i: F.concat(lead(i), F.when(opens(i), marks[0]).otherwise(""), F.get("__words", i), F.when(closes(i), marks[1]).otherwise(""))
    body = F.array_join(F.transform(F.sequence(F.col("__begin"), to - 1), shown), "")
    tail = F.when(to >= F.col("__many"), F.element_at("__between", -1)).otherwise(gap)
    whole = F.when(F.col("__many") == 0, text).otherwise(F.concat(F.when(F.col("__begin") > 0, gap).otherwise(""), body, tail))
    done = cut.withColumn(name, whole)
    return done.drop(*(c for c in done.columns if re.fullmatch(r"__([sondf]\d+(_\d+)?|length|hits|words|between|many|sentences|begin|spans)", c)))


def _joined(spans: Column, h: Column) -> Column:
    last = h["at"] + h["size"] - 1
    before = F.try_element_at(spans, F.lit(-1))
    apart = F.array(F.struct(h["at"].alias("first"), last.cast("int").alias("last")))
    grown = F.array(F.struct(before["first"].alias("first"), F.greatest(before["last"], last).cast("int").alias("last")))
    return F.when(F.size(spans) == 0, apart).when(h["at"] <= before["last"], F.concat(F.slice(spans, 1, F.size(spans) - 1), grown)).otherwise(F.concat(spans, apart))
