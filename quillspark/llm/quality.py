"""Quality by a sparse ensemble of rules over statistics of the text.

Statistics are Spark columns. Trees are boosted on those of a bounded sample of labelled rows; every path from a root
is a rule (a conjunction of comparisons), and a logistic regression with an L1 penalty leaves few of them. These are
compiled into one Spark column, so documents are scored without Python.
"""

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.mixing import draw, word_count
from quillspark.llm.toxicity import remainder

SAMPLE = 2_000  #: labelled rows of each class that rules are fitted on at most (about, by seeded hash)
TREES, DEPTH, CUTS, STEP, SHARE = 30, 3, 24, 0.3, 0.6
PENALTY = 1e-3


def _held(text: Column, signs: str) -> Column:
    """Number of the text's characters in a class of signs."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{signs}]+", ""))


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1)).cast("double")


def statistics(text: Column) -> dict[str, Column]:
    """Statistics by name, doubles that are never null; a null text counts as empty, for which all are 0 but `lines`."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    chars, words = F.length(t), word_count(t)
    letters = _held(t, r"\p{L}")
    spaces = _held(t, r"\s")
    split = F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")
    return {
        "size": F.ln(chars + F.lit(1.0)),
        "word_length": _share(chars - spaces, words),
        "letters": _share(letters, chars),
        "capitals": _share(_held(t, r"\p{Lu}"), letters),
        "digits": _share(_held(t, r"\p{N}"), chars),
        "stops": _share(_held(t, r".,;:?"), words),
        "shouts": _share(_held(t, "!"), words),
        "symbols": _share(chars - spaces - letters - _held(t, r"\p{N}\p{M}.,;:!?'’\"()\-"), chars),
        "distinct": _share(F.size(F.array_distinct(split)), words),
        "repeated": _share(F.regexp_count(t, F.lit(r"(?<!\S)(\S+)(?=\s+\1(?!\S))")), words),
        "line_length": _share(chars, F.regexp_count(t, F.lit(r"\n")) + 1),
    }


Test = tuple[str, bool, float]  # statistic, whether it must lie above, threshold


@dataclass(frozen=True)
class Rule:
    """Holds where all its tests do."""

    tests: tuple[Test, ...]

    @classmethod
    def of(cls, path: tuple[Test, ...]) -> "Rule":
        """One test for each statistic and side: the narrowest."""
        narrow: dict = {}
        for name, above, at in path:
            narrow[name, above] = (max if above else min)(at, narrow.get((name, above), at))
        return cls(tuple(sorted((n, a, t) for (n, a), t in narrow.items())))

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return reduce(np.logical_and, ((rows[n] > t) if above else (rows[n] <= t) for n, above, t in self.tests))

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, ((F.col(n) > t) if above else (F.col(n) <= t) for n, above, t in self.tests))


@dataclass
class Ensemble:
    bias: float
    weights: dict[Rule, float]

    def column(self) -> Column:
        """Chance of label 1, over columns with the names of the statistics."""
        parts = [F.when(r.column(), F.lit(float(w))).otherwise(F.lit(0.0)) for r, w in self.weights.items()]
        z = reduce(lambda a, b: a + b, parts, F.lit(float(self.bias)))
        return 1 / (1 + F.exp(-z))

    def chances(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        z = np.full(len(next(iter(rows.values()))), self.bias)
        for rule, w in self.weights.items():
            z = z + np.where(rule.holds(rows), w, 0.0)
        return 1 / (1 + np.exp(-z))


def paths(rows: dict[str, np.ndarray], gradient: np.ndarray, curve: np.ndarray, here: np.ndarray, cuts: dict[str, np.ndarray], depth: int = DEPTH, path: tuple[Test, ...] = (), least: int = 10) -> list[tuple[tuple[Test, ...], np.ndarray, float]]:
    """(path, its rows, its step) of the nodes below the root of a regression tree on a second-order loss; leaves come last among a path's ends."""
    g, h = gradient[here].sum(), curve[here].sum()
    best = (1e-9, None)
    if depth and len(here) >= 2 * least:
        for name, at in cuts.items():
            low = rows[name][here][:, None] <= at
            many, gl, hl = low.sum(0), gradient[here] @ low, curve[here] @ low
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(many < least) | (len(here) - many < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (name, float(at[k]), low[:, k]))
    found = [(path, here, float(-g / (h + 1)))] if path else []
    if best[1]:
        name, at, low = best[1]
        for above, part in ((False, here[low]), (True, here[~low])):
            found += paths(rows, gradient, curve, part, cuts, depth - 1, (*path, (name, above, at)), least)
    return found


def lasso(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept of a weighted logistic regression with an L1 penalty, by accelerated proximal steps. weight adds up to 1."""
    full = np.column_stack([x, np.ones(len(x))])
    rate = 4.0 / max(1e-12, np.linalg.eigvalsh((full * weight[:, None]).T @ full)[-1])
    now, point, t = np.zeros(full.shape[1]), np.zeros(full.shape[1]), 1.0
    for _ in range(steps):
        g = full.T @ (weight * (1 / (1 + np.exp(-np.clip(full @ point, -50, 50))) - y))
        new = point - rate * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        point, now, t = new + (t - 1) / after * (new - now), new, after
    return now[:-1], float(now[-1])


def fit_rules(rows: dict[str, np.ndarray], y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, trees: int = TREES, seed: int = 5) -> Ensemble:
    """Rules of boosted trees with sparse weights. weight: of each row, so that classes weigh what they do among all labels.

    Without rows the chance is a half, with one class alone near 0 or 1, and there are no rules.
    """
    if not len(y) or y.min() == y.max():
        return Ensemble(0.0 if not len(y) else float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), {})
    weight = weight / weight.sum()
    cuts = {}
    for name, x in rows.items():
        seen = np.unique(x)
        at = np.unique(np.quantile(x, np.linspace(0, 1, CUTS + 2)[1:-1]))
        cuts[name] = at[at < seen[-1]] if len(seen) > 1 else at[:0]
    cuts = {n: at for n, at in cuts.items() if len(at)}
    draws = np.random.default_rng(seed)
    z = np.full(len(y), np.log((weight @ y) / (weight @ (1 - y))))
    rules: dict[Rule, None] = {}
    balanced = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        here = np.flatnonzero(draws.random(len(y)) < 0.7)
        some = {n: cuts[n] for n in sorted(cuts) if draws.random() < SHARE} or cuts
        nodes = paths(rows, balanced * (p - y), balanced * p * (1 - p), here, some)
        for path, _, _ in nodes:
            rules.setdefault(Rule.of(path))
        inner = {path[:-1] for path, _, _ in nodes}
        for path, _, step in nodes:
            if path not in inner:
                z = z + STEP * step * Rule.of(path).holds(rows)
    if not rules:
        return Ensemble(float(np.log((weight @ y) / (weight @ (1 - y)))), {})
    x = np.column_stack([r.holds(rows) for r in rules]).astype(float)
    w, bias = lasso(x, y, weight, penalty)
    return Ensemble(bias, {r: float(v) for r, v in zip(rules, w) if abs(v) > 1e-6})


def _described(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    return docs.select(*keep, *(c.alias(n) for n, c in statistics(F.col(text_col)).items()))


def quality_model(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Ensemble:
    """Fits on the labelled documents for which `learn` (of doc_id) holds, about `sample` of each class. Null labels don't count; of several labels of a document the largest does."""
    marked = labels.where(learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {bool(r.good): r["count"] for r in marked.groupBy((F.col("quality") != 0).alias("good")).count().collect()}
    part = [min(1.0, sample / max(1, counts.get(k, 0))) for k in (False, True)]
    drawn = marked.where(draw(31, F.col("doc_id")) < F.when(F.col("quality") == 0, part[0]).otherwise(part[1]) * 2.0**48)
    drawn = drawn.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").alias("__quality"))
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text"))
    found = _described(texts.join(F.broadcast(drawn), "__id"), "text", [F.col("__id"), F.col("__quality")]).toPandas()
    names = [c for c in found.columns if not c.startswith("__")]
    found = found.sort_values(["__id", *names], kind="stable")
    y = (found["__quality"].to_numpy() != 0).astype(float)
    weight = np.where(y == 1, 1 / part[1], 1 / part[0])
    return fit_rules({n: found[n].to_numpy(float) for n in names}, y, weight)


def document_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row, learnt from the labels outside the held-out fold.

    Null and empty texts get the score of their statistics, which are 0; a null id is not held out; repeated rows have
    a row each. Other columns play no part. An empty table gives an empty result.
    """
    model = quality_model(docs, labels, remainder("doc_id", 3) != 1)
    held_out = (remainder("doc_id", 3) == 1).alias("held_out")
    scored = _described(docs, "text", [F.col("doc_id").cast("long").alias("doc_id"), held_out])
    scored = scored.select("doc_id", "held_out", model.column().alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
