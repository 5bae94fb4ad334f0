"""Mixing sources to target weights as a min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. The flow network has a node for each pattern and each
source: a pattern supplies its words once for nothing, a second time at cost 1, a third time at cost 2 and so on, and
each source takes its quota from the patterns that contain it. As only the first edge of a path costs anything and
its cost grows with the repetition, the cheapest flow comes from one maximum flow after another, tier by tier.
Only the patterns and sources (a catalogue, not documents) reach the driver. A seeded hash then orders each pattern's
documents, and a threshold on it picks those that are taken once more than the rest.
"""

from collections import defaultdict, deque
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.storage import Stash, as_rows, of_rows

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null and empty texts have 0. Words are counted where they begin, without making them."""
    blank = F.regexp_replace(text, WORD, "w")
    return F.coalesce(F.length(blank) - F.length(F.replace(blank, F.lit("w"), F.lit(""))), F.lit(0)).cast("long")


def reshared_targets(sizes: Mapping, weights: Mapping, budget: float, most: float = 3.0) -> dict:
    """Targets by weight that add up to the budget; what is above `most` times a source's size is reshared by weight until none is."""
    targets, free, left = {}, {s for s in sizes if weights[s] > 0}, float(budget)
    targets |= {s: 0.0 for s in sizes if s not in free}
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total > most * sizes[s]}
        for s in over or free:
            targets[s] = most * sizes[s] if over else left * weights[s] / total
        if not over:
            break
        left -= sum(targets[s] for s in over)
        free -= over
    return targets


def cheapest_flow(supply: Mapping[tuple, int], quota: Mapping, tiers: int = 3) -> dict[tuple, dict]:
    """Words that each pattern (tuple of sources) gives to each source: as much of the quotas as can be met, with the fewest repetitions."""
    flow: dict[tuple, dict] = {p: defaultdict(int) for p in supply}
    need = dict(quota)
    givers = defaultdict(list)
    for p in supply:
        for s in p:
            givers[s].append(p)
    for _ in range(tiers):
        rest = dict(supply)
        while True:
            came: dict = {}
            todo = deque(("p", p) for p in supply if rest[p] > 0)
            came.update({x: None for x in todo})
            end = None
            while todo and not end:
                kind, x = node = todo.popleft()
                if kind == "s" and need[x] > 0:
                    end = node
                    break
                near = [("s", s) for s in x if s in need] if kind == "p" else [("p", p) for p in givers[x] if flow[p][x] > 0]
                for y in near:
                    if y not in came:
                        came[y] = node
                        todo.append(y)
            if not end:
                break
            path = [end]
            while came[path[-1]]:
                path.append(came[path[-1]])
            path.reverse()
            back = [flow[b[1]][a[1]] for a, b in zip(path, path[1:]) if a[0] == "s"]
            much = min([rest[path[0][1]], need[end[1]], *back])
            for a, b in zip(path, path[1:]):
                if a[0] == "p":
                    flow[a[1]][b[1]] += much
                else:
                    flow[b[1]][a[1]] -= much
            rest[path[0][1]] -= much
            need[end[1]] -= much
    return {p: dict(x) for p, x in flow.items()}


class Mixture:
    """copies(): how often each row is taken. sizes and targets are by source."""

    def __init__(self, rules: DataFrame, few: bool, sizes: dict, targets: dict, seed: int):
        self.rules, self.few, self.sizes, self.targets, self.seed = rules, few, sizes, targets, seed

    def copies(self, rows: DataFrame, id_col: Column, pattern: Column, name: str = "copies") -> DataFrame:
        """The rows with a column `name`. A row of a pattern that the plan hasn't seen is taken 0 times."""
        marked = rows.withColumn("__pattern", pattern_key(pattern)).withColumn("__draw", draw(self.seed, id_col))
        joined = marked.join(F.broadcast(self.rules) if self.few else self.rules, "__pattern", "left")
        taken = F.coalesce(F.col("__full") + F.when(F.col("__draw") <= F.col("__most"), 1).otherwise(0), F.lit(0))
        return joined.withColumn(name, taken).drop("__pattern", "__draw", "__full", "__most")


def draw(seed: int, id_col: Column) -> Column:
    """48 seeded bits for each id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col), 16)


def pattern_key(pattern: Column) -> Column:
    return F.to_json(F.struct(F.array_sort(F.array_distinct(pattern)).alias("p")), {"ignoreNullFields": "false"})


def plan_mixture(
    rows: DataFrame, id_col: str, size_col: str, pattern: Column, weigh: Callable[[list], Mapping], most: int = 3, share: float = 1.0, seed: int = 17
) -> Mixture:
    """Plans which rows to take how often.

    rows: one for each document, cheap to read more than once. pattern: array of the sources of a row, null among
    them allowed. weigh: gives each source's weight from the list of sources by code point, null last. The budget is
    `share` of all words. A null size counts as 0; repeated rows count each; an empty table gives an empty plan.
    """
    spark = rows.sparkSession
    narrow = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("size"), F.array_sort(F.array_distinct(pattern)).alias("sources"), pattern_key(pattern).alias("__pattern"))
    found = narrow.groupBy("__pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    supply = {tuple(r.sources or ()): r["size"] for r in found}
    keys = {tuple(r.sources or ()): r["__pattern"] for r in found}
    sizes: dict = defaultdict(int)
    for p, n in supply.items():
        for s in p:
            sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = reshared_targets(sizes, weigh(order), share * sum(supply.values()), most)
    flow = cheapest_flow(supply, {s: round(targets[s]) for s in order}, most)
    cut = []
    for p, n in supply.items():
        words = sum(flow[p].values())
        cut.append((keys[p], words // n if n else 0, words % n if n else 0))
    few = len(cut) <= 50_000
    return Mixture(_rules(spark, narrow, cut, sum(r["rows"] for r in found), few, seed), few, dict(sizes), targets, seed)


def _rules(spark: SparkSession, narrow: DataFrame, cut: list[tuple], count: int, few: bool, seed: int) -> DataFrame:
    """For each pattern: full passes, and the largest draw of the documents that are taken once more.

    Draws fall into ranges of about 20,000 documents; only the range in which the words run out is sorted.
    """
    spread = max(1024, count // 20_000)
    need = spark.createDataFrame(cut, "__pattern string, __full long, __rest long")
    need = F.broadcast(need) if few else need
    drawn = narrow.where("size > 0").withColumn("draw", draw(seed, F.col("id"))).withColumn("range", F.floor(F.col("draw") / 2.0**48 * spread))
    sums = drawn.groupBy("__pattern", "range").agg(F.sum("size").alias("words"))
    by = Window.partitionBy("__pattern").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("words").over(by)).join(need, "__pattern").where("__rest > 0 AND upto >= __rest")
    edge = sums.groupBy("__pattern").agg(F.min(F.struct("range", "upto", "words", "__rest")).alias("x")).select("__pattern", "x.range", (F.col("x.upto") - F.col("x.words")).alias("before"), "x.__rest")
    near = drawn.join(edge, ["__pattern", "range"])
    each = Window.partitionBy("__pattern", "range").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.max(F.when(F.col("mid") <= F.col("__rest"), F.col("draw")))
    ends = near.withColumn("mid", F.col("before") + F.sum("size").over(each) - F.col("size") / 2).groupBy("__pattern").agg(F.coalesce(inside, F.min("draw") - 1).alias("__most"))
    return need.select("__pattern", "__full").join(ends, "__pattern", "left")


def rotating_weights(order: list) -> dict:
    """1, 2, 3, repeating."""
    return {s: 1 + i % 3 for i, s in enumerate(order)}


def mix_documents(docs: DataFrame, seed: int = 17) -> tuple[DataFrame, Mixture]:
    """(doc_id, size, source_size, target, taken) of each document, and the mixture.

    The membership pattern of a document is its one source. Null and empty texts have size 0 and are taken 0 words.
    """
    stash = Stash(docs.sparkSession)
    rows = stash.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")))
    mixture = plan_mixture(rows, "doc_id", "size", F.array("source"), rotating_weights, seed=seed)
    spark = docs.sparkSession
    of = spark.createDataFrame([(s, n, float(mixture.targets[s])) for s, n in mixture.sizes.items()], "name string, source_size long, target double")
    taken = mixture.copies(rows, F.col("doc_id"), F.array("source"))
    taken = taken.join(F.broadcast(of) if mixture.few else of, F.col("source").eqNullSafe(F.col("name")))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source"), mixture


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of the documents that the mixture takes, each as often as it does. Columns of any name stay as they are.

    Null and empty texts have no words and are not taken; a null source is a source; rows that repeat an id are taken
    alike. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"), "size": word_count(F.col("text"))}
    rows = Stash(spark).put(docs.select(*(c.alias(n) for n, c in own.items())))
    mixture = plan_mixture(rows, "doc_id", "size", F.array("source"), rotating_weights, seed=seed)
    taken = mixture.copies(as_rows(docs, **own), F.col("doc_id"), F.array("source"))
    times = F.when(F.col("size") > 0, F.col("copies")).otherwise(0).cast("int")
    return of_rows(taken.withColumn("copy", F.explode(F.array_repeat(F.lit(0), times))), docs.columns)
