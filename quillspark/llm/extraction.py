"""Main text of web pages by wrappers that are inferred for each host.

Every page is cut into block tags and texts and folded into an expression. The distinct expressions of a host are
aligned, a bounded number at a time and round after round, until one union-free wrapper describes them all; texts are
the wrapper's slots. What all pages of a host have in a slot (how much text and link text, whether it is always the
same) tells the article's slots from the rest.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.storage import Stash
from quillspark.llm.wrappers import OWN_INSIDE, OWN_REST, infer, page_blocks, skeleton, slot_zones, slots

FAN = 64  #: expressions that are aligned in one group of a round, on average
BROADCAST_BYTES = 32 << 20  #: of the table of wrappers and slots; a larger one is joined by shuffle

_PARSED = "page_id long, url string, host string, expression string, place array<int>, texts array<string>, links array<int>"


def parsed(pages: DataFrame) -> DataFrame:
    """Each page's folded expression, and the texts with the number of their T in it."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = []
                for page in part.column("html").to_pylist():
                    items, texts, links = page_blocks(page or "")
                    rows.append((*skeleton(" ".join(items)), texts, links))
                out = {c: part.column(c) for c in ("page_id", "url", "host")}
                kinds = {"expression": pa.string(), "place": pa.list_(pa.int32()), "texts": pa.list_(pa.string()), "links": pa.list_(pa.int32())}
                yield pa.record_batch(out | {c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(kinds.items())})

    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(parse, _PARSED)


def host_wrappers(expressions: DataFrame, stash: Stash) -> DataFrame:
    """(host, wrapper) from (host, expression), distinct. A round merges groups of about FAN expressions of a host into one each."""

    def align(table: pa.Table) -> pa.Table:
        return pa.table({"host": table.column("host").slice(0, 1), "expression": [infer(table.column("expression").to_pylist())]})

    now = expressions
    while True:
        many = now.groupBy("host").agg(F.ceil(F.count("*") / FAN).alias("groups"))
        most = many.agg(F.max("groups")).first()[0]
        part = F.pmod(F.xxhash64("expression"), F.col("groups"))
        grouped = now.join(many, "host").withColumn("part", part).select("host", "part", "expression")
        before, now = now, stash.put(grouped.groupBy("host", "part").applyInArrow(align, "host string, expression string"))
        if before is not expressions:
            stash.drop(before)
        if not most or most <= 1:
            return now.withColumnRenamed("expression", "wrapper")


def _keep(table: pa.Table) -> pa.Table:
    """Choices of the article's slots of one host, the best first, from its wrapper and what its pages have in each slot. A page takes the first that it has text in."""
    wrapper = table.column("wrapper")[0].as_py()
    zones = slot_zones(wrapper)
    often = max(10, max(table.column("pages").to_pylist()) // 2)  # a text of a few pages may be the same because they are copies
    seen = {s: dict(chars=c, links=n, same=f == t and p >= often) for s, c, n, f, t, p in zip(*(table.column(x).to_pylist() for x in ("slot", "chars", "links", "low", "high", "pages")))}
    inside = [s for s in seen if zones[s] == 1]
    rest = [s for s in seen if zones[s] == 0]
    text = lambda group: sum(seen[s]["chars"] - seen[s]["links"] for s in group)
    plain = [s for s in rest if seen[s]["links"] < 0.5 * seen[s]["chars"]] or rest
    order = [inside, plain] if inside and text(inside) >= 0.1 * text(rest) else [plain, inside]
    choices = []
    for found in order:  # what never changes belongs to the host, unless a page has nothing else
        choices += [[s for s in found if not seen[s]["same"]], found]
    return pa.table({"host": table.column("host").slice(0, 1), "wrapper": [wrapper], "choices": pa.array([[sorted(c) for c in choices]], pa.list_(pa.list_(pa.int32())))})


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page: the article's blocks in page order, joined by newlines.

    A null or empty page gives an empty text. Pages whose url has no host count as one host. Repeated rows give a row
    each; an empty table none; other columns aren't read.
    """
    stash = Stash(pages.sparkSession)
    rows = stash.put(parsed(pages))
    expressions = stash.put(rows.where("expression <> ''").select("host", "expression").distinct())
    wrappers = host_wrappers(expressions, stash)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [slots(e, w) for e, w in zip(batch.column("expression").to_pylist(), batch.column("wrapper").to_pylist())]
            yield pa.record_batch({"host": batch.column("host"), "expression": batch.column("expression"), "slot_of": pa.array(found, pa.list_(pa.int32()))})

    placed = stash.put(expressions.join(wrappers, "host").select("host", "expression", "wrapper").mapInArrow(place, "host string, expression string, slot_of array<int>"))
    texts = rows.select("host", "expression", F.explode(F.arrays_zip("place", "texts", "links")).alias("x"))
    each = texts.groupBy("host", "expression", "x.place").agg(F.sum(F.length("x.texts")).alias("chars"), F.sum("x.links").alias("links"), F.min(F.xxhash64("x.texts")).alias("low"), F.max(F.xxhash64("x.texts")).alias("high"), F.count("*").alias("pages"))
    of_slot = each.join(placed, ["host", "expression"]).withColumn("slot", F.col("slot_of")[F.col("place")]).where("slot >= 0")
    of_slot = of_slot.groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("pages").alias("pages"))
    kept = of_slot.join(wrappers, "host").groupBy("host").applyInArrow(_keep, "host string, wrapper string, choices array<array<int>>")
    own = F.get(F.filter("choices", lambda c: F.arrays_overlap(c, "slot_of")), F.lit(0))
    chosen = placed.join(kept.select("host", "choices"), "host", "left").withColumn("kept", F.coalesce(own, F.array().cast("array<int>")))
    # A text without a slot stays where its own page has it in the article, or has nothing else.
    stays = lambda s: F.array_contains("kept", s) | (s == OWN_INSIDE) | ((s == OWN_REST) & (F.size("kept") == 0))
    keep = chosen.select("host", "expression", F.transform("slot_of", stays).alias("keep"))
    keep = stash.put(keep)
    small = (keep.agg(F.sum(F.length("expression") + F.size("keep") + F.length("host"))).first()[0] or 0) <= BROADCAST_BYTES
    joined = rows.join(F.broadcast(keep) if small else keep, ["host", "expression"], "left")
    blocks = F.filter(F.arrays_zip("place", "texts"), lambda x: F.element_at("keep", x["place"] + 1))
    text = F.coalesce(F.array_join(F.transform(blocks, lambda x: x["texts"]), "\n"), F.lit(""))
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
