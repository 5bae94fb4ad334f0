"""Language identification as multilingual mixture inference.

Each language has a distribution over hashed character trigrams. Expectation-maximisation estimates the proportions
of the languages in a document from its trigrams' likelihoods; of the nested sets of its most likely languages, the
one with the best penalised likelihood is kept, and its largest proportion names the document's language.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.arrays import pieces
from quillspark.llm.mixing import draw
from quillspark.llm.toxicity import code_points, remainder

BITS = 15
SAMPLE = 1_500  #: documents of each language that its distribution is estimated from at most, by seeded hash
ROUNDS = 12
PENALTY = 3.0  #: in units of half the logarithm of the number of trigrams, for each further language

_LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hashed trigram, how often) of lower-cased texts, whose runs of other characters than letters count as one space."""
    texts = [f" {(x or '').lower()} " for x in column.to_pylist()]
    c = code_points(texts)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    letter = _LETTER[np.minimum(c, (1 << 16) - 1)] | (c >= 1 << 16)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (row[1:] != row[:-1])
    c, row, letter = np.where(letter, c, np.uint32(32))[keep], row[keep], letter[keep]
    if len(c) < 3:
        return (np.zeros(0, np.int64),) * 3
    h = (c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1]) * np.uint32(0x85EBCA6B) ^ c[2:]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)
    good = (row[2:] == row[:-2]) & (letter[1:-1] | letter[:-2] & letter[2:])
    key, n = np.unique(row[2:][good] << BITS | h[good], return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), n


def mixture(p: np.ndarray, n: np.ndarray, at: np.ndarray, row: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log likelihood) of each row. p: likelihood of each entry's trigram by language; at: where rows with entries begin."""
    share = allowed / allowed.sum(1, keepdims=True)
    total = np.add.reduceat(n, at)[:, None]
    for _ in range(rounds):
        joint = p * share[row]
        joint *= (n / joint.sum(1))[:, None]
        share = np.add.reduceat(joint, at, axis=0) / total
    return share, np.add.reduceat(n * np.log((p * share[row]).sum(1)), at)


def language_sets(row: np.ndarray, gram: np.ndarray, n: np.ndarray, likelihood: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with entries, proportions by language, languages kept)."""
    rows, at, own = np.unique(row, return_index=True, return_inverse=True)
    n = n.astype(np.float64)
    p = likelihood[gram]
    share, _ = mixture(p, n, at, own, np.ones((len(rows), p.shape[1])))
    order = np.argsort(-share, axis=1, kind="stable")
    price = PENALTY * 0.5 * np.log(np.maximum(2, np.add.reduceat(n, at)))
    best, best_value, kept = share, np.full(len(rows), -np.inf), np.ones(len(rows), int)
    some = np.arange(len(rows))  # rows that gained by their last language
    for k in range(1, p.shape[1] + 1):
        here = np.zeros(len(rows), bool)
        here[some] = True
        entry = np.flatnonzero(here[own])
        place = (np.cumsum(here) - 1)[own[entry]]
        allowed = np.zeros((len(some), p.shape[1]))
        np.put_along_axis(allowed, order[some, :k], 1, axis=1)
        own_share, fit = mixture(p[entry], n[entry], np.searchsorted(place, np.arange(len(some))), place, allowed, ROUNDS if k > 1 else 0)  # one language has all of the text
        value = fit - price[some] * k
        better = value > best_value[some]
        some = some[better]
        best[some], best_value[some], kept[some] = own_share[better], value[better], k
        if not len(some):
            break
    return rows, best, kept


def language_model(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, trigram likelihoods by language) from the rows with text and lang for which `learn` (of doc_id) holds."""
    known = docs.where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((1 << BITS, 0))
    parts = docs.sparkSession.createDataFrame([(x, sample / counts[x]) for x in langs], "lang string, part double")
    drawn = known.join(F.broadcast(parts), "lang").where(draw(31, F.col("doc_id")) < F.col("part") * 2.0**48).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                row, gram, n = trigrams(part.column("text"))
                yield pa.record_batch({"lang": part.column("lang").take(pa.array(row)), "gram": pa.array(gram, pa.int64()), "n": pa.array(n, pa.int64())})

    found = drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((1 << BITS, len(langs)))
    number = pc.index_in(found.column("lang").combine_chunks(), pa.array(langs)) if found.num_rows else pa.array([], pa.int32())
    table[np.asarray(found.column("gram")), np.asarray(number)] = np.asarray(found.column("n"))
    table += 0.5
    return langs, table / table.sum(0)


def document_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score (its proportion), n_languages of every whole text.

    `und` and score 0 where the text is null or has no letter, or where no row teaches a language. Extra columns
    aren't read; repeated rows give a row each.
    """
    langs, likelihood = language_model(docs, remainder("doc_id", 4) != 2)
    shared = docs.sparkSession.sparkContext.broadcast((langs, likelihood.astype(np.float32)))
    out = "doc_id long, held_out boolean, lang_pred string, score double, n_languages int"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, likelihood = shared.value
        names = np.array([*langs, "und"], object)
        for batch in batches:
            for part in pieces(batch, "text", max(1 << 16, (1 << 22) // max(4, len(langs)))):
                name, score, many = np.full(part.num_rows, len(langs)), np.zeros(part.num_rows), np.zeros(part.num_rows, np.int32)
                row, gram, n = trigrams(part.column("text"))
                if langs and len(row):
                    rows, share, kept = language_sets(row, gram, n, likelihood)
                    name[rows], score[rows], many[rows] = share.argmax(1), np.minimum(1, share.max(1)), kept
                    silent = ~np.asarray(part.column("letters"))
                    name[silent], score[silent], many[silent] = len(langs), 0, 0
                yield pa.record_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "lang_pred": pa.array(names[name], pa.string()), "score": score, "n_languages": many})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 4) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(predict, out)
