"""Toxicity by a linear classifier on character n-grams that are scaled by naive Bayes log-count ratios."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.arrays import pieces, sums
from quillspark.llm.mixing import draw
from quillspark.llm.storage import as_rows, of_rows, small_batches

SIZES = (3, 4, 5)
BITS = 18
SAMPLE = 2_000  #: labelled rows of each class that the classifier is fitted on at most, by seeded hash
SAMPLE_BYTES = 8 << 20  #: of their texts, for each class


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def ngram_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text, its distinct hashed n-grams of lower-cased characters."""
    texts = [(x or "").lower() for x in column.to_pylist()]
    c = code_points(texts)
    ends = np.cumsum([len(x) for x in texts])
    hashed, h = {}, c
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :] if len(h) else h
        if n in SIZES:
            m = (h ^ (h >> np.uint32(15)) ^ np.uint32(n * 0x9E37)) * np.uint32(0x85EBCA6B)
            hashed[n] = (m ^ (m >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)
    place = np.zeros(1 << BITS, np.int64)
    at = 0
    for end in ends:
        own = np.concatenate([hashed[n][at : max(at, end - n + 1)] for n in SIZES])
        here = np.arange(len(own))
        place[own] = here
        yield own[place[own] == here]
        at = end


def fit_ratio_scaled(flat: np.ndarray, at: np.ndarray, toxic: np.ndarray, totals: tuple[int, int], steps: int = 50, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights (scaling included) and intercept. flat[at[i] : at[i + 1]]: the distinct features of document i; totals: rows of class 0 and 1 there are. The classes weigh the same in the fit, and half their log ratio is added to the intercept: a document has to look toxic before the rarer class is chosen, yet few labels don't drown it."""
    size, count = 1 << BITS, len(toxic)
    prior = float(np.log((totals[1] + 0.5) / (totals[0] + 0.5)))
    if not count or toxic.all() or not toxic.any():
        return np.zeros(size, np.float32), prior
    y = toxic.astype(np.float64)
    cuts = [*range(0, count, 200), count]  # rows are gone through in parts, to hold little besides their features
    parts = [(lo, hi, flat[at[lo] : at[hi]], np.diff(at[lo : hi + 1])) for lo, hi in zip(cuts, cuts[1:])]

    def by_feature(values: np.ndarray) -> np.ndarray:
        """For each feature, the sum of the values of the rows that have it."""
        total = np.zeros(size)
        for lo, hi, own, n in parts:
            total += np.bincount(own, weights=np.repeat(values[lo:hi], n), minlength=size)
        return total

    every, hot = by_feature(np.ones(count)), by_feature(y)
    known = every >= 3
    p, q = 1 + hot, 1 + every - hot
    ratio = np.where(known, np.log((p / p[known].sum()) / (q / q[known].sum())) if known.any() else 0, 0)
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        scaled = ratio * w
        z = b + np.concatenate([sums(scaled[own], np.concatenate([[0], np.cumsum(n)])) for _, _, own, n in parts])
        g = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        grad = np.append(ratio * by_feature(g) + ridge * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return (ratio * w).astype(np.float32), float(b + prior / 2)


def toxicity_model(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fits on the labelled documents for which `learn` (of doc_id) holds: about `sample` of each class, fewer where these are longer than SAMPLE_BYTES in all.

    Null labels don't count; of several labels of a document the largest does. Without labels of both classes every
    weight is 0.
    """
    small_batches(docs.sparkSession)
    marked = labels.where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    length = texts.select("doc_id", F.octet_length("text").alias("bytes"))
    found = marked.join(length, "doc_id").groupBy((F.col("toxic") != 0).alias("hot")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    counts = {r.hot: (r.n, r.bytes or 0) for r in found.collect()}
    totals = tuple(counts.get(k, (0, 0))[0] for k in (False, True))
    part = [min(sample / max(1, n), SAMPLE_BYTES / max(1, size)) for n, size in (counts.get(k, (0, 0)) for k in (False, True))]
    drawn = marked.where(draw(29, F.col("doc_id")) < F.when(F.col("toxic") == 0, part[0]).otherwise(part[1]) * 2.0**48).select("doc_id", "toxic")
    if not sum(totals):
        return fit_ratio_scaled(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool), totals)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.record_batch({"toxic": part.column("toxic").cast(pa.int64()), "features": pa.array([x.astype("<u4").tobytes() for x in ngram_rows(part.column("text"))], pa.binary())})

    found = texts.join(F.broadcast(drawn), "doc_id").select("toxic", "text").mapInArrow(extract, "toxic long, features binary").toArrow()
    toxic = np.asarray(found.column("toxic")) != 0
    features = found.column("features").cast(pa.large_binary()).combine_chunks()
    del found
    _, at, data = features.buffers() if len(features) else (None, None, None)
    at = np.frombuffer(at, np.int64)[: len(features) + 1] // 4 if at is not None else np.zeros(1, np.int64)
    model = fit_ratio_scaled(np.frombuffer(data, "<i4") if data is not None else np.zeros(0, np.int32), at, toxic, totals)
    del features, data, at
    pa.default_memory_pool().release_unused()
    return model


def toxicity_scores(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score (0 to 1) of every row's whole text. Null and empty texts get the score of no feature."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                z = np.array([bias + weights[x].sum(dtype=np.float64) for x in ngram_rows(part.column("text"))])
                yield pa.record_batch({"doc_id": part.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(z, -500, 500)))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents whose score is under 0.5, learnt from the labels outside the held-out fold. All columns stay as they are.

    Null and empty texts have no feature and get the score of the intercept alone, as every text does without labels of
    both classes; they stay unless most labels are toxic. Repeated rows fare alike. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(toxicity_model(docs, labels, remainder("doc_id", 5) != 0))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                yield part.filter(pa.array([bias + weights[x].sum(dtype=np.float64) < 0 for x in ngram_rows(part.column("text"))], pa.bool_()))

    rows = as_rows(docs, text=F.col("text").cast("string"))
    return of_rows(rows.mapInArrow(clean, rows.schema), docs.columns)


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; null ids have remainder 0 of no fold and count as -1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % by, F.lit(-1))


def document_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row, learnt from the labels outside the held-out fold.

    Null and empty texts get the score of no feature; a null id is not held out; repeated rows have a row each. Other
    columns play no part. An empty table gives an empty result.
    """
    scored = toxicity_scores(docs, toxicity_model(docs, labels, remainder("doc_id", 5) != 0))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
