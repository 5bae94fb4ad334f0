"""Quality rules, collocations and importance resampling against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm.collocations import collocations
from quillspark.llm.importance import resample
from quillspark.llm.quality import Ensemble, Rule, document_quality, fit_rules, lasso, statistics

DOCS = "doc_id long, text string, lang string, source string, f long, phrase string, key string, `a.b` string, size double, row long, rank long, n long"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "p", "k", "x", 0.5, 3, 4, 5) for r in rows], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def made_up(seed, count, words=40, vocabulary=60):
    draws = np.random.default_rng(seed)
    names = ["Of", "the", "É", "ñu", "x1"] + [f"w{i}" for i in range(vocabulary)]
    out = []
    for i in range(count):
        at = np.minimum(draws.geometric(0.12, draws.integers(0, words)) - 1, len(names) - 1)
        text = "".join(names[k] + draws.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "; ", "\r\n", "\x0b"]) for k in at)
        out.append((i, text, draws.choice(["en", "de", "und"])))
    return out


def plain_collocations(rows, max_n, least, num, den, top):
    found = {}
    for lang in sorted({r[2] or "und" for r in rows}):
        f, n = Counter(), 0
        for _, text, own in rows:
            if (own or "und") != lang:
                continue
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
                w = re.findall(r"[^\x20\x09]+", piece)
                n += len(w)
                f.update(" ".join(w[i : i + k]) for k in range(1, max_n + 1) for i in range(len(w) - k + 1))
        candidates = {p: c for p, c in f.items() if " " in p and c >= least}
        out = []
        for p, a in candidates.items():
            w = p.split(" ")
            held = lambda g: any(g.split(" ")[i : i + len(w)] == w for i in range(len(g.split(" "))))
            if any(len(g) > len(p) and den * c >= num * a and held(g) for g, c in candidates.items()):
                continue
            cuts = [(1_000_000 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.append((score, a, p, f[" ".join(w[:k])], f[" ".join(w[k:])]))
        out.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        found |= {(lang, i): (p, a, left, right, n, score) for i, (score, a, p, left, right) in enumerate(out[:top], 1)}
    return found


@pytest.mark.parametrize("max_n,top", [(3, 2000), (4, 7)])
def test_collocations(spark, max_n, top):
    rows = [*made_up(3, 220), (1, "the of THE of the of", None), (None, "the of the of", None), (1, None, "en"), (7, "", None), (8, "one " * 30, "xx"), (9, "a b c " * 12, "xx"), (9, "a b c " * 12, "xx")]
    found = {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations(documents(spark, rows).repartition(5), max_n, 6, (50, 100), top).collect()}
    assert found == plain_collocations(rows, max_n, 6, 50, 100, top)
    assert len(found) > 20 and ("xx", 1) in found


def test_collocations_of_nothing(spark):
    assert collocations(documents(spark, []).limit(0)).count() == 0
    assert collocations(documents(spark, [(1, "a b", "en"), (2, None, None)])).count() == 0


def test_collocations_beyond_64_bits(spark):
    """a * a * 1,000,000 of these counts has more than 64 bits."""
    from quillspark.llm.collocations import scored

    big = 5_000_000_000
    rows = spark.createDataFrame([("en", "x y", big), ("en", "x", big + 7), ("en", "y", big + 11)], "lang string, phrase string, f long")
    assert scored(rows).first().score == 1_000_000 * big * big // ((big + 7) * (big + 11))


def plain_resample(rows, target, num=5, den=100, least=20):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    bucket = lambda x: zlib.crc32(x.encode()) % 10000
    own, wanted = [features(t) for _, t, _ in rows], [features(t)[1] for t in target]
    s, t = Counter(bucket(x) for _, f in own for x in f), Counter(bucket(x) for f in wanted for x in f)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1.0) * (all_s + 10000.0)) / ((s[b] + 1.0) * (all_t + 10000.0))))
    out = []
    for (i, _, _), (n, f) in zip(rows, own):
        weight, score = sum(gain(bucket(x)) for x in f), None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, n])
    able = sorted((x for x in out if x[4] >= least and x[3] is not None), key=lambda x: (-x[3], x[0]))
    ranks = {id(x): k for k, x in enumerate(able[: num * len(able) // den], 1)}
    return sorted(((*x[:4], ranks.get(id(x))) for x in out), key=repr)


@pytest.mark.parametrize("share", [(5, 100), (60, 100), (100, 100), (0, 100)])
def test_resample(spark, share):
    rows = [*made_up(11, 150, 60), (3, None, "en"), (4, "", "en"), (5, "the the the " * 9, None), (None, "w1 w2 w3 " * 20, "en"), (9, "w1\x00w2 w3 É É", "en"), (200, "the of " * 15, "en"), (200, "the of " * 15, "en")]
    target = ["The of É w3", None, "", "w1 w2 w3 w4 w5", "the the the"]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, bucket int")
    found = resample(documents(spark, rows).repartition(4), benchmark, share).collect()
    got = sorted((tuple(r) for r in found), key=repr)
    expected = plain_resample(rows, target, *share)
    no_rank = lambda x: [r[:4] for r in x]
    assert no_rank(got) == no_rank(expected)
    assert sorted(r[4] for r in got if r[4]) == sorted(r[4] for r in expected if r[4])
    assert {(r[3], r[0], r[4]) for r in got if r[0] != 200} == {(r[3], r[0], r[4]) for r in expected if r[0] != 200}  # 200 comes twice


def test_joined_checksums():
    from quillspark.llm.importance import joined_crc

    draws = np.random.default_rng(1)
    pairs = [(draws.bytes(int(a)), draws.bytes(int(b))) for a, b in draws.integers(0, 200, (300, 2))] + [(b"x", bytes(70_000)), (b"", b""), (b"y" * 9, draws.bytes(1 << 20))]
    left, right = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    assert joined_crc(left, right, np.array([len(b) for _, b in pairs])).tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_resample_of_nothing(spark):
    target = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert resample(documents(spark, []).limit(0), target).count() == 0
    one = resample(documents(spark, [(1, "a b " * 30, "en"), (2, "c", "en")]), target.limit(0), (1, 1)).orderBy("doc_id").collect()
    assert [r["rank"] for r in one] == [1, None] and one[0].weight < 0


def junk(draws, i):
    words = ["".join(draws.choice(list("abcdefghij"), draws.integers(2, 8))) for _ in range(draws.integers(30, 80))]
    kind = i % 4
    if kind == 0:
        return " ".join(w for w in words[:8] for _ in range(9))
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    return " ".join(w + ("***" if kind == 2 else " |") for w in words)


def clean(draws):
    words = ["".join(draws.choice(list("abcdefghij"), draws.integers(2, 8))) for _ in range(draws.integers(30, 80))]
    return " ".join(words).capitalize() + "."


def test_quality_held_out(spark):
    draws = np.random.default_rng(8)
    rows = [(i, junk(draws, i // 3) if i % 3 == 0 else clean(draws), "en") for i in range(900)]
    extra = [(None, clean(draws), "en"), (5000, None, "en"), (5001, "", "en"), (1, rows[1][1], "en"), (5002, "long word " * 200_000, "en")]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(900)] + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    found = document_quality(documents(spark, rows + extra).repartition(4), labels).collect()
    assert len(found) == 905 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    held = [r for r in found if r.held_out and r.doc_id < 900]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in found if r.doc_id is not None)
    right = sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) / len(held)
    assert len(held) > 200 and right > 0.97
    assert len({r.score for r in found if r.doc_id == 1}) == 1
    assert len({r.score for r in found if r.doc_id in (5000, 5001)}) == 1


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = documents(spark, [(1, "a", "en"), (2, None, "en")])
    assert {r.score for r in document_quality(docs, labels).collect()} == {0.5}
    assert document_quality(docs.limit(0), labels).count() == 0
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in document_quality(docs, one).collect()) or zlib.crc32(b"1") % 3 == 1


def test_rules_compile_to_what_they_say(spark):
    draws = np.random.default_rng(2)
    rows = {"size": draws.random(400).round(2), "symbols": draws.random(400).round(2), "stops": draws.random(400).round(1)}
    y = ((rows["size"] > 0.4) & (rows["symbols"] <= 0.7)).astype(float)
    model = fit_rules(rows, y, np.ones(400))
    assert 0 < len(model.weights) < 60
    names = list(rows)
    df = spark.createDataFrame([tuple(float(rows[n][i]) for n in names) for i in range(400)], ", ".join(f"{n} double" for n in names))
    got = np.array([r.c for r in df.select(model.column().alias("c")).collect()])
    assert np.allclose(got, model.chances(rows)) and ((got >= 0.5) == y).mean() > 0.98
    assert Rule.of((("size", True, 0.2), ("size", True, 0.5), ("stops", False, 0.3))).tests == (("size", True, 0.5), ("stops", False, 0.3))
    assert Ensemble(0.0, {}).column() is not None


def test_lasso_leaves_few(spark):
    draws = np.random.default_rng(4)
    x = (draws.random((500, 30)) < 0.5).astype(float)
    y = x[:, 0]
    w, _ = lasso(x, y, np.full(500, 1 / 500), 0.02)
    assert abs(w[0]) > 1 and np.count_nonzero(np.abs(w[1:]) > 1e-6) <= 2

    def loss(v, b):
        p = 1 / (1 + np.exp(-(x @ v + b)))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + 0.02 * np.abs(v).sum()

    best = lasso(x, y, np.full(500, 1 / 500), 0.02, 4000)
    assert loss(w, _) - loss(*best) < 1e-4


def test_statistics(spark):
    df = spark.createDataFrame([("One two two  TWO!\nx1 %%",), (None,), ("",)], "t string")
    one, null, empty = df.select(*(c.alias(n) for n, c in statistics(F.col("t")).items())).collect()
    assert one["repeated"] == 1 / 6 and one["distinct"] == 5 / 6 and one["shouts"] == 1 / 6 and one["symbols"] == 2 / 23
    assert one["capitals"] == 4 / 13 and one["digits"] == 1 / 23
    assert null == empty and set(null) == {0.0}
