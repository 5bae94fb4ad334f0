"""Operators on documents against plain versions, and their odd inputs."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm import mixing, packing, paragraphs, repeats, shingle_join, text_links, tokens, toxicity
from quillspark.llm.arrays import shingles, utf8
from quillspark.llm.components import components
from quillspark.llm.language import document_language
from quillspark.llm.storage import Stash

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item long, key string, root int, size int, part string, copies int, first int, rank int"
ODD = ["", " \t\n", "a", "Ünï çödé ß İ ﬁ", "<|endoftext|> x<|startoftext|>", "日本語 テキスト", "🙂🙂", "it's WE'LL 'S", "1234 5,6.7", "x\x1cy\x0bz\x85w", "\x00\x01", "á ́", "a" * 3000, "word " * 5000]


def documents(spark, rows):
    """rows: (doc_id, text[, lang, source]); the other columns clash with names that operators use."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None, 1, "k", 2, 3, "p", 4, 5, 6) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingle_set(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def plain_components(sets, num, den):
    """sets: id -> set; smallest id reachable."""
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    return {i: root(i) for i in sets}


def near_copies(seed, count=60):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)]
    out = {}
    for i in range(count):
        if i % 3 and out:
            base = words(out[rng.choice([*out])])
            for _ in range(rng.randint(0, 4)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(vocabulary)
            out[i] = " ".join(base)
        else:
            out[i] = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 40, 120])))
    return out


# Words and shingles


@pytest.mark.parametrize("size", [1, 3, 5])
def test_shingles(size):
    import pyarrow as pa

    texts = ["A b  c\nd", "", None, "one", "x y z x y z x", "\x0b\x0ca", *ODD]
    row, token = shingles(*utf8(pa.array(texts)), size)
    assert np.bincount(row, minlength=len(texts)).tolist() == [len(shingle_set(t, size)) for t in texts]
    r2, t2 = shingles(*utf8(pa.array(["q", "a B c D", *texts])), size)
    assert set(token[row == 0]) == set(t2[r2 == 1])


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7), (None, 3), (500, i) if False else (500, 501)]
    df = spark.createDataFrame([e for e in edges if None not in e] + [(None, 1)], "a long, b long")
    found = {r.node: r.root for r in components(df, Stash(spark)).collect()}
    up = {}
    for a, b in edges:
        if a is None or a == b:
            continue
        up.setdefault(a, a), up.setdefault(b, b)
        ra, rb = a, b
        while up[ra] != ra:
            ra = up[ra]
        while up[rb] != rb:
            rb = up[rb]
        up[max(ra, rb)] = min(ra, rb)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    assert found == {i: root(i) for i in up}
    assert components(df.limit(0), Stash(spark)).count() == 0


# Mixing


def test_flow_prefers_few_repetitions():
    flow = mixing.cheapest_flow({("a",): 10, ("a", "b"): 10, ("b",): 5}, {"a": 20, "b": 12})
    given = {p: sum(f.values()) for p, f in flow.items()}
    assert sum(f.get("a", 0) for f in flow.values()) == 20 and sum(f.get("b", 0) for f in flow.values()) == 12
    assert max(given[p] / n for p, n in {("a",): 10, ("a", "b"): 10, ("b",): 5}.items()) <= 2
    assert sum(max(0, given[p] - n) for p, n in {("a",): 10, ("a", "b"): 10, ("b",): 5}.items()) == 7  # 25 words once, 7 again
    assert mixing.cheapest_flow({("a",): 2}, {"a": 100}) == {("a",): {"a": 6}}
    assert mixing.cheapest_flow({}, {}) == {}


def test_targets():
    found = mixing.reshared_targets({"a": 10, "b": 1, "c": 100}, {"a": 1, "b": 2, "c": 3}, 111)
    assert found["b"] == 3 and abs(sum(found.values()) - 111) < 1e-9 and found["a"] * 3 == pytest.approx(found["c"])
    assert mixing.reshared_targets({"a": 0, "b": 5}, {"a": 1, "b": 2}, 5) == {"a": 0, "b": 5}


def test_mixture(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), "en", rng.choice(["b", "a", None, "Z"])) for i in range(600)] + [(7, "w w w", "en", "a"), (7, "w w w", "en", "a"), (None, "x y", "en", "b"), (9000, None, "en", "only null")]
    df = documents(spark, rows)
    found, mixture = mixing.mix_documents(df)
    out = found.collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in out)
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((r[0], len(words(r[1]))) for r in rows)
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
    assert [mixing.rotating_weights(["Z", "a", "b", "only null", None])[s] for s in ("Z", None)] == [1, 2]
    for s, group in by.items():
        assert {r.source_size for r in group} == {sum(r["size"] for r in group)} and {r.target for r in group} == {mixture.targets[s]}
        assert abs(sum(r.taken for r in group) - group[0].target) <= 30
    again = mixing.mix_documents(df)[0].collect()
    assert Counter(again) == Counter(out)
    kept = mixing.mixed_documents(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i: n for i, n in Counter({r.doc_id: 0 for r in out} | {}).items() if n}) + Counter(x for r in out if r["size"] for x in [r.doc_id] * r.copies)
    assert mixing.mix_documents(df.limit(0))[0].count() == 0


# Tokens and packing


def test_token_counts(spark):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("abcdeinthor'é1-. \n") for _ in range(40)) for _ in range(300)]
    df = documents(spark, [*enumerate(texts), (None, None), (3, texts[3])])
    out = tokens.token_counts(df, PATH, limit=1000).collect()
    expected = [(i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in [*enumerate(texts), (3, texts[3])]] + [(None, 0, 0)]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == Counter((*e, e[2] > 1000) for e in expected)
    assert tokens.token_counts(df.limit(0), PATH).count() == 0


def test_packing(spark):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(6)
    texts = ODD + [" ".join("abc"[: rng.randint(1, 3)] for _ in range(rng.randint(1, 60))) for _ in range(200)]
    rows = [*enumerate(texts), (None, None), (5, texts[5]), (5, texts[5])]
    df = documents(spark, rows)
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [0]
    cap = 64
    out = packing.pack_documents(df, PATH, cap).collect()
    expected = Counter()
    for i, t in rows:
        x = ids(t)
        for k in range(0, len(x), cap):
            expected[i, k // cap, k, len(x[k : k + cap]), zlib.crc32(np.array(x[k : k + cap], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= cap
    assert len(sequences) <= -(-sum(r.length for r in out) // cap) * 1.05 + 1
    assert packing.pack_documents(df.limit(0), PATH, cap).count() == 0
    with_ids = packing.token_pieces(df.where("doc_id = 3"), PATH, cap, with_ids=True).first()
    assert with_ids.ids == ids(texts[3])[:cap]


def plain_best_fit(counts, cap):
    """Free room of each sequence by best fit, longest first, one document after another."""
    free = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fit = min((room for room in free if room >= n), default=None)
            if fit is None:
                free.append(cap - n)
            else:
                free[free.index(fit)] = fit - n
    return free


@pytest.mark.parametrize("seed", range(3))
def test_best_fit_moves(spark, seed):
    rng = random.Random(seed)
    counts = {n: rng.randint(1, 400) for n in rng.sample(range(1, 101), 30)}
    table = spark.createDataFrame([*counts.items()], "length long, count long")
    used, seen = defaultdict(list), defaultdict(list)
    for length, rank, room, sequence, many in packing.best_fit_moves(table, 100, Stash(spark)).collect():
        seen[length] += range(rank, rank + many)
        for k in range(many):
            used[sequence + k].append((100 - room, length))
    assert {n: sorted(ranks) for n, ranks in seen.items()} == {n: [*range(c)] for n, c in counts.items()}
    assert sorted(used) == [*range(len(used))] and len(used) <= 1.01 * len(plain_best_fit(counts, 100)) + 1
    for spans in used.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 100


@pytest.mark.parametrize("seed", range(20))
def test_successor_sweep_by_blocks(seed):
    """Sweeps of blocks, then of what they left, move what one sweep moves: each document, longest first, to the smallest free gap."""
    rng = random.Random(seed)
    lengths = {n: rng.randint(1, 9) for n in rng.sample(range(1, 60), 12)}
    rooms = [(rng.randint(1, 60), 10 * k, rng.randint(1, 9)) for k in range(12)]
    columns = [c.split()[0] for c in packing.RUN.split(", ")]
    runs = pd.DataFrame([(packing.DOCUMENTS, n, 0, 0, 0, c) for n, c in lengths.items()] + [(packing.GAPS, 0, 0, *r) for r in rooms], columns=columns)
    blocks = [packing.successor_sweep(part) for _, part in runs.groupby((runs["length"] + runs["room"]) // 16)]
    found = Counter()
    for kind, length, _, room, _, many in packing.successor_sweep(pd.concat(blocks)).itertuples(index=False):
        found[kind, length, room] += many
    free, expected = [room for room, _, many in rooms for _ in range(many)], Counter()
    for n in sorted(lengths, reverse=True):
        for _ in range(lengths[n]):
            fit = min((room for room in free if room >= n), default=None)
            if fit is None:
                expected[packing.DOCUMENTS, n, 0] += 1
            else:
                free.remove(fit)
                expected[packing.MOVES, n, fit] += 1
    assert found == expected + Counter((packing.GAPS, 0, room) for room in free)


def test_lengths_that_do_not_fit(spark):
    for odd in (None, 0, 101):
        rows = spark.createDataFrame([(1, 0, 0, odd, 5)], packing.PIECE)
        with pytest.raises(ValueError):
            packing.pack(rows, 100)


# Near copies


@pytest.mark.parametrize("size, num", [(3, 90), (5, 80)])
def test_shingle_join(spark, size, num):
    rows = near_copies(size)
    odd = {1000: "", 1001: None, 1002: "  ", 1003: "one two", 1004: "one two", 1005: "ONE  two", 1006: "long " * 4000, 1007: "long " * 3000}
    found = shingle_join.join_shingles(documents(spark, [*rows.items(), *odd.items(), (None, "one two"), (3, rows[3])]), size=size, num=num).collect()
    sets = {i: shingle_set(t, size) for i, t in (rows | odd).items()}
    expected = plain_components(sets, num, 100)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == Counter((i, len(sets[i]), expected[i]) for i in [*sets, 3]) + Counter([(None, 1, None)])


def test_rows_of_one_id_with_unlike_texts(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(1, "something else"), (1, long), (1, "a third text here"), (2, long.replace("w50", "x")), (3, "a third text here")]
    found = shingle_join.join_shingles(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.component_id) for r in found) == Counter([(1, 1)] * 3 + [(2, 1), (3, 1)])


def test_shingle_join_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK", 7)
    monkeypatch.setattr(text_links, "BLOCK", 5)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = {}
    for i in range(60):
        copy = list(base)
        for _ in range(i % 3):
            copy[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows[i] = " ".join(copy)
    found = shingle_join.join_shingles(documents(spark, [*rows.items()])).collect()
    expected = plain_components({i: shingle_set(t, 3) for i, t in rows.items()}, 90, 100)
    assert {r.doc_id: r.component_id for r in found} == expected


def test_keys_of_other_items_with_equal_sums_stay(spark):
    from pyspark.sql import functions as F

    mark = {r.id: r.m for r in spark.range(3000).select("id", F.pmod(F.xxhash64("id"), F.lit(1 << 31)).alias("m")).collect()}
    seen, pairs = {}, []
    for a in mark:
        for b in range(a):
            other = seen.setdefault(mark[a] + mark[b], (a, b))
            if not {a, b} & {*other}:
                pairs = [other, (a, b)]
                break
        if pairs:
            break
    entries = [(k, i) for k, pair in ((1, pairs[0]), (2, pairs[1]), (3, pairs[1])) for i in pair] + [(4, 7)]
    found = text_links.shared_keys(spark.createDataFrame(entries, "key long, item long"), Stash(spark)).collect()
    assert {(r.key, r.item, r.many) for r in found} == {(k, i, 2) for k, pair in ((1, pairs[0]), (2, pairs[1])) for i in pair}


def test_one_of_each_group_by_row(spark):
    """A repeated id doesn't take texts with it of which no copy is left."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, 7), (2, a, 7), (2, b, 7), (3, b + " more", 7), (4, c, 7), (4, c + " one", 7), (5, c, 8), (5, c, 9), (None, a, 7), (6, None, 7), (6, None, 7), (6, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark long").repartition(3)
    kept = [tuple(r) for r in shingle_join.one_of_each_group(df).collect()]
    assert {r[:2] for r in kept} - {(4, c), (4, c + " one")} == {(1, a), (2, b), (None, a), (6, None), (6, "")}
    assert len(kept) == 7 and sum(r[0] == 4 for r in kept) == 1
    alone = spark.createDataFrame([(5, c, 8), (5, c, 9), (7, b, 1)], df.schema)
    assert sorted(map(tuple, shingle_join.one_of_each_group(alone).collect())) == [(5, c, 8), (7, b, 1)]


def test_many_edges_dont_overflow(spark):
    from quillspark.llm.components import _state

    count, *marks = _state(spark.range(20_000_000).selectExpr("id + 1 AS a", "id AS b"))
    assert count == 20_000_000 and all(marks)


def test_one_of_each_group(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "z y x w"), (3, "z y x w"), (None, "q"), (4, None)]
    df = documents(spark, rows)
    out = shingle_join.one_of_each_group(df, size=5, num=80)
    assert out.columns == df.columns and Counter(r.doc_id for r in out.collect()) == Counter([1, 3, None, 4])


def test_passages(spark):
    rng = random.Random(2)
    line = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(200)) for _ in range(n))
    shared, other = line(60), line(45)
    near = shared.replace(" ", "  ").replace(shared.split()[30], "changed")
    rows = [(1, f"{line(50)}\n{shared}"), (2, shared), (3, f"{near}\n\n{line(9)}\n{other}"), (4, line(80)), (5, f"{other}\n{other}"), (6, None), (7, ""), (None, shared), (8, "short line\nshort line")]
    df = documents(spark, rows)
    out = paragraphs.repeated_passages(df).collect()
    assert {(r.doc_id, r.para, r.first_doc_id, r.removed) for r in out} == {(1, 1, 1, False), (2, 0, 1, True), (3, 0, 1, True), (3, 3, 3, False), (5, 0, 3, True), (5, 1, 3, True)}
    left = {r.doc_id: r.text for r in paragraphs.without_repeats(df).collect()}
    assert left.keys() == {1, 3, 4, 6, 7, None, 8} and left[3] == "\n".join(rows[2][1].split("\n")[1:]) and left[1] == rows[0][1]
    assert paragraphs.without_repeats(df).columns == df.columns
    assert paragraphs.repeated_passages(df.limit(0)).count() == 0


def test_passages_like_brute_force(spark):
    rng = random.Random(11)
    rows, sets = [], {}
    pool = [[rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(rng.randint(40, 120))] for _ in range(25)]
    for i in range(60):
        lines = []
        for k in range(rng.randint(1, 3)):
            w = list(rng.choice(pool))
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "e%d" % rng.randrange(99)
            lines.append(" ".join(w))
            sets[i, k] = shingle_set(lines[-1], 5)
        rows.append((i, "\n".join(lines)))
    expected = plain_components(sets, 80, 100)
    many = Counter(expected.values())
    out = paragraphs.repeated_passages(documents(spark, rows), miss=1e-6).collect()
    assert {(r.doc_id, r.para): r.removed for r in out} == {p: p != c for p, c in expected.items() if many[c] > 1}


def test_passages_inside_lines_and_over_short_lines(spark):
    rng = random.Random(21)
    some = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(3000)) for _ in range(n)]
    a, b, c = some(51), some(60), some(50)
    pair, early = some(30), some(20)
    one, two, three = (" ".join(some(70)) for _ in range(3))
    short = lambda w: "\n".join(" ".join(w[i : i + 12]) for i in range(0, len(w), 12))
    rows = [(1, f"{one} {' '.join(a)} {two}"), (2, f"{three} {' '.join(a).upper()} end\nlast  line"), (3, short(b)), (4, f"head\n{short(b)}\ntail"), (5, " ".join(c + some(60))), (6, " ".join(some(60) + c)), (7, " ".join(early + pair)), (8, " ".join(early + pair + some(40))), (9, " ".join(["again"] * 200)), (None, " ".join(b))]
    df = documents(spark, rows)
    runs = {(r.doc_id, r.word, r.n_words, r.first_doc_id, r.removed) for r in paragraphs.all_repeats(df).where("word IS NOT NULL AND doc_id < 9").collect()}
    assert runs == {(1, 70, 51, 1, False), (2, 70, 51, 1, True), (3, 0, 60, 3, False), (4, 1, 60, 3, True)}
    left = {r.doc_id: (r.text, r.n_chars) for r in paragraphs.without_repeats(df).collect()}
    expected = {i: (t, None) for i, t in rows} | {2: (f"{three} end\nlast  line", len(three) + 15), 4: ("head\ntail", 9), 9: (" ".join(["again"] * 51), 51 * 6 - 1)}
    assert left == expected


@pytest.mark.parametrize("seed, hot", [(0, repeats.HOT), (1, 1), (1, 40)])
def test_verbatim_repeats_like_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "HOT", hot)  # 1: all keys are shuffled, 40: some
    rng = random.Random(seed)
    pool = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(30, 90))] for _ in range(12)] + [["x"] * 70, ["p", "q", "r"] * 30]
    rows = []
    for i in range(80):
        w = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            lo = rng.randrange(len(p) // 2)
            w += p[lo : rng.randint(lo, len(p))] + [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 5))]
        rows.append((i, "".join(x + rng.choice([" ", "\n", "  "]) for x in w)))
    places = defaultdict(list)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 50):
            places[tuple(w[k : k + 51])].append((i, k))
    parts = Counter((tuple(w[k : k + repeats.WORDS])) for w in map(words, dict(rows).values()) for k in range(len(w) - repeats.WORDS + 1))
    again = {(i, k + n) for i, t in rows for w in [words(t)] for k in range(len(w) - repeats.WORDS + 1) if parts[tuple(w[k : k + repeats.WORDS])] > 1 for n in range(repeats.WORDS)}
    held = {(i, k + n) for x in places.values() if len(x) > 1 for i, k in x for n in range(repeats.LONG)}
    df = documents(spark, rows)
    found = repeats.verbatim_repeats(df).collect()
    covered = {(r.doc_id, r.word + n) for r in found for n in range(r.n_words)}
    # At the ends of a chain, words may stay that only another place than the paragraph's first one shares.
    assert covered <= again and len(held) > 100 and len(held - covered) <= 0.01 * len(held)
    assert {(i, k) for x in places.values() if len(x) > 1 for i, k in x if not any((i, k + n) in covered for n in range(51))} == set()
    gone = {r.doc_id: words(r.text) for r in paragraphs.without_repeats(df, min_words=1000).collect()}
    left = Counter(tuple(w[k : k + 51]) for w in gone.values() for k in range(len(w) - 50))
    assert all(n == 1 or p not in places for p, n in left.items())
    assert {x for w in gone.values() for x in w} == {x for _, t in rows for x in words(t)}


# Classifiers


def fold(i, by):
    return zlib.crc32(str(i).encode()) % by


def test_toxicity(spark):
    rng = random.Random(4)
    clean = [f"word{i}" for i in range(150)]
    rows, labels = [], []
    for i in range(700):
        w = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["nastyblob", "grimslur", "vileterm"]) + rng.choice("abc"))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    extra = [(9001, None), (9002, ""), (None, "nastybloba"), (5, rows[5][1])]
    df, marks = documents(spark, rows + extra), spark.createDataFrame([*labels, (None, 1), (5000, None), (3, 0)], "doc_id long, toxic int")
    out = toxicity.document_toxicity(df, marks).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows + extra)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and fold(r.doc_id, 5) == 0) for r in out)
    truth = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    kept = toxicity.without_toxic(df, marks)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {9001, 9002}
    assert toxicity.document_toxicity(df.limit(0), marks).count() == 0
    none = toxicity.document_toxicity(df, marks.limit(0)).collect()
    assert len({r.score for r in none}) == 1


def test_language(spark):
    rng = random.Random(8)
    syllables = {"aa": ["ka", "ro", "mi", "tu"], "bb": ["sch", "ung", "ein", "zt"], "cc": ["ó", "ci", "ña", "rr"]}
    rows = []
    for i in range(600):
        lang = rng.choice([*syllables])
        text = " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 40)))
        rows.append((i, text, lang))
    extra = [(7001, None, "aa"), (7002, "123 !!", "bb"), (7003, "karo", None), (None, "schung ein", "bb"), (1, rows[1][1], rows[1][2])]
    out = document_language(documents(spark, rows + extra)).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows + extra)
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    assert {r.doc_id: (r.lang_pred, r.score) for r in out if r.doc_id in (7001, 7002)} == {7001: ("und", 0.0), 7002: ("und", 0.0)}
    mixed = document_language(documents(spark, [*rows, (8000, " ".join([rows[0][1]] + [t for _, t, x in rows if x != rows[0][2]][:1]) * 3, None)])).where("doc_id = 8000").first()
    assert mixed.n_languages == 2
    assert {r.lang_pred for r in document_language(documents(spark, [(1, "text", None)])).collect()} == {"und"}
    assert document_language(documents(spark, rows[:1]).limit(0)).count() == 0
