"""Operators on vectors and pages against plain versions, and their odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import extraction, nearest, vector_dedup, wrappers

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, copies int, code long, line int, block int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, x, 1, 2, 3, 4, 5) for i, v, x in rows], SCHEMA)


def sample(seed, count, dim=16, labels=3):
    rng = np.random.default_rng(seed)
    rows, base = [], []
    for i in range(count):
        if base and i % 2:
            k = int(rng.integers(len(base)))
            v, label = base[k][0] + rng.normal(0, rng.choice([0.0, 0.02, 0.06]), dim), base[k][1]
        else:
            v, label = rng.normal(0, 1, dim), int(rng.integers(labels))
            base.append((v, label))
        rows.append((i, [float(x) for x in v.astype(np.float32)], label))
    return rows


ODD = [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] * 16, 1), (9003, [float("inf")] + [1.0] * 15, 1), (9004, [1.0, None] + [1.0] * 14, 1), (9005, [1.0] * 3, 1)]


def good(rows):
    keep = [(i, v, x) for i, v, x in rows if i is not None and v and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    m = np.array([v for _, v, _ in keep], float)
    return [i for i, _, _ in keep], m / np.linalg.norm(m, axis=1, keepdims=True), [x for *_, x in keep]


@pytest.mark.parametrize("block", [4, 2000])
def test_linked_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rows = [*sample(1, 160), *ODD, (9006, [1.0] * 16, None), (9007, [1e-30] * 16, 1), (9008, [2e-30] * 16, 1)]
    out = {r.vec_id: r for r in vector_dedup.linked_vectors(vectors(spark, [*rows, (None, [1.0] * 16, 1)])).where("vec_id IS NOT NULL").collect()}
    ids, m, labels = good(rows)
    near = (m @ m.T >= 0.98) & np.equal.outer(labels, labels) & np.array([x is not None for x in labels])[:, None]
    np.fill_diagonal(near, False)
    low = np.array(ids)
    while True:
        new = np.minimum(low, np.where(near, low[None], 1 << 60).min(1))
        if (new == low).all():
            break
        low = new
    assert {i: (n, c) for i, n, c in zip(ids, near.sum(1).tolist(), low.tolist())} == {i: (out[i].n_links, out[i].component_id) for i in ids}
    assert near.any() and all(out[i].n_links == 0 and out[i].component_id == i and out[i].kept for i in range(9000, 9007))
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.values()) and len(out) == len(rows)
    assert vector_dedup.linked_vectors(vectors(spark, rows).limit(0)).count() == 0
    assert vector_dedup.linked_vectors(vectors(spark, ODD[:2])).count() == 2


def test_no_more_rows_than_vectors(spark, monkeypatch):
    """Keys, of which a vector enters hundreds, are no rows of a table; nor are pairs of blocks."""
    written, put = [], vector_dedup.Stash.put

    def counted(stash, df, *by):
        out = put(stash, df, *by)
        written.append(out.count())
        return out

    monkeypatch.setattr(vector_dedup.Stash, "put", counted)
    monkeypatch.setattr(vector_dedup, "SHARED", 100)
    monkeypatch.setattr(vector_dedup, "TASK", 100)
    rows = sample(4, 600)
    out = {r.vec_id: r.n_links for r in vector_dedup.linked_vectors(vectors(spark, rows)).collect()}
    ids, m, labels = good(rows)
    near = (m @ m.T >= 0.98) & np.equal.outer(labels, labels)
    assert out == dict(zip(ids, (near.sum(1) - 1).tolist())) and near.sum() > 700
    assert 0 < max(written) <= len(rows)


def test_equal_but_for_the_sign_of_zero(spark):
    rows = [(3, [0.0, 1.0, 2.0], 1), (5, [-0.0, 1.0, 2.0], 1), (7, [9.0, 0.0, -2.0], 1)]
    out = vector_dedup.linked_vectors(vectors(spark, rows)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == [(3, 1, 3), (5, 1, 3), (7, 0, 7)]


@pytest.mark.parametrize("leaf", [8, 64])
def test_no_bucket_loses_a_link(monkeypatch, leaf):
    """All tables of a label that is dealt by first bits, with a dense heap and a chain: components as by brute force."""
    monkeypatch.setattr(vector_dedup, "LEAF", leaf)
    monkeypatch.setattr(vector_dedup, "TASK", 60)
    rng = np.random.default_rng(6)
    heap = np.eye(48)[0] + rng.normal(0, 0.016, (250, 48))
    chain = np.array([np.cos(a) * np.eye(48)[1] + np.sin(a) * np.eye(48)[2] for a in np.arange(0, 1.5, 0.19)])
    other = rng.normal(0, 1, (400, 48))
    x = np.concatenate([heap, other, other[:200] + rng.normal(0, 0.08, (200, 48)), chain])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = len(x)
    codes = vector_dedup.Codes(x, 0.98)
    places = vector_dedup.Places({7: n}, 0, codes.parts, min(b - a for a, b in codes.spans))
    edges, tasks = [], set()
    for part, (near, check) in enumerate(codes.sketches(x)):
        for task, bits, prefix, at in places.find(part, np.full(n, 7), near):
            buckets = vector_dedup.Buckets(codes, near[at], check[at])
            buckets.search(np.arange(len(at)), bits, prefix)
            buckets.settle()
            edges.append((at, at[buckets.low]))
            tasks.add(task)
    low = vector_dedup.lowest(*(np.concatenate(e) for e in zip(*edges)), n)
    i, j = np.nonzero(x @ x.T >= 0.98)
    exact = vector_dedup.lowest(i, j, n)
    assert (low[i] == low[j]).all() and len(np.unique(low)) > 0.98 * len(np.unique(exact))
    assert len(tasks) > 8 and max(tasks) < places.count and len(np.unique(exact[-len(chain) :])) == 1


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 150)
    rows = [*sample(2, 1200), *ODD, (None, [1.0] * 16, 1), (1201, [1.0] * 16, 1), (1202, [1.0] * 16, 2), (1203, [2.0] * 16, 2), (1250, [1.0] * 16, 0)]
    out = nearest.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
    ids, m, _ = good(rows)
    queries, hits = [k for k, i in enumerate(ids) if i % 50 == 0], 0
    for k in queries:
        own = sorted((r for r in out if r.query_id == ids[k]), key=lambda r: r["rank"])
        score = m @ m[k]
        score[k] = -9
        best = sorted(range(len(ids)), key=lambda x: (-round(score[x], 12), ids[x]))[:5]
        hits += len({ids[x] for x in best} & {r.vec_id for r in own})
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and all(abs(r.score - score[ids.index(r.vec_id)]) < 1e-12 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
    assert hits >= 0.9 * 5 * len(queries)
    assert [r.vec_id for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == 1250][:3] == [1201, 1202, 1203]
    few = nearest.nearest(vectors(spark, rows[:3] + ODD), F.col("vec_id") % 50 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert nearest.nearest(vectors(spark, rows).limit(0), F.col("vec_id") % 50 == 0).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script><style>p{{}}</style></head><body>
<header><a href="/">Site</a></header><nav><ul>{menu}</ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>hidden</p> -->
<aside><p>Side story</p></aside>{main}<div id="comments"><p>Reader says {n}</p></div><form><label>Mail</label><input name=x></form><footer>&copy; me {n}</footer></body></html>"""


def page(rng, main):
    return PAGE.format(menu="".join(f"<li><a href='/{k}'>Item {k}</a></li>" for k in range(rng.randint(2, 6))), main=main, n=rng.randrange(99))


def test_main_texts(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for i in range(40):
        host = f"h{i % 4}.example.org"
        blocks = [f"Paragraph {i} {k} &amp; more&nbsp;text <b>bold</b>\n  <a href=x>link</a> end" for k in range(rng.randint(1, 7))]
        tag = "article" if i % 4 < 2 else "div class=content" if i % 4 == 2 else "div"
        body = "".join(f"<p>{b}</p>" if k % 2 else f"<p>{b}" for k, b in enumerate(blocks))
        extra = "<ul><li>One<li>Two</ul>" if rng.random() < 0.4 else ""
        rows.append((i, f"https://{host}/{i}", page(rng, f"<{tag}><h1>Title {i}</h1>{body}{extra}</{tag.split()[0]}>"), "x"))
        expected[i] = "\n".join([f"Title {i}"] + [f"Paragraph {i} {k} & more text bold link end" for k in range(len(blocks))] + (["One", "Two"] if extra else []))
    rows += [(100, "https://h0.example.org/e", None, "x"), (101, None, "", "x"), (102, "not a url", "just text &lt; &#233;", "x"), (103, "https://h0.example.org/b", "<article><p>Cut <b>off", "x"), (5, rows[5][1], rows[5][2], "x"), (104, "https://long.example/", "<article>" + "<p>ab cd</p>" * 5000 + "</article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, expression string")
    out = extraction.main_texts(df).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    found = {r.page_id: r.text for r in out}
    assert {i: found[i] for i in expected} == expected
    assert [found[i] for i in (100, 101, 102, 103)] == ["", "", "just text < é", "Cut off"]
    assert found[104] == "\n".join(["ab cd"] * 5000)
    assert extraction.main_texts(df.limit(0)).count() == 0


def test_wrapper_inference():
    a = wrappers.skeleton("div T /div p T /p p T /p footer T /footer")[0]
    b = wrappers.skeleton("div T /div p T /p ul li T /li li T /li /ul footer T /footer")[0]
    assert a == "div T /div ( p T /p )+ footer T /footer"
    wrapper = wrappers.infer([a, b])
    assert wrapper == "div T /div ( p T /p )+ ul? ( li T /li )+? /ul? footer T /footer"
    assert wrappers.slots(a, wrapper) == (0, 1, 3) and wrappers.slots(b, wrapper) == (0, 1, 2, 3)
    assert wrappers.skeleton("p T /p p T /p x")[1] == (0, 0)


def test_every_text_has_a_slot_or_a_zone():
    """A run that stands once where the wrapper has a group, with optional items in between, is aligned inside the group."""
    pages = ["article p T /p /article section h2 T /h2 ul li T /li /ul /section", "article ( p T /p )+ /article section h2 T /h2 /section", "article ( p T /p h2 T /h2 )+ /article"]
    wrapper = wrappers.infer(pages)
    found = [wrappers.slots(p, wrapper) for p in pages]
    assert all(s >= 0 or s == wrappers.OWN_INSIDE for f in found for s in f)
    zones = wrappers.slot_zones(wrapper)
    assert all(zones[f[0]] == 1 for f in found if f[0] >= 0)
    assert wrappers.slots("nav T /nav article b T /b /article div T /div", "ul ( li T /li )+ /ul") == (-1, wrappers.OWN_INSIDE, wrappers.OWN_REST)


def test_first_paragraphs_stay(spark):
    p1 = "<article><p>one first</p></article><section><h2>one s</h2><ul><li>one l</ul></section>"
    p2 = "<article><p>two first</p><p>two second</p></article><section><h2>two s</h2></section>"
    p3 = "<article><p>three first</p><h2>three h</h2><p>three second</p><h2>three i</h2></article>"
    rows = [(i, "http://three.example/", p) for i, p in enumerate((p1, p2, p3))]
    out = {r.page_id: r.text.split("\n") for r in extraction.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[i][0] for i in range(3)] == ["one first", "two first", "three first"]
    assert out[1][:2] == ["two first", "two second"] and out[2] == ["three first", "three h", "three second", "three i"]


def test_many_expressions_of_a_host(spark, monkeypatch):
    monkeypatch.setattr(extraction, "FAN", 3)
    rng = random.Random(5)
    rows, expected = [], {}
    for i in range(60):
        inner = "".join(rng.choice([f"<p>a{i}</p>", f"<h2>b{i}</h2>", f"<ul><li>c{i}</ul>", f"<blockquote>d{i}</blockquote>", f"<table><tr><td>e{i}</table>"]) for _ in range(rng.randint(1, 6)))
        rows.append((i, "http://one.example/", f"<nav><li>m{i}</nav><article>{inner}</article><footer>f</footer>"))
        expected[i] = "\n".join(c for c in inner.replace("</", "<").split(">") for c in [c.split("<")[0]] if c)
    out = {r.page_id: r.text for r in extraction.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == expected


def test_templates_and_copies_of_one_host(spark):
    mixed = [(i, "http://two.example/", f"<nav>menu</nav><article><p>article {i} has a text</p></article>" if i % 5 == 0 else f"<nav>menu</nav><div><p>plain page {i} has a text</p></div>") for i in range(20)]
    copies = [(100 + i, "http://copies.example/", "<div><p>the same text on each page</p></div>") for i in range(12)] + [(200, "http://copies.example/", "<section><h2>another page</h2></section>")]
    out = {r.page_id: r.text for r in extraction.main_texts(spark.createDataFrame(mixed + copies, "page_id long, url string, html string")).collect()}
    assert out == {i: f"article {i} has a text" if i % 5 == 0 else f"plain page {i} has a text" for i in range(20)} | {100 + i: "the same text on each page" for i in range(12)} | {200: "another page"}
