"""URL rules, HTML extraction, vectors, components and the pipeline."""

import random

import numpy as np
import pyarrow as pa


def test_url_rules(spark):
    from skylattice.llm.url_rules import HOST_RULES, WORD_RULES, judge

    urls = [None, "", "nourl", "http://Example.COM/en/1?x#y", "https://www.example.com/en/", "http://a.net/es/x", "http://a.net/fr", "http://x.com", "http://free-bets.org/", "x://a.org/p#q?r", "http://notexample.com/en/1"]
    pages = spark.createDataFrame([(i, u, "old", "z") for i, u in enumerate(urls)], "page_id long, url string, rule string, extra string")
    rows = judge(pages, HOST_RULES + WORD_RULES, named=HOST_RULES).orderBy("page_id").collect()
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("example.com", "/en/1", "example.com/en/", "block"),
        ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("a.net", "/es/x", "net/es/", "block"), ("a.net", "/fr", None, "allow"),
        ("x.com", "", None, "allow"), ("free-bets.org", "/", None, "block"), ("a.org", "/p", None, "allow"), ("notexample.com", "/en/1", "com/", "allow"),
    ]
    assert judge(pages.limit(0), HOST_RULES).count() == 0


def test_url_patterns_from_a_table(spark):
    import re

    from skylattice.llm.url_rules import Rule, judge, rules_of

    assert Rule("a", "b", "||ads.example^").tokens() == ["ads", "example"]
    assert Rule("a", "b", "|track*pixel.gif|").tokens() == ["gif"] and Rule("a", "b", "*banner*").tokens() == []
    patterns = [
        ("ads", "block", "||ads.example^", 1), ("gif", "block", "/pixel.gif|", 2), ("start", "allow", "|shop.example/", 2), ("mid", "block", "^promo^*deal^", 0),
        ("tie b", "allow", "^same^", 5), ("tie a", "block", "^same^", 5), ("nul", None, "^x^", 1), ("no rank", "block", "^plain^", None),
    ]
    rules = rules_of(spark.createDataFrame(patterns, "name string, verdict string, pattern string, rank int"))
    assert len(rules) == 7
    urls = ["http://ads.example/", "http://x.ads.example:80/a", "http://badads.example/", "http://a.b/pixel.gif", "http://a.b/pixel.gif/2", "http://shop.example/pixel.gif",
            "http://a.shop.example/", "http://a.b/promo-x/deal", "http://a.b/promox/deals", "http://a.b/same", "http://a.b/same", "http://a.b/" + "long/" * 20_000 + "plain", None]
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls)], "page_id long, url string, best0 int, _best int")
    got = judge(pages, rules, default="none").orderBy("page_id").collect()
    assert pages.columns + ["host", "path", "rule", "verdict"] == list(got[0].asDict())
    for r, u in zip(got, urls, strict=True):
        target = re.sub(r"\A.*?://", "", u) if u else ""
        fit = [x for x in rules if u and re.search(x.regex().replace(r"\z", r"\Z"), target)]
        best = max(fit, key=lambda x: (x.rank, x.name), default=None)
        assert (r["rule"], r["verdict"]) == ((best.name, best.verdict) if best else (None, "none")), u
    assert [r["rule"] for r in got] == ["ads", "ads", None, "gif", None, "start", None, "mid", None, "tie b", "tie b", "no rank", None]
    assert {r["verdict"] for r in judge(pages, ()).collect()} == {"allow"}


def test_html_main_text(spark):
    from skylattice.llm.html_text import extract, fit, sample_pages

    page = (
        '<html><head><title>no</title></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="ad">buy this now</div>'
        "<article><h1>Big &amp; small</h1><p><b>One  two<br>three<p>Four\n five &eacute;.</p><script>var x='</p>';</script></article><footer>&copy; all</footer></body></html>"
    )
    rows = [(0, page, 1), (1, None, 1), (2, "", 1), (3, "<<<>><p", 1), (4, "plain words", 1)]
    got = extract(spark.createDataFrame(rows, "page_id long, html string, text int"), fit(sample_pages(200))).orderBy("page_id").collect()
    assert got[0]["text"] == "Big & small One two three Four five é."
    assert got[1]["text"] == got[2]["text"] == "" and got[1]["n_chars"] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_marginals_match_enumeration():
    from itertools import product
    from math import exp

    from skylattice.llm.html_text import _looks, fit, parse, sample_pages

    model = fit(sample_pages(50))
    page = parse("<div class=ad><p>a</p></div><article><p>b c d</p><ul><li>e</li></ul></article>")
    holds = {i for i, _ in page.pieces}
    total, on = 0.0, [0.0] * len(page.nodes)
    for labels in product((0, 1), repeat=len(page.nodes)):
        s = model.root[labels[0]]
        for i, node in enumerate(page.nodes):
            s += sum(model.looks[x][labels[i]] for x in _looks(node, i in holds) if x in model.looks)
            if i:
                s += model.edges.get(node.tag, model.other)[labels[node.parent]][labels[i]]
        total += exp(s)
        for i, y in enumerate(labels):
            on[i] += y * exp(s)
    assert np.allclose([x / total for x in on], model.marginals(page))


def test_vectors(spark):
    from skylattice.llm.vector_dedup import VectorLinks

    g = np.random.default_rng(4)
    base = g.standard_normal((40, 8))
    rows = []
    for i, x in enumerate(base):
        for k in range(int(g.integers(1, 5))):
            rows.append((len(rows), (x + 0.02 * k * g.standard_normal(8)).tolist(), i % 3))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(30)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 8, 0), (n + 2, [float("nan")] * 8, 0), (n + 3, [None] * 8, 0), (n + 4, rows[0][1], None), (n + 5, rows[0][1][:4], 0)]
    good = [(i, np.array(x), y) for i, x, y in rows[:n]]
    root = {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(root, 0)
    for i, x, y in good:
        for j, z, w in good:
            if i < j and y == w and x @ z / np.linalg.norm(x) / np.linalg.norm(z) >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for options in ({}, {"leaf": 8, "trees": 12}, {"subtree": 16, "block": 6, "trees": 16}):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in VectorLinks(df, **options).result().collect()}
        assert got == {i: (links[i], find(i), find(i) == i) for i in root}
    assert VectorLinks(df.limit(0)).result().count() == 0


def test_components_of_random_graphs(spark):
    from skylattice.llm.shared import components

    r = random.Random(9)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def pipeline_tables(spark, path, rows, passage, extra=""):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + extra).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as c

    r = random.Random(10)
    word = lambda letters="abcdefghij": "".join(r.choices(letters, k=5))
    body = [" ".join(word() for _ in range(60)) for _ in range(12)]
    line = "a line that stands in every document of all"
    passage = " ".join(word() for _ in range(30))
    noise = " ".join(word("qrstuvwxyz") for _ in range(80))
    texts = [f"{line}\n{b}" for b in body]
    texts += [line, body[0], body[1] + " tail", "123 456", None, f"{body[5][:100]} {passage} {body[6][:150]}", noise, "xyzzy", f"{line}\n{body[7][:150]}"]
    rows = [(i, t, None if t in (noise, "xyzzy") else "en", "s", len(t or ""), 7, "x") for i, t in enumerate(texts)]
    rows += [(None, body[3], "en", "s", 1, 7, "x"), (2, texts[2], "en", "s", 1, 7, "x")]  # without an id; repeated
    docs = pipeline_tables(spark, tmp_path, rows, passage, ", score int, runs string")
    left = []
    for name, stage in c.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(tmp_path)).cache()
        assert docs.schema == before.schema, name
        assert docs.where("score != 7 OR runs != 'x'").count() == 0, name
        left.append(sorted((x["doc_id"] for x in docs.collect()), key=lambda x: (x is None, x)))
    everything = [0, 1, 2, 2, *range(3, 12), 12, 13, 14, 17, 19, 20, None]
    assert left[0] == everything  # without a letter: 15, 16; letter noise: 18, but not two short words
    assert left[1] == [i for i in everything if i != 12]  # 12 has lost all its lines
    assert left[2] == [i for i in left[1] if i not in (13, 14)]  # near copies of 0 and 1; what has no id stays
    assert left[3] == [i for i in left[2] if i != 17]
    kept = {x["doc_id"]: x for x in docs.collect()}
    assert kept[20]["text"].startswith(line) and kept[3]["text"] == body[3] and kept[3]["n_chars"] == len(body[3])
    got = c.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in got} == set(left[3])


def test_pipeline_of_empty_and_null_tables(spark, tmp_path):
    import corpus_pipeline as c

    pipeline_tables(spark, tmp_path / "none", [], "a b c")
    assert c.run(spark, str(tmp_path / "none")).count() == 0
    pipeline_tables(spark, tmp_path / "null", [(1, None, None, None, None), (None, None, "en", None, 3), (2, "", "fr", None, 0)], None)
    assert c.run(spark, str(tmp_path / "null")).count() == 0
    # nothing says what a language looks like, so all that has a letter stays
    pipeline_tables(spark, tmp_path / "plain", [(1, "some words", None, None, None), (1, "some words", None, None, None), (2, "1 2 3", None, None, None)], "x y")
    assert {x["doc_id"] for x in c.run(spark, str(tmp_path / "plain")).collect()} == {1}


def test_vector_dedup_keeps_dense_groups_whole_above_the_subtrees(spark):
    from skylattice.llm.vector_dedup import VectorLinks

    g = np.random.default_rng(8)
    base = g.standard_normal(32)
    base /= np.linalg.norm(base)
    x = base + 0.12 / 32**0.5 * g.standard_normal((900, 32))
    rows = [(i, v.tolist(), "one group") for i, v in enumerate(x)] + [(1000 + i, g.standard_normal(32).tolist(), "apart") for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    like = u @ u.T >= 0.98
    for options in ({"leaf": 32}, {"trees": 2, "subtree": 64, "block": 100}):  # one task; blocks of a dense leaf
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in VectorLinks(vectors, **options).result().collect()}
        assert like.sum() > 400_000 and all(got[i] == (like[i].sum() - 1, 0) for i in range(900) if like[i].sum() > 10)
        assert all(got[i] == (0, i) for i in range(1000, 1300))


def test_vector_recall_in_one_large_label(spark):
    """50,000 vectors of one label, links close to the least cosine, default settings: the label is dealt leaf by leaf."""
    from pyspark.sql import functions as F

    from skylattice.llm.vector_dedup import SUBTREE, VectorLinks

    g = np.random.default_rng(12)
    base = g.standard_normal((25_000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    # of the pairs made so, cosines are about 0.975 to 0.985
    x = np.concatenate([base, base + 0.2 / 64**0.5 * g.standard_normal(base.shape)])
    assert len(x) > 6 * SUBTREE
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([(u[i : i + 2000] @ u.T >= 0.98).sum(axis=1) - 1 for i in range(0, len(u), 2000)])
    table = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float64())), "label": ["one"] * len(x)})
    links = VectorLinks(spark.createDataFrame(table))
    forest = links._forest()["one/64"]
    assert len(forest) == links.trees and all(len(counts) > 16 for _, counts in forest)
    got = np.array([r["n_links"] for r in links.result().orderBy("vec_id").select(F.col("n_links")).collect()])
    assert want.sum() > 5_000 and (got <= want).all()
    print("recall", got.sum() / want.sum(), "of", want.sum())
    assert got.sum() >= 0.9 * want.sum()


def test_vectors_with_repeated_ids_and_clashing_columns(spark):
    from skylattice.llm.vector_dedup import VectorLinks

    rows = [(5, [1.0, 0.0], "a"), (5, [0.0, 1.0], "a"), (6, [0.0, 2.0], "a"), (None, [0.0, 1.0], "a"), (7, [0.0, 1.0], "b"), (8, [], "a")]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label string, k int, id int")
    got = sorted(map(str, (tuple(r) for r in VectorLinks(vectors).result().collect())))
    want = [(5, 0, 5, True), (5, 1, 5, True), (6, 1, 5, False), (None, 0, None, None), (7, 0, 7, True), (8, 0, 8, True)]
    assert got == sorted(map(str, want))
