"""Edge cases and brute force for the operators on texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def random_texts(seed, n=60):
    r = random.Random(seed)
    base = ["the Quick brown fox", "jumps over", "a lazy dog", "é à ü", "lorem ipsum", "12 34", "x", "A very common line of text indeed"]
    out = [None, "", " ", "\n", "\n\n", "one", "A very common line of text indeed\n" * 3]
    while len(out) < n:
        words = " ".join(r.choices(base, k=r.randint(1, 12)))
        out.append(words if r.random() < 0.5 else words.replace(" ", "\n", r.randint(1, 3)))
        if r.random() < 0.3:
            out.append(out[-1])
    return out


# -- kernel


@pytest.mark.parametrize("limit", [1, 16, 1 << 20])
def test_spans_match_regular_expression(limit):
    from skylattice.llm.decontaminate import WORD
    from skylattice.llm.textkernel import blocks

    texts = random_texts(1)
    got = []
    for block in blocks(pa.array(texts), limit):
        starts, ends, first = block.spans(WORD)
        hashes = block.hashes(starts, ends)
        for i in range(len(block)):
            got.append([(block.data[a:z].tobytes().decode(), int(h)) for a, z, h in list(zip(starts, ends, hashes, strict=True))[first[i] : first[i + 1]]])
    want = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW)) for t in texts]
    assert [[w.translate(LOW) for w, _ in row] for row in got] == want
    seen = {}
    for row in got:
        for w, h in row:
            assert seen.setdefault(w.translate(LOW), h) == h
    assert len(set(seen.values())) == len(seen)


def thue_morse(levels):
    """Two strings that every polynomial modulo a power of two takes for equal, once they are long enough."""
    x, y = "a", "b"
    for _ in range(levels):
        x, y = x + y, y + x
    return x, y


def test_hashes_of_adversarial_and_zero_padded_spans_differ():
    from skylattice.llm.textkernel import blocks

    pairs = [thue_morse(n) for n in range(1, 14)] + [("a", "a\0"), ("a" * 7, "a" * 7 + "\0"), ("a" * 8, "a" * 8 + "\0"), ("x" * 32, "x" * 33)]
    block = next(blocks(pa.array([x for pair in pairs for x in pair]), 1 << 24))
    for hashes in (block.hashes(block.offsets[:-1], block.offsets[1:]), *block.digests(block.offsets[:-1], block.offsets[1:])):
        assert len(set(hashes.tolist())) == len({x for pair in pairs for x in pair})
    upper = next(blocks(pa.array([x.upper() for pair in pairs for x in pair]), 1 << 24))
    assert (upper.hashes(upper.offsets[:-1], upper.offsets[1:]) == block.hashes(block.offsets[:-1], block.offsets[1:])).all()


def test_adversarial_lines_and_words_stay_apart(spark):
    from skylattice.llm.decontaminate import digest, find
    from skylattice.llm.jaccard_join import JaccardJoin
    from skylattice.llm.line_dedup import LineStore

    a, b = thue_morse(12)
    docs = docs_of(spark, [b, a, a, a]).cache()
    kept = {r["doc_id"]: r["text"] for r in LineStore(spark).add(docs).dedup(docs).collect()}
    assert kept == {0: b, 1: "", 2: "", 3: a}
    assert {r["doc_id"]: r["component_id"] for r in JaccardJoin(docs).components().collect()} == {0: 0, 1: 1, 2: 1, 3: 1}
    items = spark.createDataFrame([(7, a)], "item_id long, text string")
    assert [r["n_hit"] for r in digest(find(docs, items)).orderBy("doc_id").collect()] == [0, 1, 1, 1]


# -- token counts and packing


def test_encoder_equals_tokenizer():
    from skylattice.llm.tokens import Encoder, default_path

    encoder = Encoder(default_path(), cache_pieces=5)
    r = random.Random(2)
    texts = ["".join(r.choice([" ", "  ", "a", "b", "é", "1", "\n", "\t", "!", "'s", "<|endoftext|>", "\xa0", "word"]) for _ in range(r.randint(0, 9))) for _ in range(3000)]
    assert encoder.encode_all(texts) == [encoder.whole(t) for t in texts]
    assert encoder.encode_all([None, ""]) == [b"", b""]


def test_histogram_and_suffix_sums(spark):
    from skylattice.llm.token_counts import length_histogram, quantile_length, truncated_total, with_suffix_sums
    from skylattice.llm.tokens import Encoder, default_path

    texts = random_texts(3)
    encoder = Encoder(default_path())
    lengths = sorted(len(encoder.whole(t)) // 4 if t else 0 for t in texts)
    sums = with_suffix_sums(length_histogram(docs_of(spark, texts))).cache()
    for row in sums.collect():
        n = row["n_tokens"]
        assert row["n_docs"] == lengths.count(n)
        assert row["docs_over"] == sum(x > n for x in lengths) and row["tokens_over"] == sum(x for x in lengths if x > n)
        assert row["truncated_tokens"] == sum(min(x, n) for x in lengths)
    assert truncated_total(sums, 7).first()["tokens"] == sum(min(x, 7) for x in lengths)
    assert quantile_length(sums, 0.5).first()["n_tokens"] == lengths[-(-len(lengths) // 2) - 1]
    assert with_suffix_sums(length_histogram(docs_of(spark, []))).count() == 0


def test_packing_is_an_exact_partition(spark):
    from skylattice.llm.packing import pack
    from skylattice.llm.tokens import Encoder, default_path

    texts = [*random_texts(4), "word " * 3000, "y" * 5000]
    encoder = Encoder(default_path())
    ids = {i: (encoder.whole(t) if t else b"") + bytes(4) for i, t in enumerate(texts)}
    rows = pack(docs_of(spark, texts), capacity=64).collect()
    places, pieces = {}, {}
    for r in rows:
        raw = ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert r["ids_crc32"] == zlib.crc32(raw) and len(raw) == 4 * r["length"] > 0 and r["doc_tokens"] == len(ids[r["doc_id"]]) // 4
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, raw in ids.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(raw) // 4
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 64 and (at == 64 or at & (at - 1) == 0)
    assert pack(docs_of(spark, [])).count() == 0


# -- decontamination


def brute_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    doc, hit, names = words(text), set(), set()
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        if n:
            windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            for k in range(len(doc) - n + 1):
                if tuple(doc[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    names.add(i)
    return len(doc), len(hit), names


@pytest.mark.parametrize("hit_bytes", [64 << 20, 0])
def test_decontamination_matches_brute_force(spark, hit_bytes):
    from skylattice.llm.decontaminate import digest, find

    r = random.Random(5)
    words = ["a", "b", "c", "D", "e1", "ß"]
    text = lambda lo, hi: " ".join(r.choices(words, k=r.randint(lo, hi)))
    items = [(i, text(0, 14)) for i in range(12)] + [(12, None), (13, ""), (14, "!!"), (3, text(9, 14)), (15, "a " * 25), (16, text(30, 30))]
    texts = [None, "", "a " * 31, "a " * 9, f"b {'a ' * 12}b {'a ' * 12}", *(text(0, 40) for _ in range(40)), *(f"{text(0, 5)}, {t.upper()}! {text(0, 5)}" for _, t in items if t)]
    got = digest(find(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"), hit_bytes=hit_bytes)).collect()
    assert len(got) == len(texts)
    for row in got:
        n, hit, names = brute_hits(texts[row["doc_id"]], items)
        want = hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest()
        assert (row["n_words"], row["n_hit"], row["n_items"], row["items_sha256"], row["contaminated"]) == (n, hit, len(names), want, hit > 0)


def test_decontamination_without_items_keeps_clashing_columns_right(spark):
    from skylattice.llm.decontaminate import find

    docs = docs_of(spark, ["a b"]).selectExpr("doc_id", "text", "7 AS runs", "'x' AS extra")
    row = find(docs, spark.createDataFrame([], "item_id long, text string")).first()
    assert row["runs"] == [] and row["extra"] == "x" and row["n_words"] == 2
    clash = docs_of(spark, ["a b", "a b", "c"]).selectExpr("text", "doc_id AS d1", "doc_id AS spans", "'y' AS c0")
    items = spark.createDataFrame([(4, "A B")], "item_id long, text string")
    for hit_bytes in (64 << 20, 0):
        got = find(clash, items, hit_bytes=hit_bytes)
        assert got.columns == ["text", "d1", "spans", "c0", "n_words", "runs", "items"]
        assert sorted((r["d1"], r["spans"], r["c0"], r["items"]) for r in got.collect()) == [(0, 0, "y", [4]), (1, 1, "y", [4]), (2, 2, "y", [])]


def test_decontamination_is_linear_in_repeated_words(spark):
    from skylattice.llm.decontaminate import digest, find, item_prints

    items = spark.createDataFrame([(1, "same " * 20_000)], "item_id long, text string")
    assert item_prints(items).count() < 20
    got = digest(find(docs_of(spark, ["same " * 40_000, "same " * 9, None]), items)).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"]) for r in got] == [(40_000, 40_000, 1), (9, 0, 0), (0, 0, 0)]


# -- line dedup


def brute_lines(texts, min_docs=3):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOW)
    held = {}
    for i, t in texts:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = {}
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in gone and gone[key(x)] != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize(("options", "small"), [({}, False), ({}, True), ({"exact_rows": 0}, False), ({"exact_rows": 0, "filter_bytes": 0}, True)])
def test_lines_go_and_come_back(spark, options, small, monkeypatch):
    from skylattice.llm import line_dedup
    from skylattice.llm.line_dedup import LineStore

    if small:  # shards are laid out anew as they fill, postings written anew all the time
        monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
        monkeypatch.setattr(line_dedup, "MOST_GENERATIONS", 1)

    r = random.Random(6)
    lines = ["  This is a line that repeats a lot. ", "THIS is a line that repeats a lot.", "short", "", "another rather long line é à ü ß", "\tthird line, which is long enough\r", "éééééééééééééééééééé"]
    texts = [(i, "\n".join(r.choices(lines, k=r.randint(0, 6)))) for i in range(30)] + [(30, None), (31, ""), (32, "\n")]

    def check(store, some):
        rows = store.dedup(docs_of(spark, [t for _, t in some], [i for i, _ in some])).collect()
        want = brute_lines(some)
        assert {x["doc_id"]: (x["n_lines"], x["n_dropped"], x["text"] or "") for x in rows} == want

    store = LineStore(spark, **options)
    if small:  # begins with one shard
        store.add(docs_of(spark, [t for _, t in texts[:3]], [i for i, _ in texts[:3]]))
    store.add(docs_of(spark, [t for _, t in texts[:20]], [i for i, _ in texts[:20]]))
    assert store.shards > 1 or not small
    check(store, texts[:20])
    store.add(docs_of(spark, [t for _, t in texts[20:]], [i for i, _ in texts[20:]]))
    check(store, texts)
    last = docs_of(spark, [t for _, t in texts[15:]], [i for i, _ in texts[15:]])
    store.remove(last)
    check(store, texts[:15])
    store.add(last)
    check(store, texts)


@pytest.mark.parametrize("options", [{}, {"exact_rows": 0, "filter_bytes": 0}])
def test_lines_of_long_texts_repeated_and_null_ids_and_clashing_columns(spark, options):
    from skylattice.llm.line_dedup import LineStore

    line = "a line that is long enough to count"
    rows = [(1, line), (1, line), (2, f"x\n{line}\n{line}"), (3, f"{line}\n" * 20_000 + "y"), (None, line), (4, None)]
    docs = spark.createDataFrame([(i, t, 9, "z") for i, t in rows], "doc_id long, text string, _id int, lost string")
    kept = LineStore(spark, **options).add(docs).dedup(docs)
    assert kept.columns == ["doc_id", "text", "_id", "lost", "n_lines", "n_dropped"]
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"], r["_id"], r["lost"]) for r in kept.collect()), key=str)
    want = [(1, "", 1, 1), (1, "", 1, 1), (2, "x", 3, 2), (3, rows[3][1], 20_001, 0), (None, line, 1, 0), (4, None, 1, 0)]
    assert got == sorted(((*w, 9, "z") for w in want), key=str)


def test_lines_of_an_empty_table(spark):
    from skylattice.llm.line_dedup import LineStore

    none = docs_of(spark, [])
    store = LineStore(spark).add(none)
    assert store.dedup(none).count() == 0
    assert store.dedup(docs_of(spark, [None, "a\nb"])).count() == 2
    assert store.add(docs_of(spark, ["a line that is long enough to count"] * 3)).remove(none).refs().count() == 1


def test_cuckoo_filter_keeps_what_it_holds():
    from skylattice.llm.cuckoo import CuckooFilter, build

    keys = np.random.default_rng(1).integers(0, 1 << 63, 2000).astype(np.uint64)
    some = build(keys)
    assert some.contains(keys).all() and some.contains(keys + np.uint64(1)).mean() < 0.01
    again = CuckooFilter.from_bytes(some.to_bytes())
    for k in keys[:1000]:
        assert again.remove(int(k))
    assert again.contains(keys[1000:]).all() and again.count == 1000
    tiny = CuckooFilter(1)
    added = [tiny.add(int(k)) for k in keys[:20]]
    assert sum(added) <= 4 and tiny.contains(keys[:20][np.array(added)]).all()


# -- Jaccard join


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def family_texts():
    """Families of near copies, boilerplate that many texts share, a hub that is like many, and a very long text with a near copy."""
    r = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    texts = [None, "", " \n", "one", "ONE", "a b c", "a b c d"]
    boilerplate = " ".join(r.choices(words, k=30))
    while len(texts) < 90:
        base = r.choices(words, k=r.randint(3, 60))
        for _ in range(r.randint(1, 5)):
            x = list(base)
            for _ in range(r.randint(0, 4)):
                x[r.randrange(len(x))] = r.choice(words)
            texts.append(" ".join(x))
    texts += [f"{boilerplate} {' '.join(r.choices(words, k=r.randint(2, 14)))}" for _ in range(25)]
    long = r.choices([f"v{i}" for i in range(3000)], k=30_000)
    return [*texts, " ".join(long), " ".join(long[:28_000])]


#: Small bounds, so that every way through the join is taken.
SMALL = {"crowd": 2, "fetch_rows": 0, "frequent_docs": 3, "crowd_rows": 4}


@pytest.mark.parametrize(("options", "near"), [({}, True), (SMALL, True), (SMALL, False), ({"crowd": 3}, False)])
def test_jaccard_components_match_brute_force(spark, options, near, monkeypatch):
    import skylattice.llm.jaccard_join as j

    if options:
        for name, value in (("BLOCK_SETS", 3), ("GROUP_PAIRS", 5), ("BUNDLE_ROWS", 20)):
            monkeypatch.setattr(j, name, value)
    if not near:  # the exact steps alone have to find everything
        monkeypatch.setattr(j.JaccardJoin, "_near_copies", lambda self: spark.createDataFrame([], "a long, b long"))
    texts = family_texts()
    rows = j.JaccardJoin(docs_of(spark, texts), **options).components().collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows} == brute_components(list(enumerate(texts)))


def test_jaccard_rows_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    """Copies of one text, each with a word changed, that no band brings together: all pairs are similar, few links are needed."""
    import skylattice.llm.jaccard_join as j

    monkeypatch.setattr(j.JaccardJoin, "_near_copies", lambda self: spark.createDataFrame([], "a long, b long"))
    words = [f"w{i}" for i in range(130)]
    texts = [" ".join([*words[:i], f"x{i}", *words[i + 1 :]]) for i in range(120)]
    texts += [" ".join([*words[:80], *(f"y{i}.{k}" for k in range(50))]) for i in range(10)]  # hold most of it, but are similar to none
    one = j.JaccardJoin(docs_of(spark, texts), crowd_rows=40)
    _, links = one.links()
    found = links.count()
    assert 119 <= found < 10 * len(texts)  # of 7,140 similar pairs
    rows = one.components().collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows} == brute_components(list(enumerate(texts)))


def test_jaccard_rows_with_repeated_and_null_ids(spark):
    from skylattice.llm.jaccard_join import JaccardJoin

    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    near = " ".join(f"b{i}" for i in range(38))
    rows = [(5, one), (5, two), (5, two), (3, near), (9, one), (None, one), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sid string, n int")
    got = JaccardJoin(docs).components().collect()
    want = [(5, 36, 5), (5, 36, 3), (5, 36, 3), (3, 34, 3), (9, 36, 5), (None, 36, None), (None, 0, None)]
    assert sorted(map(str, (tuple(x) for x in got))) == sorted(map(str, want))


def test_jaccard_of_an_empty_table(spark):
    from skylattice.llm.jaccard_join import JaccardJoin

    assert JaccardJoin(docs_of(spark, [])).components().count() == 0


def test_trie_links_match_brute_force():
    from skylattice.llm.jaccard_trie import Trie, all_links

    r = random.Random(3)
    for _ in range(60):
        sets = []
        for _ in range(r.randint(0, 20)):
            x = set(r.choice(sets).tolist()) if sets and r.random() < 0.6 else {r.randint(0, 60) for _ in range(r.randint(0, 25))}
            x ^= {r.randint(0, 60) for _ in range(r.randint(0, 3))}
            sets.append(np.array(sorted(x), np.uint64))
        trie = Trie(sets)
        similar = lambda a, b: len(a) and len(b) and 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
        for i in range(len(sets)):
            want = {k for k in range(len(sets)) if k != i and similar(sets[i], sets[k])}
            assert set(trie.links(i, 75)) == want == set(trie.links(i, 75, targets=list(range(len(sets)))))
        all_links(sets, 75)


# -- language and toxicity


def test_language(spark):
    from skylattice.llm.language import fit, predict

    texts = ["the cat sat on the mat with the hat", "le chat est sur la table avec le chapeau"] * 5 + [None, "", "123 !?", "the hat"]
    langs = ["en", "fr"] * 5 + [None] * 4
    docs = spark.createDataFrame([(i, t, x, 5) for i, (t, x) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string, score int")
    rows = predict(docs, fit(docs)).orderBy("doc_id").collect()
    assert [x["lang_pred"] for x in rows] == ["en", "fr"] * 5 + ["und"] * 3 + ["en"]
    assert all(0 <= x["score"] <= 1 for x in rows)
    none = predict(docs, fit(docs.limit(0))).collect()
    assert {x["lang_pred"] for x in none} == {"und"}


def test_toxicity_finds_documents_and_sentences(spark):
    from skylattice.llm.toxicity import fit, score

    r = random.Random(8)
    clean = lambda: " ".join(r.choices("the of and sun moon tree water stone river".split(), k=12)) + "."
    rows, labels = [], []
    for i in range(200):
        bad = i % 4 == 0
        parts = [clean() for _ in range(4)]
        if bad:
            parts[2] = "you are a grumbler and a " + r.choice(["nastyish", "nastyest", "nastying"]) + "."
        rows.append((i, " ".join(parts)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "x " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit(docs, spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int"))
    got = {x["doc_id"]: x for x in score(docs, model).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["predicted"] == y for i, y in labels)
    assert [x["sentence"] for x in got[0]["sentences"]] == [2]
    assert got[1000]["predicted"] == got[1001]["predicted"] == got[1002]["predicted"] == 0
    assert {x["predicted"] for x in score(docs, fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))).collect()} == {0}


def test_language_matches_naive_bundling(spark):
    """Letter vectors, rotated and multiplied; trigrams summed; unit documents summed by language: all by plain loops."""
    from skylattice.llm.language import fit, predict

    r = random.Random(21)
    make = lambda letters: " ".join("".join(r.choices(letters, k=r.randint(1, 7))) for _ in range(r.randint(1, 30)))
    rows = [(i, make("abcdeé" if i % 2 else "deßfGh"), "x" if i % 2 else "y") for i in range(40)]
    rows += [(40, None, "x"), (41, "", "y"), (42, "12 34!", "x"), (43, "a", None), (43, "a", None), (44, "De ", None), (45, "abc " * 30_000, None), (46, "Ω日本", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    n, seed = 256, 9

    def letter(c):
        return 2 * np.random.Generator(np.random.PCG64([seed, ord(c)])).integers(0, 2, n) - 1.0

    def profile(text):
        low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
        line = f" {' '.join(low.split())} "
        total = np.zeros(n)
        for a, b, c in zip(line, line[1:], line[2:], strict=False):
            if b != " ":
                total += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
        return total / np.linalg.norm(total) if total.any() else None

    profiles = [profile(t if len(t or "") < 1000 else t[:4] * 3000) for _, t, _ in rows]
    want = {y: sum(np.rint(p * (1 << 20)) for p, (_, _, z) in zip(profiles, rows, strict=True) if p is not None and z == y) for y in "xy"}
    want = {y: v / np.linalg.norm(v) for y, v in want.items()}
    model = fit(docs, dimensions=n, seed=seed)
    assert model.languages == ["x", "y"] and np.allclose(model.prototypes, [want["x"], want["y"]], atol=1e-5)
    got = predict(docs, model).orderBy("doc_id").collect()
    assert len(got) == len(rows)
    for p, row in zip(profiles, got, strict=True):
        if p is None:
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
        else:
            cosines = {y: float(v @ p) for y, v in want.items()}
            assert row["lang_pred"] == max(cosines, key=cosines.get) and abs(row["score"] - max(0.0, max(cosines.values()))) < 1e-2
    assert predict(docs.limit(0), model).count() == 0 and fit(docs.limit(0)).languages == []
    clash = predict(docs.selectExpr("doc_id", "text", "1 AS score", "2 AS points"), model)
    assert clash.columns == ["doc_id", "text", "points", "lang_pred", "score"]


def test_language_ties_go_to_the_first_name(spark):
    from skylattice.llm.language import fit, predict

    docs = spark.createDataFrame([(1, "same text", "b"), (2, "same text", "a")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in predict(docs, fit(docs)).collect()} == {"a"}


def test_toxicity_matches_naive_noisy_or(spark):
    """Scores from sentences split by a regular expression, and a likelihood that no small step improves."""
    from skylattice.llm import toxicity as t
    from skylattice.llm.textkernel import blocks, mix

    r = random.Random(31)
    plain, bad = [f"word{i}" for i in range(60)], ["vileness", "Vilest", "scumbag"]
    sentence = lambda some: " ".join(r.choices(some, k=r.randint(2, 9))) + r.choice([". ", "! ", "?\n", "\n"])
    texts, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        texts.append("".join(sentence(plain + (bad * 4 if toxic and r.random() < 0.6 else [])) for _ in range(r.randint(1, 6))) + (f"You {r.choice(bad)}!" if toxic else ""))
        labels.append((i, int(toxic)))
    texts += [None, "", "...", "é ß", texts[0], "calm words. " * 50_000 + "you scumbag"]
    docs = docs_of(spark, texts)
    model = t.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert 0 < len(model.hashes) <= t.FEATURES

    def hashed(raw):
        block = next(blocks(pa.array([raw], pa.binary()).cast(pa.string(), safe=False) if isinstance(raw, str) else pa.array([raw])))
        return int(block.hashes(np.array([0]), np.array([len(block.data)]))[0])

    weights = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))
    seen = {}

    def features(word):
        if word not in seen:
            raw = word.encode()
            found = [hashed(raw)] + [int(mix(np.array([hashed(raw[:k])], np.uint64) ^ np.uint64(k))[0]) for k in (4, 5, 6) if len(raw) > k]
            seen[word] = {x for x in found if x in weights}
        return seen[word]

    def score(text):
        clean = 1 - model.leak
        for part in re.split(r"[.!?\n]", (text or "").translate(LOW)):
            some = set().union(*(features(w) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", part)))
            if some:
                clean *= 1 - 1 / (1 + np.exp(-(model.bias + sum(weights[x] for x in some))))
        return 1 - clean

    got = {x["doc_id"]: x for x in t.score(docs, model).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert abs(got[i]["score"] - score(text)) < 1e-9 and got[i]["predicted"] == (got[i]["score"] >= 0.5)
    assert got[len(texts) - 1]["sentences"][0]["sentence"] == 50_000
    assert sum(got[i]["predicted"] == y for i, y in labels) >= 295
    repeated = t.score(docs.union(docs).selectExpr("doc_id", "text", "1 AS score", "2 AS y"), model)
    assert repeated.count() == 2 * len(texts) and repeated.columns == ["doc_id", "score", "predicted", "sentences"]
    assert t.score(docs.limit(0), model).count() == 0
    assert t.fit(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).weights.size == 0


def test_noisy_or_training_comes_close_to_the_optimum():
    from skylattice.llm.toxicity import _train

    g = np.random.default_rng(2)
    hashes = np.arange(5, dtype=np.uint64)
    f = [g.integers(0, 5, g.integers(0, 8)) for _ in range(200)]
    s = [np.sort(g.integers(0, 3, len(x))) for x in f]
    y = np.array([float(3 in x or g.random() < 0.1) for x in f])

    def likelihood(w, b, leak):
        total = -0.01 * (w @ w) - 0.25 * (b + 3) ** 2
        for k in range(len(y)):
            clean = 1 - leak
            for part in set(s[k].tolist()):
                clean /= 1 + np.exp(b + w[f[k][s[k] == part]].sum())
            total += np.log(1 - clean) if y[k] else np.log(clean)
        return total

    model = _train(hashes, y, s, f)
    best = likelihood(model.weights, model.bias, model.leak)
    for _ in range(60):
        step = 0.05 * g.standard_normal(6)
        assert likelihood(model.weights + step[:5], model.bias + step[5], model.leak) < best + 0.1
