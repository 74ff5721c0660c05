"""Spelling variants and vector codes against brute force, toxicity on held-out rows; odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import spelling, toxicity, vector_codes


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n, times=10):
    by = {w: [v for v in n if v != w and near(w, v)] for w in n}

    def form(w):
        best = min(by[w], key=lambda v: (-n[v], v), default=None)
        return best if best and n[best] >= times * n[w] else None

    def root(w):
        while form(w):
            w = form(w)
        return w

    return {(w, form(w), root(w), n[w], len(by[w]), n[form(w)] if form(w) else None) for w in n}


@pytest.mark.parametrize("most", [50_000, 30])
def test_spelling_variants(spark, most):
    draw = random.Random(5)
    words = {"".join(draw.choice("abé") for _ in range(draw.choice([7, 7, 8, 8, 9, 10]))) for _ in range(900)}
    n = {w: draw.choice([2, 3, 5, 20, 60, 200, 700, 9000]) for w in sorted(words)}
    n["aaaaaaa"], n["aaaaaaaa"], n["z" * 3000], n["z" * 3001] = 7, 70, 5, 50
    found = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"), most=most)
    assert {tuple(r) for r in found.collect()} == plain_variants(n)


def test_words_of_texts(spark):
    long = "verylongword" * 500
    texts = [(1, "Abcdefgh abcdefgh, ABCDEFG"), (2, None), (3, ""), (None, "Ünterwegs unterwegs"), (5, long + " " + long), (5, long)]
    found = spelling.words(spark.createDataFrame(texts, "doc_id long, text string"), least=1)
    want: dict = {}
    for key, text in texts:
        for run in __import__("re").findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] = want.get(run, 0) + 1
    assert {r.word: r.n for r in found.collect()} == want


def test_no_words(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(none).count() == 0
    docs = spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")
    assert spelling.variants(spelling.words(docs)).count() == 0


def plain_codes(rows, rounds=4, entries=256):
    """rows: (id, label, vector) kept, in order of ids."""
    x = np.floor(np.array([v for *_, v in rows], np.float64) * 1024).astype(np.int64)
    parts = np.split(x, 4, axis=1)
    books = [p[:entries].copy() for p in parts]

    def nearest(p, book):
        return np.array([min(range(len(book)), key=lambda j: (int(((v - book[j]) ** 2).sum()), j)) for v in p])

    for _ in range(rounds):
        for p, book in zip(parts, books):
            at = nearest(p, book)
            for j in set(at.tolist()):
                mine = p[at == j]
                book[j] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    at = [nearest(p, b) for p, b in zip(parts, books)]
    errors = [sum(int(((p[i] - b[a[i]]) ** 2).sum()) for p, b, a in zip(parts, books, at)) for i in range(len(rows))]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return ["".join(f"{a[i]:02x}" for a in at) for i in range(len(rows))], errors, digest


def test_vector_codes(spark):
    draw = np.random.default_rng(4)
    rows = [(i, int(draw.integers(0, 3)) if i % 7 else None, [float(x) for x in draw.normal(0, 0.02, 12)]) for i in range(700)]
    rows[300] = (300, 1, rows[3][2])  # a repeated vector
    rows += [(700 + i, 1, rows[5][2]) for i in range(3)]
    odd = [(-1, 0, None), (-2, 0, [1.0, None] + [0.0] * 10), (-3, 0, [float("nan")] * 12), (-4, 0, [float("inf")] * 12)]
    df = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<float>").repartition(5)
    kept = [(i, label, np.float32(v).astype(float).tolist()) for i, label, v in rows]
    codes, errors, digest = plain_codes(kept)
    coded, books = vector_codes.encode(df)
    assert books.digest() == digest
    got = {r.vec_id: r for r in vector_codes.with_label_errors(coded).collect()}
    assert len(got) == len(rows)
    sums: dict = {}
    for (_, label, _), e in zip(rows, errors):
        sums[label] = sums.get(label, 0) + e
    for (i, label, _), code, error in zip(rows, codes, errors):
        assert (got[i].code, got[i].error, got[i].label_error) == (code, error, sums[label])


def test_bounds_skip_scans_and_keep_ties():
    draw = np.random.default_rng(6)
    x = draw.integers(-40, 40, (3000, 3))
    entries = draw.integers(-40, 40, (40, 3))
    entries[7] = entries[3]  # a tie for all that are nearest to either
    entry, upper, lower = np.full(3000, -1, np.int16), np.zeros(3000, np.float32), np.zeros(3000, np.float32)
    assert vector_codes.assign(x, entries, entry, upper, lower) == 3000
    want = [min(range(40), key=lambda j: (int(((v - entries[j]) ** 2).sum()), j)) for v in x]
    assert entry.tolist() == want
    assert vector_codes.assign(x, entries, entry, upper, lower) < 3000 and entry.tolist() == want


def test_vector_codes_of_odd_tables(spark):
    schema = "vec_id long, label int, embedding array<float>, code string"
    coded, books = vector_codes.encode(spark.createDataFrame([], schema))
    assert coded.count() == 0 and books.digest() == hashlib.sha256(b"").hexdigest()
    few = spark.createDataFrame([(2, None, [0.5, 0.25, 0.0, -1.0], "x"), (1, None, [0.0, 0.0, 0.0, 0.0], "y"), (None, 1, [0.5, 0.25, 0.0, -1.0], "z"), (4, 1, [1.0], "z")], schema)
    coded, books = vector_codes.encode(few)
    got = {r.vec_id: (r.code, r.error) for r in coded.collect()}
    # entries are the vectors in order of ids: 1, 2, none; the last equals the second, the lower index wins
    assert got == {1: ("00000000", 0), 2: ("01010001", 0), None: ("01010001", 0)}
    with pytest.raises(ValueError):
        vector_codes.encode(spark.createDataFrame([(1, None, [0.5] * 6, "x")], schema))
    with pytest.raises(ValueError):
        vector_codes.encode(spark.createDataFrame([(1, None, [1e9] * 4, "x")], schema))


def made_documents(n=1500):
    draw = random.Random(8)
    clean = ["".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(draw.choice([2, 3]))) for _ in range(400)]
    bad = ["zoxkwal", "quvvixy", "wyxxoqa"]
    rows, labels = [], []
    for i in range(n):
        words = [draw.choice(clean) for _ in range(draw.choice([30, 60, 200]))]
        toxic = draw.random() < 0.25
        if toxic:
            for _ in range(max(1, len(words) // 30)):
                word = draw.choice(bad)
                if draw.random() < 0.3:  # a misspelling: one letter doubled
                    at = draw.randrange(len(word))
                    word = word[:at] + word[at] + word[at:]
                words[draw.randrange(len(words))] = word.capitalize() + draw.choice(["", ".", "!"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = made_documents()
    toxic = dict(labels)
    odd = [(9001, None), (9002, ""), (9003, "... !!"), (None, "zoxkwal zoxkwal"), (9004, "clean " * 300_000 + "x" * 100_000)]
    docs = spark.createDataFrame([(*r, "s") for r in rows + odd + odd[:1]], "doc_id long, text string, score string").repartition(4)
    marks = spark.createDataFrame(labels + [(9001, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    found = toxicity.score(docs, model).collect()
    assert len(found) == len(rows) + 6 and found[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    test = [r for r in found if r.held_out and r.doc_id in toxic]
    caught = [r.predicted for r in test if toxic[r.doc_id]]
    wrong = [r.predicted for r in test if not toxic[r.doc_id]]
    assert np.mean(caught) >= 0.9 and np.mean(wrong) <= 0.02
    assert not any(r.predicted for r in found if r.doc_id in (9001, 9002, 9003))
    contrast, bias = model.contrast().astype(np.float32), float(model.bias[1] - model.bias[0])
    by_id = {r.doc_id: r.score for r in found}
    for key, text in rows[:40] + odd:
        at, share = toxicity.bag(text)  # the mean of embeddings, then the softmax
        z = share @ model.embeddings[at] @ model.weights + model.bias
        assert by_id[key] == pytest.approx(1 / (1 + np.exp(z[0] - z[1])), abs=1e-4)
    assert by_id[9001] == by_id[9002] == by_id[9003] == pytest.approx(1 / (1 + np.exp(-bias)))


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows, labels = made_documents(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    one, two = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int"), rounds=1) for x in (labels, turned))
    assert (one.embeddings == two.embeddings).all() and (one.weights == two.weights).all()


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a word")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).first().score == 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_shards_of_one_repeated_row(spark):
    """One id and text beyond a shard's share: its rows are dealt out, and sizes stay near equal."""
    from seqloom.llm import bin_pack

    rows = [(7, "same text " * 3)] * 2000 + [(i, f"text {i} " * 3) for i in range(100, 2100)]
    got = bin_pack.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), n_shards=16).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() <= 1.15 * sizes.mean()
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
