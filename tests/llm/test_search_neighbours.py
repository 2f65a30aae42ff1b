import itertools
import math
import random
import tracemalloc
from functools import reduce

import numpy as np
import pytest

from lumenframe.llm import neighbours, search


def best(rows, queries, k):
    """All scores, summed in the terms' order."""
    docs = [(d, (t or "").encode().lower().split()) for d, t in rows if d is not None]
    mean = sum(len(w) for _, w in docs) / len(docs)
    out = {}
    for q, terms in queries.items():
        scored = []
        for d, words in docs:
            parts = [idf * (words.count(t) * 2.2 / (words.count(t) + 1.2 * (0.25 + 0.75 * len(words) / mean))) for t, idf in terms if t in words]
            if parts:
                scored.append((-round(sum(parts), 6), d))
        out[q] = sorted(scored)[:k]
    return out


@pytest.mark.parametrize("first", [1, 3, 16])
def test_search(spark, first):
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))).replace("w1 ", "É ")) for i in range(400)] + [(None, "w5 w6"), (401, None), (50, "w7 w7 w7"), (402, "w9 " * 2000), (403, "w3 w8 " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = search.build_index(docs, shard_words=1500)
    assert index.count() > 2
    n, mean = search.totals(index)
    said = search.said_terms(docs.where("doc_id % 50 = 0"))
    queries = search.keywords(said, search.document_frequencies(index, said), n, 6)
    counts = {}
    for d, t in rows:
        for w in set((t or "").encode().lower().split()) if d is not None else ():
            counts[w] = counts.get(w, 0) + 1
    assert n == len(rows) - 1
    idf = {w: math.log(1 + (n - c + 0.5) / (c + 0.5)) for w, c in counts.items()}
    wanted = {}
    for q in {d for d, _ in rows if d is not None and d % 50 == 0}:
        text = [w for d, t in rows if d == q for w in (t or "").encode().lower().split()]
        order = sorted(set(text), key=lambda w: (-round(text.count(w) * idf[w], 6), w))[:6]
        wanted[q] = [(w, idf[w]) for w in order]
    found = {}
    for r in search.top_k(index, queries, mean, 5, first=first).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((-r.score, r.doc_id))
    assert found == {q: v for q, v in best(rows, wanted, 5).items() if v}


def test_pruned_search_is_exact():
    rng = np.random.default_rng(2)
    n, terms = 3000, 40
    docs, which = np.nonzero(rng.random((n, terms)) < rng.random(terms) ** 3)
    tf = rng.integers(1, 6, len(docs))
    lengths = rng.integers(5, 90, n)
    built = search.Index.build(np.arange(n) * 3, docs, which.astype(np.int64), tf, lengths)
    index = search.Searcher(search.Index.load(built.terms, built.dump()), 40.0, search.Bm25())
    for _ in range(40):
        query = [(int(t), float(i)) for t, i in zip(rng.choice(terms, 6, replace=False), rng.choice([0.1, 1, 1, 5], 6), strict=True)]
        scores = {}
        for t, idf in query:
            for d, f in zip(docs[which == t], tf[which == t], strict=True):
                scores[d] = scores.get(d, 0.0) + idf * (f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lengths[d] / 40.0)))
        wanted = sorted(((-round(s, 6), int(d) * 3) for d, s in scores.items()))[:7]
        places, idf = index.places(np.array([t for t, _ in query])), np.array([i for _, i in query])
        assert [(-s, d) for s, d in index.top(places, idf, 7)] == wanted
        for floor in (-wanted[-1][0], -wanted[0][0], -wanted[0][0] + 1):
            # Whatever reaches the floor is found, whole or not.
            assert [(-s, d) for s, d in index.top(places, idf, 7, floor) if s >= floor] == [x for x in wanted if -x[0] >= floor]


@pytest.mark.parametrize("block_terms", [60, 1000])
def test_blocks_of_queries(spark, block_terms):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(1, 30)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = search.build_index(docs, shard_words=400)
    n, mean = search.totals(index)
    said = search.said_terms(docs.where("doc_id % 5 = 0"))
    queries = search.keywords(said, search.document_frequencies(index, said), n, 6)
    wanted = {}
    words = {(r.query_id, r.term): r.word.encode() for r in said.collect()}
    for r in queries.collect():
        wanted[r.query_id] = [(words[r.query_id, t], i) for t, i in zip(r.terms, r.idfs, strict=True)]
    found = {}
    for r in search.top_k(index, queries, mean, 5, first=3, block_terms=block_terms).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((-r.score, r.doc_id))
    assert found == best(rows, wanted, 5)


def test_every_term_of_a_row_counts(spark, tmp_path):
    """Rows 1 and 2 share with row 0 only what is in most rows, and so is last among its terms."""
    often = [f"o{i}" for i in range(20)]
    rows = [(0, " ".join([f"own{i} own{i}" for i in range(40)] + often[:9])), (1, " ".join(often[:9])), (2, "o1 x o2"), (3, "nothing of it"), (4, None)]
    rng = random.Random(7)
    rows += [(i, " ".join(rng.sample(often[9:], 8) + rng.sample(often[:9], i % 3))) for i in range(5, 120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for r in search.op5_search(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((-r.score, r.doc_id))
    counts = {}
    for _, t in rows:
        for w in set((t or "").encode().split()):
            counts[w] = counts.get(w, 0) + 1
    idf = {w: math.log(1 + (len(rows) - c + 0.5) / (c + 0.5)) for w, c in counts.items()}
    wanted = {}
    for q, t in rows:
        if q % 50 == 0:
            text = t.encode().split()
            wanted[q] = [(w, idf[w]) for w in sorted(set(text), key=lambda w: (-round(text.count(w) * idf[w], 6), w))]
    assert found == best(rows, wanted, 10)
    assert {1, 2} <= {d for _, d in found[0]}


def test_rows_and_lists_agree(monkeypatch):
    """Lists kept as rows or not, and whatever the floor, the best are the same."""
    rng = np.random.default_rng(11)
    n, terms = 2000, 300
    docs, which = np.nonzero(rng.random((n, terms)) < rng.random(terms) ** 4)
    tf, lengths = rng.integers(1, 6, len(docs)), rng.integers(5, 90, n)
    built = search.Index.build(np.arange(n), docs, which.astype(np.int64), tf, lengths)
    found = []
    for often in (0, 3, 12, 10**6):
        monkeypatch.setattr(search, "OFTEN", often)
        index = search.Searcher(search.Index.load(built.terms, built.dump()), 40.0, search.Bm25())
        assert (len(index.rows) > 0) == (often > 0)
        queries = [(index.places(np.append(-5, np.random.default_rng(q).permutation(terms)[: 40 * q + 1])), np.random.default_rng(q).random(40 * q + 2)) for q in range(8)]
        all_of = [index.top(p, i, 10) for p, i in queries]
        for (p, i), near, whole in zip(queries, index.often(queries), all_of, strict=True):
            for floor in (0.0, whole[4][0], whole[-1][0], whole[0][0] + 1):
                assert [x for x in index.top(p, i, 10, floor, near) if x[0] >= floor] == [x for x in whole if x[0] >= floor]
        found.append(all_of)
    assert all(f == found[0] for f in found)


def test_kin_share_rows():
    """Two languages in turn: each one's words, too rare for rows over all documents, are rows where its documents lie, and all is found."""
    rng = np.random.default_rng(12)
    n, own = 1600, 60
    docs, which = np.nonzero(rng.random((n, own)) < 0.06)
    which += np.where(docs % 2, 1000, 2000)
    docs, which = np.append(docs, np.arange(n)), np.append(which, np.where(np.arange(n) % 2, 1, 2))
    order = np.lexsort((which, docs))
    docs, which = docs[order].astype(np.int32), which[order]
    tf, lengths = rng.integers(1, 4, len(docs)).astype(np.int32), rng.integers(5, 40, n)
    built = search.Index.build(np.arange(n), docs, which, tf, lengths)
    assert (np.diff(built.doc_ids % 2) != 0).sum() < 40
    shard = search.Searcher(search.Index.load(built.terms, built.dump()), 20.0, search.Bm25())
    assert len(shard.listed) < len(docs) / 4
    for q in range(0, n, 100):
        terms = which[docs == q]
        idf = rng.random(len(terms)) + 0.5
        scores = np.zeros(n)
        for t, i in zip(terms, idf, strict=True):
            held = which == t
            scores[docs[held]] += i * (tf[held] * 2.2 / (tf[held] + 1.2 * (0.25 + 0.75 * lengths[docs[held]] / 20.0)))
        wanted = sorted((-round(s, 6), d) for d, s in enumerate(scores.tolist()) if s > 0)[:10]
        places = shard.places(terms)
        assert [(-s, d) for s, d in shard.top(places, idf, 10)] == wanted
        assert [(-s, d) for s, d in shard.top(places, idf, 10, -wanted[-1][0])] == wanted
        # A floor that splits the lists.
        assert [(-s, d) for s, d in shard.top(places, idf, 10, -wanted[0][0])] == [w for w in wanted if w[0] == wanted[0][0]]


def test_memory_of_a_shard():
    """Whatever the table's size, a full shard is built and loaded in what two workers have beside a JVM of 1800 MB under 3000."""
    n = search.SHARD_WORDS
    rng = np.random.default_rng(6)
    docs, lengths = np.repeat(np.arange(n // 400, dtype=np.int32), 400), np.full(n // 400, 400)
    terms, tf = rng.integers(0, n // 5, len(docs)), np.ones(len(docs), np.int32)
    tracemalloc.start()
    built = search.Index.build(np.arange(n // 400), docs, terms, tf, lengths)
    data = built.dump()
    own = built.terms
    del built
    search.Searcher(search.Index.load(own, data), 400.0, search.Bm25())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


def test_empty_search(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    index = search.build_index(docs)
    n, mean = search.totals(index)
    assert (n, mean) == (0, 0.0)
    said = search.said_terms(docs)
    assert search.top_k(index, search.keywords(said, search.document_frequencies(index, said), n), mean).count() == 0


def test_hilbert_curve_is_one():
    for d, bits in ((1, 4), (2, 4), (3, 2), (5, 1)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        keys = neighbours.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def nearest(rows, every, k):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = {}
    for q, a in good:
        if q % every == 0:
            scored = sorted((-float(reduce(lambda s, xy: s + xy[0] * xy[1], zip(a, b, strict=True), 0.0)), i) for i, b in good if i != q)
            out[q] = scored[:k]
    return out


def found_in(answers):
    found = {}
    for r in answers.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    return found


@pytest.mark.parametrize("c", [neighbours.Curves(), neighbours.Curves(window=8, block=16, part=40)])
def test_neighbours(spark, c):
    rng = np.random.default_rng(3)
    rows = [(i, np.float32(rng.integers(-4, 5, 6) / 4).tolist()) for i in range(300)]
    rows += [(400 + i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(60)] + [(500, None), (520, [0.0] * 6), (540, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (560, [float("nan")] * 6), (580, [1.0]), (None, [1.0] * 6), (4, rows[4][1]), (600, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", search.F.lit("x"))
    assert found_in(neighbours.nearest(df, 20, 7, c)) == nearest(rows, 20, 7)
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.where("vec_id = 500")).count() == 0


@pytest.mark.parametrize("c", [neighbours.Curves(), neighbours.Curves(window=16, block=32, part=64)])
def test_plateaus_between_different_vectors(spark, c):
    """All of 399 different vectors have one inner product with query 0, and many with each other."""
    rng = np.random.default_rng(8)
    rows = [(0, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])] + [(i, [0.5, *(rng.permutation([i, 1, 2, 3, 4]) / 8).tolist()]) for i in range(1, 400)]
    rows = [rows[i] for i in rng.permutation(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = found_in(neighbours.nearest(df, 50, 20, c))
    assert found[0] == [(-0.5, i) for i in range(1, 21)]
    assert found == nearest(rows, 50, 20)


def norms_of(kind, rng, n):
    return {"one": np.ones(n), "outlier": np.where(np.arange(n) == 7, 100.0, 1.0), "heavy": np.minimum(rng.pareto(1.5, n) + 1, 1e4), "wide": 10.0 ** rng.uniform(-6, 6, n)}[kind]


@pytest.mark.parametrize(("kind", "decay"), [("one", 0.85), ("one", 1.0), ("outlier", 0.85), ("heavy", 1.0), ("wide", 0.85)])
def test_nothing_is_missed(spark, kind, decay):
    """With and without structure, whatever the norms."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 32)) @ np.diag(decay ** np.arange(32))
    x *= (norms_of(kind, rng, 6000) / np.sqrt((x * x).sum(1)))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = found_in(neighbours.nearest(df, 200, 20, neighbours.Curves(block=256)))
    for q in range(0, 6000, 200):
        s = x @ x[q]
        s[q] = -np.inf
        assert {i for _, i in found[q]} == set(np.argsort(-s)[:20].tolist())


def test_blocks_pass_over_what_cannot_reach():
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(40, 16)), 50, 0) + 0.01 * rng.normal(size=(2000, 16))
    blocks = neighbours.Blocks(x, 50)
    floors = np.sort(x[::100] @ x.T, axis=1)[:, -5]
    who, where, met = blocks.reached(x[::100], floors, 5)
    assert met < 20 * 40 / 8
    for q in range(20):
        assert set(np.argsort(-(x @ x[q * 100]))[:5]) <= set(where[who == q])
