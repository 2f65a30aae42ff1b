import itertools
import random
import re
import time

import numpy as np
import pytest

from lumenframe.llm import common, mixing, packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by sharing again and again."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: weights[k % 3] for k, n in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        unit = left / sum(weight[n] for n in free)
        over = {n for n in free if weight[n] * unit >= most * sizes[n]}
        if not over:
            target |= {n: weight[n] * unit for n in free}
            break
        for n in over:
            target[n] = most * sizes[n]
            left -= target[n]
        free -= over
    return target


def rows(rng, n):
    sources = ["a", "b", "é", "Z", None, "hot"]
    return [(rng.choice([i, i, i, None]), rng.choice(sources[:5] + ["hot"] * 5), None if rng.random() < 0.05 else " ".join("w" * rng.randint(0, 30)) + rng.choice(["", " x\n", " "]), 7) for i in range(n)]


@pytest.mark.parametrize(("seed", "copies"), [(1, 50_000), (2, 3)])
def test_mix(spark, monkeypatch, seed, copies):
    monkeypatch.setattr(mixing, "COPIES", copies)
    data = rows(random.Random(seed), 300)
    data += data[:5] + [(None, "hot", "same words here", 7)] * 10 + [(None, "a", None, 7)] * 4
    docs = spark.createDataFrame(data, "doc_id long, source string, text string, size int").select("doc_id", "source", "text", "size")
    size = lambda t: len(WORD.findall(t or ""))
    totals = {}
    for _, s, t, _ in data:
        totals[s] = totals.get(s, 0) + size(t)
    wanted = water(totals)
    turns = mixing.schedule(docs).collect()
    assert len(turns) == sum(2 if size(t) else 1 for _, _, t, _ in data)
    taken = {}
    for r in turns:
        source = r.sk[1:] if r.sk else None
        assert r.source_size == totals[source] and abs(r.target - wanted[source]) < 1e-6 and 0 <= r.taken <= r.size
        taken[source] = taken.get(source, 0) + r.taken
    # Served whole and cut once: at a source's target, but for a document or two of 31 words.
    assert all(abs(taken[s] - wanted[s]) <= 62 for s in wanted)
    assert sum(taken.values()) == int(1.5 * sum(totals.values()))
    assert sum(0 < r.taken < r.size for r in turns) <= 1
    by_time = sorted((r.finish, r.taken == r.size) for r in turns if r.size)
    assert [whole for _, whole in by_time] == sorted((whole for _, whole in by_time), reverse=True)
    again = mixing.schedule(docs.repartition(3)).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, turns)) == sorted(map(key, again))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(size(r.text) for r in mixed.collect()) == sum(taken.values())


def test_rows_without_ids_spread(spark):
    rows = spark.range(20_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'s' AS source", "CAST(id AS STRING) AS text")
    turns = mixing.schedule(rows)
    assert turns.select("key").distinct().count() == 20_000
    spread = rows.select(common.hash_range(common.row_key(), 64).alias("r")).groupBy("r").count().collect()
    assert len(spread) == 64 and max(r["count"] for r in spread) < 500
    assert turns.agg(mixing.F.sum("taken")).first()[0] == 30_000


def test_no_documents_or_words(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.schedule(spark.createDataFrame([], schema)).count() == 0
    empty = spark.createDataFrame([(1, None, None), (2, "a", " ")], schema)
    assert {(r.target, r.taken) for r in mixing.schedule(empty).collect()} == {(0.0, 0)}
    assert mixing.mix(empty).count() == 2


def padding(lengths, counts, limits):
    return sum(min(x for x in limits if x >= n) * c for n, c in zip(lengths, counts, strict=True))


def test_best_limits():
    rng = random.Random(3)
    for _ in range(60):
        lengths = sorted(rng.sample(range(0, 60), rng.randint(1, 8)))
        counts = [rng.randint(1, 9) for _ in lengths]
        for buckets in (1, 2, 3):
            found = packing.best_limits(lengths, counts, buckets)
            best = min(padding(lengths, counts, [*c, lengths[-1]]) for k in range(buckets) for c in itertools.combinations(lengths[:-1], min(k, len(lengths) - 1)))
            assert len(found) <= buckets and padding(lengths, counts, found) == best


def quadratic(lengths, counts, buckets):
    """The least padded total by the plain recurrence."""
    upto = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0], np.array(lengths) * upto[1:]])
    for _ in range(1, buckets):
        total = np.array([0, *(min(total[i] + lengths[j - 1] * (upto[j] - upto[i]) for i in range(j)) for j in range(1, len(lengths) + 1))])
    return int(total[-1])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_limits_of_long_lengths(seed):
    rng = random.Random(seed)
    lengths = sorted({int(rng.paretovariate(0.5)) % 40_000 for _ in range(300)} | {513, 600, 5_000, 20_000})
    counts = [rng.choice([1, 1, 2, 900]) for _ in lengths]
    for buckets in (2, 5, 16):
        limits = packing.best_limits(lengths, counts, buckets)
        assert len(limits) <= buckets and limits[-1] == lengths[-1]
        assert padding(lengths, counts, limits) == quadratic(lengths, counts, buckets)


def test_limits_among_equals():
    """Of limits with the same padding, those that the plain recurrence gives by the lowest places."""
    rng = random.Random(7)
    for _ in range(1500):
        n, buckets = rng.randint(1, 9), rng.randint(1, 5)
        lengths, counts = sorted(rng.sample(range(12), n)), [rng.randint(1, 3) for _ in range(n)]
        upto = [0, *itertools.accumulate(counts)]
        total, came = [0, *(size * m for size, m in zip(lengths, upto[1:], strict=True))], []
        for _ in range(1, min(buckets, n)):
            best = [min((total[i] + lengths[j - 1] * (upto[j] - upto[i]), i) for i in range(j)) for j in range(1, n + 1)]
            if best[-1][0] >= total[n]:
                break
            total, came = [0, *(b[0] for b in best)], [*came, [0, *(b[1] for b in best)]]
        limits, at = {lengths[-1]}, n
        for start in reversed(came):
            at = start[at]
            limits |= {lengths[at - 1]} if at else set()
            if not at:
                break
        assert packing.best_limits(lengths, counts, buckets) == sorted(limits), (lengths, counts, buckets)


def test_limits_of_many_lengths_are_quick():
    begin = time.process_time()
    packing.best_limits(list(range(50_000)), [1 + k % 7 for k in range(50_000)])
    assert time.process_time() - begin < 20


@pytest.mark.parametrize(("copies", "maps"), [(50_000, False), (3, False), (3, True)])
def test_packing(spark, monkeypatch, copies, maps):
    monkeypatch.setattr(packing, "COPIES", copies)
    rng = random.Random(4)
    data = [(i, "w " * rng.choice([0, 3, 9, 50, 51, 400])) for i in range(500)] + [(None, None), (7, "w w"), (7, "w w")] + [(None, "w w w")] * 40
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("batch", packing.F.lit("x"))
    docs = docs.withColumn("pairs", packing.F.create_map(packing.F.lit("a"), packing.F.lit(1))) if maps else docs
    found = packing.pack(docs, buckets=4, budget=300).collect()
    assert len(found) == len(data)
    assert sorted(map(repr, found)) == sorted(map(repr, packing.pack(docs.repartition(5), buckets=4, budget=300).collect()))
    assert len({(r.bucket, r.batch, r.slot) for r in found}) == len(found)
    for r in found:
        assert r.length <= r.bucket_length and (r.slot + 1) * r.bucket_length <= 300 or r.slot == 0
    for b in {r.bucket for r in found}:
        sizes = {}
        for r in found:
            if r.bucket == b:
                sizes[r.batch] = sizes.get(r.batch, 0) + 1
        holds = max(1, 300 // max(1, next(r.bucket_length for r in found if r.bucket == b)))
        assert sorted(sizes) == list(range(len(sizes))) and all(n == holds for k, n in sizes.items() if k < len(sizes) - 1)
    assert packing.pack(docs.limit(0)).count() == 0
