import random

import numpy as np
import pytest

from lumenframe.llm import near_dups
from lumenframe.llm.components import connected_components


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def plain(rows, n):
    """Components of all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            # Sets of such different sizes can't have enough in common.
            if 100 * min(len(sets[i]), len(sets[j])) < 80 * max(len(sets[i]), len(sets[j])):
                continue
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return [(d, len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def corpus(rng):
    words = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            copy = [w if rng.random() > rng.choice([0, 0.01, 0.03]) else rng.choice(words) for w in base]
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy)))
    # A star: copies of a text that are like it, but not like each other.
    base = [rng.choice(words) for _ in range(200)]
    for k in range(40):
        copy = list(base)
        for at in range(k % 5, 200, 42):
            copy[at] = f"x{k}"
        rows.append((len(rows), " ".join(copy)))
    rows.append((len(rows), " ".join(base)))
    rows += [(1000, None), (1001, ""), (1002, "  "), (5, "w1 w2"), (1003, "w1 W2"), (None, "w1 w2"), (3, rows[3][1]), (None, "alone here now and then")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "words"), [(1, 4), (2, 5)])
def test_against_all_pairs(spark, seed, words):
    rows = corpus(random.Random(seed))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", near_dups.F.lit(1))
    s = near_dups.Settings(words=words)
    found = near_dups.near_duplicates(docs, s).collect()
    wanted = plain(rows, words)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == sorted(wanted, key=repr)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    kept = near_dups.deduplicate(docs, s)
    assert kept.columns == docs.columns
    groups = {(c if c is not None else "none") for d, n, c in wanted if n}
    assert kept.where("trim(text) != ''").count() == len(groups)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_dups.near_duplicates(docs).count() == near_dups.deduplicate(docs).count() == 0


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK_SHINGLES", 900)
    rows = corpus(random.Random(5))
    found = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_dups.CONTRACT).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == sorted(plain(rows, 4), key=repr)


def test_pruning_keeps_similar_pairs():
    s = near_dups.Settings()
    least = near_dups.least_matches(s)
    rng = np.random.default_rng(1)
    left = rng.integers(0, 65536, (20_000, s.hashes)).astype(np.uint16)
    right = np.where(rng.random(left.shape) < 0.8, left, left + np.uint16(1))
    assert len(near_dups.survivors(left, right, s, least)) == len(left)
    far = np.where(rng.random(left.shape) < 0.4, left, left + np.uint16(1))
    assert len(near_dups.survivors(left, far, s, least)) < 10


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (3, 1)]
    found = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    full = {**found, **{c: c for c in found.values()}}
    assert {full[k] for k in range(41)} == {0} and {full[k] for k in (90, 95, 100)} == {90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_star_with_very_many_links(spark):
    """Its centre's links are joined as any others, with skewed keys split."""
    edges = [(0, k) for k in range(1, 4000)] + [(5000, k) for k in range(5001, 9000, 2)] + [(5001, 8999), (3999, 10_000)]
    keys = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        found = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {k: 0 for k in [*range(1, 4000), 10_000]} | {k: 5000 for k in range(5001, 9000, 2)}


def test_very_long_texts(spark):
    words = [f"w{k * 7919 % 10_007}" for k in range(60_000)]
    near = [w if k % 200 else "x" for k, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[::-1])), (4, "w1 " * 50_000)]
    found = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_dups.CONTRACT).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(plain(rows, 4))
