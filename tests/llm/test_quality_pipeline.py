import hashlib
import itertools
import random
import re

import numpy as np

import corpus_pipeline
from lumenframe.llm import common, mixing, near_dups, packing, quality, secrets
from tests.llm.test_near_dups import plain

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source", "lang", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 3 != 0"))
    held = docs.join(labels.where("doc_id % 3 = 0"), "doc_id")
    found = quality.with_posterior(held, model, quality.F.col("source"), quality.F.col("lang")).select("row.quality", "posterior").collect()
    good = np.array([r.quality for r in found])
    kept = np.array([r.posterior for r in found]) >= quality.THRESHOLD
    assert kept[good == 1].mean() > 0.99 and (~kept[good == 0]).mean() > 0.95


def test_rates_shrink_toward_their_parents(spark):
    rng = random.Random(1)
    rows = [("a", "a/x", 950_000)] * 200 + [("a", "a/y", 100_000)] + [("b", "b/x", 200_000)] * 200 + [("c", "c/x", rng.choice([100_000, 900_000])) for _ in range(3)]
    found = {r.path: r for r in quality.site_rates(spark.createDataFrame(rows, "host string, path string, p long")).collect()}
    prior = (sum(r[2] for r in rows) / 1e6 + 1) / (len(rows) + 2)
    assert abs(found["a/x"].prior - prior) < 1e-12
    assert abs(found["a/x"].path_rate - 0.95) < 0.02 and abs(found["b/x"].path_rate - 0.2) < 0.02
    assert found["a/y"].path_rate > 0.1
    mean = sum(r[2] for r in rows if r[0] == "c") / 3e6
    assert min(mean, prior) <= found["c/x"].host_rate <= max(mean, prior)


def plain_hierarchy(rows):
    """host, path and p of each document to host rate, path rate and posterior, in plain NumPy."""
    p = np.array([r[2] for r in rows])
    host, path = [r[0] for r in rows], [r[:2] for r in rows]
    prior = (p.sum() + 1) / (len(p) + 2)

    def rates(keys, priors):
        names = sorted(set(keys), key=repr)
        n = np.array([sum(k == x for k in keys) for x in names], float)
        good = np.array([sum(v for k, v in zip(keys, p, strict=True) if k == x) for x in names])
        base = np.array([priors(x) for x in names])
        chance = base * (1 - base)
        spread = ((n * (good / n - base) ** 2).sum() - chance.sum()) / n.sum()
        k = min(max((n * chance).sum() / n.sum() / spread, 1.0), 1e4) if spread > 0 else 1e4
        return {x: ((g + k * b) / (m + k), k, m, g) for x, m, g, b in zip(names, n, good, base, strict=True)}

    logit = lambda x: np.log(x / (1 - x))
    hosts = rates(host, lambda _: prior)
    paths = rates(path, lambda x: hosts[x[0]][0])
    out = []
    for h, t, v in zip(host, path, p, strict=True):
        rate, k, n, good = paths[t]
        others = np.clip((good - v + k * hosts[h][0]) / (n - 1 + k), 1e-6, 1 - 1e-6)
        out.append((hosts[h][0], rate, 1 / (1 + np.exp(-(logit(v) + logit(others) - logit(prior))))))
    return out


def test_hierarchy_against_plain_numpy(spark):
    rng = random.Random(5)
    texts = ["plain words of a text here", "!!! ??? ###", "A B C D 1 2 3", None, "", "x" * 9, "word " * 400]
    hosts = ["a", "b", "", None, "hot", "hot", "hot", "hot"]
    rows = [(k, rng.choice(hosts), rng.choice(["en", "", None]), rng.choice(texts)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    labels = spark.createDataFrame([(k, int(rows[k][3] is not None and rows[k][3].startswith(("plain", "word")))) for k in range(0, 200, 2)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert not isinstance(model, float)
    found = {r.doc_id: r for r in quality.with_posterior(docs, model, quality.F.col("source"), quality.F.concat_ws("/", "source", "lang")).select("row.doc_id", "p", "host_rate", "path_rate", "posterior").collect()}
    p = np.rint(np.clip(model(quality._expand(quality._measured([t or "" for *_, t in rows]))), 1e-6, 1 - 1e-6) * 1e6) / 1e6
    path = lambda s, x: "/".join(v for v in (s, x) if v is not None)
    wanted = plain_hierarchy([(s, path(s, x), float(v)) for (_, s, x, _), v in zip(rows, p, strict=True)])
    for k, (v, w) in enumerate(zip(p, wanted, strict=True)):
        r = found[k]
        assert np.allclose([r.p, r.host_rate, r.path_rate, r.posterior], [v, *w], rtol=1e-9, atol=1e-12), k
    assert len(found) == 200


def test_repeated_ids_in_the_fit(spark):
    """Which of an id's texts is fitted doesn't depend on where rows lie."""
    rows = [(k % 40, f"{'!' * (k % 7)} words {'A' * (k % 11)} here {k}") for k in range(120)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(1, 0)], "doc_id long, quality int")
    models = {quality.train(spark.createDataFrame(some, "doc_id long, text string").repartition(n), labels) for some, n in ((rows, 1), (rows[::-1], 5))}
    assert len(models) == 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (None, "s", "l", "some words here"), (2, "", "l", "")], "doc_id long, source string, lang string, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    # No label counts, so the evidence is (0 + 1) / (0 + 2) for all, and so are all rates: each posterior is the threshold.
    assert quality.train(docs, labels) == 0.5
    out = quality.with_posterior(docs, 0.5, quality.F.col("source"), quality.F.concat_ws("/", "source", "lang")).collect()
    assert len(out) == 4 and all(abs(r.posterior - 0.5) < 1e-9 and r.p == 0.5 for r in out)
    assert quality.with_posterior(docs, 0.9, quality.F.col("source"), quality.F.col("lang")).where("posterior > 0.8").count() == 4
    assert quality.keep_good(docs.limit(0), labels).count() == 0
    assert len(quality.measures("")) == len(quality.measures("a b")) == 10


def test_measures_of_very_long_texts():
    signs = "".join(chr(c) for c in range(0x2190, 0x2400))
    text = ("Ab 1! " + signs + " ") * 2_000
    found = quality.measures(text)
    assert abs(found[1] - 2_000 * (1 + len(signs)) / len(text)) < 1e-12 and abs(found[2] - 2_000 / len(text)) < 1e-12
    short = quality.measures(text[: len(text) // 2_000])
    assert np.allclose(found[1:4], short[1:4])


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], EMPTY)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, SF), name)
        assert docs.count() == 0 and (name == "packing" or docs.columns == [c.split()[0] for c in EMPTY.split(", ")])


def test_stages_of_odd_rows(spark):
    """Nulls in all columns, empty and very long texts, ties and repeated rows pass through each stage that isn't to drop them."""
    long = " ".join(f"word{k}" for k in range(30_000))
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", "a", 0), (2, None, "en", "a", None), (3, long, "en", "a", len(long)), (4, long, "en", "b", len(long)), (5, "a tie", None, "b", 5), (5, "a tie", None, "b", 5), (6, "token=abcdef1 in words", "en", None, 22)]
    docs = spark.createDataFrame(rows, EMPTY)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_dups"](spark, docs, SF).collect()
    # Copies leave one row; documents without words all stay.
    assert sorted((r.doc_id for r in kept if r.doc_id is not None)) == [1, 2, 3, 5, 6] and len(kept) == 7
    clean = stages["secrets"](spark, docs, SF).collect()
    assert len(clean) == len(rows) and {r.text for r in clean if r.doc_id == 6} == {"<assign> in words"}
    mixed = stages["mixing"](spark, docs, SF)
    size = mixed.agg(mixing.F.sum(common.word_count(mixing.F.col("text")))).first()[0]
    assert size == int(1.5 * sum(len((r[1] or "").split()) for r in rows))
    packed = stages["packing"](spark, docs, SF).collect()
    assert len(packed) == len(rows) and len({(r.bucket, r.batch, r.slot) for r in packed}) == len(rows)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = common.materialize(stage(spark, docs, SF), name)
        assert name == "packing" or docs.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in inputs["near_dups"].collect()}
    every = {r.doc_id for r in inputs["quality"].collect()}
    assert {d for d in every if labels.get(d) == 1} <= kept
    assert not {d for d in every - kept if labels.get(d) == 1}
    before = near_dups.near_duplicates(inputs["near_dups"]).collect()
    after = {r.doc_id for r in inputs["secrets"].collect()}
    assert after == {r.component_id for r in before}
    clean = secrets.BlobLedger(spark, common.scratch(spark, "ledger")).scan(inputs["mixing"].select("doc_id", "text"))
    assert clean.where("size(spans) > 0").count() == 0
    assert {r.doc_id for r in inputs["mixing"].collect()} == after
    words = lambda df: df.agg(mixing.F.sum(common.word_count(mixing.F.col("text")))).first()[0]
    assert abs(words(inputs["packing"]) - 1.5 * words(inputs["mixing"])) < 1
    assert docs.count() == inputs["packing"].count()
    assert docs.select("bucket", "batch", "slot").distinct().count() == docs.count()
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def plain_redaction(text):
    """A text with the stretches that any rule finds replaced."""
    found = []
    for rank, rule in enumerate(secrets.RULES.rules):
        found += [(m.start(), rank, m.end(), rule.kind) for m in re.finditer(rule.pattern, text or "", re.A) if len(m[rule.group]) >= rule.least]
    out, at = [], 0
    for start, _, end, kind in sorted(found):
        if start < at:
            at = max(at, end)
        else:
            out, at = [*out, text[at:start], f"<{kind}>"], end
    return "".join([*out, text[at:]]) if found else text


WORD = re.compile(common.WORD)


def size_of(text):
    return len(WORD.findall(text or ""))


def key_of(doc_id, text):
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    return md5(f"{'' if doc_id is None else doc_id}:{'' if text is None else md5(text)}")


def plain_mix(rows):
    """Rows (doc_id, text, source) served in order of virtual finish time, cut once."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size_of(text)
    names = sorted((n for n in sizes if n is not None), key=str.encode) + [None] * (None in sizes)
    weight = {n: float(mixing.WEIGHTS[k % 3]) for k, n in enumerate(names)}
    order = sorted(names, key=lambda n: (2.0 * sizes[n] / weight[n], n is None, (n or "").encode()))
    budget, used, level = 1.5 * sum(sizes.values()), 0.0, None
    for k, n in enumerate(order):
        level = (budget - used) / sum(weight[x] for x in order[k:])
        if 2.0 * sizes[n] / weight[n] > level:
            break
        used, level = used + 2.0 * sizes[n], None
    target = {n: 2.0 * sizes[n] if level is None else min(2.0 * sizes[n], weight[n] * level) for n in names}
    entries, out = [], [r for r in rows if not size_of(r[1])]
    for n in names:
        upto = 0
        for key, row in sorted((key_of(r[0], r[1]), r) for r in rows if r[2] == n and size_of(r[1])):
            upto += size_of(row[1])
            entries += [((turn * sizes[n] + upto) / target[n], "" if n is None else f"={n}", key, turn, row) for turn in (0, 1)]
    left = int(budget)
    for *_, row in sorted(entries):
        size = size_of(row[1])
        if left >= size:
            out.append(row)
        elif left > 0:
            out.append((row[0], "".join(re.findall(r"[\x20\x09-\x0D]*" + common.WORD, row[1])[:left]), row[2]))
        left -= size
    return out


def plain_pack(rows):
    """Rows (doc_id, text, source) with their place, limits by the plain recurrence."""
    lengths = sorted({size_of(r[1]) for r in rows})
    counts = [sum(size_of(r[1]) == x for r in rows) for x in lengths]
    upto = [0, *itertools.accumulate(counts)]
    total, came = [0, *(size * m for size, m in zip(lengths, upto[1:], strict=True))], []
    for _ in range(1, min(packing.BUCKETS, len(lengths))):
        best = [min((total[i] + lengths[j - 1] * (upto[j] - upto[i]), i) for i in range(j)) for j in range(1, len(lengths) + 1)]
        if best[-1][0] >= total[-1]:
            break
        total, came = [0, *(b[0] for b in best)], [*came, [0, *(b[1] for b in best)]]
    limits, at = {lengths[-1]}, len(lengths)
    for start in reversed(came):
        at = start[at]
        if not at:
            break
        limits.add(lengths[at - 1])
    out = []
    for bucket, limit in enumerate(sorted(limits)):
        inside = [r for r in rows if next(x for x in sorted(limits) if size_of(r[1]) <= x) == limit]
        holds = max(1, packing.BUDGET // max(limit, 1))
        out += [(r[0], r[2], size_of(r[1]), bucket, limit, k // holds, k % holds) for k, r in enumerate(sorted(inside, key=lambda r: key_of(r[0], r[1])))]
    return out


def test_pipeline_against_plain_python(spark):
    """All five stages over whole tables, each in plain Python over what the one before it kept."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang", "source").collect()
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    p = np.rint(np.clip(model(quality._expand(quality._measured([r.text or "" for r in rows]))), 1e-6, 1 - 1e-6) * 1e6) / 1e6
    sites = [(r.source, "/".join(v for v in (r.source, r.lang) if v is not None), float(v)) for r, v in zip(rows, p, strict=True)]
    good = [r for r, x in zip(rows, plain_hierarchy(sites), strict=True) if x[2] >= quality.THRESHOLD]
    assert 0 < len(good) < len(rows) and len({r.doc_id for r in good}) == len(good)
    groups = plain([(r.doc_id, r.text) for r in good], near_dups.Settings().words)
    once = [r for r, (d, n, component) in zip(good, groups, strict=True) if n == 0 or d == component]
    assert len(once) < len(good)
    clean = [(r.doc_id, plain_redaction(r.text), r.source) for r in once]
    assert any(a[1] != b.text for a, b in zip(clean, once, strict=True))
    wanted = plain_pack(plain_mix(clean))
    found = [tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "source", "length", "bucket", "bucket_length", "batch", "slot").collect()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)
