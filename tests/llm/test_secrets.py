import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lumenframe.llm import common, secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
LONG = "deadbeef" * 4
ODD = ["", None, "token=token:abcdef", "PassWord = 'abcdef'", "api_key:short", "AKIA" + "A" * 16, "AKIAA", f"é日 {LONG} x", f"{LONG}" * 3, "secret=a.b+c/d= passwd:zzzzzz", "x" * 50_000 + f" token={LONG}", f"ghp_{'a' * 36} " * 200, "-----BEGIN RSA PRIVATE KEY-----", "token:abcdef " * 300]


def plain(text):
    """Base spans by the regular expressions themselves."""
    found = []
    for kind, pattern, group, least in (("assign", ASSIGN, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)):
        found += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return ",".join(x[2] for x in sorted(found))


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secrets.BlobLedger(spark, common.scratch(spark, "ledger")).scan(docs)
    base = secrets.F.filter("spans", lambda s: s["rank"] < 3)
    return {r.doc_id: r for r in found.select("doc_id", secrets.span_text(base).alias("base"), secrets.span_text(secrets.F.col("spans")).alias("every"), "spans").collect()}


def test_base_spans(spark):
    found = scanned(spark, ODD)
    assert {i: r.base for i, r in found.items()} == {i: plain(t) for i, t in enumerate(ODD)}
    assert found[11].every.count("forge_token") == 200 and "private_key:0:31" in found[12].every


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.lists(st.sampled_from(["token", "SECRET", "api_key", "=", ":", " ", "'", '"', "abcdef", "AKIA", "A" * 17, "0" * 25, "é", "\n", "."]), max_size=25).map("".join), min_size=30, max_size=60))
def test_random_texts(spark, texts):
    assert [r.base for _, r in sorted(scanned(spark, texts).items())] == [plain(t) for t in texts]


def test_ledger_scans_only_what_is_new(spark):
    ledger = secrets.BlobLedger(spark, common.scratch(spark, "ledger"))
    one = spark.createDataFrame([(1, "token=abcdef", "p"), (2, "token=abcdef", "q"), (None, None, None)], "doc_id long, text string, blob string")
    assert ledger.unseen(one, secrets.RULES).count() == 2
    first = ledger.scan(one).collect()
    assert len(first) == 3 and sum(len(r.spans) for r in first) == 2
    two = spark.createDataFrame([(3, "token=abcdef"), (4, "new")], "doc_id long, text string")
    assert [r.text for r in ledger.unseen(two, secrets.RULES).collect()] == ["new"]
    ledger.scan(two)
    assert ledger.findings("1").count() == 3
    assert ledger.unseen(two, secrets.RuleSet("2", secrets.BASE)).count() == 2
    assert ledger.scan(two.limit(0)).count() == 0


def test_ledger_with_doubled_and_missing_pairs(spark):
    """Two scans at once append a pair twice; a lost driver leaves some pairs out, and files that no reader takes."""
    path = common.scratch(spark, "ledger")
    ledger = secrets.BlobLedger(spark, path)
    docs = spark.createDataFrame([(1, "token=abcdef"), (2, "token=abcdef"), (3, "secret=ghijkl"), (4, "plain words without one"), (5, "")], "doc_id long, text string")
    wanted = sorted((r.doc_id, len(r.spans)) for r in ledger.scan(docs).collect())
    assert wanted == [(1, 1), (2, 1), (3, 1), (4, 0), (5, 0)]
    held = spark.createDataFrame(spark.read.parquet(path).collect(), secrets.BlobLedger.SCHEMA)
    held.write.mode("append").partitionBy("rule_version").parquet(path)
    assert sorted((r.doc_id, len(r.spans)) for r in ledger.attach(docs).collect()) == wanted
    assert ledger.findings("1").count() == 4 and ledger.unseen(docs, secrets.RULES).count() == 0
    assert sorted((r.doc_id, len(r.spans)) for r in ledger.scan(docs).collect()) == wanted

    other = common.scratch(spark, "ledger")
    held.where(secrets.F.size("spans") == 0).write.partitionBy("rule_version").parquet(other)
    held.write.parquet(f"{other}/_temporary/0/task")
    lost = secrets.BlobLedger(spark, other)
    assert lost.unseen(docs, secrets.RULES).count() == 2
    assert sorted((r.doc_id, len(r.spans)) for r in lost.scan(docs).collect()) == wanted


def test_very_many_matches(spark):
    texts = [f"token=abcdef{k % 10} " * 20_000 for k in range(2)] + ["0123456789abcdef01234567 é " * 5_000]
    assert [r.base for _, r in sorted(scanned(spark, texts).items())] == [plain(t) for t in texts]


def test_shortest(spark):
    """Every rule needs that many characters."""
    for text in ("token=abcdef", "AKIA" + "A" * 16, "0" * 24, "-----BEGIN PRIVATE KEY-----", "ghp_" + "a" * 36):
        assert len(text) >= secrets.SHORTEST and scanned(spark, [text])[0].every


def test_redaction(spark):
    docs = spark.createDataFrame([(1, f"é token={LONG} end AKIA{'B' * 16}"), (2, "plain")], "doc_id long, text string")
    found = secrets.BlobLedger(spark, common.scratch(spark, "ledger")).scan(docs)
    out = {r.doc_id: r.t for r in found.select("doc_id", secrets.redact(secrets.F.col("text"), secrets.F.col("spans")).alias("t")).collect()}
    assert out == {1: "é <assign> end <access>", 2: "plain"}


def test_digest(spark):
    found = secrets.op1_secret_scans(spark, "/root/testdata/sf0.01").where("spans != ''").collect()
    assert found
    for r in found:
        base = ",".join(s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex"))
        assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256


@pytest.mark.parametrize("name", ["op1_secret_scans"])
def test_native_plan(spark, name):
    plan = secrets.op1_secret_scans(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
