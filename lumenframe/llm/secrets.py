"""Secret scans over an incremental ledger of content-addressed blobs.

Each version of a text is a blob, named by its SHA-256.  A ledger in the shared
folder says which (blob, rule version) pairs have been scanned and what was
found; a scan reads only pairs that it doesn't hold, appends them, and joins
findings back to every row that has the blob.  All of it is native.

A ledger may hold a pair twice, as after two scans at once, or only some pairs
of a scan, as after a lost driver: what is read from it has each pair once, and
the next scan finds what lacks.

Defined cases: a null text is an empty one; repeated rows each get their blob's
findings, once for each row; texts too short for any finding have no partner to
meet, so however many they are, they spread; an empty table gives an empty
result; a column that is named like an output is replaced, and others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import common

SPAN = "struct<start: long, rank: int, end: long, kind: string>"
#: Spans whose lengths are summed together when places are computed.
CHUNK = 64
#: No rule matches a text of fewer characters.
SHORTEST = 12


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


@dataclass(frozen=True)
class RuleSet:
    version: str
    rules: tuple[Rule, ...]


#: The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a shorter run can't hold one, so the bound may stand in the pattern

BASE = (Rule("assign", ASSIGN, 2, 6), Rule("access", ACCESS, 0, 20), Rule("hex", HEX, 0, 24))
RULES = RuleSet(
    "1",
    (
        *BASE,
        Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
        Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
        Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ),
)


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


def find_spans(df: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """``df`` with ``spans``: an array of (start, rank, end, kind) in code points, by start, then rule.

    Places come from the lengths of the matches and of the parts between them.
    Sums run over chunks of matches, so many matches in a text cost little more
    than their number.
    """
    body = F.col(text)
    none = F.array().cast("array<string>")
    kinds: list[str] = []
    for k, r in enumerate(rules):
        matched = body.rlike(r.pattern)
        df = df.withColumns(
            {
                f"_m{k}": F.when(matched, F.regexp_extract_all(body, F.lit(r.pattern), F.lit(0))).otherwise(none),
                f"_g{k}": F.when(matched, F.regexp_extract_all(body, F.lit(r.pattern), F.lit(r.group))).otherwise(none) if r.group else F.lit(None),
                f"_p{k}": F.when(matched, F.split(body, r.pattern, -1)).otherwise(none),
            }
        )
        kinds += [f"_m{k}", f"_g{k}", f"_p{k}"]
    kept = [c for c in df.columns if c not in (*kinds, text)]
    lengths = lambda c: F.transform(F.col(c), lambda s: F.length(s).cast("long"))
    df = df.select(*kept, text, *(x for k, r in enumerate(rules) for x in (lengths(f"_m{k}").alias(f"_m{k}"), (lengths(f"_g{k}") if r.group else lengths(f"_m{k}")).alias(f"_g{k}"), lengths(f"_p{k}").alias(f"_p{k}"))))
    df = df.withColumns({f"_s{k}": F.zip_with(f"_m{k}", F.slice(f"_p{k}", F.lit(1), F.size(f"_m{k}")), lambda m, p: m + p) for k in range(len(rules))})
    chunks = lambda k: F.when(F.size(f"_m{k}") > 0, F.sequence(F.lit(0), ((F.size(f"_m{k}") - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))

    def chunk_sums(k: int) -> Column:
        return F.transform(chunks(k), lambda c: _sum(F.slice(f"_s{k}", c * CHUNK + 1, F.lit(CHUNK))))

    def big_sums(k: int) -> Column:
        """Sums of chunks of chunks."""
        big = F.when(F.size(f"_c{k}") > 0, F.sequence(F.lit(0), ((F.size(f"_c{k}") - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(big, lambda c: _sum(F.slice(f"_c{k}", c * CHUNK + 1, F.lit(CHUNK))))

    def before_big(k: int) -> Column:
        return F.transform(F.col(f"_d{k}"), lambda _, i: _sum(F.slice(f"_d{k}", F.lit(1), i)))

    def before_chunks(k: int) -> Column:
        inside = lambda i: _sum(F.slice(f"_c{k}", (i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK))
        return F.transform(F.col(f"_c{k}"), lambda _, i: F.get(f"_e{k}", (i / CHUNK).cast("int")) + inside(i))

    for name, made in (("_c", chunk_sums), ("_d", big_sums), ("_e", before_big), ("_b", before_chunks)):
        df = df.withColumns({f"{name}{k}": made(k) for k in range(len(rules))})

    def spans(k: int, r: Rule) -> Column:
        def one(m: Column, i: Column) -> Column:
            chunk = (i / CHUNK).cast("int")
            start = F.get(f"_b{k}", chunk) + _sum(F.slice(f"_s{k}", chunk * CHUNK + 1, i % CHUNK)) + F.get(f"_p{k}", i)
            return F.struct(start.alias("start"), F.lit(k).alias("rank"), (start + m).alias("end"), F.lit(r.kind).alias("kind"), F.get(f"_g{k}", i).alias("size"))

        found = F.filter(F.transform(f"_m{k}", one), lambda s: s["size"] >= r.least)
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))

    return df.select(*kept, text, F.array_sort(F.concat(*(spans(k, r) for k, r in enumerate(rules)))).cast(f"array<{SPAN}>").alias("spans"))


class BlobLedger:
    """What has been scanned, at ``path`` in storage that all executors share."""

    SCHEMA = f"blob binary, spans array<{SPAN}>, rule_version string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _held(self, version: str) -> DataFrame:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("rule_version") == version)

    def findings(self, version: str) -> DataFrame:
        """All blobs scanned under ``version`` with what was found in each, one row for each."""
        return self._held(version).dropDuplicates(["blob"])

    def unseen(self, rows: DataFrame, rules: RuleSet, text: str = "text") -> DataFrame:
        """One row (blob, text) for each blob of ``rows`` that wasn't scanned under these rules."""
        body = common.text_or_empty(text)
        blobs = rows.select(blob_id(body).alias("blob"), body.alias("text"))
        # Copies of a text meet in the map-side half of the aggregation, before any shuffle;
        # the anti join then has its rows where they are.
        once = blobs.groupBy("blob").agg(F.first("text").alias("text"))
        return once.join(self._held(rules.version).select("blob"), "blob", "left_anti")

    def scan(self, rows: DataFrame, rules: RuleSet = RULES, text: str = "text") -> DataFrame:
        """Scan what is unseen, add it to the ledger, and return ``rows`` with blob and spans."""
        found = find_spans(self.unseen(rows, rules, text), rules.rules).select("blob", "spans", F.lit(rules.version).alias("rule_version"))
        found.write.mode("append").partitionBy("rule_version").parquet(self.path)
        return self.attach(rows, rules, text)

    def attach(self, rows: DataFrame, rules: RuleSet = RULES, text: str = "text") -> DataFrame:
        """``rows`` with their blob and its spans; a blob without any needs no partner."""
        kept = [c for c in rows.columns if c not in ("blob", "spans")]
        # What has no spans needs no row, so copies of a pair are dropped among the others only.
        some = self._held(rules.version).where(F.size("spans") > 0).dropDuplicates(["blob"]).select(F.col("blob").alias("_meets"), "spans")
        blob = blob_id(F.col(text))
        alone = F.concat(F.lit("alone "), F.monotonically_increasing_id().cast("string")).cast("binary")
        meets = F.when(F.length(common.text_or_empty(text)) >= SHORTEST, blob).otherwise(alone)
        addressed = rows.select(*kept, blob.alias("blob"), meets.alias("_meets"))
        return addressed.join(some, "_meets", "left").withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>"))).select(*kept, "blob", "spans")


def span_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each stretch that spans cover replaced by ``<kind>`` of its first span."""
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))

    def step(s: Column, x: Column) -> Column:
        overlaps = x["start"] < s["at"]
        between = F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        return F.when(overlaps, state(F.greatest(s["at"], x["end"]), s["out"])).otherwise(state(x["end"], F.concat(s["out"], F.array(F.concat(between, F.lit("<"), x["kind"], F.lit(">"))))))

    zero = state(F.lit(0).cast("long"), F.array().cast("array<string>"))
    end = F.aggregate(spans, zero, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, end).otherwise(text)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table("documents")(spark, sf_dir).select("doc_id", "text")
    found = BlobLedger(spark, common.scratch(spark, "blob-ledger")).scan(docs)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


_ASSIGN_SQL = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _oracle() -> str:
    """The same by the lengths of matches and of the parts between them."""
    kinds = [(r.kind, _ASSIGN_SQL if r.kind == "assign" else r.pattern, r.group, r.least) for r in RULES.rules]
    cases = "\nUNION ALL ".join(
        f"SELECT rid, {k} AS rank, '{kind}' AS kind, regexp_extract_all(body, '{p}', 0) AS m, regexp_extract_all(body, '{p}', {g}) AS g, string_split_regex(body, '{p}') AS p, {least} AS least FROM d WHERE regexp_matches(body, '{p}')" for k, (kind, p, g, least) in enumerate(kinds)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
found AS ({cases}),
each AS (SELECT rid, rank, kind, least, i, length(m[i]) AS ml, length(g[i]) AS gl, length(p[i]) AS pl
  FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM found)),
placed AS (SELECT *, CAST(sum(ml + pl) OVER (PARTITION BY rid, rank ORDER BY i) AS BIGINT) AS e FROM each),
spans AS (SELECT rid, rank, kind, e - ml AS s, kind || ':' || CAST(e - ml AS VARCHAR) || ':' || CAST(e AS VARCHAR) AS say FROM placed WHERE gl >= least),
by_row AS (SELECT rid, count(*) FILTER (WHERE rank = 0) AS a, count(*) FILTER (WHERE rank = 1) AS b, count(*) FILTER (WHERE rank = 2) AS c,
  string_agg(say, ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base, string_agg(say, ',' ORDER BY s, rank) AS every FROM spans GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN by_row USING (rid)"""


QUERIES = {"op1_secret_scans": op1_secret_scans}
ORACLE_SQL = {"op1_secret_scans": _oracle()}
