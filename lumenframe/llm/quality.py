"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

A logistic model of plain text measures, fitted on a bounded sample of labelled
rows, gives each document its own evidence.  Grouped sums of that evidence give
each host and each path a rate of good documents.  A host's rate is shrunk
toward the global one, a path's toward its host's, the more the fewer documents
it has; how much is estimated from the spread between groups.  A document's
posterior joins its evidence with its path's rate, its own share of it left out.

Evidence is summed as whole millionths, so results don't depend on the order.

Defined cases: a null text is an empty one; a null host or path is one of its
own, apart from an empty one; repeated rows each count; a doc_id with several
labels is good if one of them says so, and of its texts the smallest is fitted;
without labels of both kinds the evidence is the labels' smoothed rate; an empty
table gives an empty result; other columns are kept by ``keep_good``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import common

#: Labelled rows used for fitting, at most: those of the smallest hash of doc_id.
SAMPLE = 20_000
#: Documents with a posterior below this are rejected.
THRESHOLD = 0.5
MILLION = 1_000_000


def measures(text: str) -> list[float]:
    """What the model knows of a text."""
    words = text.split()
    if not words:
        return [1.0, *([0.0] * 9)]
    n, chars = len(words), len(text)
    counts = Counter(words)
    upper = digits = signs = 0
    # Letters without case and small ones aren't counted; where many others occur, one pass counts all.
    counted = [c for c in set(text) if c.isupper() or c.isdigit() or not (c.isalnum() or c.isspace())]
    number = Counter(text).__getitem__ if len(counted) > 100 else text.count
    for c in counted:
        if c.isupper():
            upper += number(c)
        elif c.isdigit():
            digits += number(c)
        else:
            signs += number(c)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = text.split("\n")
    return [
        0.0,
        signs / chars,
        upper / chars,
        digits / chars,
        1 - len(counts) / n,
        counts.most_common(1)[0][1] / n,
        repeats / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n)),
        chars / n / 10,
    ]


@dataclass(frozen=True)
class Model:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        z = (rows - np.array(self.mean)) / np.array(self.scale) @ np.array(self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -13, 13)))


def fit_model(rows: np.ndarray, good: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Model:
    """Logistic regression by Newton's method on squares too, on standard scores."""
    wide = _expand(rows)
    mean, scale = wide.mean(0), wide.std(0)
    scale[scale < 1e-9] = 1.0
    x = np.column_stack([(wide - mean) / scale, np.ones(len(wide))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (good - p) - penalty * w
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
    return Model(tuple(mean), tuple(scale), tuple(w[:-1]), float(w[-1]))


def _expand(rows: np.ndarray) -> np.ndarray:
    return np.column_stack([rows, np.sqrt(rows)])


def _measured(texts: list[str]) -> np.ndarray:
    return np.array([measures(t) for t in texts]).reshape(len(texts), 10)


def evidence(model: Model | float) -> Callable[[Column], Column]:
    """An Arrow function from texts to millionths of the chance that they are good."""

    @F.arrow_udf("long")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [np.empty(0)]
            for at in range(0, len(batch), 256):
                texts = [t or "" for t in batch.slice(at, 256).to_pylist()]
                found.append(np.full(len(texts), model) if isinstance(model, float) else model(_expand(_measured(texts))))
            yield pa.array(np.rint(np.clip(np.concatenate(found), 1e-6, 1 - 1e-6) * MILLION).astype(np.int64))

    return scored


def train(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model | float:
    """Fit on the labelled rows of the ``sample`` smallest hashes."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _measured(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(rows), pa.list_(pa.float64()))], names=["quality", "x"])

    # ``chosen`` has ``sample`` rows at most.
    joined = docs.select("doc_id", common.text_or_empty(text).alias("t")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("t").alias("t"))
    found = joined.select(F.col("quality").cast("int").alias("quality"), "t").mapInArrow(measured, "quality int, x array<double>").toArrow()
    good = found.column("quality").to_numpy().astype(float)
    if len(set(good.tolist())) < 2:
        return float((good.sum() + 1) / (len(good) + 2))
    rows = np.array(found.column("x").to_pylist())
    order = np.lexsort((good, *rows.T))
    return fit_model(rows[order], good[order])


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, prior: str) -> Column:
    """How many documents the prior of a group counts for: from the spread of the groups' rates beyond chance, between 1 and 10,000."""
    rate = F.col("good") / F.col("n")
    chance = F.col(prior) * (1 - F.col(prior))
    spread = (F.sum(F.col("n") * (rate - F.col(prior)) * (rate - F.col(prior))) - F.sum(chance)) / F.sum("n")
    usual = F.sum(F.col("n") * chance) / F.sum("n")
    found = groups.agg(F.when(spread > 0, F.least(F.greatest(usual / spread, F.lit(1.0)), F.lit(1e4))).otherwise(F.lit(1e4)).alias("k")).first()
    return F.lit(float(found["k"]) if found and found["k"] is not None else 1e4)


def site_rates(scored: DataFrame) -> DataFrame:
    """Rates of hosts and paths from (host, path, p in millionths): host, path, n, good, prior, host_rate, host_k, path_rate, path_k."""
    paths = common.hold(scored.groupBy("host", "path").agg(F.count("*").alias("n"), (F.sum("p") / MILLION).alias("good")))
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    prior = (total["good"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("prior", F.lit(float(prior)))
    host_k = _strength(hosts, "prior")
    hosts = hosts.withColumn("host_rate", (F.col("good") + host_k * F.col("prior")) / (F.col("n") + host_k))
    joined = paths.join(hosts.select("host", "prior", "host_rate"), "host")
    path_k = _strength(joined, "host_rate")
    return joined.withColumns({"path_k": path_k, "path_rate": (F.col("good") + path_k * F.col("host_rate")) / (F.col("n") + path_k)})


def _named(key: Column) -> Column:
    """A key that tells null from empty."""
    return F.when(key.isNull(), "").otherwise(F.concat(F.lit("="), key))


def with_posterior(docs: DataFrame, model: Model | float, host: Column, path: Column, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all) of ``docs`` as ``row``, with p, host_rate, path_rate and posterior.

    Texts are read once, and written with their evidence to the shared folder
    where they are carried; they are not shuffled when the sites' table is small.
    """
    named = docs.select(F.struct(*(docs.columns if carry is None else carry)).alias("row"), _named(host).alias("host"), _named(path).alias("path"), evidence(model)(F.col(text)).alias("p"))
    with common.arrow_rows(docs.sparkSession, 1024):
        named = common.materialize(named, "quality-scored")
    sites = common.hold(site_rates(named.select("host", "path", "p")))
    joined = named.withColumn("p", F.col("p") / MILLION).join(sites, ["host", "path"])
    others = (F.col("good") - F.col("p") + F.col("path_k") * F.col("host_rate")) / (F.col("n") - 1 + F.col("path_k"))
    z = _logit(F.col("p")) + _logit(F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6))) - _logit(F.col("prior"))
    return joined.select("row", "p", "host_rate", "path_rate", (1 / (1 + F.exp(-z))).alias("posterior"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with its columns."""
    return with_posterior(docs, train(docs, labels, text), F.col(host), F.concat_ws("/", host, path), text).where(F.col("posterior") >= threshold).select("row.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table("documents")(spark, sf_dir).select("doc_id", "source", "lang", "text")
    model = train(docs, common.table("labels")(spark, sf_dir))
    found = with_posterior(docs, model, F.col("source"), F.concat_ws("/", "source", "lang"), carry=["doc_id"])
    return found.select("row.doc_id", F.round("p", 6).alias("p_document"), F.round("host_rate", 6).alias("host_rate"), F.round("path_rate", 6).alias("path_rate"), F.round("posterior", 6).alias("posterior"), (F.col("posterior") >= THRESHOLD).alias("keep"))


QUERIES = {"op3_quality": op3_quality}
