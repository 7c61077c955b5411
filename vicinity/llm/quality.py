"""Operator 4: quality by hierarchical empirical Bayes.

A logistic classifier on shares of signs, words and repetitions gives each
document its evidence: the log odds of good quality beyond the share of good
documents in the training rows. Sites give the prior. Over all documents, one
grouped aggregation gives the number of documents and the mean probability of a
good one for each path, and for each host and for everything from the same rows.
The mean of a host is shrunk towards the global mean, that of a path towards its
host's, by strengths that the method of moments takes from the spread between
hosts and between paths. The posterior log odds of a document are its evidence
plus the log odds of its path.

Rows: a null text is empty; empty texts have features of their own and are judged
like others. A null host or path is a site like any other. Without labels, or
with labels of one class only, nothing is known and every document is kept with
posterior 1. Documents with several labels count once for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinity.llm.common import text_of
from vicinity.session import stable

#: Labelled rows the classifier is fitted on, about; 24 bytes each when their ids are sent to the executors.
SAMPLE_ROWS = 10_000
#: Paths up to which their table goes to every executor, some 100 bytes each.
BROADCAST_SITES = 20_000
#: Posterior from which a document is kept.
KEEP_FROM = 0.5
#: Evidence is held within these log odds, so that no document is beyond its site's reach.
MOST_EVIDENCE = 12.0
#: Bounds of the pseudo-documents that a level above lends to a site.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 10_000.0
_UPPER, _LETTER, _DIGIT = (bytes(b for b in range(128) if test(chr(b))) for test in (str.isupper, str.isalpha, str.isdigit))
_SIGN = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:!?'\"-()")
_CLOSE = b".,;:!?"


def features(text: str) -> list[float]:
    """Shares that describe how a text is written; 0 for what an empty text lacks."""
    data, words = text.encode(), text.split()
    size, count = max(1, len(data)), max(1, len(words))
    share = lambda signs: (len(data) - len(data.translate(None, signs))) / size
    distinct = set(words)
    lines = text.split("\n")
    pairs = len(set(zip(words, words[1:])))
    return [np.log1p(len(words)), share(_UPPER), share(_LETTER), share(_DIGIT), share(_SIGN), share(_CLOSE),
            len(data) / count, len(distinct) / count, np.log1p(len(words) / max(1, len(distinct))),
            pairs / max(1, len(words) - 1), len(lines) / count, len(set(lines)) / max(1, len(lines)),
            sum(w.isupper() for w in words) / count, sum(not w[-1].isalnum() for w in words) / count, float(not words)]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features_udf(texts: pd.Series) -> pd.Series:
    return texts.map(features)


class Classifier:
    """Regularised logistic regression on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30):
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-9
        z = np.c_[np.ones(len(x)), self._standard(x)]
        w = np.zeros(z.shape[1])
        penalty = np.r_[1e-6, np.full(z.shape[1] - 1, ridge)]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        self.weights, self.prior = w, float(np.log(y.mean() / (1 - y.mean())))

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log odds beyond those of the training rows."""
        return np.clip(self.weights[0] + self._standard(x) @ self.weights[1:] - self.prior, -MOST_EVIDENCE, MOST_EVIDENCE)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int) -> Classifier | None:
    """Classifier of a bounded sample of labelled rows, chosen by a hash of the id; None without both classes."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y")).where(
        "__id is not null and __y in (0, 1)")
    share = min(1.0, sample_rows / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # Bounded by sample_rows, whatever the size of the tables.
    read = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text")).join(F.broadcast(sample), "__id")
    rows = sorted((r[0], list(r[1])) for r in read.select("__y", features_udf("__text").alias("x")).collect())
    y = np.array([r[0] for r in rows])
    if len(set(y)) < 2:
        return None
    return Classifier(np.array([r[1] for r in rows]), y)


def evidence_column(model: Classifier, text: Column) -> Column:
    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            x = np.array([features(t) for t in batch]) if len(batch) else np.zeros((0, len(model.mean)))
            yield pd.Series(model.evidence(x))
    return run(text)


def shrinkage(groups: DataFrame, mean: str, prior: Column | float) -> float:
    """Pseudo-documents by which groups lean on their prior: the method of moments for beta-binomial means."""
    prior = prior if isinstance(prior, Column) else F.lit(prior)
    off = F.col("docs") * F.pow(F.col(mean) - prior, 2)
    row = groups.agg(F.sum(off).alias("off"), F.sum(F.col("docs") * prior * (1 - prior)).alias("unit"),
                     F.sum("docs").alias("docs"), F.count("*").alias("groups"),
                     F.sum(F.col("docs").cast("double") * F.col("docs")).alias("squares")).first()
    if not row["docs"] or row["groups"] < 2 or not row["unit"]:
        return MOST_STRENGTH
    # Expected squared distance = unit * (1/strength share + the noise of finite groups).
    within = row["unit"] / row["docs"]
    between = (row["off"] - (row["groups"] - 1) * within) / (row["docs"] - row["squares"] / row["docs"] + 1e-9)
    return float(np.clip(within / between - 1, LEAST_STRENGTH, MOST_STRENGTH)) if between > 0 else MOST_STRENGTH


def site_priors(scored: DataFrame, host: str, path: str, evidence: str, base: float) -> DataFrame:
    """host, path, site_docs, site_prior: one row per path, from all rows of ``scored``."""
    good = 1 / (1 + F.exp(-(F.col(evidence) + F.lit(base))))
    paths = stable(scored.groupBy(host, path).agg(F.count("*").alias("docs"), F.sum(good).alias("good"))
                   .withColumn("mean", F.col("good") / F.col("docs")))
    hosts = paths.groupBy(host).agg(F.sum("docs").alias("docs"), F.sum("good").alias("good")).withColumn(
        "mean", F.col("good") / F.col("docs"))
    total = paths.agg(F.sum("docs").alias("docs"), F.sum("good").alias("good")).first()
    overall = (total["good"] / total["docs"]) if total["docs"] else 0.5
    k_host = shrinkage(hosts, "mean", overall)
    hosts = hosts.select(F.col(host).alias("__host"), ((F.col("good") + k_host * overall) / (F.col("docs") + k_host)).alias("host_prior"))
    both = paths.join(hosts, F.col(host).eqNullSafe(F.col("__host")))
    k_path = shrinkage(both, "mean", F.col("host_prior"))
    prior = (F.col("good") + k_path * F.col("host_prior")) / (F.col("docs") + k_path)
    return both.select(F.col(host), F.col(path), F.col("docs").alias("site_docs"), "host_prior", prior.alias("site_prior"))


#: Columns that a judgement adds.
VERDICTS = ("evidence", "site_docs", "host_prior", "site_prior", "posterior", "keep")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None,
          path: Column | None = None, label_col: str = "quality", keep_from: float = KEEP_FROM,
          sample_rows: int = SAMPLE_ROWS, carry: bool = True) -> DataFrame:
    """``docs`` (or, without ``carry``, only their ids) with evidence, site_docs, host_prior, site_prior, posterior and keep.

    ``host`` and ``path`` are expressions over ``docs``; by default the source is the host and
    its section in one language the path. A column of ``docs`` with the name of a verdict column
    is left out (``good_documents`` keeps it). Null and empty texts are judged like others, rows without
    a host or path share one, repeated rows are judged each on their own, and an empty table gives no
    rows. Without labels of both classes all are kept.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    columns = [c for c in docs.columns if c not in VERDICTS] if carry else [id_col]
    names = [f"__{i}" for i in range(len(columns))]
    read = docs.select(*[F.col(c).alias(n) for c, n in zip(columns, names)], text_of(text_col).alias("__text"),
                       host.cast("string").alias("__h"), path.cast("string").alias("__p"))
    model = fit(docs, labels, id_col, text_col, label_col, sample_rows)
    known = [*[F.col(n).alias(c) for c, n in zip(columns, names)]]
    if model is None:
        nothing = F.lit(None).cast("double")
        return read.select(*known, F.lit(0.0).alias("evidence"), F.lit(None).cast("long").alias("site_docs"),
                           nothing.alias("host_prior"), nothing.alias("site_prior"), F.lit(1.0).alias("posterior"),
                           F.lit(True).alias("keep"))
    scored = read.withColumn("__e", evidence_column(model, F.col("__text"))).drop("__text")
    if not carry:
        scored = stable(scored)
    sites = stable(site_priors(scored.select("__h", "__p", "__e"), "__h", "__p", "__e", model.prior))
    few = sites.count() <= BROADCAST_SITES
    sites = sites.toDF("__sh", "__sp", "site_docs", "host_prior", "site_prior")
    # A checked number of short rows spares the texts a shuffle; beyond it both sides are shuffled and hot sites split.
    sites = F.broadcast(sites) if few else sites
    joined = scored.join(sites, F.col("__h").eqNullSafe(F.col("__sh")) & F.col("__p").eqNullSafe(F.col("__sp")), "left")
    odds = F.col("__e") + F.log(F.col("site_prior") / (1 - F.col("site_prior")))
    posterior = 1 / (1 + F.exp(-odds))
    return joined.select(*known, F.col("__e").alias("evidence"), "site_docs", "host_prior", "site_prior",
                         posterior.alias("posterior"), (posterior >= keep_from).alias("keep"))


def good_documents(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows that ``judge`` rejects; all columns stay as they are, also those named like a verdict."""
    held = {c: f"__held_{i}" for i, c in enumerate(docs.columns) if c in VERDICTS}
    verdicts = judge(docs.withColumnsRenamed(held), labels, **settings).where("keep").drop(*VERDICTS)
    return verdicts.withColumnsRenamed({new: old for old, new in held.items()}).select(*docs.columns)
