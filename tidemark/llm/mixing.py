"""Mixing sources to target weights by soft membership.

A classifier fitted on labelled rows gives each document a posterior over domains: word counts by domain give a
naive Bayes score, which a softmax regression weighs together with a few measures of the text. A document d with t_d
words and posterior p_d adds r_d t_d p_d to the expected words of the domains, where r_d is its rate. Projected
gradient least squares fits rates in [0, most] so that these totals match the targets. A step
needs the totals only, which one aggregate gives, and moves r_d by p_d times a vector of the size of the domains; so
the rates are an expression of p_d and of the steps so far, and no state of the documents is written down.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tidemark.llm.common import Words, cut, lower_ascii, one_of_each, packed, slices, stage

#: Labelled rows that the classifier is fitted on at most (those of least hash); buckets of its word counts.
FIT_ROWS, BUCKETS = 20_000, 1 << 14
#: Largest rate, most steps, and the largest relative error of a domain's total at which fitting ends.
MOST, STEPS, CLOSE = 8.0, 40, 1e-3
N_MEASURES = 6


def _read(texts: pa.Array, table: np.ndarray | None) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """For runs of texts: their words, measures, and mean score of the words in each domain (none without a table)."""
    buf, offsets = packed(texts)
    for i, j in slices(offsets):
        part, at = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        words = Words(lower_ascii(part), at)
        size = np.maximum(np.diff(at), 1)

        def share(mask: np.ndarray, at=at, size=size) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[at]) / size

        letters = ((part | 32) >= 97) & ((part | 32) <= 122)
        upper, digits = (part >= 65) & (part <= 90), (part >= 48) & (part <= 57)
        blank = (part == 32) | ((part >= 9) & (part <= 13))
        measures = [np.log1p(words.count), np.log1p(size / np.maximum(words.count, 1)), share(upper), share(digits), share(~(letters | digits | blank) & (part < 128)), share(part == 10)]
        scores = np.zeros((j - i, 0))
        if table is not None:
            sums = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(table[(words.hash % np.uint64(BUCKETS)).astype(np.int64)], axis=0)])
            scores = (sums[words.first + words.count] - sums[words.first]) / np.maximum(words.count, 1)[:, None]
        yield words, np.column_stack(measures), scores


@dataclass
class Classifier:
    """domains in order, log probability of each word bucket in each, and the softmax over (1, measures, scores)."""

    domains: list[str]
    table: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def posterior(self, features: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(features)), (features - self.centre) / self.scale]) @ self.weights
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _softmax(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 400) -> np.ndarray:
    """Softmax regression by accelerated gradient descent with a small ridge penalty."""
    w = ahead = np.zeros((x.shape[1], k))
    hot = np.eye(k)[y]
    step = 2.0 * len(x) / np.linalg.norm(x, 2) ** 2
    for t in range(rounds):
        z = x @ ahead
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = ahead - step * (x.T @ (p - hot) / len(x) + 1e-5 * ahead)
        ahead, w = new + t / (t + 3) * (new - w), new
    return w


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Classifier:
    """Fits the classifier on rows of docs that labels (doc_id, domain) marks, at most fit_rows of them and one of each id.

    Word counts come from one half of the rows, the softmax from the other. Null ids, domains and texts are left
    out; an id with more domains counts with the least. Without labels there is one domain, named ''.
    """
    marked = labels.where(labels["doc_id"].isNotNull() & labels["domain"].isNotNull())
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("domain").cast("string")).alias("domain"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("text IS NOT NULL")
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("half")
    sample = stage(one_of_each(texts, marked).select("domain", half, "text"), "mixing")  # fit_rows rows at most
    domains = [r[0] for r in sample.select("domain").distinct().orderBy("domain").collect()] or [""]
    index = {d: i for i, d in enumerate(domains)}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for domain, part in frame.groupby("domain"):
                total = np.zeros(BUCKETS, np.int64)
                for words, _, _ in _read(pa.array(part["text"], pa.string()), None):
                    total += np.bincount((words.hash % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
                at = np.flatnonzero(total)
                yield pd.DataFrame({"domain": domain, "bucket": at, "n": total[at]})

    counts = np.full((BUCKETS, len(domains)), 0.5)
    rows = sample.where("half = 0").mapInPandas(count, "domain string, bucket long, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS for each domain at most
    counts[rows["bucket"].to_numpy(np.int64), rows["domain"].map(index).to_numpy(np.int64)] += rows["n"].to_numpy(np.float64)
    table = np.log(counts / counts.sum(0))
    table -= table.mean(1, keepdims=True)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = [np.column_stack([m, s]) for _, m, s in _read(pa.array(frame["text"], pa.string()), table)]
            if parts:
                yield pd.DataFrame({"domain": frame["domain"], "x": list(np.concatenate(parts))})

    found = sample.where("half = 1").mapInPandas(measure, "domain string, x array<double>").toPandas()
    width = N_MEASURES + len(domains)
    if not len(found):
        return Classifier(domains, table, np.zeros(width), np.ones(width), np.zeros((width + 1, len(domains))))
    x = np.array(found["x"].tolist())
    y = found["domain"].map(index).to_numpy(np.int64)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    model = Classifier(domains, table, x.mean(0), np.maximum(x.std(0), 1e-9), np.zeros((width + 1, len(domains))))
    model.weights = _softmax(np.column_stack([np.ones(len(x)), (x - model.centre) / model.scale]), y, len(domains))
    return model


def scored(docs: DataFrame, model: Classifier, text: str, names: tuple[str, str] = ("n_tokens", "posterior")) -> DataFrame:
    """docs with two more columns: n_tokens (words of its column `text`) and posterior (one number for each domain). A null text counts as empty."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, text):
            n, p = [], []
            for words, measures, scores in _read(batch.column(at), model.table):
                n.append(words.count)
                p.append(model.posterior(np.column_stack([measures, scores])))
            flat = np.concatenate(p).ravel()
            each = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(model.domains), dtype=np.int32)), pa.array(flat))
            yield batch.append_column(names[0], pa.array(np.concatenate(n).astype(np.int64))).append_column(names[1], each)

    schema = StructType([*docs.schema.fields, StructField(names[0], LongType()), StructField(names[1], ArrayType(DoubleType()))])
    return docs.mapInArrow(run, schema)


def rate_of(posterior: Column, steps: list[list[float]], most: float = MOST) -> Column:
    """The rate after the given steps from 1, each projected onto [0, most]."""
    if not steps:
        return F.lit(1.0)
    table = F.array(*[F.array(*map(F.lit, s)) for s in steps])
    move = lambda s: F.aggregate(F.zip_with(posterior, s, lambda p, g: p * g), F.lit(0.0), lambda a, b: a + b)
    return F.aggregate(table, F.lit(1.0), lambda r, s: F.least(F.lit(most), F.greatest(F.lit(0.0), r - move(s))))


def fit_rates(members: DataFrame, targets: list[float], most: float = MOST, steps: int = STEPS, close: float = CLOSE) -> tuple[list[list[float]], list[float]]:
    """Steps of projected gradient for members (n_tokens, posterior), and what is left of each domain's relative error after
    them; targets: the share of the words each domain is to have.

    Minimises (S - T)' G^-1 (S - T) over the rates: S are the expected totals, the targets T add up to all words there
    are, and G is the sum of t_d p_d p_d', which makes one step enough where no rate meets a bound. A domain with
    target 0 gets a target of a millionth instead. Without words there are no steps. Targets that rates in [0, most]
    cannot meet leave a residual beyond `close`.
    """
    k = len(targets)
    p = [F.get("posterior", F.lit(i)) for i in range(k)]
    t = F.col("n_tokens").cast("double")
    first = members.agg(F.sum(t).alias("n"), *[F.sum(t * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    if not first["n"]:
        return [], [0.0] * k
    share = np.maximum(np.array(targets, float), 0)
    share = np.maximum(share / share.sum(), 1e-6)
    want = share / share.sum() * first["n"]
    weight = np.array([[first[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    weight = np.linalg.inv(weight + np.eye(k) * 1e-9 * np.trace(weight))
    out: list[list[float]] = []
    while True:
        rate = members.withColumn("rate", rate_of(F.col("posterior"), out, most))
        total = np.array(rate.agg(*[F.sum(F.col("rate") * t * p[i]).alias(f"s{i}") for i in range(k)]).first(), float)
        left = (total - want) / want
        if np.abs(left).max() < close or len(out) == steps:
            return out, left.tolist()
        out.append((weight @ (total - want)).tolist())


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], most: float = MOST) -> DataFrame:
    """doc_id, n_tokens, domains, posterior, rate and residual of every row of docs (doc_id, text).

    labels: doc_id and domain of some rows. targets: the share of the words of each domain; a domain that is not
    named gets none, one without labelled rows is left out, and if none is left all shares are equal. residual: of each
    domain, how far its expected total is from its target, relative to that; the same in all rows. A null text is
    an empty one and has no words; its rate moves nothing. Null and repeated ids are rows like others; other columns of
    docs are ignored. Texts are read whole, however long; an empty table gives an empty result.
    """
    model = train(docs, labels)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    members = stage(scored(rows, model, "text").drop("text"), "members")
    steps, residual = fit_rates(members, _shares(model, targets), most)
    domains, left = F.array(*map(F.lit, model.domains)), F.array(*map(F.lit, residual))
    return members.select("doc_id", "n_tokens", domains.alias("domains"), "posterior", rate_of(F.col("posterior"), steps, most).alias("rate"), left.alias("residual"))


def _shares(model: Classifier, targets: dict[str, float]) -> list[float]:
    shares = [max(targets.get(d, 0.0), 0.0) for d in model.domains]
    return shares if sum(shares) else [1.0] * len(shares)


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float], most: float = MOST) -> DataFrame:
    """docs with all its columns, each row as often as its rate says: the whole part, and one more with the chance of the rest.

    The chance is decided by a hash of doc_id and text, so the result is the same in every run; rows that repeat
    both fare alike. Labels as in `mix`.
    """
    model = train(docs, labels)
    names, width = docs.columns, "_" * max(map(len, docs.columns))
    n_tokens, posterior, chance = (f"{x}{width}" for x in ("n", "p", "chance"))
    rated = stage(scored(docs, model, "text", (n_tokens, posterior)), "scored")
    steps, _ = fit_rates(rated.select(F.col(n_tokens).alias("n_tokens"), F.col(posterior).alias("posterior")), _shares(model, targets), most)
    part = F.pmod(F.xxhash64(rated["doc_id"], rated["text"]), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(rate_of(F.col(posterior), steps, most) + part).cast("int")
    return rated.withColumn(chance, times).where(F.col(chance) > 0).select(*names, F.explode(F.sequence(F.lit(1), F.col(chance))).alias(chance)).drop(chance)
