"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding.

Folding lower-cases, maps letters that look Latin to Latin ones and digits within words to the letters they stand
for, and turns all else to spaces. The terms of the lexicon are whole words and beginnings of words; their weights
are log odds between toxic and other labelled rows. Only terms enter whose association passes a test that allows
for the number of terms tried. A phrase of a term and the next word that is as good as absent from toxic rows is an
exception: it takes the term's weight back. The weight found in a text and its share per word are turned into a
score by logistic regression.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import column, cut, one_of_each, stage

#: Labelled rows that the fit reads at most (those of least hash); what it learns is bounded by their words alone.
FIT_ROWS = 20_000
#: Lengths of the beginnings of words that are tried as terms, besides whole words.
STEMS = (4, 5, 6)
LEAST_WEIGHT = 2.0

#: Letters that look like Latin ones (Cyrillic, Greek, full width aside), and digits and signs read as letters.
HOMOGLYPHS = dict(zip("авгеіјкмнорстухѕһԁԛԝбαβγεηικνορτυχω", "abreijkmhopctyxshdqwbabyenikvoptuxw", strict=True))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


class _Table(dict):
    """For str.translate: letters stay, anything else becomes a space; filled as characters turn up."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if 0xFF41 <= code <= 0xFF5A:
            char = chr(code - 0xFF41 + 97)
        out = HOMOGLYPHS.get(char, char)
        self[code] = out if out.isalnum() or out in "@$" else " "
        return self[code]


_TABLE = _Table()


_MIXED = re.compile(r"[^ ]*[0134578@$][^ ]*")
_LETTERS = str.maketrans(DIGITS)


def _read(word: re.Match) -> str:
    """Digits and signs as letters, in a word with two letters or at least half of them; signs at its ends are no part of it."""
    inner = word[0].strip("@$")
    letters = sum(c.isalpha() for c in inner)
    return (inner.translate(_LETTERS) if letters > 1 or 2 * letters >= len(inner) else inner.replace("@", " ").replace("$", " ")).join((" ", " "))


def fold(text: str) -> str:
    """The folded text: words with one space between them, and one before and after."""
    out = text.lower().translate(_TABLE)
    return f" {' '.join((_MIXED.sub(_read, out) if any(d in out for d in DIGITS) else out).split())} "


@dataclass
class Model:
    """terms: ' stem' or ' word ' and its weight; exceptions: ' word next ' phrases; logistic: bias and one weight for each feature."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    logistic: tuple[float, float, float] = (-2.0, 1.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found if len(found) else None


def hits(automaton, folded: str) -> list[tuple[int, float]]:
    """Place and weight of each word that a term matches, the largest weight for each word; excepted words are left out."""
    best: dict[int, float] = {}
    out: set[int] = set()
    for end, (size, weight) in automaton.iter(folded) if automaton is not None else ():
        start = end - size + 1
        if weight is None:
            out.add(start)
        elif weight > best.get(start, 0.0):
            best[start] = weight
    return [(s, w) for s, w in sorted(best.items()) if s not in out]


def features(weights: float, words: int) -> tuple[float, float]:
    return math.log1p(weights), math.log1p(100.0 * weights / max(words, 1))


def _features(model: Model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = model.automaton()
        for frame in frames:
            rows = []
            for text in frame["text"]:
                folded = fold(text)
                rows.append(features(sum(w for _, w in hits(automaton, folded)), len(folded.split())))
            yield frame.drop(columns="text").assign(f1=[r[0] for r in rows], f2=[r[1] for r in rows])

    return run


def _terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that hold a term, by term and label, added up for each batch."""
    for frame in frames:
        count: Counter = Counter()
        for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
            words = set(fold(text).split())
            terms = {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEMS if len(w) >= n}
            count.update((t, int(toxic)) for t in terms)
        yield pd.DataFrame([(t, n if x else 0, 0 if x else n) for (t, x), n in count.items()], columns=["term", "toxic", "clean"])


def _phrases(terms: dict[str, float]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Model(terms).automaton()
        for frame in frames:
            count: Counter = Counter()
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                folded = fold(text)
                found = {f" {' '.join(folded[s:].split(' ', 3)[1:3])} " for s, _ in hits(automaton, folded)}
                count.update((p, int(toxic)) for p in found)
            yield pd.DataFrame([(t, n if x else 0, 0 if x else n) for (t, x), n in count.items()], columns=["term", "toxic", "clean"])

    return run


def _rate(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> tuple[Column, Column]:
    """Smoothed log odds of a term, and the log likelihood ratio of its association with the label."""
    weight = F.log((toxic + 0.5) / (n_toxic + 1.0)) - F.log((clean + 0.5) / (n_clean + 1.0))
    share = n_toxic / (n_toxic + n_clean)
    part = lambda n, p: F.when(n > 0, n * F.log(n / (toxic + clean) / p)).otherwise(0.0)
    return weight, part(toxic, share) + part(clean, 1 - share)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Newton's method with a ridge penalty; x has a leading column of ones."""
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1]) * ridge
    keep[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The lexicon and its logistic, from rows of docs that labels (doc_id, toxic) marks and that are not held out.

    At most fit_rows labelled rows are read, those with the least hash of doc_id, one of each id. Null labels, ids and texts are
    left out, and of an id with more labels the largest counts. Without both kinds of labels, as with empty tables, the
    lexicon is empty. Every term and phrase that passes its test is kept, so ties need no order.
    """
    marked = labels.where(labels["doc_id"].isNotNull() & labels["toxic"].isNotNull() & ~held_out(labels["doc_id"]))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("text IS NOT NULL")
    sample = stage(one_of_each(texts, marked).select("toxic", "text"), "toxicity")  # fit_rows rows at most, as in marked
    n_clean, n_toxic = (sample.where(F.col("toxic") == k).count() for k in (0, 1))
    if not n_clean or not n_toxic:
        return Model(logistic=(8.0 if n_toxic else -8.0, 0.0, 0.0))
    counts = stage(sample.mapInPandas(_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "terms")
    weight, llr = _rate(F.col("toxic"), F.col("clean"), n_toxic, n_clean)
    least = math.log(max(counts.count(), 2)) + 2.0
    chosen = counts.where((weight >= LEAST_WEIGHT) & (llr >= least)).select("term", weight.alias("weight")).orderBy("term").collect()
    terms = {r.term: r.weight for r in chosen}
    phrases = sample.mapInPandas(_phrases(terms), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    phrases = phrases.where((F.col("clean") >= 3) & (weight <= -0.5)).orderBy("term")
    model = Model(terms, tuple(r.term for r in phrases.collect()))
    table = sample.mapInPandas(_features(model), "toxic int, f1 double, f2 double").toPandas()  # fit_rows rows at most
    table = table.sort_values(["f1", "f2", "toxic"])
    x = np.column_stack([np.ones(len(table)), table["f1"], table["f2"]])
    model.logistic = _logistic(x, table["toxic"].to_numpy(float))
    return model


def scores(texts: Iterable[str | None], model: Model, automaton) -> np.ndarray:
    """The score of each text, from 0 to 1. Null counts as empty."""
    bias, a, b = model.logistic
    z = []
    for text in texts:
        folded = fold(text or "")
        found = hits(automaton, folded)
        f1, f2 = features(sum(w for _, w in found), len(folded.split()) if found else 0)
        z.append(bias + a * f1 + b * f2)
    return 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in cut(batches):
            yield batch.append_column("score", pa.array(scores(column(batch, "text").to_pylist(), model, automaton), pa.float64()))

    return run


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs (with a column text) that are not predicted to be toxic, all columns as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in cut(batches):
            yield batch.filter(pa.array(scores(batch.column(at).to_pylist(), model, automaton) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text, score (0 to 1) and predicted (1 from 0.5 on) of every row of docs (doc_id, text).

    A null text is scored as an empty one; null ids and repeated rows are passed through; other columns are ignored,
    whatever their names. Texts are read whole, however long; an empty table gives an empty result.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    found = rows.mapInArrow(_scored(model), "doc_id long, text string, score double")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
