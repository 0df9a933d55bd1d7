"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence's score is a logistic function of the words in it and of their first
four letters; a document's is the noisy-or of its sentences. Only documents are
labelled: the noisy-or's likelihood trains the sentence scores, which then locate
the offending sentences. Training reads a bounded sample of labelled documents
(``SAMPLE`` a class); scoring reads every whole text.

Defined results: null and empty texts are one sentence without words and get the
score of the bias; rows repeat as given; without labelled rows of both classes
every score is 0; null labels and labels of unknown documents are not learned
from; of labelled documents that share an id the least text is learned; equally bad
sentences: the first one is named; very long texts are read whole; other columns,
whatever their names, are never read, but ``predict`` replaces those it adds; a score
of exactly 0.5 is toxic; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import stratified, texts_of
from .shared import crc_mod, small_batches, widened

#: Labelled documents of each class, features kept, and the least documents of a feature.
SAMPLE, FEATURES, LEAST = 3000, 600, 6
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def features(sentence: str) -> set[str]:
    words = set(_WORD.findall(sentence.lower()))
    return words | {w[:4] + "*" for w in words if len(w) > 4}


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans of the sentences with other than white space; one empty span if there is none."""
    return [m.span() for m in _SENTENCE.finditer(text or "") if not m[0].isspace()] or [(0, 0)]


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def logits(self, text: str | None) -> tuple[np.ndarray, list[tuple[int, int]]]:
        get, spans = self.weights.get, sentences(text)
        return np.array([self.bias + sum(get(f, 0.0) for f in features((text or "")[a:b])) for a, b in spans]), spans

    def score(self, text: str | None) -> tuple[float, float, int, int]:
        """Noisy-or, and the worst sentence's score and span."""
        z, spans = self.logits(text)
        k = int(z.argmax())
        return float(-np.expm1(-np.logaddexp(0, z).sum())), float(1 / (1 + np.exp(-z[k]))), *spans[k]


def fit(bags: list[tuple[int, int, list[int], list[int]]], n_features: int, steps: int = 400, decay: float = 5e-5) -> tuple[np.ndarray, float]:
    """Weights and bias from bags ``(label, sentences, sentence of each entry, feature of each entry)``."""
    y = np.array([b[0] for b in bags])
    size = np.array([b[1] for b in bags])
    doc = np.repeat(np.arange(len(bags)), size)
    first = np.cumsum(size) - size
    sent = np.concatenate([np.asarray(b[2], np.int64) + f for b, f in zip(bags, first)])
    feat = np.concatenate([np.asarray(b[3], np.int64) for b in bags])
    w, bias, n = np.zeros(n_features), -4.0, int(size.sum())
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(sent, w[feat], minlength=n)
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(np.bincount(doc, -np.logaddexp(0, z), minlength=len(bags)))
        g = np.where(y[doc] == 1, -(clean / np.maximum(1 - clean, 1e-9))[doc] * p, p) / len(bags)
        grad = np.append(np.bincount(feat, g[sent], minlength=n_features) + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """``docs``: doc_id, text; ``labels``: doc_id, label (0 or 1)."""
    small_batches(docs.sparkSession)
    chosen = stratified(labels.where(F.col("label").isin(0, 1)).select("doc_id", "label"), "label", sample)
    bags = texts_of(docs, chosen).select("label", "text")
    per_class = {r["label"]: r["n"] for r in bags.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(per_class) < 2:
        return None

    def words(batches):
        for b in batches:
            y, f = [], []
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = features(text or "")
                f += own
                y += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(f, pa.string())], names=["label", "f"])

    def log_odds(k: int) -> F.Column:
        return F.log((F.col(f"n{k}") + 0.5) / (per_class[k] - F.col(f"n{k}") + 0.5))

    counts = bags.mapInArrow(words, "label int, f string").groupBy("f").agg(*[F.count_if(F.col("label") == k).alias(f"n{k}") for k in (0, 1)])
    z = (log_odds(1) - log_odds(0)) / F.sqrt(1 / (F.col("n0") + 0.5) + 1 / (F.col("n1") + 0.5))
    best = counts.where(F.col("n0") + F.col("n1") >= LEAST).orderBy(F.abs(z).desc(), "f").limit(FEATURES)
    names = [r["f"] for r in best.select("f").collect()]
    number = {f: k for k, f in enumerate(names)}

    def instances(batches):
        for b in batches:
            rows = []
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = sentences(text)
                held = [(s, number[f]) for s, (x, y) in enumerate(spans) for f in features((text or "")[x:y]) if f in number]
                rows.append({"label": label, "n": len(spans), "s": [s for s, _ in held], "f": [f for _, f in held]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("label", pa.int32()), ("n", pa.int32()), ("s", pa.list_(pa.int32())), ("f", pa.list_(pa.int32()))]))

    got = bags.mapInArrow(instances, "label int, n int, s array<int>, f array<int>").collect()
    w, bias = fit(sorted((r["label"], r["n"], r["s"], r["f"]) for r in got), len(names))
    return Model({f: float(x) for f, x in zip(names, w)}, bias)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Replace ``text`` by ``score``, ``worst``, ``worst_start``, ``worst_end`` (characters)."""
    small_batches(docs.sparkSession)
    added = {"score": "double", "worst": "double", "worst_start": "int", "worst_end": "int"}
    kept = [c for c in docs.columns if c not in added and c != "text"]
    docs = docs.select(*kept, F.col("text").cast("string"))
    schema = widened(docs.drop("text"), **added)
    types = [pa.float64(), pa.float64(), pa.int32(), pa.int32()]

    def run(batches):
        for b in batches:
            got = [model.score(t) if model else (0.0, 0.0, 0, 0) for t in b.column(len(kept)).to_pylist()]
            more = [pa.array(list(c), t) for c, t in zip(zip(*got), types)] if got else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *more], names=[*kept, *added])

    return docs.mapInArrow(run, schema)


def offending(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``doc_id, start, end, sentence, score`` of every sentence that scores at least ``least``."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("sentence", pa.string()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            rows = []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                z, spans = model.logits(text)
                rows += [{"doc_id": d, "start": x, "end": y, "sentence": text[x:y], "score": float(p)} for p, (x, y) in zip(1 / (1 + np.exp(-z)), spans) if p >= least and y > x]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start int, end int, sentence string, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, worst, worst_start, worst_end``."""
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    known = labels.withColumn("held", held).where(~F.col("held")).select("doc_id", F.col("toxic").cast("int").alias("label"))
    found = predict(docs.select("doc_id", held.alias("held_out"), "text"), train(docs, known))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
