"""Quality by nearest neighbours among labelled latent-semantic vectors.

A text's terms are its words, by a hash to ``WORDS`` places, pairs of adjacent
characters, in classes of characters (letters singly, others by kind), and four
measures of repetition. Weighted terms of a bounded, labelled sample (``SAMPLE`` a
class) give a truncated SVD, by steps of a block of vectors: the driver holds the
sample compressed, a block of its terms and one square matrix. Every document
is projected to it, and the exact cosines to all sample vectors, in blocks of
documents, weight the votes of the nearest ``NEIGHBOURS``.

Defined results: null text counts as empty; texts under two characters have no pair
and get the sample's share of label 1; so does every text where labelled
rows are missing (0.5 without any); neighbours as near as the last one that counts
all vote; repeated rows are scored alike; of labelled documents that share an id the
least text is learned; very long texts are read whole; other columns, whatever their
names, are never read, but ``predict`` replaces ``score`` and ``predicted``; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import stratified, texts_of
from .shared import crc_mod, kept_in_worker, small_batches, widened

#: Labelled documents of each class, dimensions, neighbours and the power of similarity in a vote.
SAMPLE, DIMENSIONS, NEIGHBOURS, POWER = 1500, 32, 15, 8
#: Classes of bytes: a-z one each, then A-Z, digits, space, breaks, beyond ASCII, and kinds of punctuation.
KINDS = 37
#: Places that words are hashed to; and the weight of words beside that of pairs.
WORDS, WORD_WEIGHT = 256, 0.5
#: Vectors beyond ``DIMENSIONS`` that steps of the SVD carry, and the most steps.
SPARE, STEPS = 32, 400
#: Distinct words whose places a worker remembers, and documents that are scored together.
REMEMBERED, BLOCK = 100_000, 200


def _classes() -> np.ndarray:
    kinds = np.full(256, 36)
    kinds[128:] = 31
    kinds[97:123] = np.arange(1, 27)
    kinds[65:91], kinds[48:58], kinds[32] = 27, 28, 29
    for n, chars in ((30, b"\t\n\r"), (32, b".,"), (33, b"!?"), (34, b"#$%&*@^~+=<>"), (35, b"|/\\_-")):
        kinds[list(chars)] = n
    return kinds


_KIND = _classes()


def places(words: list[str]) -> list[int]:
    """The place of each word."""
    known = kept_in_worker("quality")
    if len(known) > REMEMBERED:
        known.clear()
    for w in set(words).difference(known):
        known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS
    return list(map(known.__getitem__, words))


def terms(text: str | None) -> np.ndarray:
    """Counts of class pairs and of words, then shares: words like the last, like the one before it, repeated words, repeated lines."""
    text = text or ""
    kinds = _KIND[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    pairs = np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS) if len(kinds) > 1 else np.zeros(KINDS * KINDS)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n = max(1, len(words))
    same = sum(map(str.__eq__, words, words[1:])) / n
    second = sum(map(str.__eq__, words, words[2:])) / n
    own = np.bincount(places(words), minlength=WORDS) if words else np.zeros(WORDS)
    return np.concatenate([pairs, own, [same, second, (1 - len(set(words)) / n) / 2 if words else 0, 1 - len(set(lines)) / max(1, len(lines)) if lines else 0]])


def packed(counts: np.ndarray) -> bytes:
    """The terms of one text, few of which occur, as the driver keeps them."""
    return zlib.compress(counts.astype("<f4").tobytes(), 1)


def leading_axes(square: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` leading eigenvectors of a symmetric matrix without negative eigenvalues, as columns.

    A block of vectors is multiplied and made orthonormal until the leading eigenvalues stay as they are.
    No copy of the matrix is made, which ``eigh`` takes several of.
    """
    size = len(square)
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((size, min(size, n + SPARE))))[0]
    before = np.zeros(0)
    for _ in range(STEPS):
        moved = square @ q
        values, turn = np.linalg.eigh(q.T @ moved)
        order = np.argsort(-values, kind="stable")[:n]
        if len(before) and np.abs(values[order] - before).max() <= 1e-14 * max(values[order[0]], 1e-300):
            break
        before = values[order]
        q = np.linalg.qr(moved)[0]
    return q @ turn[:, order]


class Space:
    """Weights, projection and labelled vectors; bounded by the sample (``packed`` terms of each row)."""

    def __init__(self, rows: list[bytes], labels: np.ndarray):
        def blocks():
            for k in range(0, len(rows), BLOCK):
                yield np.stack([np.frombuffer(zlib.decompress(r), "<f4") for r in rows[k : k + BLOCK]]).astype(np.float64)

        having = sum((c > 0).sum(0) for c in blocks())
        self.idf = [np.log((1 + len(rows)) / (1 + n)) + 1 for n in (having[: KINDS * KINDS], having[KINDS * KINDS : -4])]
        square = np.zeros((len(having), len(having)))
        for c in blocks():
            w = self._weighted(c)
            for k in range(0, len(square), BLOCK):  # a product of its own would be as large as the matrix
                square[k : k + BLOCK] += w[:, k : k + BLOCK].T @ w
        self.axes = leading_axes(square, DIMENSIONS)
        self.known = np.concatenate([self._unit(self._weighted(c) @ self.axes) for c in blocks()])
        self.labels, self.share = labels, float(labels.mean())

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    @staticmethod
    def _parts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of pairs, and of words."""
        return counts[:, : KINDS * KINDS], counts[:, KINDS * KINDS : -4]

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        pairs, words = (self._unit(np.log1p(1000 * tf / np.maximum(1, tf.sum(1, keepdims=True))) * idf) for tf, idf in zip(self._parts(counts), self.idf))
        return self._unit(np.hstack([pairs, WORD_WEIGHT * words, counts[:, -4:]]))

    def score(self, counts: np.ndarray) -> np.ndarray:
        unit = self._unit(self._weighted(counts) @ self.axes)
        near = unit @ self.known.T
        k = min(NEIGHBOURS, near.shape[1])
        least = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
        votes = np.where(near >= least, np.maximum(near, 0) ** POWER, 0.0)  # equally near ones all vote
        total = votes.sum(1)
        got = np.where(total > 0, (votes @ self.labels) / np.maximum(total, 1e-300), self.share)
        return np.where(self._parts(counts)[0].sum(1) > 0, np.clip(got, 0, 1), self.share)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Space | None:
    """``docs``: doc_id, text; ``labels``: doc_id, label (0 or 1)."""
    small_batches(docs.sparkSession)
    chosen = stratified(labels.where(F.col("label").isin(0, 1)).select("doc_id", "label"), "label", sample)

    def run(batches):
        for b in batches:
            rows = [packed(terms(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], names=["d", "label", "terms"])

    rows = texts_of(docs, chosen)
    got = rows.select(F.col("doc_id").cast("string").alias("d"), "label", "text").mapInArrow(run, "d string, label int, terms binary").toArrow()
    if not got.num_rows:
        return None
    order = np.lexsort((got.column("label").to_numpy(), np.array(got.column("d").to_pylist())))
    counts = got.column("terms").to_pylist()
    return Space([counts[k] for k in order.tolist()], got.column("label").to_numpy()[order].astype(np.float64))


def predict(docs: DataFrame, space: Space | None) -> DataFrame:
    """Add ``score`` and ``predicted`` to the rows of ``docs``, which has ``text``."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(space)  # two samples of short vectors
    docs = docs.drop("score", "predicted")
    schema = widened(docs, score="double", predicted="int")

    def run(batches):
        kept_in_worker("quality")
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            score = np.full(len(texts), 0.5)
            if held.value is not None and texts:
                blocks = (texts[k : k + BLOCK] for k in range(0, len(texts), BLOCK))
                score = np.concatenate([held.value.score(np.array([terms(t) for t in own])) for own in blocks])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def known_labels(labels: DataFrame) -> DataFrame:
    """Labels to learn from: those that are not held out."""
    return labels.where(~F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))).select("doc_id", F.col("quality").cast("int").alias("label"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", held, F.col("text").cast("string").alias("text")), train(docs, known_labels(labels))).drop("text")
