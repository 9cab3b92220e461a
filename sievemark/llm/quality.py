"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Every whole text becomes hashed counts of adjacent byte pairs (letters folded to classes where case
and signs matter, so layout and lettering show) with idf weights, projected to a latent space by a
singular value decomposition, beside a few measures of repetition. A bounded number of labelled rows
(``LABELLED`` at most, in hash order) is broadcast as latent vectors; each document's exact cosine
with all of them is computed in blocks, and its nearest ``NEIGHBOURS`` vote with weights that grow
with similarity.

Labels are learnt only from rows whose crc32(doc_id) mod 5 isn't 0; labels, lang, source and doc_id
are never inputs of a score.

Defined results: null text counts as empty; empty texts get a score like any (their vector holds the
constant measures only); rows without a label, or with contradicting labels (their mean, rounded),
are fine; without labelled rows every score is 0.5; an empty table gives an empty result; repeated
rows each get a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import lean, read_table, text_or_empty

LABELLED, TERMS, LATENT, NEIGHBOURS, SHARPNESS, THRESHOLD, FOLDS = 4096, 1024, 48, 25, 8.0, 0.3, 5
MEASURES = 8


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Bytes to 32 classes: vowels and consonants by case, digits, each sign, bytes beyond ASCII."""
    t = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            t[b] = 30 + (b >= 192)
        elif c.isalpha():
            t[b] = 1 + 2 * c.isupper() + (c.lower() in "aeiouy")
        elif c.isdigit():
            t[b] = 5
        elif c in " \n\t.,!?|*$%&#@+-=/\"'()_:;":
            t[b] = 6 + " \n\t.,!?|*$%&#@+-=/\"'()_:;".index(c) % 24
        else:
            t[b] = 0
    return t


def features(texts: list[str]) -> np.ndarray:
    """(n, TERMS + MEASURES): term counts and repetition measures of whole texts."""
    out = np.zeros((len(texts), TERMS + MEASURES), np.float32)
    table = _classes()
    for n, text in enumerate(texts):
        own = table[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
        if len(own) > 1:
            out[n, :TERMS] = np.bincount(own[:-1] * 32 + own[1:], minlength=TERMS)[:TERMS]
        words, lines = text.split(), text.split("\n")
        k = max(1, len(words))
        same = sum(map(str.__eq__, words, words[1:]))
        signs = own[(own == 0) | (own >= 9)]
        out[n, TERMS:] = (
            1.0,
            len(set(words)) / k,
            same / k,
            1 - len(set(lines)) / max(1, len(lines)),
            min(1.0, len(text) / k / 20),
            ((own == 3) | (own == 4)).mean() if len(own) else 0.0,
            len(signs) / max(1, len(own)),
            min(1.0, np.log1p(len(words)) / 10),
        )
    return out


class Space:
    """Latent vectors: idf and a projection fitted to labelled rows."""

    def __init__(self, raw: np.ndarray, latent: int = LATENT) -> None:
        counts = raw[:, :TERMS]
        self.idf = np.log((1 + len(raw)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
        self.centre, self.spread = raw[:, TERMS:].mean(0), raw[:, TERMS:].std(0) + 1e-3
        x = self._weighed(counts)
        # The leading right singular vectors, by subspace iteration from a seeded start.
        own = np.linalg.qr(np.random.default_rng(11).normal(size=(TERMS, latent + 8)).astype(np.float32))[0]
        for _ in range(8):
            own = np.linalg.qr(x.T @ (x @ own))[0]
        _, _, turned = np.linalg.svd(x @ own, full_matrices=False)
        self.base = np.ascontiguousarray((own @ turned.T)[:, :latent])
        self.mean = (x @ self.base).mean(0)

    def _weighed(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def vectors(self, raw: np.ndarray) -> np.ndarray:
        latent = 4 * (self._weighed(raw[:, :TERMS]) @ self.base - self.mean)
        measures = 0.5 * np.clip((raw[:, TERMS:] - self.centre) / self.spread, -4, 4)
        v = np.concatenate([latent, measures], axis=1).astype(np.float32)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def vote(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray, neighbours: int = NEIGHBOURS, sharpness: float = SHARPNESS) -> np.ndarray:
    """The similarity-weighted share of label 1 among each vector's nearest labelled neighbours."""
    if not len(known):
        return np.full(len(vectors), 0.5)
    near = vectors @ known.T
    k = min(neighbours, len(known))
    top = np.argpartition(near, len(known) - k, axis=1)[:, len(known) - k :]
    weight = np.exp(sharpness * np.take_along_axis(near, top, 1).astype(np.float64))
    return (weight * labels[top]).sum(1) / weight.sum(1)


def _held_out(column) -> F.Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def labelled_features(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most`` labelled rows outside the held-out fold."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~_held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.round(F.avg(label_col)).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(most)
    )
    # At most ``most`` rows of two numbers: the limit bounds the broadcast.
    rows = docs.select(F.col(id_col).alias("_doc"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_id", "_label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                raw = features(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in raw], pa.binary())], names=["_id", "_label", "raw"])

    # Repeated documents of one id would pass the bound, so one row of each id is taken.
    found = rows.mapInArrow(lean(run), "_id long, _label int, raw binary").groupBy("_id").agg(F.min("_label").alias("_label"), F.min("raw").alias("raw")).orderBy("_id").collect()
    raw = np.stack([np.frombuffer(r.raw, np.float32) for r in found]) if found else np.zeros((0, TERMS + MEASURES), np.float32)
    return raw, np.array([r["_label"] for r in found], np.float64)


def _scorer(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int):
    """A function of texts to scores, fitted on the driver and shipped once to each executor."""
    raw, known_labels = labelled_features(docs, labels, id_col, text_col, label_col, most)
    space = Space(raw) if len(raw) else None
    known = space.vectors(raw) if space else np.zeros((0, 1), np.float32)
    shipped = docs.sparkSession.sparkContext.broadcast((space, known, known_labels))

    def score(texts: list[str | None]) -> np.ndarray:
        space, known, known_labels = shipped.value
        if not space:
            return np.full(len(texts), 0.5)
        return np.clip(vote(space.vectors(features([t or "" for t in texts])), known, known_labels), 0, 1)

    return score


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, most: int = LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    score = _scorer(docs, labels, id_col, text_col, label_col, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                scores = score(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), _held_out(F.col(id_col)).alias("held_out"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, most: int = LABELLED) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all columns; no shuffle."""
    score, at = _scorer(docs, labels, id_col, text_col, label_col, most), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield part.filter(pa.array(score(part.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
