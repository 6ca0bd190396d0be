"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's features are its counts of hashed byte pairs, square-rooted and weighted by rarity; a
truncated singular value decomposition of the labelled texts' features gives the latent space. The labelled
vectors, at most PER_CLASS of each label, are broadcast (PER_CLASS * 2 * DIMENSIONS * 4 bytes, 1 MB). Every
document's vector is multiplied with all of them, in blocks, which gives its exact cosines; its NEIGHBOURS nearest
vote for their labels with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagweave.llm.common import pieces

FEATURES, DIMENSIONS, NEIGHBOURS = 2048, 64, 25
#: The bound of the labelled sample: of each label, so many training rows with the least hashes.
PER_CLASS = 2048
SHARPNESS = 8
#: Texts whose features are in memory at once: FEATURES * 8 bytes each, 8 MB.
ROWS = 512

_rng = np.random.default_rng(11)
_LEFT, _RIGHT = (_rng.integers(0, FEATURES, 256, dtype=np.int32) for _ in range(2))


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each text: the square roots of its byte pairs' shares."""
    rows = len(at) - 1
    if len(raw) < 2:
        return np.zeros((rows, FEATURES), np.float32)
    row = np.repeat(np.arange(rows), np.diff(at))
    inside = row[1:] == row[:-1]
    key = row[:-1] * FEATURES + (_LEFT[raw[:-1]] ^ _RIGHT[raw[1:]])
    counts = np.bincount(key[inside], minlength=rows * FEATURES).reshape(rows, FEATURES)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Voters:
    def __init__(self, texts: np.ndarray, quality: np.ndarray) -> None:
        self.prior = float(quality.mean()) if len(quality) else 0.5
        self.quality = quality.astype(np.float32)
        self.rarity = np.log((1 + len(texts)) / (1 + (texts > 0).sum(0))).astype(np.float32) + 1
        weighed = unit(texts * self.rarity)
        k = min(DIMENSIONS, *weighed.shape) if len(texts) else 0
        if k:  # randomized range finding with power steps, then an exact decomposition in the small space
            start = weighed @ np.random.default_rng(5).standard_normal((FEATURES, min(len(texts), k + 16))).astype(np.float32)
            for _ in range(3):
                start, _ = np.linalg.qr(weighed @ (weighed.T @ np.linalg.qr(start)[0]))
            self.axes = np.linalg.svd(start.T @ weighed, full_matrices=False)[2][:k].T.copy()
            self.vectors = unit(weighed @ self.axes)

    def scores(self, texts: np.ndarray) -> np.ndarray:
        if not len(self.quality):
            return np.full(len(texts), self.prior)
        out = np.empty(len(texts))
        k = min(NEIGHBOURS, len(self.quality))
        for i in range(0, len(texts), ROWS):
            near = unit((texts[i : i + ROWS] * self.rarity) @ self.axes) @ self.vectors.T
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64) ** SHARPNESS
            total = weight.sum(1)
            out[i : i + ROWS] = np.where(total > 1e-9, (weight * self.quality[best]).sum(1) / np.maximum(total, 1e-9), self.prior)
        return np.clip(out, 0.0, 1.0)


def fit_voters(docs: DataFrame, labels: DataFrame) -> Voters:
    """labels: doc_id, quality. Rows whose labels are null or disagree teach nothing."""
    agreed = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other and doc_id is not null")
    pick = [agreed.filter(F.col("quality") == q).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS).collect() for q in (0, 1)]
    known = {r["doc_id"]: r["quality"] for rows in pick for r in rows}
    if not known:
        return Voters(np.zeros((0, FEATURES), np.float32), np.zeros(0))
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(known)], "known_id long")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in pieces(batches, most=ROWS):
            x = features(raw, at).astype(np.float16)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("known_id")).select("doc_id", "text")
    rows = chosen.mapInArrow(featured, "doc_id long, x binary").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()  # PER_CLASS * 2 at most
    texts = np.frombuffer(b"".join(r["x"] for r in rows), np.float16).reshape(len(rows), FEATURES).astype(np.float32)
    return Voters(texts, np.array([known[r["doc_id"]] for r in rows], float))


def scored(docs: DataFrame, voters: Voters) -> DataFrame:
    """doc_id and score of every document.

    Defined cases: null and empty texts, and texts without any positive similarity, get the share of label 1 among the
    voters; without voters the score is 0.5; repeated rows are each scored; an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in pieces(batches, most=ROWS):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(shared.value.scores(features(raw, at)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; the voters are labelled rows that are not held out."""
    voters = fit_voters(docs, labels.select("doc_id", "quality").filter(~held_out()))
    return scored(docs, voters).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns; they are filtered where they are read."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_voters(docs, labels.select("doc_id", "quality").filter(~held_out())))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in pieces(batches, most=ROWS):
            yield rows.filter(pa.array(shared.value.scores(features(raw, at)) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
