"""Quality classifier: labels of the nearest neighbours, weighted by similarity.

A text becomes hashed counts of what it is made of (runs of four character kinds, three bytes,
repeated words and lines, lengths), then a latent-semantic vector: weighted by inverse document
frequency, projected on the leading singular directions of the labelled texts, scaled to length 1.
The labelled vectors, at most ``MAX_LABELLED`` of them, are broadcast; every document's cosines with
all of them are computed exactly, as products of blocks, and the labels of the most similar ones
vote with their similarity.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import seeded

MAX_LABELLED = 4096  # labelled rows that are fitted and broadcast; more are sampled by seeded hash
KINDS, BYTES, FACTS = 1024, 512, 128  # hashed counts of each sort
DIRECTIONS = 48
SPARE, ROUNDS = 16, 12  # of the iteration that finds them: further directions, and steps
NEIGHBOURS = 15
SHARP = 8  # power of the similarity with which a label votes
ROWS = 512  # documents of a block
PIECE = 1 << 20  # bytes of a text that are counted at a time
THRESHOLD = 0.7

_WIDTH = KINDS + BYTES + FACTS
# Lower case and bytes above ASCII are one kind, upper case, digits and controls one each; every
# other character is its own.
_KIND = bytes(
    ord("a") if chr(b).islower() or b >= 128 else ord("A") if chr(b).isupper() else ord("0") if chr(b).isdigit() else b
    for b in range(256)
)
_LETTERS = re.compile(rb"[^\W\d_]", re.ASCII)


class Model(NamedTuple):
    weights: np.ndarray  # inverse document frequencies
    directions: np.ndarray  # width x directions
    vectors: np.ndarray  # labelled x directions, of length 1
    labels: np.ndarray


def _runs(data: np.ndarray, width: int, buckets: int) -> np.ndarray:
    """Counts of the hashed runs of ``width`` bytes."""
    n = len(data) - width + 1
    if n < 1:
        return np.zeros(buckets, np.int64)
    code = np.zeros(n, np.uint32)
    for k in range(width):
        code = code * np.uint32(257) + data[k : k + n]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - int(math.log2(buckets)))
    return np.bincount(code, minlength=buckets)


def _distinct_pairs(words: list[bytes]) -> int:
    """Number of different pairs of neighbouring words; long texts number their words instead of holding pairs."""
    if len(words) < PIECE:
        return len(set(zip(words, words[1:])))
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    return len(np.unique(ids[:-1] * len(numbers) + ids[1:]))


def features(text: bytes | None) -> np.ndarray:
    """Hashed counts, in logarithms, of a whole text."""
    text = text or b""
    kinds, grams = np.zeros(KINDS, np.int64), np.zeros(BYTES, np.int64)
    for at in range(0, max(len(text), 1), PIECE):
        piece = text[at : at + PIECE + 3]
        kinds += _runs(np.frombuffer(piece.translate(_KIND), np.uint8).astype(np.uint32), 4, KINDS)
        grams += _runs(np.frombuffer(piece[: PIECE + 2].lower(), np.uint8).astype(np.uint32), 3, BYTES)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n = len(words)
    share = lambda part, whole: min(15, int(16 * part / whole)) if whole else 0
    facts = np.zeros(FACTS, np.int64)
    facts[min(15, n.bit_length())] = 1
    facts[16 + share(sum(map(eq, words, words[1:])), n)] = 1
    facts[32 + share(len(set(words)), n)] = 1
    facts[48 + share(len(lines) - len(set(lines)), len(lines))] = 1
    facts[64 + share(_distinct_pairs(words), n)] = 1
    facts[80 + share(len(_LETTERS.findall(text)) if n < 20 else 0, len(text))] = 1
    parts = [np.log1p(p * (1000 / max(len(text), 50))) for p in (kinds, grams)]
    return np.concatenate([*parts, facts * 3.0]).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def fit(rows: np.ndarray, labels: np.ndarray) -> Model:
    """Weights, directions and vectors of the labelled texts' features."""
    seen = (rows > 0).sum(axis=0)
    weights = (np.log((1 + len(rows)) / (1 + seen)) + 0.3).astype(np.float32)
    weighted = _unit(rows * weights)
    directions = _leading(weighted)
    return Model(weights, directions, _unit(weighted @ directions), labels.astype(np.float32))


def _leading(rows: np.ndarray) -> np.ndarray:
    """The leading right singular directions, by subspace iteration: no width x width matrix is held."""
    start = np.random.default_rng(4).standard_normal((rows.shape[1], DIRECTIONS + SPARE)).astype(np.float32)
    basis = np.linalg.qr(start)[0]
    for _ in range(ROUNDS):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    _, turn = np.linalg.eigh((image := rows @ basis).T @ image)
    return basis @ turn[:, ::-1][:, :DIRECTIONS]


def vote(model: Model, rows: np.ndarray) -> np.ndarray:
    """Score of each row: its nearest neighbours' labels, weighted by similarity; 0 to 1.

    Of neighbours that tie for the last place those of smaller ids vote.
    """
    if not len(model.labels):
        return np.full(len(rows), 0.5)
    cosines = _unit(_unit(rows * model.weights) @ model.directions) @ model.vectors.T
    k = min(NEIGHBOURS, cosines.shape[1])
    near = np.argpartition(cosines, -k, axis=1)[:, -k:]
    least = np.take_along_axis(cosines, near, axis=1).min(axis=1, keepdims=True)
    for row in np.flatnonzero((cosines >= least).sum(axis=1) > k):
        near[row] = np.argsort(-cosines[row], kind="stable")[:k]
    weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** SHARP + 1e-9
    return (weight * model.labels[near]).sum(axis=1) / weight.sum(axis=1)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on the labelled rows of ``docs`` whose crc32 of the id, modulo 4, is not 2.

    Null labels and ids are left out; of a row labelled twice the lower label counts, of an id with
    several texts the least text.  At most ``MAX_LABELLED`` rows come to the driver.  Labels of absent documents do not count.
    """
    usable = (
        labels.where(F.col(label).isNotNull() & (_fold() != 2))
        .join(docs.select("doc_id"), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("_label"))
    )
    picked = usable.orderBy(seeded(4, "doc_id"), "doc_id").limit(MAX_LABELLED)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("_text"))
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "_label").agg(F.min("_text").alias("_text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()).tobytes() for t in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "row"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return fit(*_gathered(rows.mapInArrow(counted, f"doc_id {kind}, label int, row binary")))


def _gathered(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels by id, with one copy of them in memory at a time."""
    found = rows.toArrow().sort_by("doc_id")
    matrix = np.empty((found.num_rows, _WIDTH), np.float32)
    for k, row in enumerate(found["row"]):
        matrix[k] = np.frombuffer(row.as_buffer(), np.float32)
    return matrix, found["label"].to_numpy()


def _fold():
    return F.crc32(F.col("doc_id").cast("string")) % 4


def scores(docs: DataFrame, model: Model, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carried`` columns, ``held_out, score, predicted`` for every row of ``docs`` and its whole ``text``.

    A null text is empty, and an empty one is scored like others, by what short texts are worth.
    Without labelled rows every score is 0.5.  A null id is not held out.  Repeated rows are scored
    each; other columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*carried, "held_out", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                block = batch.slice(at, ROWS)
                rows = np.stack([features(t.as_py()) for t in block.column(0)])
                found = pa.array(vote(shared.value, rows), pa.float64())
                yield pa.RecordBatch.from_arrays([*block.columns[1:], found], names=names)

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    held = F.coalesce(_fold() == 2, F.lit(False)).alias("held_out")
    text = F.col("text").cast("binary").alias("_text")
    scored = docs.select(text, *carried, held).mapInArrow(
        score, f"{kinds}, held_out boolean, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
