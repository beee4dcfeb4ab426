"""Near-duplicates by min-max hashing.

Of every permutation of a text's shingles both the least and the greatest value are kept, so that a
signature of ``2 * PERMUTATIONS`` values takes half the hash evaluations of MinHash; either value
agrees between two texts with the probability of their Jaccard similarity.  Texts that agree on all
rows of a band are candidates.

Links are confirmed on full sets of shingles, but a group of ``n`` alike texts is not compared
``n * n`` times, since only components are asked for:

1. texts with equal words are one node;
2. every member of a bucket is compared with the bucket's least node by sketches, which are a lower
   bound of the difference of two sets; of what remains first one link per member, then those
   between different components are confirmed, and components are formed;
3. members of one bucket that are still in different components are compared pair by pair, in
   blocks, by sketches: no linked pair is lost, and nearly every pair that remains is a link, which
   is then confirmed.

Shingles are 64-bit hashes of five words.  At the threshold of 0.85, a linked pair shares no band
with a probability of about 2e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import broadcast_if_small
from shelfmark.llm.components import components
from shelfmark.shared import written

SHINGLE = 5  # words
PERCENT = 85  # least Jaccard similarity of linked texts
PERMUTATIONS = 48
ROWS = 4  # values of a band
BLOCK = 256  # members of a bucket, or of a star, that meet in one task
KNOWN_WORDS = 1 << 20  # words whose hashes a worker remembers

_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, from the golden ratio


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _shingles(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of five words, or of all words if they are fewer; sorted."""
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _mixed(out * _MIX + h[k : k + n])
    return np.unique(out)


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(7).integers(0, 2**63, (2, PERMUTATIONS, 1), dtype=np.uint64)
    return drawn[0] * np.uint64(2) + np.uint64(1), drawn[1]


def _signature(shingles: np.ndarray) -> np.ndarray:
    """The least and then the greatest value of each permutation."""
    factor, shift = _permutations()
    low, high = [], []
    for at in range(0, len(shingles), 8192):
        values = shingles[at : at + 8192] * factor + shift
        low.append(values.min(axis=1))
        high.append(values.max(axis=1))
    return np.concatenate([np.min(low, axis=0), np.max(high, axis=0)])


def _bands(signature: np.ndarray) -> np.ndarray:
    """One key per band; a band holds least or greatest values of different permutations."""
    rows = signature.reshape(-1, ROWS)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mixed(key * _MIX + rows[:, k])
    return key.view(np.int64)


def _sketch(shingles: np.ndarray) -> bytes:
    """Parity of the shingles per bucket of their low bits; of two sketches, at least so many
    shingles are in one set only as bits differ."""
    bits = max(512, 1 << int(2 * len(shingles) - 1).bit_length())
    parity = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def _split(text: bytes | None) -> list[bytes]:
    # Of bytes, Python lowers A-Z only and splits at the six ASCII white spaces.
    return text.lower().split() if text else []


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, node, sketch, bands``; node and what follows are null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, sketches, bands = [], [], [], []
            for text in batch.column(1):
                words = _split(text.as_py())
                if words:
                    shingles = _shingles(words)
                    sizes.append(len(shingles))
                    nodes.append(_digest(words))
                    sketches.append(_sketch(shingles))
                    bands.append(_bands(_signature(shingles)))
                else:
                    sizes.append(0)
                    for column in (nodes, sketches, bands):
                        column.append(None)
            columns = [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(nodes, pa.binary()),
                pa.array(sketches, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
            ]
            names = ["doc_id", "n_shingles", "node", "sketch", "bands"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        sign, f"doc_id {kind}, n_shingles long, node binary, sketch binary, bands array<long>"
    )


def _fits(n: np.ndarray | int, m: int) -> np.ndarray | bool:
    """Sets of these sizes can be linked."""
    return (n * 100 >= m * PERCENT) & (m * 100 >= n * PERCENT)


def _near(differing, n, m):
    """Sets of sizes ``n`` and ``m`` with so many elements in one only can be linked."""
    return (100 + PERCENT) * differing <= (100 - PERCENT) * (n + m)


def _folded(sketch: bytes, size: int) -> bytes:
    """A sketch of fewer bits: the parts of the long one, added bit by bit."""
    words = np.frombuffer(sketch, np.uint64).reshape(-1, size // 8)
    return np.bitwise_xor.reduce(words, axis=0).tobytes()


def _close(n: int, a: bytes, m: int, b: bytes) -> bool:
    if not _fits(n, m):
        return False
    size = min(len(a), len(b))
    a, b = (x if len(x) == size else _folded(x, size) for x in (a, b))
    return _near((int.from_bytes(a) ^ int.from_bytes(b)).bit_count(), n, m)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: their sketches become Python values a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def _stars(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``head, id``: members that their bucket's head may be linked with."""
    pairs = members.select("head", "id").distinct()
    facts = nodes.select("id", "n_shingles", "sketch")
    of_head = facts.toDF("head", "head_n", "head_sketch")
    both = pairs.join(facts, "id").join(of_head, "head")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            facts = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            mask = pa.array([bool(_close(n, a, m, b)) for n, a, m, b in facts], pa.bool_())
            yield batch.select([0, 1]).filter(mask)

    return both.select("head", "id", "n_shingles", "sketch", "head_n", "head_sketch").mapInArrow(
        keep, "head long, id long"
    )


def _compare(group: list[tuple]) -> Iterator[tuple[int, int]]:
    """Pairs of different components and different chunks (or of the only one) that may be linked."""
    group = sorted(group, key=lambda row: row[2])
    sizes = np.array([row[2] for row in group])
    comps = np.array([row[1] for row in group])
    chunks = np.array([row[4] for row in group])
    one = chunks.min() == chunks.max()
    by_size: dict[int, np.ndarray] = {}
    for size in {len(row[3]) for row in group}:
        rows = [row[3] if len(row[3]) <= size else _folded(row[3], size) for row in group]
        by_size[size] = np.frombuffer(
            b"".join(r if len(r) == size else bytes(size) for r in rows), np.uint64
        ).reshape(len(group), -1)
    for i, row in enumerate(group):
        to = np.searchsorted(sizes, row[2] * 100 // PERCENT, side="right")
        at = np.arange(i + 1, to)
        at = at[(comps[at] != comps[i]) & (one | (chunks[at] != chunks[i]))]
        if len(at):
            sketch = by_size[len(row[3])]
            differing = np.bitwise_count(sketch[at] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            for j in at[_near(differing, sizes[at], row[2])]:
                yield tuple(sorted((row[0], group[j][0])))


def _dealt(inner: DataFrame) -> DataFrame:
    """``key, lo, hi, id, component, chunk``: members of buckets in all blocks, that is pairs of chunks,
    in which they meet members of other components.

    A component with a chunk's members or more has chunks of its own, which do not meet each other;
    smaller ones share chunks.  So one outsider meets a large component once.
    """
    keys = inner.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    met = written(inner.join(keys.select("key"), "key"), "met")
    counted = met.groupBy("key", "component").agg(F.count("*").alias("n"))
    own = F.when(F.col("n") >= BLOCK, F.col("component")).alias("own")
    groups = counted.groupBy("key", own).agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("chunks"))
    of_key = Window.partitionBy("key")
    placed = groups.select(
        "key", "own", "chunks",
        (F.sum("chunks").over(of_key.orderBy("own")) - F.col("chunks")).cast("int").alias("first"),
        F.sum("chunks").over(of_key).cast("int").alias("total"),
    ).withColumnsRenamed({"key": "_key", "own": "_own"})
    here = (F.col("key") == F.col("_key")) & F.col("own").eqNullSafe(F.col("_own"))
    others = F.filter(
        F.sequence(F.lit(0), F.col("total") - 1),
        lambda k: F.col("own").isNull() | (k < F.col("first")) | (k >= F.col("first") + F.col("chunks")),
    )
    return (
        met.join(counted.select("key", "component", own), ["key", "component"])
        .join(placed, here)
        .withColumn("chunk", F.col("first") + F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(others))
        .select(
            "key",
            F.least("chunk", "other").alias("lo"),
            F.greatest("chunk", "other").alias("hi"),
            "id", "component", "chunk",
        )
    )


def _across(members: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``head, id``: members of a bucket, not its head, in different components, that may be linked."""
    label = F.coalesce("component", "id").alias("component")
    inner = members.join(labels, "id", "left").select("key", "id", label)
    spread = _dealt(inner).join(nodes.select("id", "n_shingles", "sketch"), "id")

    def rows(batches):
        for batch in _small(batches):
            yield from zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for (_, lo, hi), group in groupby(rows(batches), key=lambda row: row[:3]):
            group = [row[3:] for row in group]
            # Both chunks of a block, or a chunk with itself.
            if lo == hi or len({row[4] for row in group}) == 2:
                found.update(_compare(group))
            if len(found) > 50_000:
                yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*found))], names=["head", "id"])
                found = set()
        if found:
            yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*found))], names=["head", "id"])

    blocks = spread.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return (
        blocks.select("key", "lo", "hi", "id", "component", "n_shingles", "sketch", "chunk")
        .mapInArrow(compare, "head long, id long")
        .distinct()
    )


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``head, id`` whose full sets of shingles are linked, as edges ``a, b``.

    The texts of the nodes concerned are read again; a set goes once to each star it is part of.  A
    star with many members is dealt over salts, to each of which its head goes.
    """
    pairs = written(pairs, "pairs")
    salts = pairs.groupBy("head").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))
    member = pairs.join(salts, "head").select(
        "id", "head", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt")
    )
    heads = salts.select(
        F.col("head").alias("id"), "head",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
    )
    places = (
        member.union(heads).groupBy("id").agg(F.collect_list(F.struct("head", "salt")).alias("places"))
    )
    wanted = broadcast_if_small(written(places.join(nodes.select("id", "node", "rep"), "id"), "wanted"))
    texts = docs.select(F.col("doc_id").alias("rep_id"), F.col("text").cast("binary").alias("text"))
    found = texts.join(wanted, F.col("rep_id").eqNullSafe(F.col("rep")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["head", "salt", "id", "shingles"]
        out = pa.schema([("head", pa.int64()), ("salt", pa.int32()), ("id", pa.int64()), ("shingles", pa.binary())])
        for batch in batches:
            rows, size = [], 0
            for text, node, id_, places in zip(*(batch.column(i) for i in range(4)), strict=True):
                words = _split(text.as_py())
                if _digest(words) == node.as_py():
                    shingles = _shingles(words).tobytes()
                    for place in places.as_py():
                        rows.append((place["head"], place["salt"], id_.as_py(), shingles))
                        size += len(shingles)
                if size > 1 << 24:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], out)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], out)

    spread = (
        found.select("text", "node", "id", "places")
        .mapInArrow(sets, "head long, salt int, id long, shingles binary")
        .repartition("head", "salt")
        .withColumn("member", F.col("id") != F.col("head"))
        .sortWithinPartitions("head", "salt", "member")
        .select("head", "salt", "member", "id", "shingles")
    )

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head = None, None
        for batch in batches:
            a, b = [], []
            for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                h, salt, member, id_ = (x.as_py() for x in row[:4])
                shingles = np.frombuffer(row[4].as_py(), np.uint64)
                if (h, salt) != key:
                    key, head = (h, salt), shingles
                if member:
                    shared = len(np.intersect1d(head, shingles, assume_unique=True))
                    if 100 * shared >= PERCENT * (len(head) + len(shingles) - shared):
                        a.append(h)
                        b.append(id_)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return written(spread.mapInArrow(confirm, "a long, b long"), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` and its whole ``text``.

    ``component_id`` is the least ``doc_id`` reachable over linked texts, ``kept`` whether it is the
    row's own.  Null texts and texts without words have no shingles, are linked with nothing and are
    kept.  Fewer than five words count as one shingle.  Rows with equal text and id are all kept or
    all not; a null id never names a component while another is there, and rows of components
    without any id are kept.  Other columns are not read; an empty table gives no rows.
    """
    signed = written(signatures(docs), "signatures")
    bare = signed.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"),
        F.first("sketch").alias("sketch"), F.first("bands").alias("bands"),
    )
    nodes = written(bare.withColumn("id", F.monotonically_increasing_id()), "nodes")
    buckets = nodes.select("id", F.explode("bands").alias("key"))
    # Each bucket has a head of its own choice, so a group that shares many buckets has many stars.
    chosen = F.min_by("id", F.xxhash64("key", "id")).alias("head")
    heads = buckets.groupBy("key").agg(chosen, F.count("*").alias("n")).where("n > 1").select("key", "head")
    members = written(buckets.join(heads, "key").where("id <> head"), "members")

    stars = written(_stars(members, nodes), "stars")
    first = stars.groupBy("id").agg(F.min("head").alias("head")).select("head", "id")
    edges = _confirmed(first, nodes, docs)
    labels = written(components(edges), "labels")

    def label(column: str):
        return labels.select(F.col("id").alias(column), F.col("component").alias(f"{column}_of"))

    apart = (
        stars.join(label("id"), "id", "left")
        .join(label("head"), "head", "left")
        .where(F.coalesce("id_of", "id") != F.coalesce("head_of", "head"))
        .select("head", "id")
    )
    edges = edges.union(_confirmed(apart, nodes, docs))
    labels = written(components(edges), "labels")
    edges = edges.union(_confirmed(_across(members, nodes, labels), nodes, docs))
    labels = components(edges)

    named = nodes.select("id", "node", "rep").join(labels, "id", "left").select(
        "node", "rep", F.coalesce("component", "id").alias("component")
    )
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = named.join(least, "component").select("node", "component_id")
    rows = signed.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    named_rows = rows.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return named_rows.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
