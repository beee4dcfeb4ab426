"""G3, G5. Folded states in levels of folders that are merged as they grow in number.

A batch adds one folder of level 0.  Where a level has ``fan`` folders, they are merged to one of the next
level, so ``n`` batches leave about ``fan * log(n)`` folders, and a row is rewritten once per level.
``_manifests`` has one small file per batch with the names of the folders that hold the state; a reader
opens these and no others.  Folders that the last manifests do not name are removed, so readers that
have just opened one are not disturbed.  A batch that runs twice, or a writer that is lost anywhere
between, leaves the manifest as it was or the whole new one: folders come first, their names last.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark.sources.commits import folder

FAN = 4  # folders of a level
KEEP = 2  # manifests whose folders stay


class Segment(NamedTuple):
    """A folder: its level, the batches in it, and the newest ``last_at`` in it, in microseconds."""

    level: int
    first: int
    last: int
    newest: int | None

    @property
    def name(self) -> str:
        return f"batch={self.first}" if self.level == 0 else f"batch={self.first}-{self.last}"


class Manifest(NamedTuple):
    batch: int  # the last batch that is in the state
    segments: list[Segment]
    schema: str = ""  # of the rows, as JSON: a folder without rows may have no file that tells it


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, place = folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in _names(spark, f"{path}/_manifests") if n.isdigit())


def _file(path: str, number: int) -> str:
    return f"{path}/_manifests/{number:020d}"


def _read(spark: SparkSession, path: str, number: int) -> Manifest:
    text = spark.read.text(_file(path, number), wholetext=True).first()["value"]
    read = json.loads(text)
    return Manifest(read["batch"], [Segment(*s) for s in read["segments"]], read["schema"])


def latest(spark: SparkSession, path: str) -> Manifest:
    """The current manifest; without batches an empty one."""
    numbers = _numbers(spark, path)
    return _read(spark, path, numbers[-1]) if numbers else Manifest(-1, [])


def _write(spark: SparkSession, path: str, manifest: Manifest) -> None:
    target = _file(path, manifest.batch)
    fs, hidden = folder(spark, f"{path}/_manifests/.{manifest.batch}")
    out = fs.create(hidden, True)
    out.write(bytearray(json.dumps(manifest._asdict()).encode()))
    out.close()
    # Only a whole file ever has the name that readers look for.
    if not fs.rename(hidden, folder(spark, target)[1]):
        raise OSError(f"{target} could not be written")


def segments(spark: SparkSession, path: str, named: list[Segment], schema: str) -> DataFrame:
    """The rows of some folders."""
    kind = StructType.fromJson(json.loads(schema))
    return spark.read.schema(kind).parquet(*[f"{path}/{s.name}" for s in named])


def _newest(rows: DataFrame) -> int | None:
    return rows.agg(F.max(F.unix_micros("last_at"))).first()[0]


def _merged(
    spark: SparkSession,
    path: str,
    group: list[Segment],
    others: list[Segment],
    schema: str,
    fold: Callable[[DataFrame], DataFrame],
    ttl_seconds: float | None,
) -> Segment:
    """One folder of the next level in place of ``group``, without what is past retention.

    A key is dropped if it has had nothing for ``ttl_seconds`` up to the newest row of all: neither in
    the group nor in ``others``, which may have newer rows of it.
    """
    state = fold(segments(spark, path, group, schema))
    if ttl_seconds is not None:
        newest = max((s.newest for s in [*group, *others] if s.newest is not None), default=0)
        is_old = F.unix_micros("last_at") <= newest - int(ttl_seconds * 1e6)
        state = state.withColumn("_old", is_old)
        alive = [s for s in others if s.newest is not None and s.newest > newest - int(ttl_seconds * 1e6)]
        kept = state.where("NOT _old")
        if alive:
            young = segments(spark, path, alive, schema).where(~is_old).select("job_id")
            kept = kept.union(state.where("_old").join(young, "job_id", "left_semi"))
        state = kept.drop("_old")
    made = Segment(group[0].level + 1, group[0].first, group[-1].last, None)
    state.write.mode("overwrite").parquet(f"{path}/{made.name}")
    return made._replace(newest=_newest(segments(spark, path, [made], schema)))


def add(
    batch: DataFrame,
    path: str,
    batch_id: int,
    fold: Callable[[DataFrame], DataFrame],
    fan: int = FAN,
    ttl_seconds: float | None = None,
) -> None:
    """Add a batch of folded rows (``job_id``, ``last_at`` and what ``fold`` folds) to the state in ``path``."""
    spark = batch.sparkSession
    before = latest(spark, path)
    if batch_id <= before.batch:
        return  # it ran before and is in
    own, schema = Segment(0, batch_id, batch_id, None), batch.schema.json()
    batch.write.mode("overwrite").parquet(f"{path}/{own.name}")
    held = [*before.segments, own._replace(newest=_newest(segments(spark, path, [own], schema)))]
    level = 0
    while len(group := [s for s in held if s.level == level]) >= fan:
        others = [s for s in held if s.level != level]
        held = [*others, _merged(spark, path, group, others, schema, fold, ttl_seconds)]
        level += 1
    _write(spark, path, Manifest(batch_id, held, schema))
    _clean(spark, path)


def _clean(spark: SparkSession, path: str) -> None:
    """Remove older manifests, and folders that none of the kept ones names."""
    numbers = _numbers(spark, path)
    for number in numbers[:-KEEP]:
        fs, place = folder(spark, _file(path, number))
        fs.delete(place, False)
    named = {s.name for n in numbers[-KEEP:] for s in _read(spark, path, n).segments}
    for name in _names(spark, path):
        if name.startswith("batch=") and name not in named:
            fs, place = folder(spark, f"{path}/{name}")
            fs.delete(place, True)
