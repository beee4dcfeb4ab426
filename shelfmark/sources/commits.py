"""Numbered commits of a folder: exclusive creation, manifests, conflicts by schema, removal of what is unused.

``commits`` has one small file per commit, numbered without gaps, which holds the name of a manifest
below ``manifests``: which version of each schema is the current one.  Only one writer can create the
file of a number.  A writer that finds its number taken looks at what was committed meanwhile: if none of
these schemas is its own, it carries its own schemas over to the newer manifest and tries the next number,
without writing data again; else it has a conflict.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ["config", "instance", "schema"]
KEEP, KEEP_SECONDS = 10, 7 * 24 * 3600  # commits that stay readable: the last ones, and all younger ones


class Conflict(Exception):
    """Another writer has committed the same schemas since the version that this one was made from."""


def folder(spark: SparkSession, path: str):
    """The file system of a folder and its path there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _listed(spark: SparkSession, path: str) -> list:
    fs, place = folder(spark, path)
    return list(fs.listStatus(place)) if fs.exists(place) else []


def numbers(spark: SparkSession, path: str) -> dict[int, float]:
    """All numbers that are kept and when they were committed, in seconds."""
    files = [(f.getPath().getName(), f.getModificationTime() / 1000) for f in _listed(spark, f"{path}/commits")]
    return {int(n): at for n, at in files if n.isdigit()}


def version(spark: SparkSession, path: str) -> int:
    """Number of the latest commit, 0 where nothing is committed."""
    return max(numbers(spark, path), default=0)


def new_name() -> str:
    return uuid.uuid4().hex


def commit(spark: SparkSession, path: str, base: int, name: str) -> int:
    """Commit ``name`` as the number after ``base``; creating the file fails if it is there."""
    number = base + 1
    fs, place = folder(spark, f"{path}/commits/{number:020d}")
    try:
        out = fs.create(place, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            raise Conflict(f"{path}: version {number} is committed already") from e
        raise
    out.write(bytearray(name.encode()))
    out.close()
    return number


def names(spark: SparkSession, path: str) -> DataFrame:
    """``number, name`` of all commits."""
    files = spark.read.text(f"{path}/commits", wholetext=True)
    return files.select(F.col("_metadata.file_name").cast("bigint").alias("number"), F.col("value").alias("name"))


def manifest(spark: SparkSession, path: str, number: int) -> DataFrame:
    """``config, instance, schema, version`` of a commit; empty for number 0."""
    fields = ", ".join(f"`{k}` STRING" for k in [*LEVELS, "version"])
    if number == 0:
        return spark.createDataFrame([], fields)
    name = names(spark, path).where(F.col("number") == number).first()
    if name is None:
        raise LookupError(f"{path}: version {number} is no longer kept")
    return spark.read.schema(fields).parquet(f"{path}/manifests/{name['name']}")


def touched(spark: SparkSession, path: str, base: int, number: int) -> DataFrame:
    """Schemas whose version is another one, or gone, or new in ``number`` than in ``base``."""
    old = manifest(spark, path, base).withColumnRenamed("version", "before")
    both = old.join(manifest(spark, path, number), LEVELS, "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("version"))).select(*LEVELS)


def commit_schemas(spark: SparkSession, path: str, base: int, name: str, schemas: DataFrame) -> int:
    """Commit version ``name`` of ``schemas``, made from commit ``base``; the number of the commit.

    Commits since then are kept; one that concerns any of these schemas raises ``Conflict``.
    """
    new = schemas.select(*LEVELS).withColumn("version", F.lit(name))
    while True:
        latest = version(spark, path)
        if latest > base:
            try:
                others = touched(spark, path, base, latest)
            except LookupError as gone:
                raise Conflict(str(gone)) from gone
            same = others.join(schemas, LEVELS, "left_semi").limit(3).collect()
            if same:
                listed = ", ".join("/".join(map(str, r)) for r in same)
                raise Conflict(f"{path}: committed since version {base}: {listed}")
        kept = manifest(spark, path, latest).join(schemas, LEVELS, "left_anti")
        own = new_name()
        kept.unionByName(new).write.parquet(f"{path}/manifests/{own}")
        try:
            return commit(spark, path, latest, own)
        except Conflict:
            continue  # somebody was faster: look at that commit as well


def vacuum(spark: SparkSession, path: str, keep: int = KEEP, seconds: float = KEEP_SECONDS) -> list[str]:
    """Remove what no kept commit names; the folders and files that went.

    Kept are the last ``keep`` commits and those of the last ``seconds``.  Folders that no commit names are
    what writers left that are lost, or what writers are still writing: younger ones stay.  So a reader
    of a kept number, and a writer that takes less than ``seconds``, are not disturbed.
    """
    before = time.time() - seconds
    all_numbers = numbers(spark, path)
    last = sorted(all_numbers)[-max(keep, 1) :]
    live = {n for n, at in all_numbers.items() if n in last or at >= before}
    gone = []

    def remove(place: str) -> None:
        fs, target = folder(spark, place)
        fs.delete(target, True)
        gone.append(place)

    if not live:
        return gone
    named = {r["number"]: r["name"] for r in names(spark, path).collect()}
    # Commits first: what they name is then out of reach for new readers.
    for number in sorted(set(all_numbers) - live):
        remove(f"{path}/commits/{number:020d}")
    versions = {r["version"] for n in live for r in manifest(spark, path, n).select("version").distinct().collect()}
    used = {"manifests": {named[n] for n in live}}
    used |= {part: {f"version={v}" for v in versions} for part in ("tables", "facts")}
    # The index of names, see ``pages``: a directory per indexed commit, which names files of several builds.
    indexed = numbers(spark, f"{path}/names")
    for number in sorted(set(indexed) - live):
        remove(f"{path}/names/commits/{number:020d}")
    if indexed:
        still = live & set(indexed)
        directories = {r["name"] for r in names(spark, f"{path}/names").collect()} if still else set()
        builds = {
            r["build"]
            for d in directories
            for r in spark.read.parquet(f"{path}/names/directories/{d}").select("build").distinct().collect()
        }
        used |= {"names/directories": directories, "names/files": builds}
    for part, kept in used.items():
        for status in _listed(spark, f"{path}/{part}"):
            name = status.getPath().getName()
            if name not in kept and status.getModificationTime() / 1000 < before:
                remove(f"{path}/{part}/{name}")
    return gone


def sizes(spark: SparkSession, path: str, versions: list[str]) -> dict[str, int]:
    """Bytes of the facts and tables of versions."""
    found = {}
    for v in versions:
        places = [folder(spark, f"{path}/{part}/version={v}") for part in ("tables", "facts")]
        found[v] = sum(fs.getContentSummary(place).getLength() for fs, place in places if fs.exists(place))
    return found
