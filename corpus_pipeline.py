"""From raw documents to mixed and sharded training data: five stages over one table.

Every stage but the last returns the columns of ``documents``; its result is written as Parquet and
read again as the next one's documents.  Stages keep every row that their operator does not reject:

- quality classifier: rows scored below the threshold go;
- near duplicates: of every component the document that names it stays;
- decontamination: documents with any benchmark passage go;
- mixing: a document comes as often as the mix takes the block in which it begins, up to three
  times or not at all, so that sources come near their target weights;
- sharding: every row's shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import classifier, decontaminate, minmax, mixing, shards
from shelfmark.llm.common import broadcast_if_small
from shelfmark.shared import new_folder, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The classifier and the fitted order of stages have no SQL; small runs are tested by brute force.
ORACLE_SQL = None


def _identified(docs: DataFrame) -> DataFrame:
    """The columns of documents and ``row``, an id of their own for rows.

    That is ``doc_id`` where it is never null or repeated; else rows are numbered, and written so
    that the numbers stay.
    """
    docs = docs.select(*COLUMNS)
    plain = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty()
    if plain:
        return docs.withColumn("row", F.col("doc_id"))
    return written(docs.withColumn("row", F.monotonically_increasing_id()), "identified")


def _as_input(rows: DataFrame) -> DataFrame:
    """What operators read, with the row's own id as the document's."""
    return rows.select(F.col("row").alias("doc_id"), "text", "source")


def _decisions(df: DataFrame, name: str) -> DataFrame:
    """Decisions by row, written once, and broadcast if they hold few bytes."""
    return broadcast_if_small(written(df, name))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the nearest labelled neighbours call good."""
    model = classifier.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = classifier.scores(docs, model, tuple(COLUMNS))
    return scored.where("predicted = 1").select(*COLUMNS)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every component of near duplicates."""
    rows = _identified(docs)
    dropped = minmax.near_duplicates(_as_input(rows)).where("NOT kept")
    dropped = _decisions(dropped.select(F.col("doc_id").alias("row")), "dropped")
    return rows.join(dropped, "row", "left_anti").select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any passage of the benchmark."""
    rows = _identified(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    index = decontaminate.build_index(_as_input(rows), benchmark)
    found = decontaminate.phrases(index).select(F.col("doc_id").alias("row")).distinct()
    return rows.join(_decisions(found, "contaminated"), "row", "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated, kept or left out so that sources come near their target weights."""
    rows = _identified(docs)
    taken = mixing.copies(mixing.mix(_as_input(rows))).where("copies > 0")
    taken = _decisions(taken.select(F.col("doc_id").alias("row"), "copies"), "copies")
    return (
        rows.join(taken, "row")
        .withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
        .select(*COLUMNS)
    )


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return shards.shards(docs)


STAGES = [
    ("quality classifier", good),
    ("near duplicates", unlike),
    ("decontamination", clean),
    ("mixing", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = new_folder(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
