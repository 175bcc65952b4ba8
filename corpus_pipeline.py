"""The corpus pipeline: five stages, each one of the numbered operators, over ``documents``."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultgrain.llm import decontaminate, lines, packing, simhash, toxicity
from faultgrain.llm.common import fresh
from faultgrain.llm.components import components
from faultgrain.operators.ids import assign_ids
from faultgrain.session import materialize, scratch_path, scratch_scope, stored

FILE_ROWS = 1 << 33  # more than a file has
LARGE_ID = 1 << 62
BATCH_ROWS = 1000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that numbers its rows alike whenever they are read, and the column's name.

    A row's number is made of those of its file and of its place there, so nothing is written. ``docs`` is what
    was read from Parquet files, as each stage gets it; rows that come from no file are stored first.
    """
    key, path, place = (fresh(docs, name) for name in ("row_key", "row_file", "row_place"))
    try:
        source = docs.metadataColumn("_metadata")
        rows = docs.withColumns({path: source["file_path"], place: source["row_index"]})
    except AnalysisException:
        docs = materialize(docs, "rows")
        source = docs.metadataColumn("_metadata")
        rows = docs.withColumns({path: source["file_path"], place: source["row_index"]})
    # One row a file, of which the driver holds the list already.
    files = rows.select(path).distinct().withColumn(key, (F.row_number().over(Window.orderBy(path)) - 1) * F.lit(FILE_ROWS))
    rows = rows.join(F.broadcast(files), path).withColumn(key, F.col(key) + F.col(place))
    return rows.select(*docs.columns, key), key


def _texts(rows: DataFrame, key: str) -> DataFrame:
    """``doc_id, text`` with the row's key for a doc_id."""
    return rows.select(F.col(key).alias("doc_id"), "text")


def _by_rank(rows: DataFrame, key: str) -> DataFrame:
    """``doc_id, text`` with a number for a doc_id that no two rows share and that has the order of the doc_ids, missing ones last."""
    size = rows.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id"), F.max(F.col("doc_id").cast("long"))).first()
    if size[1] == size[2] and (size[3] or 0) < LARGE_ID:
        # Ids are single: they stay, and rows without one come after the largest.
        last = F.lit(max(size[3] or 0, 0) + 1)
        return rows.select(F.coalesce(F.col("doc_id").cast("long"), last + F.col(key)).alias("doc_id"), "text", key)
    order = rows.select(key, F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"))
    ranked = assign_ids(order, ["missing", "id", key], start=0, column="rank").select(key, "rank")
    return rows.join(ranked, key).select(F.col("rank").alias("doc_id"), "text", key)


def _without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``rows`` whose key is not in the one column of ``gone``."""
    return rows.join(gone.toDF(key), key, "left_anti").drop(key)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model does not reject."""
    rows, key = _keyed(docs)

    def toxic() -> DataFrame:
        judged = toxicity.scored(_texts(rows, key), *toxicity.train(rows, _table(spark, sf_dir, "labels")))
        return judged.filter("predicted = 1").select("doc_id")

    return _without(rows, key, stored(spark, "toxic", toxic))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; ``n_chars``, where there is one, follows the text.

    Every row is a document of its own; the last holder of a line has the largest doc_id, and one without doc_id comes last.
    """
    rows, key = _keyed(docs)

    def gone() -> DataFrame:
        ranked = _by_rank(rows, key)
        found = lines.repeated(ranked.select("doc_id", "text"))
        return found.join(ranked.select("doc_id", key), "doc_id").select(key, "gone")

    return lines.without(rows, key, stored(spark, "line-keys-gone", gone)).drop(key)


def _to_head(groups: DataFrame) -> DataFrame:
    """An edge ``a, b`` from each document that is not its group's smallest to the one that is."""
    return groups.filter("doc_id != component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, a smallest doc_id's.

    Copies are what ``near_duplicates`` links, by fingerprints at most three bits apart, and what ``near_copies`` adds:
    five-word shingles of a similarity of 0.8 or more. Rows are linked by their texts alone; of rows without doc_id
    one stays if its group has no other.
    """
    rows, key = _keyed(docs)

    def copies() -> DataFrame:
        # Numbers in the order of the doc_ids: a group is named by the row that stays.
        ranked = _by_rank(rows, key)
        texts = ranked.select("doc_id", "text")
        # Each is stored before the next begins, so that the scratch tables of the first are gone by then.
        linked = stored(spark, "linked", lambda: _to_head(simhash.near_duplicates(texts)))
        alike = stored(spark, "alike", lambda: _to_head(simhash.near_copies(texts, linked=linked)))
        groups = components(linked.union(alike)).filter("node != component")
        return groups.join(ranked.select("doc_id", key), groups.node == F.col("doc_id")).select(key)

    return _without(rows, key, stored(spark, "near-copies", copies))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark passage."""
    rows, key = _keyed(docs)

    def found() -> DataFrame:
        return decontaminate.contaminations(_texts(rows, key), _table(spark, sf_dir, "benchmark")).select("doc_id").distinct()

    return _without(rows, key, stored(spark, "contaminated", found))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_ROWS texts at most: a worker's and its JVM's buffers hold few texts at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = spark.conf.get(name)
    spark.conf.set(name, str(min(int(given), BATCH_ROWS) if int(given) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, given)


# Class models, fingerprints, edit distances and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result stored and read again by the next.

    A stage's scratch tables are deleted when its result is stored.
    """
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch_scope(spark), _small_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
