"""What the corpus operators share: inputs, identity of rows, stored intermediate tables, Arrow passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.session import scratch_table


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark from wherever ``folder`` points."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that no other column's name can clash.

    The id keeps its type and may be null or repeated; the text becomes a string, null stays null.
    """
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))


def row_key() -> Column:
    """Sixty-four bits of (doc_id, text), the same on every scan of a table.

    Together with ``doc_id`` it names a document: rows equal in both columns are one
    document and share every decision; rows that differ in either one do not.
    """
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder, and read back from there.

    Cuts the lineage like a checkpoint, survives lost executors, and is read by column.
    The shuffles behind it are of no more use then and are dropped at once.
    """
    spark, drop = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = scratch_table(spark, name), spark.conf.get(drop, "false")
    spark.conf.set(drop, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(drop, before)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(stored: DataFrame) -> None:
    """Deletes a table that ``store`` has written, once nothing reads it any more; only what ``store`` returned itself."""
    context = stored.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(stored._stored_at)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def with_schema(docs: DataFrame, *fields: tuple[str, str | T.DataType]) -> T.StructType:
    """``doc_id`` as in ``docs`` and the named result columns."""
    kinds = [(n, T._parse_datatype_string(k) if isinstance(k, str) else k) for n, k in fields]
    return T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType),
                         *(T.StructField(n, k) for n, k in kinds)])


def scan_texts(docs: DataFrame, schema: T.StructType, start: Callable[[], Callable[..., dict[str, list]]],
               extra: Sequence[str] = ()) -> DataFrame:
    """One pass over (doc_id, text): a row out for each row in, batch by batch.

    ``start`` runs once in each task and returns the function that maps the texts of
    a batch, and the values of the columns ``extra``, to lists of values by column name.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):  # keeps Python's objects few
                part = batch.slice(k, 1000)
                made = work(*(part.column(c).to_pylist() for c in ("text", *extra)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(columns.field(0).type),
                     *(x if isinstance(x, pa.Array) else pa.array(x, columns.field(n).type)
                       for n, x in ((n, made[n]) for n in columns.names[1:]))],
                    schema=columns)

    return docs.select("doc_id", "text", *extra).mapInArrow(run, schema)


def filter_texts(docs: DataFrame, text: str, start: Callable[[], Callable[..., list[bool]]],
                 extra: Sequence[str] = ()) -> DataFrame:
    """Rows of ``docs`` whose text, with the last columns ``extra``, the task's function keeps; all columns but those stay."""
    at, kept = docs.columns.index(text), len(docs.columns) - len(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                keep = work(*(part.column(c).to_pylist() for c in (at, *range(kept, kept + len(extra)))))
                yield part.select(list(range(kept))).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields[:kept]))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
