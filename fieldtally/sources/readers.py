"""Raw tables to DataFrames: Parquet files of drifting schema, CSV, and which sources exist."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.sources import schemas


class MissingSource(FileNotFoundError):
    """A source the library cannot work without is not there."""


def matching_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a glob on any file system Spark can reach, sorted."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.globStatus(path)
    return sorted(f.getPath().toString() for f in found) if found else []


def to_contract(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the contract, by name: cast where the type differs, NULL where missing."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def read_parquet_by_name(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """All Parquet files of a glob as one table aligned by column name.

    The scan is given the contract, which holds the widest type of each
    column: a column absent from older files reads as NULL and a narrower
    integer or float is widened by the reader.  No footer is opened to plan
    the scan, so the number of files does not matter to the driver, and
    filters and column pruning reach every file.
    """
    if not matching_files(spark, pattern):
        raise MissingSource(f"no files match {pattern}")
    return spark.read.schema(schema).parquet(pattern)


def _files_of(spark: SparkSession, path: str) -> dict[str, int]:
    """The data files of a glob and their bytes: of a folder its files, hidden ones left out."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for f in system.globStatus(at) or []:
        found += system.listStatus(f.getPath()) if f.isDirectory() else [f]
    sizes = {f.getPath().toString(): f.getLen() for f in found if f.isFile()}
    return {f: sizes[f] for f in sorted(sizes) if f.rsplit("/", 1)[1][:1] not in "._"}


#: A file of at most so many bytes is read whole to see its first line.
_SMALL_FILE = 1 << 20


def _headers(spark: SparkSession, files: Mapping[str, int]) -> dict[str, tuple[str, ...]]:
    """Column names in the first line of each CSV file, by one job over the small and one over the large ones (besides Spark's own to list many).

    Small files share tasks and are read whole.  Of a larger one every piece is a
    task that stops after a few lines, and the piece at the file's start answers.
    """
    def starts(stop: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = None
            for batch in batches:
                path, at = batch.column("path"), batch.column("at")
                for k in range(1 if stop else batch.num_rows) if batch.num_rows else ():
                    if at[k].as_py() == 0 and path[k].as_py() != last:
                        last = path[k].as_py()
                        yield pa.RecordBatch.from_arrays([path.slice(k, 1), batch.column("value").slice(k, 1)], names=["path", "line"])
                if stop and batch.num_rows:
                    return

        return run

    def lines(chosen: list[str], settings: dict[str, str], stop: bool) -> list:
        before = {k: spark.conf.get(k) for k in settings}
        try:
            for k, v in settings.items():
                spark.conf.set(k, v)
            text = spark.read.text(chosen).select(
                "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
            return text.mapInArrow(starts(stop), "path string, line string").collect()  # one short row a file
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)

    small = [f for f, n in files.items() if n <= _SMALL_FILE]
    large = [f for f, n in files.items() if n > _SMALL_FILE]
    rows = []
    if small:
        rows += lines(small, {}, False)
    if large:
        rows += lines(large, {"spark.sql.files.openCostInBytes": str(1 << 40),
                              "spark.sql.execution.arrow.maxRecordsPerBatch": "16"}, True)
    # Spark names files by escaped URIs, Hadoop by plain ones.
    lines_of = {_bare(unquote(r.path)): r.line for r in rows}
    return {f: tuple(next(csv.reader([lines_of.get(_bare(f), "").lstrip("\ufeff")]), ())) for f in files}


def _bare(path: str) -> str:
    """A path without its scheme, whose slashes are written in more than one way."""
    return path.split(":", 1)[-1].lstrip("/")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, *, multi_line: bool = False) -> DataFrame:
    """Headered CSV files matched to the contract by name; ``"08"`` reads as 8 in an integer column.

    Each file's own header orders its columns: files with the same header are
    one scan, and the scans are aligned by name.  A quote inside quoted text
    is doubled.  Columns are read as text and cast, so a value that does not
    fit its type fails the query instead of silently turning into NULL.
    ``multi_line`` allows line breaks in quoted text, at the price of files
    that can no longer be split.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    files = _files_of(spark, path)
    for file, header in (_headers(spark, files) if files else {}).items():
        if header:
            groups.setdefault(header, []).append(file)
    if not groups:
        raise MissingSource(f"no CSV file with a header matches {path}")
    scans = [
        to_contract(spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in header]))
                    .csv(files, header=True, escape='"', multiLine=multi_line), schema)
        for header, files in groups.items()]
    return reduce(DataFrame.unionByName, scans)


@dataclass(frozen=True)
class Source:
    """Where one raw table lives, relative to the root folder."""

    name: str
    pattern: str
    schema: T.StructType
    format: str = "csv"


MOBILITY = (
    Source("trips", "fhvhv_*.parquet", schemas.TRIPS, "parquet"),
    Source("zones", "taxi_zone_lookup.csv", schemas.ZONES),
)
# A ready classification of the zones, for studies that do not derive their own.
CLASSIFICATION = Source("zone_classification", "crz_zone_classification.csv", schemas.ZONE_CLASSIFICATION)
DELIVERY = (
    Source("orders", "instacart/orders.csv", schemas.ORDERS),
    Source("order_products_prior", "instacart/order_products__prior.csv", schemas.ORDER_PRODUCTS),
    Source("order_products_train", "instacart/order_products__train.csv", schemas.ORDER_PRODUCTS),
    Source("products", "instacart/products.csv", schemas.PRODUCTS),
    Source("aisles", "instacart/aisles.csv", schemas.AISLES),
    Source("departments", "instacart/departments.csv", schemas.DEPARTMENTS),
)


def load(spark: SparkSession, root: str, source: Source) -> DataFrame:
    path = f"{root.rstrip('/')}/{source.pattern}"
    if source.format == "parquet":
        return read_parquet_by_name(spark, path, source.schema)
    return read_csv(spark, path, source.schema)


def load_sources(spark: SparkSession, root: str, *, required: Sequence[Source] = MOBILITY,
                 optional: Sequence[Source] = DELIVERY) -> dict[str, DataFrame]:
    """All raw tables under ``root``, also registered as temporary views.

    A missing required table is an error.  The optional group is loaded whole
    or not at all.
    """
    def present(source: Source) -> bool:
        return bool(matching_files(spark, f"{root.rstrip('/')}/{source.pattern}"))

    absent = [s.pattern for s in required if not present(s)]
    if absent:
        raise MissingSource(f"missing under {root}: {', '.join(absent)}")
    wanted = list(required)
    if all(present(s) for s in optional):
        wanted += optional
    tables = {s.name: load(spark, root, s) for s in wanted}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables


def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table with its number of rows, counted by one job."""
    counts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
              for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)
