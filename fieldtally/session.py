"""Session construction and the few settings the library relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "fieldtally", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC display.

    ``conf`` overrides the defaults below; keys use Spark's own names.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Joins whose measured partitions all fit may hash instead of sort.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on the shared checkpoint folder and return it with a short plan.

    The folder is the one the session names in ``spark.checkpoint.dir``; a
    temporary one is chosen only where none is set, as in unit tests.  The
    copy survives the loss of executors, and whatever was computed from
    partition layout (see ``operators.ordering``) is frozen with it.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set only if nobody has.

    Executors on other machines cannot reach a folder of this one, so a
    temporary folder serves a local master only, and goes when Python ends;
    any other master must name shared storage in ``spark.checkpoint.dir``.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not is_local(context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
            named = tempfile.mkdtemp(prefix="fieldtally-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def is_local(master: str) -> bool:
    """Whether tasks run in the driver's own process."""
    return master == "local" or master.startswith("local[")


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh path for a table under the shared folder, which every executor can reach."""
    return f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex[:12]}"
