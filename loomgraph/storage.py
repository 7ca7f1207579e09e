"""Where intermediate tables go: the shared folder the cluster names, so that lineage can be cut and executors lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}

#: Bytes of rows that a task sends to Python at a time while a table is written, where the session names none (Spark's 10,000 rows
#: of long texts are tens of MB, held on both sides).
ARROW_BYTES = "4m"
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of numbers to a task where about how many there are is known: each task's files cost more than its rows otherwise.
TASK_ROWS = 20_000
#: Parquet options for numbers in rising order: packed differences, about a byte a number instead of eight.
PACKED = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where that is unset and Spark runs in one process (as in tests).

    Where it is unset on a cluster, this raises: every executor would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    return _OWN_DIR[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/loomgraph/{uuid.uuid4().hex}/{tag}"


def materialize(df: DataFrame, tag: str = "step", rows: int | None = None, **options: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors, computes df once.

    (An eager DataFrame.checkpoint() computes df twice, once to count it and once to write it.) rows: about how many there are; they take one task for each TASK_ROWS
    at most (all rows are written, whatever their number). options: of the Parquet writer.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    schema = df.schema
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // TASK_ROWS)))
    unset = spark.conf.get(_ARROW, None) is None
    if unset:
        spark.conf.set(_ARROW, ARROW_BYTES)
    try:
        df.write.options(**options).parquet(path)
    finally:
        if unset:
            spark.conf.unset(_ARROW)
    return spark.read.schema(schema).parquet(path)


def stored(df: DataFrame) -> bool:
    """Whether df only reads, row by row, tables that materialize() wrote: to write it again would gain nothing."""

    def bare(plan) -> bool:
        name, children = plan.nodeName(), plan.children()
        if name.startswith("LogicalRelation"):
            return True
        return name in ("Project", "Filter", "Generate", "Union") and all(bare(children.apply(i)) for i in range(children.size()))

    base = f"{shared_dir(df.sparkSession)}/loomgraph/".split(":", 1)[-1].lstrip("/")
    files = df.inputFiles()
    return bool(files) and all(f.split(":", 1)[-1].lstrip("/").startswith(base) for f in files) and bare(df._jdf.queryExecution().optimizedPlan())


def kept(df: DataFrame, tag: str = "step", **options: str) -> DataFrame:
    """df as it is where it is stored(), else materialize()d: for tables that every round reads."""
    return df if stored(df) else materialize(df, tag, **options)


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables that materialize() gave and no later plan reads; others are left alone."""
    for df in tables:
        if df is None:
            continue
        spark = df.sparkSession
        base = f"{shared_dir(spark)}/loomgraph/".split(":", 1)[-1].lstrip("/")
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.split(":", 1)[-1].lstrip("/").startswith(base):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
