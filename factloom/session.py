"""Session helpers: a tuned local session, the shared checkpoint folder, bounded reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", app: str = "factloom", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.factloom.scan.partitions", cores if cores.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in a local session where it is unset."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        configured = context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="spark-factloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application's scratch tables inside the shared folder."""
    return f"{shared_dir(spark)}/factloom-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; Spark makes the folder when it first writes there."""
    return f"{scratch_root(spark)}/{what}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; call it when none of its results is read any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialised(df: DataFrame, what: str) -> DataFrame:
    """The table written once under the shared folder and read back, so that later uses do not compute it again."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS_PER_TASK = 100_000


def spread(scan: DataFrame) -> DataFrame:
    """A table scan dealt to ``spark.factloom.scan.partitions`` tasks where that is set, as in local sessions; else as it is."""
    wanted = scan.sparkSession.conf.get("spark.factloom.scan.partitions", None)
    return scan.repartition(int(wanted)) if wanted else scan


def dealt(scan: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """A scan of narrow rows whose later steps are costly, dealt to all cores: a file may hold a million rows in one split.

    Rows are counted (from the footers of a Parquet scan); a task gets about ``rows_per_task`` of them, fewer where cores would idle.
    """
    wanted = scan.sparkSession.conf.get("spark.factloom.scan.partitions", None)
    if wanted:
        return scan.repartition(int(wanted))
    return scan.repartition(max(3 * scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // rows_per_task)))


def checkpointed(df: DataFrame) -> DataFrame:
    """The table written to the shared checkpoint folder, read back from there afterwards."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


BROADCAST_BYTES = 16 << 20


def small_side(side: DataFrame, row_bytes: int) -> DataFrame:
    """A stored table as the side of a join: broadcast where its rows, counted here, fit the bound, else left to be shuffled."""
    return F.broadcast(side) if side.count() * row_bytes <= BROADCAST_BYTES else side


class TooLarge(ValueError):
    """A table that has to be a small parameter is larger than its stated bound."""


def take_bounded(df: DataFrame, bound: int, what: str) -> list[Row]:
    """Bring a parameter-sized table to the driver, refusing anything above ``bound`` rows."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise TooLarge(f"{what}: more than {bound} rows; pass it as a joined table instead")
    return rows


def parameter_table(spark: SparkSession, rows, schema: str, broadcast_rows: int = 20_000) -> DataFrame:
    """A table made of a parameter: broadcast up to a number of rows, joined like any other table beyond it."""
    rows = [tuple(r) for r in rows]
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= broadcast_rows else table


def small_table(spark: SparkSession, rows, schema: str, bound: int, what: str) -> DataFrame:
    """A parameter-sized table, broadcast because its row count is checked here."""
    rows = [tuple(r) for r in rows]
    if len(rows) > bound:
        raise TooLarge(f"{what}: {len(rows)} rows, more than {bound}")
    return F.broadcast(spark.createDataFrame(rows, schema))
