"""Session helpers: the shared checkpoint folder and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows that Spark hands to a Python worker at a time.
BATCH_ROWS = 1000
#: Written rows of this size, in bytes, are worth a task.
PARTITION_BYTES = 1 << 20
#: Rows of a few numbers each that a task is given at most, and those that are worth a task.
TASK_ROWS, FEW_ROWS = 500_000, 20_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent and no folder was chosen yet (a local test session) a
    temporary folder takes its place.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="corelith-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it with its lineage cut.

    The files survive a lost executor, unlike cached blocks or a local checkpoint. A checkpointed frame keeps the
    size that was estimated for its plan, and joins multiply such sizes; in a loop the estimates soon have
    thousands of digits and planning stalls. So the written rows go into a frame of no estimate; adaptive
    execution goes by the sizes that it measures.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    written = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(_gathered(spark, written), written.schema(), False), spark)


def _gathered(spark: SparkSession, written):
    """The rows of a checkpoint in no more partitions than cores or ``PARTITION_BYTES`` ask for, without a shuffle.

    Every later shuffle writes files for each of its input's partitions, so very small ones cost more than they hold.
    """
    context, jvm = spark.sparkContext, spark.sparkContext._jvm
    rows, held = written.queryExecution().toRdd(), written.queryExecution().logical().rdd()
    path = jvm.org.apache.hadoop.fs.Path(held.getCheckpointFile().get())
    size = path.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    enough = max(context.defaultParallelism, size // PARTITION_BYTES)
    if enough >= held.getNumPartitions():
        return rows
    return rows.coalesce(enough, False, jvm.scala.Option.empty(), None)


def shared_path(spark: SparkSession, suffix: str) -> str:
    """A new path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}.{suffix}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and return the written table."""
    path = shared_path(df.sparkSession, "parquet")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, the unit in which operators size their splits."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def width(rows: int, spark: SparkSession) -> int:
    """For how many partitions ``rows`` narrow rows ask, so that a task's memory does not grow with them.

    Adaptive execution merges partitions up to a size in compressed bytes, which may be very many rows of a few numbers.
    """
    return max(min(spark.sparkContext.defaultParallelism, -(-rows // FEW_ROWS)), -(-rows // TASK_ROWS), 1)


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, wherever the driver has imported it from, and batches of few rows.

    Rows may hold whole texts, and a worker has a batch in memory several times over.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    if getattr(context, "_corelith_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    bundle = Path(tempfile.mkdtemp(prefix="corelith-bundle-")) / f"{package.name}.zip"
    with zipfile.ZipFile(bundle, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(bundle))
    context._corelith_shipped = True
