"""Sessions, the shared working folder, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lookout")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LOOKOUT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    It is the session's spark.checkpoint.dir. Only a local master may go without it; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir isn't set: a cluster needs a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lookout-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    if "://" not in found:
        found = "file://" + os.path.abspath(found) if spark.sparkContext.master.startswith("local") else found
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_made: list[str] = []


def fresh_path(spark: SparkSession, what: str) -> str:
    _made.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables that this process has written; frames that read them can't be used any more."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the intermediate tables that were written within it; take results out before."""
    before = set(_made)
    try:
        yield
    finally:
        for name in [p for p in _made if p not in before]:
            _made.remove(name)
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Plans that hold one of these have exchanges, whose partitions the planner chooses when it runs them.
_EXCHANGING = re.compile(r"\b(?:Join|Aggregate|Window|WindowGroupLimit|Sort|Repartition|RepartitionByExpression|RebalancePartitions|Deduplicate|Distinct|Intersect|Except)\b")


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 32 << 20) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if its counted rows and bytes are within the bounds, else as it is.

    It is counted first, so a frame that isn't cheap to read twice, one with exchanges, is written first.
    """
    if _EXCHANGING.search(df._jdf.queryExecution().optimizedPlan().toString()):
        df = materialize(df, "small-side")
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    small = rows <= max_rows and size <= max_bytes
    return (F.broadcast(df) if small else df), small


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it only reads fewer splits of files than those, as a table of one small file; else as it is.

    Splits are estimated from the sizes of fewer files than there are cores; nothing is run or planned physically.
    """
    spark = df.sparkSession
    if df.isStreaming or _EXCHANGING.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not 0 < len(files) < cores:
        return df
    sizes = []
    for f in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        sizes.append(path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen())
    number = lambda k: int(spark._jsparkSession.sessionState().conf().getConf(getattr(spark._jvm.org.apache.spark.sql.internal.SQLConf, k)()))
    most, opening = number("FILES_MAX_PARTITION_BYTES"), number("FILES_OPEN_COST_IN_BYTES")
    split = min(most, max(opening, (sum(sizes) + len(sizes) * opening) // cores))
    return df.repartition(cores) if sum(-(-n // split) for n in sizes) < cores else df
