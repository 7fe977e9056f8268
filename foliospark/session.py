"""What operators need from a session: the shared folder, and the size checks that guard broadcasts."""

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that an operator broadcasts. Larger sides go through a shuffle.
BROADCAST_ROWS = 1_000_000
#: Most bytes of them.
BROADCAST_BYTES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from spark.checkpoint.dir; one of our own where that is unset and all runs on this machine, an error on a cluster."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if given:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(given)
        return given
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        folder = tempfile.mkdtemp(prefix="foliospark-")
        atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir("file://" + folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """The same rows with their lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of df ready for a broadcast if there are at most so many and they take at most BROADCAST_BYTES, df as it is otherwise.

    A side that is small is computed here, once, and joined as given rows; of a larger one no more than the bound is read.
    """
    most = min(most, BROADCAST_BYTES // (16 + df._jdf.schema().defaultSize()))  # a row has a header too
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows > most or rows.nbytes > BROADCAST_BYTES:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once a Spark application, unless they find it by themselves."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parents[1]
    seen = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if sc.applicationId in _shipped or any(p and Path(p).resolve() == root for p in seen):
        return
    _shipped.add(sc.applicationId)
    # the driver serves the file as long as the application runs
    folder = tempfile.mkdtemp(prefix="foliospark-")
    atexit.register(shutil.rmtree, folder, True)
    file = f"{folder}/foliospark-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(file, "w") as z:
        for f in sorted((root / "foliospark").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(file)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame, least_bytes: int = 1_000_000) -> DataFrame:
    """A scan of so few pieces that most cores would idle, spread over all of them; any other scan, and tiny ones, as they are.

    Large tables come in more pieces than there are cores and are never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) < least_bytes or df.rdd.getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores)


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


#: Stage tables of this process, in order.
_stages: list[str] = []


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def written(df: DataFrame) -> DataFrame:
    """The same rows read from a Parquet table written to the shared folder: short lineage, short plans, pruned columns. It is deleted when the application ends, if not before."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    fs, p = file_system(df.sparkSession, path)
    fs.deleteOnExit(p)
    df.write.parquet(path)
    _stages.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_mark() -> int:
    return len(_stages)


def settled(df: DataFrame, since: int) -> DataFrame:
    """df written to a table of its own, and every stage table made since the mark deleted."""
    out = written(df)
    for path in _stages[since:-1]:
        fs, p = file_system(df.sparkSession, path)
        fs.delete(p, True)
    del _stages[since:-1]
    return out
