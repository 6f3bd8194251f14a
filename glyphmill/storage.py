"""Tables between steps: written once to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_MARKED: set[str] = set()
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one that the session names in
    spark.checkpoint.dir (or with setCheckpointDir); it goes when the driver ends.
    Only where all executors are on this machine, as in tests, may none be named."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        path = f"{named.rstrip('/')}/glyphmill-{sc.applicationId}"
        if path not in _MARKED:
            hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
            fs = hadoop.getFileSystem(sc._jsc.hadoopConfiguration())
            fs.mkdirs(hadoop)
            fs.deleteOnExit(hadoop)
            _MARKED.add(path)
        return path
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="glyphmill-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once as Parquet in the shared folder and reread, so
    that later uses neither compute them again nor depend on lost executors."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Lets Arrow batches to Python workers have 4 MB or one row, not Spark's 64 MB:
    an executor holds several copies of a task's batch outside its heap. A limit that
    the session names stays. It holds from then on, as tables are computed later."""
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, "4m")


def by_repeats(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key no other has, which need no grouping, and the others, None if
    there are none; null is a key. Keys alone are sent to find out."""
    again = cut(df.groupBy(key).count().where("count > 1").select(F.col(key).alias("again")))
    if again.isEmpty():
        return df, None
    same = df[key].eqNullSafe(again["again"])
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names like those wanted that clash with none taken, in any case."""
    low = {c.lower() for c in taken}
    out = []
    for w in wanted:
        while w.lower() in low:
            w += "_"
        low.add(w.lower())
        out.append(w)
    return out


def quoted(name: str) -> str:
    """The name of a top-level column as an expression, dots and all."""
    return "`" + name.replace("`", "``") + "`"
