"""Session helpers of the operators: the shared folder, sizes, written tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions.session import ship


#: Folders written by this session that nothing has discarded yet.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all of Spark runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="strataflow-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def bounded(spark: SparkSession, most: int = 8 << 20) -> SparkSession:
    """Keeps Arrow batches to `most` bytes: off-heap buffers and Python's copies of them count against an executor."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name)).rstrip("bB")
    if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
        spark.conf.set(name, str(most))
    ship(spark)
    return spark


def materialize(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: cuts the lineage, survives lost executors.

    compact: rows are few bytes beside what they were made from (a scan of texts), so they are first gathered into files of the
    advisory size; else each task of a large scan would leave a tiny file.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows = df.hint("rebalance") if compact else df
    rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many folders there are to discard."""
    return len(_WRITTEN)


def discard(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Deletes the folders written since written() was `since`, but for the last `keep`: nothing may need them any more."""
    stop = len(_WRITTEN) - keep
    for path in _WRITTEN[since:stop]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    del _WRITTEN[since:stop]


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, at least 1."""
    return int(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) + 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
