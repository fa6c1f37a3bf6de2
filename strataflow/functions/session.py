"""Session settings and lineage cuts for iterative plans."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings the engine counts on: adaptive plans, skew joins, UTC."""
    for key, value in {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}.items():
        builder = builder.config(key, value)
    return builder


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, unless their Python finds it by itself."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    paths = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if getattr(context, "_strataflow_sent", False) or any(p and Path(p).resolve() == root for p in paths):
        return
    archive = Path(tempfile.mkdtemp(prefix="strataflow-")) / "strataflow.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "strataflow").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(str(archive))
    context._strataflow_sent = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all of Spark runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="strataflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, written to the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str, buckets: int) -> tuple[DataFrame, str]:
    """cut, with rows kept in buckets of a key: joins on it read them without a shuffle. Also the folder, for readers that need no buckets.

    Buckets are known to the session's catalog alone: whoever is done with the rows takes them out of it (`forget`).
    """
    name = f"cut_{uuid.uuid4().hex}"
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name), path


def forget(spark: SparkSession, path: str) -> None:
    """Takes what cut_by wrote out of the catalog; the files stay in the shared folder."""
    spark.sql(f"DROP TABLE IF EXISTS {path.rsplit('/', 1)[1]}")
