"""Session-level helpers: where lineage is cut, and how partition counts follow the data."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes the package importable in the Python workers of this application, wherever they run; done once."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    where = temporary(spark, f"{shared_dir(spark)}/crysmill/package-{uuid.uuid4().hex[:12]}") + "/crysmill_package.zip"
    write_bytes(spark, where, packed.getvalue())
    sc.addPyFile(where)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, from ``spark.checkpoint.dir``; where that is unset, local sessions get one of their own."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="crysmill-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _fs(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def delete(spark: SparkSession, where: str) -> None:
    fs, path = _fs(spark, where)
    fs.delete(path, True)


def temporary(spark: SparkSession, where: str) -> str:
    """``where``, which is deleted when the application ends."""
    fs, path = _fs(spark, where)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return where


def write_bytes(spark: SparkSession, where: str, data: bytes) -> None:
    fs, path = _fs(spark, where)
    out = fs.create(path, True)
    out.write(bytearray(data))
    out.close()


def read_bytes(spark: SparkSession, where: str) -> bytes | None:
    """A small file's content, or None where there is none."""
    fs, path = _fs(spark, where)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


class Scratch:
    """Tables written to the shared folder to cut lineage; superseded ones can be dropped while the job runs, the rest
    goes with the application or by ``close``."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = temporary(spark, f"{shared_dir(spark)}/crysmill/{label}-{uuid.uuid4().hex[:12]}")
        self._n = 0

    def put(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.base}/t{self._n}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def put_counting(self, df: DataFrame, what: Column) -> tuple[DataFrame, int]:
        """As ``put``, with the number of rows for which ``what`` holds, counted while they are written."""
        seen = Observation()
        out = self.put(df.observe(seen, F.count_if(what).alias("n")))
        return out, (seen.get or {}).get("n") or 0

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            delete(self.spark, path)

    def close(self) -> None:
        delete(self.spark, self.base)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
