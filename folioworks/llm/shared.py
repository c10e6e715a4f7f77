"""What several operators of this package need: staged tables, words and hashes of texts."""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.session import shared_dir


def staging_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_dir(spark)}/llm/{uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files, which outlive any executor."""
    path = staging_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch: Spark's default of 10,000 whole texts can be more than a Python worker should hold.
BATCH_ROWS = "500"


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size, unless the user has set one."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def utf8(texts: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes."""
    return texts.cast(pa.binary()).to_pylist()


def words(raw: bytes | None) -> list[bytes]:
    """Maximal runs of bytes other than space and 0x09 to 0x0D: what ``bytes.split`` cuts at, too."""
    return raw.split() if raw else []


class WordHashes(dict):
    """64-bit hash of each word, computed once; emptied when it grows beyond ``bound`` words."""

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, split: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, split), np.uint64, len(split))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_HALF = np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = (x ^ (x >> _HALF)) * _MIX1
    x = (x ^ (x >> _HALF)) * _MIX2
    return x ^ (x >> _HALF)


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash for every run of ``width`` consecutive words; none if there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mixed(hashes[:n] + _ODD)
    for k in range(1, width):
        out = mixed((out + hashes[k : k + n]) * _ODD)
    return out


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def folder_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of a Parquet folder that may not exist yet."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
