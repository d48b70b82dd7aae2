"""Small helpers that every operator of this subpackage uses."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes that separate words: the ASCII white space of ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\f\r"
#: Maps A-Z to a-z and leaves every other byte alone, so UTF-8 stays valid.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_own_folder: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share. A local one only where Spark itself is local and names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="tidelog-"))
    return _own_folder[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, makes later reads repeatable and survives lost executors.
    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def written_by_key(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write ``df`` as a table in the warehouse, dealt by a hash of ``key`` to as many buckets as
    shuffles have partitions, so that later grouping by ``key`` moves nothing."""
    spark = df.sparkSession
    name = f"tidelog_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").bucketBy(buckets, key).saveAsTable(name)
    place = f"{spark.conf.get('spark.sql.warehouse.dir')}/{name}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(place)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.table(name)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, one for each of ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8, A-Z lower-cased; null has none."""
    return text.encode().translate(LOWER).split() if text else []


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


def id_crc_py(value: object) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())
