"""Token ids in files of separately compressed documents with a shared zstandard dictionary.

A file is one row of a Parquet table: the frames of many documents one after the other
(``data``), where each begins (``offsets``), the documents' ids and token counts, the width
of an id in bytes, and the SHA-256 of the dictionary that reads them. One document is read
by its offset alone. The dictionary lies beside the files in a table of its own.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidelog.llm import tokens
from tidelog.llm.shared import scratch_dir, written

END = 1
#: Documents on whose ids the dictionary is trained, and its bytes at most. Any dictionary gives the same ids back.
TRAINING_DOCUMENTS = 1000
TRAINING_IDS = 2000
DICTIONARY_BYTES = 64 * 1024
#: Bytes of frames after which a file is closed.
FILE_BYTES = 8_000_000

FILES = "part int, number long, first_id long, last_id long, dictionary_sha256 string, width int, doc_ids array<long>, n_tokens array<long>, offsets array<long>, data binary"


def serialize(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids


def training_sample(docs: DataFrame) -> list[str]:
    """At most TRAINING_DOCUMENTS texts of 1 to 20,000 characters, by a hash of ids and texts from all parts of the
    table: tasks send little more than that in all. Where too few are found, a greater share is looked through."""
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    share = min(1.0, 2 * TRAINING_DOCUMENTS / max(docs.count(), 1))
    while True:
        near = docs.where(place < F.lit(int(share * (1 << 30)))).where("length(text) between 1 and 20000")
        found = [r["text"] for r in near.orderBy(place, "doc_id", "text").select("text").limit(TRAINING_DOCUMENTS).collect()]
        if share >= 1 or len(found) >= TRAINING_DOCUMENTS // 4:
            return found
        share = min(1.0, 8 * share)


def train_dictionary(docs: DataFrame, path: str, cut: str, width: int) -> bytes:
    """A dictionary from :func:`training_sample`; empty if there is too little to train on."""
    sample = [serialize(x[: 4 * TRAINING_IDS], width) for x in tokens.encode_texts(training_sample(docs), path, cut)]
    sample = [x for x in sample if len(x) >= 16]
    if len(sample) < 20:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, sample)) // 8)), sample).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_files(docs: DataFrame, folder: str, path: str, cut: str = "space", end: int = END, partitions: int | None = None) -> None:
    """Encode whole texts, append ``end``, and write them to ``folder`` in ascending doc_id order.

    Null ids come first; null texts hold the end id alone; repeated rows are all written.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width = 2 if tokens.tokenizer(path).get_vocab_size() <= 1 << 16 else 4
    dictionary = train_dictionary(docs, path, cut, width)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        last = np.array([end], dtype="<u4")
        for batch in batches:
            doc_ids, row = batch.column("doc_id"), 0
            for flat, ends in tokens.encode_arrow(batch.column("text"), path, cut):
                edges = [0, *ends.tolist()]
                packed = [press.compress(serialize(np.append(flat[a:b], last).tobytes(), width)) for a, b in zip(edges, edges[1:])]
                sizes = pa.array(np.diff(edges) + 1, pa.int64())
                yield pa.RecordBatch.from_arrays([doc_ids.slice(row, len(packed)), sizes, pa.array(packed, pa.binary())], names=["doc_id", "n", "frame"])
                row += len(packed)

    def shard(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def close() -> pd.DataFrame:
            offsets = np.cumsum([0, *map(len, parts)]).tolist()
            return pd.DataFrame({"part": [part], "number": [number], "first_id": pd.array([ids[0]], dtype="Int64"), "last_id": pd.array([ids[-1]], dtype="Int64"), "dictionary_sha256": [name], "width": [width], "doc_ids": [ids], "n_tokens": [sizes], "offsets": [offsets], "data": [b"".join(parts)]})

        ids, sizes, parts, total, number, part = [], [], [], 0, 0, 0
        for frame in frames:
            for doc_id, n, data, part in zip(frame["doc_id"].tolist(), frame["n"].tolist(), frame["frame"].tolist(), frame["part"].tolist()):
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                sizes.append(int(n))
                parts.append(data)
                total += len(data)
                if total >= FILE_BYTES:
                    yield close()
                    ids, sizes, parts, total, number = [], [], [], 0, number + 1
        if ids:
            yield close()

    frames = docs.mapInArrow(compress, "doc_id string, n long, frame binary").withColumn("key", F.col("doc_id").cast("long"))
    frames = written(frames, "frames")
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the row's number parts rows that share an id or have none
    ranged = frames.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions, "key", "row")
    ranged = ranged.sortWithinPartitions("key", "row").withColumn("part", F.spark_partition_id()).drop("key", "row")
    ranged.mapInPandas(shard, FILES).write.option("compression", "none").parquet(f"{folder}/files")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files, in their order.

    ``start`` sums the ids of all documents before: within a file by its index, over the
    files of a part and over the parts by two small running sums.
    """
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").collect()[0]["dictionary"])
    name = hashlib.sha256(dictionary).hexdigest()
    files = spark.read.schema(FILES).parquet(f"{folder}/files")
    sums = files.select("part", "number", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = sums.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.withColumn("whole", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    inside = sums.withColumn("own", F.sum("n").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    begins = inside.join(before, "part").select("part", "number", (F.coalesce("whole", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("begin"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for frame in frames:
            for row in frame.itertuples():
                if row.dictionary_sha256 != name:
                    raise ValueError(f"file {row.part}/{row.number} needs another dictionary: {row.dictionary_sha256}")
                view, out = memoryview(row.data), []
                starts = row.begin + np.cumsum([0, *row.n_tokens])
                for i in range(len(row.n_tokens)):
                    ids = np.frombuffer(press.decompress(view[row.offsets[i] : row.offsets[i + 1]]), "<u2" if row.width == 2 else "<u4").astype("<u4")
                    out.append((int(starts[i]), len(ids), zlib.crc32(ids.tobytes())))
                found = pd.DataFrame(out, columns=["start", "n_tokens", "ids_crc32"])
                found.insert(0, "doc_id", pd.array([None if pd.isna(x) else int(x) for x in row.doc_ids], dtype="Int64"))
                yield found

    return files.drop("first_id", "last_id").join(begins, ["part", "number"]).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of one document (of each row with that id), by the offset index alone.

    Files stand in order of ids, so their first and last ids tell which can hold it; of the others
    nothing but those two is read."""
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").collect()[0]["dictionary"])
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    files = spark.read.schema(FILES).parquet(f"{folder}/files").where((F.col("first_id") <= doc_id) | F.col("first_id").isNull()).where(F.col("last_id") >= doc_id).where(F.array_contains("doc_ids", doc_id))
    one = files.select("width", F.explode(F.filter(F.sequence(F.lit(1), F.size("doc_ids")), lambda i: F.element_at("doc_ids", i) == doc_id)).alias("i"), "offsets", "data")
    one = one.select("width", F.expr("substring(data, cast(offsets[i - 1] + 1 as int), cast(offsets[i] - offsets[i - 1] as int))").alias("frame"))
    return [np.frombuffer(press.decompress(bytes(r["frame"])), "<u2" if r["width"] == 2 else "<u4").tolist() for r in one.collect()]


def round_trip(docs: DataFrame, path: str, cut: str = "space", end: int = END) -> DataFrame:
    """Write ``docs`` to new files in the shared folder and read them back."""
    spark = docs.sparkSession
    folder = f"{scratch_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_files(docs, folder, path, cut, end)
    return read_files(spark, folder)
