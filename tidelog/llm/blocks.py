"""Blocks of documents as word tables: each block's distinct words, and its texts as places in them.

A table of words is hashed to buckets. Each block sends one compressed list of its own
distinct words to each bucket, where the lists meet; the bucket works on each distinct word
once and answers each block with one compressed reply. However often a word occurs, it
travels once for each block, and no row per occurrence is ever made. A word in every block,
or a source with a third of all rows, is no hot key: a bucket holds many words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog.llm import tokens

#: Characters after which a block is closed. A longer text is a block of its own.
BLOCK_CHARS = 24_000_000

SCHEMA = "block long, doc_ids array<long>, lengths array<long>, places binary, buckets binary, words array<binary>, counts array<binary>"


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte by byte of each, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=5).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def pack_words(raw: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, raw), "<u4", len(raw))
    return zstandard.ZstdCompressor(level=5).compress(np.array([len(raw)], "<u4").tobytes() + sizes.tobytes() + b"".join(raw))


def unpack_words(data: bytes) -> list[str]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(data, "<u4", n, 4)).tolist()
    body = data[4 + 4 * n :]
    return [body[a:b].decode() for a, b in zip([0, *ends[:-1]], ends)]


def unpack_array(data: bytes) -> pa.Array:
    """The words as a large_string column; none of them becomes a Python object."""
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    edges = np.concatenate(([0], np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64)))
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(edges), pa.py_buffer(data).slice(4 + 4 * n))


def bucket_number(spark: SparkSession) -> int:
    """As many buckets as the session's shuffles have partitions, so they grow with the data."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 16)


def word_blocks(docs: DataFrame, numbered: Callable[[pa.Array], tuple[pa.Array, np.ndarray, np.ndarray]], counted: Callable[[object], bool] | None = None, chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block. Words stand in order of frequency in the block; ``places`` are ranks in it,
    ``buckets`` each word's bucket, ``words`` the bucket's words in that order, ``counts`` how often
    each occurs in documents for whose id ``counted`` is true. ``numbered`` gives a column's distinct
    words, the number of each word of its texts, and where each text's words end. Null texts count
    as empty. A block's number is a hash of its documents and of its place among the task's blocks, so
    the same partitions give the same numbers; write the table before use.
    """
    number = bucket_number(docs.sparkSession)

    def close(ids, lengths, places, known, nth: int) -> pa.RecordBatch:
        flat = np.concatenate(places) if places else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(flat, minlength=len(known)), kind="stable")
        rank = np.empty(len(known), np.int64)
        rank[order] = np.arange(len(known))
        flat = rank[flat]
        listed = list(known)
        words = [listed[i].encode() for i in order.tolist()]
        buckets = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % number
        own = [np.flatnonzero(buckets == b) for b in range(number)] if number <= 64 else np.split(np.argsort(buckets, kind="stable"), np.searchsorted(np.sort(buckets), np.arange(1, number)))
        if counted is None:
            counts = [b""] * number
        else:
            mask = np.repeat(np.array([bool(counted(i)) for i in ids], dtype=bool), lengths)
            n = np.bincount(flat[mask], minlength=len(words))
            counts = [pack(n[o]) for o in own]
        columns = [
            pa.array([own_number(ids, flat, nth)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([pack(flat)]), pa.array([pack(buckets)]),
            pa.array([[pack_words([words[i] for i in o.tolist()]) for o in own]], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.binary())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["block", "doc_ids", "lengths", "places", "buckets", "words", "counts"])

    def own_number(ids: list, flat: np.ndarray, nth: int) -> int:
        place = f"{TaskContext.get().partitionId()} {nth} {ids}".encode()
        return xxhash.xxh64_intdigest(place + np.ascontiguousarray(flat).tobytes()) >> 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, places, known, size, nth = [], [], [], {}, 0, 0
        for batch in batches:
            doc_ids, row = [None if x is None else int(x) for x in batch.column("doc_id").to_pylist()], 0
            for run in tokens.runs(batch.column("text")):
                words, numbers, ends = numbered(run)
                own = np.fromiter((known.setdefault(w, len(known)) for w in words.to_numpy(zero_copy_only=False).tolist()), np.int64, len(words))
                places.append(own[numbers].astype(np.uint32))
                ids += doc_ids[row : row + len(run)]
                lengths += np.diff(ends, prepend=0).tolist()
                row += len(run)
                size += pc.sum(pc.utf8_length(run)).as_py() or 0
                if size >= chars:
                    yield close(ids, lengths, places, known, nth)
                    ids, lengths, places, known, size, nth = [], [], [], {}, 0, nth + 1
        if ids:
            yield close(ids, lengths, places, known, nth)

    # ids as text keep whole where some are null
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(build, SCHEMA)


def lists_by_bucket(table: DataFrame) -> DataFrame:
    """A row per block and bucket: block, bucket, words, counts."""
    return table.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("bucket", "w")).select("block", "bucket", "w.words", "w.counts")


def with_replies(table: DataFrame, replies: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(block row, its replies by bucket, places of each bucket's words)`` for every block.

    ``replies`` has the columns of (block as long), bucket and reply; ``work`` gives a frame."""
    number = bucket_number(table.sparkSession)

    def run(key: tuple, block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        by_bucket = dict(zip(found["bucket"].tolist(), found["reply"].tolist()))
        (row,) = block.itertuples()
        buckets = unpack(row.buckets)
        order = np.argsort(buckets, kind="stable")
        edges = np.searchsorted(buckets[order], np.arange(number + 1))
        return work(row, [by_bucket[b] for b in range(number)], [order[a:b] for a, b in zip(edges[:-1], edges[1:])], len(buckets))

    return table.drop("counts").groupBy("block").cogroup(replies.select(F.col("block").alias("of"), "bucket", "reply").groupBy("of")).applyInPandas(run, schema)
