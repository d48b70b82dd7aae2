"""Best-fit packing with certified bin counts.

Documents become pieces of at most ``capacity`` tokens. Full pieces are sequences as they
are. The others are dealt to groups by a hash and packed best-fit decreasing in each.
Dual-feasible functions give each group a lower bound, and one for all pieces together.
A group at its bound is certified and stays as it is. Groups with a gap exchange the pieces
of their sequences that aren't full and are packed again; where every group is at its bound
but their sum is not at the bound of all, the gap lies between the groups, and all their
open sequences exchange. This goes on until the whole is certified or nothing is saved.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidelog.llm import tokens
from tidelog.llm.shared import written

CAPACITY = 2048
#: Pieces of one group; bounds a task's memory and time.
GROUP_PIECES = 100_000
END = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, cut: str = "byte", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row per piece of every document. A document longer than ``capacity`` starts with its
    shorter piece. Null and empty texts are one piece that holds only the end id."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array([end], dtype="<u4")
        for batch in batches:
            ids, at_row = batch.column("doc_id"), 0
            for flat, ends in tokens.encode_arrow(batch.column("text"), path, cut):
                rows, out = [], []
                for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                    own = np.append(flat[a:b], last)
                    at, k = 0, 0
                    while at < len(own):
                        size = (len(own) % capacity or capacity) if k == 0 else capacity
                        out.append((k, at, size, zlib.crc32(own[at : at + size].tobytes())))
                        rows.append(at_row)
                        at, k = at + size, k + 1
                    at_row += 1
                columns = [pa.array(x, pa.int64()) for x in zip(*out)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), *columns], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    made = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(build, "doc_id string, piece long, start long, length long, ids_crc32 long")
    return made.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32")


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[int]:
    """The bin of each length, best-fit decreasing. Bins of equal room form a stack, and the
    set bits of one number tell which rooms occur."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins, out = 0, 0, [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            chosen = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, chosen, bins = capacity, bins, bins + 1
        out[i] = chosen
        if room > size:
            stacks[room - size].append(chosen)
            rooms |= 1 << (room - size)
    return out


def bound_of(n: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best bound from two families of dual-feasible functions over a histogram of lengths."""
    if not n.sum():
        return 0
    size = np.arange(capacity + 1)
    total = np.cumsum(n * size)
    count = np.cumsum(n)
    best = -(-int(total[-1]) // capacity)
    for e in range(1, capacity // 2 + 1):  # over capacity - e counts whole, under e counts nothing
        weight = (count[-1] - count[capacity - e]) * capacity + total[capacity - e] - total[e - 1]
        best = max(best, -(-int(weight) // capacity))
    for k in range(1, 21):  # a length x becomes floor((k + 1) x) / k; whole multiples stay
        scaled = (k + 1) * size
        weight = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((n * weight).sum()) // (capacity * k)))
    return best


def lower_bound(lengths: list[int], capacity: int = CAPACITY) -> int:
    return bound_of(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bins", "bound"]


def _packed(items: DataFrame, number: int, capacity: int) -> DataFrame:
    """``items`` with sequence_id, filled (tokens in the sequence) and the group's count and bound."""
    groups = max(1, -(-items.count() // GROUP_PIECES))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=False, kind="stable").reset_index(drop=True)
        lengths = frame["length"].tolist()
        frame["sequence_id"] = (number << 56) + (int(frame["part"].iloc[0]) << 28) + np.array(best_fit(lengths, capacity), dtype=np.int64)
        frame["filled"] = frame.groupby("sequence_id")["length"].transform("sum")
        frame["offset"] = frame.groupby("sequence_id")["length"].cumsum() - frame["length"]
        frame["bins"], frame["bound"] = frame["sequence_id"].nunique(), lower_bound(lengths, capacity)
        return frame[[*COLUMNS, "filled", "part"]]

    # the row's number spreads rows without an id, and rows that repeat
    dealt = items.select(*COLUMNS[:5]).withColumn("row", F.monotonically_increasing_id())
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "row", F.lit(number)), F.lit(groups))).drop("row")
    done = dealt.groupBy("part").applyInPandas(pack, PIECES + ", sequence_id long, offset long, bins long, bound long, filled long, part long")
    return written(done, "packed")


def pack_documents(docs: DataFrame, path: str, cut: str = "byte", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece, and bins and
    bound: how many sequences its group was packed into last, and the least it could take.

    All rows are packed: null ids and texts too, and repeated rows each on their own. An empty
    table gives an empty table. Other columns of ``docs`` play no part.
    """
    cutup = written(pieces(docs, path, cut, capacity, end), "pieces")
    whole = cutup.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    whole = whole.withColumns({"offset": F.lit(0).cast("long"), "bins": F.lit(1).cast("long"), "bound": F.lit(1).cast("long")})
    rest = cutup.where(F.col("length") < capacity)
    histogram = np.zeros(capacity + 1, np.int64)
    for r in rest.groupBy("length").count().collect():  # at most a row for each length
        histogram[r["length"]] = r["count"]
    least = bound_of(histogram, capacity)
    packed, number, everywhere = _packed(rest, 0, capacity), 0, False
    total = _sequences(packed)
    while total > least:
        gap = F.lit(everywhere) | (F.col("bins") > F.col("bound"))
        moving = packed.where(gap & (F.col("filled") < capacity))
        before = _sequences(moving)
        again = _packed(moving, number + 1, capacity) if before > 1 else None
        saved = before - _sequences(again) if again is not None else 0
        if saved > 0:
            stay = packed.where(~(gap & (F.col("filled") < capacity)))
            packed, number, total = written(stay.unionByName(again), "packed"), number + 1, total - saved
        if saved <= 0 and everywhere:
            break  # an exchange between all groups saved nothing
        everywhere = saved <= 0
    return whole.select(COLUMNS).union(packed.select(COLUMNS))


def _sequences(packed: DataFrame) -> int:
    """Every sequence begins once."""
    return packed.where("offset = 0").count()
