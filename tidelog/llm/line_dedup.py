"""Line dedup by winnowing over line hashes.

A window is a run of whole lines, from each line with words on or back from it, that just
reaches ``min_words`` words. Each line with words of a repeated run is in such a window inside
the run: the one from the run's first line, the one back from its last, or else the one back
from the line itself. Each window picks its least line hash (the last of equals): that line is a fingerprint, and a
repeated run of ``min_words`` words or more is sure to hold a window, so to share one. Every
later place of a window is joined with the first place of the same window; neighbouring
windows mostly pick the same line and so give one pair of positions. The pairs of two documents
are extended both ways together, and the lines of the later runs go.

A window that thousands of documents share gives one pair for each later place: never all
pairs. A window that has an earlier copy anywhere has one at its first place.
Lines without words at the ends of a run go only if that first place goes on alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidelog.llm.shared import fresh, written

MIN_WORDS = 50


def line_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A signed 64-bit hash and the number of words of each line; white space at the ends is ignored."""
    lines = [line.split() for line in (text or "").encode().split(b"\n")]
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words)) for words in lines], dtype="<u8").view("<i8")
    return hashes, np.array([len(words) for words in lines], dtype=np.int64)


def winnow(hashes: np.ndarray, words: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(window hash, first line, chosen line) of each window that starts or ends with a line that has words."""
    ends = np.concatenate(([0], np.cumsum(words)))
    stops = np.searchsorted(ends, ends[:-1] + min_words, side="left")
    starts = np.searchsorted(ends, ends[1:] - min_words, side="right") - 1
    on, back = np.flatnonzero((stops <= len(words)) & (words > 0)), np.flatnonzero((starts >= 0) & (words > 0))
    out = []
    for i, j in sorted({*zip(on.tolist(), stops[on].tolist()), *zip(starts[back].tolist(), (back + 1).tolist())}):
        own = hashes[i:j]
        out.append((xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63), i, j - 1 - int(np.argmin(own[::-1]))))
    return out


def extended(mine: np.ndarray, theirs: np.ndarray, places: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """First and last line of the runs that go on alike around ``places`` of ``mine``, beside the lines
    ``shifts`` further on in ``theirs``; covered ones merged. All are halved in at once by sums of
    line hashes times powers, so a text that repeats itself throughout takes n log n steps."""
    base = np.uint64(0x9E3779B97F4A7C15)
    n = max(len(mine), len(theirs)) + 1
    powers = np.ones(n, np.uint64)
    np.multiply.accumulate(np.full(n - 1, base, np.uint64), out=powers[1:])
    sums = lambda h: np.concatenate((np.zeros(1, np.uint64), np.cumsum(h.view(np.uint64) * powers[: len(h)], dtype=np.uint64)))
    own, other = sums(mine), sums(theirs)
    up, down = powers[np.maximum(shifts, 0)], powers[np.maximum(-shifts, 0)]

    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (own[b] - own[a]) * up == (other[b + shifts] - other[a + shifts]) * down

    low, high = places, np.minimum(len(mine), len(theirs) - shifts)
    while (low < high).any():
        half = (low + high + 1) // 2
        fits = alike(places, half)
        low, high = np.where(fits, half, low), np.where(fits, high, half - 1)
    stops, low, high = low, np.maximum(0, -shifts), places
    while (low < high).any():
        half = (low + high) // 2
        fits = alike(half, places)
        low, high = np.where(fits, low, half + 1), np.where(fits, half, high)
    spans = np.unique(np.column_stack((low, stops - 1)), axis=0)
    spans = spans[spans[:, 0] <= spans[:, 1]]
    most = np.maximum.accumulate(spans[:, 1]) if len(spans) else spans[:, 1]
    return spans[np.append(True, spans[1:, 1] > most[:-1])[: len(spans)]]


def runs(pairs: DataFrame) -> DataFrame:
    """Extend each pair of positions of two documents (mine, theirs, places, shifts) both ways: first and last lines."""

    def extend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            first, last = [], []
            for row in frame.itertuples():
                spans = extended(*(np.asarray(x, np.int64) for x in (row.mine, row.theirs, row.places, row.shifts)))
                first.append(spans[:, 0].tolist())
                last.append(spans[:, 1].tolist())
            yield pd.DataFrame({"id": frame["id"], "hash": frame["hash"], "first": first, "last": last})

    return pairs.mapInPandas(extend, "id string, hash long, first array<long>, last array<long>")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """id (doc_id as text, null for null), hash (of the text), first and last: the lines that repeat earlier ones.

    Earlier means a smaller doc_id (null is smallest), or the same document and an earlier
    line. Rows with the same id and text count as one document.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text in frame["text"]:
                hashes, words = line_hashes(text)
                found = winnow(hashes, words, min_words)
                out.append((hashes.tolist(), [w for w, _, _ in found], [i for _, i, _ in found], [p for _, _, p in found]))
            cols = pd.DataFrame(out, columns=["lines", "windows", "starts", "places"])
            yield pd.concat([frame[["id", "hash"]].reset_index(drop=True), cols], axis=1)

    keyed = docs.select(F.col("doc_id").cast("string").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    seen = keyed.mapInPandas(read, "id string, hash long, lines array<long>, windows array<long>, starts array<int>, places array<int>")
    seen = written(seen, "line-windows")
    at = seen.select("id", "hash", F.explode(F.arrays_zip("windows", "starts", "places")).alias("w"))
    at = at.select(F.col("w.windows").alias("window"), F.struct(F.col("id").cast("long").alias("n"), "hash", F.col("w.starts").alias("start"), F.col("w.places").alias("place")).alias("at"))
    first = at.groupBy("window").agg(F.min("at").alias("src"), F.max("at").alias("max")).where("src != max").drop("max")
    pairs = at.join(first, "window").where("at != src")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    pairs = pairs.select(F.col("at.n").cast("string").alias("id"), "at.hash", F.col("src.n").cast("string").alias("src_id"), F.col("src.hash").alias("src_hash"), (F.col("src.place") - F.col("at.place")).alias("shift"), "at.place")
    pairs = pairs.where(~(same("id", "src_id") & (F.col("hash") == F.col("src_hash")) & (F.col("shift") >= 0)))
    meetings = pairs.groupBy("id", "hash", "src_id", "src_hash").agg(F.collect_set(F.struct("place", "shift")).alias("at"))
    lines = seen.where(F.size("windows") > 0).select("id", "hash", "lines").groupBy("id", "hash").agg(F.first("lines").alias("lines"))
    mine = lines.select(F.coalesce("id", F.lit("")).alias("k"), F.col("hash").alias("h"), F.col("lines").alias("mine"))
    theirs = lines.select(F.coalesce("id", F.lit("")).alias("k2"), F.col("hash").alias("h2"), F.col("lines").alias("theirs"))
    joined = meetings.join(mine, (F.coalesce("id", F.lit("")) == F.col("k")) & (F.col("hash") == F.col("h")))
    joined = joined.join(theirs, (F.coalesce("src_id", F.lit("")) == F.col("k2")) & (F.col("src_hash") == F.col("h2")))
    joined = joined.select("id", "hash", "mine", "theirs", F.col("at.place").alias("places"), F.col("at.shift").alias("shifts"))
    found = runs(joined).select("id", "hash", F.explode(F.arrays_zip("first", "last")).alias("r"))
    return found.groupBy("id", "hash").agg(F.collect_set("r").alias("runs")).select("id", "hash", F.sort_array("runs").alias("runs"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of ``docs``; ``text`` without the lines of later repeated runs, and
    ``removed_lines`` (array of first, last). A text that is a copy as a whole becomes empty.

    A null text stays null. Empty tables stay empty. The first place of a run, by doc_id and
    line, stays. Runs shorter than ``min_words`` words stay. Repeated rows come out alike, as often
    as they came in; columns of ``docs`` named ``removed_lines`` are replaced, others kept.
    """
    docs = docs.drop("removed_lines")
    own_id, own_hash, other_id, other_hash, runs_ = fresh(docs, "own_id", "own_hash", "other_id", "other_hash", "line_runs")
    text = F.col("text").cast("string")
    found = repeated_runs(docs, min_words).select(F.coalesce("id", F.lit("")).alias(other_id), F.col("hash").alias(other_hash), F.col("runs").alias(runs_))
    keyed = docs.withColumn(own_id, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn(own_hash, F.xxhash64(F.coalesce(text, F.lit(""))))
    out = keyed.join(found, (F.col(own_id) == F.col(other_id)) & (F.col(own_hash) == F.col(other_hash)), "left")
    gone = lambda i: F.exists(F.col(runs_), lambda r: (r["first"] <= i) & (r["last"] >= i))
    left = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~gone(i)), "\n")
    spans = F.coalesce(F.col(runs_), F.array().cast("array<struct<first:bigint,last:bigint>>"))
    return out.select(*[F.when(F.col(runs_).isNotNull(), left).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns], spans.alias("removed_lines"))
