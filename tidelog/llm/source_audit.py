"""Divergence of each source from the other sources and from its language, by a perfect-hash recount.

The first pass counts in how many documents of a language each term occurs; only frequent terms
are kept. Those of a language are dealt to shards of bounded size, and each shard gets a minimal
perfect hash that stores its keys. The second pass sends shards to all tasks, as many at a time as
BROADCAST_BYTES allows, and counts each term at its slot in a dense array for each group of
language and source. What a task has counted is merged group by group and shard by shard in
sorted order, so a merging task holds one array. All comparisons are whole-number arithmetic on
such arrays.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from tidelog.llm.perfect_hash import PerfectHash, hashes
from tidelog.llm.shared import written

#: Documents of a language that a kept term occurs in, at least.
LEAST_DOCUMENTS = 30
#: Terms a shard has on average; bytes of shards that one recount sends to all tasks.
SHARD_TERMS = 1 << 15
BROADCAST_BYTES = 64 << 20
#: Distinct terms, and bytes of dense arrays, that a task holds before it tells what it has.
HELD_TERMS = 400_000
HELD_BYTES = 64 << 20
#: Sources of a language that are compared with each other in one task.
BLOCK_SOURCES = 32
TERM_RANKS = 50
SCALE, SMOOTHING = 1_000_000_000, 5

#: Letters A-Z and a-z become small letters, bytes of other characters stay, all else parts terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(data: bytes) -> list[bytes]:
    return data.translate(TERM_BYTES).split()


def _packed(counts: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes | None, n: int) -> np.ndarray:
    if data is None:
        return np.zeros(n, np.int64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def share(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE (count + 5) / (total + 5 terms)), exact: divided in two steps, so that nothing overflows."""
    by = total + SMOOTHING * terms
    high, rest = np.divmod((counts + SMOOTHING) * 100_000, by)
    return 1 + high * (SCALE // 100_000) + rest * (SCALE // 100_000) // by


def read(docs: DataFrame) -> DataFrame:
    """lang, source and text (as bytes); null ones count as empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))


def kept_terms(rows: DataFrame, least: int) -> DataFrame:
    """lang and term of those in at least ``least`` documents of the language (rows of :func:`read`)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def told() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], names=["lang", "term", "n"])
            held.clear()

        for batch in batches:
            for lang, data in zip(batch.column("lang").to_pylist(), batch.column("text")):
                held[lang].update(set(terms_of(data.as_py())))
                if sum(map(len, held.values())) > HELD_TERMS:
                    yield from told()
        yield from told()

    found = rows.select("lang", "text").mapInArrow(count, "lang string, term binary, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", F.col("term").cast("string").alias("term"))


def shards_of(kept: DataFrame, shard_terms: int) -> DataFrame:
    """lang, shard, n, levels and keys of a perfect hash for each shard of each language's terms, and
    the language's numbers of terms and shards."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        made = PerfectHash.build([t.encode() for t in sorted(frame["term"])])
        first = frame.iloc[0]
        return pd.DataFrame({"lang": [first["lang"]], "shard": [first["shard"]], "n": [len(frame)], "terms": [first["terms"]], "shards": [first["shards"]], "levels": [made.levels], "keys": [b"\n".join(made.keys)]})

    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms")).withColumn("shards", F.ceil(F.col("terms") / shard_terms))
    dealt = kept.join(sizes, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), "shards"))
    return dealt.groupBy("lang", "shard").applyInPandas(build, "lang string, shard long, n long, terms long, shards long, levels array<binary>, keys binary")


def recounted(rows: DataFrame, shards: DataFrame, most_bytes: int) -> DataFrame:
    """lang, source, shard, counts and total of what is counted in ``rows``: several rows of a group and
    shard where several tasks met it."""
    spark = rows.sparkSession
    sizes = shards.select("lang", "shard", (F.octet_length("keys") + F.aggregate("levels", F.lit(0), lambda a, x: a + F.octet_length(x))).alias("bytes")).orderBy("lang", "shard").collect()
    passes: list[list] = []
    room = 0
    for r in sizes:
        if not passes or r["bytes"] > room:
            passes.append([])
            room = most_bytes
        passes[-1].append((r["lang"], r["shard"]))
        room -= r["bytes"]
    schema = "lang string, source string, shard long, counts binary, total long"
    out = spark.createDataFrame([], schema)
    for wanted in passes:
        named = spark.createDataFrame(wanted, "lang string, shard long")
        sent = spark.sparkContext.broadcast([tuple(r) for r in shards.join(F.broadcast(named), ["lang", "shard"]).select("lang", "shard", "n", "shards", "levels", "keys").collect()])
        out = out.union(rows.mapInArrow(_counter(sent), schema))
    return out


def _counter(sent):
    """Counts the terms of batches at the slots of the shards that were sent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, tuple[int, dict[int, PerfectHash]]] = {}
        for lang, shard, _, number, levels, keys in sent.value:
            tables.setdefault(lang, (number, {}))[1][shard] = PerfectHash(list(map(bytes, levels)), bytes(keys).split(b"\n"))
        held: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        dense: dict[tuple[str, str, int], np.ndarray] = {}

        def recount() -> None:
            """Moves what is held to the dense arrays; each distinct term of a language is looked up once."""
            for lang, groups in held.items():
                number, own = tables[lang]
                words = list(set().union(*groups.values()))
                h = hashes(words)
                dealt = h.view(np.int64) % number
                slot, of = np.full(len(words), -1), {w: i for i, w in enumerate(words)}
                for shard, table in own.items():
                    at = np.flatnonzero(dealt == shard)
                    slot[at] = table.slots([words[i] for i in at.tolist()], h[at])
                for source, counter in groups.items():
                    at = np.fromiter(map(of.__getitem__, counter), np.int64, len(counter))
                    n = np.fromiter(counter.values(), np.int64, len(counter))
                    good = slot[at] >= 0
                    at, n = at[good], n[good]
                    for shard, table in own.items():
                        here = dealt[at] == shard
                        if here.any():
                            counts = dense.setdefault((lang, source, shard), np.zeros(len(table.keys), np.int64))
                            counts[slot[at[here]]] += n[here]
            held.clear()

        def told() -> Iterator[pa.RecordBatch]:
            keys = list(dense)
            if keys:
                columns = [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([k[2] for k in keys], pa.int64()), pa.array([_packed(dense[k]) for k in keys], pa.binary()), pa.array([int(dense[k].sum()) for k in keys], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "shard", "counts", "total"])
            dense.clear()

        size = 0
        for batch in batches:
            for lang, source, data in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                if lang not in tables:
                    continue
                counter = held[lang][source]
                size -= len(counter)
                counter.update(terms_of(data.as_py()))
                size += len(counter)
                if size > HELD_TERMS:
                    recount()
                    size = 0
                    if sum(x.nbytes for x in dense.values()) > HELD_BYTES:
                        yield from told()
        recount()
        yield from told()

    return count


def merged(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each of ``keys`` and shard, with the sums of counts and of total. Rows come in order
    of their keys, so a task holds one array however many rows a key has."""
    own = [*keys, "shard"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts, total = None, None, 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([v]) for v in at], pa.array([_packed(counts)], pa.binary()), pa.array([total], pa.int64())], names=[*own, "counts", "total"])

        for batch in batches:
            for key, data, n in zip(zip(*[batch.column(c).to_pylist() for c in own]), batch.column("counts"), batch.column("total").to_pylist()):
                found = _unpacked(data.as_py(), 0)
                if key == at:
                    counts, total = counts + found, total + n
                    continue
                if at is not None:
                    yield told()
                at, counts, total = key, found, n
        if at is not None:
            yield told()

    dealt = rows.select(*own, "counts", "total").repartition(*own).sortWithinPartitions(*own)
    return dealt.mapInArrow(add, ", ".join(f"{k} string" for k in keys) + ", shard long, counts binary, total long")


def _pair_sums(vectors: DataFrame) -> DataFrame:
    """lang, source, item (another source) and value, the sum over a shard's terms, for every pair."""

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("source")
        names, blocks, first = frame["source"].tolist(), frame["block"].to_numpy(), frame.iloc[0]
        shares = np.array([share(_unpacked(r.counts, r.n), r.total, r.terms) for r in frame.itertuples()])
        out = []
        for i in range(len(names)):
            sums = np.abs(shares - shares[i]).sum(1).tolist()
            # within one block all pairs, else those between the two
            out += [(first["lang"], names[i], names[j], sums[j]) for j in range(len(names)) if i != j and (first["low"] == first["high"] or blocks[i] != blocks[j])]
        return pd.DataFrame(out, columns=["lang", "source", "item", "value"])

    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    met = vectors.withColumn("other", F.explode(every)).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
    return met.groupBy("lang", "shard", "low", "high").applyInPandas(compare, "lang string, source string, item string, value long")


def _best_terms(vectors: DataFrame, ranks: int) -> DataFrame:
    """lang, source, item (a term) and value: the ``ranks`` greatest of each shard where the source has more than its language."""

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                counts = _unpacked(r.counts, r.n)
                more = share(counts, r.total, r.terms) - share(_unpacked(r.all_counts, r.n), r.all_total, r.terms)
                at = np.flatnonzero((counts > 0) & (more > 0))
                if len(at) > ranks:  # ties with the last stay until names are compared
                    at = at[more[at] >= np.partition(more[at], -ranks)[-ranks]]
                keys = r.keys.split(b"\n")
                found = sorted((-int(more[i]), keys[i]) for i in at.tolist())[:ranks]
                out += [(r.lang, r.source, k.decode(), -v) for v, k in found]
            yield pd.DataFrame(out, columns=["lang", "source", "item", "value"])

    return vectors.mapInPandas(best, "lang string, source string, item string, value long")


RESULT = ["lang", "source", "part", "item", "value", "rank"]


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS, shard_terms: int = SHARD_TERMS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """lang, source, part, item, value and rank (from 1) for each group of lang and source.

    Part ``pair``: each other source of the language, by the sum of differences of their shares over
    the language's kept terms. Part ``term``: the ``ranks`` kept terms of which the group has most
    above its language. Null lang, source and text count as empty; every row is a document,
    repeated ones too. A group without terms takes part; a language without kept terms gives pairs
    of value 0; one with a single source gives no pairs. Ties go by UTF-8 order. An empty table
    gives no rows. Other columns are left out.
    """
    rows = read(docs)
    kept = written(kept_terms(rows, least), "audit-kept")
    shards = written(shards_of(kept, shard_terms), "audit-shards")
    counts = written(merged(recounted(rows, shards, broadcast_bytes), "lang", "source"), "audit-counts")
    whole = written(merged(counts, "lang"), "audit-langs")

    totals = lambda frame, *keys: frame.groupBy(*keys).agg(F.sum("total").alias("total"))
    langs = shards.groupBy("lang").agg(F.max("terms").alias("terms"), F.max("shards").alias("shards")).join(totals(whole, "lang").withColumnRenamed("total", "all_total"), "lang", "left")
    groups = rows.select("lang", "source").distinct().join(langs, "lang", "left").join(totals(counts, "lang", "source"), ["lang", "source"], "left")
    of_lang = Window.partitionBy("lang")
    groups = written(
        groups.fillna(0, ["terms", "shards", "total", "all_total"])
        .withColumn("block", F.floor((F.row_number().over(of_lang.orderBy("source")) - 1) / BLOCK_SOURCES))
        .withColumn("blocks", F.floor((F.count("*").over(of_lang) - 1) / BLOCK_SOURCES) + 1), "audit-groups",
    )
    each = groups.where("terms > 0").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    vectors = each.join(shards.select("lang", "shard", "n"), ["lang", "shard"]).join(counts.drop("total"), ["lang", "source", "shard"], "left")

    none = groups.where("terms = 0").select("lang", "source")
    nothing = none.join(none.withColumnRenamed("source", "item"), "lang").where("source != item").withColumn("value", F.lit(0).cast("long"))
    pairs = _pair_sums(vectors).unionByName(nothing).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    met = vectors.where("counts is not null").join(whole.select("lang", "shard", F.col("counts").alias("all_counts")), ["lang", "shard"]).join(shards.select("lang", "shard", "keys"), ["lang", "shard"])
    best = _best_terms(met, ranks).withColumn("part", F.lit("term"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = pairs.unionByName(best).withColumn("rank", F.row_number().over(order))
    return out.where((F.col("part") == "pair") | (F.col("rank") <= ranks)).select(RESULT)
