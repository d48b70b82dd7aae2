"""SimHash near-duplicates, with candidates from pigeonring filtering.

Fingerprints of 64 bits are cut into a ring of five segments. If two differ in at
most two bits, some chain of consecutive segments keeps the budget l * 2 / 5 for each
of its prefixes of l segments: none differing in the first two, at most one in the
first four, at most two in all. So the two leading segments of a chain are equal: they
are the join key (five keys a fingerprint), the further prefixes prune the pairs, and the
full distance comes last. Equal fingerprints meet before as one class.

Keys that many fingerprints share are not joined pairwise. There, all one-bit changes
of the other segments are written out: two members are at most two bits apart exactly
when they meet in such a string, so their links are found in a number of rows in
proportion to the members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidelog.llm.components import components
from tidelog.llm.shared import fresh, words_of, written

SEED = 42
SHINGLE = 3
DISTANCE = 2
#: First bit (from the lowest) of each of the five segments, and the end.
CUTS = (0, 13, 26, 39, 52, 64)
#: Members of a key up to which pairs are formed; above, one-bit changes are used.
PAIR_LIMIT = 40


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of the word shingles, repeats included; 0 without words."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def simhash_of(texts: pd.Series) -> pd.Series:
    """The fingerprint of each text as a signed number."""
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype="<u8").view("<i8"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the signed 64-bit fingerprint ``fp`` of every row."""
    return docs.select("doc_id", simhash_of(F.col("text").cast("string")).alias("fp"))


def _segment(fp: str, i: int) -> Column:
    i %= 5
    return F.shiftrightunsigned(F.col(fp), CUTS[i]).bitwiseAND(F.lit((1 << (CUTS[i + 1] - CUTS[i])) - 1))


def _mask(*segments: int) -> int:
    """The bits of these segments as a signed number."""
    bits = sum(((1 << (CUTS[s % 5 + 1] - CUTS[s % 5])) - 1) << CUTS[s % 5] for s in segments)
    return bits - (1 << 64) if bits >> 63 else bits


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect what lies within two bits.

    Every pair within two bits is linked, directly or through others within two bits;
    no other pair is.
    """
    keys = distinct.select("fp", F.posexplode(F.array(*[
        _segment("fp", i) + _segment("fp", i + 1) * (1 << 13) for i in range(5)
    ])).alias("ring", "key"))
    sizes = keys.groupBy("ring", "key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = written(keys.join(sizes, ["ring", "key"]), "simhash-keys")

    few = keyed.where(F.col("n") <= PAIR_LIMIT).drop("n")
    members = few.groupBy("ring", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = members.select("ring", F.posexplode("fps").alias("i", "a"), "fps")
    pairs = pairs.select("ring", "a", F.explode(F.slice("fps", F.col("i") + 2, F.lit(PAIR_LIMIT))).alias("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    budget = F.lit(False)
    for i in range(5):
        within = (F.bit_count(diff.bitwiseAND(F.lit(_mask(i, i + 1, i + 2)))) <= 1) & (F.bit_count(diff.bitwiseAND(F.lit(_mask(i, i + 1, i + 2, i + 3)))) <= 1)
        budget = budget | ((F.col("ring") == i) & within)
    near = pairs.where(budget).where(F.bit_count(diff) <= DISTANCE).select("a", "b")

    many = keyed.where(F.col("n") > PAIR_LIMIT)
    free = F.lit(None)
    for i in reversed(range(5)):
        bits = [b for s in (i + 2, i + 3, i + 4) for b in range(CUTS[s % 5], CUTS[s % 5 + 1])]
        flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - ((1 << 64) if b == 63 else 0)) for b in bits])
        free = F.when(F.col("ring") == i, flips).otherwise(free if i < 4 else flips)
    changed = many.select("fp", "ring", F.explode(free).alias("flip")).select("fp", "ring", F.col("fp").bitwiseXOR(F.col("flip")).alias("meet"))
    met = changed.groupBy("ring", "meet").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    met = met.select("a", F.explode("fps").alias("b")).where("a != b")
    return near.union(met).distinct()


def _with_least(prints: DataFrame) -> DataFrame:
    """fp and least: the smallest ``key`` of all rows whose fingerprints are linked to fp's."""
    classes = prints.groupBy("fp").agg(F.min("key").alias("first"))
    roots = components(written(links(classes.select("fp")), "simhash-links"))
    classes = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("first").alias("least"))
    return classes.join(least, "root").select("fp", "least")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id.

    ``component_id`` is the smallest doc_id that can be reached by links of at most
    two bits. Null and empty texts have fingerprint zero and link like any other. A null doc_id
    is kept and is never the smallest unless its whole component is null. Repeated rows
    come out as often as they came in; an empty table gives an empty table. Other columns of
    ``docs`` are left out.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    prints = written(fingerprints(docs), "simhash-prints")
    out = prints.join(_with_least(prints.withColumn("key", key)), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest doc_id (null last, then by a
    hash of the text). All columns are kept; an empty table gives an empty table."""
    own_hash, kept_id, kept_hash = fresh(docs, "own_hash", "kept_id", "kept_hash")
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    prints = docs.select("doc_id", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", text_hash.alias("hash")).alias("key"), simhash_of(F.col("text").cast("string")).alias("fp"))
    least = _with_least(written(prints.select("key", "fp"), "simhash-prints"))
    kept = least.select(F.col("least.doc_id").alias(kept_id), F.col("least.hash").alias(kept_hash)).distinct()
    hashed = docs.withColumn(own_hash, text_hash)
    found = hashed.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(own_hash) == F.col(kept_hash)), "left_semi")
    return found.dropDuplicates(["doc_id", own_hash]).drop(own_hash)
