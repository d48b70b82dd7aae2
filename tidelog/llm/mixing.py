"""Mixing sources to target weights by a time-varying curriculum.

Training time runs from 0 to 1. Each source has a weight schedule, linear between evenly spaced
knots. The schedule's integral is the source's weight, by which sources share the words of the
mix; the part of the integral up to a time, scaled to the source's target, is its cumulative
demand. A source's documents stand in one fixed order and are taken in passes over it. The word at
which a piece's middle lies, put into the inverse of the demand, gives the piece's position in
time, and all pieces are sorted by range of position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.llm.ranges import running_total
from tidelog.llm.shared import written

#: Weights at evenly spaced knots, for the sources in turn; their integrals are 3, 1 and 2.
SCHEDULES = ((4.0, 2.0), (1.0, 1.0), (1.0, 3.0))
#: Words of the mix as a share of all, and how often a source's words may be taken.
SHARE = 1.5
PASSES = 2
#: Equal rows that one row stands for are dealt out so many at a time.
COPIES = 1024

_WORD = r"[^\x20\x09-\x0D]+"


def integrals(knots: Sequence[float]) -> list[float]:
    """The schedule's integral up to each knot."""
    out, step = [0.0], 1.0 / (len(knots) - 1)
    for a, b in zip(knots, knots[1:]):
        out.append(out[-1] + step * (a + b) / 2)
    return out


def time_of(share: Column, knots: Column, sums: Column) -> Column:
    """The time by which ``share`` (0 to 1) of a schedule's integral has passed.

    ``sums`` are the integrals at its knots. Within a segment the integral is a quadratic, whose
    root is taken in the form that stays exact for flat segments."""
    segments = F.size(knots) - 1
    wanted = share * F.element_at(sums, -1)
    k = F.least(F.greatest(F.size(F.filter(sums, lambda s: s <= wanted)), F.lit(1)), segments)  # counted from 1
    low, high = F.element_at(knots, k), F.element_at(knots, k + 1)
    rest = (wanted - F.element_at(sums, k)) * segments
    root = F.sqrt(F.greatest(low * low + 2 * (high - low) * rest, F.lit(0.0)))
    inside = F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (low + root))
    return (k - 1 + inside) / segments


def targets(sources: DataFrame, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """Adds ``target`` to sources (source_size, weight): ``share`` of all words by weight, at most
    ``passes`` times the source's own; what is above is shared anew among the others.

    The level (words per weight) only rises from round to round, so a source is full where the last
    level passed its bound; a round is one aggregation, and only its sums reach the driver."""
    bound = F.col("source_size").cast("double") * passes
    weight = F.col("weight")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double")).collect()[0][0] * share
    left, open_weight, full = total, None, -1
    level = F.lit(False)
    while True:
        got = sources.agg(
            F.coalesce(F.sum(F.when(level, bound)), F.lit(0.0)), F.coalesce(F.sum(F.when(~level, weight)), F.lit(0.0)), F.count(F.when(level, 1))
        ).collect()[0]
        left, open_weight = total - got[0], got[1]
        if got[2] == full or not open_weight:
            break
        full = got[2]
        level = F.lit(left) * weight > bound * F.lit(open_weight)
    shared = F.lit(left) * weight / F.lit(open_weight or 1.0)
    return sources.withColumn("target", F.when(level, bound).otherwise(F.least(shared, bound)))


def plan(docs: DataFrame, schedules: Sequence[Sequence[float]] = SCHEDULES, share: float = SHARE, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix of ``docs`` (doc_id, text, source; other columns are left out).

    Documents: source, doc_id, key (a digest of id and text), copy (from 0, tells equal rows
    apart), size in words, source_size, target. Pieces, for each pass in which a document is taken:
    the same row's keys with epoch (from 0), length (words from its start), position (0 to 1) and
    place (words of the mix before it). A source's last piece is cut so that its target is met to
    the word. Sources stand by code point, a null one last, and take the schedules in turn.

    Null and empty texts have no words and give no pieces; a null source is a source of its own, and
    an empty one another. Equal rows count one by one. An empty table gives no rows. The order
    within a source is that of the digests, so reruns agree however the rows are stored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text))
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("size"), digest.alias("key"))
    # equal rows become one with their number, so none of them is a hot key
    rows = written(sized.groupBy("source", "doc_id", "size", "key").agg(F.count("*").alias("n")).withColumn("words", F.col("n") * F.col("size")), "mix-rows")
    by_source = rows.groupBy("source").agg(F.sum("words").alias("source_size")).withColumn("one", F.lit(1))
    sources = running_total(by_source, [F.col("source").asc_nulls_last()], "one", "source_number").drop("one")
    turn = (F.col("source_number") % len(schedules)).cast("int") + 1
    listed = lambda lists: F.element_at(F.array(*[F.array(*map(F.lit, map(float, x))) for x in lists]), turn)
    sources = sources.withColumns({"knots": listed(schedules), "sums": listed([integrals(x) for x in schedules])}).withColumn("weight", F.element_at("sums", -1))
    sources = written(targets(sources, share, passes), "mix-sources").withColumnRenamed("source", "_source")

    ordered = running_total(rows, [F.col("source").asc_nulls_last(), "key", "doc_id"], "words", "before")
    first = written(ordered, "mix-ordered")
    starts = first.groupBy("source").agg(F.min("before").alias("source_start")).withColumnRenamed("source", "_of")
    placed = first.join(sources.join(starts, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("before", F.col("before") - F.col("source_start"))
    # copies are dealt out in two steps, so that very many never stand in one array
    deals = placed.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    copy = F.explode(F.sequence(F.col("deal") * COPIES, F.least((F.col("deal") + 1) * COPIES, F.col("n")) - 1))
    documents = deals.withColumn("copy", copy).withColumn("before", F.col("before") + F.col("copy") * F.col("size")).drop("deal", "n", "words", "source_start")

    start = F.col("before") + F.col("epoch") * F.col("source_size")
    pieces = documents.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("start", start)
    pieces = pieces.withColumn("length", F.least(F.col("size"), F.floor("target") - F.col("start"))).where("length > 0")
    middle = (F.col("start") + F.col("length") / 2.0) / F.col("target")
    pieces = pieces.withColumn("position", time_of(F.least(middle, F.lit(1.0)), F.col("knots"), F.col("sums")))
    keys = ["source", "doc_id", "key", "copy", "size", "source_number", "start", "epoch", "length", "position"]
    pieces = running_total(written(pieces.select(keys), "mix-pieces"), ["position", "source_number", "start"], "length", "place")
    return documents.select("source", "doc_id", "key", "copy", "size", "source_size", "target"), pieces.drop("source_number", "start")


def mixed(docs: DataFrame) -> DataFrame:
    """Per document of :func:`plan`: doc_id, size, source_size, target, taken (words in all its pieces),
    pieces, and first_place (null where nothing is taken)."""
    documents, pieces = plan(docs)
    keys = ["source", "doc_id", "key", "copy", "size"]
    whole = documents.select(*keys, "source_size", "target", *[F.lit(None).cast("long").alias(c) for c in ("length", "place")])
    taken = pieces.select(*keys, F.lit(None).cast("long").alias("source_size"), F.lit(None).cast("double").alias("target"), "length", "place")
    out = whole.unionByName(taken).groupBy(*keys).agg(
        F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("taken"),
        F.count("length").alias("pieces"), F.min("place").alias("first_place"),
    )
    return out.select("doc_id", "size", "source_size", "target", "taken", "pieces", "first_place")
