"""Approximate nearest neighbours by inner product, with anisotropic 4-bit quantisation.

Vectors are dealt to lists by k-means and their residuals are cut into parts of two
dimensions with 16 code words each. Codes minimise an error in which the part along the
vector weighs ``ETA`` times as much, since it moves large inner products most. Two codes share a
byte; a query scans the codes of its nearest lists by tables of 256 sums and reranks with exact
products the best, and whatever the error of its codes could still bring among them.

Equal vectors are indexed once, with their smallest ids. Centroids and code words come from a
bounded sample; every row is indexed. A list is cut into blocks, neighbouring lists' blocks form
shards, and queries come in chunks: a task scans a chunk over the blocks of one shard that its
queries visit, and tells each query's best k there, once for all lists of the shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidelog.llm.shared import written

#: Vectors from which centroids and code words are fitted: a quarter of the table, within these.
LEAST_SAMPLE, MOST_SAMPLE = 5_000, 40_000
#: Of these, vectors that code words are fitted to.
WORDS_SAMPLE = 8_000
PART = 2
ETA = 4.0
#: Vectors a list has on average; candidates reranked at least in each block of a list.
LIST_ROWS = 1000
RERANKED = 100
#: Queries visit as many lists as hold this share of the sample's true neighbours, and more where those hold too few.
COVERED = 0.97
BLOCK_ROWS = 8192
SHARD_BLOCKS = 64
SHARD_ROWS = 65_536
CHUNK_QUERIES = 512


@dataclass(frozen=True)
class Codebook:
    centroids: np.ndarray  # lists x d
    words: np.ndarray  # parts x 16 x PART

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return np.argmin(((self.centroids**2).sum(1) - 2 * x @ self.centroids.T), axis=1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return assign(x - self.centroids[lists], unit(x), self.words)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def assign(r: np.ndarray, along: np.ndarray, words: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """Codes that lower |error|^2 + (ETA - 1) (error along the vector)^2, part by part."""
    n, parts = len(r), len(words)
    r, along = r.reshape(n, parts, PART), along.reshape(n, parts, PART)
    error = ((r[:, :, None, :] - words[None]) ** 2).sum(-1)
    slip = ((r[:, :, None, :] - words[None]) * along[:, :, None, :]).sum(-1)
    codes = error.argmin(-1)
    rows = np.arange(n)
    total = np.take_along_axis(slip, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(sweeps):
        for m in range(parts):
            rest = total - slip[rows, m, codes[:, m]]
            codes[:, m] = (error[:, m] + (ETA - 1) * (rest[:, None] + slip[:, m]) ** 2).argmin(1)
            total = rest + slip[rows, m, codes[:, m]]
    return codes.astype(np.uint8)


def fit(x: np.ndarray, lists: int, rounds: int = 5, seed: int = 7) -> Codebook:
    """k-means centroids, then code words by turns of assignment and weighted least squares."""
    rng = np.random.default_rng(seed)
    pad = (-x.shape[1]) % PART
    x = np.pad(x, ((0, 0), (0, pad))).astype(np.float64)
    centroids = x[rng.permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        near = np.argmin((centroids**2).sum(1) - 2 * x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centroids))
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    x = x[rng.permutation(len(x))[:WORDS_SAMPLE]]
    r, along = x - centroids[np.argmin((centroids**2).sum(1) - 2 * x @ centroids.T, axis=1)], unit(x)
    parts = x.shape[1] // PART
    rs, us = r.reshape(len(x), parts, PART), along.reshape(len(x), parts, PART)
    words = np.stack([rs[rng.integers(0, len(x), 16), m] for m in range(parts)])
    for _ in range(rounds):
        codes = assign(r, along, words, 1)
        slip = sum(((rs[:, m] - words[m][codes[:, m]]) * us[:, m]).sum(1) for m in range(parts))
        for m in range(parts):
            own = ((rs[:, m] - words[m][codes[:, m]]) * us[:, m]).sum(1)
            rest = slip - own
            for j in range(16):
                of = codes[:, m] == j
                if of.any():
                    u, v = us[of, m], rs[of, m]
                    a = of.sum() * np.eye(PART) + (ETA - 1) * u.T @ u
                    b = v.sum(0) + (ETA - 1) * ((rest[of] + (v * u).sum(1))[:, None] * u).sum(0)
                    words[m, j] = np.linalg.solve(a, b)
            slip = rest + ((rs[:, m] - words[m][codes[:, m]]) * us[:, m]).sum(1)
    return Codebook(centroids, words)


def lists_to_visit(x: np.ndarray, centroids: np.ndarray, k: int, covered: float) -> int:
    """How many of a query's best lists hold the ``covered`` share of its k nearest, in the sample."""
    q = x[:: max(1, len(x) // 200)]
    near = np.argmin((centroids**2).sum(1) - 2 * x @ centroids.T, axis=1)
    true = np.argsort(-(q @ x.T), axis=1)[:, 1 : k + 1]
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(place, near[true], axis=1).reshape(-1))
    return int(ranks[min(len(ranks) - 1, int(covered * len(ranks)))]) + 1 if len(ranks) else len(centroids)


def _valid(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))


def least(ids: np.ndarray, k: int) -> np.ndarray:
    """The smallest ids, of each at most k and 2 k in all: so many that k are left without any one id."""
    ids = np.sort(ids)
    same = np.arange(len(ids)) - np.searchsorted(ids, ids)
    return ids[same < k][: 2 * k]


def distinct_vectors(good: DataFrame, k: int) -> DataFrame:
    """v and ids, a row for each distinct vector. Batches are grouped before they are dealt, so a
    vector that fills a third of the table sends a few ids of each batch."""

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # adding 0.0 makes equal the two zeros
            keys = [(np.asarray(v, np.float64) + 0.0).tobytes() for v in frame["v"]]
            ids = frame["vec_id"].groupby(pd.Series(keys, index=frame.index), sort=False).agg(list)
            yield pd.DataFrame({"v": ids.index, "ids": [least(np.array(x, np.int64), k) for x in ids]})

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"v": frame["v"], "ids": [least(np.asarray(x, np.int64), k) for x in frame["ids"]]})

    parts = good.mapInPandas(gather, "v binary, ids array<long>")
    return parts.groupBy("v").agg(F.flatten(F.collect_list("ids")).alias("ids")).mapInPandas(merge, "v binary, ids array<long>")


RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, covered: float = COVERED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each row of ``queries`` (same columns: vec_id, embedding).

    A query's own row is no candidate. Null, zero and non-finite vectors take no part; vectors of
    different lengths have no inner product, so each length is searched on its own. Ties go to
    the smaller vec_id. A vec_id that occurs twice is two candidates, and one query (of its least vector). An empty
    table gives no rows. Other columns are left out.
    """
    spark = vectors.sparkSession
    good = written(distinct_vectors(_valid(vectors), k), "ann-distinct")
    asked = _valid(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    out = spark.createDataFrame([], RESULT)
    sizes = good.groupBy(F.octet_length("v").alias("bytes")).count().orderBy("bytes").collect()
    for r in sizes:
        d = r["bytes"] // 8
        out = out.union(_search_length(good.where(F.octet_length("v") == 8 * d), asked.where(F.size("v") == d), d, r["count"], k, covered))
    return out


def lists_in_order(centroids: np.ndarray) -> np.ndarray:
    """Lists along the direction in which centroids differ most, so that near ones share shards."""
    centred = centroids - centroids.mean(0)
    return np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")


def _search_length(good: DataFrame, queries: DataFrame, d: int, rows: int, k: int, covered: float) -> DataFrame:
    """:func:`search` among the ``rows`` distinct vectors of one length."""
    spark, first = good.sparkSession, F.col("ids")[0]
    sampled = min(MOST_SAMPLE, max(LEAST_SAMPLE, rows // 4))
    # few more than wanted pass, so that tasks send no more than that
    passes = min(1.0, (sampled + 6 * sampled**0.5) / max(rows, 1))
    near = good.where(F.pmod(F.xxhash64(first), F.lit(1 << 30)) < F.lit(int(passes * (1 << 30))))
    x = np.array([np.frombuffer(r["v"]) for r in near.orderBy(F.xxhash64(first), first, "v").select("v").limit(sampled).collect()])
    book = fit(x, max(1, min(len(x) // 20, rows // LIST_ROWS)))
    lists, width = len(book.centroids), book.centroids.shape[1]

    def padded(values) -> np.ndarray:
        out = np.zeros((len(values), width))
        if len(values):
            out[:, :d] = np.stack(values.to_list())
        return out

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = padded(frame["v"].map(np.frombuffer))
            near = book.lists_of(x)
            codes = book.encode(x, near)
            error = x - book.centroids[near] - book.words[np.arange(len(book.words)), codes].reshape(x.shape)
            # the second part is for products in single precision
            slack = np.linalg.norm(error, axis=1) + 1e-5 * (np.linalg.norm(x, axis=1) + np.linalg.norm(book.centroids[near], axis=1))
            yield pd.DataFrame({"v": frame["v"], "ids": frame["ids"], "list": near, "codes": [c.tobytes() for c in two_in_a_byte(codes)], "slack": slack})

    indexed = written(good.mapInPandas(index, "v binary, ids array<long>, list int, codes binary, slack double"), "ann-index")
    probes = lists_to_visit(np.pad(x, ((0, 0), (0, width - d))), book.centroids, k, covered)
    # per list: vectors, and ids that aren't the query's own, at least
    held, others = np.zeros(lists, np.int64), np.zeros(lists, np.int64)
    for r in indexed.groupBy("list").count().collect():
        held[r["list"]] = r["count"]
    for r in indexed.select("list", F.explode("ids").alias("id")).distinct().groupBy("list").count().collect():
        others[r["list"]] = r["count"] - 1
    # blocks of one list follow each other; shards are runs of blocks with so many vectors at most
    cut = np.maximum(1, -(-held // BLOCK_ROWS))
    shard_of: dict[tuple[int, int], int] = {}
    shard = inside = vectors_in = 0
    for one in lists_in_order(book.centroids).tolist():
        for block in range(int(cut[one])):
            size = -(-int(held[one]) // int(cut[one]))
            if inside and (inside >= SHARD_BLOCKS or vectors_in + size > SHARD_ROWS):
                shard, inside, vectors_in = shard + 1, 0, 0
            shard_of[one, block] = shard
            inside, vectors_in = inside + 1, vectors_in + size
    shards_of = [sorted({shard_of[one, b] for b in range(int(cut[one]))}) for one in range(lists)]
    blocks_of = spark.createDataFrame([(i, int(n)) for i, n in enumerate(cut)], "list int, blocks int")

    def bundle(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("v")
        ids = [np.asarray(x, np.int64) for x in frame["ids"]]
        return pd.DataFrame({
            "list": [key[0]], "shard": [shard_of[int(key[0]), int(key[1])]], "v": [b"".join(frame["v"])], "codes": [b"".join(frame["codes"])],
            "slack": [frame["slack"].to_numpy(np.float64).tobytes()], "sizes": [np.array([len(x) for x in ids], np.int64).tobytes()], "ids": [np.concatenate(ids).tobytes()],
        })

    dealt = indexed.join(blocks_of, "list").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).drop("blocks")
    bundled = dealt.groupBy("list", "block").applyInPandas(bundle, "list int, shard int, v binary, codes binary, slack binary, sizes binary, ids binary")
    bundled = written(bundled, "ann-blocks")

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = padded(frame["v"])
            best = np.argsort(-(x @ book.centroids.T), axis=1, kind="stable")
            enough = (np.cumsum(others[best], axis=1) < k).sum(1) + 1
            n = np.clip(enough, min(probes, lists), lists)
            out = []
            for i, (query, own) in enumerate(zip(frame["vec_id"].tolist(), best.tolist())):
                by: dict[int, list[int]] = {}
                for one in own[: n[i]]:
                    for s in shards_of[one]:
                        by.setdefault(s, []).append(one)
                out += [(query, x[i, :d].tobytes(), s, ones) for s, ones in by.items()]
            yield pd.DataFrame(out, columns=["query_id", "q", "shard", "lists"])

    asked = written(queries.mapInPandas(visit, "query_id long, q binary, shard int, lists array<int>"), "ann-queries")
    chunks = asked.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK_QUERIES).cast("int").alias("chunks"))
    asked = asked.join(chunks, "shard").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int")).drop("chunks")

    def gather(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        wanted = np.unique(np.concatenate([np.asarray(x) for x in frame["lists"]]))
        mask = np.zeros((len(frame), len(wanted)), np.uint8)
        for i, own in enumerate(frame["lists"]):
            mask[i, np.searchsorted(wanted, own)] = 1
        return pd.DataFrame({"shard": [key[0]], "chunk": [key[1]], "queries": [frame["query_id"].to_numpy(np.int64).tobytes()], "q": [b"".join(frame["q"])], "lists": [wanted.tolist()], "visits": [mask.tobytes()]})

    chunked = written(asked.groupBy("shard", "chunk").applyInPandas(gather, "shard int, chunk int, queries binary, q binary, lists array<int>, visits binary"), "ann-chunks")
    needs = chunked.select("shard", "chunk", F.explode("lists").alias("list"))
    left = bundled.join(needs, ["shard", "list"])
    right = chunked.select(F.col("shard").alias("s"), F.col("chunk").alias("c"), "queries", "q", "lists", "visits")

    def scan(key: tuple, blocks: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        out = []
        for c in chunk.itertuples():
            best = Best(np.frombuffer(c.queries, np.int64), k)
            q = np.frombuffer(c.q).reshape(len(best.queries), d)
            visits = np.frombuffer(c.visits, np.uint8).reshape(len(q), -1)
            for row in blocks.sort_values("list").itertuples():
                asking = np.flatnonzero(visits[:, int(np.searchsorted(c.lists, row.list))])
                scan_block(best, asking, q[asking], row, book)
            out.append(best.frame())
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = left.groupBy("shard", "chunk").cogroup(right.groupBy("s", "c")).applyInPandas(scan, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def two_in_a_byte(codes: np.ndarray) -> np.ndarray:
    """4-bit codes of two neighbouring parts in each byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] | (codes[:, 1::2] << 4)


class Best:
    """The best k of each query so far: score falling, then id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.found = [(np.zeros(0), np.zeros(0, np.int64))] * len(queries)

    def least(self, i: int) -> float:
        """What a candidate of query ``i`` must reach."""
        return self.found[i][0][-1] if len(self.found[i][0]) >= self.k else -np.inf

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        own = ids != self.queries[i]
        scores, ids = np.concatenate((self.found[i][0], scores[own])), np.concatenate((self.found[i][1], ids[own]))
        order = np.lexsort((ids, -scores))[: self.k]
        self.found[i] = scores[order], ids[order]

    def frame(self) -> pd.DataFrame:
        sizes = [len(s) for s, _ in self.found]
        return pd.DataFrame({"query_id": np.repeat(self.queries, sizes), "vec_id": np.concatenate([i for _, i in self.found]), "score": np.concatenate([s for s, _ in self.found])})


def scan_block(best: Best, asking: np.ndarray, queries: np.ndarray, block, book: Codebook) -> None:
    """Scan one block's codes for the queries that visit its list, rerank, and keep each one's best."""
    k, d, width = best.k, queries.shape[1], book.centroids.shape[1]
    v = np.frombuffer(block.v).reshape(-1, d)
    codes, slack = np.frombuffer(block.codes, np.uint8).reshape(len(v), -1), np.frombuffer(block.slack)
    sizes, ids = np.frombuffer(block.sizes, np.int64), np.frombuffer(block.ids, np.int64)
    ends = np.cumsum(sizes)
    low, high = ids[ends - sizes], ids[ends - 1]
    wide = np.zeros((len(queries), width))
    wide[:, :d] = queries
    lut = np.einsum("qmp,mjp->mqj", wide.reshape(len(queries), -1, PART), book.words).astype(np.float32)
    if len(lut) % 2:
        lut = np.concatenate((lut, np.zeros_like(lut[:1])))
    # a table of 256 sums for each two parts
    pairs = (lut[1::2][:, :, :, None] + lut[::2][:, :, None, :]).reshape(len(lut) // 2, len(queries), 256)
    base = wide @ book.centroids[block.list]
    take = min(len(v), RERANKED + k)
    for a in range(0, len(queries), 256):
        q = queries[a : a + 256]
        own = best.queries[asking[a : a + 256], None]
        rough = np.zeros((len(q), len(v)), np.float32)
        for m in range(len(pairs)):
            rough += pairs[m, a : a + 256][:, codes[:, m]]
        rough = rough + base[a : a + 256, None]
        need = ~((low == own) & (high == own))  # else vectors of the query alone
        reach = rough + np.linalg.norm(q, axis=1)[:, None] * slack
        least = np.array([best.least(i) for i in asking[a : a + 256]])
        need &= reach >= least[:, None]
        if take < len(v):
            top = np.argpartition(-np.where(need, rough, -np.inf), take - 1, axis=1)[:, :take]
            exact = np.where(np.take_along_axis(need, top, 1), np.einsum("qnd,qd->qn", v[top], q), -np.inf)
            # what the error of its code keeps below the k-th can't be among the first k
            need &= reach >= np.partition(exact, take - k, axis=1)[:, take - k, None]
        among = np.flatnonzero(need.any(0))
        exact = np.where(need[:, among], q @ v[among].T, -np.inf)
        for i in range(len(q)):
            lowest = np.partition(exact[i], len(among) - k)[len(among) - k] if len(among) > k else -np.inf
            of = np.flatnonzero((exact[i] >= lowest) & (exact[i] > -np.inf))
            if len(of):
                best.add(asking[a + i], np.repeat(exact[i, of], sizes[among[of]]), np.concatenate([ids[ends[j] - sizes[j] : ends[j]] for j in among[of]]))
