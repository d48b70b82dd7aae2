"""Log-likelihood of whole documents under a gated recurrent language model.

Word counts of all training documents give the vocabulary: the most frequent words stand for
themselves, in classes of equal size by rank; the others fall in classes by their ending, and
within those a word's probability comes from its count. The softmax is factored: first the
class, then the word in its class. More words stand for themselves the more there are to count.

The network learns from every training document as a whole, where its block is: in each of
``ROUNDS`` rounds a task runs truncated backpropagation in numpy over its own texts from the
same weights, and a tree of sums averages the tasks' weights by their tokens. It then reads
each document from its first word to the end, in windows between which the state is carried on.

Counts reach the documents through blocks: each distinct word of a block is joined once.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidelog.llm import blocks
from tidelog.llm.shared import id_crc, id_crc_py, written, written_by_key

#: Stands for the end of a text; no word holds a line feed.
END = "\n"
#: Words that stand for themselves up to COUNTED_TOKENS training tokens; then their number follows the cube root.
FREQUENT, CLASS_WORDS, ENDINGS = 1024, 32, 64
COUNTED_TOKENS = 16_000_000
HIDDEN = 24
WINDOW = 32
#: Rounds between which weights are averaged. Each block has its round, by its number, so that every
#: training text is read once, however many there are.
ROUNDS = 3
RATE = 0.02
#: Texts a task reads side by side; weights summed by a task of the tree.
LANES = 128
FAN = 8
SCORED_TOGETHER = 512
#: Rows of class logits worked on at a time, so that they stay in a core's cache; logits to which exp needs no shift.
TOGETHER = 512
PLAIN_EXP = 60

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def numbered_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (A-Z lower-cased), the number of each word of all texts, each with an END, and where each text's end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    words, numbers = coded.dictionary, coded.indices.to_numpy()
    edges = lists.offsets.to_numpy().astype(np.int64)
    edges -= edges[0]
    there = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[numbers] if len(words) else np.zeros(0, bool)
    sizes = np.add.reduceat(np.append(there, False).astype(np.int64), edges[:-1]) * (np.diff(edges) > 0) if len(texts) else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return pa.concat_arrays([words, pa.array([END], words.type)]), np.insert(numbers[there].astype(np.int64), ends, len(words)), ends + np.arange(1, len(ends) + 1)


def ending(word: str) -> int:
    """The class of a word that isn't frequent: a hash of its last letters and what follows them."""
    return int(endings(pa.array([word], pa.large_string()))[0])


def endings(words: pa.Array) -> np.ndarray:
    """The same of each word; few tails are distinct, so those alone are hashed."""
    core = pc.utf8_rtrim(words, characters=".,;:!?\"')")
    followed = pc.less(pc.binary_length(core), pc.binary_length(words)).to_numpy(zero_copy_only=False).astype(np.int64)
    tails = pc.utf8_slice_codeunits(core, -3).dictionary_encode()
    hashed = np.array([[zlib.crc32((t + end).encode()) % ENDINGS for end in ("", ".")] for t in tails.dictionary.to_pylist()], np.int64).reshape(-1, 2)
    return hashed[tails.indices.to_numpy(), followed]


@dataclass(frozen=True)
class Vocabulary:
    """ids below ``frequent`` are the words at these places of ``ids``, those above are classes of endings."""

    frequent: int
    ids: list[str]
    total: int
    distinct: int
    rare_tokens: np.ndarray
    rare_words: np.ndarray

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The id of each word."""
        found = pc.fill_null(pc.index_in(words, value_set=pa.array(self.ids, words.type)), -1).to_numpy(zero_copy_only=False)
        return np.where(found < 0, self.frequent + endings(words), found).astype(np.int32)


def vocabulary_size(tokens: int) -> int:
    """How many words stand for themselves: whole classes, in proportion to the cube root of the tokens."""
    grown = FREQUENT * (tokens / COUNTED_TOKENS) ** (1 / 3)
    return max(FREQUENT, CLASS_WORDS * round(grown / CLASS_WORDS))


def shifted(logits: np.ndarray, largest: float) -> None:
    """Less each row's largest where ``largest``, a bound of the logits, allows no plain exp."""
    if not largest <= PLAIN_EXP:
        logits -= logits.max(1, keepdims=True)


def exp_sums(logits: np.ndarray) -> np.ndarray:
    """The sum of each row's exp, which stays in ``logits``."""
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], logits.dtype)


def picked_log(logits: np.ndarray, at: np.ndarray, largest: float) -> np.ndarray:
    """The log of the softmax at one place of each row. Overwrites ``logits``."""
    shifted(logits, largest)
    out = logits[np.arange(len(at)), at].astype(np.float64)
    return out - np.log(exp_sums(logits))


def errors(logits: np.ndarray, at: np.ndarray, n: int, largest: float) -> np.ndarray:
    """Makes ``logits`` multiples of the softmax less 1 at the right place; gives what each row, times that, is this divided by ``n``."""
    shifted(logits, largest)
    sums = exp_sums(logits)
    logits[np.arange(len(at)), at] -= sums
    return 1 / (n * sums)[:, None]


def dealt(docs: list[np.ndarray], lanes: int) -> list[list[int]]:
    """Numbers of the documents of each lane, longest first; the lane with most words is first."""
    own, loads = [[] for _ in range(lanes)], [(0, i) for i in range(lanes)]
    for k in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        size, lane = heapq.heappop(loads)
        own[lane].append(k)
        heapq.heappush(loads, (size + len(docs[k]), lane))
    return [own[lane] for _, lane in sorted(loads, reverse=True)]


class Network:
    """Inputs are rows of a table (the last one starts a text); outputs are class and word logits.

    Windows are worked on in place, in memory kept from one to the next: fresh pages cost as much as
    what is computed in them. Units of a gate lie together, as do words of a class."""

    def __init__(self, seed: int = 5, frequent: int = FREQUENT):
        rng = np.random.default_rng(seed)
        scale = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        h = HIDDEN
        self.frequent, self.groups, self.start = frequent, frequent // CLASS_WORDS, frequent + ENDINGS
        classes = self.groups + ENDINGS
        self.p = {"x": scale(frequent + ENDINGS + 1, 3 * h), "u": scale(h, 2 * h), "un": scale(h, h), "c": scale(h, classes), "cb": np.zeros(classes, np.float32), "w": scale(self.groups, h, CLASS_WORDS), "wb": np.zeros((self.groups, CLASS_WORDS), np.float32)}
        # numbers of 16 bits are sorted by their digits; the last entry is that of places without a target
        self.class_of = np.concatenate((np.arange(frequent) // CLASS_WORDS, self.groups + np.arange(ENDINGS), [-1])).astype(np.int16 if classes < 1 << 15 else np.int64)
        self.kept: dict[str, np.ndarray] = {}

    def room(self, name: str, dtype: np.dtype, *shape: int) -> np.ndarray:
        """An array whose contents last until its name is asked for again."""
        size = math.prod(shape)
        if name not in self.kept or self.kept[name].size < size or self.kept[name].dtype != dtype:
            self.kept[name] = np.empty(size, dtype)
        return self.kept[name][:size].reshape(shape)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.reshape(-1) for v in self.p.values()])

    def put(self, weights: np.ndarray) -> None:
        """The parameters become views of ``weights``, or of a copy if those aren't single precision."""
        weights, at = weights.astype(np.float32, copy=False), 0
        for k, v in self.p.items():
            self.p[k] = weights[at : at + v.size].reshape(v.shape)
            at += v.size

    def inputs(self) -> np.ndarray:
        """The table of inputs by gate (z, r, candidate), those of the gates negated, as ``steps`` takes them."""
        x = self.p["x"]
        table = self.room("table", x.dtype, 3, len(x), HIDDEN)
        np.negative(x[:, :HIDDEN], out=table[0])
        np.negative(x[:, HIDDEN : 2 * HIDDEN], out=table[1])
        table[2] = x[:, 2 * HIDDEN :]
        return table

    def window(self, table: np.ndarray, source: np.ndarray) -> np.ndarray:
        """Inputs (gate, step, lane, unit) of a window whose words are (step, lane)."""
        xs = self.room("xs", table.dtype, 3, *source.shape, HIDDEN)
        for rows, out in zip(table, xs):
            np.take(rows, source, axis=0, out=out, mode="clip")
        return xs

    def steps(self, xs: np.ndarray, h: np.ndarray, begins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States before each step, those times r, and the states after. Inputs become z, r and the candidates.
        Where ``begins`` (step, lane) is true, the state before is zero."""
        (_, T, lanes, n), p = xs.shape, self.p
        before, part, after = (self.room(k, h.dtype, T, lanes, n) for k in ("before", "part", "after"))
        u, un = -p["u"].reshape(n, 2, n).transpose(1, 0, 2), p["un"]
        two, one = self.room("two", h.dtype, 2, lanes, n), self.room("one", h.dtype, lanes, n)
        some = [False] * T if begins is None else begins.any(1).tolist()
        for t in range(T):
            own, gates, c = before[t], xs[:2, t], xs[2, t]
            own[:] = h
            if some[t]:
                own[begins[t]] = 0
            np.matmul(own, u, out=two)
            gates += two
            np.exp(gates, out=gates)
            gates += 1
            np.divide(1, gates, out=gates)
            np.multiply(gates[1], own, out=part[t])
            np.matmul(part[t], un, out=one)
            c += one
            np.tanh(c, out=c)
            h = np.subtract(c, own, out=after[t])
            h *= gates[0]
            h += own
        return before, part, after

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        n = HIDDEN
        xs = np.stack([-x[:, :n], -x[:, n : 2 * n], x[:, 2 * n :]])[:, None]
        state = self.steps(xs, h)[2][0].copy()
        return state, *xs[:, 0]

    def by_class(self, states: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Places with a target in order of its class, the classes, the states there with a 1 after each,
        and where the classes of frequent words begin."""
        cls = self.class_of[target]
        order = np.argsort(cls, kind="stable")[np.count_nonzero(target < 0) :]
        cls = cls[order]
        s = self.room("sorted", states.dtype, len(order), HIDDEN + 1)
        s[:, :HIDDEN] = np.take(states, order, axis=0)
        s[:, HIDDEN] = 1
        return order, cls, s, np.searchsorted(cls, np.arange(self.groups + 1)).tolist()

    def heads(self) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Weights of classes and of words with their constants as a last row, and bounds of their logits: no state is beyond 1."""
        c, w = (np.concatenate((self.p[k], self.p[k + "b"][..., None, :]), -2) for k in ("c", "w"))
        return c, w, float(np.abs(c).sum(-2).max()), float(np.abs(w).sum(-2).max(initial=0))

    def log_probs(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of the class's probability, times that of a frequent word within its class."""
        c, w, c_most, w_most = self.heads()
        order, cls, s, edges = self.by_class(states, target)
        found = np.empty(len(order))
        for a in range(0, len(order), TOGETHER):
            own = s[a : a + TOGETHER]
            found[a : a + TOGETHER] = picked_log(np.matmul(own, c, out=self.room("classes", s.dtype, len(own), c.shape[1])), cls[a : a + TOGETHER], c_most)
        logits = self.room("words", s.dtype, edges[-1], CLASS_WORDS)
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                np.matmul(s[a:b], w[k], out=logits[a:b])
        found[: edges[-1]] += picked_log(logits, target[order[: edges[-1]]] % CLASS_WORDS, w_most)
        out = np.empty(len(order))
        out[order] = found
        return out

    def windows(self, texts: list[list[np.ndarray]], steps: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Windows of all lanes that go on, the longest lane first: places in the lanes' texts laid end to
        end, which of them are there, the words there (else -1) and those before."""
        sizes = np.array([len(t) for lane in texts for t in lane])
        flat = np.concatenate([t for lane in texts for t in lane]).astype(np.int64)
        source = np.concatenate(([self.start], flat[:-1]))
        source[(np.cumsum(sizes) - sizes)[sizes > 0]] = self.start
        sizes = np.array([sum(map(len, lane)) for lane in texts])
        starts = np.cumsum(sizes) - sizes
        for a in range(0, int(sizes[0]), steps):
            alive = int((sizes > a).sum())
            span = a + np.arange(min(steps, int(sizes[0]) - a))
            live = span < sizes[:alive, None]
            at = np.where(live, starts[:alive, None] + span, 0)
            yield at, live, np.where(live, flat[at], -1), np.where(live, source[at], 0)

    def train(self, docs: list[np.ndarray], rate: float = 0.01, seed: int = 3) -> None:
        """Truncated backpropagation over whole documents: windows pass on the state, not the gradient.

        Documents are dealt to lanes and follow each other there, each from a state of zeros.
        Where few lanes go on (in the rest of a very long document), steps are smaller."""
        tokens = sum(map(len, docs))
        if not tokens:
            return
        lanes = max(1, min(LANES, len(docs), tokens // (8 * WINDOW)))
        rng = np.random.default_rng(seed)
        texts = [[docs[k] for k in rng.permutation(lane)] for lane in dealt(docs, lanes)]
        weights = self.flat()
        self.put(weights)
        m1, m2, change = np.zeros_like(weights), np.zeros_like(weights), np.empty_like(weights)
        h = np.zeros((lanes, HIDDEN), np.float32)
        for steps, (_, live, target, before) in enumerate(self.windows(texts), 1):
            grads, h = self._gradients(before, target, h[: len(live)], before != self.start)
            g = np.concatenate([grads[k].reshape(-1) for k in self.p], out=self.room("gradient", weights.dtype, len(weights)))
            lr, root = rate * min(1, steps / 5) * live.sum() / (lanes * live.shape[1]), (1 - 0.99**steps) ** 0.5
            # moments: m1 += 0.1 * (g - m1), m2 += 0.01 * (g * g - m2)
            m1 += np.multiply(np.subtract(g, m1, out=change), np.float32(0.1), out=change)
            m2 += np.multiply(np.subtract(np.multiply(g, g, out=g), m2, out=g), np.float32(0.01), out=g)
            np.sqrt(m2, out=change)
            change += np.float32(1e-8 * root)
            np.divide(m1, change, out=change)
            change *= np.float32(lr * root / (1 - 0.9**steps))
            weights -= change

    def _gradients(self, source: np.ndarray, target: np.ndarray, h: np.ndarray, goes_on: np.ndarray | None = None) -> tuple[dict, np.ndarray]:
        """Gradients of the mean loss over targets that aren't negative, and the last state.
        Where ``goes_on`` is false, a text starts from a state of zeros."""
        p, n, (lanes, T) = self.p, HIDDEN, source.shape
        begins = None if goes_on is None else np.ascontiguousarray(~goes_on.T)
        source, target = np.ascontiguousarray(source.T), target.T.reshape(-1)  # a row for each step
        xs = self.window(self.inputs(), source)
        before, part, after = self.steps(xs, h, begins)
        last = after[-1].copy()

        c, w, c_most, w_most = self.heads()
        order, cls, s, edges = self.by_class(after.reshape(-1, n), target)
        total, f = max(len(order), 1), edges[-1]
        ds, of_c, of_w = self.room("ds", h.dtype, len(order), n), np.zeros_like(c), np.zeros_like(w)
        back_c, back_w = np.ascontiguousarray(c[:n].T), np.ascontiguousarray(w[:, :n].transpose(0, 2, 1))
        for a in range(0, len(order), TOGETHER):
            own = s[a : a + TOGETHER]
            d = np.matmul(own, c, out=self.room("classes", s.dtype, len(own), c.shape[1]))
            scale = errors(d, cls[a : a + TOGETHER], total, c_most)
            of_c += (own * scale).T @ d
            np.multiply(np.matmul(d, back_c, out=ds[a : a + TOGETHER]), scale, out=ds[a : a + TOGETHER])
        d, more = self.room("words", s.dtype, f, CLASS_WORDS), self.room("more", s.dtype, f, n)
        groups = [(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
        for k, a, b in groups:
            np.matmul(s[a:b], w[k], out=d[a:b])
        d *= errors(d, target[order[:f]] % CLASS_WORDS, total, w_most)
        for k, a, b in groups:
            np.matmul(s[a:b].T, d[a:b], out=of_w[k])
            np.matmul(d[a:b], back_w[k], out=more[a:b])
        ds[:f] += more
        full = self.room("full", h.dtype, T * lanes, n)
        if len(order) < len(full):
            full[:] = 0
        full[order] = ds
        full = full.reshape(T, lanes, n)

        # derivatives by what goes into the candidates and the gates, for all steps
        z, r, cand = xs
        stay = np.subtract(1, xs[:2], out=self.room("stay", h.dtype, 2, T, lanes, n))
        by_gates = np.multiply(xs[:2], stay, out=self.room("by gates", h.dtype, 2, T, lanes, n))
        by_gates[1] *= before
        by_c = np.subtract(cand, before, out=self.room("by candidates", h.dtype, T, lanes, n))
        by_gates[0] *= by_c
        np.multiply(cand, cand, out=by_c)
        np.subtract(1, by_c, out=by_c)
        by_c *= z
        gx, back = self.room("gx", h.dtype, 3, T, lanes, n), np.zeros((lanes, n), h.dtype)
        u, un = p["u"].T.reshape(2, n, n), np.ascontiguousarray(p["un"].T)
        two, one = self.room("two", h.dtype, 2, lanes, n), self.room("one", h.dtype, lanes, n)
        some = [False] * T if begins is None else begins.any(1).tolist()
        for t in reversed(range(T)):
            g = full[t]
            g += back
            np.multiply(g, by_c[t], out=gx[2, t])
            np.multiply(g, by_gates[0, t], out=gx[0, t])
            np.matmul(gx[2, t], un, out=one)
            np.multiply(one, by_gates[1, t], out=gx[1, t])
            np.multiply(g, stay[0, t], out=back)
            one *= r[t]
            back += one
            np.matmul(gx[:2, t], u, out=two)
            back += two[0]
            back += two[1]
            if some[t]:
                back[begins[t]] = 0

        gx = gx.reshape(3, -1, n)
        grads = {"c": of_c[:n], "cb": of_c[n], "w": of_w[:, :n], "wb": of_w[:, n], "un": part.reshape(-1, n).T @ gx[2]}
        grads["u"] = np.matmul(before.reshape(-1, n).T, gx[:2]).transpose(1, 0, 2).reshape(n, 2 * n)
        of_x, at = np.zeros(p["x"].size, h.dtype), (source.reshape(-1, 1) * (3 * n) + np.arange(n)).reshape(-1)
        for own in gx:
            np.add.at(of_x, at, own.reshape(-1))
            at += n
        grads["x"] = of_x.reshape(p["x"].shape)
        return {k: np.clip(v, -1, 1) for k, v in grads.items()}, last

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of each whole document, without the words' shares in classes of endings.

        Documents follow each other in lanes, each from a state of zeros; there are as many lanes as
        the longest document leaves full, up to SCORED_TOGETHER."""
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        if not sizes.sum():
            return np.zeros(len(docs))
        lanes = dealt(docs, min(SCORED_TOGETHER, len(docs), -(-int(sizes.sum()) // int(sizes.max()))))
        scores, table = np.empty(sizes.sum()), self.inputs()
        h = np.zeros((len(lanes), HIDDEN), np.float32)
        for at, live, target, before in self.windows([[docs[k] for k in lane] for lane in lanes], max(1, LANES * WINDOW // len(lanes))):
            before = np.ascontiguousarray(before.T)
            states = self.steps(self.window(table, before), h[: len(live)], before == self.start)[2]
            h, live = states[-1].copy(), live.T.reshape(-1)
            there = slice(None) if live.all() else live
            scores[at.T.reshape(-1)[there]] = self.log_probs(states.reshape(-1, HIDDEN)[there], target.T.reshape(-1)[there])
        order = np.concatenate(lanes).astype(np.int64)
        return np.bincount(np.repeat(order, sizes[order]), scores, len(docs))


def bucket_counts(frame: pd.DataFrame, frequent: int) -> pd.DataFrame:
    """Sums each word's counts over all blocks of a bucket. One reply per block, and one row without
    a block: the bucket's ``frequent`` most frequent words and its sums by ending."""
    lists = [blocks.unpack_array(x) for x in frame["words"]]
    coded = pa.concat_arrays(lists).dictionary_encode()
    words, at = coded.dictionary, coded.indices.to_numpy()
    sums = np.bincount(at, np.concatenate([blocks.unpack(packed) for packed in frame["counts"]]), len(words)).astype(np.int64)
    replies = [blocks.pack(own) for own in np.split(sums[at], np.cumsum([len(x) for x in lists])[:-1])]
    seen, e = sums > 0, endings(words)
    tokens, kinds = (np.bincount(e[seen], x, ENDINGS).astype(np.int64).tolist() for x in (sums[seen], None))
    # the most frequent, and all that are level with the last of them before words decide
    most = np.flatnonzero(sums >= max(1, np.partition(sums, -frequent)[-frequent] if len(sums) > frequent else 1))
    top = sorted(zip(sums[most].tolist(), words.take(pa.array(most)).to_pylist()), key=lambda x: (-x[0], x[1]))[:frequent]
    block, bucket = frame["block"].tolist(), frame["bucket"].tolist()
    rows = [(k, b, x, None, None, None) for k, b, x in zip(block, bucket, replies)]
    rows.append((None, bucket[0], None, [{"word": w, "c": c} for c, w in top], tokens, kinds))
    out = pd.DataFrame(rows, columns=["block", "bucket", "reply", "top", "tokens", "kinds"], dtype=object)
    out["block"] = out["block"].astype("Int64")
    return out


COUNTED = "block long, bucket int, reply binary, top array<struct<word:string,c:long>>, tokens array<long>, kinds array<long>"


def build_vocabulary(counted: DataFrame, frequent: int) -> Vocabulary:
    """The vocabulary from the buckets' sums; of the words only the most frequent reach the driver."""
    sums = counted.where("block is null")
    top = sums.select(F.explode("top").alias("t")).select("t.word", "t.c").orderBy(F.desc("c"), "word").limit(frequent).collect()
    tokens, words = np.zeros(ENDINGS), np.zeros(ENDINGS)
    by = sums.select(F.posexplode(F.arrays_zip("tokens", "kinds")).alias("e", "x")).groupBy("e").agg(F.sum("x.tokens").alias("t"), F.sum("x.kinds").alias("w"))
    for r in by.collect():
        tokens[r["e"]], words[r["e"]] = r["t"], r["w"]
    total, distinct = int(tokens.sum()), int(words.sum())
    for r, e in zip(top, endings(pa.array([r["word"] for r in top], pa.large_string())).tolist()):
        tokens[e] -= r["c"]
        words[e] -= 1
    return Vocabulary(frequent, [r["word"] for r in top], total, distinct, tokens, words)


def add_up(frame: pd.DataFrame) -> pd.DataFrame:
    """One row: the sum of the weights' products and of the tokens."""
    frame = frame.sort_values(["tokens", "weights"])  # the same order in every run
    total = sum(np.frombuffer(w, np.float64) for w in frame["weights"])
    return pd.DataFrame({"part": frame["part"].iloc[:1], "tokens": [frame["tokens"].sum()], "weights": [total.tobytes()]})


PART = "part long, tokens long, weights binary"


def train_network(table: DataFrame, vocabulary: Vocabulary) -> Network:
    """The network after ROUNDS rounds, each over the training documents of its blocks. A round's result
    is the mean of the tasks' weights, by the tokens that each has learned from. The same blocks in
    the same partitions give the same network."""
    network = Network(frequent=vocabulary.frequent)
    # a task's number keeps its meaning in later levels: FAN neighbours are summed together
    own = table.select(F.spark_partition_id().cast("long").alias("part"), "block", "doc_ids", "lengths", "places", "buckets", "words")
    for turn in range(ROUNDS):
        weights = network.flat()

        def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model, tokens, part = Network(frequent=vocabulary.frequent), 0, None
            model.put(weights)
            for frame in frames:
                for row in frame.itertuples():
                    part = row.part
                    mine = [training(i) for i in row.doc_ids]
                    ids = word_ids(row, vocabulary)[blocks.unpack(row.places)]
                    edges = np.concatenate(([0], np.cumsum(row.lengths))).astype(np.int64)
                    texts = [ids[a:b] for a, b, use in zip(edges[:-1], edges[1:], mine) if use]
                    model.train(texts, rate=RATE, seed=turn)
                    tokens += sum(map(len, texts))
            if tokens:
                yield pd.DataFrame({"part": [part], "tokens": [tokens], "weights": [(model.flat().astype(np.float64) * tokens).tobytes()]})

        sums = own.where(F.pmod("block", F.lit(ROUNDS)) == turn).mapInPandas(learn, PART)
        parts = table.rdd.getNumPartitions()
        while parts > FAN:
            parts = -(-parts // FAN)
            sums = sums.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInPandas(add_up, PART)
        found = sums.toPandas()
        if len(found):
            last = add_up(found)
            network.put(np.frombuffer(last["weights"].iloc[0], np.float64) / last["tokens"].iloc[0])
    return network


def training(doc_id: object) -> bool:
    return id_crc_py(doc_id) % 5 != 1


def word_ids(row, vocabulary: Vocabulary) -> np.ndarray:
    """The id of each distinct word of a block, in the order of its places."""
    order = np.argsort(blocks.unpack(row.buckets), kind="stable")
    ids = np.empty(len(order), np.int32)
    ids[order] = vocabulary.numbers(pa.concat_arrays([blocks.unpack_array(packed) for packed in row.words]))
    return ids


def score_documents(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``, as in RESULT. Null and empty texts are one end. A null id counts
    as the empty text for the split and is kept. An empty table gives an empty table."""
    table = written_by_key(blocks.word_blocks(docs, numbered_words, training), "lm_blocks", "block")
    sizes = table.select(F.explode(F.arrays_zip("doc_ids", "lengths")).alias("d")).where(id_crc("d.doc_ids") % 5 != 1)
    frequent = vocabulary_size(sizes.agg(F.sum("d.lengths")).first()[0] or 0)
    counts = lambda frame: bucket_counts(frame, frequent)
    counted = written(blocks.lists_by_bucket(table).groupBy("bucket").applyInPandas(counts, COUNTED), "lm-counts")
    vocabulary = build_vocabulary(counted, frequent)
    network = train_network(table, vocabulary)
    v, n = vocabulary.distinct, vocabulary.total

    def score(row, replies: list[bytes], places: list[np.ndarray], n_words: int) -> pd.DataFrame:
        c = np.zeros(n_words)
        for reply, own in zip(replies, places):
            c[own] = blocks.unpack(reply)
        ids = word_ids(row, vocabulary)
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        rare = ids >= frequent
        kind = np.where(rare, ids - frequent, 0)
        within = np.where(rare, np.log10((c + 0.5) / (vocabulary.rare_tokens[kind] + 0.5 * (vocabulary.rare_words[kind] + 1))), 0.0)
        edges = np.concatenate(([0], np.cumsum(row.lengths))).astype(np.int64)
        flat = blocks.unpack(row.places)
        texts = [flat[a:b] for a, b in zip(edges[:-1], edges[1:])]
        model = network.score([ids[p] for p in texts]) / np.log(10)
        out = [(doc_id, not training(doc_id), len(p), int((c[p] > 0).sum()), n, float(base[p].sum()), float(s + within[p].sum())) for doc_id, p, s in zip(row.doc_ids, texts, model)]
        frame = pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    return blocks.with_replies(table, counted.where("block is not null"), score, RESULT)
