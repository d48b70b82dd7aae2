"""Each operator against plain Python on small and odd inputs."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelog.llm import ann, blocks, bpe_words, components, gru_lm, license_scan, line_dedup, packing, quality_rules, simhash, token_files, tokens, toxicity
from tidelog.llm.shared import id_crc_py

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def texts():
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 7))) for _ in range(80)]
    sentence = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    long_line = sentence(60)
    out = [None, "", "", " \n\t ", "one", "one two", "Same Text here. " * 5, "same text here. " * 5, "<|endoftext|> it's  \n\n x\x1cy 漢字 é"]
    out += ["\n".join(sentence(rnd.randint(1, 25)) for _ in range(rnd.randint(1, 12))) for _ in range(25)]
    out += [f"{sentence(5)}\n{long_line}\n{sentence(4)}" for _ in range(6)]
    base = sentence(300)
    out += [base, base, base + " tail", base.replace(" ", "  ", 1), sentence(6000)]
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en", "s", 0) for i, t in enumerate(texts())]
    return [*out, (7, "same text here. " * 5, "en", "s", 0), (None, "no id", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)  # repeated rows, rows without an id


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def by_id(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def plain_print(text):
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows, empty):
    prints = [plain_print(t) for _, t, *_ in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for a, b in itertools.combinations(range(len(rows)), 2):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root[a] = root[b] = min(root[a], root[b])
    least = lambda k: min((rows[i][0] for i in range(len(rows)) if root[i] == k and rows[i][0] is not None), default=None)
    expected = sorted(((r[0], f"{p:016x}", least(k)) for r, p, k in zip(rows, prints, root)), key=str)
    assert by_id(simhash.near_duplicates(docs)) == expected
    assert simhash.near_duplicates(empty).count() == 0
    clash = {c: F.lit("clash") for c in ("fp", "key", "root", "least", "own_hash", "kept_id", "kept_hash", "_kept_id")}
    kept = simhash.deduplicated(docs.withColumns(clash))
    assert kept.columns == [*docs.columns, *clash] and simhash.deduplicated(empty).count() == 0
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted({k: least(k) for k in root}.values(), key=str)


def test_simhash_links_in_full_keys(spark):
    rnd = random.Random(1)
    base = rnd.getrandbits(63)
    prints = {base}
    for _ in range(300):
        p = rnd.choice(sorted(prints))
        for b in rnd.sample(range(63), 2):
            p ^= 1 << b
        prints.add(p)
    prints |= {rnd.getrandbits(63) for _ in range(200)}
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r.node: r.root for r in components.components(simhash.links(frame)).collect()}
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if (a ^ b).bit_count() <= 2:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert {p: got.get(p, p) for p in prints} == {p: find(p) for p in prints}


def test_line_dedup(docs, rows, empty):
    seen, expected = set(), {}
    order = {(i, t or ""): None for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))}
    for i, t in order:
        lines, gone = [tuple(x.split()) for x in t.split("\n")], set()
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(lines[b])
                if n >= 50:
                    run = tuple(lines[a : b + 1])
                    if run in seen:
                        gone.update(range(a, b + 1))
                    seen.add(run)
        expected[i, t] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    got = line_dedup.line_dedup(docs)
    assert got.columns == [*docs.columns, "removed_lines"] and got.count() == len(rows)
    for r in got.collect():
        before = {k[1] for k in expected if k[0] == r.doc_id}
        assert (r.text or "") in {expected[r.doc_id, t] for t in before}
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_reaches_the_ends_of_runs(spark):
    rnd = random.Random(8)
    pool = [" ".join(f"w{k}x{i}" for i in range(n)) for k, n in enumerate([60, 10, 3, 10, 20, 45, 5, 30, 1, 12])]
    texts = [[pool[0], pool[1]], [pool[0], pool[3]], [pool[0], pool[3]]]
    texts += [rnd.choices(pool, k=rnd.randint(2, 9)) for _ in range(60)]
    seen, expected = set(), {}
    for d, lines in enumerate(texts):
        gone = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(len(x.split()) for x in lines[a : b + 1]) >= 50:
                    run = tuple(lines[a : b + 1])
                    if run in seen:
                        gone.update(range(a, b + 1))
                    seen.add(run)
        expected[d] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    assert expected[2] == ""
    frame = spark.createDataFrame([(d, "\n".join(lines)) for d, lines in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(frame).collect()} == expected


def test_line_dedup_of_a_text_that_repeats_itself(spark):
    line = " ".join(f"w{i}" for i in range(50))
    once = [" ".join(f"v{k}x{i}" for i in range(50)) for k in range(3)]
    data = [(1, "\n".join([line] * 20000), "x"), (2, "\n".join([once[0], once[1], once[0], once[1], once[2], line]), "y")]
    frame = spark.createDataFrame(data, "doc_id long, text string, _id string").withColumns({c: F.lit("clash") for c in ("_k", "own_id", "line_runs", "hash")})
    got = {r.doc_id: r for r in line_dedup.line_dedup(frame).collect()}
    assert got[1].text == line and got[2].text == "\n".join([once[0], once[1], once[2]])
    assert got[1]._id == "x" and got[2].hash == "clash" and [tuple(r) for r in got[1].removed_lines] == [(1, 19999)]


def test_ann_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 16))
    x *= rng.uniform(0.5, 2, (3000, 1))
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = ann.search(frame, frame.where("vec_id % 20 = 0")).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(g.vec_id))
        assert list(g.sort_values("rank")["rank"]) == list(range(1, 21))
        assert np.allclose(g.score, s[g.vec_id])
    assert got.query_id.nunique() == 150 and hits >= 0.9 * 20 * 150
    assert ann.search(frame.limit(0), frame.limit(0)).count() == 0


def test_ann_with_a_third_of_copies(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 16))
    x[rng.permutation(3000)[:1000]] = x[7]
    near = rng.permutation(3000)[:400]
    x[near] = x[11] * (1 + 1e-4 * rng.standard_normal((400, 1)))
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(frame, frame.where("vec_id % 20 = 0")).toPandas().sort_values(["query_id", "rank"])
    hits, of_copies = 0, 0
    for q, g in got.groupby("query_id"):
        s = np.round(x @ x[q], 9)
        s[q] = -np.inf
        true = np.lexsort((np.arange(3000), -s))[:20]
        assert len(g) == 20
        hits += len(set(true) & set(g.vec_id))
        if (x[q] == x[7]).all() or q in near:
            of_copies += 1
            assert list(g.vec_id) == list(true)
    assert got.query_id.nunique() == 150 and of_copies > 20 and hits >= 0.95 * 20 * 150


def test_ann_visits_lists_until_k_are_found(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.standard_normal((4000, 8)), 50 + rng.standard_normal((6, 8)), rng.standard_normal((6, 8)) - 50))
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(frame, frame.where("vec_id >= 4000 or vec_id < 20"), covered=0.1).groupBy("query_id").count().collect()
    assert len(got) == 32 and all(r["count"] == 20 for r in got)

def test_ann_ties_and_lengths(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2500, 6))
    x[:1500, 0] = 9.0  # equal products with the queries along the first axis
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    data += [(3000 + i, [1.0 + i, 2.0]) for i in range(30)] + [(4000, [5.0])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("query_id", F.lit("clash"))
    asked = spark.createDataFrame([(9000, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (3000, [1.0, 2.0]), (4000, [5.0])], "vec_id long, embedding array<double>")
    got = ann.search(frame, asked).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 9000] == list(range(20))
    assert [r.vec_id for r in got if r.query_id == 3000] == list(range(3029, 3009, -1))
    assert not [r for r in got if r.query_id == 4000]


def test_bpe(docs, rows, empty):
    t = Tokenizer.from_file(BYTE)
    expected = []
    for i, s, *_ in rows:
        e = t.encode(s or "", add_special_tokens=False).ids
        expected.append((i, len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(t.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert by_id(bpe_words.encode_decode(docs, BYTE)) == sorted(expected, key=str)
    assert bpe_words.encode_decode(empty, BYTE).count() == 0


@pytest.mark.parametrize("path, cut", [(BYTE, "byte"), (WORD, "space")])
def test_words_keep_the_ids(path, cut):
    rnd = random.Random(2)
    alphabet = [*"ab Z'.,!?;:\n\n  \t1é", "Σ", "İ", "ß", "\x1c", "\xa0", "don't", "'S", "<|endoftext|>", "ﬁ", "́", "٣", "漢"]
    samples = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 12))) for _ in range(4000)]
    t = Tokenizer.from_file(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encode_texts(samples, path, cut)] == [e.ids for e in t.encode_batch(samples, add_special_tokens=False)]


def test_token_files(spark, docs, rows, empty, tmp_path):
    t = Tokenizer.from_file(WORD)
    token_files.write_files(docs, f"file://{tmp_path}/f", WORD)
    start, expected = 0, []
    for i, s, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        e = t.encode(s or "", add_special_tokens=False).ids + [1]
        expected.append((i, start, len(e), zlib.crc32(np.array(e, "<u4").tobytes())))
        start += len(e)
    got = by_id(token_files.read_files(spark, f"file://{tmp_path}/f"))
    unique = lambda xs: [x for x in xs if x[0] != 7]  # noqa: E731  rows with one id may stand in either order
    assert unique(got) == unique(sorted(expected, key=str)) and len(got) == len(expected)
    assert token_files.read_document(spark, f"file://{tmp_path}/f", 5)[0] == t.encode("one two", add_special_tokens=False).ids + [1]
    assert token_files.round_trip(empty, WORD).count() == 0
    found = spark.read.parquet(f"file://{tmp_path}/f/files").where("first_id is not null")
    assert found.where("first_id > last_id").count() == 0 and token_files.read_document(spark, f"file://{tmp_path}/f", 10**9) == []


def test_the_dictionary_learns_from_the_whole_table(spark, monkeypatch):
    """A thousand empty texts stand before the ones that can be learned from; few of many are taken, from all parts."""
    monkeypatch.setattr(token_files, "TRAINING_DOCUMENTS", 200)
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(300)]
    rows = [(i, "" if i < 1000 else " ".join(rnd.choices(words, k=120)), "en", "s", 0) for i in range(1600)]
    table = spark.createDataFrame(rows, DOC)
    sample = token_files.training_sample(table)
    assert 50 <= len(sample) <= 200 and sample == token_files.training_sample(table.repartition(5))
    assert len(token_files.train_dictionary(table, WORD, "space", 2)) > 0
    assert token_files.training_sample(table.limit(0)) == []


def test_packing(docs, rows, empty):
    got = packing.pack_documents(docs, BYTE).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    t = Tokenizer.from_file(BYTE)
    expected, total = [], 0
    for i, s, *_ in rows:
        ids, at, k = [*t.encode(s or "", add_special_tokens=False).ids, 0], 0, 0
        total += len(ids)
        while at < len(ids):
            n = (len(ids) % 2048 or 2048) if k == 0 else 2048
            expected.append((i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at, k = at + n, k + 1
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(expected, key=str)
    assert len(by) == math.ceil(total / 2048) and all(r.bins >= r.bound for r in got)
    assert packing.pack_documents(empty, BYTE).count() == 0


def test_groups_with_gaps_exchange(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 12)
    rnd = random.Random(5)
    data = [(None if k % 3 == 0 else 7, " word" * rnd.randint(300, 1400)) for k in range(150)]
    frame = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("part", "row", "piece", "length")})
    got = packing.pack_documents(frame, BYTE).collect()
    lengths = [t.count("word") + 1 for _, t in data]
    assert sorted(r.length for r in got) == sorted(lengths)
    one = len(set(packing.best_fit(lengths)))
    assert packing.lower_bound(lengths) <= len({r.sequence_id for r in got}) <= 1.15 * one  # in groups of twelve


def test_bounds_and_best_fit():
    rnd = random.Random(0)
    for _ in range(100):
        lengths = [rnd.choice([rnd.randint(1, 100), 40, 51, 34]) for _ in range(rnd.randint(1, 30))]
        bins = packing.best_fit(lengths, 100)
        fill = collections.Counter()
        for n, b in zip(lengths, bins):
            fill[b] += n
        assert max(fill.values()) <= 100
        assert math.ceil(sum(lengths) / 100) <= packing.lower_bound(lengths, 100) <= len(fill)
    assert packing.lower_bound([51] * 7, 100) == 7 and packing.lower_bound([34] * 6, 100) == 3


def test_toxicity(spark, empty):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    data, labels = [], []
    for i in range(600):
        bad = rnd.random() < 0.3
        lines = [" ".join(word() for _ in range(8)) + "." for _ in range(6)]
        if bad:
            lines[rnd.randrange(6)] += " you " + rnd.choice(["zorkish", "zorkers", "blimp"]) + "."
        data.append((i, " ".join(lines), "en", "s", 0))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(data, DOC)
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = toxicity.scored(docs, model).select("doc_id", "held_out", "score", "predicted").collect()
    wrong = sum(r.predicted != labels[r.doc_id][1] for r in got if r.held_out)
    assert all(r.held_out == (id_crc_py(r.doc_id) % 3 == 1) for r in got) and wrong <= 6
    found = toxicity.offending_sentences(docs, model).collect()
    assert found and sum(bool(re.search("zork|blimp", r.words)) for r in found) >= 0.9 * len(found)
    clash = docs.withColumns({c: F.lit("clash") for c in ("_id", "_toxic", "toxic", "place", "hash")})
    assert toxicity.train(clash, marks) == model and {r["_id"] for r in toxicity.scored(clash, model).collect()} == {"clash"}
    with_bad = toxicity.scored(docs, model).where("predicted = 1").select("offending").collect()
    assert with_bad and all(r.offending for r in with_bad)
    odd = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert [r.score for r in toxicity.scored(odd, model).collect()] == [0.0, 0.0]
    assert toxicity.scored(empty, toxicity.train(empty, marks)).count() == 0


def test_toxicity_is_the_noisy_or(spark):
    """Scores, gradients' result and the place of the cut against plain loops."""
    texts = ["good day. fine words here.", "you zork. fine day.", "zork zork! bad zork here. good", "fine. good. day.", "", None] * 6
    labels = [0, 1, 1, 0, 0, 0] * 6
    model = toxicity.fit(texts, labels)
    for text in texts[:6]:
        logits = []
        for part in re.split(r"[.!?\n]+", (text or "").lower()):
            words = {w.strip(toxicity._EDGE) for w in part.split()} - {""}
            if words:
                logits.append(model.bias + sum(model.weights.get(f, 0.0) for w in words for f in [w, *("^" + w[:n] for n in (4, 5) if len(w) >= n)]))
        clean = math.prod(1 / (1 + math.exp(z)) for z in logits)
        bag = math.log((1 - clean) / clean) if logits else None
        assert model.score(model.logits(text)) == pytest.approx(1 / (1 + math.exp(-(model.slope * bag + model.shift))) if logits else 0.0)
    assert model.score(model.logits("a zork.")) > 0.5 > model.score(model.logits("a good day."))
    rnd = random.Random(1)
    for _ in range(50):
        n = rnd.randint(2, 12)
        x, y = np.array([rnd.choice([0.0, 1.0, 1.5, rnd.random() * 3]) for _ in range(n)]), np.array([float(rnd.random() < 0.4) for _ in range(n)])
        if not 0 < y.sum() < n:
            continue
        f1 = lambda cut: 2 * y[x > cut].sum() / ((x > cut).sum() + y.sum())
        assert f1(toxicity.best_cut(x, y)) == pytest.approx(max(f1(c) for c in [*(x - 1e-6), x.max() + 1]))


def test_language_model(docs, rows, empty):
    got = gru_lm.score_documents(docs).collect()
    cut = [(i, WORDS.findall((t or "").translate(LOWER)) + ["\n"]) for i, t, *_ in rows]
    counts = collections.Counter(w for i, ws in cut if id_crc_py(i) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = sorted((str(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in cut)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert gru_lm.score_documents(empty).count() == 0


def test_language_model_gradients():
    rng = np.random.default_rng(0)
    net = gru_lm.Network()
    net.p = {k: p.astype(np.float64) for k, p in net.p.items()}
    ids = rng.integers(0, gru_lm.FREQUENT + gru_lm.ENDINGS, (3, 6))
    source = np.concatenate((np.full((3, 1), gru_lm.FREQUENT + gru_lm.ENDINGS), ids[:, :-1]), 1)
    h = rng.standard_normal((3, gru_lm.HIDDEN)) * 0.1

    def loss():
        state, states = h, []
        for t in range(6):
            state = net.step(net.p["x"][source[:, t]], state)[0]
            states.append(state)
        return -net.log_probs(np.stack(states, 1).reshape(-1, gru_lm.HIDDEN), ids.reshape(-1)).mean()

    grads, _ = net._gradients(source, ids, h)
    for k in ("x", "u", "un", "c", "w"):
        at = np.unravel_index(np.argmax(np.abs(grads[k])), grads[k].shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-5
        up = loss()
        net.p[k][at] = old - 1e-5
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-4 * max(1, abs(grads[k][at]))


def test_language_model_learns_from_every_training_text(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(40)]
    turned = lambda k: " ".join(words[(i + k) % 40] for i in range(4000))
    data = [(i, turned(i)) for i in range(12)]  # 28,000 characters each
    got = gru_lm.score_documents(spark.createDataFrame(data, "doc_id long, text string").repartition(2)).collect()
    assert any(r.held_out for r in got) and all(r.score > 0.5 * r.base_score for r in got)


def test_language_model_scores_again_alike(spark):
    """The same table gives the same scores to the last bit, whatever its blocks; words that are rare within
    their class get its probability by their counts."""
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choices([f"w{k}" for k in range(300)], weights=[1 / (k + 1) for k in range(300)], k=120)), "en", "s", 0) for i in range(90)]
    docs = spark.createDataFrame(rows, DOC).repartition(6, "doc_id")
    first, again = by_id(gru_lm.score_documents(docs)), by_id(gru_lm.score_documents(docs))
    assert first == again and len(first) == 90 and len({r[6] for r in first}) > 80


def test_language_model_shares_of_rare_words(spark, monkeypatch):
    """A text of one rare word more than another: its score differs by the word's share of its class, times what the
    network gives the class, which is the same for two words of one class and one length of text."""
    monkeypatch.setattr(gru_lm, "vocabulary_size", lambda tokens: gru_lm.CLASS_WORDS)
    rnd = random.Random(2)
    common = [f"c{k}" for k in range(gru_lm.CLASS_WORDS)]
    words = [w for w in (f"r{a}{b}q" for a in "abcdefgh" for b in "abcdefgh")]
    pair = next((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if gru_lm.ending(a) == gru_lm.ending(b))
    train = [i for i in range(400) if gru_lm.training(i)][:60]
    held = [i for i in range(400) if not gru_lm.training(i)][:2]
    rows = [(i, " ".join(rnd.choices(common, k=200) + [pair[0]] * 3 + ([pair[1]] if k % 3 == 0 else [])), "en", "s", 0) for k, i in enumerate(train)]
    rows += [(held[0], pair[0], "en", "s", 0), (held[1], pair[1], "en", "s", 0)]
    found = {r[0]: r[6] for r in by_id(gru_lm.score_documents(spark.createDataFrame(rows, DOC)))}
    counts = (3 * 60, 20)
    assert math.isclose(found[held[0]] - found[held[1]], math.log10((counts[0] + 0.5) / (counts[1] + 0.5)), rel_tol=1e-4)


def test_language_model_words_grow_with_the_tokens():
    sizes = [gru_lm.vocabulary_size(10**k) for k in range(5, 11)]
    assert sizes[0] == gru_lm.FREQUENT and sizes[-3] < sizes[-2] < sizes[-1] and all(n % gru_lm.CLASS_WORDS == 0 for n in sizes)
    net = gru_lm.Network(frequent=sizes[-1])
    doc = np.array([0, sizes[-1] - 1, sizes[-1] + gru_lm.ENDINGS - 1])
    net.train([doc])
    assert np.isfinite(net.score([doc])).all()


def test_language_model_works_in_full_windows(monkeypatch):
    """One long text beside short ones leaves no windows of a single lane, and texts that follow each other
    in a lane are scored as each is alone."""
    rng = np.random.default_rng(3)
    net, calls = gru_lm.Network(), []
    docs = [rng.integers(0, gru_lm.FREQUENT + gru_lm.ENDINGS, n) for n in [20_000, *rng.integers(1, 200, 1000)]]
    plain = gru_lm.Network.log_probs
    monkeypatch.setattr(gru_lm.Network, "log_probs", lambda self, states, target: calls.append(len(target)) or plain(self, states, target))
    scores = net.score(docs)
    assert sum(calls) == sum(map(len, docs)) and len(calls) < 2 * sum(calls) / (gru_lm.LANES * gru_lm.WINDOW) + 2
    for k in (0, 1, 500, 1000):
        assert math.isclose(scores[k], net.score([docs[k]])[0], rel_tol=1e-5)
    assert net.score([]).tolist() == [] and net.score([docs[1][:0], docs[1]])[0] == 0


def test_language_model_with_large_logits():
    """Where exp of a logit is too large or small for single precision, the log of the softmax is still right."""
    net = gru_lm.Network()
    net.p["c"] *= 3000
    net.p["w"] *= 3000
    states = np.random.default_rng(1).uniform(-1, 1, (300, gru_lm.HIDDEN)).astype(np.float32)
    target = np.arange(300) * 3
    classes, words = states @ net.p["c"] + net.p["cb"], np.stack([s @ net.p["w"][t // gru_lm.CLASS_WORDS] for s, t in zip(states, target)])
    log = lambda x, at: x[np.arange(len(at)), at] - x.max(1) - np.log(np.exp((x - x.max(1, keepdims=True)).astype(np.float64)).sum(1))
    expected = log(classes, target // gru_lm.CLASS_WORDS) + log(words, target % gru_lm.CLASS_WORDS)
    assert np.allclose(net.log_probs(states, target), expected, rtol=1e-3, atol=0.1)
    net.train([target, target[::-1]])
    assert all(np.isfinite(v).all() for v in net.p.values())


def test_language_model_words_as_columns():
    """Ids and endings of a column of words, and counts of a bucket, as worked out word by word."""
    rnd = random.Random(5)
    words = ["\n", "!?", "a!", "é", "éé.", "漢字字字!!", "a.b.", "😀\".", *{"".join(rnd.choices("abé漢.!,'\"", k=rnd.randint(1, 7))) for _ in range(500)}]
    words = list(dict.fromkeys(words))
    cores = [w.rstrip(".,;:!?\"')") for w in words]
    expected = [zlib.crc32((c[-3:] + "." * (c != w)).encode()) % gru_lm.ENDINGS for c, w in zip(cores, words)]
    column = pa.array(words, pa.large_string())
    assert gru_lm.endings(column).tolist() == expected == [gru_lm.ending(w) for w in words]
    known = gru_lm.Vocabulary(64, words[100:164], 0, 0, np.zeros(1), np.zeros(1))
    assert known.numbers(column).tolist() == [i - 100 if 100 <= i < 164 else 64 + e for i, e in enumerate(expected)]
    lists = [rnd.sample(words, 200) for _ in range(3)]
    counts = [[rnd.choice([0, 1, 1, 2, 9]) for _ in own] for own in lists]
    frame = pd.DataFrame({"block": [4, 5, 6], "bucket": 1, "words": [blocks.pack_words([w.encode() for w in own]) for own in lists], "counts": [blocks.pack(np.array(c)) for c in counts]})
    sums = collections.Counter()
    for own, c in zip(lists, counts):
        sums.update(dict(zip(own, c)))
    got = gru_lm.bucket_counts(frame, 50)
    assert [blocks.unpack(x).tolist() for x in got["reply"][:3]] == [[sums[w] for w in own] for own in lists]
    assert [(x["word"], x["c"]) for x in got["top"].iloc[3]] == sorted(((w, c) for w, c in sums.items() if c), key=lambda x: (-x[1], x[0]))[:50]
    kinds = collections.Counter(e for w, e in zip(words, expected) if sums[w])
    assert got["kinds"].iloc[3] == [kinds[e] for e in range(gru_lm.ENDINGS)] and sum(got["tokens"].iloc[3]) == sum(sums.values())


def test_state_is_carried_across_windows():
    net = gru_lm.Network()
    doc = np.arange(100) % 50
    h, total = np.zeros((1, gru_lm.HIDDEN), np.float32), 0.0
    for t in range(100):
        h = net.step(net.p["x"][[doc[t - 1] if t else gru_lm.FREQUENT + gru_lm.ENDINGS]], h)[0]
        total += net.log_probs(h, doc[t : t + 1])[0]
    assert abs(net.score([doc[:3], doc])[1] - total) < 1e-3


def test_license_scan(spark, empty):
    rnd = random.Random(0)
    pool = [w.decode() for _, t in license_scan.TEMPLATES for w in license_scan.license_words(t)] + ["foo", "bar"]
    data = [(i, "\n".join(" ".join(rnd.choices(pool, k=rnd.randint(1, 20))) for _ in range(4))) for i in range(80)]
    data += [(100 + i, f"x\n{t}\nend") for i, (_, t) in enumerate(license_scan.TEMPLATES)] + [(200, None), (201, ""), (202, "MIT  License! under the mit-license é")]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    listed = [license_scan.license_words(t) for _, t in license_scan.TEMPLATES]
    for r in license_scan.scan(frame).collect():
        words = license_scan.license_words(dict(data)[r.doc_id])
        expected = {}
        for k, t in enumerate(listed):
            size = math.ceil(1.25 * len(t))
            best = max((len(set(t) & set(words[a : a + size])) / len(set(t)) for a in range(len(words))), default=0)
            if best >= 0.8:
                expected[k] = best
        found = {}
        for m in r.matches:
            found[m.template] = max(found.get(m.template, 0), m.containment)
            assert len(set(listed[m.template]) & set(words[m.first : m.last + 1])) / len(set(listed[m.template])) == m.containment
        assert found == expected
        assert r.labels == ",".join(sorted(set(filter(None, r.base_labels.split(","))) | {license_scan.TEMPLATES[k][0] for k in expected}))
    wrapped = re.sub(r"((?:\S+ ){3}\S+) ", r"\1\n", license_scan.TEMPLATES[0][1])
    assert wrapped.count("\n") >= 4
    many = license_scan.scan(spark.createDataFrame([(1, wrapped), (1, wrapped), (None, "mit license " * 3000)], "doc_id long, text string"))
    got = sorted(many.collect(), key=lambda r: str(r.doc_id))
    assert [r.labels for r in got] == ["mit", "mit", "mit"] and got[2].n_base == 3000 and got[2].last_word == 5998
    one = license_scan.scan(frame.where("doc_id = 202")).collect()[0]
    assert (one.n_words, one.n_base, one.first_word, one.last_word, one.base_labels) == (7, 2, 0, 4, "mit")
    assert license_scan.scan(empty).count() == 0


def test_quality(docs, rows, empty):
    for r in quality_rules.quality_rules(docs).collect():
        t = r.text or ""
        words = WORDS.findall(t)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        n = collections.Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(empty).count() == 0
    clash = docs.withColumns({c: F.lit("clash") for c in ("_text", "_words", "_tag", "kept", "n_words", "row")})
    assert quality_rules.kept_rows(clash).columns == clash.columns
    assert {r["kept"] for r in quality_rules.kept_rows(clash).collect()} == {"clash"}
    judged = quality_rules.quality_rules(clash)
    assert {r["_tag"] for r in judged.collect()} == {"clash"}
    kept = quality_rules.kept_rows(docs)
    verdicts = quality_rules.quality_rules(docs).select("doc_id", "kept").collect()
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in verdicts if r.kept)
