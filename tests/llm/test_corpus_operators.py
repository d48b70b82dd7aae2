"""Source audit, whitening and mixing against plain Python on small and odd inputs."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import mixing, source_audit, whitening
from tidelog.llm.perfect_hash import PerfectHash, hashes
from tidelog.llm.queries import op11_source_audit

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {c: c + 32 for c in range(65, 91)}
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_rows():
    rnd = random.Random(7)
    words = ["Alpha", "beta", "gamma", "Été", "漢字", "x1y", "don't", "zeta-eta", "Ω"] + [f"w{chr(97 + i)}" for i in range(20)]
    out = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, " \n\t", "en", "", 0), (3, "1234 --- 5", "xx", "a", 0), (3, "lonely", "xx", "b", 0)]
    for i in range(200):
        source = rnd.choice(["a", "a", "a", "b", "c", "é", None, "z"])
        out.append((i, " ".join(rnd.choices(words, weights=range(len(words), 0, -1), k=rnd.randint(1, 60))), rnd.choice(["en", "en", "de", None]), source, 0))
    return [*out, *[(900, "same text here", "en", "a", 0)] * 40, (901, "word " * 30_000, "en", "b", 0)]


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def plain_audit(rows, least, ranks):
    texts = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for _, text, lang, source, _ in rows]
    seen, counts = Counter(), Counter()
    for lang, source, terms in texts:
        seen.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    groups, out = sorted({(a, b) for a, b, _ in texts}), []
    for lang in {a for a, _ in groups}:
        kept = [t for (a, t), n in seen.items() if a == lang and n >= least]
        sources = [b for a, b in groups if a == lang]

        def shares(names):
            n = {t: sum(counts[lang, s, t] for s in names) for t in kept}
            return {t: 1 + 10**9 * (n[t] + 5) // (sum(n.values()) + 5 * len(kept)) for t in kept}

        q, p = shares(sources), {s: shares([s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "ranks", "shard", "sent"), [(3, 5, 1 << 15, 1 << 20), (2, 50, 4, 40)])
def test_source_audit(docs, rows, least, ranks, shard, sent):
    """With one shard, and with many shards in several recounts."""
    found = source_audit.audit(docs, least, ranks, shard, sent)
    assert sorted(map(tuple, found.collect())) == plain_audit(rows, least, ranks)


def test_source_audit_of_many_sources(spark, monkeypatch):
    """Blocks of sources, flushes in the middle of a task, and the default bounds."""
    monkeypatch.setattr(source_audit, "BLOCK_SOURCES", 2)
    monkeypatch.setattr(source_audit, "HELD_TERMS", 7)
    monkeypatch.setattr(source_audit, "HELD_BYTES", 1)
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choices("abcdefgh", k=20)), "en", f"s{i % 7}", 0) for i in range(80)]
    found = source_audit.audit(spark.createDataFrame(rows, DOC).repartition(2), 3, 4, 3)
    assert sorted(map(tuple, found.collect())) == plain_audit(rows, 3, 4)


def test_source_audit_edges(spark, docs, rows, empty, tmp_path):
    assert source_audit.audit(empty).count() == 0
    clash = {c: F.lit("x") for c in ("term", "n", "shard", "counts", "total", "rank", "value")}
    found = source_audit.audit(docs.withColumns(clash), 3, 5)
    assert found.columns == source_audit.RESULT and sorted(map(tuple, found.collect())) == plain_audit(rows, 3, 5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, op11_source_audit(spark, str(tmp_path)).collect())) == plain_audit(rows, 30, 50)


def test_perfect_hash(monkeypatch):
    keys = [f"key {i}".encode() for i in range(3000)]
    made = PerfectHash.build(keys)
    assert sorted(made.slots(keys, hashes(keys)).tolist()) == list(range(3000))
    others = [f"other {i}".encode() for i in range(3000)]
    assert set(made.slots(others, hashes(others)).tolist()) == {-1}
    monkeypatch.setattr("tidelog.llm.perfect_hash.LEVELS", 1)  # the rest is listed
    few = PerfectHash.build(keys)
    assert sorted(few.slots(keys, hashes(keys)).tolist()) == list(range(3000))
    assert set(few.slots(others, hashes(others)).tolist()) == {-1}
    assert PerfectHash.build([]).slots(keys[:2], hashes(keys[:2])).tolist() == [-1, -1]


def check_whitening(found, vectors):
    """``found`` by id against exact moments and numpy's eigenvectors of ``vectors`` (id, list)."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in vectors], object)
    n, d = x.shape
    s = x.sum(0)
    dev = n * x - s
    cov = np.array([[float(Fraction(int((dev[:, i] * dev[:, j]).sum()), n**3)) for j in range(d)] for i in range(d)])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    y = np.array([[float(Fraction(int(t), n)) for t in row] for row in dev])
    by_row = {}
    for r in found:
        by_row.setdefault(r["vec_id"], {})[r["component"]] = r
    k = max(r["component"] for r in found)
    assert sorted(by_row) == sorted(i for i, _ in vectors) and all(sorted(m) == list(range(1, k + 1)) for m in by_row.values())
    w = np.array([[by_row[i][c]["whitened"] for c in range(1, k + 1)] for i, _ in vectors])
    assert all(r["n"] == n for r in found)
    assert [by_row[i][1]["deviation"] for i, _ in vectors] == [int((row**2).sum()) for row in dev]
    assert np.allclose([by_row[vectors[0][0]][c]["explained"] for c in range(1, k + 1)], e[:k] / e.sum(), rtol=1e-9)
    assert np.abs(w.T @ w / n - np.outer(w.mean(0), w.mean(0)) - np.eye(k)).max() < 1e-8
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-8
    expected = y @ v[:, :k] / np.sqrt(e[:k])
    for c in range(k):
        assert min(np.abs(w[:, c] - expected[:, c]).max(), np.abs(w[:, c] + expected[:, c]).max()) < 1e-6
    return k


VEC = "vec_id long, embedding array<float>, label int"


def test_whitening(spark):
    rng = np.random.default_rng(3)
    good = [(i, row, 0) for i, row in enumerate((rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40))).astype(np.float32).tolist())]
    odd = [(900, None, 0), (901, [], 0), (902, [*good[0][1][:-1], None], 0), (903, [*good[0][1][:-1], float("nan")], 0), (904, [float("-inf"), *good[0][1][1:]], 0), (905, [1e30, *good[0][1][1:]], 0)]
    table = spark.createDataFrame(good + odd, VEC).repartition(5)
    found = whitening.whiten(table).collect()
    assert check_whitening(found, [(i, v) for i, v, _ in good]) == 32
    assert {r["deviation_exact"] == r["deviation"] for r in found} == {True}
    assert all(np.isfinite(r["whitened"]) for r in found)


def test_whitening_of_few_dimensions_and_copies(spark):
    """Fewer dimensions than components, dependent dimensions, a third of equal rows, large entries, repeated ids."""
    rng = np.random.default_rng(4)
    two = rng.normal(size=(90, 2)).astype(np.float32).tolist()
    rows = [(i, [a, b, a, 5.0], 0) for i, (a, b) in enumerate(two)] + [(100 + i, [1.0, 2.0, 1.0, 5.0], 0) for i in range(45)]
    found = whitening.whiten(spark.createDataFrame(rows, VEC)).collect()
    assert check_whitening(found, [(i, v) for i, v, _ in rows]) == 2
    large = [(i, [c * 1e12 for c in v], 0) for i, v in enumerate(two)]
    wide = spark.createDataFrame(large, "vec_id long, embedding array<double>, label int")
    found = whitening.whiten(wide).collect()
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v, _ in large], object)
    exact = {i: int(((len(x) * row - x.sum(0)) ** 2).sum()) for i, row in enumerate(x)}
    assert {r["vec_id"]: int(r["deviation_exact"]) for r in found} == exact
    assert all(r["deviation"] is None for r in found if exact[r["vec_id"]] >= 1 << 63)
    lengths = spark.createDataFrame([(i, v, 0) for i, v in enumerate(two)] + [(i, [*v, 2 * v[0] + i], 0) for i, v in enumerate(two)] + [(None, two[0], 0)], VEC)
    counts = Counter((r["n"], r["component"]) for r in whitening.whiten(lengths.withColumn("n", F.lit(1)).withColumn("w", F.lit(1))).collect())
    assert counts == {(91, 1): 91, (91, 2): 91, (90, 1): 90, (90, 2): 90, (90, 3): 90}


def test_whitening_without_variance(spark):
    assert whitening.whiten(spark.createDataFrame([], VEC)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 5, VEC)).count() == 0


def test_cholesky_and_jacobi():
    rng = np.random.default_rng(0)
    for d in (1, 2, 5, 33):
        a = rng.normal(size=(2 * d, d)) * 10.0 ** rng.integers(-6, 6, d)
        c = a.T @ a
        order, factor = whitening.pivoted_cholesky(c)
        assert np.allclose(factor @ factor.T, c[order][:, order], rtol=1e-10)
        turned = whitening.one_sided_jacobi(factor)
        gram = turned.T @ turned
        scale = np.sqrt(np.outer(gram.diagonal(), gram.diagonal()))
        assert np.abs(gram / scale - np.eye(d)).max() < 1e-13  # orthogonal to each one's own length
        assert np.allclose(turned @ turned.T, c[order][:, order], rtol=1e-9)


def plain_mix(rows):
    """doc_id, size, source_size, target, taken, pieces, first_place by the rule, one source after another."""
    made = [(source, hashlib.md5(f"{'' if i is None else i}|{text or ''}".encode()).hexdigest(), i, len(WORD.findall(text or ""))) for i, text, _, source, _ in rows]
    names = sorted({m[0] for m in made if m[0] is not None}) + ([None] if any(m[0] is None for m in made) else [])
    size = {s: sum(m[3] for m in made if m[0] == s) for s in names}
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, sum(size.values()) * 1.5, list(names)
    while free:
        whole = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] > 2.0 * size[s] * whole]
        if not above:
            target |= {s: left * weight[s] / whole for s in free}
            break
        for s in above:
            target[s] = 2.0 * size[s]
            left -= target[s]
            free.remove(s)
    out, pieces = [], []
    for k, s in enumerate(names):
        low, high = ((4.0, 2.0), (1.0, 1.0), (1.0, 3.0))[k % 3]
        before = 0
        for key, i, n in sorted(((m[1], m[2], m[3]) for m in made if m[0] == s), key=lambda m: (m[0], m[1] is not None, m[1])):
            out.append([i, n, size[s], target[s], 0, 0, None])
            for start in (before, before + size[s]):
                length = min(n, int(target[s]) - start)
                if length > 0:
                    need = min((start + length / 2.0) / target[s], 1.0) * ((low + high) / 2)
                    pieces.append((2 * need / (low + (low * low + 2 * (high - low) * need) ** 0.5), k, start, length, out[-1]))
            before += n
    place = 0
    for _, _, _, length, row in sorted(pieces, key=lambda p: p[:3]):
        row[4] += length
        row[5] += 1
        row[6] = place if row[6] is None else min(row[6], place)
        place += length
    return sorted(map(tuple, out), key=str), place


def test_mixing(spark, docs, rows, empty):
    expected, words = plain_mix(rows)
    clash = {c: F.lit("x") for c in ("size", "key", "copy", "target", "start", "position", "one", "before", "_source")}
    for table in (docs, docs.withColumns(clash), docs.repartition(7)):
        found = sorted(map(tuple, mixing.mixed(table).collect()), key=str)
        assert found == expected
    assert mixing.mixed(empty).count() == 0
    assert sum(r[4] for r in expected) == words and all(r[4] <= 2 * r[1] for r in expected)
    by_source = {}
    for r in expected:
        by_source[r[2], r[3]] = by_source.get((r[2], r[3]), 0) + r[4]
    assert all(target - 1 < taken <= target for (_, target), taken in by_source.items())
    nothing = spark.createDataFrame([(1, None, "en", "a", 0), (2, " ", "en", None, 0)], DOC)
    assert sorted(map(tuple, mixing.mixed(nothing).collect())) == [(1, 0, 0, 0.0, 0, 0, None), (2, 0, 0, 0.0, 0, 0, None)]


def test_copies_are_dealt_out(spark, rows, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 3)
    found = sorted(map(tuple, mixing.mixed(spark.createDataFrame(rows, DOC)).collect()), key=str)
    assert found == plain_mix(rows)[0]


def test_pieces_follow_the_schedules(docs):
    """By any time a source has been taken in proportion to its schedule's integral so far; no gaps in the mix."""
    schedules = ((1.0, 4.0, 1.0, 0.0), (2.0, 2.0, 2.0, 2.0), (0.0, 1.0, 2.0, 3.0))
    _, pieces = mixing.plan(docs, schedules)
    found = sorted(pieces.collect(), key=lambda r: r["place"])
    place = 0
    for a in found:
        assert a["place"] == place
        place += a["length"]
    assert [r["position"] for r in found] == sorted(r["position"] for r in found)
    names = ["", "a", "b", "c", "z", "é", None]
    for k, source in enumerate(names):
        own = [r for r in found if r["source"] == source]
        total, longest = sum(r["length"] for r in own), max((r["length"] for r in own), default=0)
        knots = schedules[k % 3]
        fine = np.interp(np.linspace(0, 1, 3001), np.linspace(0, 1, 4), knots)
        demand = np.append(0, np.cumsum((fine[1:] + fine[:-1]) / 2)) / (((fine[1:] + fine[:-1]) / 2).sum())
        for t in (0.1, 0.35, 0.5, 0.8, 1.0):
            taken = sum(r["length"] for r in own if r["position"] <= t)
            assert abs(taken - demand[int(t * 3000)] * total) <= longest + 0.002 * total + 1
