"""Each stage of the pipeline on odd rows, and all of them against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rnd, n):
    return " ".join("".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(3, 9))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(12)
    bad = ["zorkish", "zorkers", "blimpoid"]
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        lines = [sentence(rnd, 14) for _ in range(4)]
        if toxic:
            lines[rnd.randrange(4)] += f" You {rnd.choice(bad)} {rnd.choice(bad)}."
        rows.append((i, "\n".join(lines), "en", "web", 0))
        labels.append((i, 0, int(toxic)))
    clean = [r for r in rows if r[0] % 5]
    shared = "\n".join(sentence(rnd, 30) for _ in range(3))
    rows += [(1000 + k, clean[k][1], "en", "copy", 0) for k in range(10)]  # exact copies
    rows += [(2000 + k, f"{sentence(rnd, 40)}\n{shared}\n{sentence(rnd, 40)}", "en", "web", 0) for k in range(5)]
    rows += [(3000, None, "en", "web", 0), (3001, "", "en", "web", 0), (3002, "two words", None, None, None), (None, sentence(rnd, 60), None, None, None)]
    rows += [(4000, sentence(rnd, 5000), "en", "long", 0)] * 2  # a repeated row
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit("clash") for c in ("score", "kept", "line_runs", "own_hash")})
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == corpus_pipeline.COLUMNS
        seen[name] = docs = spark.createDataFrame(docs.collect(), DOC)
        docs = docs.withColumn("clash", F.lit("x"))
    of = lambda name: {r.doc_id: r.text for r in seen[name].collect()}
    toxic, good, lines, near = (of(n) for n, _ in corpus_pipeline.STAGES[:-1])
    clean = [i for i in range(300) if i % 5]
    assert sum(i in toxic for i in range(0, 300, 5)) <= 6 and all(i in toxic for i in clean) and {3000, 3001, 3002, None} <= set(toxic)
    assert set(toxic) - set(good) == {3000, 3001, 3002}
    assert set(lines) == set(good) and all(lines[1000 + k] == "" for k in range(10)) and all(lines[2001 + k].count("\n") == 1 for k in range(4)) and lines[2000].count("\n") == 4
    assert set(lines) - set(near) == set(range(1001, 1010)) and seen["near duplicates"].where("doc_id = 4000").count() == 1


def test_run_packs_what_is_left(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    rows = got.collect()
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert {r.doc_id for r in rows} >= {i for i in range(300) if i % 5} and not {3000, 3001, 3002} & {r.doc_id for r in rows}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
