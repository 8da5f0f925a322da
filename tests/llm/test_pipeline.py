"""The pipeline's stages, each on its own input."""

import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from recallgrid.llm import near, quality, toxicity
from recallgrid.llm.common import stored

FOLDER = "/root/testdata/sf0.001"


def test_stages_narrow_down_and_keep_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert kept.columns == columns and kept.count() <= before
            gone = {r["doc_id"] for r in docs.join(kept, "doc_id", "left_anti").collect()}
            if name in ("toxicity", "quality"):
                clean = [i for i, r in labels.items() if not r["toxic"] and r["quality"]]
                assert len(gone & set(clean)) <= 0.05 * len(clean)
            assert kept.where(F.col("n_chars") != F.char_length("text")).isEmpty()
        docs, before = kept, kept.count()
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


def test_run_equals_a_plain_version(spark):
    """The classifiers' decisions, then groups by all pairs, byte strings in a dictionary, and the tokenizer's ids."""
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    for model in (toxicity, quality):
        scored = model.score_documents(docs, model.train(docs, labels))
        docs = stored(scored.where("predicted = 0" if model is toxicity else "predicted = 1").select(*docs.columns), "plain")
    texts = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    words = {i: t.lower().split() for i, t in texts}
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, w in words.items()}
    first = {i: i for i, _ in texts}
    for i, _ in texts:  # ids ascend, so a group's first is its smallest
        for j, _ in texts:
            if j < i and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((first[i], first[j]))
                first = {k: a if f == b else f for k, f in first.items()}
    seen, left = set(), {}
    for i, text in texts:
        if first[i] == i:
            data, cut = text.encode(), set()
            for k in range(len(data) - 99):
                if data[k : k + 100] in seen:
                    cut.update(range(k, k + 100))
                seen.add(data[k : k + 100])
            kept = bytes(b for k, b in enumerate(data) if k not in cut)
            if kept or not cut:
                left[i] = kept.decode(errors="ignore")
    tokens, expected, total = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), [], 0
    for i, text in left.items():
        ids = [*tokens.encode(text, add_special_tokens=False).ids, 0]
        total += len(ids)
        expected += [(i, n, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], dtype="<u4").tobytes())) for n, a in enumerate(range(0, len(ids), 2048))]
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(expected)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 2048) + 1


def test_empty_documents(spark, tmp_path):
    for table in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("cell", [20_000, 16])
def test_near_duplicates_are_those_of_similarity_08(spark, tmp_path, monkeypatch, cell):
    """Planted copies on both sides of 0.8, a chain and a large group, against the exact groups of all pairs."""
    monkeypatch.setattr(near, "CELL", cell)
    random.seed(9)
    word = lambda: "".join(random.choices("abcdefghijklmnop", k=6))
    texts = []
    for changes in [*range(1, 9)] * 12:
        base = [word() for _ in range(random.randint(60, 300))]
        edited = list(base)
        for _ in range(changes):
            edited[random.randrange(len(edited))] = word()
        texts += [base, edited]
    large = [word() for _ in range(150)]
    for i in range(60):
        texts.append(large[: 2 * i % 150] + [word()] + large[2 * i % 150 + 1 :])
    chain = [word() for _ in range(200)]
    for i in range(10):
        chain = chain[12:] + [word() for _ in range(12)]
        texts.append(chain)
    star = [word() for _ in range(200)]
    for _ in range(60):  # each 0.8 or so like the first of them, but not like each other
        copy = list(star)
        for at in random.sample(range(190), random.randint(1, 4)):
            copy[at] = word()
        texts.append(copy)
    texts.append(star)
    texts += [[], [], ["one"], ["one"], ["One", "two"]]
    random.shuffle(texts)
    sets = [frozenset(tuple(x.lower() for x in t[i : i + 5]) for i in range(max(1, len(t) - 4))) for t in texts]
    root, found = list(range(len(texts))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
                found += 1
    assert found > 1000
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/docs"), FOLDER)
    assert kept.columns == ["doc_id", "text"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({find(i) for i in range(len(texts))})


def _peak_mb(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_training_keeps_little_on_the_driver(spark, tmp_path):
    """Of toxicity the driver holds what entries the rows have: 3,000 rows of 890 features would be 10 MB, twice that in double precision."""
    random.seed(5)
    words = ["".join(random.choices("abcdefghijklmnop", k=8)) for _ in range(300)]
    rows = [(i, " ".join(random.choices(words[:150] if i % 2 else words, k=6))) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs, labels = spark.read.parquet(f"{tmp_path}/d"), spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id long, toxic int")
    model, peak = _peak_mb(lambda: toxicity.train(docs, labels, parts=3001, held=3000))
    assert len(model.weights) > 800 and peak < 8
    x = np.random.default_rng(1).random((8000, len(quality.MARKS) + 18))
    model, peak = _peak_mb(lambda: quality.fit(x[:3000] * 0.9, x[3000:], prior=0.4))
    assert len(model.weights) > 100 and peak < 3.2 * (x.nbytes * 3 / 1e6)


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_sparse_rows_multiply_as_dense_ones(block):
    random_numbers = np.random.default_rng(3)
    dense = np.where(random_numbers.random((50, 30)) < 0.2, random_numbers.random((50, 30)), 0)
    dense[10:14] = 0
    of = toxicity.Rows.of(dense)
    rows = toxicity.Rows(of.at, of.value, of.lengths, 30, block)
    w, r = random_numbers.random(30), random_numbers.random(50)
    assert np.allclose(rows.times(w), dense @ w) and np.allclose(rows.turned_times(r), dense.T @ r)
    assert toxicity.Rows.of(dense[:0]).times(w).shape == (0,) and not toxicity.Rows.of(dense[:0]).turned_times(r[:0]).any()
