"""The corpus pipeline on a small table, each stage against a plain version."""

import random

import pytest
from test_near_copies import plain_kept
from test_text_operators import plain_components

import corpus_pipeline
from ledgerflow.llm import bpe, decontaminate, exact_dedup, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ta", "ri", "mo", "sel", "ku"]) for _ in range(rng.randrange(1, 6)))
    items = [(k, " ".join(word() for _ in range(30)) + ".\n" + " ".join(word() for _ in range(6)) + ".") for k in range(8)]
    rows, labels = [], []
    for k in range(400):
        words = [word() for _ in range(rng.randrange(60, 200))]
        bad = k % 5 == 0
        if k % 11 == 0:
            words[20:20] = items[k % 8][1].split()
        rows.append((k, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words), "en", f"src{k % 3}", 0))
        labels.append((k, int(not bad), 0))
    rows += [(1000 + k, rows[k][1].replace(" ", "  "), "en", "copy", 0) for k in range(0, 100, 3)]
    for k in range(1, 100, 4):
        near = rows[k][1].split()
        near[len(near) // 2] = "changed"
        rows.append((2000 + k, " ".join(near), "en", "near", 0))
    rows += [(3000, None, None, None, None), (3001, "", "en", "s", 0), (3002, "", "en", "s", 0)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact", "near", "leaks", "tokens"]
    stage = dict(corpus_pipeline.STAGES)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}

    good = stage["quality"](spark, docs, folder)
    left = {r["doc_id"] for r in good.collect()}
    assert good.columns == docs.columns
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert left == {r["doc_id"] for r in quality.grade(docs, model).collect() if r["tail_probability"] >= 0.5}
    assert not any(i < 1000 and i % 5 == 0 for i in left) and all(i in left for i in range(400) if i % 5)

    exact = stage["exact"](spark, good, folder)
    norm = lambda i: texts[i].translate({ord(c): None for c in exact_dedup.SPACES})
    want = {min((j for j in left if norm(j) == norm(i)), key=lambda j: (-len(texts[j]), j)) for i in left}
    assert {r["doc_id"] for r in exact.collect()} == want

    near = stage["near"](spark, exact, folder)
    kept = plain_kept([(i, texts[i]) for i in sorted(want)])
    assert {r["doc_id"] for r in near.collect()} == kept
    assert all(i in kept for i in range(400) if i in want)

    clean = stage["leaks"](spark, near, folder)
    index = decontaminate.Index([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    leaking = {i for i in kept if index.leaks([texts[i]])}
    assert leaking == {i for i in kept if i < 3000 and i % 1000 % 11 == 0}  # copies keep their source number
    assert {r["doc_id"] for r in clean.collect()} == kept - leaking

    tokens = stage["tokens"](spark, clean, folder)
    assert {r["doc_id"] for r in tokens.collect()} == kept - leaking
    assert corpus_pipeline.run(spark, folder).count() == len(kept - leaking)


def test_empty(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_plain_helper():
    assert plain_components([0, 1, 2**40 - 1], 1) == [0, 0, 2] and bpe.SHORT >= 2
