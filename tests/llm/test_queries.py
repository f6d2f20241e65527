"""Every registered text query, called as it is registered, against plain versions."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_near_copies import plain_kept
from test_text_operators import near_texts, plain_components, plain_fingerprint, plain_leaks

import __spark_entry__
from ledgerflow.llm import decontaminate, quality, shared, toxicity
from ledgerflow.llm.queries import ORACLES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables with every kind of row: copies, near copies, leaks, toxic and bad texts, nulls, empties and a long text."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["ta", "ri", "mo", "sel", "ku", "ben"]) for _ in range(rng.randrange(1, 5)))
    items = [(k, " ".join(word() for _ in range(30)) + "?\n" + " ".join(word() for _ in range(12))) for k in range(6)]
    rows, labels = [], []
    for k in range(360):
        words = [word() for _ in range(rng.randrange(20, 90))]
        toxic, bad = rng.random() < 0.25, k % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "scum", "zorgface"])
        if bad:
            words = [w.upper() + "!!" for w in words]
        if k % 13 == 0:
            words[10:10] = items[k % 6][1].split()
        rows.append((k, " ".join(words), ("en", "de")[k % 2] if k % 7 else None, f"s{k % 3}"))
        labels.append((k, int(not bad), int(toxic)))
    rows += [(400 + k, t, "en", "near") for k, t in enumerate(near_texts(4, 60))]
    rows += [(500 + k, rows[k][1].replace(" ", " \n"), "en", "copy") for k in range(0, 60, 5)]
    rows += [(600, None, None, None), (601, "", "en", "s"), (602, " \t", "en", "s"), (603, "ta ri " * 30_000, "en", "long"), (604, "a <|endoftext|> b", "de", "s")]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    pages = [(k, f"http://site{k % 4}.example/{k % 9}", None if k == 5 else f"<p>{k % 11}</p>") for k in range(60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2).write.parquet(str(path / "pages.parquet"))
    return str(path), {i: t for i, t, *_ in rows}, {i: (q, t) for i, q, t in labels}, items


def run(spark, folder, name):
    return [r.asDict() for r in __spark_entry__.queries()[name](spark, folder[0]).collect()]


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def digest(ids):
    return np.array(ids, "<u4").tobytes()


def test_op1(spark, folder):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in folder[1].items():
        ids = plain.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(digest(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, folder, "op1_bpe")} == want


def test_op2(spark, folder):
    from tokenizers import Tokenizer

    plain, want, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}, 0
    for i in sorted(folder[1]):
        ids = [*plain.encode(folder[1][i] or "", add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(digest(ids)))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, folder, "op2_token_store")} == want


def plain_features(text, words, stems):
    """The toxicity features by their definitions, token by token."""
    tokens = (text or "").split()
    if not tokens:
        return [0.0] * len(toxicity.Features.NAMES)
    flags = [toxicity.token_flags(t, frozenset(words), frozenset(stems)) for t in tokens]
    has = lambda *bits: [k for k, f in enumerate(flags) if any(f & b for b in bits)]
    hot, you = has(toxicity.HIT, toxicity.LEARNED, toxicity.STEM, toxicity.MASKED_HIT), has(toxicity.YOU)
    near = sum(any(abs(h - y) <= toxicity.NEAR for y in you) for h in hot)
    raw, n = text.encode(), len(tokens)
    share = lambda test: sum(map(test, raw)) / len(raw)
    mark = lambda b: 33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127
    hits, learned, stem = len(has(toxicity.HIT)), len(has(toxicity.LEARNED)), len(has(toxicity.STEM))
    return [
        math.log(1 + n), min(hits, 20), hits / n, min(learned, 20), learned / n, min(stem, 20), stem / n, len(you) / n, near / max(1, len(hot)),
        share(lambda b: 65 <= b < 91), share(mark), share(lambda b: b == 33), share(lambda b: 48 <= b < 58),
        len(has(toxicity.MASKED)) / n, min(len(has(toxicity.MASKED_HIT)), 20), len(has(toxicity.STRETCHED)) / n,
    ]


def plain_margin(trees, x):
    """Boosted trees walked node by node for one row."""
    out = trees.base
    for feature, cut, value in trees.trees:
        at = 1
        for _ in range(toxicity.DEPTH):
            f = feature[at]
            right = f >= 0 and sum(x[f] >= e for e in trees.edges[f]) > cut[at]
            at = 2 * at + int(right)
        out += value[at]
    return out


def test_op3(spark, folder):
    got = {r["doc_id"]: r for r in run(spark, folder, "op3_toxicity")}
    assert got.keys() == folder[1].keys()
    docs, labels = (spark.read.parquet(f"{folder[0]}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    for i, t in folder[1].items():
        margin = plain_margin(model.trees, plain_features(t, model.words, model.stems))
        want = 0.98 * float(np.interp(margin, *model.points)) + 0.02 / (1 + math.exp(-margin))
        assert got[i]["score"] == pytest.approx(min(1.0, max(0.0, want)), abs=1e-9)
        assert got[i]["held_out"] == held(i) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)
    toxic = [i for i, (_, y) in folder[2].items() if y and held(i)]
    clean = [i for i, (_, y) in folder[2].items() if not y and held(i)]
    assert np.mean([got[i]["predicted"] for i in toxic]) > 0.8 and np.mean([got[i]["predicted"] for i in clean]) < 0.1


def test_isotonic_is_the_best_monotone_fit():
    """Against the minimax formula of isotonic regression: the largest over starts of the least mean over ends."""
    rng = np.random.default_rng(5)
    x, y = rng.permutation(40).astype(float), rng.integers(0, 2, 40).astype(float)
    points = toxicity.isotonic(x, y)
    z = y[np.argsort(x)]
    for k in range(40):
        best = max((min((z[a : b + 1].mean(), b - a + 1) for b in range(k, 40)) for a in range(k + 1)), key=lambda m: m[0])
        got = float(np.interp(float(k), *points))
        assert abs(got - best[0]) <= 0.03  # an imagined 0.02 of a row of either class keeps it off 0 and 1


def plain_row(text):
    """The quality features by their definition: counts of words, of shapes and of repeats, as square roots of shares."""
    tokens, out = (text or "").split(), Counter()
    if not tokens:
        return {}
    families = {"w": Counter(quality.hashed("w", t.lower()) for t in tokens), "s": Counter(quality.hashed("s", quality.shape(t)) for t in tokens)}
    again = sum(a == b for a, b in zip(tokens, tokens[1:]))
    families["r"] = Counter({quality.hashed("r", "1"): again, quality.hashed("r", "0"): len(tokens) - again})
    for name, weight in quality.FAMILIES:
        for at, n in families[name].items():
            out[at] += weight * math.sqrt(n / len(tokens))
    return out


def test_op8(spark, folder):
    got = {r["doc_id"]: r for r in run(spark, folder, "op8_quality")}
    assert got.keys() == folder[1].keys()
    docs, labels = (spark.read.parquet(f"{folder[0]}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    logistic = lambda z: 1 / (1 + math.exp(-z))
    for i, t in folder[1].items():
        margin = sum(model.weights[at] * v for at, v in plain_row(t).items())
        tails = [logistic(margin - c) for c in model.thresholds]
        assert got[i]["tail_probability"] == pytest.approx(tails[0], abs=1e-5)
        assert got[i]["expected_grade"] == pytest.approx(model.grades[0] + sum(p * d for p, d in zip(tails, np.diff(model.grades))), abs=1e-5)
        assert got[i]["held_out"] == held(i) and got[i]["kept"] == (got[i]["tail_probability"] >= 0.5)
    asked = [i for i in folder[2] if held(i)]
    assert np.mean([got[i]["kept"] == bool(folder[2][i][0]) for i in asked]) > 0.95


def test_cumulative_link_fit_is_the_optimum():
    """No small change of any weight or threshold lowers the penalised loss, computed row by row."""
    rng = np.random.default_rng(2)
    rows = [(np.array([k % 4, 4 + k % 3], np.int32), np.array([1.0, 0.5], np.float32)) for k in range(200)]
    y = np.array([min(2, max(0, (k % 4) // 2 + rng.integers(0, 2))) for k in range(200)], float)
    model = quality.fit_rows(rows, y)

    def loss(weights, thresholds):
        total = 0.0
        for (at, value), g in zip(rows, y.astype(int)):
            margin = float(weights[at] @ value)
            upto = [0.0, *(1 / (1 + math.exp(margin - c)) for c in thresholds), 1.0]
            total -= math.log(upto[g + 1] - upto[g])
        return total / len(rows) + quality.RIDGE / 2 * float((weights**2).sum())

    best = loss(model.weights, model.thresholds)
    for k in range(7):
        for step in (-0.3, 0.3):
            assert loss(model.weights + step * (np.arange(len(model.weights)) == k), model.thresholds) > best
    for k in range(2):
        for step in (-0.2, 0.2):
            assert loss(model.weights, model.thresholds + step * (np.arange(2) == k)) > best


def test_op5(spark, folder):
    got = {r["doc_id"]: r for r in run(spark, folder, "op5_language")}
    assert got.keys() == folder[1].keys()
    for i, t in folder[1].items():
        assert got[i]["held_out"] == held(i) and 0 <= got[i]["score"] <= 1
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) and got[i]["lang_pred"] in ("en", "de", "und")


def test_op6(spark, folder):
    ids = sorted(folder[1])
    want = {(ids[k], i) for k, i in plain_leaks([folder[1][i] or "" for i in ids], folder[3])}
    got = run(spark, folder, "op6_decontaminate")
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) >= 28
    assert all(r["overlap"] >= decontaminate.LEAST_OVERLAP and r["bm25_share"] >= decontaminate.LEAST_SCORE - 1e-5 for r in got)


def test_op10(spark, folder):
    ids = sorted(folder[1])
    prints = [plain_fingerprint(folder[1][i], 4) for i in ids]
    parts = plain_components(prints, 4)
    want = {i: (f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, parts)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, folder, "op10_simhash")} == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, folder, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        c.execute(f"create view {t} as select * from '{folder[0]}/{t}.parquet/*.parquet'")
    want = c.sql(ORACLES[name])
    got = run(spark, folder, name)
    order = sorted(want.columns)
    assert sorted(got[0]) == order
    at = [want.columns.index(x) for x in order]
    assert sorted(str([r[x] for x in order]) for r in got) == sorted(str([r[k] for k in at]) for r in want.fetchall())


def test_pipeline_near_stage_on_the_same_texts(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["near"](spark, docs, folder[0])
    assert {r["doc_id"] for r in kept.collect()} == plain_kept(sorted(folder[1].items()))
    assert shared.BROADCAST_ROWS > 0
