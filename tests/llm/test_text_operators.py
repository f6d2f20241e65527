"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, and against plain versions."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgerflow.llm import bpe, components, decontaminate, exact_dedup, language, licenses, quality, shared, simhash, token_store, toxicity, warc

CLASHING = [f"'x' as {c}" for c in ("_id", "_text", "f0", "keep_id", "component_id", "digest", "license", "ids", "score", "_norm", "part")]
ODD = [None, "", " \t\n", "a", "A b\tc", "ab c", "AbC", "the cat sat on the mat", "the cat sat on the mat ", "x" * 3000, "é漢字😀 \x85end", "\x1c a", "12 34's we'll", "the cat sat on the mat"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "a"), (None, "a"), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *CLASHING)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def tiktoken_encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# ---- byte-level BPE


def test_bpe_against_library(odd, none):
    plain = tiktoken_encoding()
    out = bpe.encode(odd, decoded=True).collect()
    texts = [r["text"] or "" for r in odd.collect()]
    assert len(out) == len(texts)
    for r, t in zip(out, texts):
        assert np.frombuffer(r["ids"], "<u4").tolist() == plain.encode_ordinary(t)
        assert r["decoded"] == t.encode() and r["n_tokens"] == len(r["ids"]) // 4
    again = bpe.decode(bpe.encode(odd)).collect()
    assert [bytes(r["decoded"]) for r in again] == [t.encode() for t in texts]
    assert bpe.encode(none).count() == 0


def test_bpe_random_texts():
    plain, rng = tiktoken_encoding(), random.Random(1)
    table, store = bpe.codec(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    parts = ["a", "b", " ", "  ", "\n", "é", "ß", "the", "'s", "1", "!!", "漢", "😀", "²", "ab" * 60, "_"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(500)]
    for t, ids in zip(texts, store.texts(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(t)
    for t in texts[:100]:  # one tree and many trees agree
        piece = t.encode()[: bpe.SHORT]
        assert bpe.merge_one(piece, table) == bpe.merge_many([piece], table)[0]


# ---- token store


MARK = "<|endoftext|>"


def test_token_store(spark, odd, none):
    """Against an unmodified tokenizer, also where a text spells the added token."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    marked = [f"{MARK} a", f"a {MARK} b", f"a b{MARK}", MARK, MARK * 2, f" {MARK}\n{MARK} ", "<|endoftext", "a <|EndOfText|>"]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(marked)], "doc_id long, text string"))
    folder = token_store.write_tokens(docs, files=3)
    out = sorted(token_store.read_tokens(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == sorted((r["doc_id"] for r in docs.collect()), key=lambda i: (i is not None, i))
    at = 0
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in docs.collect())
    assert sum(50256 in ids for _, ids in want) == 6
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, np.frombuffer(r["ids"], "<u4").tolist()) for r in out) == want
    for r in out:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    some = token_store.read_tokens(spark, folder, [9, 7, 50]).collect()
    assert {r["doc_id"] for r in some} == {7, 9}
    wide = token_store.read_tokens(spark, token_store.write_tokens(docs.limit(3), end_id=70_000)).collect()
    assert all(np.frombuffer(r["ids"], "<u4")[-1] == 70_000 for r in wide)
    assert token_store.read_tokens(spark, token_store.write_tokens(none, files=3)).count() == 0


def test_one_id_of_many_rows(spark):
    """Rows of one id are dealt to several files, and every document comes back whole."""
    rows = [(7, f"text {k} " + "word " * (k % 5)) for k in range(300)]
    folder = token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), files=4)
    out = sorted(token_store.read_tokens(spark, folder).collect(), key=lambda r: r["start"])
    plain = tiktoken_encoding()
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in out) == sorted([*plain.encode_ordinary(t), 0] for _, t in rows)
    assert [r["start"] for r in out] == np.cumsum([0, *(len(r["ids"]) // 4 for r in out[:-1])]).tolist()
    assert len(token_store.read_tokens(spark, folder, [7]).collect()) == 300 and token_store.read_tokens(spark, folder, [6, 8]).count() == 0


def test_piece_store_generations():
    """A store that forgets gives the same ids."""
    from ledgerflow.llm.pieces import PieceStore

    seen = []
    store = PieceStore(public_tokenizers.PATTERN, lambda pieces: (seen.append(len(pieces)), [p.encode() for p in pieces])[1], most=5)
    texts = ["a b c d e f", "a b", "g h i j k l m", "a b g", ""]
    for _ in range(3):
        assert store.texts(texts) == [t.encode() for t in texts]
        assert [store.texts([t]) for t in texts] == [[t.encode()] for t in texts]
    assert sum(seen) > 14


def test_frames(tmp_path):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50_000, n, np.uint32) for n in (0, 5, 400_000, 3, 70_000)]
    writer = token_store.FrameWriter(2)
    data = b"".join([c for k, d in enumerate(docs) for c in writer.add(k, d)] + list(writer.end()))
    (tmp_path / "f").write_bytes(data)
    with open(tmp_path / "f", "rb") as f:
        reader = token_store.FrameReader(f, len(data))
        assert np.array_equal(reader.document(1), docs[1]) and reader.frames_read == 1
        assert all(np.array_equal(reader.document(k), d) for k, d in enumerate(docs))
    damaged = bytearray(data)
    damaged[200] ^= 1
    (tmp_path / "g").write_bytes(damaged)
    with open(tmp_path / "g", "rb") as f, pytest.raises(Exception):
        token_store.FrameReader(f, len(data)).document(2)


# ---- exact dedup


def test_exact_ids(spark):
    """One row of a group stays where an id repeats, by its length; rows without an id give way; ids of their own drop by id."""
    rows = [(1, "a b"), (1, "ab"), (2, "ab"), (3, "c"), (None, "c  "), (4, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda df: sorted(((r["doc_id"] or 0, r["text"]) for r in df.collect()))
    assert kept(exact_dedup.exact_groups(docs).join(docs.limit(0), ["doc_id"], "left").where("kept").select("doc_id", "text_sha256").withColumnRenamed("text_sha256", "text"))[0][0] == 1
    assert exact_dedup.exact_groups(docs).where("kept").count() == 3
    assert kept(exact_dedup.drop_exact_copies(docs)) == [(1, "a b"), (3, "c"), (4, "d")]
    own = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)] + [(None, "d "), (9, None), (10, "")], "doc_id long, text string")
    assert kept(exact_dedup.drop_exact_copies(own)) == [(0, "a b"), (4, "c  "), (5, "d"), (9, None)]


def test_exact(odd, none, monkeypatch):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    norm = lambda t: t.translate({ord(c): None for c in exact_dedup.SPACES})
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t), i if i is not None else 1 << 62, i))
    want = []
    for i, t in rows:
        named = [g for g in groups[norm(t)] if g[2] is not None]
        size, _, best = min(named) if named else (None, None, None)
        want.append((str(i), best, len(groups[norm(t)]), i == best and size in (None, -len(t)), hashlib.sha256(norm(t).encode()).hexdigest()))
    for limit in (exact_dedup.REPEATED, 0):  # texts of repeated digests, and all texts
        monkeypatch.setattr(exact_dedup, "REPEATED", limit)
        got = exact_dedup.exact_groups(odd).collect()
        assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == sorted(want, key=str)
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns
    assert len(kept.collect()) == len(groups) == len({norm(r["text"] or "") for r in kept.collect()})


# ---- SimHash


def plain_fingerprint(text, words):
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    grams = [b" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_components(prints, bits):
    up = list(range(len(prints)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= bits:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(prints))]


def near_texts(seed, n=160):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 120))] for _ in range(12)]
    out = []
    for _ in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
        out.append(" ".join(words))
    return out


def test_simhash(spark, odd, none):
    texts = near_texts(3) + [t for t in ODD if t is not None]
    out = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    prints = [plain_fingerprint(t, 4) for t in texts]
    assert [r["f0"] % 2**64 for r in out] == prints
    assert [r["component_id"] for r in out] == plain_components(prints, 4)
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.near_duplicates(odd).count() == odd.count()
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns


def test_simhash_ids_of_several_texts(spark):
    """An id with several texts is one node, so it joins their groups."""
    a, b, c = "one two three four five", "six seven eight nine ten", "other words again and again"
    rows = [(3, a), (5, a), (5, b), (9, b), (11, c), (None, b), (None, c + " x")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in out.where("doc_id is not null").collect()) == [(3, 3), (5, 3), (5, 3), (9, 3), (11, 11)]
    assert sorted((r["component_id"] or 0) for r in out.where("doc_id is null").collect()) == [0, 3]


@pytest.mark.parametrize("bucket, bits", [(simhash.BUCKET, 4), (simhash.BUCKET, 9), (40, 9), (8, 4)])
def test_links_lose_nothing(spark, monkeypatch, bucket, bits):
    """Dense clusters and small bucket limits, against all pairs."""
    rng = random.Random(bits)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (2**64 - 1) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(60)})
    reps = spark.createDataFrame([(k, v - 2**64 if v >= 2**63 else v) for k, v in enumerate(prints)], "rep long, f0 long")
    large = []
    monkeypatch.setattr(simhash, "written", lambda df, name: (out := shared.written(df, name), name == "large-buckets" and large.append(out.count()))[0])
    links = simhash.near_links(reps, bits, bucket=bucket)
    assert bucket != 8 or sum(n > 0 for n in large) >= 2  # some stay large after one deal
    found = dict(components.connected_components(links).collect())
    assert [found.get(k, k) for k in range(len(prints))] == plain_components(prints, bits)


def test_plan_of_thresholds():
    sample = np.random.default_rng(0).integers(0, 2**63, 500, np.int64).view(np.uint64)
    for bits in (1, 4, 10):
        parts, limits = simhash.plan_thresholds(sample, 100_000, bits)
        assert sorted(b for p in parts for b in p) == list(range(64))
        assert sum(t + 1 for t in limits) == bits + 1 and min(limits) >= -1


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 4), (9, 8), (8, 7), (7, 6), (6, 5), (None, 1)], "a long, b long")
    assert dict(components.connected_components(links).collect()) == {1: 1, 2: 1, 3: 1, **{k: 4 for k in range(4, 10)}}
    assert components.connected_components(links.limit(0)).count() == 0


# ---- licences


def test_licenses(spark, odd, none):
    mit = licenses.known_texts()[1][1]
    rows = [(1, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(" ", "  ")), (2, "Some text.\nReleased under the MIT Licence!\nmore"), (3, "Licensed under CC BY-NC 4.0."), (3, "Licensed under CC BY-NC 4.0."), (4, mit + " extra"), (5, None)]
    out = sorted(tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_digest").collect() if True)
    assert [(r[0], r[1]) for r in out] == [(1, "MIT"), (2, None), (3, "CC-BY-NC-4.0"), (3, "CC-BY-NC-4.0"), (4, None), (5, None)]
    assert [r[2] for r in out][1:4] == ["MIT", "CC-BY-NC-4.0", "CC-BY-NC-4.0"]
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).count() == 0


# ---- decontamination


def plain_leaks(texts, items):
    found = set()
    for k, t in enumerate(texts):
        tokens = decontaminate.words(t)
        have = {tuple(tokens[a : a + n]) for n in range(1, 6) for a in range(len(tokens) - n + 1)}
        for i, text in items:
            whole, (q, a) = decontaminate.words(text), decontaminate.question_and_answer(text)
            grams = lambda p, n: {tuple(p[k : k + n]) for k in range(max(1, len(p) - n + 1))} if p else set()
            share = lambda p, n: sum(g in have for g in grams(p, n)) / len(grams(p, n)) if p else 1.0
            part = lambda p: share(p, 5 if len(p) >= 10 else 1)
            if whole and share(whole, min(5, len(whole))) >= 0.8 and min(part(q), part(a)) >= 0.5:
                found.add((k, i))
    return found


def test_leaks(spark, odd, none):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) for _ in range(rng.randrange(1, 5)))
    items = [(k, " ".join(word() for _ in range(rng.randrange(8, 150))) + "?\n" + " ".join(word() for _ in range(rng.randrange(1, 12))) + ".") for k in range(40)] + [(40, ""), (41, None)]
    texts = []
    for k in range(120):
        filler = [word() for _ in range(rng.randrange(0, 300))]
        if k % 3 == 0:
            at = rng.randrange(len(filler) + 1)
            filler[at:at] = items[rng.randrange(40)][1].split()
        texts.append(" ".join(filler))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)) + [(500, None), (501, "")], "doc_id long, text string")
    want = plain_leaks(texts, [(i, t) for i, t in items if t])
    assert len(want) >= 40
    for limit in (decontaminate.INDEX_LIMIT, 11):
        got = decontaminate.find_leaks(docs, benchmark, limit=limit).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want
    for limit in (decontaminate.INDEX_LIMIT, 11):
        clean = decontaminate.drop_leaks(docs, benchmark, limit=limit)
        assert {r["doc_id"] for r in clean.collect()} == {*range(120), 500, 501} - {d for d, _ in want}
    assert decontaminate.find_leaks(none, benchmark).count() == 0
    assert decontaminate.find_leaks(odd, benchmark.limit(0)).count() == 0
    assert decontaminate.drop_leaks(odd, benchmark).columns == odd.columns


def test_one_block_at_a_time(spark, monkeypatch):
    """Of several blocks, each index is given up before the next is broadcast."""
    alive, most = [0], [0]
    make = decontaminate._broadcast

    def counted(session, index):
        real = make(session, index)
        alive[0] += 1
        most.append(alive[0])
        end = real.destroy
        real.destroy = lambda *a: (alive.__setitem__(0, alive[0] - 1), end(*a))
        return real

    monkeypatch.setattr(decontaminate, "_broadcast", counted)
    monkeypatch.setattr(decontaminate, "INDEX_CHARS", 200)
    items = [(k, " ".join(f"w{k}x{j}" for j in range(14))) for k in range(9)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in items] + [(99, "nothing here")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, benchmark).collect()} == {(k, k) for k, _ in items}
    assert [r["doc_id"] for r in decontaminate.drop_leaks(docs, benchmark).collect()] == [99]
    assert len(most) > 6 and max(most) == 1 and alive == [0]


def test_short_answers_and_plain_items():
    """One changed word of a short answer is still a leak; an item without question and answer is decided by its whole share."""
    question = " ".join(f"q{k}" for k in range(40))
    index = decontaminate.Index([(0, question + "?\nthe five word answer is"), (1, ". ".join(f"s{k} t{k} u{k}" for k in range(20)) + ".")])
    assert [i for _, i, *_ in index.leaks([question + " the five word reply is"])] == [0]
    assert index.leaks([question + " something else altogether now here"]) == []
    cut = " ".join(f"s{k} t{k} u{k}" for k in range(18))
    assert [i for _, i, *_ in index.leaks([cut])] == [1]


def test_search_finds_all_above_threshold():
    rng = random.Random(4)
    items = [(k, " ".join(f"t{int(rng.expovariate(0.05))}" for _ in range(rng.randrange(5, 40)))) for k in range(80)]
    index = decontaminate.Index(items)
    for _ in range(50):
        query = sorted({index.terms[w] for w in decontaminate.words(rng.choice(items)[1]) + [f"t{rng.randrange(60)}" for _ in range(10)] if w in index.terms})
        scores = {}
        for t in query:
            for entries in index.postings[t].values():
                for s, x in entries:
                    scores[s] = scores.get(s, 0.0) + x
        for least in (0.3, 0.6):
            got = {s for b in range(index.block_max.shape[1]) for s, _ in index.search(query, b, least)}
            assert got == {s for s, x in scores.items() if x >= least - 1e-9}


# ---- language


def test_language(spark, odd, none):
    rng = random.Random(1)
    bank = {"en": "the and with house water people time there".split(), "de": "der und nicht haus wasser leute zeit schon".split(), "xx": "qua zor plim vek".split()}
    rows = [(k, l, " ".join(rng.choices(bank[l], k=30))) for k in range(120) for l in [rng.choice(list(bank))]]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    out = language.predict(docs, language.fit(docs)).join(docs, "doc_id")
    assert out.where("lang_pred <> lang").count() == 0 and out.where("score < 0.5 or score > 1").count() == 0
    model = language.fit(docs)
    strange = language.predict(odd, model).collect()
    assert len(strange) == odd.count()
    assert all((r["lang_pred"] == "und") == (not language.words(t["text"])) for r, t in zip(strange, odd.collect()))
    nothing = language.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(none, model).count() == 0


def test_forward_sums_all_segmentations():
    pieces = {"▁a": 0, "▁ab": 1, "b": 2, "bc": 3, "c": 4, "▁": 5}
    chances = {p: [0.1 * (p + 1)] for p in pieces.values()}

    def total(rest):
        if not rest:
            return 1.0
        out = language.UNKNOWN * total(rest[1:])
        for w, p in pieces.items():
            if rest.startswith(w):
                out += chances[p][0] * total(rest[len(w) :])
        return out

    assert language.forward("abc", pieces, 3, chances, 1)[0] == pytest.approx(np.log(total("▁abc")))
    long = language.forward("ab" * 3000, pieces, 3, chances, 1)[0]
    assert np.isfinite(long) and long < 0
    model = language.Model({"x": {p: c[0] for p, c in chances.items()}}, {"x": 1}, pieces)
    scorer = language.Scorer(model, pieces)
    scorer.learn(["abc", "cab", "zzz", "ab" * 3000])
    for w, at in scorer.known.items():
        assert scorer.scores[at] == pytest.approx(language.forward(w, pieces, 3, model.chances, 1), rel=1e-9)


# ---- toxicity and quality


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(600):
        words = ["".join(rng.choice(["ta", "ri", "mo", "sel"]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(15, 60))]
        toxic, bad = rng.random() < 0.2, rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "scum", "zorgface", "zorglip"])
        if bad:
            words = [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, int(not bad) + int(not bad and k % 2 == 0), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string").persist(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").persist()


def test_toxicity(labelled, odd, none):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).join(labels, "doc_id").where(shared.crc_bucket("doc_id") == 2).toPandas()
    hit, toxic = out["score"] >= 0.3, out["toxic"] == 1
    assert (hit & toxic).sum() >= 0.9 * toxic.sum() and (hit & ~toxic).sum() <= 0.05 * (~toxic).sum()
    strange = [r["score"] for r in toxicity.score(odd, model).collect()]
    assert len(strange) == odd.count() and all(0 <= s <= 1 for s in strange)
    assert toxicity.score(none, model).count() == 0
    blank = toxicity.fit(docs, labels.limit(0))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, blank).collect())


def test_isotonic_and_flags():
    x, y = toxicity.isotonic(np.array([3.0, 1.0, 2.0, 2.0, 4.0]), np.array([1.0, 0.0, 1.0, 0.0, 0.0]))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all() and 0 < y[0] and y[-1] < 1
    flags = lambda t: toxicity.token_flags(t, frozenset(), frozenset())
    assert flags("Idiot,") & toxicity.HIT and not flags("plain") and flags("1d10t") & toxicity.MASKED_HIT
    assert flags("id1ot") & toxicity.MASKED_HIT and flags("i.d.i.o.t") & toxicity.MASKED_HIT and flags("you") & toxicity.YOU


def test_quality(labelled, odd, none):
    docs, labels = labelled
    model = quality.fit(docs, labels)
    assert len(model.thresholds) == 2 and (np.diff(model.thresholds) > 0).all()
    out = quality.grade(docs, model).join(labels, "doc_id").where(shared.crc_bucket("doc_id") == 2).toPandas()
    assert ((out["tail_probability"] >= 0.5) == (out["quality"] >= 1)).mean() > 0.97
    assert out["expected_grade"].between(0, 2).all()
    kept = quality.select_good(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == quality.grade(docs, model).where("tail_probability >= 0.5").count()
    assert quality.select_good(odd, model).columns == odd.columns and quality.grade(odd, model).count() == odd.count()
    assert quality.grade(none, model).count() == 0 and quality.select_good(none, model).count() == 0
    blank = quality.fit(docs, labels.limit(0))
    assert quality.select_good(docs, blank).count() == docs.count()


def test_cumulative_link_gradient():
    """The fit is at a stationary point: no small change of a threshold lowers the loss."""
    rng = np.random.default_rng(0)
    rows = [(np.array([k % 3], np.int32), np.array([1.0], np.float32)) for k in range(300)]
    y = np.array([min(2, (k % 3) + rng.integers(0, 2)) for k in range(300)], float)
    model = quality.fit_rows(rows, y)

    def loss(m):
        tail = m.at_least(np.array([m.weights[a[0]] for a, _ in rows]))
        p = np.concatenate([tail[:, :-1] - tail[:, 1:], tail[:, -1:]], 1)
        return -np.log(p[np.arange(300), y.astype(int)]).mean() + quality.RIDGE / 2 * (m.weights**2).sum()

    for k in range(2):
        for step in (-0.2, 0.2):
            moved = quality.Model(model.grades, model.weights, model.thresholds + step * (np.arange(2) == k))
            assert loss(moved) > loss(model)


# ---- WARC


@pytest.mark.parametrize("fan_in", [64, 2])
def test_warc(spark, fan_in):
    html = ["", None, "<p>a</p>", "<p>é</p>", "<p>a</p>", "x" * 100_000, "", "<p>a</p>"]
    rows = [(k, f"http://www.Site{k % 3}.example/p?q={k % 2}#f" if k % 5 else None, t) for k, t in enumerate(html)] + [(4, "http://b/", "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as _id", "'y' as payload").repartition(5)
    folder, runs = warc.write_archives(pages)
    index = warc.capture_index(spark, folder, runs, fan_in)
    entries = index.orderBy("shard").collect()
    keys = [(r["url_key"], r["captured_at"], r["page_id"]) for r in entries]
    assert keys == sorted(keys) and len(keys) == len(rows)
    out = warc.read_records(index, folder, payloads=True).collect()
    top = {}
    for k, _, t in rows:
        top[t or ""] = max(k, top.get(t or "", -1))
    want = []
    for k, _, t in rows:
        data = (t or "").encode()
        first = top[t or ""] == k
        want.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else top[t or ""], data if first else None))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_warc_edges(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder, runs = warc.write_archives(pages)
    assert warc.read_records(warc.capture_index(spark, folder, runs), folder).count() == 0
    small = spark.createDataFrame([(1, "http://a/", "xy"), (2, "http://a/", "xy")], "page_id long, url string, html string")
    folder, runs = warc.write_archives(small, least_payload=3)
    assert {r["record_type"] for r in warc.read_records(warc.capture_index(spark, folder, runs), folder).collect()} == {"response"}


def test_url_keys():
    assert warc.url_key("HTTPS://user@www.Example.COM:443/A b?x#frag") == "com,example)/A%20b?x"
    assert warc.url_key("http://example.com:8080") == "com,example:8080)/"
    assert warc.url_key(None) == "-" and warc.url_key("http://[bad") == "http://[bad"


def test_loser_tree():
    rng = random.Random(0)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


# ---- shared


def test_held_out_rule(spark):
    rows = spark.range(50).select("id", (shared.crc_bucket("id") == 2).alias("h")).collect()
    assert [r["h"] for r in rows] == [zlib.crc32(str(r["id"]).encode()) % 4 == 2 for r in rows]
