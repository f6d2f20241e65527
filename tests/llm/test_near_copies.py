"""The near stage against all pairs of shingle sets."""

import random

import pytest
from test_text_operators import CLASHING, ODD

from ledgerflow.llm import shared, shingle_join, simhash


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def plain_kept(rows):
    """Ids that are the least of their component over all pairs at 0.8 or more."""
    sets = [(i, plain_set(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i for i in up if find(i) == i}


def edited(seed):
    """Pairs, chains and a dense group of copies at all similarities from 0.6 on, over boilerplate that many texts hold."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    boiler = [word() for _ in range(40)]
    out = []
    for k in range(60):
        base = [word() for _ in range(rng.randrange(5, 160))] + boiler * (k % 3 == 0)
        out.append(base)
        for _ in range(40 if k == 7 else rng.randrange(4)):
            copy = list(rng.choice([base, out[-1]]))
            for _ in range(rng.randrange(1, 5)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(1, 4)] = [word()]
            out.append(copy)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("cells, stars", [(shingle_join.CELLS, True), (1, False)])
def test_near_stage_is_exact(spark, monkeypatch, cells, stars):
    """With counters, and with one for all shingles, which orders by hash alone; also where the pairs with least and greatest ids find nothing and all is left to the pairs across."""
    monkeypatch.setattr(shingle_join, "CELLS", cells)
    possible, calls = shingle_join._possible, []
    monkeypatch.setattr(shingle_join, "_possible", lambda prefixes, pairs: possible(prefixes, pairs if calls.append(1) or stars or len(calls) > 1 else pairs.limit(0)))
    rows = list(enumerate(edited(5)))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r["doc_id"] for r in simhash.drop_near_copies(docs).collect()} == plain_kept(sorted(rows))


def test_passage_of_many_texts_makes_few_pairs(spark, monkeypatch):
    """Texts that share a passage, but are no near copies, meet at rarer shingles: pairs to verify do not grow with the square of the texts."""
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(60))
    docs = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) + " " + passage) for k in range(600)]
    made = {}
    monkeypatch.setattr(shingle_join, "written", lambda df, name: (out := shared.written(df, name), made.setdefault(name, out.count()))[0])
    kept = simhash.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string"))
    assert kept.count() == 600
    assert made["shared-shingles"] < 600 and made["near-candidates"] < 600


def test_odd_texts(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "a"), (3, "the cat sat on the mat"), (None, "a"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *CLASHING)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    # 3 has two texts, so its components are one; rows without an id stay.
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, k) for k in (0, 3, 3, 3, 4, 5, 6, 9, 10, 11, 12)] + [(True, 0), (True, 0)]
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


def reach(rows, bits=6):
    """Pairs of ids (a, b), a < b, whose fingerprints of five-word shingles differ in at most bits bits."""
    prints = [(i, simhash.fingerprint(t, 5)) for i, t in rows]
    return {(min(i, j), max(i, j)) for k, (i, f) in enumerate(prints) for j, g in prints[:k] if (f ^ g).bit_count() <= bits}


def test_fingerprints_decide_what_is_kept(spark, monkeypatch):
    """The pairs within reach of the fingerprints come from their search alone: what it doesn't give is not found by shingles."""
    rows = list(enumerate(edited(6)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets, near = {i: plain_set(t) for i, t in rows}, reach(rows)
    alike = [(j, i) for i in sets for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert near & set(alike) and set(alike) - near  # either way has its part
    assert {r["doc_id"] for r in simhash.drop_near_copies(docs).collect()} == plain_kept(rows)

    monkeypatch.setattr(simhash, "bucket_links", lambda group, own, f, ids, *_: (ids[:0], ids[:0]))
    up = {i: i for i in sets}
    for j, i in alike:
        if (j, i) not in near:
            x, y = sorted((up[i], up[j]))
            up = {k: x if v == y else v for k, v in up.items()}
    same = {t: min(i for i, u in rows if simhash.fingerprint(u, 5) == simhash.fingerprint(t, 5)) for _, t in rows}
    assert all(same[t] == i for i, t in rows)
    without = {r["doc_id"] for r in simhash.drop_near_copies(docs).collect()}
    assert without == {i for i in up if up[i] == i} != plain_kept(rows)


def test_near_fingerprints_of_unlike_texts(spark, monkeypatch):
    """Texts of one repeated word and a few of their own: a dense bucket of near and equal fingerprints, in which few pairs are near copies."""
    rng = random.Random(4)
    texts = []
    for _ in range(50):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 40))]
        texts += [own, own[:-1] + ["end"], [*own, "more"]][: rng.randrange(1, 4)]
    rows = [(k, " ".join(["spam"] * 2000 + t)) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    assert len(reach(rows)) > 4 * len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = {}
    monkeypatch.setattr(simhash, "written", lambda df, name: (out := shared.written(df, name), made.setdefault(name, out.count()))[0])
    assert {r["doc_id"] for r in simhash.drop_near_copies(docs).collect()} == plain_kept(sorted(rows))
    assert made["near-across"]
