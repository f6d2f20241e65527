"""Pairs of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more: those with near fingerprints come from a search over these, all others are found without loss by prefix filtering.

A text's set holds the XXH64 values of its word shingles. Under one order of
all shingles, two sets of similarity t or more share one of their first
n - ceil(t n) + 1 members. Any order gives the same result; this one puts common
shingles last, so that a text meets others only at its rarest ones. Frequencies
over all texts come from a table of counters that shingles share by their hash:
its size follows the rows up to CELLS, and it is the only thing broadcast.

Two bounds on the overlap of sets a and b, both exact, come before any whole
set is read. Where they first meet, no more than what lies behind that place in
either set can be shared. And if their prefixes share A members, the overlap is
at most A plus the rest of the set whose prefix ends first in the order: a
member of that prefix that the other set has lies in the other's prefix too. A
passage that many documents share seldom passes the second bound. The pairs
left are decided on the whole sets.

Fingerprints: a pair within the bits of the search (simhash.NearSearch) is
never taken from a shingle, so each pair has one way to be found.

Dense groups: first come the pairs that the search proposes, and all texts at a
shingle are held against the least and the greatest id there, which is linear;
together they join most of a group. Then texts meet only across the components
so found: the search gives the pairs of near fingerprints that are still in
different ones, and texts at a shingle give the rest. Links therefore have the
components of all pairs, but are not all pairs.

Words are those of simhash.fingerprint: fewer than a shingle, and the whole
sequence is one; null and empty texts have one empty shingle, so they are
copies of each other. An id with several texts is one node. Rows without an id
are not searched.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import anew
from .components import connected_components
from .shared import mapped, narrow, small_batches, written

CELLS = 1 << 24  # counters at most: 32 MB in a task that counts, 16 MB broadcast
SPREAD = 16  # counters a text
BLOCK = 1 << 18  # counters summed by one task


def shingle_set(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles, sorted."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and bytes.split know ASCII only
    if len(tokens) < words:
        tokens, words = [b" ".join(tokens)], 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(s), seed) for s in zip(*(tokens[k:] for k in range(words)))), np.uint64).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *arrays]))


def _sets(rows: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for batch in small_batches(batches, 128):
            yield {"id": batch.column(0), "shingles": _lists([shingle_set(t, words) for t in batch.column(1).to_pylist()])}

    return mapped(rows, run, "id long, shingles array<long>")


def _commonness(rows: DataFrame, words: int) -> np.ndarray:
    """Counters of shingles by the low bits of their hash, over all texts, on a logarithmic scale of 8 bits: steps of a fortieth up to 255."""
    cells = min(CELLS, 1 << max(10, (SPREAD * rows.count() - 1).bit_length()))

    def count(batches):
        table = np.zeros(cells, np.uint16)
        for batch in small_batches(batches, 128):
            found = [shingle_set(t, words) & (cells - 1) for t in batch.column(0).to_pylist()]
            if found:
                at, n = np.unique(np.concatenate(found), return_counts=True)
                table[at] = np.minimum(table[at].astype(np.int64) + n, 65535)
        for k in range(0, cells, BLOCK):
            if (block := table[k : k + BLOCK]).any():
                yield {"block": [k], "counts": [zlib.compress(block.tobytes(), 1)]}

    def add_up(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(packed), np.uint16).astype(np.int64)
        for k, n in total.items():
            yield {"block": [k], "counts": [np.minimum(255, 40 * np.log10(n + 1.0)).astype(np.uint8).tobytes()]}

    kinds = "block int, counts binary"
    tasks = max(1, min(cells // BLOCK, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = mapped(mapped(rows.select("_text"), count, kinds).repartition(tasks, "block"), add_up, kinds).collect()  # a byte a counter
    out = np.zeros(cells, np.uint8)
    for r in parts:
        out[r["block"] : r["block"] + BLOCK] = np.frombuffer(r["counts"], np.uint8)
    return out


def _prefixes(rows: DataFrame, words: int, commonness: np.ndarray, search) -> DataFrame:
    """id, f (fingerprint), n (size of the set), shingles: the members, in the order, of which a near copy must share one."""
    known = rows.sparkSession.sparkContext.broadcast(commonness)

    def run(batches):
        table = known.value
        for batch in small_batches(batches, 128):
            sizes, found, texts = [], [], batch.column(1).to_pylist()
            for t in texts:
                s = shingle_set(t, words)
                s = s[np.lexsort((s, table[s & (len(table) - 1)]))]
                sizes.append(len(s))
                found.append(s[: len(s) - (4 * len(s) + 4) // 5 + 1])
            yield {"id": batch.column(0), "f": search.prints(texts), "n": sizes, "shingles": _lists(found)}

    return mapped(rows, run, "id long, f long, n int, shingles array<long>")


def _can_reach(a: str, b: str):
    """Whether sets that first share a shingle at these places can have similarity 0.8: 9 i >= 4 (na + nb)."""
    left = lambda x: F.col(f"{x}.n") - F.col(f"{x}.pos")
    return 9 * F.least(left(a), left(b)) >= 4 * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _can_reach_with(shared):
    """Whether sets of na and nb members whose prefixes share so many can have similarity 0.8."""
    rest = lambda n: F.expr(f"(4 * {n} + 4) div 5 - 1")
    return 9 * (shared + F.greatest(rest("na"), rest("nb"))) >= 4 * (F.col("na") + F.col("nb"))


def _ids(pairs: DataFrame) -> DataFrame:
    return narrow(written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-ids"))


def _both(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """pairs (a, b) with the columns of sides for either, as na, sa, nb, sb."""
    side = lambda x: sides.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("shingles").alias(f"s{x}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")


def _possible(prefixes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that pass the bound on their prefixes."""
    pairs = written(pairs.distinct(), "near-candidates")
    found = _both(pairs, prefixes.join(_ids(pairs), "id", "left_semi"))
    return found.where(_can_reach_with(F.size(F.array_intersect("sa", "sb")))).select("a", "b")


def _verified(rows: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have similarity 0.8 or more."""
    pairs = written(pairs.distinct(), "near-pairs")
    sets = _sets(rows.join(_ids(pairs), F.col("_id") == F.col("id"), "left_semi").select("_id", "_text"), words)
    found = _both(pairs, written(sets, "shingle-sets").withColumn("n", F.size("shingles")))
    return written(found.where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b").distinct(), "near-links")


def _close(placed: DataFrame, proposed: DataFrame, search) -> DataFrame:
    """Pairs of ids (a, b) in different components whose fingerprints are near: the search gives the fingerprints, and of their texts those are held against each other that can be near copies by the shingle they share."""
    near = placed.join(_ids(proposed), F.col("x.id") == F.col("id"), "left_semi")
    near = written(near.select("shingle", "x", "part", F.col("x.f").alias("f")), "close-shingles")
    prints = search.across(near.groupBy("f").agg(F.min("part").alias("low"), F.max("part").alias("high")))
    one = near.select("shingle", "x", "part", F.col("f").alias("a"))
    other = near.select("shingle", F.col("x").alias("y"), F.col("part").alias("_other"), F.col("f").alias("b"))
    found = prints.join(one, "a").join(other, ["shingle", "b"]).where("part <> _other and x.id <> y.id").where(_can_reach("x", "y"))
    return found.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def near_components(df: DataFrame, search, text: str = "text", key: str = "doc_id", words: int = 5) -> DataFrame:
    """(node, component) for every id that has a link: component is the least id reachable over pairs of similarity 0.8 or more. search (simhash.NearSearch) finds the pairs whose fingerprints are near; all pairs are decided on the whole sets."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    prefixes = written(_prefixes(rows, words, _commonness(rows, words), search), "prefixes")
    proposed = search.proposed(prefixes.select("id", "f"))
    beyond = F.bit_count(F.col("x.f").bitwiseXOR(F.col("y.f"))) > search.most_bits
    places = prefixes.select("id", "f", "n", F.posexplode("shingles").alias("pos", "shingle"))
    met = places.groupBy("shingle").count().where("count > 1").drop("count")
    at = lambda one: F.col("shingle") == F.col(one)
    shared = written(places.join(anew(met, "shingle", "_met"), at("_met"), "left_semi").select("shingle", F.struct("id", "n", "pos", "f").alias("x")), "shared-shingles")

    ends = shared.groupBy("shingle").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    ends = shared.join(anew(ends, "shingle", "_end"), at("_end")).select("x", F.explode(F.array("low", "high")).alias("y"))
    first = ends.where("x.id <> y.id").where(_can_reach("x", "y")).where(beyond).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    links = _verified(rows, _possible(prefixes, first.unionByName(proposed)), words)

    parts = connected_components(links)
    placed = shared.join(parts, F.col("x.id") == F.col("node"), "left").select("shingle", "x", F.coalesce("component", "x.id").alias("part"))
    placed = written(placed, "placed-shingles")
    crossed = placed.groupBy("shingle").agg(F.min("part").alias("_low"), F.max("part").alias("_high")).where("_low < _high").select("shingle")
    placed = written(placed.join(anew(crossed, "shingle", "_crossed"), at("_crossed"), "left_semi"), "crossed-shingles")
    # What the best of a component's texts at a shingle could reach with the best of another's.
    groups = placed.groupBy("shingle", "part").agg(F.min("x.n").alias("n"), F.max(F.col("x.n") - F.col("x.pos")).alias("left"))
    across = groups.alias("p").join(groups.alias("q"), F.col("p.shingle") == F.col("q.shingle")).where("p.part < q.part and 9 * least(p.left, q.left) >= 4 * (p.n + q.n)")
    across = across.select("p.shingle", "p.part", F.col("q.part").alias("_other"))
    other = placed.select("shingle", F.col("x").alias("y"), F.col("part").alias("_other"))
    rest = placed.join(across, ["shingle", "part"]).join(other, ["shingle", "_other"]).where("x.id <> y.id").where(_can_reach("x", "y")).where(beyond)
    rest = rest.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).unionByName(_close(placed, proposed, search))
    return connected_components(links.unionByName(_verified(rows, _possible(prefixes, rest), words)))
