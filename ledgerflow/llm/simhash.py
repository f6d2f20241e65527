"""SimHash near-duplicates found by the generalised pigeonhole principle.

Fingerprint: 64 bits, each set if it is set in over half of the XXH64 values
of the text's word shingles (repeats count).

Search: the bits are dealt into m parts, correlated bits together (correlation
over a bounded sample of fingerprints). If two fingerprints differ in at most
D bits, then for thresholds T_i >= -1 with sum(T_i + 1) = D + 1 some part
differs in at most T_i bits. m and the unequal T_i come from dynamic
programming over candidate counts estimated on the sample plus the cost of the
signatures; a part with T_i = -1 is not indexed. Every distinct fingerprint
emits its value of each part, and for T_i > 0 the values within T_i flips as
probes. Candidates share (part, value) and are verified on all bits.

Sizes: identical fingerprints collapse to one row before any signature. A
bucket over BUCKET rows is dealt anew by the bits that its rows need not share
(the distance there is at most D, so D + 1 sub-parts with threshold 0 lose
nothing), and what is still over it is dealt again by the bits then left, up to
DEALS times; rows that even then meet are dense. Within a bucket links come out as a spanning forest, found by
breadth-first search with whole-array distances, so a dense group of g
fingerprints yields g - 1 links and not g * g. Only a sample of at most SAMPLE
fingerprints ever reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import anew
from .components import connected_components
from .shared import mapped, narrow, small_batches, written
from .shingle_join import near_components

SAMPLE = 4096
BUCKET = 50_000
DEALS = 3
SIGNATURE_COST = 1000.0  # one signature row, made, shuffled, sorted and stored, against one verified pair
PAIRS = 1 << 20  # pairs verified at once


# ---- fingerprints


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint. A-Z is lower-cased, words are runs without [\\x20\\x09-\\x0D]; fewer words than a shingle: the whole sequence is one; none: 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and bytes.split know ASCII only
    if not tokens:
        return 0
    if len(tokens) < words:
        tokens = [b" ".join(tokens)]
        words = 1
    total, n, digest = np.zeros(64, np.int64), len(tokens) - words + 1, xxhash.xxh64_intdigest
    for at in range(0, n, 65_536):  # bounded memory for very long texts
        block = tokens[at : at + 65_536 + words - 1]
        hashes = np.fromiter((digest(b" ".join(s), seed) for s in zip(*(block[k:] for k in range(words)))), np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """(key, f0, f1, ...): a signed 64-bit fingerprint for each seed. Null text counts as empty."""
    names = [f"f{k}" for k in range(len(seeds))]

    def run(batches):
        for batch in small_batches(batches):
            texts = batch.column(1).to_pylist()
            cols = [np.array([fingerprint(t, words, s) for t in texts], np.uint64).view(np.int64) for s in seeds]
            yield {"_id": batch.column(0), **dict(zip(names, cols))}

    rows = df.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    return mapped(rows, run, "_id long, " + ", ".join(f"{n} long" for n in names)).withColumnRenamed("_id", key)


# ---- parts and thresholds


def deal_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """64 bit numbers in m parts of nearly equal size; each part grows by the free bit that correlates most with it."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    if len(sample) > 1:
        c = bits - bits.mean(0)
        norm = np.sqrt((c * c).sum(0))
        corr = np.abs(c.T @ c) / np.maximum(np.outer(norm, norm), 1e-12)
    else:
        corr = np.zeros((64, 64))
    free, parts = list(range(64)), []
    for k in range(m):
        part = [free.pop(0)]
        while len(part) < (64 + k) // m:
            best = max(free, key=lambda b: (corr[b, part].mean(), -b))
            free.remove(best)
            part.append(best)
        parts.append(sorted(part))
    return parts


def part_values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def _ball(bits: int, t: int) -> int:
    return sum(comb(bits, k) for k in range(min(t, bits) + 1))


def plan_thresholds(sample: np.ndarray, n: int, most_bits: int) -> tuple[list[list[int]], list[int]]:
    """Parts and thresholds of least estimated cost for n distinct fingerprints: dynamic programming over the parts, for each number of parts."""
    best, budget = None, most_bits + 1
    pairs = max(1, len(sample) * (len(sample) - 1) // 2)
    for m in range(2, min(16, budget) + 1):
        parts = deal_bits(sample, m)
        cost = np.full((m, budget + 1), np.inf)
        for p, bits in enumerate(parts):
            v = part_values(sample, bits).astype(np.uint64)
            near = np.zeros(65)
            for at in range(0, len(v), 256):
                near += np.bincount(np.bitwise_count(v[at : at + 256, None] ^ v[None, :]).ravel(), minlength=65)
            near = np.cumsum((near - np.eye(1, 65)[0] * len(v)) / 2)
            cost[p, 0] = 0.0
            for t in range(min(budget, len(bits))):
                share = max(near[t] / pairs, _ball(len(bits), t) / 2 ** len(bits))
                cost[p, t + 1] = share * n * n / 2 + SIGNATURE_COST * n * _ball(len(bits), t)
        total = np.full((m + 1, budget + 1), np.inf)
        total[0, 0], took = 0.0, np.zeros((m + 1, budget + 1), int)
        for p in range(m):
            for used in range(budget + 1):
                for u in range(used + 1):
                    if (c := total[p, used - u] + cost[p, u]) < total[p + 1, used]:
                        total[p + 1, used], took[p + 1, used] = c, u
        if best is None or total[m, budget] < best[0]:
            left, units = budget, []
            for p in range(m, 0, -1):
                units.append(int(took[p, left]))
                left -= units[-1]
            best = (total[m, budget], parts, [u - 1 for u in reversed(units)])
    return best[1], best[2]


# ---- verification inside buckets


def _near(a: np.ndarray, b: np.ndarray, bits: int, total: int) -> np.ndarray:
    """Whether rows of a and b link: at most bits of the first column differ, and at most total of all columns."""
    d = np.bitwise_count(a[..., 0] ^ b[..., 0])
    ok = d <= bits
    if a.shape[-1] > 1:
        d = d.astype(np.int32)
        for k in range(1, a.shape[-1]):
            d = d + np.bitwise_count(a[..., k] ^ b[..., k])
        ok &= d <= total
    return ok


def forest(f: np.ndarray, bits: int, total: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the link graph on rows f: breadth-first, each row's distances to all unvisited rows at once."""
    edges, rest = [], np.arange(len(f))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = _near(f[rest], f[x], bits, total)
            if hit.any():
                found = rest[hit]
                edges += [(x, int(y)) for y in found]
                queue += found.tolist()
                rest = rest[~hit]
    return edges


def bucket_links(group: np.ndarray, own: np.ndarray, f: np.ndarray, ids: np.ndarray, bits: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal group numbers. own: the row's exact value (else a probe); a pair needs one row of that kind, as two probes meet elsewhere."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(group)]
    size = ends - starts
    owned = np.add.reduceat(own.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    a, b = [], []
    small = (size > 1) & (size <= 32) & (owned > 0)
    idx = np.flatnonzero(np.repeat(small, size))
    stop = np.repeat(ends, size)
    for k in range(1, 32):
        idx = idx[idx + k < stop[idx]]
        if not len(idx):
            break
        ok = (own[idx] | own[idx + k]) & _near(f[idx], f[idx + k], bits, total)
        a.append(ids[idx[ok]])
        b.append(ids[idx[ok] + k])
    for s, e in zip(starts[(size > 32) & (owned > 0)], ends[(size > 32) & (owned > 0)]):
        # Own values first: a block of them is held against all rows behind its start.
        rows = s + np.argsort(~own[s:e], kind="stable")
        mine, g, pairs, hits = int(own[s:e].sum()), f[rows], [], 0
        step = max(1, PAIRS // len(rows))
        for low in range(0, mine, step):
            x, y = np.nonzero(np.bitwise_count(g[low : min(mine, low + step), None, 0] ^ g[None, low:, 0]) <= bits)
            x, y = x[x < y] + low, y[x < y] + low
            ok = _near(g[x], g[y], bits, total)
            pairs.append((rows[x[ok]], rows[y[ok]]))
            hits += int(ok.sum())
            if hits > 4 * len(rows):  # dense: a spanning forest says the same in fewer links
                x, y = np.array(forest(g, bits, total)).T
                pairs = [(rows[x], rows[y])]
                break
        for x, y in pairs:
            a.append(ids[x])
            b.append(ids[y])
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def bucket_pairs(group: np.ndarray, own: np.ndarray, f: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within the runs of equal group numbers that differ in at most bits bits, block by block, but for pairs whose labels low to high are one and the same. own: as in bucket_links."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(group)]
    size = ends - starts
    unlike = lambda x, y: np.maximum(high[x], high[y]) > np.minimum(low[x], low[y])
    idx = np.flatnonzero(np.repeat(size <= 32, size))
    stop = np.repeat(ends, size)
    for k in range(1, 32):
        idx = idx[idx + k < stop[idx]]
        ok = (own[idx] | own[idx + k]) & unlike(idx, idx + k) & (np.bitwise_count(f[idx] ^ f[idx + k]) <= bits)
        yield idx[ok], idx[ok] + k
    for s, e in zip(starts[size > 32], ends[size > 32]):
        rows = s + np.argsort(~own[s:e], kind="stable")
        mine, g, step = int(own[s:e].sum()), f[rows], max(1, PAIRS // len(rows))
        for at in range(0, mine, step):
            x, y = np.nonzero(np.bitwise_count(g[at : min(mine, at + step), None] ^ g[None, at:]) <= bits)
            x, y = rows[x[x < y] + at], rows[y[x < y] + at]
            ok = unlike(x, y)
            yield x[ok], y[ok]


def merged(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """The same components as stars around each least id."""
    up: dict[int, int] = {}

    def find(x):
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        if (r := find(x)) != (s := find(y)):
            up[max(r, s)] = min(r, s)
    out = [(x, find(x)) for x in list(up)]
    return [x for x, r in out if x != r], [r for x, r in out if x != r]


# ---- the search


def _mixed(*columns) -> np.ndarray:
    """One 64-bit key of integer arrays; keys that collide only bring more pairs to verify."""
    key = np.uint64(0)
    for c in columns:
        key = (key ^ np.asarray(c).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        key = key ^ (key >> np.uint64(32))
    return key.view(np.int64)


def _free(used: list[int]) -> int:
    """The bits that are not used, as a signed mask."""
    return int(np.uint64(~sum(1 << b for b in used) & (2**64 - 1)).astype(np.int64))


def _signatures(reps: DataFrame, names: list[str], parts: list[list[int]], limits: list[int]) -> DataFrame:
    """bucket (a key of part and value), free (mask of the bits outside the part), own (the row's own value, else a probe), rep and fingerprints."""
    masks = []
    for p, (bits, t) in enumerate(zip(parts, limits)):
        for k in range(t + 1):
            masks += [(p, sum(1 << b for b in c)) for c in combinations(range(len(bits)), k)]
    free = [_free(bits) for bits in parts]

    def run(batches):
        for batch in small_batches(batches, max(64, 200_000 // max(1, len(masks)))):
            f0 = batch.column(1).to_numpy().view(np.uint64)
            values = [part_values(f0, bits) for bits in parts]
            n, cols = len(f0), [batch.column(k).to_numpy() for k in range(batch.num_columns)]
            yield {
                "bucket": _mixed(np.repeat(np.array([p for p, _ in masks]), n), np.concatenate([values[p] ^ mask for p, mask in masks])),
                "free": np.repeat(np.array([free[p] for p, _ in masks], np.int64), n),
                "own": np.repeat(np.array([mask == 0 for _, mask in masks]), n),
                "rep": np.tile(cols[0], len(masks)),
                **{name: np.tile(c, len(masks)) for name, c in zip(names, cols[1:])},
            }

    return mapped(reps, run, _signature_kinds(names))


def _signature_kinds(names: list[str]) -> str:
    return "bucket long, free long, own boolean, rep long, " + ", ".join(f"{n} long" for n in names)


def _deal_anew(rows: DataFrame, names: list[str], bits: int, bucket: int) -> DataFrame:
    """Signatures whose buckets are at most bucket rows, as far as DEALS deals go: rows of larger ones are dealt by bits + 1 disjoint parts of the bits in free, and free shrinks by the part."""

    def run(batches):
        for batch in small_batches(batches, 20_000):
            t = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            f0 = t["f0"].view(np.uint64)
            for s in range(bits + 1):
                value, left = np.zeros(len(f0), np.int64), t["free"].copy()
                for mask in np.unique(t["free"]):
                    at, whole = t["free"] == mask, int(mask) & (2**64 - 1)
                    used = [b for k, b in enumerate(b for b in range(64) if whole >> b & 1) if k % (bits + 1) == s]
                    value[at] = part_values(f0[at], used)
                    left[at] = mask & np.int64(_free(used))
                yield t | {"bucket": _mixed(t["bucket"], np.full(len(f0), s), value), "free": left}

    done = None
    for deal in range(DEALS + 1):
        large = written(rows.groupBy("bucket").count().where(F.col("count") > bucket).select("bucket"), "large-buckets") if deal < DEALS else None
        fine = rows if large is None or large.isEmpty() else rows.join(large, "bucket", "left_anti").select(rows.columns)
        done = fine if done is None else done.unionByName(fine)
        if fine is rows:
            break
        again = rows.join(large, "bucket", "left_semi").select(rows.columns)
        rows = written(mapped(again, run, _signature_kinds(names)), "dealt-signatures")
    return done


def _dealt(reps: DataFrame, names: list[str], most_bits: int, bucket: int) -> DataFrame | None:
    """The signatures of reps (rep, and names, of which the first is f0), each bucket's rows together in a task; None if there are no two reps."""
    n = reps.count()
    if n < 2:
        return None
    sample = np.array([r[0] for r in reps.select("f0").orderBy(F.xxhash64("f0")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    parts, limits = plan_thresholds(sample, n, most_bits)
    kept = [(p, t) for p, t in zip(parts, limits) if t >= 0]
    parts, limits = [p for p, _ in kept], [t for _, t in kept]
    rows = _deal_anew(written(_signatures(reps.select("rep", *names), names, parts, limits), "signatures"), names, most_bits, bucket)
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket")


def _whole_buckets(batches) -> Iterator[dict[str, np.ndarray]]:
    """Columns of the sorted signatures, cut only between buckets."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        t = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in batch.schema.names}
        if held is not None:
            t = {x: np.concatenate([held[x], t[x]]) for x in t}
        last = t["bucket"] == t["bucket"][-1]  # the last bucket may go on in the next batch
        cut = len(last) - int(last.sum())
        held = {x: v[cut:] for x, v in t.items()}
        if cut:
            yield {x: v[:cut] for x, v in t.items()}
    if held is not None:
        yield held


def near_links(reps: DataFrame, most_bits: int, most_total: int | None = None, bucket: int = BUCKET, stars: bool = True) -> DataFrame:
    """reps: rep (a distinct id), f0 and further fingerprints, one row a distinct tuple. Links (a, b) whose components are those of all pairs that differ in at most most_bits bits of f0 and most_total bits altogether. Without stars every link is such a pair, and only dense buckets give fewer than all of theirs; a pair may come from several buckets."""
    names = [c for c in reps.columns if c != "rep"]
    total = most_bits if most_total is None else most_total
    dealt = _dealt(reps, names, most_bits, bucket)
    if dealt is None:
        return reps.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)

    def run(batches):
        found_a, found_b, have = [], [], 0
        for t in _whole_buckets(batches):
            a, b = bucket_links(t["bucket"], t["own"], np.stack([t[x].view(np.uint64) for x in names], 1), t["rep"], most_bits, total)
            if not stars:
                yield {"a": a, "b": b}
                continue
            found_a.append(a)
            found_b.append(b)
            have += len(a)
            if have > 1_000_000:
                a, b = merged(np.concatenate(found_a), np.concatenate(found_b))
                yield {"a": a, "b": b}
                found_a, found_b, have = [], [], 0
        if found_a:
            a, b = merged(np.concatenate(found_a), np.concatenate(found_b))
            yield {"a": a, "b": b}

    return mapped(dealt, run, "a long, b long")


def near_pairs(prints: DataFrame, most_bits: int, bucket: int = BUCKET) -> DataFrame:
    """prints: f (distinct fingerprints), low and high (least and greatest label of the texts that have it). All pairs (a, b) of fingerprints that differ in at most most_bits bits, of one with itself too, unless all their texts have one label; a pair may come from several buckets."""
    reps = written(prints.select(F.col("low").alias("rep"), F.col("f").alias("f0"), "high"), "labelled-fingerprints")
    same = reps.where("rep < high").select(F.col("f0").alias("a"), F.col("f0").alias("b"))
    dealt = _dealt(reps, ["f0", "high"], most_bits, bucket)
    if dealt is None:
        return same

    def run(batches):
        for t in _whole_buckets(batches):
            for x, y in bucket_pairs(t["bucket"], t["own"], t["f0"].view(np.uint64), t["rep"], t["high"], most_bits):
                if len(x):
                    yield {"a": t["f0"][x], "b": t["f0"][y]}

    return mapped(dealt, run, "a long, b long").unionByName(same)


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4, most_bits: int = 4, seeds: tuple[int, ...] = (42,), most_total: int | None = None) -> DataFrame:
    """One row a row of df: key, f0 (and further fingerprints), component_id: the least id reachable over links of near fingerprints, itself included.

    Null and empty texts have fingerprint 0, which links like any other. Null
    ids get a null component unless a row with an id shares their fingerprint.
    Repeated rows are members of one component; an id with several texts is
    one node, so it joins their groups. Further columns are ignored.
    An empty table gives an empty result. With several seeds a link needs
    most_bits or fewer in f0 and most_total or fewer in all together.
    """
    prints = written(fingerprints(df, text, key, words, seeds), "fingerprints")
    names = [f"f{k}" for k in range(len(seeds))]
    reps = written(prints.groupBy(*names).agg(F.min(key).alias("rep")).where("rep is not null").select("rep", *names), "fingerprint-classes")
    parts = connected_components(near_links(reps, most_bits, most_total).unionByName(_id_links(prints, reps, names, key)))
    classes = reps.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(*names, F.coalesce("component", "rep").alias("component_id"))
    out = prints.join(classes.select(*[F.col(n).alias(f"_{n}") for n in names], "component_id"), [F.col(n) == F.col(f"_{n}") for n in names], "left")
    return out.select(key, *names, "component_id")


def _id_links(prints: DataFrame, reps: DataFrame, names: list[str], key: str) -> DataFrame:
    """Links (a, b) between the fingerprint classes that rows of one id belong to; an id with one fingerprint has none."""
    whole = F.struct(*names) if len(names) > 1 else F.col(names[0])
    several = prints.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(whole).alias("_low"), F.max(whole).alias("_high")).where("_low <> _high").select("_key")
    several = written(several, "ids-of-several")
    if several.isEmpty():
        return several.select(F.col("_key").alias("a"), F.col("_key").alias("b"))
    rows = prints.select(F.col(key).alias("_key"), *names).join(several, "_key", "left_semi").join(reps, names).select("_key", "rep").distinct()
    least = rows.groupBy("_key").agg(F.min("rep").alias("b"))
    return rows.join(anew(least, "_key", "_least"), F.col("_key") == F.col("_least")).select(F.col("rep").alias("a"), "b")


class NearSearch:
    """The part of the near stage that is decided by fingerprints: every pair of texts in which they differ in at most most_bits bits. shingle_join.near_components takes such pairs from here alone."""

    def __init__(self, words: int, most_bits: int):
        self.words, self.most_bits = words, most_bits

    def prints(self, texts: list[str | None]) -> np.ndarray:
        return np.array([fingerprint(t, self.words) for t in texts], np.uint64).view(np.int64)

    def proposed(self, prints: DataFrame) -> DataFrame:
        """prints: id, f. Pairs of ids (a, b), each id with the least of its fingerprint, and those least ids where fingerprints are near; dense buckets give a spanning forest. Every id that has a text near another one's, or the least of its fingerprint, is in a pair."""
        reps = written(prints.groupBy("f").agg(F.min("id").alias("rep")), "near-classes")
        same = prints.join(anew(reps, "f", "_f"), F.col("f") == F.col("_f")).select(F.col("id").alias("a"), F.col("rep").alias("b"))
        # An id with several texts stands for several fingerprints.
        near = near_links(reps.select("rep", F.col("f").alias("f0")), self.most_bits, stars=False)
        return written(near.unionByName(same).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-proposed")

    def across(self, prints: DataFrame) -> DataFrame:
        """prints: f, low, high (components of the texts that have it). The pairs of fingerprints (a, b) of which texts in different components are still to be decided."""
        return written(near_pairs(prints, self.most_bits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-across")


def drop_near_copies(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, most_bits: int = 6) -> DataFrame:
    """The rows of df with one document of each group left: the one with the least id. A group is a component of links between texts whose word shingles have a Jaccard similarity of 0.8 or more.

    Pairs whose fingerprints differ in at most most_bits bits are found by the
    search over fingerprints and by nothing else; each is decided on the
    shingles. A fingerprint only estimates the similarity, so pairs beyond
    those bits are found by shingle_join and decided in the same way.

    Rows without an id stay. An id with several texts is one node: its rows
    stay or go together. Null and empty texts are copies of each other.
    Repeated rows of the id that stays all stay. An empty table gives an empty
    result; further columns are kept, whatever their names.
    """
    gone = near_components(df, NearSearch(words, most_bits), text, key, words).where("node <> component").select(F.col("node").alias("__gone"))
    return df.join(narrow(written(gone, "near-gone")), F.col(key).cast("long") == F.col("__gone"), "left_anti").select(df.columns)
