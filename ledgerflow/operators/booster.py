"""Boosted classification trees, grown by all tasks of one stage together.

Friedman (2001) with logistic loss over labels -1 and 1, by the rules of Spark's
GBTClassifier: the first tree fits the labels and counts whole, each further one
fits the loss's negative gradient and counts step; splits have the greatest fall
of weighted variance over at most 32 bins a feature, among a share of the
features drawn for each node; a leaf is the weighted mean of its rows; each tree
sees a share of the rows, drawn by hash of the account.

Spark's own booster runs seven jobs a round. Here every task keeps its rows as
one byte a value for all rounds; a level's sums by node, feature and bin go to
the first task, which sends back the splits. A message holds sums, never rows,
so it doesn't grow with the input. The tasks run as a barrier stage: if one is
lost, Spark starts all of them anew.
"""

from __future__ import annotations

import math
import pickle
import secrets
import socket
import struct

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32
PATIENCE_S = 900


class Booster:
    """Trees as arrays: feature (-1 at leaves), cut (x <= cut goes left), left, right, value (times the tree's weight) and cover (weight of training rows)."""

    SCHEMA = "tree int, node int, feature int, cut double, left int, right int, value double, cover double"
    FIELDS = (("feature", int), ("cut", float), ("left", int), ("right", int), ("value", float), ("cover", float))

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    def rows(self) -> list[tuple]:
        return [(t, k, *(kind(a[k]) for a, (_, kind) in zip(tree, self.FIELDS))) for t, tree in enumerate(self.trees) for k in range(len(tree[0]))]

    @classmethod
    def from_rows(cls, rows) -> Booster:
        by: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r["tree"], r["node"])):
            by.setdefault(r["tree"], []).append(r)
        return cls([tuple(np.array([r[name] for r in t], kind) for name, kind in cls.FIELDS) for t in by.values()])

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Half the log odds of label 1."""
        total = np.zeros(len(x))
        for start in range(0, len(x), 4096):  # rows that stay in the processor's cache
            part = np.ascontiguousarray(x[start : start + 4096])
            flat, base = part.ravel(), np.arange(len(part)) * part.shape[1]
            for feature, cut, left, right, value, _ in self.trees:
                # A leaf goes to itself, so that all rows take as many steps.
                inner, here = feature >= 0, np.arange(len(feature))
                column, after = np.where(inner, feature, 0), np.stack([np.where(inner, left, here), np.where(inner, right, here)], 1).ravel()
                at = np.zeros(len(part), np.intp)
                while inner.take(at).any():
                    at = after.take(2 * at + (flat.take(base + column.take(at)) > cut.take(at)))
                total[start : start + 4096] += value.take(at)
        return total


# ---- bins


def feature_cuts(x: DataFrame, width: int) -> list[np.ndarray]:
    """Ascending cuts of each entry of the array x, over all rows: between all its values where they are few, else at quantiles."""
    col = lambda f: F.col("x")[f]
    shares = [k / BINS for k in range(BINS)]
    first = x.agg(*[F.approx_count_distinct(col(f)).alias(f"n{f}") for f in range(width)], *[F.percentile_approx(col(f), shares, 10_000).alias(f"q{f}") for f in range(width)], *[F.max(col(f)).alias(f"m{f}") for f in range(width)]).first()
    few = [f for f in range(width) if first[f"n{f}"] <= 2 * BINS]  # the count is approximate, so somewhat more are looked at
    values = x.agg(*[F.collect_set(col(f)).alias(f"v{f}") for f in few]).first() if few else {}
    out = []
    for f in range(width):
        if f in few and len(found := np.unique(values[f"v{f}"])) <= BINS:
            out.append((found[:-1] + found[1:]) / 2)
        else:
            at = np.unique(first[f"q{f}"])
            out.append(at[at < first[f"m{f}"]][: BINS - 1])
    return out


# ---- messages between the tasks of one stage


class Alone:
    first = True

    def total(self, sums: np.ndarray) -> np.ndarray:
        return sums

    def told(self, message):
        return message

    def close(self) -> None:
        pass


class Together:
    """Sums to the first task, its answers to all. Sums are added in the order of tasks, so they don't depend on time."""

    def __init__(self, context: BarrierTaskContext, token: bytes):
        self.first = context.partitionId() == 0
        self.socks: list[socket.socket] = []
        server = None
        if self.first:
            server = socket.create_server(("", 0))
            server.settimeout(PATIENCE_S)
        host = context.getTaskInfos()[context.partitionId()].address.rsplit(":", 1)[0]
        where = context.allGather(f"{host} {server.getsockname()[1]}" if server else "")[0]
        if server:
            waited = {}
            while len(waited) < len(context.getTaskInfos()) - 1:
                s, _ = server.accept()
                s.settimeout(PATIENCE_S)
                said = self._read(s, len(token) + 4)
                if secrets.compare_digest(bytes(said[:-4]), token):
                    waited[struct.unpack("<i", said[-4:])[0]] = s
                else:
                    s.close()
            server.close()
            self.socks = [waited[k] for k in sorted(waited)]
        else:
            host, port = where.split(" ")
            s = socket.create_connection((host, int(port)), timeout=PATIENCE_S)
            s.sendall(token + struct.pack("<i", context.partitionId()))
            self.socks = [s]
        for s in self.socks:
            s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    @staticmethod
    def _read(s: socket.socket, size: int) -> bytearray:
        out = bytearray(size)
        view, got = memoryview(out), 0
        while got < size:
            n = s.recv_into(view[got:])
            if not n:
                raise ConnectionError("a task of the stage is gone")
            got += n
        return out

    def total(self, sums: np.ndarray) -> np.ndarray:
        if not self.first:
            self.socks[0].sendall(np.ascontiguousarray(sums).tobytes())
            return sums
        out = sums.copy()
        for s in self.socks:
            out += np.frombuffer(self._read(s, sums.nbytes), sums.dtype).reshape(sums.shape)
        return out

    def told(self, message):
        if self.first:
            sent = pickle.dumps(message)
            for s in self.socks:
                s.sendall(struct.pack("<q", len(sent)) + sent)
            return message
        return pickle.loads(self._read(self.socks[0], struct.unpack("<q", self._read(self.socks[0], 8))[0]))

    def close(self) -> None:
        for s in self.socks:
            s.close()


# ---- growth


def drawn(keys: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """The rows that a tree sees, by their keys alone."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z < np.uint64(min(int(share * 2.0**64), 2**64 - 1))


def level_sums(bins: np.ndarray, rows: np.ndarray, slot: np.ndarray, weight: np.ndarray, target: np.ndarray, slots: int) -> np.ndarray:
    """Weight and weighted target of the rows by (slot, feature, bin)."""
    out = np.empty((2, len(bins), slots * BINS))
    base, w, g = slot * BINS, weight[rows], target[rows]
    for f in range(len(bins)):
        at = base + bins[f].take(rows)
        out[0, f], out[1, f] = np.bincount(at, w, slots * BINS), np.bincount(at, g, slots * BINS)
    return np.ascontiguousarray(out.reshape(2, len(bins), slots, BINS).transpose(2, 0, 1, 3))


def best_splits(sums: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """feature (-1: none), last bin on the left, and weight and target on the left and right of each node. may: the features drawn for it. Weights are 1 at least, so less than a half is no row."""
    left = np.cumsum(sums, axis=3)
    whole = left[:, :, :, -1:]
    right = whole - left
    usable = (left[:, 0] > 0.5) & (right[:, 0] > 0.5) & may[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        before = whole[:, 1] ** 2 / whole[:, 0]
        gain = np.where(usable, left[:, 1] ** 2 / left[:, 0] + right[:, 1] ** 2 / right[:, 0] - before, -np.inf).reshape(len(sums), -1)
    at, k = gain.argmax(1), np.arange(len(sums))
    f, b = at // BINS, at % BINS
    found = gain[k, at] > 1e-10 * before[:, 0, 0]  # below that it is rounding
    return np.where(found, f, -1), b, np.stack([left[k, 0, f, b], left[k, 1, f, b], right[k, 0, f, b], right[k, 1, f, b]], 1)


def grow(bins: np.ndarray, keys: np.ndarray, y: np.ndarray, weight: np.ndarray, peers, rounds: int, depth: int, step: float, share: float, seed: int):
    """The trees as lists of (feature, last bin on the left, left, right, value, cover). bins: feature by row; y: -1 or 1."""
    width, n = bins.shape
    margin, everyone = np.zeros(n), np.arange(n)
    for t in range(rounds):
        target = y if t == 0 else 4.0 * y / (1.0 + np.exp(np.minimum(2.0 * y * margin, 700.0)))
        seen = drawn(keys, seed, t, share)
        pull = weight * target
        draw = np.random.default_rng((seed, t))
        nodes: list[list] = [[-1, -1, -1, -1, 0.0, 0.0]]
        live, at, slot, small, sums = [0], np.zeros(n, int), np.zeros(n, int), np.zeros(1, int), None
        for level in range(depth):
            # Of two siblings the one of less weight is summed; the other is what is left of their parent.
            place = np.full(len(live) + 1, -1)
            place[small] = np.arange(len(small))
            rows = everyone[seen & (place[slot] >= 0)]
            part = peers.total(level_sums(bins, rows, place[slot[rows]], weight, pull, len(small)))
            if peers.first:
                if sums is None:
                    sums = part
                else:
                    both = np.empty((len(live), *part.shape[1:]))
                    both[small], both[small ^ 1] = part, sums - part
                    sums = both
                may = draw.random((len(live), width)).argsort(1).argsort(1) < math.ceil(share * width)
                answer = (*best_splits(sums, may), sums[:, :, 0].sum(2) if level == 0 else None)
            else:
                answer = None
            feature, last, sides, root = peers.told(answer)
            if level == 0:
                nodes[0][4], nodes[0][5] = float(root[0, 1] / root[0, 0]) if root[0, 0] else 0.0, float(root[0, 0])
            split = np.flatnonzero(feature >= 0)
            if not len(split):
                break
            children = []
            for k in split:
                wl, gl, wr, gr = sides[k].tolist()
                nodes[live[k]][:4] = [int(feature[k]), int(last[k]), len(nodes), len(nodes) + 1]
                children += [len(nodes), len(nodes) + 1]
                nodes += [[-1, -1, -1, -1, gl / wl, wl], [-1, -1, -1, -1, gr / wr, wr]]
            # Rows of nodes that stay leaves go to a slot past the last, where they remain.
            pair = np.full(len(live) + 1, -1)
            pair[split] = np.arange(len(split))
            go = everyone[pair[slot] >= 0]
            old = slot[go]
            right = bins[feature[old], go] > last[old]
            slot = np.full(n, len(children))
            slot[go] = 2 * pair[old] + right
            at[go] = np.array(children)[slot[go]]
            small = 2 * np.arange(len(split)) + (sides[split, 2] < sides[split, 0])
            live = children
            sums = sums[split] if peers.first else None
        factor = 1.0 if t == 0 else step
        margin += factor * np.array([v[4] for v in nodes])[at]
        yield [(f, b, left, right, factor * value, cover) for f, b, left, right, value, cover in nodes]


def slots_of(spark) -> int:
    """Tasks that can run at once now: a barrier stage needs as many."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 1
    context = spark.sparkContext._jsc.sc()
    return max(1, int(context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())))


def fit_booster(labelled: DataFrame, width: int, rows: int, positive_weight: float, rounds: int, depth: int, step: float, seed: int, task_rows: int, share: float = 0.8) -> Booster:
    """labelled: account, x (vector of width entries), label 0 or 1; rows: their number. All rows are binned and seen; a task has about task_rows, but no more tasks run than there are cores."""
    spark = labelled.sparkSession
    table = labelled.select("account", vector_to_array("x").alias("x"), F.col("label").cast("double").alias("label"))
    cuts = feature_cuts(table, width)
    tasks = max(1, min(rows // task_rows, slots_of(spark)))
    token = secrets.token_bytes(16)

    def run(batches):
        bins, keys, y = [np.zeros((width, 0), np.uint8)], [np.zeros(0, np.uint64)], [np.zeros(0)]
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            bins.append(np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)]).astype(np.uint8))
            keys.append(b.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            y.append(b.column("label").to_numpy(zero_copy_only=False) * 2.0 - 1.0)
        y = np.concatenate(y)
        peers = Alone() if tasks == 1 else Together(BarrierTaskContext.get(), token)
        try:
            trees = grow(np.concatenate(bins, 1), np.concatenate(keys), y, np.where(y > 0, positive_weight, 1.0), peers, rounds, depth, step, share, seed)
            for t, nodes in enumerate(trees):
                if peers.first:
                    f, b, left, right, value, cover = map(list, zip(*nodes))
                    cut = [float(cuts[i][j]) if i >= 0 else 0.0 for i, j in zip(f, b)]
                    arrays = [pa.array([t] * len(f), pa.int32()), pa.array(range(len(f)), pa.int32()), pa.array(f, pa.int32()), pa.array(cut, pa.float64()), pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(value, pa.float64()), pa.array(cover, pa.float64())]
                    yield pa.RecordBatch.from_arrays(arrays, ["tree", "node", *(name for name, _ in Booster.FIELDS)])
        finally:
            peers.close()

    dealt = table.select("account", F.xxhash64("account").alias("key"), "x", "label")
    dealt = (dealt.coalesce(1) if tasks == 1 else dealt.repartition(tasks, "account")).sortWithinPartitions("account").drop("account")
    return Booster.from_rows(dealt.mapInArrow(run, Booster.SCHEMA, barrier=tasks > 1).collect())
