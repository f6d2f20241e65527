"""Byte-level BPE encoding and decoding by rank table.

Each match of the cutting pattern is merged on its own. A segment tree over the
byte positions holds, at every leaf that starts a live part, the rank of the
pair formed with the next live part, joined with the position; so the root is
the leftmost pair of least rank. A merge removes the right part and updates
three leaves at most: the merged part, its left neighbour and the removed part,
each in a number of steps logarithmic in the piece's length. Short pieces are
merged many at a time, one tree a row of a NumPy array; long ones singly.

Null and empty texts have no ids and decode to no bytes. Texts of any length
are encoded whole. Repeated rows and ids are encoded like any other.
"""

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PieceStore
from .shared import kept, mapped, small_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
_NONE = np.int64(2**62)
SHORT = 32
STORE = 300_000  # pieces a generation: a Python worker stays near 300 MB


class RankTable:
    """Ranks of byte strings, and of every pair of tokens whose concatenation has one."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pair: dict[tuple[int, int], int] = {}
        for whole, rank in self.ranks.items():
            for cut in range(1, len(whole)):
                a, b = self.ranks.get(whole[:cut]), self.ranks.get(whole[cut:])
                if a is not None and b is not None:
                    self.pair[a, b] = rank
        self.span = np.int64(max(self.tokens) + 1)
        keys = np.array([a * int(self.span) + b for a, b in self.pair], np.int64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array(list(self.pair.values()), np.int64)[order]
        self.byte_pair = self.pair_ranks(*np.broadcast_arrays(self.byte[:, None], self.byte[None, :]))

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; _NONE where a pair cannot merge or either part is missing (-1)."""
        key = a * self.span + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.values[at], _NONE)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def merge_one(piece: bytes, table: RankTable) -> bytes:
    """Ids of one piece of any length by a segment tree on a list."""
    n = len(piece)
    if n == 0:
        return b""
    size = 1 << max(0, n - 1).bit_length()
    ids = table.byte[np.frombuffer(piece, np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair, none = table.pair, (1 << 62, 0)
    tree = [none] * (2 * size)
    for k in range(n - 1):
        if (r := pair.get((ids[k], ids[k + 1]))) is not None:
            tree[size + k] = (r, k)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def update(k: int) -> None:
        r = pair.get((ids[k], ids[after[k]])) if after[k] < n else None
        put(k, none if r is None else (r, k))

    def put(k: int, value) -> None:
        k += size
        tree[k] = value
        while k := k >> 1:
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    while (top := tree[1]) is not none and top[0] < 1 << 62:
        rank, k = top
        gone = after[k]
        ids[k], ids[gone] = rank, -1
        after[k] = after[gone]
        if after[k] < n:
            before[after[k]] = k
        put(gone, none)
        update(k)
        if before[k] >= 0:
            update(before[k])
    return np.array([i for i in ids if i >= 0], "<u4").tobytes()


def merge_many(pieces: list[bytes], table: RankTable) -> list[bytes]:
    """Ids of pieces of at most SHORT bytes: one segment tree for each piece, all pieces a merge at a time. Trees and lists lie in flat arrays, node by node."""
    n = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, n)
    width = 1 << max(0, int(lengths.max(initial=1)) - 1).bit_length()
    raw = np.array(pieces, f"S{width}").view(np.uint8).reshape(n, width).T
    cols = np.arange(width + 1)[:, None]
    ids = np.full((width + 1, n), -1)
    ids[:width] = np.where(cols[:width] < lengths, table.byte[raw], -1)
    after, before = np.minimum(cols + 1, lengths), np.repeat(cols - 1, n, 1)
    tree = np.full((2 * width, n), _NONE)
    if width > 1:
        rank = np.where(ids[1:width] >= 0, table.byte_pair[raw[:-1], raw[1:]], _NONE)
        tree[width : 2 * width - 1] = np.where(rank < _NONE, rank * width + cols[: width - 1], _NONE)
        for k in range(width - 1, 0, -1):
            np.minimum(tree[2 * k], tree[2 * k + 1], out=tree[k])
    ids, after, before, tree = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()

    def leaf(rows, at):
        here = at * n + rows
        rank = table.pair_ranks(ids.take(here), ids.take(after.take(here) * n + rows))
        return np.where(rank < _NONE, rank * width + at, _NONE)

    def put(rows, at, value):
        node, half = at + width, width
        tree.put(node * n + rows, value)
        while half > 1:
            node, half = node >> 1, half >> 1
            below = 2 * node * n + rows
            tree.put(node * n + rows, np.minimum(tree.take(below), tree.take(below + n)))

    rows = np.flatnonzero(tree[n : 2 * n] < _NONE) if width > 1 else np.zeros(0, np.int64)
    while len(rows):
        top = tree.take(n + rows)
        at, rank = top % width, top // width
        here = at * n + rows
        gone = after.take(here)
        then = after.take(gone * n + rows)
        ids.put(here, rank)
        ids.put(gone * n + rows, -1)
        after.put(here, then)
        has = then < lengths.take(rows)
        before.put((then * n + rows)[has], at[has])
        put(rows, gone, np.full(len(rows), _NONE))
        put(rows, at, leaf(rows, at))
        left = before.take(here)
        has = left >= 0
        if has.any():
            rows_left, left = rows[has], left[has]
            put(rows_left, left, leaf(rows_left, left))
        rows = rows[tree.take(n + rows) < _NONE]
    done = ids.reshape(width + 1, n)[:width].T
    live = done >= 0
    flat, ends = done[live].astype("<u4").tobytes(), (4 * np.cumsum(live.sum(1))).tolist()
    return [flat[s:e] for s, e in zip([0, *ends], ends)]


def encode_pieces(pieces: list[str], table: RankTable) -> list[bytes]:
    raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    order = np.argsort(lengths, kind="stable")
    out = np.empty(len(raw), object)
    many = int(np.searchsorted(lengths[order], SHORT, "right"))
    cuts = [0, *(int(np.searchsorted(lengths[order], w, "right")) for w in (4, 8, 16, SHORT))]
    for start, end in zip(cuts, cuts[1:]):
        for s in range(start, end, 4096):
            at = order[s : min(end, s + 4096)].tolist()
            out[at] = merge_many([raw[k] for k in at], table) if len(at) >= 16 else [merge_one(raw[k], table) for k in at]
    for k in order[many:].tolist():
        out[k] = merge_one(raw[k], table)
    return out.tolist()


def codec(path: str, pattern: str) -> tuple[RankTable, PieceStore]:
    """A process's table and piece store."""

    def make():
        table = RankTable(path)
        return table, PieceStore(pattern, lambda pieces: encode_pieces(pieces, table), STORE)

    return kept(f"bpe {path} {pattern}", make)


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, pattern: str = public_tokenizers.PATTERN, decoded: bool = False) -> DataFrame:
    """(key, ids, n_tokens[, decoded]): ids as binary, little-endian unsigned 32-bit. decoded: the bytes that the ids stand for, decoded from them."""
    name = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        table, store = codec(name, pattern)
        for batch in small_batches(batches, 256):
            ids = store.texts([t or "" for t in batch.column(1).to_pylist()])
            out = {"_id": batch.column(0), "ids": ids, "n_tokens": [len(x) // 4 for x in ids]}
            yield out | ({"decoded": [table.decode(x) for x in ids]} if decoded else {})

    rows = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    schema = f"_id {rows.schema[0].dataType.simpleString()}, ids binary, n_tokens long" + (", decoded binary" if decoded else "")
    return mapped(rows, run, schema).withColumnRenamed("_id", key)


def decode(df: DataFrame, ids: str = "ids", key: str = "doc_id", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(key, decoded): the bytes that binary ids stand for; null ids decode to no bytes."""
    name = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        table, _ = codec(name, pattern)
        for batch in small_batches(batches, 256):
            yield {"_id": batch.column(0), "decoded": [table.decode(x or b"") for x in batch.column(1).to_pylist()]}

    rows = df.select(F.col(key).alias("_id"), F.col(ids).alias("_ids"))
    return mapped(rows, run, f"_id {rows.schema[0].dataType.simpleString()}, decoded binary").withColumnRenamed("_id", key)
