"""Benchmark decontamination: a BM25 index of test items searched by block-max WAND.

Test items are cut into segments of at most SEGMENT words; each is a document
of the inverted index. Its BM25 weights are divided by the segment's score
against itself, so a passage's score is the share of the segment that it
covers, weighted by rarity. Every text is cut into passages of twice the
longest segment, half overlapping, so each segment lies whole in one of them,
and every passage is a query: all segments at or above LEAST_SCORE are
retrieved. Segments stand in blocks, and each word has its maximum weight in
each block: the sums of those over a passage's distinct words, taken for all
passages of a batch at once, rule out most pairs of passage and block. In the
blocks left, WAND walks the postings and scores only pivots that can reach the
threshold.

A retrieved pair is then verified on the whole text: of the item, its question
and its answer, shares of their five-word shingles that the text has (a shorter
item is one shingle; of questions and answers under SHORT words, single words are
compared, as one changed word would leave no shingle). It is a leak if the item
has 0.8 or more and question and answer half or more each. The answer is an item's
last line, or what follows its last question mark; other items have none, and
their whole share decides.

Words are runs of word characters, lower-cased. Null and empty texts match
nothing; null and empty items are not indexed; items of one text are reported
each. Repeated rows give repeated results. The index is broadcast only up to
INDEX_LIMIT items and INDEX_CHARS characters of them; larger benchmarks are
searched in blocks of that size, one pass over the texts each, and a block's index
is given up before the next one is made.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import kept, mapped, small_batches, small_transfers, written

SEGMENT, SHINGLE = 64, 5
K1, B = 1.2, 0.75
LEAST_SCORE, LEAST_OVERLAP, LEAST_PART = 0.6, 0.8, 0.5
BLOCK, MOST_BLOCKS = 4, 128  # segments a block at least, blocks at most
INDEX_LIMIT, INDEX_CHARS = 50_000, 16 << 20
SHORT = 10
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and answer; an item without such a structure is all question."""
    lines = [x for x in text.split("\n") if words(x)]
    if len(lines) > 1:
        return words(" ".join(lines[:-1])), words(lines[-1])
    question, _, answer = text.rpartition("?")
    return (words(question), words(answer)) if words(question) and words(answer) else (words(text), [])


def shingles(tokens: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, len(tokens))
    return {tuple(tokens[k : k + n]) for k in range(len(tokens) - n + 1)} if n else set()


def part_shingles(tokens: list[str]) -> set[tuple[str, ...]]:
    """What a question's or an answer's share is taken of."""
    return shingles(tokens) if len(tokens) >= SHORT else {(t,) for t in tokens}


class Index:
    """Segments of items, and by word and block the postings (segment, weight) and their maximum weight."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = dict(enumerate(items))
        segments: list[tuple[int, list[str]]] = []
        self.parts = {}
        for k, (_, text) in self.items.items():
            tokens = words(text)
            question, answer = question_and_answer(text)
            # Shingles of the whole item, of its question and of its answer.
            self.parts[k] = (shingles(tokens), part_shingles(question), part_shingles(answer))
            n = max(1, math.ceil(len(tokens) / SEGMENT))
            cut = [len(tokens) * j // n for j in range(n + 1)]
            segments += [(k, tokens[a:b]) for a, b in zip(cut, cut[1:]) if b > a]
        count = Counter(w for _, t in segments for w in set(t))
        # Segments that share their commonest word stand together, so that a block's maxima are close to its members' weights.
        segments.sort(key=lambda s: (max(((count[w], w) for w in s[1])), s[0]))
        self.owner = [k for k, _ in segments]
        self.longest = max((len(t) for _, t in segments), default=1)
        n, mean = len(segments), sum(len(t) for _, t in segments) / max(1, len(segments))
        self.terms = {w: j for j, w in enumerate(sorted(count))}
        self.block = max(BLOCK, -(-n // MOST_BLOCKS))
        blocks = max(1, -(-n // self.block))
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        self.block_max = np.zeros((len(self.terms) or 1, blocks), np.float32)
        for s, (_, t) in enumerate(segments):
            own = {}
            for w, tf in Counter(t).items():
                idf = math.log(1 + (n - count[w] + 0.5) / (count[w] + 0.5))
                own[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(t) / mean))
            whole = sum(own.values())
            for w, x in own.items():
                j = self.terms[w]
                postings[j].append((s, x / whole))
                self.block_max[j, s // self.block] = max(self.block_max[j, s // self.block], x / whole)
        # A word's postings by block.
        self.postings = []
        for p in postings:
            cut: dict[int, list[tuple[int, float]]] = {}
            for s, x in p:
                cut.setdefault(s // self.block, []).append((s, x))
            self.postings.append(cut)

    def search(self, terms: list[int], block: int, least: float) -> list[tuple[int, float]]:
        """WAND in one block: its segments whose score for the distinct terms is at least least. Postings below the pivot are skipped unscored."""
        lists = [(p, float(self.block_max[t, block])) for t in terms if (p := self.postings[t].get(block))]
        at, found, live, eps = [0] * len(lists), [], list(range(len(lists))), least - 1e-6
        while live:
            live.sort(key=lambda j: lists[j][0][at[j]][0])
            total, pivot = 0.0, -1
            for r, j in enumerate(live):
                total += lists[j][1]
                if total >= eps:
                    pivot = r
                    break
            if pivot < 0:
                break
            doc = lists[live[pivot]][0][at[live[pivot]]][0]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][0][at[live[pivot + 1]]][0] == doc:
                pivot += 1
            target = doc
            if lists[live[0]][0][at[live[0]]][0] == doc:
                score = sum(lists[j][0][at[j]][1] for j in live[: pivot + 1])
                if score >= eps:
                    found.append((doc, score))
                target = doc + 1
            for j in live[: pivot + 1]:
                postings, k = lists[j][0], at[j]
                while k < len(postings) and postings[k][0] < target:
                    k += 1
                at[j] = k
            live = [j for j in live if at[j] < len(lists[j][0])]
        return found

    def verify(self, item: int, have: set) -> tuple[float, float, float]:
        """Shares of the item's, its question's and its answer's shingles that are in have; a missing part counts as held."""
        return tuple(len(part & have) / len(part) if part else 1.0 for part in self.parts[item])

    def sizes(self, item: int) -> set[int]:
        """Lengths in words of the item's shingles."""
        return {len(next(iter(p))) for p in self.parts[item] if p}

    def leaks(self, texts: list[str | None], least: float = LEAST_SCORE) -> list[tuple[int, int, float, float, float, float]]:
        """(text number, item number, score, item share, question share, answer share) of verified pairs."""
        if not self.terms:
            return []
        tokens = [words(t) for t in texts]
        half = self.longest
        get, none = self.terms.get, len(self.terms)
        lengths = [len(t) for t in tokens]
        code = np.fromiter((x for t in tokens for x in map(get, t, [none] * len(t))), np.int64, sum(lengths))
        out = []
        # Passages start at every half-th word of a text; a word belongs to the half it is in and to the passage that began one half earlier.
        halves = [max(1, -(-n // half)) for n in lengths]
        first = np.concatenate([[0], np.cumsum(halves)])
        inside = np.concatenate([np.arange(n) // half for n in lengths]) if lengths else np.zeros(0, np.int64)
        cell = np.repeat(first[:-1], lengths) + inside
        known = code < none
        code, cell, later = code[known], cell[known], inside[known] > 0
        pair = np.unique(np.concatenate([cell * none + code, (cell[later] - 1) * none + code[later]]))
        passage, term = pair // none, pair % none
        starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(passage) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(passage)]
        seen: dict[tuple[int, int], float] = {}
        for low in range(0, len(starts), 4096):
            cut = starts[low : low + 4096]
            stop = ends[min(len(ends), low + 4096) - 1]
            bound = np.add.reduceat(self.block_max[term[cut[0] : stop]], cut - cut[0], axis=0)
            for p, block in zip(*np.nonzero(bound >= least - 1e-5)):
                s, e = int(cut[p]), int(ends[low + p])
                text = int(np.searchsorted(first, passage[s], "right")) - 1
                for segment, score in self.search(term[s:e].tolist(), int(block), least):
                    key = (text, self.owner[segment])
                    seen[key] = max(score, seen.get(key, 0.0))
        by_text: dict[int, list[int]] = {}
        for text, item in seen:
            by_text.setdefault(text, []).append(item)
        for text, items in by_text.items():
            t = tokens[text]
            have: set = set()
            for n in set().union(*(self.sizes(i) for i in items)):
                have.update(zip(*(t[k:] for k in range(n))))
            for item in items:
                whole, question, answer = self.verify(item, have)
                if whole >= LEAST_OVERLAP and min(question, answer) >= LEAST_PART:
                    out.append((text, item, seen[text, item], whole, question, answer))
        return sorted(out)


def _passes(benchmark: DataFrame, item_text: str, item_id: str, limit: int, one, start: DataFrame | None = None) -> list[DataFrame]:
    """one(broadcast index, token) for each block of items, or one(index, token, what the pass before kept) from start on. Each block is collected by itself; of several, a result is written before the block's index goes and the next is made."""
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    n, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.char_length("t")), F.lit(0))).first()
    parts, found = max(1, -(-n // limit), -(-chars // INDEX_CHARS)), []
    for k in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        index = _broadcast(items.sparkSession, Index([(r["i"], r["t"]) for r in mine.orderBy("i", "t").collect()]))
        out = one(index, uuid.uuid4().hex, *([] if start is None else [start]))
        if parts > 1:
            out = written(out, "leaks")
            index.destroy()
        found.append(out)
        start = None if start is None else out
    return found


def _broadcast(spark: SparkSession, index: Index):
    return spark.sparkContext.broadcast(index)


def find_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_id: str = "item_id", limit: int = INDEX_LIMIT) -> DataFrame:
    """One row a text and item that leaks into it: key, item_id, bm25_share, overlap, question_overlap, answer_overlap."""
    rows = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    schema = f"_id {rows.schema[0].dataType.simpleString()}, item_id long, bm25_share double, overlap double, question_overlap double, answer_overlap double"
    found = _passes(benchmark, item_text, item_id, limit, lambda index, token: mapped(rows, _searcher(index, token), schema))
    return reduce(DataFrame.unionByName, found).withColumnRenamed("_id", key)


def _searcher(index, token: str):
    def run(batches):
        own = kept(token, lambda: index.value)
        for batch in small_batches(batches, 128):
            ids = batch.column(0).to_pylist()
            hits = own.leaks(batch.column(1).to_pylist())
            if hits:
                yield {
                    "_id": [ids[t] for t, *_ in hits],
                    "item_id": [own.items[i][0] for _, i, *_ in hits],
                    **{n: [h[2 + k] for h in hits] for k, n in enumerate(("bm25_share", "overlap", "question_overlap", "answer_overlap"))},
                }

    return run


def drop_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_id: str = "item_id", limit: int = INDEX_LIMIT) -> DataFrame:
    """The rows of df into which no item leaks, with all their columns; one pass a block of items, no shuffle."""
    at = df.columns.index(text)
    small_transfers(df.sparkSession)

    def one(index, token, df=df):
        def run(batches):
            import pyarrow as pa

            own = kept(token, lambda: index.value)
            for batch in small_batches(batches, 128):
                clean = np.ones(batch.num_rows, bool)
                clean[[t for t, *_ in own.leaks(batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(clean))

        return df.mapInArrow(run, df.schema)

    return _passes(benchmark, item_text, item_id, limit, one, df)[-1]
