"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features of a whole text: densities of a fixed insult lexicon, of learned words
and of learned stems; how many hits stand within NEAR words of a second-person
word; shares of capitals, punctuation and digits; and rates of obfuscated
spellings (digits or marks inside words, stretched letters, hits only after
undoing both). Learned lexicon, trees and calibration are fitted on disjoint
folds of at most SAMPLE labelled rows that are not held out, so the lexicon
never meets the rows that teach the trees its weight.

Null and empty texts have all-zero features and get the score of those. With
fewer than two classes to learn from, every score is the share of toxic rows.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import sample_labelled
from .shared import kept, mapped, small_batches

SAMPLE = 24_000
LEXICON_SIZE, STEMS = 600, (4, 5, 6)
NEAR = 6
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 64

INSULTS = frozenset(
    "bastard clown coward creep cretin degenerate disgusting dumb dumbass filth filthy fool freak garbage hate hateful hideous idiot idiotic imbecile jerk kill loathsome loser lowlife maggot moron moronic nasty pathetic pig psycho rat repulsive rotten scum scumbag shit slime stupid swine trash ugly useless vermin vile worthless wretch".split()
)
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur du dich dir dein deine euch ihr tu te ti tus tuyo toi ton ta tes vous votre vos usted ustedes".split())
_UNMASK = str.maketrans("013457@$!", "oieastasi")
_WORDS = re.compile(r"[^\W\d_]+")
HIT, LEARNED, STEM, YOU, MASKED, MASKED_HIT, STRETCHED = (1 << k for k in range(7))


def terms(text: str) -> set[str]:
    """Words of a text and, marked with ~, their stems."""
    words = set(_WORDS.findall(text.lower()))
    return words | {f"~{w[:n]}" for w in words for n in STEMS if len(w) > n}


def token_flags(token: str, words: frozenset, stems: frozenset) -> int:
    low = token.lower()
    bare = low.strip(".,;:!?\"'()[]{}<>-_*#%&$@|/\\")
    flags = 0
    if bare in INSULTS:
        flags |= HIT
    if bare in words:
        flags |= LEARNED
    if any(bare[:n] in stems for n in STEMS):
        flags |= STEM
    if bare in SECOND_PERSON:
        flags |= YOU
    if len(bare) > 2 and not bare.isalpha() and re.search(r"[^\W\d_][\d*@$!#.\-_]+[^\W\d_]", bare):
        flags |= MASKED
        plain = re.sub(r"[^\w]|_", "", bare.translate(_UNMASK))
        if plain in INSULTS or plain in words:
            flags |= MASKED_HIT
    if re.search(r"(\w)\1\1", bare):
        flags |= STRETCHED
        if re.sub(r"(\w)\1+", r"\1", bare) in INSULTS:
            flags |= MASKED_HIT
    return flags


class Features:
    """Feature rows of texts, with a bounded store of token flags."""

    NAMES = ("tokens", "hits", "hit_rate", "learned", "learned_rate", "stems", "stem_rate", "you_rate", "near_you", "capitals", "punctuation", "exclaims", "digits", "masked_rate", "masked_hits", "stretched_rate")

    def __init__(self, words, stems, most: int = 400_000):
        self.words, self.stems, self.most = frozenset(words), frozenset(stems), most
        self.known: dict[str, int] = {}

    def row(self, text: str | None) -> list[float]:
        tokens = (text or "").split()
        if not tokens:
            return [0.0] * len(self.NAMES)
        if len(self.known) > self.most:
            self.known = {}
        known = self.known
        for t in set(tokens).difference(known):
            known[t] = token_flags(t, self.words, self.stems)
        flags = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        n = len(tokens)
        hot = np.flatnonzero(flags & (HIT | LEARNED | STEM | MASKED_HIT))
        you = np.flatnonzero(flags & YOU)
        near = 0
        if len(hot) and len(you):
            at = np.searchsorted(you, hot)
            gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - hot), np.abs(you[np.maximum(at - 1, 0)] - hot))
            near = int((gap <= NEAR).sum())
        count = lambda bit: int(np.count_nonzero(flags & bit))
        chars = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        size = max(1, int(chars.sum()))
        hits, learned, stems = count(HIT), count(LEARNED), count(STEM)
        return [
            math.log1p(n), min(hits, 20), hits / n, min(learned, 20), learned / n, min(stems, 20), stems / n,
            count(YOU) / n, near / max(1, len(hot)), chars[65:91].sum() / size,
            (chars[33:48].sum() + chars[58:65].sum() + chars[91:97].sum() + chars[123:127].sum()) / size,
            chars[33] / size, chars[48:58].sum() / size, count(MASKED) / n, min(count(MASKED_HIT), 20), count(STRETCHED) / n,
        ]


# ---- trees and calibration


class Trees:
    """Binary logistic gradient boosting over binned features, level by level."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-4), 1 - 1e-4)
        self.base, self.trees = math.log(share / (1 - share)), []
        if len(np.unique(y)) < 2:
            self.edges = None
            return
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = self._bin(x)
        margin = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree, leaf = self._grow(binned, p - y, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            margin += tree[2][leaf]

    def _bin(self, x):
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1)

    def _grow(self, b, g, h):
        nodes = 2 ** (DEPTH + 1)
        feature, cut, at = np.full(nodes, -1), np.zeros(nodes, int), np.ones(len(g), int)
        for level in range(DEPTH):
            first, width = 2**level, 2**level
            best = np.full(width, 1e-3)
            local = at - first
            for f in range(b.shape[1]):
                key = local * (BINS + 1) + b[:, f]
                gs = np.bincount(key, g, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                hs = np.bincount(key, h, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 0.5) | (ht - hs < 0.5)] = 0
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > best
                best[better] = gain[np.arange(width), k][better]
                feature[first : first + width][better], cut[first : first + width][better] = f, k[better]
            f = feature[at]
            at = 2 * at + np.where(f >= 0, b[np.arange(len(g)), np.maximum(f, 0)] > cut[at], 0)
        value = -RATE * np.bincount(at, g, nodes) / (np.bincount(at, h, nodes) + 1)
        return (feature, cut, value), at

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if self.edges is None or not len(x):
            return out
        b, rows = self._bin(x), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.ones(len(x), int)
            for _ in range(DEPTH):
                f = feature[at]
                at = 2 * at + np.where(f >= 0, b[rows, np.maximum(f, 0)] > cut[at], 0)
            out += value[at]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: points of a non-decreasing fit. One imagined row of either class at the ends keeps it off 0 and 1."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for v, t in zip(x[order], y[order]):
        blocks.append([t, 1.0, v, v])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], hi]
    px, py = [], []
    for s, n, lo, hi in blocks:
        px += [lo, hi]
        py += [(s + 0.02) / (n + 0.04)] * 2
    return np.array(px), np.maximum.accumulate(np.array(py)) if py else np.array(py)


class Model:
    def __init__(self, words, stems, trees: Trees, points):
        self.words, self.stems, self.trees, self.points = words, stems, trees, points

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = self.trees.margin(x)
        raw = 1 / (1 + np.exp(-margin))
        if len(self.points[0]) < 2:
            return raw
        # A little of the raw probability keeps the order inside flat steps.
        return np.clip(0.98 * np.interp(margin, *self.points) + 0.02 * raw, 0, 1)


def fit(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", most: int = SAMPLE) -> Model:
    sample = sample_labelled(df, labels, label, most, text, key)

    def count_terms(batches):
        for batch in small_batches(batches):
            found = (Counter(), Counter())
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[min(1, max(0, int(y)))].update(terms(t))
            every = list(found[0].keys() | found[1].keys())
            if every:
                yield {"term": every, "clean": [found[0][t] for t in every], "toxic": [found[1][t] for t in every]}

    # Single sightings in a batch still add up over batches; the aggregation keeps what toxic rows repeat.
    first = sample.where("_fold < 4").select("_text", "_grade")
    sizes = {bool(r[0]): r[1] for r in first.groupBy(F.col("_grade") > 0).count().collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    counted = mapped(first, count_terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    least = 2 if toxic < 200 else 4
    top = counted.where((F.col("toxic") >= least) & (F.col("clean") * 10 <= F.col("toxic"))).withColumn("odds", odds).where("odds > 3").orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(LEXICON_SIZE).collect()
    words = [r["term"] for r in top if r["term"][0] != "~"]
    stems = [r["term"][1:] for r in top if r["term"][0] == "~"]

    def features(batches):
        own = Features(words, stems)
        for batch in small_batches(batches):
            yield {"x": [own.row(t) for t in batch.column(0).to_pylist()], "y": batch.column(1), "fold": batch.column(2)}

    rows = mapped(sample.where("_fold >= 4").select("_text", F.least(F.greatest(F.col("_grade").cast("int"), F.lit(0)), F.lit(1)), "_fold"), features, "x array<double>, y int, fold int").toPandas()
    x = np.array(rows["x"].tolist()).reshape(len(rows), len(Features.NAMES))
    y, fold = rows["y"].to_numpy(float), rows["fold"].to_numpy()
    # Trees of one half calibrate on the other, and the other way round; then all rows teach the trees that score.
    points = ([], [])
    for half in (0, 1):
        learn, rest = fold % 2 == half, fold % 2 != half
        if learn.any() and rest.any() and len(np.unique(y[learn])) == 2:
            points[0].append(Trees(x[learn], y[learn]).margin(x[rest]))
            points[1].append(y[rest])
    fitted = isotonic(np.concatenate(points[0]), np.concatenate(points[1])) if points[0] else (np.zeros(0), np.zeros(0))
    return Model(words, stems, Trees(x, y) if len(x) else Trees(np.zeros((0, 1)), np.zeros(0)), fitted)


def score(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score) for every row and whole text."""
    shared, token = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # LEXICON_SIZE terms and TREES small trees

    def run(batches):
        model = shared.value
        own = kept(token, lambda: Features(model.words, model.stems))
        for batch in small_batches(batches):
            x = np.array([own.row(t) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, len(Features.NAMES))
            yield {"_id": batch.column(0), "score": model.score(x)}

    rows = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    return mapped(rows, run, f"_id {rows.schema[0].dataType.simpleString()}, score double").withColumnRenamed("_id", key)
