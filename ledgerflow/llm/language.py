"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's likelihood is the sum over all its segmentations into pieces, which a
forward algorithm gives in one pass; a character that no piece covers costs a
fixed small probability. A text's score for a language is the sum of its words'
log likelihoods and the log prior; the probability of the best language is the
softmax at the evidence scale of SHARPNESS words.

Words are runs of letters, lower-cased. Texts that are null, empty or without
a letter are "und" with score 0. Learning reads only texts and non-null
languages of rows that are not held out, at most DOCUMENTS a language by hash
of the id, and their WORDS most frequent words; expectation maximisation runs
on those counts. Scoring reads every whole text. With nothing to learn from,
every text is "und".
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import crc_bucket, kept, mapped, small_batches

VOCABULARY = "piece_bpe_32k.model"
DOCUMENTS, WORDS, ROUNDS = 2000, 6000, 2
UNKNOWN = 1e-7
SHORT = 40  # letters up to which a word's likelihood cannot underflow
SHARPNESS = 20.0
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@lru_cache(2)
def vocabulary(path: str) -> dict[str, int]:
    """Pieces made of letters, with the mark of a word's start where they have it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[str, int] = {}
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k).lower()
        if _WORD.fullmatch(piece.lstrip("▁")) and piece.count("▁") <= 1:
            found.setdefault(piece, len(found))
    return found


def spans(word: str, pieces: dict[str, int], longest: int) -> list[list[tuple[int, int]]]:
    """For each end, the (start, piece) that end there; a word starts with its mark."""
    word = "▁" + word
    n = len(word)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        for j in range(i + 1, min(n, i + longest) + 1):
            if (p := pieces.get(word[i:j])) is not None:
                out[j].append((i, p))
    return out


def forward(word: str, pieces: dict[str, int], longest: int, chances: dict[int, list[float]], k: int) -> list[float]:
    """Log likelihood of a word in each of k languages, summed over all segmentations. The running sums are rescaled, so words of any length are safe."""
    ends = spans(word, pieces, longest)
    alpha: list[list[float]] = [[1.0] * k]
    scale = 0.0
    for j in range(1, len(ends)):
        row = [UNKNOWN * a for a in alpha[j - 1]]
        for i, p in ends[j]:
            if (c := chances.get(p)) is not None:
                row = [r + a * x for r, a, x in zip(row, alpha[i], c)]
        alpha.append(row)
        if j % 16 == 0:  # bring the window that later pieces can start in back to 1
            top = max(max(a) for a in alpha[-longest:])
            scale += math.log(top)
            alpha = alpha[: max(0, j + 1 - longest)] + [[a / top for a in r] for r in alpha[max(0, j + 1 - longest) :]]
    return [scale + math.log(max(a, 1e-300)) for a in alpha[-1]]


def fit_language(counts: dict[str, int], pieces: dict[str, int], longest: int, rounds: int = ROUNDS) -> dict[int, float]:
    """Piece probabilities of one language by expectation maximisation over word counts."""
    table = [(spans(w, pieces, longest), n) for w, n in counts.items()]
    chance: dict[int, float] = {}
    for ends, n in table:
        for at in ends:
            for i, p in at:
                chance[p] = chance.get(p, 0.0) + n
    for _ in range(rounds + 1):
        total = sum(chance.values()) or 1.0
        chance = {p: c / total for p, c in chance.items() if c > 1e-12}
        expected: dict[int, float] = {}
        for ends, n in table:
            m = len(ends)
            a, b = [1.0] + [0.0] * (m - 1), [0.0] * (m - 1) + [1.0]
            for j in range(1, m):
                a[j] = UNKNOWN * a[j - 1] + sum(a[i] * chance.get(p, 0.0) for i, p in ends[j])
            for j in range(m - 1, 0, -1):
                b[j - 1] += UNKNOWN * b[j]
                for i, p in ends[j]:
                    b[i] += b[j] * chance.get(p, 0.0)
            if a[-1] > 0:
                for j in range(1, m):
                    for i, p in ends[j]:
                        expected[p] = expected.get(p, 0.0) + n * a[i] * chance.get(p, 0.0) * b[j] / a[-1]
        chance = expected
    total = sum(chance.values()) + 0.01 * len(chance) or 1.0
    return {p: (c + 0.01) / total for p, c in chance.items()}


class Model:
    """Languages in order, their log priors, and piece probabilities by piece, one a language; pieces a language never used have a floor."""

    def __init__(self, fitted: dict[str, dict[int, float]], documents: dict[str, int], pieces: dict[str, int]):
        self.languages = sorted(fitted)
        total = sum(documents.values()) or 1
        self.prior = [math.log(max(1, documents[x]) / total) for x in self.languages]
        self.longest = max(map(len, pieces), default=1)
        used = set().union(*fitted.values()) if fitted else set()
        self.chances = {p: [fitted[x].get(p, 1e-8) for x in self.languages] for p in used}


class Scorer:
    """A process's view of a model, with a bounded store of word scores."""

    def __init__(self, model: Model, pieces: dict[str, int], most: int = 500_000):
        self.model, self.most = model, most
        self.pieces = {w: p for w, p in pieces.items() if p in model.chances}
        self.longest = max(map(len, self.pieces), default=1)
        self.prefixes = {w[:n] for w in self.pieces for n in range(1, len(w))}
        self.chance = np.zeros((max(pieces.values(), default=0) + 1, max(1, len(model.languages))))
        for p, c in model.chances.items():
            self.chance[p] = c
        self.clear()

    def clear(self):
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, self.chance.shape[1]))

    def learn(self, new: list[str]) -> None:
        """Run the forward algorithm for new words, all of a length at most SHORT together, position by position."""
        k = self.chance.shape[1]
        while len(self.scores) < len(self.known) + len(new):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        first = len(self.known)
        self.known.update(zip(new, range(first, first + len(new))))
        out = self.scores[first : first + len(new)]
        pieces, prefixes = self.pieces, self.prefixes
        for low in range(0, len(new), 8192):
            block = new[low : low + 8192]
            width = min(SHORT, max(map(len, block))) + 1
            hits: list[list[int]] = [[] for _ in range(width + 1)]  # word, start and piece, flat
            short = []
            for at, word in enumerate(block):
                if len(word) > SHORT:
                    out[low + at] = forward(word, self.pieces, self.longest, self.model.chances, k)
                    continue
                short.append(at)
                word = "▁" + word
                n = len(word)
                for i in range(n):
                    for j in range(i + 1, n + 1):
                        part = word[i:j]
                        if (p := pieces.get(part)) is not None:
                            hits[j] += (at, i, p)
                        if part not in prefixes:
                            break
            alpha = np.zeros((len(block), width + 1, k))
            alpha[:, 0] = 1.0
            for j in range(1, width + 1):
                alpha[:, j] = UNKNOWN * alpha[:, j - 1]
                if hits[j]:
                    w, i, p = np.array(hits[j]).reshape(-1, 3).T  # in order of words
                    starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                    alpha[w[starts], j] += np.add.reduceat(alpha[w, i] * self.chance[p], starts, axis=0)
            ends = np.array([len(block[at]) + 1 for at in short], int)
            out[low + np.array(short, int)] = np.log(np.maximum(alpha[short, ends], 1e-300))

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        m = self.model
        tokens = [words(t) for t in texts]
        if not m.languages:
            return [("und", 0.0)] * len(texts)
        if len(self.known) > self.most:
            self.clear()
        new = list(set().union(*tokens).difference(self.known))
        if new:
            self.learn(new)
        known, out = self.known.__getitem__, []
        for t in tokens:
            if not t:
                out.append(("und", 0.0))
                continue
            totals = self.scores[np.fromiter(map(known, t), np.int64, len(t))].sum(0) + m.prior
            best = int(totals.argmax())
            out.append((m.languages[best], float(1.0 / np.exp((totals - totals[best]) / max(1.0, len(t) / SHARPNESS)).sum())))
        return out


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", path: str | None = None, documents: int = DOCUMENTS, most_words: int = WORDS) -> Model:
    """Learn from rows that are not held out: about documents texts a language, chosen by hash, and their most frequent words."""
    pieces = vocabulary(path or public_tokenizers.path(VOCABULARY))
    rows = df.where(F.col(lang).isNotNull() & (F.coalesce(crc_bucket(key), F.lit(0)) != 2)).select(F.col(key).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    sizes = {r[0]: r[1] for r in rows.groupBy("_lang").count().collect()}
    if not sizes:
        return Model({}, {}, pieces)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, documents / n)))])
    sample = rows.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < F.element_at(share, F.col("_lang")) * 1_000_000)

    def run(batches):
        for batch in small_batches(batches):
            found: dict[str, Counter] = {}
            for l, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(l, Counter()).update(w for w in words(t) if len(w) <= 40)
            flat = [(l, w, n) for l, c in found.items() for w, n in c.items()]
            if flat:
                yield dict(zip(("lang", "word", "n"), map(list, zip(*flat))))

    counted = mapped(sample.select("_lang", "_text"), run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    fitted: dict[str, dict[str, int]] = {l: {} for l in sizes}
    for r in counted.withColumn("_r", rank).where(F.col("_r") <= most_words).collect():
        fitted[r["lang"]][r["word"]] = r["n"]
    longest = max(map(len, pieces), default=1)
    return Model({l: fit_language(c, pieces, longest) for l, c in fitted.items()}, sizes, pieces)


def predict(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, lang_pred, score) for every row and whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # as large as the fixed vocabulary times the languages
    name, token = path or public_tokenizers.path(VOCABULARY), uuid.uuid4().hex

    def run(batches):
        scorer = kept(token, lambda: Scorer(shared.value, vocabulary(name)))
        for batch in small_batches(batches):
            out = scorer.score(batch.column(1).to_pylist())
            yield {"_id": batch.column(0), "lang_pred": [x for x, _ in out], "score": [x for _, x in out]}

    rows = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    return mapped(rows, run, f"_id {rows.schema[0].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("_id", key)
