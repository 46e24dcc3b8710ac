"""Operator 3: toxicity after noisy-channel deobfuscation.

A character trigram model is counted over all documents. Words that look disguised (digits or signs among letters,
stretched letters, letters set apart) become lattices of readings, and a Viterbi search under the model picks the
likeliest. A lexicon of words and word beginnings with weights is learnt from labelled rows and scores the restored text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SpanHash, Words, arrow_rows, fold_of, mix, small_side, summed, table, text_blocks

FOLDS, HELD_OUT = 3, 1
CUT = 0.7
#: The lexicon is fitted on at most this many labelled rows, those with the smallest hash of their id.
MOST_LABELLED = 40_000
#: A lexicon entry needs so many distinct toxic texts, this lower bound on its precision, and so many toxic texts to a clean one.
LEAST_TOXIC, LEAST_PRECISION, LEAST_ODDS = 5, 0.64, 20
#: Score of a text without any lexicon word.
BASE_SCORE = 0.03
PREFIXES = (4, 5, 6)

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
NOT_LETTER = ~LETTER
#: Symbols of the character model: 0 outside words, 1-26 letters, 27 any byte beyond ASCII.
SYMBOL = np.zeros(256, np.int64)
SYMBOL[65:91] = SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[128:] = 27
N_SYMBOLS = 28
# What signs stand for in disguised words.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "abcdefghijklmnopqrstuvwxyz"}
IS_LEET = np.zeros(256, bool)
IS_LEET[[ord(x) for x in LEET]] = True
#: Channel costs (natural logarithms): a sign read as a letter, a wild card, letters dropped from a stretch, a gap closed or kept.
SIGN, WILD, SHORTEN, CLOSE, KEEP = -0.5, -1.0, -0.3, -0.2, -0.2
KEPT = 128  # bytes of a disguised word or span whose answer is kept
GAP = re.compile(rb"[^A-Za-z0-9@$!|+(<*\x80-\xff]+")  # what neither is a letter nor stands for one
SPACED = re.compile(rb"(?<![^\s\x00])(?:[A-Za-z0-9@$!][\s._*-]+){3,}[A-Za-z0-9@$!](?![^\s\x00.,;:!?])")
EDGE = b"\0"  # parts the texts of a block: no span reads over it


def char_counts(docs: DataFrame) -> np.ndarray:
    """Counts of symbol trigrams over every byte of every document, shape (28, 28, 28)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_SYMBOLS**3)
        for _, raw, offsets in text_blocks(batches):
            s = SYMBOL[raw]
            if len(s) > 2:
                inside = np.ones(len(s), bool)  # a trigram that runs into the next text doesn't count
                inside[offsets[1:][offsets[1:] > 0] - 1] = False
                whole = inside[:-2] & inside[1:-1]
                total += np.bincount(((s[:-2] * N_SYMBOLS + s[1:-1]) * N_SYMBOLS + s[2:])[whole], minlength=N_SYMBOLS**3)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    found = summed(docs.select("text").mapInArrow(part, "v array<double>"))
    return (found if len(found) else np.zeros(N_SYMBOLS**3)).reshape((N_SYMBOLS,) * 3)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(third symbol | two before), backed off to pairs and single symbols."""
    single = (counts.sum(axis=(0, 1)) + 1) / (counts.sum() + N_SYMBOLS)
    pair_counts = counts.sum(axis=0)
    pair = (pair_counts + 5 * single) / (pair_counts.sum(axis=1, keepdims=True) + 5)
    return np.log((counts + 5 * pair[None]) / (counts.sum(axis=2, keepdims=True) + 5))


def readings(token: str) -> list[list[tuple[str, float]]]:
    """The lattice of a disguised word: for each step the strings it may stand for, with their channel cost."""
    steps: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c, j = token[i], i
        while j < len(token) and token[j] == c:
            j += 1
        if c.isalpha():
            steps.append([(c * (j - i), 0.0)] if j - i == 1 else [(c * 2, 0.0), (c, SHORTEN)])
            i = j
        elif c in LEET:
            signs = [(x, WILD if c == "*" else SIGN) for x in LEET[c]]
            steps.append(signs + [(x * 2, SIGN + SHORTEN) for x, _ in signs] if j - i > 1 else signs)
            i = j
        else:
            if any(steps) and j < len(token):
                steps.append([("", CLOSE), (" ", KEEP)])
            i = j
    return steps


def viterbi(steps: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The likeliest path through the lattice under the character model; blanks part words."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}  # score, path as (path before, text)
    for options in steps:
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in best.items():
            for text, cost in options:
                x, y, total = a, b, score + cost
                for c in text:
                    z = 0 if c == " " else int(SYMBOL[ord(c)]) if ord(c) < 128 else 27
                    total += model[x, y, z]
                    x, y = y, z
                if (x, y) not in new or total > new[x, y][0]:
                    new[x, y] = (total, (path, text))
        best = new
    path = max(((score + model[a, b, 0], path) for (a, b), (score, path) in best.items()), key=lambda x: x[0])[1]
    texts = []
    while path:
        path, text = path
        texts.append(text)
    return "".join(reversed(texts))


class Restorer:
    """Restores the disguised words of a block; answers for words seen before are kept, up to a bound."""

    def __init__(self, model: np.ndarray, keep: int = 200_000):
        self.model, self.keep, self.seen = model, keep, {}

    def word(self, token: bytes) -> list[bytes]:
        if token in self.seen:
            return self.seen[token]
        text = viterbi(readings(token.decode("utf-8", "ignore").lower()), self.model)
        out = [x.encode() for x in text.split() if len(x) > 2]
        if len(token) <= KEPT:
            if len(self.seen) >= self.keep:
                self.seen.clear()
            self.seen[token] = out
        return out

    def block(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[int]]:
        """The restored words and their document numbers; a text's words don't depend on the block it comes in."""
        words = Words(raw, offsets)
        if not len(words.start):
            return [], []
        letters = np.append(0, np.cumsum(LETTER[raw]))
        signs = np.append(0, np.cumsum(IS_LEET[raw]))
        last = words.end - 1  # trailing signs are punctuation
        for _ in range(3):
            last = np.where((last > words.start) & ~LETTER[raw[last]] & ~((raw[last] >= 48) & (raw[last] <= 57)), last - 1, last)
        n_letters = letters[last + 1] - letters[words.start]
        n_signs = signs[last + 1] - signs[words.start]
        same = np.zeros(len(raw), np.int64)
        if len(raw) > 2:
            same[:-2] = (raw[:-2] == raw[1:-1]) & (raw[1:-1] == raw[2:]) & LETTER[raw[:-2]] & (raw[:-2] < 128)
        stretched = np.append(0, np.cumsum(same))
        n_same = stretched[np.maximum(last - 1, words.start)] - stretched[words.start]
        digits = np.append(0, np.cumsum((raw >= 48) & (raw <= 57)))
        n_digits = digits[last + 1] - digits[words.start]
        some = (n_signs > 0) & ((n_letters > 0) | (n_signs > n_digits)) & (last - words.start >= 2)  # not plain numbers
        odd = (some & (n_signs <= 2 * n_letters + 1)) | (n_same > 0)
        found, owner = [], []
        whole = raw.tobytes()

        def restore(token: bytes, doc: int) -> None:
            for x in self.word(token):
                found.append(x)
                owner.append(doc)

        for k in np.flatnonzero(some | odd):
            token = whole[words.start[k] : last[k] + 1]
            if odd[k]:
                restore(token, int(words.doc[k]))
                continue
            for part in GAP.split(token):  # too many signs in all, but not in each part
                code = np.frombuffer(part, np.uint8)
                if len(part) > 2 and IS_LEET[code].any() and (LETTER[code].any() or not part.isdigit()):
                    restore(part, int(words.doc[k]))
        parted = EDGE.join(whole[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))  # no span reaches into the next text
        first = offsets[:-1] + np.arange(len(offsets) - 1)
        for m in SPACED.finditer(parted):
            restore(m.group(), int(np.searchsorted(first, m.start(), "right") - 1))
        return found, owner


class Features:
    """Feature hashes of a block's words, restored ones too: whole word first, then its beginnings; 0 where it has none."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, restorer: Restorer):
        words = Words(raw, offsets, NOT_LETTER, lower=True)
        extra, owner = restorer.block(raw, offsets)
        ends = np.cumsum([len(x) for x in extra], dtype=np.int64) + len(raw)
        start = np.append(words.start, ends - np.array([len(x) for x in extra], np.int64)).astype(np.int64)
        end = np.append(words.end, ends).astype(np.int64)
        self.doc = np.append(words.doc, np.array(owner, np.int64)).astype(np.int64)
        spans = SpanHash(np.append(words.raw, LOWER[np.frombuffer(b"".join(extra), np.uint8)]))
        size = end - start
        self.word = spans(start, end)
        self.hash = [np.where(size >= 3, self.word, 0).astype(np.uint64)]
        for k in PREFIXES:
            self.hash.append(np.where(size > k, mix(spans(start, np.minimum(start + k, end)) + np.uint64(k)), 0).astype(np.uint64))
        grams, inside = words.grams(3)
        self.sketch = np.full(len(offsets) - 1, np.iinfo(np.uint64).max)
        np.minimum.at(self.sketch, words.doc[: len(grams)][inside], grams[inside])


def lexicon(labelled: DataFrame, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature hashes and weights (lower bounds of precision), from labelled rows (text, toxic).

    Near copies of one toxic text count once (same smallest hash of a word triple). A beginning needs two words.
    """

    def toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        schema = pa.schema([("feature", pa.int64()), ("prefix", pa.bool_()), ("sketch", pa.int64()), ("word", pa.int64())])
        for _, raw, offsets in text_blocks(batches):
            f = Features(raw, offsets, restorer)
            for k, h in enumerate(f.hash):
                at = np.flatnonzero(h)
                frame = pd.DataFrame({"feature": h[at].view(np.int64), "sketch": f.sketch[f.doc[at]].view(np.int64), "word": f.word[at].view(np.int64)}).drop_duplicates()
                yield arrow_rows(schema, frame.feature.to_numpy(), np.full(len(frame), k > 0), frame.sketch.to_numpy(), frame.word.to_numpy())

    uses = labelled.where("toxic = 1").select("text").mapInArrow(toxic, "feature long, prefix boolean, sketch long, word long")
    once = uses.groupBy("feature", "prefix", "sketch").agg(F.min("word").alias("low"), F.max("word").alias("high"))
    counts = once.groupBy("feature", "prefix").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    kept = counts.where((F.col("n") >= LEAST_TOXIC) & (~F.col("prefix") | (F.col("low") != F.col("high")))).select("feature", "n").toPandas()
    kept = kept.sort_values("feature")  # bounded by the sample of labelled rows
    wanted = kept.feature.to_numpy(np.int64)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, total = Restorer(model), np.zeros(len(wanted))
        for _, raw, offsets in text_blocks(batches):
            f = Features(raw, offsets, restorer)
            for h in f.hash:
                at = find(wanted, h.view(np.int64))
                pairs = np.unique(at[at >= 0] + len(wanted) * f.doc[at >= 0])
                total += np.bincount(pairs % max(len(wanted), 1), minlength=len(wanted))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    if not len(wanted):
        return wanted, np.zeros(0)
    c = summed(labelled.where("toxic = 0").select("text").mapInArrow(clean, "v array<double>"))
    t = kept.n.to_numpy(float)
    c = c if len(c) else np.zeros(len(t))
    n, z = t + c, 1.645
    p = t / n
    low = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    good = (low >= LEAST_PRECISION) & (c * LEAST_ODDS <= t)
    return wanted[good], low[good]


def find(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted array known, -1 if it isn't there."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where((known[at] == values) & (values != 0), at, -1)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words (lexicon words, each once) for each row of docs.

    Nulls: a null text is empty, a null doc_id has no label and isn't held out; labels of null id or null toxic are
    none, and of several labels of one document the largest holds. A text without lexicon words, an empty one, or any
    text if no label is toxic, scores BASE_SCORE, so ties are common. Repeated rows are scored each; only the text, all
    of it, is scored; an empty table gives no rows. A block, or a longer text alone, is held with some tens of bytes a byte.
    """
    truth = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(fold_of(FOLDS) != HELD_OUT)
    truth = truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED).select(F.col("doc_id").alias("_id"), "toxic")
    labelled = docs.select("doc_id", "text").join(small_side(truth), F.col("doc_id") == F.col("_id")).select("text", "toxic")
    model = log_model(char_counts(docs))
    known, weight = lexicon(labelled, model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_words", pa.int64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch, raw, offsets in text_blocks(batches):
            f = Features(raw, offsets, restorer)
            best = np.zeros(len(f.word))
            for h in f.hash:
                at = find(known, h.view(np.int64))
                hit = at >= 0
                best[hit] = np.maximum(best[hit], weight[at[hit]])
            at = np.flatnonzero(best)
            _, first = np.unique(mix(f.word[at] + f.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
            at = at[first]
            none = np.bincount(f.doc[at], np.log1p(-best[at]), batch.num_rows)
            yield arrow_rows(schema, batch.column(0), 1 - (1 - BASE_SCORE) * np.exp(none), np.bincount(f.doc[at], minlength=batch.num_rows))

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double, n_words long")
    return scored.select("doc_id", (fold_of(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "n_words")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
