"""Operator 13 against brute force: odd rows, runs of several words, ties, empty tables."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from terrablock.llm.resampling import Features, crc_onward, resampled

from .test_operators import TEXTS, got, order, rows_of, words

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text):
    return words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""), WORDS)


def brute(texts, target, most=1, buckets=10_000, percent=10, least=20):
    def features(text):
        w = lowered(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, most + 1) for i in range(len(w) - k + 1)]

    s, t = ([0] * buckets for _ in range(2))
    for counts, side in ((s, texts), (t, target)):
        for _, text in side:
            for b in features(text):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in texts:
        f = features(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(lowered(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], order(r[0])))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


COLUMNS = ("doc_id", "n_features", "weight", "score", "rank")
TARGET = [("b1", "passage1 passage2 Passage3 the end"), ("b2", None), ("b3", ""), ("b1", "passage1 passage2 Passage3 the end"), (None, "é1 w3x0 w4x0")]


@pytest.mark.parametrize(("most", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (3, 101, 50, 1), (2, 7, 100, 0)])
def test_resampled(spark, most, buckets, percent, least):
    texts = TEXTS + [(k, f"common words of row {k % 5} " * 6) for k in range(200, 260)] + [(8, "same id again " * 9), (None, "no id " * 30), (None, "no id " * 30)]
    target = spark.createDataFrame([(i, t, "x") for i, t in TARGET], "item_id string, text string, doc_id string")
    out = resampled(rows_of(spark, texts), target, Features(most, buckets), percent, least)
    assert got(out, *COLUMNS) == brute(texts, TARGET, most, buckets, percent, least)


def test_resampled_from_and_to_nothing(spark, odd_none):
    odd, none = odd_none
    bench = spark.createDataFrame([], "item_id string, text string")
    assert got(resampled(odd, bench), *COLUMNS) == brute(TEXTS, [])
    assert resampled(none, bench).count() == 0


@pytest.fixture(scope="module")
def odd_none(spark):
    odd = rows_of(spark)
    return odd, odd.limit(0)


def test_crc_of_words_of_any_length():
    rng = np.random.default_rng(0)
    raw = rng.integers(0, 256, 5000, dtype=np.uint8)
    start = rng.integers(0, 2000, 300)
    end = start + rng.integers(0, 120, 300)
    end[:3] = 4990
    full = np.full(300, 0xFFFFFFFF, np.uint32)
    first = crc_onward(full, raw, start, end)
    assert [(int(x) ^ 0xFFFFFFFF) for x in first] == [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(start, end, strict=True)]
    second = crc_onward(first, raw, end, end + 3)
    assert [(int(x) ^ 0xFFFFFFFF) for x in second] == [zlib.crc32(raw[a : b + 3].tobytes()) for a, b in zip(start, end, strict=True)]
