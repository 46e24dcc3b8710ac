"""Operator 12 against brute force with the tokenizers' own libraries: odd rows, special strings, long blanks, many stripes' parts."""

import hashlib
import itertools
from collections import Counter
from functools import partial

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terrablock.llm import alignment
from terrablock.llm.alignment import Aligner, aligned
from terrablock.llm.common import table, text_blocks
from terrablock.llm.subwords import BYTE_BPE, PIECE_BPE, byte_letters, contents

from .test_operators import SF, TEXTS, got, rows_of

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = ["<|endoftext|> stays text", "<s>and</s><unk>", "a▁b", " ▁", "\n\n\t x  　y", "tail   ", "日本語 emoji 🙂 é", "\x00\x01nul", " " * 5000 + "x", "x" + "\t" * 3000, "a" * 4000, "don't we'll I'M 12345 ... ---"]


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    side_a = Tokenizer.from_file(BYTE_BPE)
    side_a.encode_special_tokens = True
    side_b = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    letters = byte_letters()
    counts, found = Counter(), []
    for i, t in texts:
        a, b, links, sha = [], [], [], ""
        if t:
            one = side_a.encode(" " + t, add_special_tokens=False)
            spelt_a = [bytes(letters[c] for c in s) for s in one.tokens]
            spelt_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in side_b.encode(t, out_type=str)]
            if b"".join(spelt_a) == b"".join(spelt_b) == (" " + t).encode():
                a, b = one.ids, side_b.encode(t)
                ends_b = {e: k for k, e in enumerate(itertools.accumulate(map(len, spelt_b)))}
                last, groups = (0, 0), []
                for k, e in enumerate(itertools.accumulate(map(len, spelt_a))):
                    if e in ends_b:
                        links.append((a[k], b[ends_b[e]]))
                        groups.append(",".join(map(str, a[last[0] : k + 1])) + "|" + ",".join(map(str, b[last[1] : ends_b[e] + 1])))
                        last = (k + 1, ends_b[e] + 1)
                sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
        counts.update(links)
        found.append((i, len(a), len(b), links, sha))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(((i, a, b, len(x), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), sha) for i, a, b, x, sha in found), key=repr)


@pytest.mark.parametrize(("stripe", "fan", "size"), [(64, 64, 8 << 20), (7, 2, 1)])
def test_aligned(spark, monkeypatch, stripe, fan, size):
    """The second case: one text a block, and matrices added two at a time."""
    monkeypatch.setattr(alignment, "BLOCK_BYTES", size)
    texts = TEXTS + [(300 + k, t) for k, t in enumerate(ODD)] + [(300, ODD[0]), (None, ODD[-1])]
    want = brute(texts)
    assert sum(r[1] == 0 for r in want) == 5  # two nulls, an empty text and the two that hold the mark of blanks itself
    assert got(aligned(rows_of(spark, texts), stripe=stripe, fan=fan), *COLUMNS) == want


def test_query_and_nothing(spark):
    assert aligned(rows_of(spark).limit(0)).count() == 0
    docs = table(spark, SF, "documents")
    assert got(alignment.op12_align(spark, SF), *COLUMNS) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_texts_that_are_not_spelt_have_no_tokens():
    """A vocabulary without some bytes can't spell every text: those have zeros, their neighbours keep their tokens."""
    aligner = Aligner(contents(BYTE_BPE), contents(PIECE_BPE))
    texts = ["first text", "a▁b", "last text"]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    n_a, n_b, groups, sha, a, b = aligner.block(np.frombuffer(raw, np.uint8), offsets)
    assert n_a.tolist() == [2, 0, 2] and n_b[1] == groups[1] == 0 and sha[1] == "" and len(a) == len(b) == groups.sum()


def test_blocks_of_many_pieces(spark, monkeypatch):
    """A block's links are told apart piece by piece: a text or two each."""
    monkeypatch.setattr(alignment, "text_blocks", partial(text_blocks, block=60))
    texts = TEXTS + [(300 + k, t) for k, t in enumerate(ODD)]
    docs = rows_of(spark, texts).coalesce(1)
    per = alignment.linked_blocks(docs, BYTE_BPE, PIECE_BPE).groupBy("block").agg(F.count("*").alias("n"), F.count_if(F.col("a").isNotNull()).alias("k")).collect()
    assert len(per) == 1 and per[0].n > 10 and per[0].k == 1
    assert got(aligned(docs), *COLUMNS) == brute(texts)


def test_rows_stay_small(spark, monkeypatch):
    """A block of 4 MB of text is saved in rows of 1 MB and in several row groups, so that neither Java nor Python holds it as one value."""
    words = "some words of plain text that repeat and differ by a number"
    monkeypatch.setattr(alignment, "ROW_GROUPS", alignment.ROW_GROUPS | {"parquet.block.size": 1 << 20})
    docs = rows_of(spark, [(i, " ".join(f"{words} {i * 37 + j}" for j in range(1500))) for i in range(45)]).coalesce(1)
    pieces = alignment.linked_blocks(docs, BYTE_BPE, PIECE_BPE)
    size = [r.n for r in pieces.select("block", F.length("link").alias("n")).collect()]
    assert pieces.select("block").distinct().count() == 1 and len(size) >= 4 and max(size) < 2 << 20
    assert sum(pq.ParquetFile(f.removeprefix("file://")).num_row_groups for f in pieces.inputFiles()) > 1
