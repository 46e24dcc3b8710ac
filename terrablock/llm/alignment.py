"""Operator 12: cross-tokenizer alignment by id-striped dense count matrices.

Both tokenizers write the same bytes, so the offsets where a token of each ends cut a text into groups, and the two tokens
that end there are linked. Each task encodes blocks of text and keeps, for each block, its distinct id pairs, how often
each occurs, and which pair each link is. Pairs are dealt by stripes of side B's ids; in a stripe np.add.at adds the
blocks' counts into a dense matrix, stripe ids by side A's ids, in a tree of tasks, so that a stripe with a frequent id
never meets whole. Row maxima of the last matrix give each id's best partner. The counts go back to the blocks that hold
the pairs, which score their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, materialise, table, text_blocks
from .subwords import BYTE_BPE, PIECE_BPE, ByteBPE, PieceBPE, contents, made

#: Ids of side B in a stripe; parts of a stripe whose matrices are added in one task.
STRIPE, FAN = 64, 64
#: Bytes of text whose links are kept in one row (a longer text comes alone).
BLOCK_BYTES = 8 << 20

#: A block's row groups are cut by size after every row, however few rows there are, so that a reader never holds a whole file.
ROW_GROUPS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1}

LONGS, INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
PIECE = pa.schema([("block", pa.int64()), ("piece", pa.int32()), ("doc_id", LONGS), ("n_a", LONGS), ("n_b", LONGS), ("n_groups", LONGS), ("sha", pa.list_(pa.string())), ("link", pa.binary()), ("a", INTS), ("b", INTS), ("n", LONGS)])
PIECE_SQL = "block long, piece int, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, sha array<string>, link binary, a array<int>, b array<int>, n array<long>"
STRIPED = pa.schema([("stripe", pa.int32()), ("block", pa.int64()), ("a", INTS), ("b", INTS), ("n", LONGS)])
STRIPED_SQL = "stripe int, block long, a array<int>, b array<int>, n array<long>"
DOCUMENT = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string())])
DOCUMENT_SQL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def encoded(texts: list[bytes], tokenizer, lead: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, how many each has)."""
    ids = [tokenizer.encode(lead + x.decode()) if x else [] for x in texts]
    size = np.array([len(x) for x in ids], np.int64)
    flat = np.empty(size.sum(), np.int64)
    at = 0
    for x in ids:
        flat[at : at + len(x)] = x
        at += len(x)
    return flat, size


def digit_entries(n: int, end: str) -> np.ndarray:
    return np.array([f"{i}{end}".encode() for i in range(n)], object)


class Aligner:
    """Groups and links of blocks of texts under two tokenizers."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = made(ByteBPE, a), made(PieceBPE, b)
        self.a_mid, self.a_end = (digit_entries(self.a.n, x) for x in ",|")
        self.b_mid, self.b_end = (digit_entries(self.b.n, x) for x in ",;")

    def spells(self, tokens: tuple[np.ndarray, np.ndarray], table_, want: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each text's tokens are, joined, its bytes in want (which end at ends)."""
        ids, size = tokens
        begins = np.append(0, ends[:-1])
        owner = np.repeat(np.arange(len(size)), size)
        right = np.bincount(owner, table_.size[ids], len(size)).astype(np.int64) == ends - begins
        kept = right[owner]
        joined, there = table_.join(ids[kept]), np.repeat(right, ends - begins)
        differ = np.flatnonzero(joined != want[there])
        right[np.searchsorted(ends, np.flatnonzero(there)[differ], "right")] = False
        return right

    def block(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each text n_a, n_b, n_groups, sha; then the linked ids (a, b) of all texts in order."""
        docs = len(offsets) - 1
        whole = raw.tobytes()
        texts = [whole[x:y] for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
        a, b = encoded(texts, self.a, " "), encoded(texts, self.b, "")
        some = np.diff(offsets) > 0
        want = np.frombuffer(b"".join(b" " + x for x in texts if x), np.uint8)
        ends = np.cumsum(np.where(some, np.diff(offsets) + 1, 0))
        same = some.copy()
        for tokens, tokenizer in ((a, self.a), (b, self.b)):
            same &= self.spells(tokens, tokenizer.table, want, ends)
        (ids_a, n_a), (ids_b, n_b) = ((ids[np.repeat(same, n)], np.where(same, n, 0)) for ids, n in (a, b))
        end_a, end_b = np.cumsum(self.a.table.size[ids_a]), np.cumsum(self.b.table.size[ids_b])
        mark = np.zeros((end_a[-1] if len(end_a) else 0) + 1, bool)
        mark[end_b] = True
        last_a = mark[end_a]  # tokens that end a group
        mark[end_b] = False
        mark[end_a] = True
        last_b = mark[end_b]
        first_a, first_b = (np.append(0, np.cumsum(n)) for n in (n_a, n_b))
        done = np.append(0, np.cumsum(last_a))
        groups = np.diff(done[first_a])
        return n_a, n_b, groups, self.digests(ids_a, ids_b, last_a, last_b, first_a, first_b), ids_a[last_a], ids_b[last_b]

    def digests(self, ids_a, ids_b, last_a, last_b, first_a, first_b) -> list[str]:
        """SHA-256 of each text's groups as `a1,a2|b1;a3|b2,b3`; '' without tokens."""
        done_a, done_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1  # tokens through each group
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        line = np.empty(len(ids_a) + len(ids_b), object)
        line[np.arange(len(ids_a)) + np.append(0, done_b)[group_a]] = np.where(last_a, self.a_end[ids_a], self.a_mid[ids_a])
        line[np.arange(len(ids_b)) + np.append(done_a, 0)[group_b]] = np.where(last_b, self.b_end[ids_b], self.b_mid[ids_b])
        cut = (first_a + first_b).tolist()
        return [hashlib.sha256(b"".join(line[x:y].tolist())[:-1]).hexdigest() if y > x else "" for x, y in zip(cut[:-1], cut[1:], strict=True)]


def linked_blocks(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A saved row for each piece of a block of texts: its documents' figures and the pair of each link, as its place among
    the block's distinct pairs; the block's first piece has these pairs with their counts.

    Links are told apart piece by piece, and only a piece's distinct pairs wait for the others of its block.
    """
    files = docs.sparkSession.sparkContext.broadcast((contents(a), contents(b)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*files.value)
        name, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            pair, place = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            n = np.bincount(place, np.concatenate([x[1] for x in held]), len(pair)).astype(np.int64)
            known, at = [pair % aligner.a.n, pair // aligner.a.n, n], 0
            for k, (own, _, link, *figures) in enumerate(held):
                links = place[at : at + len(own)].astype(np.uint32)[link].tobytes()
                at += len(own)
                yield arrow_rows(PIECE, [name], [k], *([x] for x in figures), [links], *([x] if k == 0 else [None] for x in known))

        for batch, raw, offsets in text_blocks(batches):
            n_a, n_b, groups, sha, x, y = aligner.block(raw, offsets)
            pair, link, n = np.unique(y * aligner.a.n + x, return_inverse=True, return_counts=True)
            held.append((pair, n, link.astype(np.uint32), batch.column(0).to_pylist(), n_a, n_b, groups, sha))
            size += len(raw)
            if size >= BLOCK_BYTES:
                yield from out()
                name, held, size = name + 1, [], 0
        if held:
            yield from out()

    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(blocks, PIECE_SQL), ROW_GROUPS)


def dense_sums(frame: pd.DataFrame, stripe: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, count, whether b has no higher one) of the pairs of a stripe's parts, added one by one into a matrix of its B ids by the A ids in use."""
    seen = np.zeros(1 + max((x.max() for x in frame.a if len(x)), default=0), bool)
    for a in frame.a:
        seen[a] = True
    used, column = np.flatnonzero(seen), np.cumsum(seen) - 1
    counts = np.zeros((stripe, len(used)), np.int64)
    for a, b, n in zip(frame.a, frame.b, frame.n, strict=True):
        np.add.at(counts, (b % stripe, column[a]), n)
    row, column = np.nonzero(counts)
    total = counts[row, column]
    return used[column], int(frame.stripe.iloc[0]) * stripe + row, total, total == counts.max(axis=1)[row]


def pair_counts(blocks: DataFrame, stripe: int, fan: int) -> DataFrame:
    """A saved table of a, b, total, best: each pair's number of links in the corpus, and whether b has no more with any other."""

    def add_parts(frame: pd.DataFrame) -> pd.DataFrame:
        a, b, n, _ = dense_sums(frame, stripe)
        return pd.DataFrame({"stripe": frame.stripe.iloc[:1], "part": frame.part.iloc[:1], "a": [a], "b": [b], "n": [n]})

    def best_of(frame: pd.DataFrame) -> pd.DataFrame:
        a, b, n, best = dense_sums(frame, stripe)
        return pd.DataFrame({"a": a.astype(np.int32), "b": b.astype(np.int32), "total": n, "best": best})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch.column(0).to_pylist()):
                a, b, n = (c[i].values.to_numpy() for c in batch.columns[1:])  # pairs stand in order of b
                stripes, first = np.unique(b // stripe, return_index=True)
                cut = [np.split(x, first[1:]) if len(first) else [] for x in (a, b, n)]
                yield arrow_rows(STRIPED, stripes, np.full(len(stripes), block), *cut)

    parts = -(-blocks.count() // fan)
    rows = blocks.select("block", "a", "b", "n").mapInArrow(deal, STRIPED_SQL).withColumn("part", F.pmod(F.xxhash64("block"), F.lit(max(parts, 1))).cast("int")).drop("block")
    while parts > 1:  # no task adds up more than about fan parts of a stripe
        rows = rows.groupBy("stripe", "part").applyInPandas(add_parts, "stripe int, part int, a array<int>, b array<int>, n array<long>")
        parts = -(-parts // fan)
        rows = rows.withColumn("part", F.pmod("part", F.lit(parts)).cast("int"))
    return materialise(rows.groupBy("stripe").applyInPandas(best_of, "a int, b int, total long, best boolean"))


def score_block(pieces: pa.Table, known: pa.Table) -> pa.Table:
    """The documents of one block: each link takes its pair's total, and whether it is its B id's best."""
    order = np.argsort(known.column("place").to_numpy())
    best, total = (known.column(c).to_numpy().astype(np.int64)[order] for c in ("best", "total"))
    found = [DOCUMENT.empty_table()]
    for i in range(pieces.num_rows):
        doc_id, n_a, n_b, n_groups, sha = (pieces.column(c)[i].values for c in ("doc_id", "n_a", "n_b", "n_groups", "sha"))
        link = np.frombuffer(pieces.column("link")[i].as_buffer(), np.uint32)
        cut = np.append(0, np.cumsum(n_groups.to_numpy()))
        per = [(running := np.append(0, np.cumsum(values[link])))[cut[1:]] - running[cut[:-1]] for values in (best, total)]
        found.append(pa.Table.from_arrays([doc_id, n_a, n_b, n_groups, n_groups, *map(pa.array, per), sha], schema=DOCUMENT))
    return pa.concat_tables(found)


def aligned(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE, stripe: int = STRIPE, fan: int = FAN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs.

    a: the path of a byte-level vocabulary (JSON), b: of a piece model. A null or empty text, or one that either tokenizer
    doesn't spell byte by byte (with the blank before it), has no tokens: zeros and ''. Ties: every pair that has its B
    id's highest count is a best one. Repeated rows are each encoded and counted; a null doc_id is returned as null; an
    empty table gives no rows; other columns are ignored. Links are at most as many as tokens; a block keeps 4 bytes for
    each, and no matrix has over stripe rows and as many columns as side A has ids.
    """
    pieces = linked_blocks(docs, a, b)
    blocks = pieces.where("piece = 0").select("block", "a", "b", "n")
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("place", "p")).select("block", "place", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    known = pairs.join(pair_counts(blocks, stripe, fan), ["b", "a"]).select(F.col("block").alias("of"), "place", "total", "best")
    return pieces.drop("a", "b", "n").groupBy("block").cogroup(known.groupBy("of")).applyInArrow(score_block, DOCUMENT_SQL)


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
