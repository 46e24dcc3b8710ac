"""Operator 6: n-gram Jaccard join with prefix trees.

A document's set of word shingles (triples in op6_ngram_join) is ordered globally (very frequent ones last, else by hash). Of its head, the first few
members, those that no other head has show that it can link with none, or are skipped; of the others the rarest are
named, so that two sets that reach the threshold name one in common. Every named member leads to the smallest document
that names it, its hub; documents of one hub meet in a group, so every possible pair does. In a group the sets are stored in a trie; one walk
carries the partial overlaps of all sets down the shared branches and drops those whose remaining length cannot reach
the threshold. Large groups are walked in chunks that hold the hub too, and what a chunk does not join to the hub is
then walked against all chunks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, arrow_rows, join_by_key, materialise, mix, small_side, table, text_blocks
from .components import components
from .repeats import buckets_for, keyed, real_id

#: A member that over 1 in RARE documents has is ordered last; the list of those is bounded by RARE * the mean set size.
RARE, LEAST_FREQUENT = 1000, 32
COUNT_OVER = 16 << 20
#: Heads of this much text are sent together.
SEND = 8 << 20
#: Members looked at beyond twice what a linked set may lack.
HEAD_SLACK = 8
#: Sets and members of a chunk of a group.
CHUNK_SETS, CHUNK_MEMBERS = 256, 300_000


@dataclass(frozen=True)
class Link:
    """Two sets of shingles of size words link when units * shared >= least * united."""

    size: int = 3
    least: int = 90
    units: int = 100

    def holds(self, shared, together):
        """Whether sets with so many shared members and members together (both sizes added) link."""
        return (self.units + self.least) * shared >= self.least * together

    def missing(self, n):
        """How many members of a set of n a linked set may lack (numbers or arrays)."""
        return n - (self.least * n + self.units - 1) // self.units

    def head(self, n):
        """How many first members of a set of n are looked at: about twice what a linked set may lack."""
        return np.minimum(n, 2 * self.missing(n) + HEAD_SLACK)

    def named(self, n):
        """How many of the head's members, rarest first, must be named so that two linked sets name one in common.

        The set whose head ends first shares all but missing() of its head with the other's head. So of the other's head at
        most head(n) less that many stand before the first shared one; the smallest partner gives the bound.
        """
        least = -(-self.least * n // self.units)
        return np.minimum(self.head(n), self.head(n) - np.maximum(self.head(least) - self.missing(least), 1) + 1)


#: op6_ngram_join's contract.
TRIPLES = Link()


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of the distinct shingles of a block's texts, sorted; a text of fewer words has one, of no words none."""
    words = Words(raw, offsets, lower=True)
    grams, inside = words.grams(size)
    doc, h = words.doc[: len(grams)][inside], grams[inside]
    n = np.diff(words.first)
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            doc, h = np.append(doc, short), np.append(h, words.grams(k)[0][words.first[short]])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[fresh], h[fresh]


def set_digests(rows: DataFrame, size: int) -> DataFrame:
    """id, key, size, s1, s2, n_bytes: the size and two sums that name each row's set."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("size", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("n_bytes", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in text_blocks(batches):
            doc, h = shingle_sets(raw, offsets, size)
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            sums = []
            for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)):
                total = np.append(np.zeros(1, np.uint64), np.cumsum(mix(h ^ salt), dtype=np.uint64))
                sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            yield arrow_rows(schema, batch.column(0), batch.column(1), np.diff(first), *sums, np.diff(offsets))

    return rows.select("id", "key", "text").mapInArrow(digest, "id long, key long, size long, s1 long, s2 long, n_bytes long")


def digests_by_key(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(keyed rows, their saved digests) under the first seed that gives no two different (id, set) one key of 64 bits."""
    for seed in itertools.count():
        rows = keyed(docs, seed)
        meta = materialise(set_digests(rows, size))
        what = F.struct("id", "size", "s1", "s2")
        if meta.groupBy("key").agg(F.min(what).alias("a"), F.max(what).alias("b")).where("a <> b").isEmpty():
            return rows, meta


def frequent_members(texts: DataFrame, n_docs: int, words: int) -> np.ndarray:
    """Hashes of the members of over 1 in RARE sets, rarest first. Counts of a stretch of COUNT_OVER bytes start at 4."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value[n >= 4].view(np.int64)), pa.array(n[n >= 4])], ["h", "n"])

        for _, raw, offsets in text_blocks(batches):
            held.append(shingle_sets(raw, offsets, words)[1])
            size += len(raw)
            if size >= COUNT_OVER:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    counts = texts.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= max(LEAST_FREQUENT, n_docs // RARE)).collect()
    return np.array([r.h for r in sorted(found, key=lambda r: (r.n, r.h))], np.int64).view(np.uint64)


class Order:
    """The global order as a rank of 64 bits: the top bit and a number for frequent members, else the hash without its last bit."""

    def __init__(self, frequent: np.ndarray):
        self.by = np.argsort(frequent)
        self.sorted = frequent[self.by]

    def rank(self, h: np.ndarray) -> np.ndarray:
        out = h >> np.uint64(1)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            out = np.where(self.sorted[at] == h, np.uint64(1 << 63) + self.by[at].astype(np.uint64), out)
        return out


ROWS = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])


def shared_heads(texts: DataFrame, order: Order, n_buckets: int, link: Link) -> DataFrame:
    """id, n, and of the head's members that other sets' heads have too: members (hashes) and counts (frequent ones above all).

    Members of the list of frequent ones are known to be shared where they stand. All others, which few documents have,
    are sent in one binary row per bucket of hashes and block of text, and counted there.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, ids, n, count = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (np.where(count > 0, mix(ids.view(np.uint64)), h) % np.uint64(n_buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
            some = np.flatnonzero(np.diff(cut))
            columns = [x[by] for x in (h, ids, n, count)]
            return arrow_rows(ROWS, some, np.diff(cut)[some], [b"".join(c[cut[b] : cut[b + 1]].tobytes() for c in columns) for b in some])

        for batch, raw, offsets in text_blocks(batches):
            doc, h = shingle_sets(raw, offsets, link.size)
            rank = order.rank(h)
            by = np.lexsort((rank, doc))
            doc, h, rank = doc[by], h[by], rank[by]
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            n = np.diff(first)
            keep = np.arange(len(doc)) - first[doc] < link.head(n)[doc]
            doc, h, rank = doc[keep], h[keep], rank[keep]
            often = (rank >> np.uint64(63)) == 1
            count = np.where(often, (1 << 30) + (rank & np.uint64((1 << 30) - 1)).astype(np.int64), 0).astype(np.int32)
            held.append((h, batch.column(0).to_numpy(zero_copy_only=False)[doc], n[doc].astype(np.int32), count))
            size += len(raw)
            if size >= SEND:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [[np.frombuffer(d, t, n, at * n) for n, d in zip(frame.n, frame.data, strict=True)] for t, at in ((np.uint64, 0), (np.int64, 8), (np.int32, 16), (np.int32, 20))]
        h, ids, size, count = (np.concatenate(x) for x in parts)
        by = np.lexsort((ids, h))
        h, ids, size, count = h[by], ids[by], size[by], count[by]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        seen = np.diff(np.append(start, len(h)))
        count = np.where(count > 0, count, np.repeat(seen, seen))
        keep = count > 1
        h, ids, size, count = h[keep], ids[keep], size[keep], count[keep]
        by = np.argsort(ids, kind="stable")
        h, ids, size, count = h[by].view(np.int64), ids[by], size[by], count[by]
        start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)

        def lists(x: np.ndarray) -> pd.Series:
            return pd.Series(np.split(x, start[1:]) if len(start) else [], dtype=object)

        return pd.DataFrame({"id": ids[start], "n": size[start], "members": lists(h), "counts": lists(count.astype(np.int32))})

    sent = texts.select("id", "text").mapInArrow(send, "bucket int, n int, data binary")
    return sent.groupBy("bucket").applyInPandas(gather, "id long, n int, members array<long>, counts array<int>")


def naming_members(heads: DataFrame, link: Link) -> DataFrame:
    """member, id: the members each set names. Members of its own count as named, so a set with named() of them or more names none.

    More than missing() of them don't rule a link out: the partner may hold them beyond its own head.
    """

    def names(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n = frame.n.to_numpy(np.int64)
            own = link.head(n) - frame.members.str.len().to_numpy()  # no other head has them: they come first in the order
            take = link.named(n) - own
            ids, members = [], []
            for i in np.flatnonzero(take > 0):
                m, c = np.asarray(frame.members.iloc[i]), np.asarray(frame.counts.iloc[i])
                members.append(m[np.lexsort((m, c))][: take[i]])
                ids.append(np.full(len(members[-1]), frame.id.iloc[i]))
            if ids:
                yield pd.DataFrame({"member": np.concatenate(members), "id": np.concatenate(ids)})

    whole = heads.groupBy("id").agg(F.max("n").alias("n"), F.flatten(F.collect_list("members")).alias("members"), F.flatten(F.collect_list("counts")).alias("counts"))
    return whole.mapInPandas(names, "member long, id long")


def member_lists(texts: DataFrame, size: int) -> DataFrame:
    """id, n, members (hashes as bytes) of each text's set."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("members", pa.binary())])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in text_blocks(batches):
            doc, h = shingle_sets(raw, offsets, size)
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield arrow_rows(schema, batch.column(0), np.diff(first), [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)])

    return texts.select("id", "text").mapInArrow(lists, "id long, n long, members binary")


class Groups:
    """Union of row numbers."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.parent[max(a, b)] = min(a, b)


def trie_join(sets: list[np.ndarray], asked: np.ndarray, link: Link) -> Groups:
    """Join the sets that link; pairs have one of asked (row numbers) at least.

    The trie's paths are the sets without members of one set only, the group's most frequent members first. One walk
    over its branches: asked sets still in play carry their overlap with the branch, and stay while the branch's
    longest rest, or their own, can bring it to the threshold.
    """
    n = np.array([len(s) for s in sets])
    groups = Groups(len(sets))
    owner = np.repeat(np.arange(len(sets)), n)
    value, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.full(len(value), -1)
    shared = np.flatnonzero(count > 1)
    rank[shared[np.lexsort((value[shared], -count[shared]))]] = np.arange(len(shared))
    r = rank[inverse]
    owner, r = owner[r >= 0], r[r >= 0]
    by = np.lexsort((r, owner))
    owner, r = owner[by], r[by]
    first = np.searchsorted(owner, np.arange(len(sets) + 1))
    has = np.zeros((len(sets), len(shared)), np.uint8)
    has[owner, r] = 1
    paths = [r[first[i] : first[i + 1]] for i in range(len(sets))]
    size = np.diff(first)
    leaves = sorted(range(len(sets)), key=lambda i: paths[i].tolist())
    stack = [(0, len(leaves), 0, asked, np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64))]
    while stack:
        low, high, depth, active, overlap, passed = stack.pop()
        below = leaves[low:high]
        a, b = paths[below[0]], paths[below[-1]]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:m] != b[depth:m])
        end = depth + int(differ[0]) if len(differ) else m  # the branch: all below share a[depth:end]
        if end > depth:
            overlap = overlap + has[active][:, a[depth:end]].sum(axis=1, dtype=np.int64)
            passed = np.array([np.searchsorted(paths[x], a[end - 1], "right") for x in active], np.int64)
        rest = np.minimum(max(size[i] for i in below) - end, size[active] - passed)
        keep = link.holds(overlap + rest, n[active] + min(n[i] for i in below))
        active, overlap, passed = active[keep], overlap[keep], passed[keep]
        if not len(active):
            continue
        here = low
        while here < high and len(paths[leaves[here]]) == end:  # sets that end on this branch
            y = leaves[here]
            for x in active[link.holds(overlap, n[active] + n[y])]:
                if x != y:
                    groups.join(int(x), y)
            here += 1
        while here < high:  # the branches that part here
            token, to = paths[leaves[here]][end], here + 1
            while to < high and paths[leaves[to]][end] == token:
                to += 1
            stack.append((here, to, end, active, overlap, passed))
            here = to
    return groups


def group_links(rows: DataFrame, link: Link) -> DataFrame:
    """a, b of the joined sets of each (hub, part, turn) group; left: a set that its chunk does not join to the hub.

    rows: hub, part, turn (-1: all pairs; else pairs with an asked one), id, members, asked.
    """

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "asked"], ascending=[True, False]).drop_duplicates("id")
        ids = frame.id.to_numpy()
        groups = trie_join([np.frombuffer(x, np.uint64) for x in frame.members], np.flatnonzero(frame.asked.to_numpy()), link)
        root = np.array([groups.find(i) for i in range(len(ids))])
        hub = int(np.searchsorted(ids, frame.hub.iloc[0]))  # the smallest id of its group
        left = root != root[hub] if hub < len(ids) and ids[hub] == frame.hub.iloc[0] else np.ones(len(ids), bool)
        return pd.DataFrame({"hub": frame.hub.to_numpy(), "a": ids, "b": ids[root], "left": left})

    return rows.groupBy("hub", "part", "turn").applyInPandas(walk, "hub long, a long, b long, left boolean")


def linked_components(docs: DataFrame, link: Link = TRIPLES) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    Every row is a document of its own: rows of one doc_id, or of none, link only by what they hold. Nulls and empties: a
    null or empty text, or one of white space, has no set and is linked with nothing; a null doc_id orders after every
    other and is returned as null. Equal sets are combined first, so copies and repeated rows cost one set; component_id
    is the smallest doc_id among the rows reachable. The sets are the nodes of the links, each named by the key of one
    of its rows.
    """
    rows, meta = digests_by_key(docs, link.size)
    name = ["size", "s1", "s2"]
    first = materialise(meta.where("size > 0").groupBy(*name).agg(F.min("id").alias("first_id"), F.min("key").alias("node"), F.count("*").alias("n")))
    whole = join_by_key(meta.where("size > 0"), first, name).drop("n").unionByName(meta.where("size = 0"), allowMissingColumns=True)
    meta = materialise(whole.withColumnRenamed("size", "n"))
    copies = meta.where("n = 0 OR key <> node").select(F.col("key").alias("copy")).distinct()
    texts = rows.join(small_side(copies), F.col("key") == F.col("copy"), "left_anti").select(F.col("key").alias("id"), "text")
    order = Order(frequent_members(texts, meta.count(), link.size))
    members = materialise(naming_members(shared_heads(texts, order, buckets_for(meta), link), link))
    hubs = members.groupBy("member").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub < top").select("member", "hub")
    pairs = materialise(members.join(hubs, "member").select("hub", "id").distinct())
    wanted = small_side(pairs.select(F.col("id").alias("_id")).distinct(), 1_000_000)
    lists = materialise(member_lists(texts.join(wanted, F.col("id") == F.col("_id"), "left_semi"), link.size))
    sizes = pairs.join(lists.select("id", "n"), "id").groupBy("hub").agg(F.count("*").alias("sets"), F.sum("n").alias("total"))
    parts = materialise(sizes.where("sets > 1").select("hub", F.ceil(F.greatest(F.col("sets") / CHUNK_SETS, F.col("total") / CHUNK_MEMBERS)).cast("int").alias("parts")))
    grouped = pairs.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    every = F.when(F.col("id") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
    one = grouped.select("hub", "id", F.explode(every).alias("part"), F.lit(-1).alias("turn"), F.lit(True).alias("asked"))
    found = materialise(group_links(one.join(lists.select("id", "members"), "id"), link))
    large = small_side(parts.where("parts > 1"))
    left = materialise(found.where("left").join(large, "hub").select("hub", F.col("a").alias("id"), "parts").distinct())
    turns = left.groupBy("hub").agg(F.ceil(F.count("*") / CHUNK_SETS).cast("int").alias("turns"))
    asking = left.join(turns, "hub").select("hub", "id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("id", F.lit(1)), "turns").cast("int").alias("turn"), F.lit(True).alias("asked"))
    against = grouped.join(turns, "hub").select("hub", "id", "part", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(False).alias("asked"))
    more = group_links(asking.unionByName(against).join(lists.select("id", "members"), "id"), link)
    roots = components(found.select("a", "b").unionByName(more.select("a", "b")))
    known = materialise(first.select("node", "first_id", F.col("n").alias("rows")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    lowest = materialise(known.groupBy("root").agg(F.min("first_id").alias("component"), F.count("*").alias("n")))
    sets = materialise(join_by_key(known, lowest, ["root"]).select("node", F.col("rows").alias("n"), "component"))
    joined = join_by_key(meta.where("n > 0").withColumnRenamed("n", "size"), sets, ["node"]).select("id", "size", "component")
    alone = meta.where("n = 0").select("id", F.col("n").alias("size"), F.col("id").alias("component"))
    return joined.unionByName(alone).select(real_id(F.col("id")).alias("doc_id"), F.col("size").alias("n_shingles"), real_id(F.col("component")).alias("component_id"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"), TRIPLES)


OP6_SQL = r"""
WITH RECURSIVE base AS MATERIALIZED (SELECT doc_id AS real_id, row_number() OVER () AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM base WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 190 * k >= 90 * (p.n + q.n)),
reach(a, b) AS (SELECT doc_id, doc_id FROM base UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT real_id AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM base LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(q.real_id) AS component_id FROM reach JOIN base q ON q.doc_id = b GROUP BY a) USING (doc_id)
"""
