"""Operator 4: embedding near-dedup with randomised-rotation binary codes.

Each vector is rotated at random and stored as the signs of its coordinates with a correction factor, its cosine with
them. The product of another vector with the signs, divided by the factor, estimates the cosine of the two without bias;
the factor also gives the bounds of that estimate. Pairs whose bounds lie under the threshold are dropped; all others are
computed exactly in doubles. At the confidence that the operator takes, 1, the bounds hold for certain, so no link is lost.
Large labels are cut into cells by their nearest pivot, and a vector visits each other cell that may hold a link of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, join_by_key, materialise, small_side, table
from .components import components
from .ngram_join import Groups

LEAST_COSINE = 0.93
SEED = 7
#: A label has a pivot, and so a cell, for about this many distinct vectors.
WHOLE = 8192
#: Allowance of the bounds for rounding.
SLACK = 1e-3
TILE = 1024
#: Standard deviations of the estimate's error that its bounds hold; None: the bounds hold for certain.
EPSILON = None


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in doubles; scaled by their largest number first, so that tiny and huge ones keep their angle."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def estimates(y: np.ndarray, signs: np.ndarray, factor: np.ndarray, epsilon: float | None = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, greatest cosine) of each rotated unit vector behind signs (+1, -1; rows) with each of y (rows): (rows of signs, rows of y).

    With x = the vector, s = its signs over the root of d, f = x.s and c = y.s: s = f x + sqrt(1 - f^2) u, u a direction at
    right angles to x that the random rotation makes even in all such directions. So c / f = x.y + sqrt(1 - f^2) / f (u.y)
    estimates x.y without bias; u.y has the deviation sqrt(1 - (x.y)^2) / sqrt(d - 1), and is never over sqrt(1 - (x.y)^2).
    The greatest cosine is that which puts c within epsilon deviations, or, for certain, the one that u along y would take.
    """
    d = y.shape[1]
    c = np.clip((signs @ y.T) / np.float32(math.sqrt(d)), -1, 1)
    f = np.minimum(factor, 1).astype(np.float32)[:, None]
    share = np.float32(1 if epsilon is None else min(1, epsilon / math.sqrt(max(d - 1, 1))))
    side = np.sqrt(1 - f**2) * share  # c = f t + side sqrt(1 - t^2) solved for the larger t
    long = np.sqrt(f**2 + side**2)
    c /= long
    np.clip(c, -1, 1, out=c)
    return c * long / np.maximum(f, np.float32(1e-6)), c * (f / long) + np.sqrt(1 - c**2) * (side / long)


def cells_of(x: np.ndarray, pivots: np.ndarray) -> list[np.ndarray]:
    """The cells of each unit vector: first its home, the nearest pivot's, then the later ones that it visits.

    If x of home p links with y of a later home q, y is no nearer to p than to q, so x's angle to q is at most that
    to p and twice the threshold's angle more. So each such pair meets in y's home, and only there.
    """
    if len(pivots) < 2:
        return list(np.zeros((len(x), 1), np.int64))
    out = []
    for k in range(0, len(x), TILE):
        angle = np.arccos(np.clip(x[k : k + TILE] @ pivots.T, -1, 1))
        home = angle.argmin(axis=1)
        near = angle <= angle.min(axis=1, keepdims=True) + 2 * math.acos(LEAST_COSINE) + SLACK
        near &= np.arange(len(pivots)) > home[:, None]
        out += [np.append(h, np.flatnonzero(v)) for h, v in zip(home, near, strict=True)]
    return out


def encoded(vectors: DataFrame, pivots: dict[tuple[str, int], np.ndarray]) -> DataFrame:
    """The index: id (the number of a row), label, d, n (copies), vector (of length 1, bytes of doubles), signs (packed), factor, cells. pivots: by label and d."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (label, d), own in frame.groupby(["label", "d"]):
                x = unit(np.array(own.embedding.tolist(), np.float64).reshape(len(own), d))
                y = x @ rotation(d).T
                out = own[["id", "label", "d", "n"]].copy()
                out["vector"] = [v.tobytes() for v in x]
                out["signs"] = [s.tobytes() for s in np.packbits(y > 0, axis=1)]
                out["factor"] = np.abs(y).sum(axis=1) / math.sqrt(d)
                out["cells"] = pd.Series(cells_of(x, pivots.get((label, int(d)), x[:0])), index=own.index, dtype=object)
                yield out

    return vectors.mapInPandas(encode, "id long, label string, d int, n long, vector binary, signs binary, factor double, cells array<long>")


def tile_links(frame: pd.DataFrame) -> pd.DataFrame:
    """Links between the two sides of one tile: a, b (joined vectors) and links: copies linked with a across the tile."""
    left, right = frame[frame.side == 0], frame[frame.side == 1]
    same = bool(frame.same.iloc[0])
    right = left if same else right
    none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
    if not len(left) or not len(right):
        return none
    d = int(frame.d.iloc[0])

    x, y = (np.frombuffer(b"".join(side.vector), np.float64).reshape(len(side), d) for side in (left, right))
    signs = np.unpackbits(np.frombuffer(b"".join(left.signs), np.uint8).reshape(len(left), -1), axis=1)[:, :d].astype(np.float32) * 2 - 1
    i, j = np.nonzero(estimates((y @ rotation(d).T).astype(np.float32), signs, left.factor.to_numpy())[1] >= LEAST_COSINE - SLACK)
    if same:
        i, j = i[i < j], j[i < j]
    if len(i) > len(x) * len(y) // 64:  # so many are computed faster by whole rows
        near = (x @ y.T)[i, j] >= LEAST_COSINE - SLACK
        i, j = i[near], j[near]
    linked = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        part = slice(k, k + (1 << 16))
        linked[part] = np.einsum("ij,ij->i", x[i[part]], y[j[part]]) >= LEAST_COSINE
    i, j = i[linked], j[linked]
    ids = left.id.to_numpy() if same else np.append(left.id.to_numpy(), right.id.to_numpy())
    copies = left.n.to_numpy() if same else np.append(left.n.to_numpy(), right.n.to_numpy())
    j = j if same else j + len(left)
    links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
    order = np.argsort(ids)
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    groups = Groups(len(ids))
    for p, q in zip(place[i].tolist(), place[j].tolist(), strict=True):
        groups.join(p, q)
    root = np.array([ids[order[groups.find(p)]] for p in place.tolist()])
    some = links > 0
    return pd.DataFrame({"a": ids[some], "b": root[some], "links": links[some].astype(np.int64)})


def near_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of embeddings.

    Only vectors of one label and one length are compared. Nulls: a null label, a null or zero vector, or one that holds
    null or non-finite numbers links with nothing. Every row is a vector of its own, whether its vec_id is null or stands
    on others too: the row's number is the node of the links, vec_id only names the component, by the smallest one of its
    rows (null last). Equal vectors of a label (repeated rows too) are combined first and link with each other; other
    columns are ignored; an empty table gives no rows. Every pair at the threshold
    is found: a label has a pivot for each WHOLE distinct vectors, and a pair of two cells meets in the later one. A cell
    of any size is cut into tiles, so none is capped. Where the pivots part nothing, all tiles meet.
    """
    good = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False)) & F.col("label").isNotNull()
    rows = embeddings.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("label").cast("string").alias("label"), "embedding").withColumn("good", good)
    rows = rows.withColumn("same", F.when(F.col("good"), F.sha2(F.concat(F.array_join(F.transform("embedding", lambda v: v.cast("string")), ","), F.lit(":"), "label"), 256)))
    named = materialise(rows.select("id", "label", "good", "same", F.when(F.col("good"), F.col("embedding")).alias("embedding"), F.monotonically_increasing_id().alias("row")))
    first = materialise(named.where("good").groupBy("same").agg(F.min("id").alias("first_id"), F.min("row").alias("first_row"), F.count("*").alias("n"), F.any_value("label").alias("label"), F.any_value(F.size("embedding")).alias("d")))
    sizes = first.groupBy("label", "d").agg(F.count("*").alias("m")).select(F.col("label").alias("_label"), F.col("d").alias("_d"), "m", F.ceil(F.col("m") / WHOLE).alias("cells"))
    owned = named.where("good").select("id", "row", "same")
    one = first.select(F.col("first_row").alias("id"), "same", "label", "d", "n")
    distinct = named.select(F.col("row").alias("id"), "embedding").join(one, "id")
    large = [(F.col("label") == F.col("_label")) & (F.col("d") == F.col("_d"))]
    chosen = distinct.join(small_side(sizes.where("cells > 1")), large).where(F.pmod(F.xxhash64("same"), "m") < F.col("cells")).select("label", "d", "same", "embedding").collect()
    pivots: dict[tuple[str, int], list] = {}  # one for WHOLE vectors
    for r in sorted(chosen, key=lambda r: r.same):
        pivots.setdefault((r.label, r.d), []).append(r.embedding)
    units = {k: unit(np.array(v, np.float64)) for k, v in pivots.items()}
    index = materialise(encoded(distinct.select("id", "label", "d", "n", "embedding"), units))
    placed = index.select("id", "label", "d", "n", "vector", "signs", "factor", F.posexplode("cells").alias("visit", "cell"))
    cell = ["label", "d", "cell"]
    own = F.ceil(F.count_if(F.col("visit") == 0) / TILE).cast("int").alias("own")
    cut = materialise(placed.groupBy(*cell).agg(own, F.ceil(F.count_if(F.col("visit") > 0) / TILE).cast("int").alias("guests"), F.count("*").alias("members")).where("members > 1 AND own > 0"))
    # a cell's own tiles come before its guests'; a vector of tile t stands on the left of tiles (t, u >= t), unless it is a guest, and on the right of own tiles (u < t, t)
    tile = F.when(F.col("visit") == 0, F.pmod(F.xxhash64("id"), "own")).otherwise(F.col("own") + F.pmod(F.xxhash64("id"), "guests")).cast("int")
    dealt = placed.join(small_side(cut), cell).withColumn("t", tile)
    row = [*cell, "id", "n", "vector", "signs", "factor"]
    with_left = dealt.where("visit = 0").select("*", F.explode(F.sequence(F.col("t"), F.col("own") + F.col("guests") - 1)).alias("u")).select(*row, F.col("t").alias("p"), F.col("u").alias("q"), F.lit(0).alias("side"))
    with_right = dealt.where("t > 0").select("*", F.explode(F.sequence(F.lit(0), F.least("t", "own") - 1)).alias("u")).select(*row, F.col("u").alias("p"), F.col("t").alias("q"), F.lit(1).alias("side"))
    tiles = with_left.unionByName(with_right).withColumn("same", F.col("p") == F.col("q"))
    found = materialise(tiles.groupBy(*cell, "p", "q").applyInPandas(tile_links, "a long, b long, links long"))
    counts = found.groupBy(F.col("a").alias("_a")).agg(F.sum("links").alias("links"))
    roots = components(found.select("a", "b"))
    joined = first.select("same", "first_id", "first_row", "n").join(counts, F.col("first_row") == F.col("_a"), "left").join(roots, F.col("first_row") == F.col("node"), "left")
    known = materialise(joined.select("same", "first_id", F.col("n").alias("copies"), "links", F.coalesce("root", "first_row").alias("root")))
    lowest = materialise(known.groupBy("root").agg(F.min("first_id").alias("lowest"), F.count("*").alias("n")))
    sets = materialise(join_by_key(known, lowest, ["root"]).select("same", F.col("copies").alias("n"), "links", "lowest"))
    linked = join_by_key(owned, sets, ["same"])
    out = linked.select("id", "n", "links", "lowest").unionByName(named.where("NOT good").select("id"), allowMissingColumns=True)
    component = F.coalesce("lowest", "id")
    links = F.coalesce(F.col("n") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    return out.select(F.nullif("id", F.lit(NO_ID)).alias("vec_id"), links.cast("long").alias("n_links"), F.nullif(component, F.lit(NO_ID)).alias("component_id"), (F.col("id") == component).alias("kept"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE base AS MATERIALIZED (SELECT vec_id AS real_id, row_number() OVER () AS vec_id, label, embedding FROM embeddings),
good AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM base
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM base UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
roots AS (SELECT a, min(q.real_id) AS component_id FROM reach JOIN base q ON q.vec_id = b GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT real_id AS vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(real_id = component_id, component_id IS NULL) AS kept
FROM base JOIN roots ON roots.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""
