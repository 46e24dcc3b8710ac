"""Repeated rows, null ids and one id on several contents: every row is judged on its own, by brute force and by SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrablock.llm import embeddings, ngram_join, queries, repeats
from terrablock.llm.embeddings import near_vectors
from terrablock.llm.ngram_join import linked_components
from terrablock.llm.secrets import scan_secrets
from terrablock.llm.suffix_array import dedup_bytes
from terrablock.llm.suffix_tree import dedup_words

from .test_operators import BYTE_COLUMNS, WORD_COLUMNS, got, removed_bytes, removed_words, rows_of

PASSAGE = " ".join(f"passage{i}" for i in range(40))
PARTLY = [(1, PASSAGE + " tail of one"), (2, "start two " + PASSAGE), (2, "start two " + PASSAGE), (2, "other start " + PASSAGE + " end"), (None, "x " + PASSAGE), (None, "x " + PASSAGE), (None, "y " + PASSAGE), (3, PASSAGE)]
PARTLY += [(2, "start two " + PASSAGE)] * 5


def test_repeated_rows_with_partial_removal(spark):
    docs = rows_of(spark, PARTLY)
    assert got(dedup_words(docs), *WORD_COLUMNS) == removed_words(PARTLY)
    assert got(dedup_bytes(docs), *BYTE_COLUMNS) == removed_bytes(PARTLY)


def by_rows(rows, link):
    """(id, number of links, smallest id reachable) of each row; link(a, b) of two contents. A null id comes last."""
    n = len(rows)
    near = np.array([[i != j and link(rows[i][1], rows[j][1]) for j in range(n)] for i in range(n)])
    reach = near | np.eye(n, dtype=bool)
    for k in range(n):
        reach |= reach[:, k : k + 1] & reach[k]
    return [(rows[i][0], int(near[i].sum()), min((rows[j][0] for j in np.flatnonzero(reach[i]) if rows[j][0] is not None), default=None)) for i in range(n)]


def cosine(a, b):
    x, y = np.array(a), np.array(b)
    return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93


VECTORS = [(None, [1.0, 0.01]), (None, [0.0, 1.0]), (1, [1.0, 0.0]), (6, [1.0, 1.0]), (6, [-1.0, 0.2]), (9, [-1.0, 0.2]), (9, [1.0, 1.1]), (None, [0.0, 1.0]), (None, [0.3, -1.0]), (7, [1.0, 1.0])]


def test_links_of_null_and_repeated_vec_ids(spark):
    frame = spark.createDataFrame([(i, 1 << 40, v, "s", 0, 0) for i, v in VECTORS], "vec_id long, label long, embedding array<double>, same string, row int, node int")
    out = near_vectors(frame).collect()
    want = by_rows(VECTORS, cosine)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=repr) == sorted(want, key=repr)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


SETS = [(1, "a b c d e f g h i j k l m n o p q r s t u v w"), (2, "A B C X Y Z one two three four five six seven"), (None, "a b c d e f g h i j k l m n o p q r s t u v w x"), (None, "a b c x y z one two three four five six seven x"), (7, "one"), (7, "two"), (9, "two"), (None, "three"), (None, "three"), (None, "four")]


def jaccard(a, b):
    x, y = ({tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))} for w in (a.lower().split(), b.lower().split()))
    return 100 * len(x & y) >= 90 * len(x | y)


@pytest.mark.parametrize("swap", [False, True])
def test_links_of_null_and_repeated_doc_ids(spark, swap):
    """swap: the null ids are an id that other texts have too."""
    texts = [(7 if swap and i is None else i, t) for i, t in SETS]
    out = linked_components(rows_of(spark, texts)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in out), key=repr) == sorted(((i, c) for i, _, c in by_rows(texts, jaccard)), key=repr)


def test_keys_that_clash_are_taken_anew(spark, monkeypatch):
    """Keys of the first seed all agree: the join must notice and take another."""
    plain_keys = repeats.keyed
    monkeypatch.setattr(ngram_join, "keyed", lambda docs, seed=0: plain_keys(docs, seed).withColumn("key", F.col("key") if seed else F.lit(5).cast("long")))
    out = linked_components(rows_of(spark, SETS)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in out), key=repr) == sorted(((i, c) for i, _, c in by_rows(SETS, jaccard)), key=repr)


def test_sql_sees_repeated_and_null_ids(spark, tmp_path):
    con = duckdb.connect()
    texts = PARTLY + SETS
    docs = rows_of(spark, texts)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, v) for i, v in VECTORS], "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("op4_near_vectors", "op6_ngram_join", "op7_substrings", "op9_bytes"):
        found = con.execute(queries.SQL[name])
        columns = sorted(c[0] for c in found.description)
        want = sorted((tuple(dict(zip([c[0] for c in found.description], r, strict=True))[c] for c in columns) for r in found.fetchall()), key=repr)
        assert got(queries.QUERIES[name](spark, str(tmp_path)), *columns) == want, name


def test_a_null_owner_is_none_of_the_named(spark):
    docs = spark.createDataFrame([(1, "token=copiedvalue9", None), (2, "token=copiedvalue9", ""), (3, "token=copiedvalue9", "x"), (4, "token=otherval99", None), (5, "token=otherval99", None)], "doc_id long, text string, source string")
    out = {r.doc_id: r for r in scan_secrets(docs).collect()}
    assert [(out[i].most_owners, out[i].n_copied) for i in (1, 2, 3)] == [(3, 1)] * 3 and (out[4].most_owners, out[4].n_copied) == (1, 0)


def test_estimates_have_no_bias_and_bounds_hold():
    """Over many random rotations the mean estimate is the cosine; no cosine is over the certain bound; few over the one of two deviations."""
    rng = np.random.default_rng(1)
    x = embeddings.unit(rng.normal(size=(40, 32)))
    y = embeddings.unit(x[:40] * 0.9 + rng.normal(size=(40, 32)) * 0.08)
    exact, sums, over = (x @ y.T), np.zeros((40, 40)), 0
    for _ in range(300):
        q, r = np.linalg.qr(rng.standard_normal((32, 32)))
        turn = q * np.sign(np.diag(r))
        a, b = x @ turn.T, y @ turn.T
        signs = np.where(a > 0, 1, -1).astype(np.float32)
        factor = np.abs(a).sum(axis=1) / np.sqrt(32)
        estimate, most = embeddings.estimates(b.astype(np.float32), signs, factor)
        assert (most >= exact - 1e-4).all()
        sums += estimate
        over += (embeddings.estimates(b.astype(np.float32), signs, factor, 2.0)[1] < exact - 1e-4).mean()
    assert np.abs(sums / 300 - exact).max() < 0.06 and over / 300 < 0.05
