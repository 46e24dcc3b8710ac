"""Operator 2: secret scan with corpus-wide ownership frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_by_key, materialise, table

# The contract's patterns, with letters in either case spelt out (engines differ in case folding).
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the same as runs of AKIA[A-Z0-9]+ of 16 or more: both take maximal runs
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8
#: Bare tokens that may repeat a candidate value: whole runs of its letters that hold a digit. (Looking back keeps Java linear.)
TOKEN = r"[A-Za-z+/_.=-]*[0-9][A-Za-z0-9+/_.=-]*"
TOKEN_ONCE = r"(?<![A-Za-z0-9+/_.=-])" + TOKEN
KINDS = ["assign", "access", "hex", "reuse"]
REUSE = 3
#: A value that so many owners, or so many repositories, have is a copied example, not one owner's live credential.
COPIED_OWNERS, COPIED_REPOS = 3, 10
BARE = "array<struct<rank:int,gap:bigint,size:bigint,value:string>>"


def pieces(text: Column, rank: int, pattern: str, group: int, least: int = 0) -> Column:
    """Array of (rank, gap, size, value) of the leftmost non-overlapping matches: code points before the match since the
    one before, code points of the match, and the SHA-256 of the value, null if it has fewer than least characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    both = F.zip_with(found, values, lambda m, v: F.struct(m.alias("m"), v.alias("v")))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    row = lambda x, g: F.struct(F.lit(rank).alias("rank"), F.length(g).cast("bigint").alias("gap"), F.length(x["m"]).cast("bigint").alias("size"), F.when(F.length(x["v"]) >= least, F.sha2(x["v"], 256)).alias("value"))
    return F.when(text.rlike(pattern), F.zip_with(both, gaps, row)).otherwise(F.array().cast(BARE))


def found_spans(docs: DataFrame, repo: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """(rows, spans), both saved. rows: row, doc_id; spans: row, repo, owner, rank, start, end, value of every match with
    a value, bare tokens (rank REUSE) too. Running sums of gaps and sizes give the places, one row for each match."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.concat(pieces(text, 0, ASSIGN, 1, LEAST_VALUE), pieces(text, 1, ACCESS, 0), pieces(text, 2, HEX, 0), pieces(text, REUSE, TOKEN_ONCE, 0, LEAST_VALUE))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731  (a null is no empty name)
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", name(repo).alias("repo"), name(owner).alias("owner"), every.alias("pieces")))
    each = rows.where(F.size("pieces") > 0).select("row", "repo", "owner", F.posexplode("pieces").alias("at", "p"))
    upto = Window.partitionBy("row", "p.rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("p.gap") + F.col("p.size")).over(upto)
    spans = each.select("row", "repo", "owner", F.col("p.rank").alias("rank"), (end - F.col("p.size")).alias("start"), end.alias("end"), F.col("p.value").alias("value")).where("value IS NOT NULL")
    return rows.select("row", "doc_id"), materialise(spans)


def value_owners(spans: DataFrame) -> DataFrame:
    """A saved table of value (hash), n (rows of spans), n_repos, n_owners, copied of each candidate value of the corpus.

    Distinct names are grouped before they are counted, each time combined before the shuffle, so that a value which a
    third of all rows hold stays small.
    """
    uses = spans.groupBy("value", "repo", "owner").agg(F.count("*").alias("n"), F.min("rank").alias("rank"))
    known = F.min("rank") < REUSE
    repos = uses.groupBy("value", "repo").agg(F.sum("n").alias("n"), F.min("rank").alias("rank"))
    repos = repos.groupBy("value").agg(F.sum("n").alias("n"), F.count_if(F.col("rank") < REUSE).alias("n_repos"), known.alias("known")).where("known").drop("known")
    owners = uses.where(F.col("rank") < REUSE).groupBy("value", "owner").agg(F.lit(1).alias("x")).groupBy("value").agg(F.count("*").alias("n_owners"))
    return materialise(repos.join(owners, "value").withColumn("copied", (F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repos") >= COPIED_REPOS)))


def scan_secrets(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, counts by kind, base_sha256, spans, and n_reuse, n_live, n_copied, most_repos, most_owners.

    Candidate values (those of base spans) are hashed and counted by distinct repositories and owners over the whole
    corpus. Spans of kind reuse are added: bare tokens that equal a candidate value and overlap no base span. n_copied
    counts the row's distinct values that many owners or repositories have, n_live the others; most_repos and
    most_owners are the largest counts among its values. Nulls: a null text is empty (no spans; base_sha256 of the empty
    text); a null owner or repository is one of its own; ties don't arise, as spans of one kind never overlap; repeated
    rows each get their row and count as one repository; an empty table gives none; other columns are ignored.
    """
    rows, spans = found_spans(docs, repo, owner)
    values = value_owners(spans)
    judged = join_by_key(spans.select("row", "rank", "start", "end", "value"), values, ["value"])
    order = Window.partitionBy("row").orderBy("start", "rank")
    before = F.max(F.when(F.col("rank") < REUSE, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("rank") < REUSE, F.col("start"))).over(Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.col("rank") < REUSE) | ((F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end")))
    kept = judged.withColumn("apart", apart).where("apart")
    label = F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1), F.col("start"), F.col("end"))
    kind = lambda k: F.count_if(F.col("rank") == k)
    listed = F.collect_list(F.struct("start", "rank", label.alias("s")))
    per = kept.groupBy("row").agg(
        *(kind(k).alias(n) for k, n in enumerate(("n_assign", "n_access", "n_hex", "n_reuse"))), F.array_sort(listed).alias("listed"),
        F.size(F.collect_set(F.when(~F.col("copied"), F.col("value")))).cast("long").alias("n_live"), F.size(F.collect_set(F.when(F.col("copied"), F.col("value")))).cast("long").alias("n_copied"),
        F.max("n_repos").alias("most_repos"), F.max("n_owners").alias("most_owners"),
    )
    joined = lambda spans: F.coalesce(F.array_join(F.transform(spans, lambda x: x["s"]), ","), F.lit(""))
    base = F.sha2(joined(F.filter("listed", lambda x: x["rank"] < REUSE)), 256)
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(per, "row", "left").select("doc_id", *map(count, ("n_assign", "n_access", "n_hex")), base.alias("base_sha256"), joined("listed").alias("spans"), *map(count, ("n_reuse", "n_live", "n_copied", "most_repos", "most_owners")))


def ownership(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """value_hash, n_repos, n_owners, verdict ('example' or 'live') of each candidate value of the corpus."""
    values = value_owners(found_spans(docs, repo, owner)[1])
    return values.select(F.col("value").alias("value_hash"), "n_repos", "n_owners", F.when(F.col("copied"), "example").otherwise("live").alias("verdict"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def _sql_spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    at = "CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT)"
    return f"""
  SELECT rn, '{kind}' AS kind, {rank} AS rank, s, s + length(m[i]) AS e, v[i] AS value FROM (
    SELECT rn, m, v, unnest(range(1, len(m) + 1)) AS i, g, {at} AS s FROM (
      SELECT rn, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS g FROM base)) WHERE length(v[i]) >= {least}"""


OP2_SQL = f"""
WITH base AS (SELECT row_number() OVER () AS rn, doc_id, source, coalesce(text, '') AS t FROM documents),
found AS MATERIALIZED ({" UNION ALL ".join(_sql_spans(*x) for x in (("assign", 0, ASSIGN, 1, LEAST_VALUE), ("access", 1, ACCESS, 0, 16), ("hex", 2, HEX, 0, 32), ("reuse", 3, TOKEN, 0, LEAST_VALUE)))}),
owners AS MATERIALIZED (SELECT value, count(DISTINCT coalesce('=' || CAST(doc_id AS VARCHAR), '')) AS n_repos, count(DISTINCT coalesce('=' || source, '')) AS n_owners FROM found JOIN base USING (rn) WHERE rank < 3 GROUP BY value),
spans AS MATERIALIZED (SELECT f.*, n_repos, n_owners, n_owners >= {COPIED_OWNERS} OR n_repos >= {COPIED_REPOS} AS copied FROM found f JOIN owners USING (value)
  WHERE rank < 3 OR NOT EXISTS (SELECT 1 FROM found g WHERE g.rn = f.rn AND g.rank < 3 AND g.s < f.e AND g.e > f.s)),
lists AS (SELECT rn, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex, count(*) FILTER (WHERE rank = 3) AS n_reuse,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base_spans,
  count(DISTINCT value) FILTER (WHERE NOT copied) AS n_live, count(DISTINCT value) FILTER (WHERE copied) AS n_copied, max(n_repos) AS most_repos, max(n_owners) AS most_owners FROM spans GROUP BY rn)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_reuse, 0) AS n_reuse, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(most_repos, 0) AS most_repos, coalesce(most_owners, 0) AS most_owners
FROM base LEFT JOIN lists USING (rn)
"""
