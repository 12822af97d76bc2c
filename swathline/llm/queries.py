"""The queries of the corpus problems over the shared tables (see TESTDATA.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.functions import nulls
from swathline.llm import dedupe, mixing, stuffing, tokens
from swathline.plans.problems import table
from swathline.session import cut, scratch_path


def p2_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every decided reading with ``accepted``; rejected and accepted alike."""
    coll = table(spark, sf_dir, "cell_collections").select(
        F.col("collection_id").alias("c"), (F.coalesce("dupe_window_s", F.lit(dedupe.DEFAULT_WINDOW_S)).cast("bigint") * 1_000_000).alias("w"))
    obs = table(spark, sf_dir, "observations").select("obs_id", "batch_id", "collection_id", "location_id", nulls.micros(nulls.instant(F.col("time"))).alias("t"))
    # cell_collections has ten rows at any scale; without the hint Spark decides by its size.
    rows = obs.join(coll, F.col("collection_id") == F.col("c"), "left").select(
        F.col("collection_id").alias("k0"), F.col("location_id").alias("k1"), "t",
        F.coalesce("w", F.lit(dedupe.DEFAULT_WINDOW_S * 1_000_000)).alias("w"), F.col("obs_id").alias("id"), "batch_id")
    return dedupe.dedupe_batches(rows, "batch_id", scratch_path(spark, "accepted"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the readings that repeat an accepted one."""
    return p2_decisions(spark, sf_dir).where(~F.col("accepted")).select(F.col("id").alias("obs_id"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document's text."""
    return tokens.encode(table(spark, sf_dir, "documents"), ["doc_id"], "text")


def _mix(spark: SparkSession, sf_dir: str):
    targets = table(spark, sf_dir, "mix_targets")
    lengths = cut(tokens.count_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text"))
    return mixing.mix(lengths, "doc_id", "source", "n_tokens", targets)[0], targets


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each used document with its length and how often it is used."""
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.report(*_mix(spark, sf_dir))


def p10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged pages with their words, stitched words, links and share."""
    return stuffing.stuffed_pages(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made of stuffed keywords, tags, links or goods."""
    return p10_pages(spark, sf_dir).select("doc_id")


QUERIES = {"p2_found": p2_found, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_pages": p10_pages}
_GREEDY = """
WITH RECURSIVE r AS (
  SELECT collection_id AS k0, location_id AS k1, epoch_us("time") AS t, coalesce(dupe_window_s, 600)::BIGINT * 1000000 AS w, obs_id AS id,
    row_number() OVER (PARTITION BY collection_id, location_id ORDER BY obs_id, "time") AS n
  FROM observations LEFT JOIN cell_collections USING (collection_id)
  WHERE collection_id IS NOT NULL AND location_id IS NOT NULL AND obs_id IS NOT NULL AND "time" IS NOT NULL AND "time" <> TIMESTAMP '1970-01-01'),
g AS (
  SELECT k0, k1, t, w, id, n, true AS accepted, [t] AS kept FROM r WHERE n = 1
  UNION ALL
  SELECT k0, k1, t, w, id, n, ok, CASE WHEN ok THEN list_append(kept, t) ELSE kept END FROM (
    SELECT r.*, g.kept, len(list_filter(g.kept, lambda x: abs(x - r.t) < r.w)) = 0 AS ok FROM g JOIN r ON r.k0 = g.k0 AND r.k1 = g.k1 AND r.n = g.n + 1))
"""
SQL: dict[str, str] = {
    "p2_found": _GREEDY + "SELECT id AS obs_id FROM g WHERE NOT accepted",
}
