"""Threat lookups with an expiring cache, and evaluation datasets and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATASET = "queries array<struct<id string, query string, expected_sources array<string>, negative_sources array<string>, expected_keywords array<string>, category string>>"


def check_urls(urls: DataFrame, threats: DataFrame, cache: DataFrame, now: float) -> DataFrame:
    """(url, safe, threats, cached): each distinct URL by its unexpired cache entry, else by the threat table; unknown URLs are safe.

    threats: (url, threat). cache: (url, safe, threats array, expires_at seconds); of several entries the last to expire counts.
    """
    fresh = cache.filter(F.col("expires_at") > now).groupBy("url").agg(F.max_by(F.struct("safe", "threats"), "expires_at").alias("c"))
    known = threats.groupBy("url").agg(F.array_sort(F.collect_set("threat")).alias("t"))
    joined = urls.select("url").filter(F.col("url").isNotNull()).distinct().join(fresh, "url", "left").join(known, "url", "left")
    cached = F.col("c").isNotNull()
    found = F.coalesce("t", F.array().cast("array<string>"))
    return joined.select("url", F.when(cached, F.col("c.safe")).otherwise(F.size(found) == 0).alias("safe"), F.when(cached, F.col("c.threats")).otherwise(found).alias("threats"), cached.alias("cached"))


def updated_cache(cache: DataFrame, results: DataFrame, now: float, ttl: float = 300.0) -> DataFrame:
    """The unexpired entries and those of ``results`` that did not come from the cache, good for ``ttl`` seconds."""
    new = results.filter(~F.col("cached")).select("url", "safe", "threats", F.lit(now + ttl).alias("expires_at"))
    return cache.filter(F.col("expires_at") > now).select("url", "safe", "threats", "expires_at").unionByName(new)


def evaluation_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(id, query, expected_sources, negative_sources, expected_keywords, category) of a JSON dataset; missing lists are empty."""
    rows = spark.read.schema(DATASET).option("multiLine", True).json(path).select(F.explode("queries").alias("q")).select("q.*")
    empty = F.array().cast("array<string>")
    return rows.withColumns({c: F.coalesce(c, empty) for c in ("expected_sources", "negative_sources", "expected_keywords")})


def report(summary: dict[str, float], baseline: dict[str, float] | None = None, allowed: float = 0.1) -> tuple[str, str, bool]:
    """(JSON, Markdown, regressed) of an evaluation's averages; a fall of F1 by more than ``allowed`` below the baseline is a regression."""
    delta = summary["f1"] - baseline["f1"] if baseline else None
    regressed = delta is not None and delta < -allowed
    rows = "\n".join(f"| {k} | {v:.4f} |" for k, v in summary.items())
    text = f"# Retrieval quality\n\n| Metric | Mean |\n|---|---|\n{rows}\n" + (f"\nF1 against the baseline: {delta:+.4f}{' (regression)' if regressed else ''}\n" if delta is not None else "")
    return json.dumps({"summary": summary, "delta_f1": delta, "regressed": regressed}, ensure_ascii=False), text, regressed
