"""Readers of fetched API records: pages of feeds, blog articles and scraps, and the choice of a transcript. Fetching itself is not done here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TOPIC = "array<struct<display_name string, name string>>"
ARTICLE = f"struct<slug string, title string, path string, article_type string, published_at string, liked_count bigint, topics {_TOPIC}, body_html string, user struct<username string>>"
SCRAP = f"struct<slug string, title string, path string, created_at string, closed boolean, topics {_TOPIC}, comments array<struct<body_html string, created_at string>>, user struct<username string>>"
PAGES_MOST, ITEMS_MOST = 10, 100


def listed_slugs(pages: DataFrame, number: str, payload: str, kind: str, username: str, most: int = ITEMS_MOST) -> DataFrame:
    """(position, slug) of a user's articles or scraps from list pages {articles: [...], next_page}, in order of pages and items.

    Pages count up to the first without next_page, PAGES_MOST at most; items of other users are dropped; at most ``most`` remain
    (a limit that is the feature). Pages that are no JSON hold nothing.
    """
    if kind not in ("articles", "scraps"):
        raise ValueError(kind)
    read = F.from_json(payload, f"struct<{kind} array<struct<slug string, user struct<username string>>>, next_page bigint>")
    rows = pages.select(F.col(number).cast("int").alias("n"), read.alias("r")).filter(F.col("n").between(1, PAGES_MOST))
    ends = rows.filter(F.col("r.next_page").isNull()).agg(F.coalesce(F.min("n"), F.lit(PAGES_MOST)).alias("last"))  # one row
    items = rows.crossJoin(F.broadcast(ends)).filter(F.col("n") <= F.col("last")).select("n", F.posexplode(f"r.{kind}").alias("i", "item"))
    own = items.filter((F.col("item.user.username") == username) & F.col("item.slug").isNotNull())
    top = own.orderBy("n", "i").limit(min(most, ITEMS_MOST))
    return top.select(F.row_number().over(Window.orderBy("n", "i")).alias("position"), F.col("item.slug").alias("slug"))


def _topics(c: Column) -> Column:
    return F.filter(F.transform(c, lambda t: F.coalesce(F.nullif(t["display_name"], F.lit("")), t["name"])), lambda t: t.isNotNull() & (t != ""))


def blog_articles(df: DataFrame, payload: str) -> DataFrame:
    """(slug, title, path, article_type, published_at, liked_count, topics, body_html) of article records; others have no row."""
    a = df.select(F.from_json(payload, f"struct<article {ARTICLE}>").alias("r")).select("r.article.*").filter(F.col("slug").isNotNull())
    return a.select("slug", "title", "path", "article_type", "published_at", "liked_count", _topics(F.col("topics")).alias("topics"), "body_html")


def blog_scraps(df: DataFrame, payload: str) -> DataFrame:
    """(slug, title, path, created_at, topics, n_comments, bodies) of scrap records; null comments and bodies are passed over."""
    s = df.select(F.from_json(payload, f"struct<scrap {SCRAP}>").alias("r")).select("r.scrap.*").filter(F.col("slug").isNotNull())
    bodies = F.filter(F.transform(F.coalesce("comments", F.array()), lambda c: c["body_html"]), lambda b: b.isNotNull() & (b != ""))
    return s.select("slug", "title", "path", "created_at", _topics(F.col("topics")).alias("topics"), F.size(bodies).alias("n_comments"), bodies.alias("bodies"))


def not_yet_there(df: DataFrame, known: DataFrame, key: str, force: bool = False) -> DataFrame:
    """The rows whose key is not known yet; all with ``force``."""
    return df if force else df.join(known.select(key).distinct(), key, "left_anti")


def feed_posts_upto(items: DataFrame, order: list[str], repost: Column, most: int, with_reposts: bool = False) -> DataFrame:
    """The first ``most`` posts of a feed, counted before reposts are dropped."""
    first = items.orderBy(*order).limit(most)
    return first if with_reposts else first.filter(~F.coalesce(repost, F.lit(False)))


def chosen_transcript(df: DataFrame, key: str, language: str, generated: str, order: tuple[str, ...] = ("ja", "en")) -> DataFrame:
    """One transcript a video: hand-made before generated, then by the order of languages, others last and in order of their names."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(language)), F.lit(0))
    place = F.struct(F.coalesce(F.col(generated), F.lit(True)).alias("g"), F.when(rank == 0, len(order) + 1).otherwise(rank).alias("r"), F.col(language).alias("l"))
    return df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), place).alias("_t")).select(key, "_t.*")
