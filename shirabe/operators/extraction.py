"""Which way a PDF's text is taken: from its text layer, or by layout analysis with or without reading the page images. Judged on extracted pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of producers that tell TeX, and of fonts that tell formulas.
TEX = ("tex", "latex", "pdflatex", "xelatex", "lualatex", "dvips", "dvipdfm")
MATH_FONTS = ("cmmi", "cmsy", "cmex", "msam", "msbm", "stix", "cambria math", "latin modern math")
#: Thresholds of the character shares and of characters a page.
BROKEN_MOST, GREEK_MOST, CJK_LEAST, PAGE_LEAST = 0.10, 0.15, 0.05, 10
_BROKEN, _CJK, _GREEK = r"[\x{FFFD}]", r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]", r"[\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}]"


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(c).rlike("|".join(words)), F.lit(False))


def extraction_choice(pages: DataFrame, key: str, text: str, producer: Column, fonts: Column, unmapped: Column) -> DataFrame:
    """(key, backend, mode, reason) of each document from its pages; the first reason that holds decides.

    producer: the creating program; fonts: the names of a page's fonts in one text; unmapped: whether a page has a font without a
    mapping to characters. Null texts count as empty pages, null marks as absent. The sums are combined before the exchange.
    """
    t = F.coalesce(text, F.lit(""))
    count = lambda p: F.sum(F.regexp_count(t, F.lit(p)))
    d = pages.groupBy(key).agg(
        F.sum(F.char_length(t)).alias("_n"), F.count(F.lit(1)).alias("_pages"), count(_BROKEN).alias("_broken"), count(_CJK).alias("_cjk"), count(_GREEK).alias("_greek"),
        F.max(_any(producer, TEX)).alias("_tex"), F.max(_any(fonts, MATH_FONTS)).alias("_math"), F.max(F.coalesce(unmapped, F.lit(False))).alias("_unmapped"),
    )
    share = lambda c: F.when(F.col("_n") > 0, F.col(c) / F.col("_n")).otherwise(0.0)
    reason = (
        F.when(F.col("_unmapped"), "unmapped")
        .when(share("_broken") > BROKEN_MOST, "broken")
        .when((share("_cjk") < CJK_LEAST) & (share("_greek") > GREEK_MOST), "greek")
        .when(F.col("_n") / F.col("_pages") < PAGE_LEAST, "empty")
        .when(F.col("_math"), "math")
        .when(F.col("_tex"), "tex")
        .otherwise("plain")
    )
    out = d.select(key, reason.alias("reason"))
    layout = F.col("reason") != "plain"
    mode = F.when(F.col("reason").isin("math", "tex"), "txt").when(layout, "ocr")
    return out.select(key, F.when(layout, "layout").otherwise("text").alias("backend"), mode.alias("mode"), "reason")
