"""Text expressions: whitespace as Python sees it, normalisation, tokens, splitting, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Japanese function words that are no search terms.
STOP_WORDS = (
    "の", "に", "は", "を", "た", "が", "で", "て", "と", "し", "れ", "さ", "ある", "いる", "も", "する", "から", "な", "こと", "として",
    "い", "や", "れる", "など", "なっ", "ない", "この", "ため", "その", "あっ", "よう", "また", "もの", "という", "あり", "まで", "られ", "なる", "へ", "か",
    "だ", "これ", "によって", "により", "おり", "より", "による", "ず", "なり", "られる", "において", "ば", "なかっ", "なく", "しかし", "について", "せ", "だっ", "その他", "できる",
    "それ", "う", "ので", "なお", "のみ", "でき", "き", "つ", "における", "および", "いう", "さらに", "でも", "ら", "たり", "その後", "ほか", "ほど", "ます", "です", "ました", "でした",
)


def strip(c: Column) -> Column:
    """Without white space at both ends, in the Unicode sense (U+3000 included)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Search tokens: lower case, split at white space and sentence marks, without stop words and single characters. Null gives null."""
    parts = F.split(F.lower(text), r"(?U)[\s.,!?、。！？]+")
    return F.filter(parts, lambda t: (F.char_length(t) > 1) & ~t.isin(*STOP_WORDS))


def ngram_tokens(text: Column) -> Column:
    """Tokens for languages without spaces: every two neighbouring characters of a run of kana and kanji, a lone one as it is, and the words of other scripts. Null gives null."""
    run = "[ぁ-ゖァ-ヺー一-鿿々]+"
    parts = F.regexp_extract_all(F.lower(text), F.lit(f"{run}|[a-z0-9]+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
    return F.flatten(F.transform(parts, lambda r: F.when(r.rlike(f"^{run}$"), pairs(r)).otherwise(F.array(r))))


def normalise(text: Column) -> Column:
    """No blanks at line ends, no more than one empty line in a row, nothing but text at both ends."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n"))


def paragraphs(text: Column) -> Column:
    """Array of the stripped, non-empty paragraphs (divided by blank lines)."""
    return F.filter(F.transform(F.split(text, r"\n(?U)\s*\n"), strip), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Array of stripped, non-empty sentences, each ending after 。 . ! or ?"""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[。.!?])\s*"), strip), lambda p: p != "")


def slices(text: Column, size: int, step: int | None = None) -> Column:
    """Array of code-point slices of ``size``, each starting ``step`` after the one before; the last reaches the end first."""
    step = step or size
    n = F.char_length(text)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step).cast("int")) if step < size else F.floor((n - 1) / step).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, (i * step + 1).cast("int"), F.lit(size)))).otherwise(F.array().cast("array<string>"))


def size_text(n: Column) -> Column:
    """A byte count as B, KB, MB or GB with one decimal (halves to even)."""
    f = n.cast("double")
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.format_string("%.1f KB", F.bround(f / 1024, 1)))
        .when(n < 1024**3, F.format_string("%.1f MB", F.bround(f / 1024**2, 1)))
        .otherwise(F.format_string("%.1f GB", F.bround(f / 1024**3, 1)))
    )


def elapsed_text(seconds: Column) -> Column:
    """A duration in seconds, minutes and seconds, or hours, minutes and seconds, in Japanese."""
    h, m, r = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), (seconds % 60).cast("double")
    return (
        F.when(seconds < 60, F.format_string("%.1f 秒", r))
        .when(seconds < 3600, F.format_string("%d 分 %.1f 秒", m, r))
        .otherwise(F.format_string("%d 時間 %d 分 %.1f 秒", h, m, r))
    )


def has_heading(text: Column) -> Column:
    """Whether a line is a Markdown heading or the text holds an HTML heading."""
    return text.rlike(r"(?m)^#{1,6}\s+.+") | text.rlike(r"(?i)<h[1-6][^>]*>.*?</h[1-6]>")


def is_table(text: Column) -> Column:
    """Whether the text is tabular: piped rows with a rule, or enough lines of several cells or of numbers."""
    lines = F.split(strip(text), "\n")
    bars = lambda l: F.char_length(l) - F.char_length(F.replace(l, F.lit("|"), F.lit("")))  # noqa: E731, E741
    piped = F.size(F.filter(lines, lambda l: bars(l) >= 2)) >= 2  # noqa: E741
    rule = F.exists(lines, lambda l: strip(l).rlike(r"^\|?[\s\-:|]+\|[\s\-:|]+\|?$"))  # noqa: E741
    full = F.filter(F.transform(lines, strip), lambda l: l != "")  # noqa: E741
    cells = F.filter(F.transform(full, lambda l: F.split(l, r"\t|(?U)\s{2,}")), lambda c: F.size(c) >= 3)  # noqa: E741
    number = lambda x: F.regexp_replace(strip(x), "[¥$€£,円%]", "").rlike(r"^-?\d+\.?\d*$")
    numeric = F.filter(cells, lambda c: F.size(F.filter(c, number)) * 2 >= F.size(c))
    n = F.size(full)
    spaced = (n >= 2) & ((F.size(cells) / n >= 0.3) | (F.size(numeric) / n >= 0.2))
    return (F.size(lines) >= 2) & ((piped & rule) | spaced)


def content_type(text: Column) -> Column:
    """prose, heading, table or mixed; blank and null texts are prose."""
    t = strip(F.coalesce(text, F.lit("")))
    table, heading = is_table(t), has_heading(t)
    return F.when(t == "", "prose").when(table & heading, "mixed").when(table, "table").when(heading, "heading").otherwise("prose")
