"""Reading level of each document by regularised ordinal regression.

Features of length, lexical diversity, word rarity, connectives and clause depth are computed for the script that a document is
mainly written in (each script has its own block of weights). The rarity of a word comes from exact counts over the whole corpus. A
proportional-odds model with an L2 penalty is fitted to a bounded sample of rated documents and applied to all.

A document is judged by its running text; only where tables hold nearly all of it, by the cells that are sentences.

Costs at scale: a pass over the texts that counts words (combined before the exchange), one over the sampled documents, one that
judges. Sent to the driver are the words of at least WORD_SHARE of all words, so at most 1 / WORD_SHARE of them, and the sample's
features, a fixed number each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.session import spread

LEAST_CHARS, LEVELS = 300, 5
#: The share of all words below which a word counts as rarest; rated documents that the model is fitted on at most.
WORD_SHARE, RATED_MOST = 2e-6, 8000
#: Different words of a task that are held before they are handed on; the weight of running text (wide characters count twice) that is enough to judge by.
HELD, ENOUGH = 200_000, 60
#: Words of a stretch whose variety is measured.
SEGMENT = 80

_FENCE = re.compile(r"^(?:```|~~~)[\s\S]*?(?:^(?:```|~~~)[ \t\r]*$|\Z)", re.MULTILINE)
_LATIN = re.compile(r"[^\W\d_\u3040-\u30ff\u3400-\u9fff々]+(?:[-'’][^\W\d_\u3040-\u30ff\u3400-\u9fff々]+)*")
_ANY_WORD = re.compile(_LATIN.pattern + "|[一-鿿々]+|[ァ-ヺー]+")
_JA_WORD = re.compile(r"[一-鿿々]+|[ァ-ヺー]+")
_KANA_RUN = re.compile(r"[ぁ-ゖ]+")
_ROW = re.compile(r"^[ \t]*\|[^\n]*", re.MULTILINE)
_END = re.compile(r"[.!?。！？♪…]+(?=[\s」』）)\"”’]|$|[^\x00-\x7f])")
_HIRAGANA = re.compile(r"[ぁ-ゖ]")

#: Connectives by how demanding they are: coordinating, common and less common subordinating ones, those of formal writing.
CONNECTIVES_EN = (
    ("and", "but", "so", "or", "then"),
    ("when", "while", "because", "after", "before", "if", "until"),
    ("although", "though", "since", "unless", "whereas", "whether", "which", "during", "within", "throughout"),
    ("however", "therefore", "thus", "hence", "moreover", "furthermore", "nevertheless", "consequently", "notwithstanding", "insofar", "whereby", "thereby", "albeit", "whose"),
)
CONNECTIVES_JA = (
    ("と", "は", "まで", "で、", "から、"),
    ("ので", "ごとに", "では", "のに", "ながら", "けれど", "について"),
    ("および", "に関して", "を通じて", "に基づき", "による", "により", "に伴い", "ため、", "ものの"),
    ("ならびに", "もしくは", "ないし", "ゆえに", "に鑑み", "において", "に際して", "とすれば", "限り", "ひいては", "すなわち", "ざるを得"),
)
_LATINATE = ("tion ", "sion ", "ment ", "ance ", "ence ", "ical ", "ised ", "ized ", "able ", "ible ", "logy ", "eous ", "aphy ", "tive ")


def _cells(row: re.Match[str]) -> str:
    """The cells of a table row that hold sentences, one to a line."""
    cells = (c.strip() for c in row.group().split("|"))
    return "\n".join(c if c[-1] in ".!?。！？♪" else c + "." for c in cells if c.count(" ") >= 2 or _HIRAGANA.search(c))


def _weight(text: str) -> int:
    return sum(2 if c > "\u2fff" else 1 for c in text if not c.isspace())


def prose_of(text: str) -> tuple[str, bool]:
    """(the text to judge by, whether it is cells): without code blocks and tables, or, where little is left, with the cells that hold sentences."""
    text = _FENCE.sub(" ", text)
    if "|" not in text:
        return text, False
    rest = _ROW.sub("", text)
    return (rest, False) if _weight(rest) >= ENOUGH else (_ROW.sub(_cells, text), True)


def _variety(words: list[str]) -> float:
    """The mean share of different words over all stretches of SEGMENT words; the last stretch ends with the text."""
    last = max(0, len(words) - SEGMENT)
    starts = [*range(0, last, SEGMENT), last]
    return sum(len(set(words[a : a + SEGMENT])) for a in starts) / len(starts) / max(1, min(SEGMENT, len(words)))


def profile(text: str) -> tuple[bool, np.ndarray, list[str]]:
    """(mainly Japanese, form features (the last: whether only cells are judged), words) of one text."""
    plain, cells = prose_of(text)
    low = plain.lower()
    latin = _LATIN.findall(low)
    kana = _KANA_RUN.findall(plain)
    hiragana = len("".join(kana))
    ja = 2 * hiragana > len("".join(latin))
    words = _JA_WORD.findall(plain) if ja else latin
    n = max(1, len(words))
    kinds = Counter(words)
    sizes = np.array(list(map(len, words)) or [0])
    mean = sizes.sum() / len(sizes)
    sentences = max(1, len(_END.findall(plain)), plain.count("\n") // 12)
    chars = max(1, len(plain) - plain.count(" ") - plain.count("\n"))
    block = [
        math.log(n / sentences + 1),
        math.log(chars / sentences + 1),
        mean,
        max(0.0, (sizes * sizes).sum() / len(sizes) - mean * mean) ** 0.5,
        *(np.count_nonzero(sizes >= least) / len(sizes) for least in ((4, 5, 6) if ja else (7, 10, 13))),
        len(kinds) / n**0.75,
        _variety(words),
        (plain.count("、") if ja else plain.count(",") + plain.count(";")) / sentences,
    ]
    if ja:
        kanji = len("".join([w for w in words if w[0] > "ヺ"]))
        katakana = int(sizes.sum()) - kanji
        block += [kanji / chars, katakana / chars, hiragana / chars, kanji / max(1, kanji + hiragana)]
        block += [sum(map(plain.count, group)) / sentences for group in CONNECTIVES_JA]
        block += [plain.count("の") / sentences, plain.count("的") / n]
    else:
        row = " ".join(words) + " "
        block += [sum(map(row.count, _LATINATE)) / n, np.count_nonzero((sizes <= 3) & (sizes > 0)) / n, low.count("-") / n, row.count("ed ") / n]
        counts = [sum(map(kinds.__getitem__, group)) for group in CONNECTIVES_EN]
        block += [c / sentences for c in counts]
        block += [sum(counts[2:]) / n, counts[0] / n]
    block.append(float(cells))
    return ja, np.array(block), words


_QUANTILES = np.array([0.05, 0.25, 0.5, 0.75, 0.95])


def _spread(v: np.ndarray) -> list[float]:
    """Mean, deviation and nearest-rank quantiles."""
    v = np.sort(v)
    n = len(v)
    mean = v.sum() / n
    return [mean, np.sqrt(max(0.0, (v * v).sum() / n - mean * mean)), *v[((n - 1) * _QUANTILES + 0.5).astype(int)].tolist()]


FORM, SPREAD = 20, 7
HALF = FORM + SPREAD


class Rarity(dict):
    """word -> how rare it is, from {word: count} of the words of at least WORD_SHARE of ``total``; all others are as rare as that."""

    def __init__(self, counts: dict[str, int], total: int):
        super().__init__((w, -math.log(n / total)) for w, n in counts.items())
        self.rarest = -math.log(WORD_SHARE)

    def __missing__(self, word: str) -> float:
        return self.rarest


def vector(text: str, rarity: Rarity) -> np.ndarray:
    """The feature vector: the script, one block for each script, of which one is in use, and how cells shift the scale (their sentences are simpler than the document)."""
    ja, form, words = profile(text)
    out = np.zeros(1 + 2 * HALF + 4)
    rare = _spread(np.array(list(map(rarity.__getitem__, words)))) if words else [0.0] * SPREAD
    out[0] = 1.0 if ja else -1.0
    out[1 + ja * HALF : 1 + (ja + 1) * HALF] = [*form[:FORM], *rare]
    cells, mean = form[FORM], rare[0]
    out[1 + 2 * HALF :] = cells, cells * mean, cells * ja, cells * ja * mean
    return out


class Ordinal:
    """Proportional odds, fitted by gradient steps (Adam) with an L2 penalty on standardised features (each block within its own script)."""

    def __init__(self, levels: int = LEVELS, penalty: float = 30.0):
        self.levels, self.penalty = levels, penalty

    def _scale(self, x: np.ndarray) -> np.ndarray:
        z = np.where(x == 0, 0.0, (x - self.mean) / self.std)
        return np.hstack([z, np.clip(z, -3, 3) ** 2])

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 400) -> Ordinal:
        used = x != 0
        count = np.maximum(1, used.sum(0))
        self.mean = x.sum(0) / count
        self.std = np.sqrt(np.where(used, (x - self.mean) ** 2, 0).sum(0) / count) + 1e-6
        z = self._scale(x)
        k = self.levels - 1
        self.w = np.zeros(z.shape[1])
        share = np.clip(np.array([(y <= j + 1).mean() if len(y) else 0.5 for j in range(k)]), 0.01, 0.99)
        self.cuts = np.maximum.accumulate(np.log(share / (1 - share)) + np.arange(k) * 1e-3)
        m = v = np.zeros(len(self.w) + k)
        hit = y[:, None] <= np.arange(1, k + 1)[None, :]
        for t in range(1, rounds + 1):  # Adam on the sum of the binary losses of all cuts
            p = 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - (z @ self.w)[:, None], -30, 30)))
            d = p - hit
            g = np.r_[-(z.T @ d.sum(1)) / max(1, len(y)) + self.penalty * self.w / max(1, len(y)), d.mean(0)]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (1 - t / (rounds + 1))
            self.w, self.cuts = self.w - step[: len(self.w)], np.maximum.accumulate(self.cuts - step[len(self.w) :])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 + ((self._scale(x) @ self.w)[:, None] > self.cuts[None, :]).sum(1)


def word_counts(df: DataFrame, text: str) -> Rarity:
    """How rare each word is, counted exactly over all texts. The counts of the words kept add up to no more than all words, so at most
    1 / WORD_SHARE of them leave the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.update(_ANY_WORD.findall(t.lower()))
                if len(held) > HELD:
                    yield hand_on()
        yield hand_on()

    sums = spread(df.select(text)).filter(F.col(text).isNotNull()).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    total = F.broadcast(sums.agg(F.sum("n").alias("total")))  # one row; the exchange of the sums is used again
    found = sums.crossJoin(total).filter(F.col("n") >= F.col("total") * WORD_SHARE).toArrow()
    counts = dict(zip(found["word"].to_pylist(), found["n"].to_pylist()))
    return Rarity(counts, found["total"][0].as_py() if counts else 1)


def rated_sample(labels: DataFrame, key: str, level: str, most: int) -> DataFrame:
    """(key, level): the median rating of at most ``most`` rated documents, those whose hashed ids come first. Null ratings do not count."""
    rated = labels.filter(F.col(level).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.floor(F.expr(f"percentile(`{level}`, 0.5)") + 0.5).cast("int").alias("_level"))
    return rated.filter(F.col("_level").between(1, LEVELS)).orderBy(F.xxhash64(key), key).limit(most)


def fit_levels(docs: DataFrame, labels: DataFrame, key: str, text: str, level: str, rarity: Rarity, most: int = RATED_MOST) -> Ordinal | None:
    """The model, from at most ``most`` rated documents, each once however often it is repeated; None where no rated document has a text."""
    sample = F.broadcast(rated_sample(labels, key, level, most))  # at most ``most`` rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [vector(t, rarity).tolist() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["k", "level", "x"])

    long = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.char_length("_text") >= LEAST_CHARS)
    rated = long.join(sample.withColumnRenamed(key, "_key"), "_key").select(F.xxhash64("_key").alias("k"), "_level", "_text")
    once = rated.mapInArrow(run, "k bigint, level int, x array<double>").groupBy("k").agg(F.max(F.struct("level", "x")).alias("r"))
    rows = sorted((r["r"]["level"], r["r"]["x"]) for r in once.collect())
    return Ordinal().fit(np.array([x for _, x in rows]), np.array([y for y, _ in rows])) if rows else None


def reading_levels(docs: DataFrame, labels: DataFrame, key: str, text: str, level: str) -> DataFrame:
    """(key, reading_level): the level 1 to LEVELS of every document of at least LEAST_CHARS characters.

    Null and shorter texts have no row; a text without words is judged by its form alone; repeated rows give equal rows. Of several
    ratings of a document the median counts, a half rounded up; null ratings and ratings of unknown documents are ignored. Without
    any rated document every level is null. Empty tables give an empty table.
    """
    rarity = word_counts(docs, text)
    model = fit_levels(docs, labels, key, text, level, rarity)
    key_type = docs.schema[key].dataType.simpleString()
    long = spread(docs.select(key, text)).filter(F.char_length(text) >= LEAST_CHARS)
    if model is None:
        return long.select(key, F.lit(None).cast("bigint").alias("reading_level"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array([vector(t, rarity) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.predict(x), pa.int64())], names=[key, "reading_level"])

    return long.mapInArrow(run, f"`{key}` {key_type}, reading_level bigint")
