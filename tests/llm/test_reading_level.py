"""Held-out accuracy, the ordinal model itself, and odd inputs."""

import random

import numpy as np
import pytest

from shirabe.llm.reading_level import HALF, WORD_SHARE, Ordinal, Rarity, profile, prose_of, reading_levels, vector, word_counts

EN = [
    ["The red box ate.", "My dog hid a hat.", "A cat sat by the door."],
    ["Every lesson followed our summer and our ladder held the letter.", "The kitchen lost one basket but our teacher found every picture."],
    ["When our review compared the recent project, another setting updated the common feature.", "Because the message measured our network, each folder recorded the internal schedule."],
    ["Although any deterministic migration consolidated the repository, the configuration, which documented such a dependency, approximated the infrastructure."],
    ["Notwithstanding that each epistemic reconciliation presupposed the stratification, every historiography, whose commensurability circumscribed any idempotence, substantiated the heterogeneity."],
]
JA = [
    ["ほしはほんをかいました。", "いぬはねこをみました。"],
    ["静かな花火は明るい学校と図書館を持って帰りました。", "先生まで、友だちは古い写真を見つけました。"],
    ["作業が増えてきたので、画面について必要な設定を確認しました。", "会議ごとに記事を見直し、主な資料と手順を更新しました。"],
    ["統計的な評価指標が例外処理に及ぼす影響を踏まえ、実装方針に基づき検索精度および類似度を、移行計画を通じて再設計することにした。"],
    ["超越論的な認識論的前提が本質的に不可分な蓋然性評価との緊張関係に起因すると解される以上、概念的枠組を媒介として捨象していると言わざるを得ない。"],
]


def made(rnd, level):
    pool = rnd.choice([EN, JA])[level - 1]
    return " ".join(rnd.choice(pool) for _ in range(40))


def test_held_out_accuracy(spark):
    rnd = random.Random(1)
    truth = {i: rnd.randint(1, 5) for i in range(240)}
    docs = spark.createDataFrame([(i, made(rnd, t), 9) for i, t in truth.items()], "doc_id long, text string, reading_level int")
    labels = spark.createDataFrame([(i, t) for i, t in truth.items() if i % 2] + [(1, None), (9999, 3), (None, 2)], "doc_id long, reading_level long")
    got = {r["doc_id"]: r["reading_level"] for r in reading_levels(docs, labels, "doc_id", "text", "reading_level").collect()}
    assert set(got) == set(truth)
    assert np.mean([got[i] == t for i, t in truth.items() if i % 2 == 0]) >= 0.9


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "short"), (4, "x" * 300), (5, "\n" * 400), (6, "| 1 | 2 |\n" * 60), (7, made(random.Random(2), 3) * 50), (8, "9" * 500), (9, "\U0001f600" * 300)]
    docs = spark.createDataFrame(rows + [(4, "x" * 300)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 3), (4, 1), (7, 4), (7, None)], "doc_id long, reading_level long")
    got = reading_levels(docs, labels, "doc_id", "text", "reading_level").collect()
    assert sorted(r["doc_id"] for r in got) == [4, 4, 5, 6, 7, 8, 9]
    assert all(1 <= r["reading_level"] <= 5 for r in got)
    unrated = reading_levels(docs, labels.limit(0), "doc_id", "text", "reading_level").collect()
    assert len(unrated) == 7 and all(r["reading_level"] is None for r in unrated)
    assert reading_levels(docs.limit(0), labels, "doc_id", "text", "reading_level").count() == 0


def test_ordinal_orders_levels():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = 1 + np.digitize(x[:, 0] * 2 - x[:, 1], [-2, -0.7, 0.7, 2])
    model = Ordinal(penalty=1).fit(x[:400], y[:400])
    assert (model.predict(x[400:]) == y[400:]).mean() > 0.85
    assert (np.diff(model.cuts) >= 0).all()


@pytest.mark.parametrize("text", ["", "a", "あ", "|", "```\ncode"])
def test_profile_shapes(text):
    assert vector(text, Rarity({}, 1)).shape == (1 + 2 * HALF + 4,)


def test_words_are_counted_exactly(spark):
    rnd = random.Random(4)
    texts = [" ".join(f"w{rnd.randrange(10**9):x}q".translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(500)) + " the café あ漢字" for _ in range(400)]
    df = spark.createDataFrame([(t, "clash") for t in texts] + [(None, "")], "text string, word string")
    got = word_counts(df, "text")
    words = [w for t in texts for w in [*t.split()[:502], "漢字"]]
    assert got["the"] == got["café"] == got["漢字"] == pytest.approx(-np.log(400 / len(words)))
    assert len(got) == len(set(words)) <= 1 / WORD_SHARE  # every word of this small corpus is above the share
    assert got["never"] == -np.log(WORD_SHARE)


def test_running_text_goes_before_cells():
    table = "| Ab | 3.2 | The cat sat down. |\n" * 20
    assert prose_of(table + "\n" + "A sentence that stands outside of every table and says a good deal more than they do.\n")[1] is False
    plain, cells = prose_of(table)
    assert cells and "The cat sat down." in plain and "3.2" not in plain


def test_variety_is_of_the_whole_text():
    letters = "abcdefghij"
    kinds = [a + b + c for a in letters for b in letters for c in "xy"]
    share = lambda words: profile(" ".join(words))[1][8]
    assert share(kinds[:80]) == 1.0 and share(kinds[:7] + kinds[:7]) == 0.5 and share([]) == 0.0
    assert share(kinds[:80] + ["word"] * 160) == pytest.approx((80 + 1 + 1) / 240)
    assert share(["word"] * 160 + kinds[:80]) == pytest.approx((80 + 1 + 1) / 240)
    assert share(kinds[:80] + ["word"] * 40) == pytest.approx((80 + 41) / 160)
