"""Boundaries of marked-up texts, exact round trips, sizes, and stability under edits."""

import random

import pytest

from shirabe.llm.split_items import LIMIT, OVERLAP, boundaries, cuts, divide, landmarks, natural_boundaries, split_items

UNITS = [
    ["The cat sat. ", "Dr. Bo came at 3.5 p.m. with A. Lee (see fig. 2. Really!) today? ", '"Is it done?" he asked. ', "It was... perhaps not. ", "npm runs it! ", "Done."],
    ["空が青い。", "「本を読みました。」と言った。", "今日は（未確認。）雨でした！！", "歌を聞きました♪　", "『なぜか？』それは8.9％です。\n", "窓を開けました\n", "次の行です。"],
    ["# Title here\n\n", "A first line that is\nwrapped in the middle. ", "Second one.\n", "- item one. Still one.\n", "- item two\n", "1. first\n", "1. second.\n\n", "After the list."],
    ["| a | b |\n|---|---|\n", "| 1. | 2! |\n", "| 3 | 4 |\n\n", "Text.\n\n", "```py\nx = 1. \n\ny = 2!\n```\n\n", "End."],
    ["[00:05] First. ", "Second.\r\n", "[00:09] Third\r\n", "[00:12] Fourth!"],
    ["資料について見直し、更\n新と手順を整理する必要があります。\n", "終わりです。"],
    ["a" * 90 + "\n" + "b" * 90 + "\n\n", "Then text."],
    ["(A whole sentence that stands in its own brackets.) ", "Their river rose."],
]


@pytest.mark.parametrize("units", UNITS)
def test_boundaries(units):
    text = "".join(units)
    want = [sum(map(len, units[:i])) for i in range(1, len(units))]
    assert [text[a:].split("\n")[0][:12] for a in natural_boundaries(text)] == [text[a:].split("\n")[0][:12] for a in want]
    assert natural_boundaries(text) == want


@pytest.mark.parametrize("text", ["", " ", "\n\n", "x", "。", "```", "|", "[00:01] ", "　"])
def test_odd_texts(text):
    assert all(0 < a < max(1, len(text)) for a in natural_boundaries(text))


def made(seed, n):
    rnd = random.Random(seed)
    words = "river stone paper glass window market garden lantern thread copper".split()
    return "".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(4, 20))).capitalize() + rnd.choice([". ", "! ", ".\n\n"]) for _ in range(n))


@pytest.mark.parametrize("text", [made(1, 100), made(2, 400), "x" * 5000, "空が青い。" * 900, "あ" * 3000, "𠮷野家。" * 500, "word " * 2000])
def test_pieces_are_whole_and_within_limit(text):
    ends = [0, *cuts(text), len(text)]
    assert ends == sorted(set(ends))
    pieces = [text[max(0, a - OVERLAP if i else 0) : b] for i, (a, b) in enumerate(zip(ends, ends[1:]))]
    assert max(map(len, pieces)) <= LIMIT
    assert pieces[0] + "".join(p[OVERLAP:] for p in pieces[1:]) == text
    natural = set(natural_boundaries(text))
    if len(natural) > len(text) / 300:
        assert all(c in natural for c in cuts(text))


def test_an_edit_alters_only_near_pieces():
    text = made(3, 2000)
    at = len(text) // 2
    edited = text[:at] + " Inserted words here. " + text[at:]
    grow = len(edited) - len(text)
    before, after = set(cuts(text)), {c if c < at else c - grow for c in cuts(edited)}
    assert len(before ^ after) <= 12 < len(before) / 10


def test_frames(spark):
    long = made(4, 60)
    rows = [("a", long), ("a", long), ("b", "short"), ("c", ""), ("d", None), (None, long), ("e", "y" * 200_000)]
    df = spark.createDataFrame([(i, t, 0, "clash") for i, t in rows], "id string, text string, piece int, chunk_id string")
    got = split_items(df, "id", "text").collect()
    assert {r["chunk_id"] for r in got} == {"a", "b", "c", "e", None}
    assert all(len(r["text"]) <= LIMIT for r in got)
    one = sorted((r["piece"], r["start_at"], r["end_at"]) for r in got if r["chunk_id"] is None)
    assert [p[0] for p in one] == list(range(len(one))) and one[0][1] == 0 and one[-1][2] == len(long)
    assert all(a[2] == b[1] for a, b in zip(one, one[1:]))
    assert sorted(r["cut_at"] for r in boundaries(df, "id", "text").filter("chunk_id is null").collect()) == natural_boundaries(long)
    assert split_items(df.limit(0), "id", "text").count() == 0 == boundaries(df.limit(0), "id", "text").count()
    with pytest.raises(ValueError):
        split_items(df, "id", "text", limit=50)


LONG_EN, LONG_JA = "The old cat sat near a door. " * 40, "猫が戸の前で静かに寝ていた。" * 60


@pytest.mark.parametrize("quoted", ["“" + LONG_EN + "”", "(" + LONG_EN + ")", '"' + LONG_EN.strip().replace("door. The", "door.\nThe") + '"', "(see (" + LONG_EN + ") and more)"])
def test_long_quotations_and_brackets_are_one_unit(quoted):
    text = "He began " + quoted + " and left. Then it rained."
    assert natural_boundaries(text) == [text.index("Then")]


@pytest.mark.parametrize("a,b", ["「」", "『』", "（）", "【】"])
def test_long_japanese_quotations_are_one_unit(a, b):
    text = f"彼は{a}{LONG_JA}{a}犬。{b}{LONG_JA}{b}と言った。雨が降った。"
    assert natural_boundaries(text) == [text.index("雨")]


@pytest.mark.parametrize("mark", ["“", "(", '"'])
def test_marks_that_never_close_are_plain_text(mark):
    text = f"He began {mark}so it went. " + LONG_EN + "Then (it rained. Really.) and so on. The end."
    assert len(natural_boundaries(text)) == 42 and text.index("The end") in natural_boundaries(text)
    assert natural_boundaries("It cost (cf. vol.\n3) our ash. The end.") == [30]
    assert len(natural_boundaries('It is 5" wide. ' + LONG_EN + 'One is 7", he said. The end.')) == 42


def test_every_cut_is_a_boundary_a_landmark_or_the_limit(spark):
    """Boundaries and pieces come from one division of each text."""
    rnd = random.Random(9)
    words = ["river", "lamp", "quiet", "stone", "bridge", "letter", "harbour", "seven"]
    texts = [" ".join((" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 14))) + ".").capitalize() for _ in range(90)) for _ in range(20)] + ["x" * 3000, "ab cd " * 700, "（" + "文です。" * 400 + "）"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    natural = {(r["chunk_id"], r["cut_at"]) for r in boundaries(df, "id", "text").collect()}
    plain = forced = 0
    for r in split_items(df, "id", "text").collect():
        if r["piece"] and (r["chunk_id"], r["start_at"]) in natural:
            plain += 1
        elif r["piece"]:
            forced += 1
            assert r["chunk_id"] >= 20
            assert r["start_at"] in set(landmarks(texts[r["chunk_id"]]).tolist()) or r["end_at"] - r["start_at"] <= 731
    assert plain > 100 and forced
    for i, t in enumerate(texts):
        units, marks, ends = divide(t)
        assert {c for k, c in natural if k == i} == set(units) and list(marks) == list(landmarks(t)) and ends == cuts(t)


def test_long_brackets_after_a_line_break_and_plain_verbs():
    inner = "x" * 900
    assert natural_boundaries(f"The box\n({inner}) is full. Then it closed.") == [len(f"The box\n({inner}) is full. ")]
    assert natural_boundaries("We walked to the\nriver. Then we left.") == [24]
