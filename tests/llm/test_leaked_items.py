"""Planted leaks in many disguises, near misses, and the edit distance against a plain one."""

import random

import pytest

from shirabe.llm.leaked_items import build_index, edit_distance_within, find_in, leaked_items, tokens, undone

EN = (
    "When our review compared the recent project, another setting updated the common feature. The kitchen lost one basket near the yellow window! "
    "Because the message measured our network, each folder recorded the internal schedule. Every lesson followed our summer behind the ladder."
)
JA = "会議ごとに記事を見直し、主な資料と手順を更新しました。静かな花火は明るい学校と図書館を持って帰りました！先生まで、友だちは古い写真を見つけました。作業が増えてきたので、画面について必要な設定を確認しました。"
FILLER = "A gardener walked along the quiet harbour with a lantern. Nobody saw the boats that left before the storm. "
FILLER_JA = "港では朝から風が強く、漁師たちは船を出しませんでした。町の人々は窓を閉めて待ちました。"
EN_PARTS = EN.replace("!", ".").split(". ")


def embed(text, ja=False):
    f = FILLER_JA if ja else FILLER
    return f * 2 + text + f * 2


CASES = [
    ("whole", embed(EN), 1), ("upper", embed(EN.upper()), 1), ("bold", embed(EN.replace("the", "**the**")), 1), ("html", embed(EN.replace("our", "<b>our</b>").replace("'", "&#39;")), 1),
    ("wide", embed("".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in EN)), 1), ("no marks", embed(EN.replace(",", "").replace(".", "")), 1), ("wrapped", embed(EN.replace(" ", "\n")), 1),
    ("escaped", embed(EN.encode("unicode_escape").decode().replace(" ", "\\n")), 1), ("three of four", embed(". ".join(EN_PARTS[:3]) + "."), 1), ("apart", embed(EN_PARTS[0] + ". " + FILLER + EN_PARTS[2] + ". "), 1),
    ("edited", embed(EN.replace("recent", "late").replace("basket", "bag").replace("internal", "inner").replace("summer", "winter")), 1),
    ("ja", embed(JA, True), 2), ("ja spaced", embed(" ".join(JA), True), 2), ("ja edited", embed(JA.replace("資料", "資金").replace("写真", "写本"), True), 2), ("ja html", embed("".join(f"&#{ord(c)};" for c in JA), True), 2),
    ("ja escaped", embed("".join(f"\\u{ord(c):04x}" for c in JA), True), 2),
    ("one sentence", embed(EN_PARTS[0] + "."), None), ("order", embed(". ".join([EN_PARTS[3], EN_PARTS[1], EN_PARTS[0]])), None), ("far", embed(EN_PARTS[0] + ". " + FILLER * 40 + EN_PARTS[2] + "."), None),
    ("much edited", embed(" ".join(w if i % 3 else "other" for i, w in enumerate(EN.split()))), None), ("ja one", embed(JA.split("。")[0] + "。", True), None), ("filler", FILLER * 30, None), ("empty", "", None), ("null", None, None),
    ("long", FILLER * 3000 + EN + FILLER * 3000, 1),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(n, t, 0, "clash") for n, t, _ in CASES] + [("whole", embed(EN), 0, "again")], "doc_id string, text string, _item long, passage string")
    items = spark.createDataFrame([(1, EN), (2, JA), (3, None), (4, ""), (5, "?!"), (6, "Zebra quartz jumps.")], "item_id long, passage string")
    return {(r["doc_id"], r["item_id"]) for r in leaked_items(docs, "doc_id", "text", items, "item_id", "passage").collect()}


@pytest.mark.parametrize("name,want", [(n, w) for n, _, w in CASES])
def test_case(found, name, want):
    assert {i for n, i in found if n == name} == ({want} if want else set())


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, EN)], "doc_id long, text string"), spark.createDataFrame([(1, EN)], "item_id long, passage string")
    assert leaked_items(docs.limit(0), "doc_id", "text", items, "item_id", "passage").count() == 0
    assert leaked_items(docs, "doc_id", "text", items.limit(0), "item_id", "passage").count() == 0


def test_edit_distance():
    rnd = random.Random(1)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    for _ in range(300):
        a = [rnd.randint(0, 4) for _ in range(rnd.randint(1, 20))]
        b = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 40))]
        d = plain(a, b)
        assert edit_distance_within(a, b, 99)[0] == d
        assert (edit_distance_within(a, b, 2)[1] >= 0) == (d <= 2)


def test_undone():
    assert tokens("Ｆｏｏ &amp;#x41; \\u3042\\n<b>b</b>a*r* quasi-\nset %E3%81%82%E3%81%84") == ["foo", "a", "あ", "bar", "quasiset", "あ", "い"]
    assert undone("") == ""


def short_items(rnd, n):
    """Passages of four short sentences, English ones of 4 to 9 words and Japanese ones of 10 to 16 characters."""
    words = ["".join(rnd.choice("bdgklmnprst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(150)]
    for i in range(n):
        if i % 2:
            yield [[chr(0x3042 + rnd.randrange(80)) for _ in range(rnd.randint(10, 16))] for _ in range(4)]
        else:
            yield [[rnd.choice(words) for _ in range(rnd.randint(4, 9))] for _ in range(4)]


@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("edited", [False, True])
def test_halves_of_items_of_short_sentences(apart, edited):
    rnd = random.Random(3)
    items = list(short_items(rnd, 200))
    write = lambda s: "".join(s) + "。" if len(s[0]) == 1 else " ".join(s).capitalize() + ". "
    index = build_index(range(200), ["".join(map(write, item)) for item in items])
    lost = []
    for i, item in enumerate(items):
        ja = len(item[0][0]) == 1
        weight = [len(write(s).strip()) for s in item]
        half = next(p for p in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)) if 2 * (weight[p[0]] + weight[p[1]]) >= sum(weight))
        taken = [list(item[k]) for k in half]
        if edited:
            for s in taken:
                s[rnd.randrange(len(s))] = "猫" if ja else "quux"
        between = ("港では朝から風が強かった。" if ja else "A gardener walked along. ") if apart else ""
        if find_in(index, [embed(write(taken[0]) + between + write(taken[1]), ja)]) != [(0, i)]:
            lost.append(i)
    assert lost == []


def test_a_stray_copy_far_ahead_hides_no_leak():
    first = "Our curator catalogued seventeen porcelain teapots while several patient volunteers carefully wrapped painted saucers downstairs yesterday evening."
    rest = ["Their insurer requested photographs before each delivery.", "Heavy crates blocked both museum corridors overnight.", "Nobody remembered where those missing labels went."]
    index = build_index([1], [" ".join([first, *rest])])
    spread_out = f"{first} {FILLER}{rest[0].replace('photographs', 'drawings')} {FILLER}{rest[1].replace('corridors', 'doors')} "
    assert find_in(index, [spread_out]) == [(0, 0)]
    assert find_in(index, [first + " " + FILLER * 100 + spread_out + FILLER * 5]) == [(0, 0)]
    assert find_in(index, [first + " " + FILLER * 100 + rest[0] + " "]) == []


@pytest.mark.parametrize(
    "passage, other",
    [
        ("Старый мост стоял над рекой. Каждое утро рыбаки несли сети домой. Никто не слышал звона колоколов.", "Зимой дети катались на льду. "),
        ("낡은 다리가 강 위에 서 있었다. 어부들은 아침마다 그물을 집으로 가져갔다. 아무도 종소리를 듣지 못했다.", "겨울에는 아이들이 얼음을 탔다. "),
        ("Η παλιά γέφυρα στεκόταν πάνω από το ποτάμι. Κάθε πρωί οι ψαράδες έφερναν τα δίχτυα. Κανείς δεν άκουσε την καμπάνα.", "Τον χειμώνα έπαιζαν στον πάγο. "),
        ("สะพานเก่าตั้งอยู่เหนือแม่น้ำ. ชาวประมงนำแหกลับบ้านทุกเช้า. ไม่มีใครได้ยินเสียงระฆัง.", "ฤดูหนาวเด็กเล่นบนน้ำแข็ง. "),
    ],
)
def test_any_script(passage, other):
    index = build_index([1], [passage])
    assert find_in(index, [other * 3 + passage.upper() + other, other * 9]) == [(0, 0)]


def test_long_tags_links_and_repeats_in_one_document():
    index = build_index([1], [EN])
    tag, link = f'<a title="{"x " * 400}">', f"](https://a.example/{'y' * 900})"
    assert find_in(index, [embed(EN.replace("kitchen", f"{tag}kitchen</a>").replace("network", f"[network{link}"))]) == [(0, 0)]
    assert find_in(index, [(EN_PARTS[0] + ". ") * 5000]) == []


@pytest.mark.parametrize("kind, value", [("double", 1.5), ("date", "2024-01-01"), ("binary", bytearray(b"k"))])
def test_any_item_key(spark, kind, value):
    items = spark.createDataFrame([(EN,)], "passage string").selectExpr(f"CAST({value!r} AS {kind}) AS item_id" if kind != "binary" else "CAST('k' AS binary) AS item_id", "passage")
    docs = spark.createDataFrame([(1, embed(EN))], "doc_id long, text string")
    (row,) = leaked_items(docs, "doc_id", "text", items, "item_id", "passage").collect()
    assert row["doc_id"] == 1 and (bytes(row["item_id"]) == bytes(value) if kind == "binary" else str(row["item_id"]) == str(value))
