"""Main bodies of pages whose boilerplate the table never saw, accuracy on unseen sites with and without line counts, the tree itself, and odd inputs."""

import random

import numpy as np
import pytest

from shirabe.llm.main_body import OWN, SHARE_LEAST, Tree, block_of, common_forms, describe, judge, labelled_table, learn, main_lines

WORDS = "Fluss Brücke Markt Winter Garten Lehrer Hafen Straße Fenster Wald Glocke Mühle Bauer Kahn Deich Turm Acker Laden Wiese Schule".split()
HOW = "leise alt früh kalt ruhig schmal hell langsam nass müde grün schwer".split()
VERBS = "stand blieb lag ging kam wuchs fiel schlief wartete brannte sang trug".split()
START, JOIN = ("Am Morgen", "Später", "Im Dorf", "Seit gestern", "Niemals"), ("und", "aber dann", "während er", "weil sie", "bis es")


def german(i: int) -> tuple[str, set[int]]:
    """A page in a language, on a site and with boilerplate that the labelled table does not know, and the numbers of its main lines."""
    rng = random.Random(i)
    w = lambda _: rng.choice(WORDS)
    text = lambda k: " ".join(f"{rng.choice(START)} {rng.choice(HOW)} {rng.choice(VERBS)} der {rng.choice(HOW)}e {w(k)} {rng.choice(JOIN)} {rng.choice(VERBS)} {rng.choice(HOW)} am {w(k)}." for _ in range(rng.randint(1, 4)))
    lines = [
        ("<html lang=\"de\"><head><title>Zeitung</title></head><body>", 0), ("<ul>", 0), ('<li><a href="/1">Startseite</a></li>', 0), ('<li><a href="/2">Nachrichten</a></li>', 0),
        ('<li><a href="/3">Anmelden</a></li>', 0), ("</ul>", 0), ("<p>Diese Seite verwendet Cookies, um Ihnen den Besuch zu erleichtern.</p>", 0), ("<p>Alle annehmen</p>", 0),
        (f"<h1>Wie {rng.choice(HOW)} der {w(1)} {rng.choice(VERBS)} und {rng.choice(HOW)} {rng.choice(VERBS)}</h1>", 1), *[(f"<p>{text(k)}</p>", 1) for k in range(6)], ("<h2>Verwandte Artikel</h2>", 0),
        *[(f'<a href="/v/{k}">Was {rng.choice(HOW)} am {w(k)} {rng.choice(VERBS)} und {rng.choice(VERBS)}, {rng.choice(HOW)} und {rng.choice(HOW)}</a>', 0) for k in range(4)], ("<p>© Zeitung am Fluss</p>", 0), ('<a href="/5">Impressum</a>', 0), ('<a href="/6">Datenschutz</a>', 0), ("</body></html>", 0),
    ]
    return "\n".join(x for x, _ in lines), {k for k, (_, y) in enumerate(lines) if y}


HTML = german(0)[0]


def frames(spark, pages, log=()):
    p = spark.createDataFrame([(f, b, 1, "clash", 2) for f, b in pages], "filepath string, body string, status int, lines string, _forms int")
    return p, spark.createDataFrame(list(log), "filepath string, status long, body string")


def found(spark, pages, log=()):
    p, c = frames(spark, pages, log)
    return {r["filepath"]: set(r["lines"]) for r in main_lines(p, "filepath", "body", c, "filepath", "status").collect()}


def test_boilerplate_that_was_never_seen(spark):
    pages = {f"p{i}": german(i) for i in range(60)}
    got = found(spark, [(f, b) for f, (b, _) in pages.items()])
    both = sum(len(got.get(f, set()) & want) for f, (_, want) in pages.items())
    assert both / sum(len(want) for _, want in pages.values()) > 0.95
    assert both / sum(map(len, got.values())) > 0.95


def test_status_notation_and_odd_rows(spark):
    pages = [(f"p{i}", german(i)[0]) for i in range(40)]
    pages += [("same", HTML), ("returns", HTML.replace("\n", "\r\n")), ("gone", HTML), ("moved", HTML), ("odd", HTML), ("empty", ""), ("null", None), ("blank", "\n \n<div>\n</div>"), ("twice", HTML), ("twice", HTML)]
    log = [("gone", 404, ""), ("gone", 500, ""), ("moved", 301, ""), ("moved", 200, ""), ("odd", None, ""), (None, 404, "")]
    got = found(spark, pages, log)
    assert got["same"] and got["same"] == got["returns"] == got["moved"] == got["twice"]
    assert not set(got) & {"gone", "odd", "empty", "null", "blank"}


def test_a_page_copied_into_a_third_of_all_rows(spark):
    """Its own lines are on many pages, yet are no template."""
    pages = [(f"p{i}", german(i)[0]) for i in range(60)] + [(f"c{i}", german(7)[0]) for i in range(30)]
    got = found(spark, pages)
    assert len(got["c0"] & german(7)[1]) >= 5 and all(got[f"c{i}"] == got["p7"] for i in range(30))


def test_long_page_is_read_whole(spark):
    got = found(spark, [("long", "".join(f"Sentence {WORDS[k % 20]} {'x' * (k % 97)} says something about rivers and boats in the harbour that we know.\n" for k in range(3000)))])
    assert len(got["long"]) > 2900 and max(got["long"]) > 2900


def test_empty_tables(spark):
    p, c = frames(spark, [("a", HTML)])
    assert main_lines(p.limit(0), "filepath", "body", c, "filepath", "status").count() == 0
    assert common_forms(p.limit(0), "body") == {}


@pytest.mark.parametrize("raw", ["", "  ", "<div>", "</p>", "<title>x</title>", "<script>var a;</script>", "<b></b>", "** **", "&nbsp;"])
def test_markup_alone_is_no_block(raw):
    assert block_of(raw) is None


@pytest.mark.parametrize("shares, least", [(True, 0.98), (False, 0.95)])
def test_unseen_sites(shares, least):
    """Sites held out of the table, with and without knowing how common a line is; no text of any line is known in either case."""
    rows = labelled_table()
    assert set(rows) == {"site", "page", "line", "body", "share", *OWN}
    held = rows["site"] % 4 == 0
    tree = learn({k: v[~held] for k, v in rows.items()}, shares)
    own = np.stack([rows[c][held] for c in OWN], axis=1)
    good = tree.predict(describe(own, rows["line"][held], rows["share"][held] if shares else np.zeros(held.sum()), rows["page"][held]))
    true = rows["body"][held]
    assert (good & true).sum() / good.sum() > least and (good & true).sum() / true.sum() > least


def test_tree_splits_on_words_and_links():
    rows = labelled_table()
    tree = learn(rows, shares=False)
    width = len(OWN) + 1
    near = {width + 2 + 9 * k + j for k in range(4) for j in (0, 1)}  # words and links of the four neighbours
    used = set(tree.feature[tree.feature >= 0].tolist())
    assert 0 in used and len(used & near) >= 3


def test_counts_of_line_forms(spark):
    p, _ = frames(spark, [(f"p{i}", german(i)[0] + f"\nVisitor Number {i}") for i in range(20)])
    got = common_forms(p, "body")
    lines = 20 * len((HTML + "\nx").split("\n"))
    assert any(abs(10**v * SHARE_LEAST - 19 / lines) < 1e-9 for v in got.values())
    assert sum(10**v * SHARE_LEAST * lines for v in got.values()) <= lines


def test_describe_keeps_pages_apart():
    own = np.array([block_of(x) for x in ("One line of text.", '<a href="/x">Home</a>', "Another line of text, longer.")])
    alone = np.concatenate([describe(own, np.arange(3), np.zeros(3), np.zeros(3)) for _ in range(2)])
    together = describe(np.concatenate([own, own]), np.r_[np.arange(3), np.arange(3)], np.zeros(6), np.repeat([0, 1], 3))
    assert np.allclose(alone, together)
    assert judge(learn(labelled_table()), "", []) == []


def test_tree():
    rng = np.random.default_rng(0)
    x = rng.random((500, 3))
    y = (x[:, 0] > 0.5) & (x[:, 2] < 0.3) | (x[:, 1] > 0.9)
    assert (Tree().fit(x[:400], y[:400]).predict(x[400:]) == y[400:]).mean() > 0.9
    assert not Tree().fit(x, np.zeros(500)).predict(x).any()
