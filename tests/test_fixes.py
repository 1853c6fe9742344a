"""Section overflow, selectors, deep pages, and tables that are written and compacted at one time."""

import pytest

from shirabe.operators import convert as C
from shirabe.operators.chunkers import heading_chunks
from shirabe.operators.html_markdown import convert, matching, parse, selector
from shirabe.sources.tables import Busy, SegmentedTable, VersionedTable, file_system


def test_a_chunk_opened_by_an_overflow_counts_without_its_divider():
    text = "# H\n\n" + "\n\n".join("x" * n for n in (15, 10, 8))
    assert [c[3] for c in heading_chunks(text, 20, 0)] == ["x" * 15, "x" * 10 + "\n\n" + "x" * 8]
    assert [c[3] for c in heading_chunks("\n\n".join("y" * n for n in (10, 8, 7)), 20, 0)] == ["y" * 10, "y" * 8 + "\n\n" + "y" * 7]


def test_deep_pages_keep_their_text():
    assert convert("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"
    assert "deep" in convert("<main>" + "<ul><li>" * 1500 + "deep" + "</li></ul>" * 1500 + "</main>")


PAGE = '<body><div class="maintxt"><p class=empty></p><div class="Entry-Content big" id=e data-k="a-b"><p>one</p><span><p>two</p></span></div></div><p>three</p></body>'


@pytest.mark.parametrize(
    "text, want",
    [
        (".maintxt .entry-content", ["onetwo"]), (".maintxt > p", [""]), ("div.big#e p", ["one", "two"]), ("div.big > p", ["one"]), ("[data-k]", ["onetwo"]), ('div[data-k|="a"] > span p', ["two"]),
        ("p", ["", "one", "two", "three"]), ("span p, body > p", ["two", "three"]), ("*[data-k$='b']", ["onetwo"]), ("section", []), ("div div div", []),
    ],
)
def test_selectors(text, want):
    assert [n.text() for n in matching(parse(PAGE), text)] == want


@pytest.mark.parametrize("text", ["", "> p", "p:first-child", "p +", "[a", "a,,b", ".", "p!"])
def test_unreadable_selectors(text):
    with pytest.raises(ValueError):
        selector(text)
    with pytest.raises(ValueError):
        C.site_rules(f'["h"]\ncontent = ["{text}"]')


def test_empty_elements_are_passed_over():
    assert convert(PAGE, [".empty", ".entry-content"]) == "one\n\ntwo"
    assert convert(PAGE, [".maintxt"], ["span p"]) == "one"


def test_batches_and_compaction_keep_out_of_each_other(spark, tmp_path):
    t = SegmentedTable(spark, str(tmp_path / "t"))
    rows = lambda *r: spark.createDataFrame(list(r), "source_id string, n int")
    t.write_batch(0, rows(("a", 1), ("b", 2)), rows(("a", 0), ("b", 0)))
    fs, path = file_system(spark, t.path)
    fs.create(path(f"{t.path}/_compacting"), True).close()
    with pytest.raises(Busy):
        t.write_batch(1, rows(("a", 5)), rows(("a", 0)))
    fs.delete(path(f"{t.path}/_compacting"), False)
    fs.create(path(f"{t.path}/_writing/1"), True).close()
    with pytest.raises(Busy):
        t.compact(1)
    t.write_batch(1, rows(("a", 5)), rows(("a", 0)))
    t.compact(2)
    t.delete_owners(3, rows(("b", 0)))
    assert [tuple(r) for r in t.read().select("source_id", "n").collect()] == [("a", 5)]
    t.clear()
    assert t.read() is None


def test_the_greatest_of_repeated_keys_counts(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "v"))
    for order in (1, -1):
        t.upsert(spark.createDataFrame([("k", 1, "x"), ("k", 2, "a"), ("l", None, None)][::order], "id string, n int, s string"), "id")
        assert {tuple(r) for r in t.read().collect()} == {("k", 2, "a"), ("l", None, None)}
