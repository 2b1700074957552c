"""Pages of characters: every place of a document against the joined text itself."""

import pytest

from tidemark.operators import places

PAGES = [("d", 1, 10, " \n"), ("d", 2, 11, None), ("d", 3, 12, "  ab c"), ("d", 4, None, ""), ("d", 5, 14, "x" * 70_000), ("d", 6, 15, "end "), ("e", 1, 1, "  "), ("f", 1, 7, "one")]


def plain(doc, separator, at):
    rows = [r for r in PAGES if r[0] == doc]
    joined = separator.join(r[3] or "" for r in rows)
    at += len(joined) - len(joined.lstrip())
    owner = [r[2] for k, r in enumerate(rows) for _ in range(len(r[3] or "") + (len(separator) if k < len(rows) - 1 else 0))]
    return owner[at] if at < len(owner) else None


@pytest.mark.parametrize("separator", ["\n\n", " | ", ""])
def test_every_place_has_the_page_of_the_joined_text(spark, separator):
    pages = spark.createDataFrame(PAGES, "doc string, n int, page int, text string")
    spans = places.page_spans(pages, "doc", "n", "text", separator)
    asked = [(doc, at) for doc in "def" for at in (*range(40), 65_530, 65_535, 65_536, 65_537, *range(69_980, 70_040))]
    got = places.page_at(spark.createDataFrame(asked, "doc string, at long"), spans, "doc", "at", "page")
    assert {(r.doc, r.at): r.page for r in got.collect()} == {(doc, at): plain(doc, separator, at) for doc, at in asked}


def test_odd_offsets(spark):
    pages = spark.createDataFrame(PAGES, "doc string, n int, page int, text string")
    spans = places.page_spans(pages, "doc", "n", "text")
    odd = spark.createDataFrame([("f", None, 5), ("f", -1, 5), ("f", 0, 5), ("f", 0, 5), ("f", 3, 5), ("g", 0, 5), (None, 0, 5)], "doc string, at long, page int")
    assert sorted((str(r.doc), str(r.at), str(r.page)) for r in places.page_at(odd, spans, "doc", "at", "page").collect()) == sorted([("f", "None", "None"), ("f", "-1", "None"), ("f", "0", "7"), ("f", "0", "7"), ("f", "3", "None"), ("g", "0", "None"), ("None", "0", "None")])
    assert places.page_at(odd, spans.where("false"), "doc", "at", "page").where("page is not null").count() == 0
    assert places.page_at(odd.where("false"), spans, "doc", "at", "page").count() == 0
