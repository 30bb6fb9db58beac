"""Pages and labels of awkward shapes."""

import time

import pytest
from saidso.llm import html_extraction as X
from saidso.llm import toxicity


@pytest.mark.parametrize("page", ["<b>" * 170_000 + "</i>" * 130_000, '<a "' * 250_000, "<b>" * 150_000 + "<p>x</p>" * 60_000, "<script>" + "</script " * 110_000, "<ul>" + "<li>" * 250_000, "<!-" * 330_000, "<div>" * 70_000 + "</div>" * 70_000 + "</p>" * 60_000])
def test_a_megabyte_of_odd_markup_is_read_in_linear_time(page):
    began = time.monotonic()
    X.parse(page)
    assert len(page) > 900_000 and time.monotonic() - began < 20


def test_markup_reads_as_before():
    texts = lambda page: [t for _, t in X.parse(page).runs]
    assert texts("a<!-- b > c") == ["a"] and texts("a <!-- b --> c") == ["a c"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul>d") == ["a", "b", "c", "d"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts("<p>a <b>b</p> c") == ["a b", "c"] and texts("x</b></p>y") == ["xy"] and texts("a < b <c") == ["a < b <c"]


def test_a_labelled_id_is_learned_from_once(spark):
    rows = [(1, f"text {i}") for i in range(3000)] + [(i, f"other {i}") for i in range(2, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 200)], "doc_id long, toxic int")
    assert toxicity.labelled(docs, labels, 60).count() <= 60
