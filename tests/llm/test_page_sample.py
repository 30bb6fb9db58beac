"""The sample that page extraction learns from, on tables with failed fetches and repeated pages."""

from saidso.llm import html_extraction as X

PAGE = "<body><nav><a href=/>menu</a></nav><article><h1>Title {0}</h1><p>Words of the text number {0}, as always, and a few more.</p></article><footer>foot of page</footer></body>"
PAGES = "page_id long, url string, html string"


def test_failed_fetches_do_not_fill_the_sample(spark):
    good = [(i, f"http://a.com/{i}", PAGE.format(i)) for i in range(30)]
    bad = [(1000 + i, None, None) for i in range(400)]
    texts = {r.page_id: r.text for r in X.extract_text(spark.createDataFrame(good + bad, PAGES)).collect()}
    assert len(texts) == 430 and all(f"number {i}," in texts[i] and "menu" not in texts[i] for i in range(30))
    assert {texts[1000 + i] for i in range(400)} == {""}


def test_repeated_pages_count_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(X, "train", lambda pages: seen.extend(pages))
    rows = [(i, None, PAGE.format("one")) for i in range(400)] + [(1000 + i, f"http://a.com/{i}", PAGE.format(i)) for i in range(20)]
    X.fit(spark.createDataFrame(rows, PAGES))
    assert sorted(seen) == sorted([PAGE.format("one"), *(PAGE.format(i) for i in range(20))])


def test_pages_too_long_to_learn_from_keep_their_text(spark):
    page = PAGE.format("x" * X.LONGEST)
    text = X.extract_text(spark.createDataFrame([(1, "http://a.com/", page)], PAGES)).first().text
    assert text.startswith("Title x") and "menu" not in text and "foot of page" not in text
