import pytest

from pulsespark.llm import op4_html as h

SF = "/root/testdata/sf0.001"
LONG = "A sentence of the article that is long enough to be read as text, and it goes on for a while. "


def test_article_without_surroundings():
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Menu</a></nav><div class='cookie-notice'>Accept</div><article><h1>Head &amp; line</h1><p>{LONG}\n  <b>bold</b></p><script>var a='</p>'</script><p>Short.</p><div class=\"comments\"><p>{LONG}</p></div></article><footer>&copy; me</footer></body></html>"
    assert h.main_text(page) == f"Head & line\n\n{LONG.strip()} bold\n\nShort."


def test_without_article_tags():
    page = "<body><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>" + f"<p>{LONG}</p>" * 3 + "<div class=sidebar>" + LONG + "</div></body>"
    assert h.main_text(page) == "\n\n".join([LONG.strip()] * 3)


def test_advert_inside_an_unmarked_page():
    advert = "<div class=advert><p>Buy one</p><p>Buy two</p><p>Buy three</p></div>"
    page = "<body>" + f"<p>{LONG}</p>" * 10 + advert + f"<p>{LONG}</p>" * 8 + "<ul><li><a href=a>One</a></li></ul></body>"
    assert h.main_text(page) == "\n\n".join([LONG.strip()] * 18)


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<script>", "<div><div>", "&amp", "<a href='x"])
def test_broken_pages(page):
    assert isinstance(h.main_text(page), str)


def test_table(spark):
    rows = [(1, "u", None, "clash"), (2, None, "", "x"), (2, None, f"<article><p>{LONG}</p></article>", "y"), (3, "v", "<p>" + "word " * 200_000 + "</p>", None)]
    got = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got) == [(1, 0), (2, 0), (2, len(LONG) - 1), (3, 999_999)]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert h.extract(empty).count() == 0


def test_query_keeps_every_page(spark):
    got = h.op4_html(spark, SF)
    assert got.columns[:4] == ["page_id", "url", "text", "n_chars"] and got.count() == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert got.where("n_chars > 0").count() > 0.9 * got.count()
    assert got.where("text rlike '<(p|div|article|script|a)[ >]'").count() == 0


def test_names_on_running_text_and_bare_attributes():
    page = "<article><p class='share-price'>Shares rose again.</p><p class='advert'>Buy now</p><a title=don't href=x>more</a> text</article>"
    assert h.main_text(page) == "Shares rose again.\n\nmore text"


def test_hostile_pages_take_linear_time():
    import time

    for piece in ("<div ", '<a href="', "<a x='", "<!--", "<script>", "<", "<p>a", "<a b=c "):
        start = time.time()
        h.main_text(piece * ((1 << 20) // len(piece)))
        assert time.time() - start < 20, piece


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "u", "<p>" + "word " * 40, "mine")] * 2
    got = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string, tag string")).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0]["tag"] == "mine" and got[0]["n_chars"] == len(got[0]["text"])


def test_head_without_an_end_and_hidden_elements_without_one():
    assert h.main_text("<html><head><title>x</title><body><article><p>One.<p>Two.") == "One.\n\nTwo."
    assert h.main_text(f"<head><meta charset=x><p>{LONG}") == LONG.strip()
    assert h.main_text(f"<div><select><option>a</div><p>{LONG}</p><p>End.</p>") == f"{LONG.strip()}\n\nEnd."
    assert h.main_text(f"<div><script>var a = 1;</div><p>{LONG}</p>") == LONG.strip()


def test_first_lines_and_linked_paragraphs_of_an_unmarked_page_stay():
    page = "".join(f"<p>{x}</p>" for x in ("Intro line.", "b", "c", "d", "e", LONG, LONG, "<a href=x>linked words are most of it</a> here"))
    assert h.main_text(page) == "\n\n".join(["Intro line.", "b", "c", "d", "e", LONG.strip(), LONG.strip(), "linked words are most of it here"])


def test_what_names_mark():
    page = f"<article><p>One <span class='advert'>buy <b>this</b> <span>now</span></span> two.</p><div class='side-by-side'>Three.</div><div class='notice-board-story'>Four.</div><div class='cookie-banner'>no</div></article><article class='comment'><p>{LONG}</p></article>"
    assert h.main_text(page) == "One two.\n\nThree.\n\nFour."
    for name, article, marks in (("ad", True, True), ("main-nav", True, True), ("site-header", False, True), ("site-header", True, False), ("menu-planning-guide", True, False), ("related-posts", True, True), ("Sidebar", True, True), ("side", True, True)):
        assert h.is_boiler(name, "div", article) == marks, name


def test_links_after_the_text_end_it():
    links = "<ul>" + "<li><a href=a>More</a></li>" * 4 + "</ul>"
    assert h.main_text(links + f"<p>{LONG}</p><p>Short.</p>" + links + "<div>All rights</div>") == f"{LONG.strip()}\n\nShort."


def plain_span(weight):
    """The same by loops over all windows."""
    sums = [sum(weight[i : i + h.WINDOW]) for i in range(len(weight))]
    enough = min(h.SURGE, max(sums))
    surges = [i for i, s in enumerate(sums) if s >= enough and weight[i]]
    if not surges:
        return 0, 0
    end = next((i for i in range(surges[-1], len(sums)) if not sums[i]), len(weight))
    return next(i for i, w in enumerate(weight) if w), end


def test_spans_as_by_loops_over_windows():
    import random

    import numpy as np

    r = random.Random(0)
    for _ in range(2000):
        weight = [r.choice([0, 0, 5, 30, 90]) for _ in range(r.randrange(1, 14))]
        assert h.text_span(np.array(weight)) == plain_span(weight)


def test_closing_tags_that_nothing_opened_take_linear_time():
    import time

    n = 100_000
    for page in ("<div>" * n + "</p>" * n, "<b>" * n + "<p></p>" * n, "<p><div>" + "<b>" * n + "<p></p>" * n, "<select>" * n, "<span class=ad>" * n, "<head>" * n + "<p>" * n):
        start = time.time()
        h.main_text(page)
        assert time.time() - start < 10, page[:20]
