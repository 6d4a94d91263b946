"""Block rules of the HTML extraction."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from peneira.llm import html_extract as H

STORY = "This is the story of the town and of the people in it, as it was told to them. "


def test_each_rule_decides_blocks(spark, sf_dir):
    """Densities and neighbours decide most blocks of the generated pages, elements the rest."""
    why = Counter()
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect():
        why.update(rule for _, rule in H.decide(H.blocks(r.html or "")))
    assert all(why[x] for x in ("stop words", "links", "neighbour", "frame element"))
    assert why["frame element"] + why["article"] < 0.2 * why.total()


PLAIN = f"""<html><body><div><a href=/a>Home</a> <a href=/b>About us</a> <a href=/c>Contact</a></div>
<div><h1>News of the town</h1><p>{STORY * 3}</p><p>He left.</p><h2>What came next</h2><p>{STORY * 2}</p></div>
<div><p><a href=/x>More of this</a></p><p><a href=/y>And of that</a></p><p>Partners</p><p><a href=/z>Elsewhere on this site</a></p></div>
<div><p>{"lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod " * 4}</p></div></body></html>"""


def test_golden_without_articles_or_names():
    found = H.blocks(PLAIN)
    assert not any(b.article or b.outer for b in found)
    text = H.main_text(PLAIN).split("\n\n")
    assert text[:2] == ["News of the town", (STORY * 3).strip()] and "He left." in text and "What came next" in text
    assert not any(x.startswith(("Home", "More", "And of", "Partners", "Elsewhere")) for x in text)


def test_short_paragraphs_are_judged_together():
    page = "<nav><a href=/>Start</a></nav><section>" + "<p>It is of the town.</p><p>And so it was.</p>" * 6 + "</section>"
    assert H.main_text(page).count("town") == 6 and "Start" not in H.main_text(page)
    junk = "<div>" + "<p>alpha beta gamma</p><p>delta epsilon zeta</p>" * 8 + f"</div><article><p>{STORY * 3}</p></article>"
    assert H.main_text(junk) == (STORY * 3).strip()


def test_notice_and_comments_go_by_their_element():
    page = f"<main><h1>Title</h1><p>{STORY * 3}</p></main><div class=comments><p>{STORY * 3}</p></div><div id=cookie-notice>{STORY * 4}</div>"
    assert H.main_text(page) == "Title\n\n" + (STORY * 3).strip()


@pytest.mark.parametrize("name", sorted(H.OUTER_NAMES - H.COMMENT_NAMES) + ["post legal", "news-alert"])
def test_names_do_not_overrule_densities(name):
    prose = (STORY * 3).strip()
    frame = f"<nav><a href=/>Start</a></nav><div class=cookie><p>{STORY * 2}</p></div>"
    for tag in ("article", "main"):
        assert H.main_text(f'{frame}<{tag} class="{name}"><p>{prose}</p></{tag}>') == prose
    # all dense text is in named elements: that with most of it is the page's
    assert H.main_text(f'<nav><a href=/>Start</a></nav><div class="{name}"><p>{prose}</p></div><div class=cookie><p>{STORY}</p></div>') == prose


def test_comments_stay_comments():
    prose, said = (STORY * 2).strip(), (STORY * 6).strip()
    for page in (f"<article><p>{prose}</p><article class=comment><p>{said}</p></article></article>", f"<main><p>{prose}</p></main><div id=comments><article><p>{said}</p></article></div>", f"<div><p>{prose}</p></div><ul class=commentlist><li>{said}</li></ul>"):
        assert H.main_text(page) == prose


def test_references():
    assert H.main_text("<p>&#00000000000065;&#x000000041; &#99999999999; &#" + "1" * 6000 + "; &lt;b&gt; &amp;amp;</p>") == "AA � � <b> &amp;"


@pytest.mark.parametrize(
    "unit,end",
    [("<a ", "'"), ("<b>", "</i>"), ("<i><div>", "</i>"), ("<head><body>", ""), ("<a href='", ""), ("<title></title ", ""), ("<p>a", ""), ("<", ""), ("<a b=", "'"), ('a="', ">"), ("<li><p>", ""), ("</p>", ""), ("<!--", ""), ("&#1", ""), ("<table><tr><td>", ""), ("<a x        ", "")],
)
def test_time_in_proportion(unit, end):
    """Sixteen times the page takes no more than some sixteen times the time."""

    def took(n):
        page = unit * (n // len(unit)) + end * (n // len(unit) if len(end) > 1 else 1)
        began = time.perf_counter()
        H.main_text(page)
        return time.perf_counter() - began

    small = min(took(1 << 15) for _ in range(3))
    assert took(1 << 19) < 48 * max(small, 0.002)


def test_tables(spark):
    kind = "page_id long, url string, html string, text int, n_chars string"
    assert H.extract(spark.createDataFrame([], kind)).collect() == []
    rows = [(1, None, None, 5, "x"), (None, "u", "<p>a b c</p>", None, None), (2, "u", "", 1, "")]
    got = sorted(H.extract(spark.createDataFrame(rows, kind)).collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(1, None, "", 0), (None, "u", "a b c", 5), (2, "u", "", 0)], key=str)
    assert H.extract(spark.createDataFrame(rows * 3, kind)).agg(F.count("*")).first()[0] == 9
