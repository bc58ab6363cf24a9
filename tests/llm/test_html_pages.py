"""Pages on which class words, nesting or depth mislead, and a plain slow tree walk."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tablewright.llm import html_text
from tablewright.llm.html_text import main_text

TEXT = "Words of an article that go on for a while, so that there is something to read in it. " * 3


def test_sections_with_doubtful_names_stay():
    page = f"""<body><nav><a href=x>menu</a></nav><article><h1 id='search'>Search in graphs</h1><p>{TEXT}</p>
        <section id='related-work'><h2>Related work</h2><p>{TEXT}</p></section>
        <section id='discussion'><h2>Discussion</h2><p>{TEXT}</p></section>
        <h2 id='legal'>Law</h2><p class='notice'>A short note.</p>
        <p>They <span class='share'>share</span> a border.</p></article></body>"""
    found = main_text(page)
    for wanted in ("Search in graphs", "Related work", "Discussion", "Law", "A short note.", "They share a border."):
        assert wanted in found
    assert "menu" not in found and found.count("Words of an article") == 9


def test_doubtful_blocks_of_links_go():
    links = "".join(f"<a href=x>Another story {k}</a> " for k in range(9))
    page = f"<article><p>{TEXT}</p><div class='related'>{links}</div><div class='share'>Share this</div></article><div class=notice>{TEXT}</div>"
    assert main_text(page) == " ".join(TEXT.split())


def test_reader_comments_go():
    outer = f"<p>{TEXT}</p><p>{TEXT}</p>"
    want = " ".join((TEXT + TEXT).split())
    assert main_text(f"<article>{outer}<section><article class='comment'><p>I like it</p></article></section></article>") == want
    assert main_text(f"<article>{outer}<article><p>A reader: {TEXT}</p></article><article><p>Me too</p></article></article>") == want
    assert main_text(f"<main><article>{outer}</article><article class='comment'><p>I like it. {TEXT}</p></article></main>") == want


def test_teasers_go_and_further_parts_stay():
    page = f"<main><article><p>{TEXT}</p></article><article class='teaser'><a href=x>Read this next</a></article><article><p>Part two. {TEXT}</p></article></main>"
    found = main_text(page)
    assert "Part two." in found and "Read this next" not in found


def test_headlines_stay():
    body = f"<p>{TEXT}</p>"
    assert main_text(f"<article><header><h1>Title</h1><p>By a person</p><nav>x</nav></header>{body}</article>").startswith("Title Words")
    assert main_text(f"<body><header><h1>Site</h1></header><div class=top><h1>Title</h1></div><div>{body}{body}</div></body>").startswith("Title Words")
    assert "By a person" not in main_text(f"<article><header><h1>Title</h1><p>By a person</p></header>{body}</article>")


def test_hidden_elements_go():
    page = f"<article><p>{TEXT}</p><p style='color:red; display : none'>no</p><p hidden>no</p><p style='visibility:hidden'>no</p></article>"
    assert main_text(page) == " ".join(TEXT.split())


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 20_000 + f"<p>{TEXT}",
        "<div><b>" * 6_000 + "</i>" * 6_000 + f"<p>{TEXT}",
        "<b>" * 20_000 + "</i>" * 20_000 + f"<p>{TEXT}",
        "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000 + f"<p>{TEXT}",
        "<div>" * 20_000 + "</section>" * 20_000 + f"<p>{TEXT}",
        "<div>" * 10_000 + "<option>x</option>" * 10_000 + f"<p>{TEXT}",
        "<ul><li>" * 10_000 + f"<p>{TEXT}",
        "<p>" * 30_000 + TEXT,
        "<article>" * 5_000 + f"<p>{TEXT}",
        "<table><tr><td>" * 5_000 + f"<p>{TEXT}",
        f"<p>{TEXT}" + "<div class=comment>" * 10_000,
    ],
)
def test_deep_pages_take_time_in_proportion(page):
    start = time.process_time()
    found = main_text(page)
    assert time.process_time() - start < 4
    assert "Words of an article" in found or "<article>" in page


class PlainTree:
    """What is open, as a list that is searched from its end for every tag."""

    def __init__(self, page):
        self.stack, self.found = [], []
        for tag in re.findall(r"</?[a-z0-9]+>|[^<]+", page):
            if tag.startswith("</"):
                self.end(tag[2:-1])
            elif tag.startswith("<"):
                self.start(tag[1:-1])
            else:
                self.found.append(("/".join(self.stack), tag))

    def close(self, tags, stops):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k] in stops and self.stack[k] not in tags:
                return
            if self.stack[k] in tags:
                del self.stack[k:]
                return

    def start(self, tag):
        if tag in html_text.CLOSES_P:
            self.close(("p",), ("table", "td", "th", "button", "object"))
        elif tag in html_text.CLOSES:
            self.close(*html_text.CLOSES[tag])
        if tag not in html_text.VOID:
            self.stack.append(tag)

    def end(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k] == tag:
                del self.stack[k:]
                return
            if tag in html_text.INLINE and self.stack[k] not in html_text.INLINE:
                return


@pytest.mark.parametrize("seed", range(60))
def test_tree_as_by_plain_search(seed):
    pick = random.Random(seed)
    tags = "div p b i a ul li table tr td tbody dl dt dd section span br h2".split()
    page = "".join(
        pick.choice((f"<{t}>", f"<{t}>", f"</{t}>", f"w{k} ")) for k, t in enumerate(pick.choices(tags, k=pick.randrange(5, 120)))
    )
    tree = html_text.Tree()
    tree.feed(page)
    tree.close()

    def path(node):
        return f"{path(node.parent)}/{node.tag}" if node.parent.parent is not None else node.tag

    got = [("" if node is tree.root else path(node), item) for node in tree.order for item in node.items if isinstance(item, str)]
    assert sorted(got) == sorted(PlainTree(page).found)


def test_odd_tables_and_clashing_columns(spark):
    pages = [(1, None), (1, None), (2, ""), (3, "<"), (4, "no tags"), (None, f"<p>{TEXT}"), (5, "<div>" * 3_000 + TEXT), (6, "x" * 1_000_000)]
    df = spark.createDataFrame(pages, "page_id long, html string").select("*", *[F.lit("mine").alias(n) for n in ("text", "n_chars", "__text")])
    found, names = html_text.extract(df)
    rows = found.collect()
    assert found.columns[: len(df.columns)] == df.columns and len(rows) == len(pages)
    assert {r["text"] for r in rows} == {"mine"} and all(len(r[names["text"]]) == r[names["n_chars"]] for r in rows)
    lengths = sorted((r["page_id"] or 0, r[names["n_chars"]]) for r in rows)
    assert lengths[0][1] == lengths[6 - 0][1] and (6, 1_000_000) in lengths and (1, 0) in lengths and (4, 7) in lengths
    assert html_text.extract(df.filter("false"))[0].count() == 0
