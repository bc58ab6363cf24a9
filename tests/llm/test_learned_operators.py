"""Operators that learn or choose: held-out accuracy, round trips, and odd tables."""

import textwrap
import zlib
from collections import defaultdict
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import html_text, language, licenses, packing, quality, queries, rules
from tablewright.llm.batches import held_out

from . import brute
from .conftest import SF, rows_of

MORE = "/root/testdata/sf0.01"


def labels_of(spark, sf, *columns):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}


# quality


def test_quality_on_held_out_rows(spark):
    found = queries.op2_quality(spark, MORE).collect()
    labels = labels_of(spark, MORE)
    assert len(found) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert all(r["held_out"] == (brute.crc_fold(r["doc_id"]) == 0) for r in found)
    good = [r["score"] for r in found if r["held_out"] and r["doc_id"] in labels and labels[r["doc_id"]]["quality"] == 1]
    bad = [r["score"] for r in found if r["held_out"] and r["doc_id"] in labels and labels[r["doc_id"]]["quality"] == 0]
    ranked = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert ranked > 0.97
    right = sum(g >= 0.3 for g in good) + sum(b < 0.3 for b in bad)
    assert right >= 0.93 * (len(good) + len(bad))


def test_prior_and_risk_on_made_samples():
    picked = np.random.default_rng(1)
    good, bad = picked.normal(2, 1, (3000, 3)), picked.normal(-2, 1, (900, 3))
    mixed = np.vstack([picked.normal(2, 1, (2100, 3)), bad])
    model = quality.fit(["a", "b", "c"], good, mixed)
    assert 0.6 < model.prior < 0.8
    scored = 1 / (1 + np.exp(-quality._features(np.vstack([good, bad]), model.means, model.scales) @ model.weights))
    assert (scored[:3000] > 0.3).mean() > 0.98 and (scored[3000:] < 0.3).mean() > 0.95


def test_quality_never_reads_labels_of_fold_0(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.score(docs, labels)[0], quality.score(docs, turned)[0]
    assert rows_of(a, "doc_id", "score") == rows_of(b, "doc_id", "score")


def test_quality_takes_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (5, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    found = quality.score(odd, labels)[0]
    assert found.count() == odd.count()
    assert {r["score"] for r in found.filter("doc_id in (0, 1, 2)").collect()} == {0.0}
    assert quality.score(odd, labels.filter("false"))[1].prior == 0.5
    assert quality.score(empty, labels)[0].count() == 0


# rules


def test_rules_on_held_out_rows(spark):
    found = queries.op7_rules(spark, MORE).collect()
    labels = labels_of(spark, MORE)
    judged = [(r["kept"], labels[r["doc_id"]]["quality"]) for r in found if r["doc_id"] in labels and not r["base_failed"] and brute.crc_fold(r["doc_id"]) == 0]
    assert sum(k == bool(q) for k, q in judged) >= 0.95 * len(judged)
    assert not any(r["kept"] for r in found if r["base_failed"])
    assert all((r["rule"] is not None) == (not r["kept"]) for r in found if not r["base_failed"])


def test_rules_are_found_in_order_and_agree_with_their_expression(spark):
    picked = np.random.default_rng(2)
    n = 4000
    values = {k: picked.random(n) for k in ("symbols", "upper", "distinct")}
    bad = (values["symbols"] > 0.9) | (values["upper"] > 0.8) & (values["distinct"] < 0.3)
    learned = rules.learn(values, bad)
    hit = np.zeros(n, bool)
    for r in learned:
        hit |= r.holds(values)
    assert 2 <= len(learned) <= 6 and (hit == bad).mean() > 0.98
    df = spark.createDataFrame([tuple(float(values[k][i]) for k in values) for i in range(200)], ", ".join(f"{k} double" for k in values))
    kept = df.select(rules.verdict(learned, {k: F.col(k) for k in values}).alias("kept")).collect()
    assert [r["kept"] for r in kept] == [not h for h in hit[:200]]
    assert all(">=" in str(r) or "<=" in str(r) for r in learned)


def test_rules_without_labels_of_both_kinds(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (None, 0)], "doc_id long, quality int")
    found, learned = rules.judge(odd, labels)
    assert learned == [] and found.count() == odd.count()
    assert found.filter("kept = base_failed").count() == 0
    assert rules.judge(empty, labels)[0].count() == 0


# language


def test_language_on_held_out_rows(spark):
    found = queries.op6_language(spark, MORE).collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "lang").collect()}
    judged = [r["lang_pred"] == langs[r["doc_id"]] for r in found if r["held_out"]]
    assert len(found) == 1000 and sum(judged) >= 0.97 * len(judged)
    assert sum(not r["accepted"] for r in found) <= 20 and all(0 <= r["score"] <= 1 for r in found)


def test_language_takes_odd_tables(odd, documents, empty):
    known = documents(*[(k, "the cat sat on the mat and the dog ran " * 5, "en") for k in range(20)], *[(100 + k, "der hund und die katze sind im haus " * 5, "de") for k in range(20)])
    languages = language.fit(known, F.lit(True))
    assert languages.names == ["de", "en"]
    found, names = language.predict(odd, languages)
    assert found.count() == odd.count()
    predicted = {r["doc_id"]: r for r in found.collect()}
    for k in (0, 1, 2, 4, 8):
        assert (predicted[k][names["lang_pred"]], predicted[k][names["score"]], predicted[k][names["accepted"]]) == ("und", 0.0, False)
    assert predicted[7][names["lang_pred"]] in ("de", "en")
    nothing = language.fit(empty, F.lit(True))
    assert nothing.names == [] and language.predict(known, nothing)[0].filter(F.col("__lang_pred") != "und").count() == 0
    assert language.keep_identified(known).columns == known.columns
    assert language.keep_identified(empty).count() == 0


# packing


def check_round_trip(docs, pieces, length):
    """docs: {id: [ids bytes]}; every id once, sequences gapless, digests right."""
    by_doc, by_sequence = defaultdict(dict), defaultdict(list)
    for r in pieces:
        assert r["length"] > 0 and zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        assert r["start"] not in by_doc[r["doc_id"]]
        by_doc[r["doc_id"]][r["start"]] = r["ids"]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, ids in docs.items():
        assert b"".join(by_doc[doc][k] for k in sorted(by_doc[doc])) == ids
    for found in by_sequence.values():
        at = 0
        for offset, size in sorted(found):
            assert offset == at
            at += size
        assert at <= length
    return {k: sum(s for _, s in v) for k, v in by_sequence.items()}


def test_packing_of_the_test_tables(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    end = np.array([1], "<u4").tobytes()
    want = {r["doc_id"]: np.array(tokenizer.encode(r["text"], add_special_tokens=False).ids, "<u4").tobytes() + end for r in docs.collect()}
    pieces = packing.pack(docs, with_ids=True).collect()
    filled = check_round_trip(want, pieces, 2048)
    assert all(r["doc_tokens"] == len(want[r["doc_id"]]) // 4 for r in pieces)
    assert sum(n < 2048 for n in filled.values()) <= 1
    assert "ids" not in queries.op8_packing(spark, SF).columns


@pytest.mark.parametrize("text", ["", " ", "a  b\n\n c\t\td \n", "x<|endoftext|>y", "z　 w!\x1c!", "it's 12 3's  'll", "a\r\nb  c", "᠎ q", "\U0001f600 é́ 한국어", " " * 200_000, "\n \t" * 1_000, "a" * 100_000])
def test_encoder_agrees_with_the_tokenizer(text):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert packing.Encoder(path).ids(text) == np.array(want, "<u4").tobytes()


def test_packer_places_by_the_sum_of_squares():
    picked = np.random.default_rng(4)
    packer = packing.Packer(length=64, open_most=10_000)
    for size in picked.integers(1, 64, 800).tolist():
        counts = packer.counts.copy()
        levels = [h for h in range(64 - size + 1) if h == 0 or counts[h]]

        def after(h, counts=counts, size=size):
            c = counts.copy()
            if h:
                c[h] -= 1
            if h + size < 64:
                c[h + size] += 1
            return int((c[1:64] ** 2).sum())

        assert after(packer.level_for(size)) == min(map(after, levels))
        list(packer.add(0, 0, bytes(4 * size), size))


def test_packer_closes_what_is_open_without_gaps():
    packer, out = packing.Packer(length=16, open_most=5), []
    docs = {k: bytes([k]) * 4 * n for k, n in enumerate([9, 9, 9, 9, 9, 9, 15, 1, 3, 3, 16 - 9])}
    for k, ids in docs.items():
        out += packer.add(k, 0, ids, len(ids) // 4)
    out += packer.close()
    sizes = [sum(len(p[2]) for p in s) // 4 for s in out]
    assert sum(sizes) == sum(len(d) // 4 for d in docs.values()) and sum(n < 16 for n in sizes) <= 2
    back = {k: b"".join(p[2] for p in sorted((p for s in out for p in s if p[0] == k), key=lambda p: p[1])) for k in docs}
    assert back == docs


def test_packing_takes_odd_tables(odd, empty):
    pieces = packing.pack(odd, with_ids=True).collect()
    total = defaultdict(int)
    for r in pieces:
        total[r["doc_id"]] += r["length"]
    assert total[0] == total[1] == 2 and total[None] > 1  # end ids alone, of two rows each
    assert packing.pack(empty).count() == 0


# page text

ARTICLE = "<h1>A headline</h1><p>First <b>bold</b>ly&amp;  said.<p>Second&nbsp;one,<br>broken <a href=x>link</a>.</p><ul><li>item<li>item two</ul>"
TEXT = "A headline First boldly& said. Second one, broken link. item item two"


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script>{head}</head><body>{body}</body></html>"


NOISE = [
    "<nav><ul><li><a href=/>home</a></li></ul></nav>",
    "<header>Site name</header>",
    "<div class='ad'>Buy this now and never think of it again, it is good for you.</div>",
    "<div id='comments'><p>What a long and winding comment this reader has left here for us all to read.</p></div>",
    "<aside><p>Read this other thing, which is also very long and has many words in it.</p></aside>",
    "<form><label>Name</label><input><button>Send</button></form>",
    "<div class='cookie-notice'>We use cookies.</div>",
    "<footer>&copy; 2024 example</footer>",
    "<!-- a <p>comment</p> -->",
    "<script>document.write('<p>x</p>')</script>",
    "<noscript>Turn it on</noscript>",
]


def test_article_without_its_surroundings():
    inside = ARTICLE.replace("<p>Second", NOISE[2] + NOISE[3] + NOISE[9] + "<p>Second")
    html = page("".join(NOISE[:3]) + f"<article>{inside}</article>" + "".join(NOISE[3:]))
    assert html_text.main_text(html) == TEXT


def test_densest_subtree_without_an_article_element():
    paragraphs = "".join(f"<p>{'Many words of some length stand in this paragraph. ' * 4}</p>" for _ in range(4))
    links = "<div><ul>" + "".join(f"<li><a href=/{k}>link {k}</a></li>" for k in range(20)) + "</ul></div>"
    html = page(f"{links}<div><div>{paragraphs}</div></div><div><span>small</span> <a href=x>print</a></div>")
    assert html_text.main_text(html) == " ".join(["Many words of some length stand in this paragraph."] * 16)


@pytest.mark.parametrize("html", [None, "", " ", "<", "<p", "<html>", "<body></body>", "</div>" * 10, "<!--", "<script>", "<nav>x</nav>", "&amp", "<a href='"])
def test_pages_without_text(html):
    assert isinstance(html_text.main_text(html), str)
    if html != "&amp":
        assert html_text.main_text(html).strip("<pahref='= ") == ""


@pytest.mark.parametrize(
    "before",
    ["<script>var s='<!--';</script>", "<script><!--\nx()</script>", "<style><!-- p{}</style>", "<textarea><!--</textarea>", "<i title='<!--'></i>", "<!-- a --!>", "<!-->", "<title>a <!-- b</title>"],
)
def test_comment_marks_that_open_no_comment(before):
    assert html_text.main_text(f"{before}<article>{ARTICLE}</article>") == TEXT


@pytest.mark.parametrize("wrapper", ["div class='content-with-sidebar'", "section class='no-ads nav-open'", "div id='widget-area'", "form"])
def test_article_inside_a_marked_block(wrapper):
    closing = wrapper.split()[0]
    inner = "".join(NOISE[:3]) + f"<article>{ARTICLE}</article>" + NOISE[-4]
    assert html_text.main_text(page(f"<{wrapper}>{inner}</{closing}>")) == TEXT
    assert html_text.main_text(page(f"<{wrapper}><div>{ARTICLE}</div>{NOISE[0]}</{closing}>")) == TEXT


def test_long_comments_stay_out():
    comments = f"<div class='comments'>{'<p>A comment with a good number of words in it.</p>' * 8}</div>"
    assert html_text.main_text(page(f"<article>{ARTICLE}</article>{comments}")) == TEXT


def test_parts_and_headline_of_one_main():
    parts = [f"<article>{'<p>Part %d has many words of some length.</p>' % k * 5}</article>" for k in (1, 2)]
    html = page(f"<main><h1>Title</h1>{''.join(parts)}<div><a href=a>more</a> <a href=b>less</a></div></main>")
    assert html_text.main_text(html) == " ".join(["Title", *["Part 1 has many words of some length."] * 5, *["Part 2 has many words of some length."] * 5])


def test_text_directly_on_the_path():
    words = "Many words of some length stand in this paragraph. " * 4
    html = page(f"<div>Opening <b>wor</b>ds.<div><p>{words}</p><p>{words}</p></div>Closing <a href=x>li</a> words.</div>")
    assert html_text.main_text(html) == f"Opening words. {words}{words}Closing li words."


def test_an_open_comment_reaches_to_the_end():
    assert html_text.main_text(f"<article>{ARTICLE}<!-- <p>gone</p></article>") == TEXT


def test_plain_text_and_deep_pages():
    assert html_text.main_text("just  text") == "just text"
    deep = "<div>" * 20_000 + "deep words" + "</div>" * 20_000
    assert html_text.main_text(deep) == "deep words"


def test_pages_of_the_test_tables(spark):
    import html as entities
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op10_html(spark, SF).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S).group(1)
        inner = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inner))
        assert r["text"] == " ".join(entities.unescape(inner).split()) and r["n_chars"] == len(r["text"])


# licences


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def test_notices_against_plain_comparison(spark, documents):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "licensed under the apache license version 2", "All rights reserved", "rights reserved",
        "prose\nReleased under the MIT License!\nmore prose", "Permission is\nhereby granted, free of charge", "a a a a a a a a", None, "",
        *[t for t in licenses.TEMPLATES.values()], "\n".join(licenses.TEMPLATES["MIT-grant"].split(", ")),
    ]
    found = {r["doc_id"]: r for r in licenses.scan(documents(*enumerate(texts))).collect()}
    sets = {n: set(licenses.bigrams_of(t)) for n, t in licenses.TEMPLATES.items()}
    for k, text in enumerate(texts):
        lines = (text or "").split("\n")
        units = lines + ([text] if len(lines) > 1 else [])
        shown = [[(dice(set(licenses.bigrams_of(u)), s), n) for n, s in sets.items() if dice(set(licenses.bigrams_of(u)), s) >= 0.8] for u in units]
        rival = lambda a, b: a != b and dice(sets[a], sets[b]) >= 0.5
        shown = [[x for x in u if not any(rival(x[1], o[1]) and (-o[0], o[1]) < (-x[0], x[1]) for o in u)] for u in shown]
        flat = [x for u in shown for x in u]
        best = min(((-d, n) for d, n in flat), default=(None, None))
        r = found[k]
        assert (r["n_lines"], r["n_notices"]) == (len(lines), sum(map(bool, shown)))
        assert r["licenses"] == ",".join(sorted({n for _, n in flat})) and r["best_license"] == best[1]
        assert r["best_dice"] == (None if best[0] is None else pytest.approx(-best[0]))


def test_notices_over_several_lines_and_inside_a_line(documents):
    grant, terms, gpl = (licenses.TEMPLATES[n] for n in ("MIT-grant", "MIT-terms", "GPL-3.0-notice"))
    wrap = lambda text, mark="": "\n".join(mark + line for line in textwrap.wrap(text, 60))
    mit = "MIT License\n\nCopyright (c) 2024 Somebody\n\n" + wrap(grant) + "\n\n" + wrap(terms) + "\n\nIN NO EVENT SHALL THE AUTHORS BE LIABLE."
    code = "\n".join(f"value_{k} = compute(value_{k - 1}) + offset[{k}]" for k in range(40))
    sentence = "Some story of an old house by the sea. Released under the MIT License. More text follows here, and it goes on."
    texts = [mit, "import os\n" + wrap(gpl, "# ") + "\n" + code, sentence, f"{code} {sentence} {sentence}\n{grant} {code}", "the license of the software " * 300, grant]
    found = {r["doc_id"]: r for r in licenses.scan(documents(*enumerate(texts))).collect()}
    shown = [(found[k]["n_notices"], found[k]["licenses"]) for k in range(len(texts))]
    assert shown == [(2, "MIT-grant,MIT-terms"), (1, "GPL-3.0-notice"), (1, "MIT"), (3, "MIT,MIT-grant"), (0, ""), (1, "MIT-grant")]
    assert [found[k]["best_dice"] for k in (0, 2)] == [1.0, 1.0]


def test_neighbouring_licences_are_told_apart(documents):
    wrap = lambda text: "\n".join(" * " + line for line in textwrap.wrap(text, 58))
    names = [n for n in licenses.TEMPLATES if "GPL" in n and "notice" in n or n in ("0BSD", "ISC", "Zlib", "Unlicense", "EPL-2.0", "CC0-1.0", "BSL-1.0")]
    forms = [lambda t: t, lambda t: "/*\n" + wrap(t) + "\n */\nint main() {}\n", lambda t: f"A story begins. {t} And it goes on from there.\nMore."]
    texts = [form(licenses.TEMPLATES[n]) for n in names for form in forms]
    found = {r["doc_id"]: r for r in licenses.scan(documents(*enumerate(texts))).collect()}
    assert [(found[k]["licenses"], found[k]["best_license"]) for k in found] == [(names[k // 3],) * 2 for k in found]
    lesser = licenses.TEMPLATES["LGPL-2.1-notice"].replace("This library", "This program")
    [r] = licenses.scan(documents((1, lesser))).collect()
    assert (r["licenses"], r["n_notices"]) == ("LGPL-2.1-notice", 1)


def test_many_licence_templates(documents):
    many = {f"licence {k}": f"the {k} licence of {k + 1} and {k * 7} grants rights" for k in range(200)}
    [r] = licenses.scan(documents((1, f"prose\n{many['licence 77']}\nprose")), templates=many).collect()
    assert r["best_license"] == "licence 77" and r["best_dice"] == 1.0


def test_licences_run_without_python(spark):
    plan = queries.op3_licenses(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Exchange", "Join"))


def test_licences_take_odd_tables(odd, empty):
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(odd, templates={str(k): "a b" for k in range(1001)})


def test_sorted_names_and_sql_agree(spark):
    names = [k for k, _ in groupby(sorted(queries.QUERIES))]
    assert len(names) == 13 and set(queries.SQL) <= set(names)
