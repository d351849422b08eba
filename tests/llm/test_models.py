"""Quality, toxicity and main text."""

import time
import tracemalloc
import zlib

import numpy as np
import pandas as pd

from serieslake.llm import common, html_text, quality, queries, toxicity, words
from tables import awkward, documents, found, prose

FOLDER = "/root/testdata/sf0.01"


def test_word_hashes_do_not_depend_on_neighbours():
    texts = [b"One two  TWO", b"", b"two", b"\xc3\xa9 x-y 12"]
    run = words.Words(texts, words.SPACED)
    assert run.bounds.tolist() == [0, 3, 3, 4, 7]
    alone = words.Words([b"two"], words.SPACED)
    assert run.hash[1] == run.hash[2] == run.hash[3] == alone.hash[0]
    marks = words.Words([b"x-y 12!!"], words.LETTERS_OR_MARKS)
    assert marks.kind.tolist() == [1, 2, 1, 1, 2]


def test_quality_on_held_out_labels(spark):
    got = {r["doc_id"]: r for r in queries.op9_quality(spark, FOLDER).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 50 and all(got[i]["held_out"] for i in held)
    assert np.mean([got[i]["predicted"] == labels[i] for i in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_quality_of_awkward_rows(spark):
    train = documents(spark, [(i, "fine words in a row here") for i in range(40)] + [(100 + i, "BAD!!! TEXT!!!") for i in range(40)])
    labels = spark.createDataFrame(
        [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(None, 1), (3, None), (5, 0)], "doc_id long, quality int"
    )
    weights, bias = quality.fit(train, labels)
    got = found(quality.score(documents(spark, awkward(), extra=True), weights, bias))
    assert sum(map(len, got.values())) == len(awkward())
    assert got[1][0]["quality_score"] == got[2][0]["quality_score"] == got[3][0]["quality_score"]
    assert got[7][0]["quality_score"] == got[7][1]["quality_score"] == got[6][0]["quality_score"]
    assert quality.score(documents(spark, []), weights, bias).count() == 0
    weights, bias = quality.fit(train, labels.limit(0))
    assert {r["quality_score"] for r in quality.score(train, weights, bias).collect()} == {0.5}


def test_scores_do_not_depend_on_other_texts_of_a_batch():
    weights = np.random.default_rng(0).standard_normal(quality.SORTS << quality.BITS)
    texts = ["One two two!", "", "!!! ??? A B", "x", "LONG " * 50]
    together = quality._scores(texts, weights, 0.1)
    assert np.allclose(together, [quality._scores([t], weights, 0.1)[0] for t in texts], atol=1e-12)


def test_memory_of_a_fit():
    texts = [prose(i, 400) for i in range(10)]
    rows = [(i, texts[i % 10] + f" {i}", i % 2) for i in range(1500)]
    sample = pd.DataFrame(rows, columns=["doc_id", "text", "label"])
    words.Words([b""], words.SPACED)  # its tables stay, whatever runs
    tracemalloc.start()
    list(quality._fit(iter([sample])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    model = 2 * 8 * (quality.SORTS << quality.BITS)
    assert peak < 3 * model


def test_texts_become_objects_a_slice_at_a_time_and_travel_once(spark):
    docs = documents(spark, [(i, None if i % 7 == 0 else f"text {i}") for i in range(1300)]).coalesce(1)
    made = common.with_columns_of_text(docs, None, "beside int, own string", lambda texts: ([len(texts)] * len(texts), texts))
    rows = made.collect()
    assert len(rows) == 1300 and all(r["own"] == (r["text"] or "") for r in rows)
    assert max(r["beside"] for r in rows) <= common.SLICE
    assert "__text" not in made._jdf.queryExecution().toString()


def test_toxicity_on_labels(spark):
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, FOLDER).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    toxic = [got[i]["toxic"] for i, t in labels.items() if t == 1]
    clean = [got[i]["toxic"] for i, t in labels.items() if t == 0]
    assert np.mean(toxic) >= 0.75 and np.mean(clean) <= 0.03
    assert all((r["grade"] > 0) == r["toxic"] and 0 <= r["severity"] <= 2 for r in got.values())


def test_toxicity_generalises(spark):
    """Trained on two thirds, measured on the rest, at a size with enough toxic texts.

    Texts that were made into junk lost the words that make them toxic, so only good ones count.
    """
    folder = "/root/testdata/sf0.1"
    texts, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(texts, labels.where(~quality.held_out()))
    rest = toxicity.grade(texts, model, ["doc_id"]).join(labels.where(quality.held_out()).withColumnRenamed("toxic", "label"), "doc_id").collect()
    assert np.mean([r["toxic"] for r in rest if r["label"] == 1 and r["quality"] == 1]) >= 0.9
    assert np.mean([r["toxic"] for r in rest if r["label"] == 0]) <= 0.02


def test_toxicity_of_awkward_rows(spark):
    rows = [(i, f"good words number w{i}") for i in range(30)] + [(100 + i, f"you vile{i % 3} thing w{i}" + " vile" * (i % 2)) for i in range(30)]
    labels = spark.createDataFrame([(i, 0) for i in range(30)] + [(100 + i, 1) for i in range(30)], "doc_id long, toxic int")
    model = toxicity.fit(documents(spark, rows), labels)
    assert model.thresholds[0] < model.thresholds[1]
    got = found(toxicity.grade(documents(spark, awkward() + [(11, "vile vile1"), (12, "VILE words vile2")], extra=True), model))
    assert got[11][0]["toxic"] and got[12][0]["toxic"] and not got[1][0]["toxic"] and not got[6][0]["toxic"]
    assert toxicity.fit(documents(spark, rows), labels.where("toxic = 0")) is None
    assert toxicity.grade(documents(spark, rows), None, ["doc_id"]).agg({"severity": "max"}).first()[0] == 0.0


def test_both_thresholds_are_those_of_greatest_likelihood():
    pick = np.random.default_rng(3)
    margins, noise = pick.normal(0, 3, 4000), pick.logistic(size=4000)
    grade = (margins + noise > 1).astype(int) + (margins + noise > 2.5).astype(int)
    low, high = toxicity._thresholds(margins, grade, -3.0, 8.0)
    assert abs(low - 1) < 0.2 and abs(high - 2.5) < 0.25
    best = toxicity.log_likelihood(margins, grade, low, high)
    assert all(best >= toxicity.log_likelihood(margins, grade, low + a, high + b) for a in (-0.05, 0, 0.05) for b in (-0.05, 0, 0.05))


def test_severity_is_that_of_the_model(spark):
    """The decision cut tells which texts are toxic; the severity is the sum of the model's chances."""
    model = toxicity.Model(np.array([], np.int32), np.array([]), 1.0, 2.0, 0.0)
    got = found(toxicity.grade(documents(spark, [(1, "any text"), (2, None)]), model))
    chance = 1 / (1 + np.exp(1.0)) + 1 / (1 + np.exp(2.0))
    assert all(abs(got[i][0]["severity"] - chance) < 1e-12 and got[i][0]["toxic"] and got[i][0]["grade"] == 1 for i in (1, 2))


ARTICLE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><article>no";</script></head>
<body><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div class="cookie-notice"><p>We use cookies, many of them, on all of our pages.</p></div>
<article><h1>Title</h1><p>First &eacute; para&#103;raph<b> is <i>bold</b>.<p>Second   one
with a <a href=x>link</a><div class=ad>Buy this now</div><form><p>Mail</p></form><p>Hi.</article>
<aside><p>Other things that are long enough to look like text in their own right.</p></aside>
<section id="comments"><article class="comment"><p>A reader says a great many things here, longer than the article by far, and goes on and on.</p></article></section>
<footer>&copy; x</footer></body></html>"""


def test_article_without_its_surroundings():
    assert html_text.extract(ARTICLE) == "Title\nFirst é paragraph is bold.\nSecond one with a link\nHi."


def test_deep_pages_take_linear_time():
    page = "<div>" * 100_000 + "<p>Some text that is long enough to be found." + "</span>" * 100_000
    start = time.monotonic()
    assert html_text.extract(page) == "Some text that is long enough to be found."
    assert time.monotonic() - start < 20


def test_density_finds_the_text_without_marks_of_an_article():
    page = (
        "<body><div><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div><div><div><p>A long paragraph of the main text, with many words.</p>"
        "<p>Another long paragraph of the main text, also with words.</p><p>Short.</p></div></div><div><a href=3>more</a> <a href=4>links</a></div>"
    )
    assert html_text.extract(page).split("\n")[-1] == "Short." and "two" not in html_text.extract(page)


def test_named_wrappers_and_forms_around_the_text():
    paragraphs = "".join(f"<p>Paragraph {k} says enough words to be text, and some more of them.</p>" for k in range(4))
    text = html_text.extract(f"<div id=content>{paragraphs}</div>")
    assert text.count("\n") == 3
    links = "<div class=sidebar><p>Side <a href=x>one</a> <a href=y>two</a></p></div>"
    for wrapper in ("div id=content class='content has-sidebar'", "div class='no-comments'", "div class=sidebar-layout", "form action=x"):
        tag = wrapper.split()[0]
        page = f"<body><nav><a href=z>menu</a></nav><{wrapper}>{paragraphs}{links}</{tag}><footer>foot</footer></body>"
        assert html_text.extract(page) == text, wrapper
    half = "<p>A comment, as long as can be.</p>" * 9
    page = f"<article>{paragraphs}</article><div class=comments>{half}</div><form hidden>{half * 9}</form>"
    assert html_text.extract(page) == text
    assert html_text.extract(f"<div>{paragraphs}</div><form style='display:none'>{half * 9}</form><div class=comment>a b</div>") == text
    assert html_text.extract(f"<div class=hasSidebar>{paragraphs}</div><div class='no-ads sidebar'>Not this</div>") == text


def test_broken_pages():
    pages = {
        None: "", "": "", "plain  &lt;text&gt;\n": "plain <text>", "<script>x<p>y": "", "<!-- a <p>b</p>": "",
        "<article><p>a <b>b</p><p>c&eacute; &am": "a b\ncé &am",
        "<article>" + "<div><b>" * 4000 + "deep": "deep",
        "<article><ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table>a<br>b": "x\ny\n1\n2\n3\na\nb",
        "<p>x</p></div></p></article><p>y": "x\ny",
    }
    for page, text in pages.items():
        assert html_text.extract(page) == text


def test_pages_table(spark):
    rows = [(1, "u", ARTICLE, "x"), (1, "u", ARTICLE, "x"), (2, None, None, "x"), (None, "u", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.main_text(pages).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"], r["text"]) for r in got)[0] == (0, 0, "")
    assert [len(r["text"]) for r in got] == [r["n_chars"] for r in got]
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_every_given_page_yields_its_article(spark):
    import html
    import re

    folder = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in queries.op3_html_text(spark, folder).collect()}
    for i, page in pages.items():
        inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inside)]
        assert got[i] == "\n".join(b for b in blocks if b)
