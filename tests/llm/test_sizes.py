"""What must not depend on size: long tags, texts full of matches, many rows of one id; and verdicts that the methods decide."""

import time

import pytest
from pyspark.sql import functions as F

from lorewell.llm import decontaminate, html_text, license_rules, line_quality, token_files, tokens, toxicity


@pytest.mark.parametrize("n", [100, 60_000, 70_000, 300_000])
def test_quotes_of_long_tags_close(n):
    html = f"<article><div data-x='{'a' * n} <b>secret>'>tail</div></article>"
    assert html_text.blocks(html) == [("article", "tail")]


def test_many_open_quotes_take_linear_time():
    began = time.time()
    html_text.blocks("<p a='x>" * 60_000 + "end")
    html_text.blocks("<p a=\"'>" * 60_000 + "end")
    assert time.time() - began < 5


@pytest.mark.parametrize(
    "html, want",
    [
        ("<div class='header'><main><p>main text</p></main></div>", ["main text"]),
        ("<div id='banner'><article><p>only</p></article></div>", ["only"]),
        ("<article>main</article><div class='sidebar'><article>teaser</article></div>", ["main"]),
        ("<div class='sidebar'><article>teaser</article></div><main>text</main>", ["text"]),
        ("<div class='page-header'><div role='main'>x<div class='menu'>y</div></div></div>", ["x"]),
        ("<section class='comments'><article>reader</article></section><article>text</article>", ["text"]),
        ("<section class='comments'><article>reader</article></section>", []),
        ("<aside><article>teaser</article></aside><p>open</p>", []),
        ("<div class='advert'><main>ad</main></div>", []),
        ("<article><header><h1>Title</h1></header><p>text</p></article>", ["text"]),
        ("<div class='sidebar'>links</div><article>text</article>", ["text"]),
    ],
)
def test_main_text_under_noisy_wrappers(html, want):
    found = html_text.blocks(html)
    assert [t for z, t in found if z == "article"] == want


def test_pages_that_need_no_repeats_are_parsed_once(spark, monkeypatch):
    rows = [(k, "http://h/", f"<article>{k}</article><div>side</div>") for k in range(20)] + [(99, "http://g/", "<p>open</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = []
    whole = html_text.repeats
    monkeypatch.setattr(html_text, "repeats", lambda p: seen.append(sorted(r._key for r in p.select("_key").collect())) or whole(p))
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert got == {k: str(k) for k in range(20)} | {99: "open"}
    assert seen == [[99]]  # only the host of the page that asks
    html_text.main_text(pages.where("page_id < 50")).collect()
    assert len(seen) == 1


def test_texts_full_of_licences_take_linear_time():
    line = "this is under the mit license or the apache license version 2 and cc by nc "
    scan = license_rules.detect
    active = [r for r in license_rules.rules() if r.label in ("mit", "apache-2", "cc-by-nc")]
    times, counts = [], []
    for n in (1_200, 4_800, 19_200):
        began = time.time()
        counts.append(len(scan((line * n).strip(), active)))
        times.append(time.time() - began)
    assert counts[2] == 16 * counts[0] and times[2] < 40 * times[0] + 1


def test_places_of_matches_are_words():
    text = "ä b under the mit license x spdx license identifier apache 2 0"
    active = [r for r in license_rules.rules() if r.label in ("mit", "apache-2")]
    words = text.split()
    for label, a, b, _ in license_rules.detect(text, active):
        assert {"mit": "mit", "apache-2": "apache"}[label] in words[a:b]


def test_lines_decide_a_verdict_that_the_base_rule_does_not(spark):
    own = lambda k: "\n".join(" ".join(f"w{k}x{i}y{j}" for j in range(10)) for i in range(6))
    shared = "\n".join(" ".join(f"menu{i}item{j}" for j in range(10)) for i in range(4))
    rows = [(k, own(k) + "\n" + shared, "host") for k in range(12)] + [(50, own(50), "host"), (51, own(51) + "\n" + shared, "other")]
    rows += [(60 + k, own(60 + k) + "\n" + shared.split("\n")[0], "host") for k in range(3)]
    got = {r.doc_id: r for r in line_quality.line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_left=0.7).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == set(range(12))  # 40 of 100 words are the host's; 10 of 70 are not too many
    assert got[0].n_shared_words == 40 and got[60].n_shared_words == 10 and got[51].n_shared_words == 0


def test_rows_of_no_id_are_many_shards(spark, tmp_path):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write_token_files(docs, str(tmp_path / "t"), tokens.default_vocabulary("byte_bpe_50k.json"), 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = [r.docs for r in manifest.collect()]
    assert len(shards) >= 3 and max(shards) < 3000 and sum(shards) == 4000
    rows = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_one_id_of_many_rows_is_one_of_the_sample(spark):
    rows = [(1, f"bad words {k}") for k in range(500)] + [(k, "good words") for k in range(2, 40)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert isinstance(model, toxicity.Model)


def test_items_without_blanks_are_counted_by_words(spark):
    items = spark.createDataFrame([(1, ",".join(f"w{k}" for k in range(50)))], "item_id long, text string")
    docs = spark.createDataFrame([(7, "x " + " ".join(f"w{k}" for k in range(50)) + " y")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.score) for r in decontaminate.contaminated(docs, items).collect()] == [(7, 1, 1.0)]
