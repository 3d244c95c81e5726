"""Lint of changes against a full run, after each of a series of edits."""

import random

from pyspark.sql import functions as F

from lorewell.operators import lint_changes as X
from lorewell.operators import linting as L
from lorewell.operators import wiki_pages as W
from lorewell.sources.store import Store

CONCEPT = "slug string, title string, status string, aliases array<string>, sources array<string>, compile_version int, synthesis string, key_idea_blocks array<string>"
SUMMARY = "name string, title string, feeds_concepts array<string>, brainstorm_value string, takeaway string"
STATE = "path string, content_hash string, feeds_concepts array<string>"


class Wiki:
    """Concepts, summaries, states and articles that tests change."""

    def __init__(self, r):
        self.r, self.concepts, self.summaries, self.state, self.articles, self.broken = r, {}, {}, {}, {}, set()
        for k in range(8):
            self.add_concept(f"c{k}")
        for k in range(12):
            self.add_summary(f"s{k}")
            self.state[f"raw/s{k}"] = ("h", [f"c{k % 8}"])
            self.articles[f"raw/s{k}"] = "h"

    def add_concept(self, slug):
        r = self.r
        bullets = [f"idea {r.randrange(9)}" + r.choice(["", " [raw/1]"]) for _ in range(r.randrange(3))]
        aliases = [f"A{r.randrange(5)}", f" a{r.randrange(5)}"]
        self.concepts[slug] = (slug, slug, r.choice(["stable", "stable", "proposed", "deprecated"]), aliases, r.choice([[], ["raw/1"]]), r.randrange(3), r.choice(["", "text"]), bullets)

    def add_summary(self, name):
        r = self.r
        self.summaries[name] = (name, name, sorted({f"c{r.randrange(10)}" for _ in range(r.randrange(3))}), r.choice(["high", "best"]), "t")

    def tables(self, spark):
        pages = W.render_concept_pages(spark.createDataFrame(list(self.concepts.values()), CONCEPT)).collect()
        rows = [(p.page_path, "no header" if p.page_path in self.broken else p.content) for p in pages]
        sources = W.render_source_pages(spark.createDataFrame(list(self.summaries.values()), SUMMARY))
        state = spark.createDataFrame([(p, h, f) for p, (h, f) in self.state.items()], STATE)
        articles = spark.createDataFrame(list(self.articles.items()), "article_key string, hash string")
        return spark.createDataFrame(rows, "page_path string, content string"), sources, state, articles


def full(pages, sources, state, articles):
    c, s = W.parse_concept_pages(pages), W.parse_source_pages(sources)
    named = s.where("error IS NULL").withColumn("name", F.regexp_extract("page_path", r"([^/]*)\.md\z", 1))
    return L.lint_job(c.where("error IS NULL"), c, s, named, state, articles)


def rows(df):
    return sorted(tuple(r) for r in df.select("severity", "kind", "path", "message").collect())


def test_after_any_edit_the_table_is_that_of_a_full_run(spark, tmp_path, monkeypatch):
    wiki = Wiki(random.Random(11))
    store = Store(spark, str(tmp_path / "lint"), X.STORED, 8)
    judged = []
    whole = W.parse_concept_pages
    monkeypatch.setattr(X.W, "parse_concept_pages", lambda p: judged.append(sorted(r.page_path for r in p.collect())) or whole(p))

    def check(pages_judged):
        tables = wiki.tables(spark)
        judged.clear()
        got = rows(X.lint_changes(store, *tables))
        assert judged == ([sorted(f"wiki/concepts/{s}.md" for s in pages_judged)] if pages_judged is not None else [])
        assert got == rows(full(*tables))
        return got

    check(list(wiki.concepts))
    before = set(store.read("issues").inputFiles())
    check(None)  # nothing changed, nothing is judged or written
    assert set(store.read("issues").inputFiles()) == before
    wiki.concepts["c1"] = ("c1", "c1", "stable", ["A1", "shared"], [], 1, "text", ["bare"])
    wiki.concepts["c2"] = ("c2", "c2", "stable", ["SHARED "], [], 1, "", [])
    assert any("shared: c1, c2" in r[3] for r in check(["c1", "c2"]))
    # an alias and summaries lose concepts, and gain one that they fed before it was there
    wiki.concepts["c2"] = ("c2", "c2", "deprecated", ["SHARED "], [], 1, "", [])
    del wiki.concepts["c1"]
    wiki.add_concept("c9")
    wiki.broken.add("wiki/concepts/c3.md")
    assert not any("shared" in r[3] for r in check(["c2", "c3", "c9"]))
    wiki.broken.clear()
    wiki.add_summary("s1")
    wiki.summaries["s2"] = ("s2", "s2", ["nowhere"], "high", "")
    del wiki.summaries["s4"]
    wiki.articles["raw/s5"] = "other"
    del wiki.articles["raw/s6"]
    del wiki.state["raw/s7"]
    got = check(["c3"])
    assert ("warning", "orphan_sources", "raw/s6", "source is gone") in got
