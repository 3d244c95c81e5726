"""Lint of what changed: issues are stored by what they belong to, and judged again only where that, or what it depends on, differs.

A page is judged by itself, by its content's hash.  An alias is judged again
when a page that has it, or had it, changes; a source summary also when a
concept that it feeds appears, goes or changes its status; a source's entry
when its hash or its article's does.  The stored tables are keyed for these
look-ups, so a run reads the buckets of what it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.operators import concepts as C
from lorewell.operators import linting as L
from lorewell.operators import wiki_pages as W
from lorewell.sources import scratch
from lorewell.sources.store import Change, Store

#: Tables of a lint store, and their keys.
STORED = {"seen": "owner", "facts": "owner", "aliases": "alias", "slugs": "slug", "feeders": "slug", "issues": "owner"}
_SCHEMAS = {
    "seen": "owner string, hash string",
    "facts": "owner string, slug string, stable boolean, aliases array<string>, name string, feeds_concepts array<string>",
    "aliases": "alias string, owner string, slug string",
    "slugs": "slug string, owner string, stable boolean",
    "feeders": "slug string, owner string",
    "issues": "owner string, severity string, kind string, path string, message string",
}
_ISSUE = ["severity", "kind", "path", "message"]


def _stored(store: Store, table: str, keys: DataFrame | None = None) -> DataFrame:
    """A stored table, or its rows of some keys, read from their buckets."""
    key, none = STORED[table], store.spark.createDataFrame([], _SCHEMAS[table])
    if keys is None:
        whole = store.read(table)
        return none if whole is None else whole
    buckets = [r.b for r in keys.select(store.bucket(F.col(key)).alias("b")).distinct().collect()]
    some = store.read(table, only=buckets)
    return none if some is None else some.join(keys.select(key).distinct(), key, "left_semi")


def _alias(c: Column) -> Column:
    return F.lower(F.trim(c))


def _page_issues(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(owner, issue) of parsed concept and source pages by themselves."""
    good = pages.where("error IS NULL")
    # judged under the page's path, which is one, and then named by its slug
    by_page = C.lint(good.withColumn("slug", F.col("page_path"))).where("kind <> 'schema_empty_synthesis'")
    names = good.select("page_path", F.concat(F.lit("wiki/concepts/"), "slug", F.lit(".md")).alias("path"))
    of_rows = by_page.withColumnRenamed("slug", "page_path").join(names, "page_path")
    of_rows = of_rows.select(F.col("page_path").alias("owner"), *_ISSUE)
    judged = W.lint_concept_pages(pages).unionByName(W.lint_source_pages(sources))
    of_pages = judged.select(F.col("page_path").alias("owner"), "severity", "kind", F.col("page_path").alias("path"), "message")
    return of_rows.unionByName(of_pages)


def _alias_issues(rows: DataFrame) -> DataFrame:
    """(owner, issue) of ``rows(alias, owner, slug)``: aliases of more than one slug."""
    many = rows.groupBy("alias").agg(F.array_sort(F.collect_set("slug")).alias("slugs")).where(F.size("slugs") > 1)
    return many.select(
        F.concat(F.lit("alias:"), "alias").alias("owner"),
        F.lit("warning").alias("severity"),
        F.lit("duplicate_aliases").alias("kind"),
        F.lit("wiki/concepts").alias("path"),
        F.concat("alias", F.lit(": "), F.array_join("slugs", ", ")).alias("message"),
    )


def lint_changes(store: Store, concept_pages: DataFrame, source_pages: DataFrame, source_state: DataFrame, articles: DataFrame) -> DataFrame:
    """(severity, kind, path, message): all issues, as :func:`lorewell.operators.linting.lint_job` gives, from the stored ones and what changed.

    ``concept_pages`` and ``source_pages`` are (page_path, content) rows, each
    path once.  The new issues are committed to ``store``, in one version with
    what the next run needs.
    """
    now = articles.select(F.col("article_key").alias("path"), F.col("hash").alias("_now"))
    state = source_state.select("path", "content_hash", "feeds_concepts").join(now, "path", "left")
    of_state = F.sha2(F.to_json(F.struct("content_hash", "feeds_concepts", "_now")), 256)
    of_page = F.sha2(F.coalesce("content", F.lit("")), 256)
    seen = concept_pages.select(F.col("page_path").alias("owner"), of_page.alias("hash"))
    seen = seen.unionByName(source_pages.select(F.col("page_path").alias("owner"), of_page.alias("hash")))
    seen = seen.unionByName(state.select(F.concat(F.lit("state:"), "path").alias("owner"), of_state.alias("hash")))
    old = _stored(store, "seen").select("owner", F.col("hash").alias("was"))
    both = scratch.kept(seen.join(old, "owner", "full").where("NOT (hash <=> was)"))
    changed = both.where("hash IS NOT NULL").select("owner", "hash")
    touched = both.select("owner")  # what changed, came or went
    if not both.limit(1).count():
        return _stored(store, "issues").select(*_ISSUE)

    of_path = changed.select(F.col("owner").alias("page_path"))
    pages = scratch.kept(W.parse_concept_pages(concept_pages.join(of_path, "page_path", "left_semi")))
    sources = scratch.kept(W.parse_source_pages(source_pages.join(of_path, "page_path", "left_semi")))
    none = lambda kind: F.lit(None).cast(kind)
    facts = pages.where("error IS NULL").select(
        F.col("page_path").alias("owner"), "slug", (F.col("status") == "stable").alias("stable"), "aliases",
        none("string").alias("name"), none("array<string>").alias("feeds_concepts"),
    )
    facts = facts.unionByName(
        sources.where("error IS NULL").select(
            F.col("page_path").alias("owner"), none("string").alias("slug"), none("boolean").alias("stable"), none("array<string>").alias("aliases"),
            F.regexp_extract("page_path", r"([^/]*)\.md\z", 1).alias("name"), "feeds_concepts",
        )
    )
    facts = scratch.kept(facts)
    before = scratch.kept(_stored(store, "facts", touched))

    def renewed(table: str, key: str, rows_of) -> tuple[DataFrame, DataFrame]:
        """(keys that pages which changed have or had, all rows of these keys as they are now)."""
        fresh = rows_of(facts)
        keys = scratch.kept(fresh.select(key).unionByName(rows_of(before).select(key)).distinct())
        others = _stored(store, table, keys).join(touched, "owner", "left_anti")
        return keys, scratch.kept(others.unionByName(fresh))

    of_aliases = lambda f: f.where("stable").select(F.explode("aliases").alias("alias"), "owner", "slug").withColumn("alias", _alias(F.col("alias"))).distinct()
    of_slugs = lambda f: f.where("slug IS NOT NULL").select("slug", "owner", "stable")
    of_feeders = lambda f: f.where("name IS NOT NULL").select(F.explode("feeds_concepts").alias("slug"), "owner").distinct()
    aliases, alias_rows = renewed("aliases", "alias", of_aliases)
    slugs, slug_rows = renewed("slugs", "slug", of_slugs)
    fed, feeder_rows = renewed("feeders", "slug", of_feeders)

    # summaries that changed, and those that feed a concept which did
    feeding = _stored(store, "feeders", slugs).select("owner").join(touched, "owner", "left_anti").distinct()
    asked = _stored(store, "facts", feeding).unionByName(facts.where("name IS NOT NULL"))
    asked = scratch.kept(asked.select("owner", "name", "feeds_concepts"))
    wanted = asked.select(F.explode("feeds_concepts").alias("slug")).distinct()
    known = _stored(store, "slugs", wanted).join(touched, "owner", "left_anti").unionByName(of_slugs(facts))
    stable = known.where("stable").select("slug", F.lit("stable").alias("status")).distinct()
    loose = L.orphan_summaries(asked.withColumn("_name", F.col("name")).withColumn("name", F.col("owner")), stable)
    loose = loose.withColumn("owner", F.regexp_replace(F.substring("path", len("wiki/sources/") + 1, 1_000_000), r"\.md\z", ""))
    loose = loose.join(asked.select("owner", "name"), "owner").select(
        F.concat(F.lit("feeds:"), "owner").alias("owner"), "severity", "kind", F.concat(F.lit("wiki/sources/"), "name", F.lit(".md")).alias("path"), "message"
    )
    of_state = changed.where(F.col("owner").startswith("state:")).select(F.substring("owner", len("state:") + 1, 1_000_000).alias("path"))
    stale = L.stale_sources(source_state.join(of_state, "path", "left_semi"), articles)
    stale = stale.select(F.concat(F.lit("state:"), "path").alias("owner"), *_ISSUE)

    issues = _page_issues(pages, sources).unionByName(_alias_issues(alias_rows)).unionByName(loose).unionByName(stale)
    owners = touched.unionByName(aliases.select(F.concat(F.lit("alias:"), "alias").alias("owner")))
    owners = owners.unionByName(touched.unionByName(asked.select("owner")).select(F.concat(F.lit("feeds:"), "owner").alias("owner")))
    store.commit(
        {
            "issues": Change(issues, owners),
            "seen": Change(changed, touched),
            "facts": Change(facts, touched),
            "aliases": Change(alias_rows, aliases),
            "slugs": Change(slug_rows, slugs),
            "feeders": Change(feeder_rows, fed),
        }
    )
    return store.read("issues").select(*_ISSUE)
