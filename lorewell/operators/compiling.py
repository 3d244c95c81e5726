"""Concepts are compiled from notes: assignments, summaries, proposals, source sets, merged results and state."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import blocks
from lorewell.operators import concepts as scoring
from lorewell.operators import edges as edge_table
from lorewell.operators import seeds as seeding

# The fields of a model's assignment.
ASSIGNMENT = (
    "existing_concepts array<string>, proposed_new_concepts array<struct<"
    "slug: string, title: string, aliases: array<string>, rationale: string, draft_synthesis: string>>"
)
# Lists that a recompilation may give anew.
RESULT_LISTS = (
    "related_concepts", "key_idea_blocks", "variants", "common_combinations", "transfer_targets", "failure_modes", "open_questions",
)
#: Sources that one recompilation reads.
PROMPT_SOURCES = 8


def _given(c: Column) -> Column:
    """Stripped, or null if nothing is left."""
    return F.nullif(T.strip(c), F.lit(""))


def _text(df: DataFrame, name: str) -> Column:
    return _given(F.col(name)) if name in df.columns else F.lit(None).cast("string")


def parse_assignments(raw: DataFrame) -> DataFrame:
    """``raw(article_key, raw)`` as (article_key, existing, proposed, error).

    Unreadable or missing answers give empty lists and an error.  Blank slugs
    are dropped; a proposal without title is called by its slug.
    """
    got = F.from_json(T.unfenced(F.col("raw")), f"{ASSIGNMENT}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    a = raw.select("article_key", got.alias("a"))
    failed = F.col("a").isNull() | F.col("a._bad").isNotNull()
    kept = F.filter("a.proposed_new_concepts", lambda p: _given(p["slug"]).isNotNull())
    named = F.transform(
        kept, lambda p: p.withField("slug", T.strip(p["slug"])).withField("title", F.coalesce(_given(p["title"]), T.strip(p["slug"])))
    )
    existing = F.filter(F.transform("a.existing_concepts", T.strip), lambda s: s != "")
    return a.select(
        "article_key",
        F.when(~failed, existing).alias("existing"),
        F.when(~failed, named).alias("proposed"),
        F.when(failed, "json_parse_error").alias("error"),
    ).select(
        "article_key",
        F.coalesce("existing", F.array().cast("array<string>")).alias("existing"),
        F.coalesce("proposed", F.expr("filter(proposed, x -> false)"), F.from_json(F.lit("[]"), _proposals())).alias("proposed"),
        "error",
    )


def _proposals() -> str:
    return ASSIGNMENT.split("proposed_new_concepts ")[1]


def feeds(assignments: DataFrame) -> DataFrame:
    """(article_key, slug): every concept, existing or proposed, that an article feeds; once."""
    both = F.array_distinct(F.concat("existing", F.transform("proposed", lambda p: p["slug"])))
    return assignments.select("article_key", F.explode(both).alias("slug"))


def source_summaries(notes: DataFrame, assignments: DataFrame, today: str) -> DataFrame:
    """A summary of each note: what to take from it and which concepts it feeds.

    The takeaway is the first of core hypothesis, tldr and 140 characters of
    the summary that is not blank.  Notes may lack any of the columns.
    """
    takeaway = F.coalesce(
        _text(notes, "core_hypothesis"), _text(notes, "tldr"), F.substring(_text(notes, "summary"), 1, 140), F.lit("")
    )
    value = F.coalesce(_text(notes, "brainstorm_value"), F.lit(""))
    both = F.concat("existing", F.transform("proposed", lambda p: p["slug"]))
    return notes.join(assignments.select("article_key", both.alias("_feeds")), "article_key", "left").select(
        "article_key",
        F.coalesce(_text(notes, "title"), F.col("article_key")).alias("title"),
        F.coalesce(_text(notes, "content_type"), F.lit("")).alias("content_type"),
        F.coalesce("_feeds", F.array().cast("array<string>")).alias("feeds_concepts"),
        F.coalesce(_text(notes, "ingested"), F.lit(today)).alias("ingested"),
        F.lit(today).alias("last_compiled"),
        takeaway.alias("takeaway"),
        F.slice(F.coalesce("idea_blocks", F.array().cast("array<string>")), 1, 3).alias("top_idea_blocks"),
        F.when(value == "", "").otherwise(F.concat(F.lit("Brainstorm value: "), value, F.lit("."))).alias("why_in_kb"),
    )


def concept_index(concepts: DataFrame) -> DataFrame:
    """(slug, title, definition) of stable concepts, definitions cut to 120 characters."""
    return concepts.where("status = 'stable'").select(
        "slug", "title", F.substring(F.coalesce("definition", F.lit("")), 1, 120).alias("definition")
    )


def proposed_concepts(assignments: DataFrame, concepts: DataFrame) -> DataFrame:
    """New concepts: of several proposals of one slug the first article's counts, existing slugs stay as they are.

    The minimum is taken before the shuffle, so a slug that a third of all
    articles propose costs one row a task.
    """
    each = assignments.select("article_key", F.posexplode("proposed").alias("at", "p"))
    first = each.groupBy(F.col("p.slug").alias("slug")).agg(F.min(F.struct("article_key", "at", "p")).alias("f"))
    return first.join(concepts.select("slug").distinct(), "slug", "left_anti").select(
        "slug",
        F.col("f.p.title").alias("title"),
        F.lit("proposed").alias("status"),
        F.col("f.p.rationale").alias("definition"),
        F.col("f.p.draft_synthesis").alias("synthesis"),
        F.array("f.article_key").alias("sources"),
        F.lit(0).alias("compile_version"),
    )


def concept_sources(
    concepts: DataFrame, fed: DataFrame, changed: DataFrame, hit: DataFrame | None = None, edges: DataFrame | None = None
) -> DataFrame:
    """(slug, article_key, current): sources of each concept that a changed article feeds, old and new ones, once.

    ``current`` says that the article feeds the concept now.  ``hit(slug)`` names
    the concepts where not all that changed articles feed count.  Rows and not
    lists, since one concept may have a third of all articles; with ``edges``
    (see :mod:`lorewell.operators.edges`) the old ones come from there too.
    """
    known = concepts.select("slug").distinct()
    if hit is None:
        hit = fed.join(changed.select("article_key").distinct(), "article_key", "left_semi")
    hit = hit.select("slug").distinct()
    hit = hit.join(known, "slug", "left_semi")
    old = concepts.select("slug", F.explode("sources").alias("article_key"))
    if edges is not None:  # proposals list the one source they have
        old = old.unionByName(edge_table.rows_of(edges))
    old = old.withColumn("current", F.lit(False))
    every = old.unionByName(fed.select("slug", "article_key").withColumn("current", F.lit(True)))
    return every.join(hit, "slug", "left_semi").groupBy("slug", "article_key").agg(F.max("current").alias("current"))


def prompt_sources(sources: DataFrame, cap: int = PROMPT_SOURCES) -> DataFrame:
    """The ``cap`` sources that a recompilation of a concept reads, current ones first; with ``place`` from 1."""
    w = Window.partitionBy("slug").orderBy(F.desc("current"), "article_key")
    return sources.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)


def source_sets(sources: DataFrame) -> DataFrame:
    """(slug, sources, source_basenames) of ``concept_sources``: each concept's articles in order, as its page lists them."""
    listed = sources.groupBy("slug").agg(F.array_sort(F.collect_set("article_key")).alias("sources"))
    return listed.withColumn("source_basenames", F.transform("sources", lambda k: F.substring_index(k, "/", -1)))


def recompile_merge(
    concepts: DataFrame, results: DataFrame, sets: DataFrame | None = None, today: str | None = None
) -> DataFrame:
    """``concepts`` with ``results(slug, synthesis, definition, error)`` taken over.

    Concepts without a result or with an error stay; the others become stable
    in a new version, and keep their definition if the new one is blank.  Lists
    of :data:`RESULT_LISTS` that the results have are taken over too.  With
    ``sets`` (see :func:`source_sets`) they also take over their sources, with
    ``today`` the date.
    """
    lists = [c for c in RESULT_LISTS if c in results.columns and c in concepts.columns]
    r = results.select(
        "slug", F.col("synthesis").alias("_synthesis"), F.col("definition").alias("_definition"), F.col("error").isNull().alias("_ok"),
        *[F.col(c).alias(f"_new_{c}") for c in lists],
    )
    ok = F.coalesce("_ok", F.lit(False))
    given = concepts
    if sets is not None:
        new = sets.select("slug", F.col("sources").alias("_sources"), F.col("source_basenames").alias("_names"))
        new = new.join(r.where("_ok").select("slug"), "slug", "left_semi")
        given = given.join(new, "slug", "left").withColumn("sources", F.coalesce("_sources", "sources"))
        if "source_basenames" in concepts.columns:
            given = given.withColumn("source_basenames", F.coalesce("_names", "source_basenames"))
        if "source_count" in sets.columns and "source_count" in concepts.columns:
            counts = sets.select("slug", F.col("source_count").alias("_count")).join(r.where("_ok").select("slug"), "slug", "left_semi")
            given = given.join(counts, "slug", "left").withColumn("source_count", F.coalesce("_count", "source_count")).drop("_count")
        given = given.drop("_sources", "_names")
    if today is not None:
        done = r.where("_ok").select("slug", F.lit(today).alias("_today"))
        given = given.join(done, "slug", "left").withColumn("last_compiled", F.coalesce("_today", "last_compiled")).drop("_today")
    return (
        given.join(r, "slug", "left")
        .withColumn("status", F.when(ok, "stable").otherwise(F.col("status")))
        .withColumn("compile_version", F.col("compile_version") + ok.cast("int"))
        .withColumn("synthesis", F.when(ok, F.col("_synthesis")).otherwise(F.col("synthesis")))
        .withColumn("definition", F.when(ok, F.coalesce(_given(F.col("_definition")), "definition")).otherwise(F.col("definition")))
        .withColumns({c: F.when(ok & F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in lists})
        .drop("_synthesis", "_definition", "_ok", *[f"_new_{c}" for c in lists])
    )


def retrieval_hints(aliases: Column, title: Column) -> Column:
    """Aliases and title, trimmed; of those that differ in case alone the first stays."""
    all_ = F.filter(F.transform(F.concat(aliases, F.array(title)), T.strip), lambda x: x != "")
    low = F.transform(all_, F.lower)
    return F.filter(all_, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def concept_state(concepts: DataFrame, state: DataFrame, today: str) -> DataFrame:
    """State of each concept after a compilation; only conflicts come from the ``state`` before."""
    old = state.select("slug", F.col("conflicts").alias("_conflicts"))
    # with an edge table a concept's row lists its first sources alone, and says how many it has
    n = F.coalesce("source_count", F.size("sources")) if "source_count" in concepts.columns else F.size("sources")
    c = concepts.join(old, "slug", "left")
    return c.select(
        "slug",
        "status",
        n.alias("source_count"),
        F.least(n / 5.0, F.lit(1.0)).alias("importance"),
        T.freshness(F.col("last_compiled"), F.lit(today).cast("date")).alias("freshness"),
        retrieval_hints(F.col("aliases"), F.col("title")).alias("retrieval_hints"),
        F.coalesce("_conflicts", F.lit(0)).alias("conflicts"),
        *([F.col("confidence")] if "confidence" in concepts.columns else []),
    )


def compile_report(
    judged: DataFrame, assignments: DataFrame, results: DataFrame
) -> DataFrame:
    """One row of counts: articles skipped and assigned, summaries written, failures, proposals and recompiled concepts.

    ``judged`` are all articles with their state, ``assignments`` those of the
    changed ones, ``results(slug, error)`` the recompilations.
    """
    skipped = judged.agg(F.count_if(F.col("state") == "same").alias("skipped"))
    assigned = assignments.agg(
        F.count("*").alias("sources_written"),
        F.count("*").alias("concepts_assigned"),
        F.coalesce(F.sum(F.size("proposed").cast("long")), F.lit(0)).alias("concepts_proposed"),
        F.count_if(F.col("error").isNotNull()).alias("assign_failed"),
    )
    compiled = results.agg(
        F.count_if(F.col("error").isNull()).alias("concepts_recompiled"), F.count_if(F.col("error").isNotNull()).alias("recompile_failed")
    )
    row = assigned.crossJoin(compiled).crossJoin(skipped)  # one row each
    return row.withColumn("errors", F.col("assign_failed") + F.col("recompile_failed"))


def index_groups(concepts: DataFrame) -> DataFrame:
    """(section, content_type, slug, source_count): the overview page's lines, stable concepts by type and proposed ones.

    Write it after ``orderBy`` of these columns; deprecated concepts are left out.
    """
    kind = F.coalesce(F.get("content_types", F.lit(0)), F.lit("uncategorized"))
    stable = F.col("status") == "stable"
    return concepts.where(F.col("status").isin("stable", "proposed")).select(
        F.when(stable, "stable").otherwise("proposed").alias("section"),
        F.when(stable, kind).otherwise("").alias("content_type"),
        "slug",
        F.size("sources").alias("source_count"),
    )


def index_header(concepts: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row: stable and proposed concepts, and source summaries."""
    of_concepts = concepts.agg(
        F.count_if(F.col("status") == "stable").alias("stable"), F.count_if(F.col("status") == "proposed").alias("proposed")
    )
    return of_concepts.crossJoin(summaries.agg(F.count("*").alias("sources")))  # one row each


class Compiled(NamedTuple):
    """What a compilation gives."""

    concepts: DataFrame
    summaries: DataFrame
    source_state: DataFrame
    concept_state: DataFrame
    report: DataFrame
    edges: DataFrame | None = None


def compile_job(
    notes: DataFrame,
    concepts: DataFrame,
    summaries: DataFrame,
    source_state: DataFrame,
    state: DataFrame,
    seeds: DataFrame,
    assign: Callable[[DataFrame], DataFrame],
    recompile: Callable[[DataFrame], DataFrame],
    keep: Callable[[DataFrame], DataFrame],
    today: str,
    mode: str = "incremental",
    edges: DataFrame | None = None,
) -> Compiled:
    """Articles to concepts: assignments of changed articles, proposals, recompiled concepts, summaries and states.

    All notes ``(article_key, hash, ...)`` take part, whatever their status.
    ``assign(notes)`` gives model answers ``(article_key, raw)``, ``recompile(prompts)``
    answers ``(slug, synthesis, definition, error)`` for rows
    ``(slug, article_key, place)``; ``keep`` writes a table and reads it again, so
    that no model is asked twice.  A rebuild begins with the seeds alone and takes
    every article as new.  An article whose assignment failed gets a summary but no
    state, so the next run takes it again.

    With ``edges``, the edge table before, concepts list their first sources
    only and have ``source_count``, and the new edge table is returned; no row
    then grows with the articles that feed a concept.
    """
    if mode not in ("incremental", "rebuild"):
        raise ValueError(f"no mode {mode}")
    if mode == "rebuild":
        concepts, summaries, source_state, state = (df.limit(0) for df in (concepts, summaries, source_state, state))
        edges = edges.limit(0) if edges is not None else None
    concepts = seeding.bootstrap(concepts, seeds)
    known = source_state.select(F.col("path").alias("article_key"), F.col("content_hash").alias("hash"))
    judged = blocks.changed_articles(notes.select("article_key", "hash"), known, summaries=summaries)
    todo = judged.where("state <> 'same'").select("article_key")
    changed = notes.join(todo, "article_key", "left_semi")
    assigned = keep(parse_assignments(assign(changed)))
    new = proposed_concepts(assigned, concepts)
    every = keep(concepts.unionByName(new, allowMissingColumns=True))
    done = assigned.where("error IS NULL")
    skipped = judged.where("state = 'same'").select("article_key")
    fed = feeds(done).unionByName(
        source_state.select(F.col("path").alias("article_key"), F.explode("feeds_concepts").alias("slug")).join(skipped, "article_key", "left_semi")
    )
    existing = done.select("article_key", F.explode("existing").alias("slug"))
    sources = keep(concept_sources(every, fed, done, hit=existing, edges=edges))
    results = keep(recompile(prompt_sources(sources)))
    if edges is None:
        sets = source_sets(sources)
    else:
        if "source_count" not in every.columns:
            every = every.withColumn("source_count", F.size("sources"))
        of_good = sources.join(results.where("error IS NULL").select("slug").distinct(), "slug", "left_semi")
        places = keep(edge_table.placed(of_good, keep))
        sets = edge_table.first_sources(places)
        proposed = new.join(of_good, "slug", "left_anti").select("slug", F.explode("sources").alias("article_key"))
        fresh = edge_table.chunks(places).unionByName(edge_table.chunks(edge_table.placed(proposed, keep)))
        edges = edge_table.merged(edges, keep(fresh))
    merged = keep(recompile_merge(every, results, sets, today))
    written = keep(source_summaries(changed, assigned, today))
    old_summaries = summaries.join(written.select("article_key"), "article_key", "left_anti")
    entries = done.join(notes.select("article_key", "hash"), "article_key").select(
        F.col("article_key").alias("path"),
        F.col("hash").alias("content_hash"),
        F.lit(today).alias("last_seen"),
        F.concat("existing", F.transform("proposed", lambda p: p["slug"])).alias("feeds_concepts"),
    )
    old_entries = source_state.join(entries.select("path"), "path", "left_anti")
    return Compiled(
        merged,
        old_summaries.unionByName(written, allowMissingColumns=True),
        old_entries.unionByName(entries, allowMissingColumns=True),
        concept_state(scoring.confidence(merged), state, today),
        compile_report(judged, assigned, results),
        edges,
    )
