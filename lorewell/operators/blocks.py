"""Typed blocks of notes, their ids and the incremental index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import text as T

TEXT_FIELDS = ("summary", "core_hypothesis", "research_question", "signal_framework")
LIST_FIELDS = ("idea_blocks", "combination_hooks", "transfer_targets", "failure_modes")
# Texts that stand for nothing.
PLACEHOLDERS = ("_none_", "_pending_")


def _typed(name: str):
    return lambda x: F.struct(F.lit(name).alias("block_type"), x.alias("text"))


def build_blocks(notes: DataFrame, max_paragraphs: int = 6, cut: int = 400, keep: tuple[str, ...] = ()) -> DataFrame:
    """(article_key, ordinal, block_type, text): text fields, list items, then the first lines of the main content.

    Blank texts and placeholders are dropped before blocks are numbered.  Fields
    that the notes lack, and null ones, give nothing.  Columns named by ``keep``
    go with each block.
    """
    parts = []
    for name in TEXT_FIELDS:
        if name in notes.columns:
            parts.append(F.array(F.struct(F.lit(name).alias("block_type"), F.col(name).alias("text"))))
    for name in LIST_FIELDS:
        if name in notes.columns:
            items = F.coalesce(F.col(name), F.array().cast("array<string>"))
            parts.append(F.transform(items, _typed(name)))
    lines = F.filter(F.split(F.coalesce("main_content", F.lit("")), "\n"), lambda x: T.strip(x) != "")
    parts.append(
        F.transform(
            F.slice(lines, 1, max_paragraphs),
            lambda x: F.struct(F.lit("main_content").alias("block_type"), F.substring(T.strip(x), 1, cut).alias("text")),
        )
    )
    stripped = F.transform(F.concat(*parts), lambda b: F.struct(b["block_type"], T.strip(b["text"]).alias("text")))
    kept = F.filter(stripped, lambda b: b["text"].isNotNull() & (b["text"] != "") & ~b["text"].isin(*PLACEHOLDERS))
    return notes.select("article_key", *keep, F.posexplode(kept).alias("ordinal", "b")).select(
        "article_key", "ordinal", "b.block_type", "b.text", *keep
    )


def with_block_id(blocks: DataFrame) -> DataFrame:
    """The id names article, type and place, and ends in a hash that changes with the text."""
    raw = F.concat_ws("|", "article_key", "block_type", F.col("ordinal").cast("string"), "text")
    return blocks.withColumn(
        "block_id",
        F.concat_ws(
            "__",
            F.regexp_replace("article_key", "/", "__"),
            "block_type",
            F.col("ordinal").cast("string"),
            F.substring(F.sha1(raw), 1, 16),
        ),
    )


# Sections of a concept whose bullets are part of its block.
CONCEPT_BLOCK_SECTIONS = ("key_idea_blocks", "variants", "common_combinations", "transfer_targets", "failure_modes")
#: Version of the index's layout; part of every article's hash, so a new one indexes all again.
INDEX_VERSION = "1"
SCORES = ("confidence", "importance", "freshness")


def article_blocks(notes: DataFrame) -> DataFrame:
    """Blocks of notes with ids, the layer ``article`` and what the index says about their note."""
    said = tuple(c for c in ("content_type", "brainstorm_value", "status") if c in notes.columns)
    return with_block_id(build_blocks(notes, keep=said)).withColumn("kb_layer", F.lit("article"))


def build_wiki_blocks(concepts: DataFrame, summaries: DataFrame, state: DataFrame) -> DataFrame:
    """A block for each concept and each source summary that has text, as rows of the index.

    A concept's text is its synthesis, its definition and its bullets but open
    questions; its scores come from ``state``, 0 without one.  A summary's text is
    its takeaway and top ideas.
    """
    empty = F.array().cast("array<string>")
    sections = [F.array_join(F.coalesce(F.col(c), empty), "\n") for c in CONCEPT_BLOCK_SECTIONS if c in concepts.columns]
    parts = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in ("synthesis", "definition") if c in concepts.columns], *sections)
    filled = lambda x: x != ""
    known = state.select("slug", *[F.col(c).alias(f"_{c}") for c in (*SCORES, "source_count")])
    kind = F.coalesce(F.get("content_types", F.lit(0)), F.lit("")) if "content_types" in concepts.columns else F.lit("")
    of_concepts = concepts.join(known, "slug", "left").select(
        F.concat(F.lit("wiki/concepts/"), "slug", F.lit(".md")).alias("article_key"),
        F.lit("wiki_concept").alias("block_type"),
        F.array_join(F.filter(parts, filled), "\n\n").alias("text"),
        kind.alias("content_type"),
        F.lit("high").alias("brainstorm_value"),
        "status",
        "slug",
        *[F.coalesce(F.col(f"_{c}"), F.lit(0.0)).alias(c) for c in SCORES],
        F.coalesce("_source_count", F.size("sources")).alias("source_count"),
    )
    ideas = F.concat(F.array(F.coalesce("takeaway", F.lit(""))), F.coalesce("top_idea_blocks", empty))
    value = F.coalesce("brainstorm_value", F.lit("")) if "brainstorm_value" in summaries.columns else F.lit("")
    name = F.substring_index("article_key", "/", -1)
    of_summaries = summaries.select(
        F.concat(F.lit("wiki/sources/"), name, F.lit(".md")).alias("article_key"),
        F.lit("wiki_source").alias("block_type"),
        F.array_join(F.filter(ideas, filled), " · ").alias("text"),
        "content_type",
        value.alias("brainstorm_value"),
        F.lit("stable").alias("status"),
    )
    both = of_concepts.unionByName(of_summaries, allowMissingColumns=True).where(T.strip(F.col("text")) != "")
    return with_block_id(both.withColumn("ordinal", F.lit(0))).withColumn("kb_layer", F.col("block_type"))


def all_blocks(articles: DataFrame, wiki: DataFrame) -> DataFrame:
    """One table of article and wiki blocks; ``kb_layer`` tells them apart, columns of one kind are null in the other."""
    return articles.unionByName(wiki, allowMissingColumns=True)


def index_hash(content: Column) -> Column:
    """The hash that decides whether an article is indexed again: of the index's version and the article's text."""
    return F.sha2(F.concat(F.lit(INDEX_VERSION), F.coalesce(content, F.lit(""))), 256)


def changed_articles(
    current: DataFrame, manifest: DataFrame, force: bool = False, summaries: DataFrame | None = None
) -> DataFrame:
    """``current(article_key, hash)`` with state: new, changed or same.

    With ``summaries`` (compilation) an article of the same hash counts as
    changed if its summary is missing.
    """
    old = manifest.select("article_key", F.col("hash").alias("old_hash"))
    differs = F.lit(force) | (F.col("hash") != F.col("old_hash"))
    out = current.join(old, "article_key", "left")
    if summaries is not None:
        out = out.join(summaries.select("article_key").distinct().withColumn("_has", F.lit(True)), "article_key", "left")
        differs = differs | F.col("_has").isNull()
    state = F.when(F.col("old_hash").isNull(), "new").when(differs, "changed").otherwise("same")
    return out.withColumn("state", state).select(*current.columns, "state")


def upsert_blocks(
    index: DataFrame, new_blocks: DataFrame, changed: DataFrame, present: DataFrame | None = None
) -> DataFrame:
    """All blocks of changed articles and of wiki pages that come anew are replaced; the others stay.

    A changed wiki page's old block has another id, so pages are replaced by
    name.  With ``present`` blocks of articles and pages not in it go too.
    """
    pages = new_blocks.where("kb_layer <> 'article'").select("article_key") if "kb_layer" in new_blocks.columns else None
    replaced = changed.select("article_key") if pages is None else changed.select("article_key").unionByName(pages)
    kept = index.join(replaced.distinct(), "article_key", "left_anti")
    if present is not None:
        kept = kept.join(present.select("article_key").distinct(), "article_key", "left_semi")
    return kept.unionByName(new_blocks, allowMissingColumns=True)


def block_counts(articles: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks of every article, 0 included."""
    n = blocks.groupBy("article_key").agg(F.count("*").alias("block_count"))
    return articles.select("article_key").join(n, "article_key", "left").fillna(0, ["block_count"])
