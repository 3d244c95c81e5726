"""Articles with a header become notes; notes are filtered and routed by their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import text as T

# Fields of an article's header.
HEADER_TEXTS = (
    "content_type", "brainstorm_value", "summary", "core_hypothesis", "research_question", "signal_framework", "source_url", "ingested", "tldr",
)
FACETS = ("market", "asset_type", "strategy_type")
HEADER_LISTS = ("idea_blocks", "combination_hooks", "transfer_targets", "failure_modes")
SYNCABLE = ("reviewed", "high_value")


def parse_frontmatter(content: Column) -> tuple[Column, Column]:
    """(header map, body).  Without two ``---`` lines the header is empty and the body is everything.

    Lines part at their first colon; of a repeated name the last value counts.
    """
    has = content.rlike(r"(?s)\A---\n.*?\n---\n") | content.startswith("---\n---\n")
    head = F.regexp_extract(content, r"(?s)\A---\n(.*?)---\n", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: F.instr(x, ":") > 0)
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            F.trim(F.substring_index(x, ":", 1)).alias("k"), T.strip(F.substr(x, F.instr(x, ":") + 1)).alias("v")
        ),
    )
    last = F.filter(
        pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"])
    )
    empty = F.create_map().cast("map<string,string>")
    body = F.regexp_replace(content, r"(?s)\A---\n.*?---\n", "")
    return F.when(has, F.map_from_entries(last)).otherwise(empty), F.when(has, body).otherwise(content)


def effective_status(status: Column, stage: Column) -> Column:
    s = F.coalesce(T.strip(status), F.lit(""))
    return F.when(s.isin("", "raw"), F.regexp_replace(F.coalesce(stage, F.lit("raw")), "-", "_")).otherwise(s)


def header_text(header: Column, name: str) -> Column:
    """A header value as text: JSON text without its quotes, anything else as it is written; missing ones are empty."""
    raw = F.coalesce(header[name], F.lit(""))
    quoted = F.try_variant_get(F.try_parse_json(raw), "$", "string")
    return F.when(raw.startswith('"') & quoted.isNotNull(), quoted).otherwise(raw)


def header_list(header: Column, name: str) -> Column:
    """The items of a header value that is a JSON list, else null; a list that is no JSON stays a text."""
    raw = F.coalesce(header[name], F.lit(""))
    items = F.try_variant_get(F.when(raw.startswith("["), F.try_parse_json(raw)), "$", "array<string>")
    return F.filter(items, lambda x: x.isNotNull())


def to_notes(articles: DataFrame) -> DataFrame:
    """Typed notes of ``articles(article_key, content)``; other columns stay.

    A title falls back to the key.  Facets hold the items of a list or the one
    text; idea blocks, hooks, targets and failure modes must be lists.  The
    main content is the body's section of that name.
    """
    header, body = parse_frontmatter(F.coalesce("content", F.lit("")))
    h = F.col("_h")
    given = articles.drop("header", "body").withColumn("_h", header).withColumn("body", body)
    facet = lambda n: F.coalesce(header_list(h, n), F.filter(F.array(header_text(h, n)), lambda x: x != ""))
    stage = header_text(h, "status")
    fields = {
        "title": F.coalesce(F.nullif(T.strip(header_text(h, "title")), F.lit("")), F.col("article_key")),
        "status": effective_status(stage, F.when(T.strip(stage) == "", "raw").otherwise(T.strip(stage))),
        **{n: header_text(h, n) for n in HEADER_TEXTS},
        **{n: facet(n) for n in FACETS},
        **{n: header_list(h, n) for n in HEADER_LISTS},
        "main_content": T.extract_section(F.col("body"), "Main Content"),
    }
    kept = [F.col(f"`{c}`") for c in given.columns if c not in (*fields, "_h")]
    return given.select(*kept, *[c.alias(n) for n, c in fields.items()])


def filter_status(notes: DataFrame, stages: list[str]) -> DataFrame:
    """Notes of these stages; all of them if none is named."""
    s = F.regexp_replace(F.coalesce("status", F.lit("")), "-", "_")
    s = F.when(s == "", "raw").otherwise(s)
    return notes.where(s.isin([x.replace("-", "_") for x in stages])) if stages else notes


def filter_notes(notes: DataFrame, **facets: list[str]) -> DataFrame:
    """Reviewed and high-value notes that match each facet; values of one facet are alternatives."""
    out = notes.where(F.col("status").isin(*SYNCABLE))
    for name, wanted in facets.items():
        if wanted:
            many = notes.schema[name].dataType.typeName() == "array"
            hit = F.arrays_overlap(name, F.array(*map(F.lit, wanted))) if many else F.col(name).isin(wanted)
            out = out.where(hit)
    return out


def sync_plan(notes: DataFrame) -> DataFrame:
    """What to do with each article: (article_key, status, target, action, reason)."""
    s = F.regexp_replace("status", "-", "_")
    missing = F.col("main_content").isNull()
    action = F.when(missing, "skip").when(s == "rejected", "delete").when(s.isin(*SYNCABLE), "move").otherwise("skip")
    reason = F.when(missing, "article missing").when(action == "skip", "status not syncable").otherwise("")
    return notes.select(
        "article_key",
        s.alias("status"),
        F.when(action == "move", s).otherwise("").alias("target"),
        action.alias("action"),
        reason.alias("reason"),
    )


def stage_listing(notes: DataFrame) -> DataFrame:
    return notes.groupBy("status").agg(F.count("*").alias("n"))


def stage_rows(notes: DataFrame, status: str) -> DataFrame:
    """(article_key, content_type, title, brainstorm_value) of a stage's notes, as a listing shows them."""
    return notes.where(F.col("status") == status).select("article_key", "content_type", "title", "brainstorm_value")
