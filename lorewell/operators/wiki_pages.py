"""Concepts and source summaries as Markdown pages, back again, and lint rules over the pages themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import text as T

# Header fields and sections of a concept page, in page order.
CONCEPT_TEXTS = ("title", "slug", "status", "last_compiled")
CONCEPT_LISTS = ("aliases", "related_concepts", "sources", "content_types")
TEXT_SECTIONS = {"synthesis": "Synthesis", "definition": "Definition"}
LIST_SECTIONS = {
    "key_idea_blocks": "Key Idea Blocks", "variants": "Variants & Implementations", "common_combinations": "Common Combinations",
    "transfer_targets": "Transfer Targets", "failure_modes": "Failure Modes", "open_questions": "Open Questions",
    "source_basenames": "Sources",
}
STATUSES = ("stable", "proposed", "deprecated")
# Header fields of a source page, and the marks of its parts.
SOURCE_TEXTS = ("source_path", "title", "content_type", "brainstorm_value", "ingested", "last_compiled")
SOURCE_MARKS = ("One-line takeaway", "Idea Blocks", "Why it's in the KB", "Feeds concepts")
VALUES = ("low", "medium", "high", "")
MAX_BYTES = 8192


def _text(name: str, columns: list[str]) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in columns else F.lit("")


def _list(name: str, columns: list[str]) -> Column:
    empty = F.array().cast("array<string>")
    return F.coalesce(F.col(name), empty) if name in columns else empty


def _flow(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def _bullets(items: Column) -> Column:
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(items) == 0, "- _none_").otherwise(lines)


def _or(text: Column, other: str) -> Column:
    return F.when(text == "", other).otherwise(text)


def _page(header: list[tuple[str, Column]], parts: list[Column]) -> Column:
    lines = [F.concat(F.lit(f"{name}:"), F.when(value.startswith("\n"), value).otherwise(F.concat(F.lit(" "), value))) for name, value in header]
    return F.concat(F.concat_ws("\n", F.lit("---"), *lines, F.lit("---\n\n")), F.concat_ws("\n\n", *parts), F.lit("\n"))


def render_concept_pages(concepts: DataFrame) -> DataFrame:
    """(page_path, content) of each concept; lists without items read ``- _none_``, blank texts ``_pending_``."""
    c = concepts.columns
    sources = _list("sources", c)
    block = F.concat(F.lit("\n"), F.array_join(F.transform(sources, lambda x: F.concat(F.lit("  - "), x)), "\n"))
    header = [
        ("title", _text("title", c)), ("slug", _text("slug", c)), ("aliases", _flow(_list("aliases", c))),
        ("status", _text("status", c)), ("related_concepts", _flow(_list("related_concepts", c))),
        ("sources", F.when(F.size(sources) == 0, "[]").otherwise(block)), ("content_types", _flow(_list("content_types", c))),
        ("last_compiled", _text("last_compiled", c)), ("compile_version", _or(_text("compile_version", c), "0")),
    ]
    parts = [F.concat(F.lit("# "), _text("title", c))]
    for name, heading in TEXT_SECTIONS.items():
        parts += [F.lit(f"## {heading}"), _or(_text(name, c), "_pending_")]
    for name, heading in LIST_SECTIONS.items():
        items = _list(name, c)
        if name == "source_basenames":
            items = F.transform(items, lambda b: F.concat(F.lit("[["), b, F.lit("]]")))
        parts += [F.lit(f"## {heading}"), _bullets(items)]
    path = F.concat(F.lit("wiki/concepts/"), F.col("slug"), F.lit(".md"))
    return concepts.select(path.alias("page_path"), _page(header, parts).alias("content"))


def render_source_pages(summaries: DataFrame) -> DataFrame:
    """(page_path, content) of each source summary, which ``name`` names; the first three ideas are shown."""
    c = summaries.columns
    feeds = _list("feeds_concepts", c)
    header = [(n, _text(n, c)) for n in SOURCE_TEXTS]
    header.insert(4, ("feeds_concepts", _flow(feeds)))
    links = F.array_join(F.transform(feeds, lambda x: F.concat(F.lit("[["), x, F.lit("]]"))), ", ")
    takeaway, ideas, why, fed = (F.lit(f"**{m}:** ") for m in ("One-line takeaway", "Idea Blocks (top 3)", "Why it's in the KB", "Feeds concepts"))
    parts = [
        F.concat(F.lit("# "), _text("title", c), F.lit(" — Source Summary")),
        F.concat(takeaway, _or(_text("takeaway", c), "_none_")),
        F.rtrim(ideas),
        _bullets(F.slice(_list("top_idea_blocks", c), 1, 3)),
        F.concat(why, _or(_text("why_in_kb", c), "_none_")),
        F.concat(fed, _or(links, "_none_")),
    ]
    path = F.concat(F.lit("wiki/sources/"), F.col("name"), F.lit(".md"))
    return summaries.select(path.alias("page_path"), _page(header, parts).alias("content"))


def _head(content: Column) -> Column:
    return F.regexp_extract(content, r"(?s)\A---\n(.*?)---\n", 1)


def _body(content: Column) -> Column:
    return F.regexp_replace(content, r"(?s)\A---\n.*?---\n", "")


def _field(head: Column, name: str) -> Column:
    return F.regexp_replace(T.strip(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*)$", 1)), "^([\"'])(.*)\\1\\z", "$2")


def _leading(lines: Column, wanted) -> Column:
    """The lines before the first that is not wanted."""
    end = F.array_position(F.transform(lines, wanted), False).cast("int")
    return F.when(end > 0, F.slice(lines, 1, F.greatest(end - 1, F.lit(0)))).otherwise(lines)


def _after(lines: Column, found) -> Column:
    """The lines behind the first that is found; none without it."""
    at = F.array_position(F.transform(lines, found), True).cast("int")
    return F.when(at > 0, F.slice(lines, at + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))


def _is_item(line: Column) -> Column:
    return F.ltrim(line).startswith("- ")


def _field_list(head: Column, name: str) -> Column:
    """Items of ``[a, b]``, of indented lines that begin with a hyphen, or a single text."""
    inline = _field(head, name)
    lines = _leading(_after(F.split(head, "\n"), lambda x: F.rtrim(x) == f"{name}:"), _is_item)
    items = (
        F.when(F.size(lines) > 0, F.transform(lines, lambda x: F.substr(F.ltrim(x), F.lit(3))))
        .when(inline.startswith("["), F.split(F.regexp_replace(inline, r"^\[|\]\z", ""), ","))
        .otherwise(F.array(inline))
    )
    clean = F.transform(items, lambda x: F.regexp_replace(T.strip(x), "^([\"'])(.*)\\1\\z", "$2"))
    return F.filter(clean, lambda x: x != "")


def _items(text: Column) -> Column:
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*- (.*)$"), 1)
    return F.filter(F.transform(lines, T.strip), lambda x: ~x.isin("", "_none_"))


def parse_concept_pages(pages: DataFrame) -> DataFrame:
    """Concept columns of ``pages(page_path, content)`` and ``error``.

    A page with a bad slug, status or version keeps its row and has an error; null
    content counts as an empty page.  A missing status is ``proposed``.
    """
    content = F.coalesce("content", F.lit(""))
    head, body = F.col("_h"), F.col("_b")
    fields = {n: _field(head, n) for n in CONCEPT_TEXTS} | {n: _field_list(head, n) for n in CONCEPT_LISTS}
    fields["status"] = _or(fields["status"], "proposed")
    version = _or(_field(head, "compile_version"), "0")
    fields["compile_version"] = version.try_cast("int")
    fields |= {n: T.extract_section(body, rf"\Q{h}\E") for n, h in TEXT_SECTIONS.items()}
    fields |= {n: _items(T.extract_section(body, rf"\Q{h}\E")) for n, h in LIST_SECTIONS.items()}
    links = F.transform(fields["source_basenames"], lambda x: F.regexp_extract(x, r"^\[\[(.+?)\]\]", 1))
    fields["source_basenames"] = F.filter(links, lambda x: x != "")
    fields["error"] = (
        F.when(~fields["status"].isin(*STATUSES), "invalid status")
        .when(~T.valid_slug(fields["slug"]), "invalid slug")
        .when(fields["compile_version"].isNull(), "invalid version")
    )
    split = pages.select("page_path", content.alias("content"), _head(content).alias("_h"), _body(content).alias("_b"))
    return split.select("page_path", "content", *[c.alias(n) for n, c in fields.items()])


def parse_source_pages(pages: DataFrame) -> DataFrame:
    """Summary columns of ``pages(page_path, content)`` and ``error``, set where a page has no header."""
    content = F.coalesce("content", F.lit(""))
    head, body = F.col("_h"), F.col("_b")
    fields = {n: _field(head, n) for n in SOURCE_TEXTS} | {"feeds_concepts": _field_list(head, "feeds_concepts")}
    for name, mark in (("takeaway", "One-line takeaway"), ("why_in_kb", "Why it's in the KB")):
        value = T.strip(F.regexp_extract(body, rf"\*\*{mark}:\*\* (.*)", 1))
        fields[name] = F.when(value == "_none_", "").otherwise(value)
    behind = F.filter(_after(F.split(body, "\n"), lambda x: F.rtrim(x) == "**Idea Blocks (top 3):**"), lambda x, i: (i > 0) | (x != ""))
    fields["top_idea_blocks"] = _items(F.array_join(_leading(behind, lambda x: x.startswith("- ")), "\n"))
    fields["error"] = F.when(head == "", "no header")
    split = pages.select("page_path", content.alias("content"), _head(content).alias("_h"), _body(content).alias("_b"))
    return split.select("page_path", "content", *[c.alias(n) for n, c in fields.items()])


def _issues(pages: DataFrame, rules: list[tuple[Column, str, str, Column]]) -> DataFrame:
    """(severity, kind, page_path, message): one scan, a row for each rule that a page breaks."""
    hits = F.array(
        *[
            F.when(cond, F.struct(F.lit(s).alias("severity"), F.lit(k).alias("kind"), m.alias("message")))
            for cond, s, k, m in rules
        ]
    )
    rows = pages.select("page_path", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("x"))
    return rows.select("x.severity", "x.kind", "page_path", "x.message")


def lint_concept_pages(parsed: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Malformed and oversized pages, missing sections, and empty texts of compiled concepts."""
    good = F.col("error").isNull()
    compiled = good & (F.col("status") == "stable") & (F.col("compile_version") > 0)
    rules = [
        (~good, "error", "malformed_concept", F.col("error")),
        (good & (F.octet_length("content") > max_bytes), "warning", "oversized_concepts", F.octet_length("content").cast("string")),
    ]
    for heading in [*TEXT_SECTIONS.values(), *LIST_SECTIONS.values()]:
        missing = ~F.concat(F.lit("\n"), F.col("content")).contains(f"\n## {heading}\n")
        rules.append((good & (F.col("status") != "deprecated") & missing, "warning", "schema_missing_section", F.lit(heading)))
    for name in TEXT_SECTIONS:
        blank = (F.col(name) == "") | F.col(name).startswith("_pending")
        rules.append((compiled & blank, "warning", f"schema_empty_{name}", F.lit(name)))
    return _issues(parsed, rules)


def lint_source_pages(parsed: DataFrame) -> DataFrame:
    """Malformed pages, values out of range and missing parts."""
    good = F.col("error").isNull()
    rules = [
        (~good, "warning", "malformed_source_summary", F.col("error")),
        (good & ~F.col("brainstorm_value").isin(*VALUES), "warning", "schema_invalid_enum", F.col("brainstorm_value")),
    ]
    for mark in SOURCE_MARKS:
        rules.append((good & ~F.col("content").contains(f"**{mark}"), "info", "schema_missing_section", F.lit(mark)))
    return _issues(parsed, rules)
