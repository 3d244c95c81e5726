"""Ideas in a model's written answers, and what the knowledge base says about them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.operators import ideas as I

# Headings of an English answer's parts, and how those that end a part begin.
TITLE_LABEL = "idea title"
EN_LABELS = {
    "inspired by": "inspired_by", "core combination logic": "core_logic", "what is new": "what_is_new",
    "why it might make sense": "why_it_might_work", "what could break": "what_could_break", "possible variants": "possible_variants",
}
EN_ENDS = (TITLE_LABEL, "inspired by", "core combination", "what is new", "why it might", "what could break", "possible variants")
# Labels of a Chinese answer's parts, words and numerals that head an idea.
CN_LABELS = {
    "灵感来源": "inspired_by", "来源": "inspired_by", "inspired by": "inspired_by", "核心逻辑": "core_logic", "组合逻辑": "core_logic",
    "core logic": "core_logic", "创新点": "what_is_new", "新意": "what_is_new", "what is new": "what_is_new",
    "可行性": "why_it_might_work", "为什么可行": "why_it_might_work", "why": "why_it_might_work", "潜在风险": "what_could_break",
    "风险点": "what_could_break", "风险": "what_could_break", "what could break": "what_could_break", "变体": "possible_variants",
    "可能的变体": "possible_variants", "possible variants": "possible_variants",
}
CN_IDEA_WORDS = ("策略", "想法", "Idea")
NUMERALS = "一二三四五六七八九十0123456789"
COLONS = "：:"
FIELDS = ("inspired_by", "core_logic", "what_is_new", "why_it_might_work", "what_could_break", "possible_variants")
NAMES = ("title", *FIELDS, "raw")


def _label(line: str) -> str:
    """A heading in plain lower case, without bold marks around it."""
    return " ".join(line.strip().removeprefix("**").removesuffix("**").lower().split())


def _starts_english_idea(line: str) -> bool:
    marks = len(line) - len(line.lstrip("#"))
    return (marks in (0, 2, 3)) and _label(line[marks:].lstrip(" *") if marks or line[:1] == "*" else line).startswith(TITLE_LABEL)


def _chunks(lines: list[str], starts) -> list[list[str]]:
    """Lines from one idea's heading to before the next; what comes before the first goes."""
    out: list[list[str]] = []
    for line in lines:
        if starts(line):
            out.append([])
        if out:
            out[-1].append(line)
    return out


def _english(chunk: list[str]) -> dict[str, str]:
    found: dict[str, list[str]] = {}
    field = "title"
    for line in chunk[1:]:
        label = _label(line)
        if line.startswith(("---", "***")):
            field = None
        elif label in EN_LABELS and not line.startswith("#"):
            field = EN_LABELS[label] if EN_LABELS[label] not in found else None
        elif label.startswith(EN_ENDS) and not line.startswith("#"):
            field = None
        elif field == "title":
            if line.strip():
                found["title"], field = [line], None
        elif field:
            found.setdefault(field, []).append(line)
    return {name: "\n".join(part).strip() for name, part in found.items()}


def _chinese_title(line: str) -> str | None:
    """What stands after ``## ... <word> <numeral>:``, or None if the line is no such heading."""
    rest = line.lstrip("#")
    if len(line) - len(rest) not in (2, 3):
        return None
    at = min((k for k in map(rest.find, COLONS) if k >= 0), default=-1)
    named = rest[:at].rstrip(NUMERALS) if at >= 0 else ""
    if at < 0 or len(named) == at:
        return None
    named = named.rstrip()
    word = next((w for w in CN_IDEA_WORDS if named.endswith(w)), None)
    if word is None or len(named.removesuffix(word).strip().removeprefix("💡").strip().split()) > 1:
        return None
    return rest[at + 1 :].strip()


def _chinese(chunk: list[str]) -> dict[str, str]:
    """Fields of one line each: behind their bold label, or if nothing is there, the next line with text."""
    found = {"title": _chinese_title(chunk[0]) or ""}
    for k, line in enumerate(chunk):
        parts = line.split("**")
        for i in range(1, len(parts) - 1, 2):
            field = CN_LABELS.get(_label(parts[i].rstrip(COLONS)))
            if field and field not in found:
                behind = "**".join(parts[i + 1 :]).lstrip(COLONS + " \t")
                following = (x.strip() for x in chunk[k + 1 :] if x.strip())
                found[field] = behind.strip() or next(following, "")
    return found


def ideas_of(text: str | None) -> list[dict[str, str]]:
    """Ideas with a title, in order; English forms count first, then Chinese ones."""
    lines = (text or "").strip().split("\n")
    for starts, fields in ((_starts_english_idea, _english), (lambda x: _chinese_title(x) is not None, _chinese)):
        out = []
        for chunk in _chunks(lines, starts):
            got = fields(chunk)
            if got.get("title"):
                out.append({n: got.get(n, "") for n in NAMES[:-1]} | {"raw": "\n".join(chunk).strip()})
        if out:
            return out
    return []


IDEAS = f"array<struct<{', '.join(f'{n}: string' for n in NAMES)}>>"


def _ideas(texts: pd.Series) -> pd.Series:
    return texts.map(ideas_of)


def parse_ideas(outputs: DataFrame) -> DataFrame:
    """(output_id, place, title, six fields, raw) of ``outputs(output_id, text)``: a row an idea with a title.

    A heading ends the part before it, and so does a rule of hyphens or stars.
    Missing fields are empty; a null or blank answer gives nothing.
    """
    found = outputs.select("output_id", F.posexplode(F.pandas_udf(_ideas, IDEAS)("text")).alias("place", "i"))
    return found.select("output_id", "place", "i.*")


def rethink(outputs: DataFrame, retrieved: DataFrame, matches: DataFrame, judged: DataFrame) -> DataFrame:
    """Every idea of ``outputs`` with traceability, novelty and quality; an idea is named ``output_id#place``.

    ``retrieved(query_id, title)`` holds the titles behind each output,
    ``matches(idea_id, id, score)`` its neighbours in the index, and
    ``judged(idea_id, coherence, actionability)`` a judge's view.  Outputs without
    ideas give no rows; see :func:`rethink_reports`.
    """
    found = parse_ideas(outputs).withColumn("idea_id", F.concat_ws("#", "output_id", "place"))
    found = found.withColumn("query_id", F.col("output_id"))
    traced = I.traceability(found, retrieved)
    return (
        found.drop("query_id")
        .join(traced, "idea_id")
        .join(I.novelty(found, matches), "idea_id")
        .join(I.composite(traced, judged), "idea_id")
    )


def judged_ideas(outputs: DataFrame, answers: DataFrame) -> DataFrame:
    """What ``answers(output_id, raw)`` of a judge say of the ideas of ``outputs``; see :func:`lorewell.operators.ideas.parse_judged`."""
    found = parse_ideas(outputs).select("output_id", "place", F.concat_ws("#", "output_id", "place").alias("idea_id"))
    return I.parse_judged(answers, found)


def rethink_reports(outputs: DataFrame, rethought: DataFrame) -> DataFrame:
    """(output_id, text): answers with a report on their ideas behind them; answers without ideas pass through unchanged."""
    line = F.concat_ws(
        "\n",
        F.concat(F.lit("### Idea "), (F.col("place") + 1).cast("string"), F.lit(": "), "title"),
        F.format_string("- **Quality Score**: %.2f (Traceability: %.1f)", "quality", "traceability"),
        F.when(F.col("novel"), "- **Novelty**: Novel — no close matches found").otherwise(
            F.concat(F.lit("- **Novelty**: Similar to existing — "), F.col("best_id").cast("string"))
        ),
    )
    reports = rethought.groupBy("output_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("_r"))
    body = F.concat(F.lit("\n\n## Rethink Report\n\n"), F.array_join(F.col("_r.line"), "\n\n"))
    joined = outputs.select("output_id", "text").join(reports, "output_id", "left")
    text = F.when(F.col("_r").isNull(), F.col("text")).otherwise(F.concat(F.rtrim("text"), body))
    return joined.select("output_id", text.alias("text"))
