"""Text, date and score expressions; all stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days after which a compiled concept has lost half of its freshness.
HALF_LIFE_DAYS = 60


def tokenize(text: Column) -> Column:
    """Distinct lower-case tokens: runs of a-z, 0-9 and _, and pairs of neighbouring CJK characters (a lone one stays)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), 0)
    runs = F.regexp_extract_all(low, F.lit("[\\x{4E00}-\\x{9FFF}]+"), 0)
    pairs = F.flatten(
        F.transform(
            runs,
            lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(
                F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2)))
            ),
        )
    )
    return F.array_distinct(F.concat(words, pairs))


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode kinds included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def clean_text(text: Column) -> Column:
    """Unix newlines, no blanks before them, at most one empty line in a row."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.regexp_replace(t, "[ \\t]+\n", "\n")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def sanitize_title(title: Column) -> Column:
    """A title that can name a file, of at most 80 characters; ``untitled`` if nothing is left."""
    t = F.regexp_replace(F.coalesce(title, F.lit("")), r'[\\/:*?"<>|\x00-\x1f]', "_")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), "_+", "_")
    t = F.regexp_replace(F.substring(t, 1, 80), r"^[ ._]+|[ ._]+\z", "")
    return F.when(t == "", "untitled").otherwise(t)


def slugify(text: Column, size: int = 60) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one hyphen, cut to ``size``."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(t, r"^-+|-+\z", ""), 1, size), r"-+\z", "")


def query_slug(query: Column, size: int = 60) -> Column:
    """A question's short name in the log: letters, digits, _ and CJK in lower case, all else one underscore; ``query`` if nothing is left."""
    t = F.regexp_replace(F.lower(strip(F.coalesce(query, F.lit("")))), r"(?U)[^\w\x{4E00}-\x{9FFF}]+", "_")
    t = F.substring(F.regexp_replace(t, r"^_+|_+\z", ""), 1, size)
    return F.when(t == "", "query").otherwise(t)


def output_slug(query: Column) -> Column:
    """A question's name in an output file, of at most 80 characters; ``result`` if nothing is left."""
    t = F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), r'[\\/:*?"<>|：？“”‘’《》【】｜]+', "_")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", "_"), "_+", "_")
    t = F.substring(F.regexp_replace(t, r"^[ ._]+|[ ._]+\z", ""), 1, 80)
    return F.when(t == "", "result").otherwise(t)


def normalize_date(text: Column) -> Column:
    """The first date with year, month and day as ISO text, or an empty one."""
    p = r"(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})"
    y, m, d = (F.regexp_extract(text, p, i) for i in (1, 2, 3))
    return F.when(y == "", "").otherwise(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def extract_section(body: Column, heading: str) -> Column:
    """What stands under ``## heading``, up to the next such heading."""
    return strip(F.regexp_extract(body, rf"(?s)(?:^|\n)## {heading}\n\n(.*?)(?=\n## |\z)", 1))


def bullet_sources(bullet: Column) -> Column:
    """Names in the anchor ``[a, b]`` that ends a bullet."""
    inside = F.regexp_extract(bullet, r"\[([^\[\]]*)\]\s*\z", 1)
    return F.filter(F.transform(F.split(inside, ","), lambda x: F.trim(x)), lambda x: x != "")


def valid_slug(slug: Column) -> Column:
    return slug.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*\z")


def freshness(last_compiled: Column, as_of: Column) -> Column:
    """Halves every 60 days; 0 without a valid date."""
    days = F.datediff(as_of, F.try_to_date(last_compiled))
    value = F.exp(-math.log(2) * F.greatest(days, F.lit(0)) / HALF_LIFE_DAYS)
    return F.when(days.isNull(), 0.0).otherwise(value)  # greatest skips nulls


def memory_score(confidence: Column, importance: Column, fresh: Column, sources: Column, conflicts: Column) -> Column:
    """How much a concept's state speaks for it, 0 or more."""
    s = 0.35 * confidence + 0.25 * importance + 0.2 * fresh + 0.2 * (1 - F.exp(-sources / 4.0))
    return F.greatest(s - 0.15 * F.least(conflicts, F.lit(3)), F.lit(0.0))


def route_url(url: Column) -> Column:
    """Which extractor a page needs: wechat, pdf or web."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    path = F.lower(F.element_at(F.split(F.coalesce(url, F.lit("")), "[?]"), 1))
    return F.when(host.endswith("mp.weixin.qq.com"), "wechat").when(path.endswith(".pdf"), "pdf").otherwise("web")


def unfenced(raw: Column) -> Column:
    """Without the fence that models put around JSON."""
    return F.regexp_replace(strip(raw), r"^```[a-zA-Z]*\s*|\s*```\z", "")


def hundredths(x: Column) -> Column:
    """A number to two places by its exact binary value, halves to the even one, as Python rounds.

    ``x * 100`` is added up from products with powers of two, which are exact,
    and what the additions lose decides where the sum looks like a half.
    """

    def lost(a: Column, b: Column) -> Column:
        total = a + b
        part = total - a
        return (a - (total - part)) + (b - part)

    a, b, c = x * 64.0, x * 32.0, x * 4.0
    total, rest = a + b + c, lost(a, b) + lost(a + b, c)
    low = F.floor(total).cast("double")
    half = total - low == 0.5
    nearest = F.when(half & (rest > 0), low + 1).when(half & (rest < 0), low).otherwise(F.rint(total))
    return nearest / 100.0
