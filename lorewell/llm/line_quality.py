"""Quality rules over words and over lines that many documents of a host share.

One Arrow pass gives each document its counts and the hashes of its normalised
lines (lower-case A-Z, words joined by one blank).  Counting the different
documents per host and line groups by (host, line) with partial counts in the
map tasks; equal texts count as one document, so copies of a text do not make
its lines boilerplate.  Lines above the limit are removed, and a document that
loses more than a share of its words is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm import common, kernel
from lorewell.llm.line_spread import without_lines  # noqa: F401  the lines that :func:`line_quality` names can be taken out with it

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_U = np.uint64


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def measure(data: np.ndarray, offsets: np.ndarray) -> dict:
    """Counts of each text of a pass, and (row, number, hash, words) of its lines that have words."""
    n = len(offsets) - 1
    rolling = kernel.RollingHash(data)
    w = kernel.Words(data, offsets, kernel.NON_SPACE)
    out = {"n_words": w.count}
    lead = kernel.NON_SPACE[data] & ((data & 0xC0) != 0x80)
    out["word_chars"] = _per_row(lead, offsets)
    out["n_symbols"] = _per_row(_SYMBOL[data], offsets)
    # words in three-word windows that the text has twice or more
    grams, owner = kernel.shingles(w.hashes(rolling), w.first, 3, whole=False)
    order = np.lexsort((grams, owner))
    same = (grams[order][1:] == grams[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    per = np.maximum(w.count - 2, 0)
    place = w.first[:-1][owner[at]] + at - (np.cumsum(per) - per)[owner[at]]
    covered = np.zeros(len(w.start), bool)
    for k in range(3):
        covered[place + k] = True
    out["n_repeat_words"] = _per_row(covered, w.first)
    # lines: between newlines and the ends of texts
    newline = np.flatnonzero(data == 10)
    row_of = np.searchsorted(offsets, newline, "right") - 1
    begin = np.concatenate([offsets[:-1], newline + 1])
    row = np.concatenate([np.arange(n), row_of])
    order = np.lexsort((begin, row))
    begin, row = begin[order], row[order]
    first_line = np.searchsorted(row, np.arange(n))
    number = np.arange(len(row)) - first_line[row]
    end = np.empty(len(begin), np.int64)
    end[:-1] = begin[1:] - 1
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    end[last] = offsets[1:][row[last]]
    a, b = np.searchsorted(w.start, begin), np.searchsorted(w.start, end)
    has = b > a
    begin, end, row, number, a, b = (x[has] for x in (begin, end, row, number, a, b))
    raw = rolling.ranges(begin, end)
    order = np.lexsort((number, raw, row))
    again = (raw[order][1:] == raw[order][:-1]) & (row[order][1:] == row[order][:-1])
    out["n_dup_lines"] = np.bincount(row[order[1:][again]], minlength=n)
    # hash of the normalised line, from the hashes of its lower-cased words
    low = kernel.RollingHash(kernel.LOWER[data]).ranges(w.start, w.end)
    up, down = kernel._Powers.of(len(low) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(low * up[: len(low)])]) if len(low) else np.zeros(1, _U)
    norm = kernel.mix((sums[b] - sums[a]) * down[a] + (b - a).astype(_U))
    out["lines"] = (row, number, norm, b - a)
    out["text_hash"] = rolling.ranges(offsets[:-1], offsets[1:])
    return out


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(batches):
    for batch in batches:
        data, offsets = kernel.utf8(batch["_t"])
        for a, b in kernel.passes(offsets):
            m = measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            row, number, norm, words = m["lines"]
            cols = [batch[c].slice(a, b - a) for c in ("_key", "_id", "_host")]
            cols += [pa.array(np.asarray(m[c], np.int64)) for c in _COUNTS]
            cols.append(pa.array(m["text_hash"].view(np.int64)))
            for x, kind in ((norm.view(np.int64), np.int64), (number, np.int32), (words, np.int32)):
                cols.append(kernel.lists(x.astype(kind), row, b - a))
            yield pa.RecordBatch.from_arrays(
                cols, ["_key", "_id", "_host", *_COUNTS, "text_hash", "line", "number", "words"]
            )


def line_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = 10,
    min_left: float = 0.5,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """Counts, base rule and verdict for every document.

    Returns per row ``id_col``, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_shared_words (words in lines above the
    limit) and shared_lines (numbers of these lines, from 0).  A line is above
    the limit if over ``max_docs`` different texts of its host have it; a
    document is rejected if less than ``min_left`` of its words are left.  Null
    and empty texts have no words and fail the base rule.  Rows without a host
    form one host.  Rows that repeat an id are documents of their own.  An empty
    table gives an empty result; other columns are ignored.
    """
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("_host")
    keyed, _ = common.row_keyed(
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), host), "_id", "_t"
    )
    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    m = common.saved(
        keyed.select("_key", "_id", "_host", "_t").mapInArrow(
            _measured,
            f"_key long, _id {kind}, _host string, {counts}, text_hash long, "
            "line array<long>, number array<int>, words array<int>",
        ),
        "measures",
    )
    texts = m.groupBy("_host", "text_hash").agg(F.min("_key").alias("_key"))
    lines = (
        m.join(texts.select("_key"), "_key", "left_semi")
        .select("_host", F.explode(F.array_distinct("line")).alias("line"))
        .groupBy("_host", "line")
        .agg(F.count("*").alias("docs"))
        .where(F.col("docs") > max_docs)
        .select("_host", "line")
    )
    lines = common.if_small(common.saved(lines, "shared-lines"))
    each = m.select("_key", "_host", F.explode(F.arrays_zip("line", "number", "words")).alias("x")).select(
        "_key", "_host", "x.line", "x.number", "x.words"
    )
    shared = (
        each.join(lines, ["_host", "line"])
        .groupBy("_key")
        .agg(F.sum("words").alias("gone"), F.array_sort(F.collect_list("number")).alias("shared_lines"))
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    gone = F.coalesce("gone", F.lit(0).cast("long"))
    left = F.col("n_words") - gone >= min_left * F.col("n_words")
    return m.join(shared, "_key", "left").select(
        F.col("_id").alias(id_col),
        *_COUNTS,
        failed.alias("base_failed"),
        (~failed & left).alias("kept"),
        gone.alias("n_shared_words"),
        F.coalesce("shared_lines", F.array().cast("array<int>")).alias("shared_lines"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
grams AS (SELECT doc_id, k, array_to_string(w[k:k+2], ' ') AS g FROM w, unnest(range(1, len(w) - 1)) AS r(k)),
twice AS (SELECT doc_id, k FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT k + i) AS n FROM twice, unnest([0, 1, 2]) AS r(i) GROUP BY doc_id),
lines AS (
  SELECT doc_id, host, t, number, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM (SELECT *, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS number FROM d)),
filled AS (SELECT * FROM lines WHERE words > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM filled GROUP BY doc_id),
shared AS (SELECT host, norm FROM filled GROUP BY host, norm HAVING count(DISTINCT t) > {max_docs}),
gone AS (
  SELECT doc_id, sum(words) AS n, string_agg(cast(number AS varchar), ',' ORDER BY number) AS numbers
  FROM filled SEMI JOIN shared USING (host, norm) GROUP BY doc_id),
counts AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS gone, coalesce(numbers, '') AS numbers
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, cast(n_words AS bigint) AS n_words, cast(word_chars AS bigint) AS word_chars,
  cast(n_symbols AS bigint) AS n_symbols, cast(n_dup_lines AS bigint) AS n_dup_lines,
  cast(n_repeat_words AS bigint) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - gone >= {min_left} * n_words AS kept,
  cast(gone AS bigint) AS n_shared_words, numbers AS shared_lines
FROM counts
"""
