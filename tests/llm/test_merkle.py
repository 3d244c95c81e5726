"""Merkle manifests against trees built one hash at a time."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lorewell.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, rank string, total string, grp string, above string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """(root, siblings below each node's path as (left, right) pairs)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, path in enumerate(paths):
            run = at[k] // 8 * 8
            path.append(("".join(level[run : at[k]]), "".join(level[at[k] + 1 : run + 8])))
            at[k] //= 8
        level = [h(*level[a : a + 8]) for a in range(0, len(level), 8)]
    return level[0] if level else None, paths


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[g] = tree([leaf(r) for r in groups[g]])
    root, above = tree([made[g][0] for g in order])
    out = []
    for g, over in zip(order, above):
        for r, path in zip(groups[g], made[g][1]):
            path = path + over
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            # bytes.lower() changes A to Z alone
            now = leaf((*r[:4], r[4].encode().lower().decode())) if hit else leaf(r)
            for left, right in path:
                now = h(left, now, right)
            proof = h(*[x for pair in path for x in pair])
            out.append((r[0], leaf(r), made[g][0], root, proof, now, now == root))
    return sorted(out, key=repr)


def got(spark, rows):
    frame = spark.createDataFrame([(*r, "c", "c", "c", "c") for r in rows], SCHEMA).repartition(3)
    out = merkle.documents_manifest(frame)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=repr)


def documents(n, lang, first=0):
    return [(first + k, f"s{k % 3}", lang, k, f"Text {k} ÄÉ" if k % 5 else f"text {k}") for k in range(n)]


@pytest.mark.parametrize("n", [1, 2, 9, 65, 512, 513, 4200])
def test_one_group(spark, n):
    rows = documents(n, "en")
    assert got(spark, rows) == expected(rows)


def test_groups_of_all_heights(spark):
    sizes = [1, 1, 7, 8, 9, 64, 65, 600, 3, 2, 1]
    names = [None, "", "en", "fr", "de", "é", "z", "\U0001f600", "￮", "a", "b"]
    rows = [r for k, (n, name) in enumerate(zip(sizes, names)) for r in documents(n, name, 10_000 * k)]
    assert got(spark, rows) == expected(rows)


def test_many_groups(spark):
    rows = [r for k in range(700) for r in documents(1 + k % 2, f"g{k:03d}", 10 * k)]
    assert got(spark, rows) == expected(rows)


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None)] * 3 + [(5, "s", "en", 1, "A")] * 4 + [(5, "s", "en", 1, "a"), (None, "s", "en", 1, "")]
    rows += [(6, "s", "en", None, "X" * 100_000), (7, "", "en", -3, "\n")]
    assert got(spark, rows) == expected(rows)


def test_no_rows(spark):
    assert got(spark, []) == []


def test_tampering_with_any_field_is_seen(spark):
    rows = documents(100, "en")
    frame = spark.createDataFrame([(*r, "c", "c", "c", "c") for r in rows], SCHEMA)
    out = merkle.manifest(frame, ["doc_id", "source", "text"], tampered={"source": F.when(F.col("doc_id") == 7, "?").otherwise(F.col("source"))})
    assert [r.doc_id for r in out.where("NOT verified").collect()] == [7]
