"""A Merkle manifest of a table: leaf digests, a root for each group and one over all, and each row's proof.

A level of a tree is kept as strings of hex digests, 64 characters each, laid
one after another; every aligned block of ``BLOCK`` nodes is one row that holds
its stretch of a level as one string.  Parents are hashes of fixed-width
substrings of eight digests, so a block climbs three levels by itself, and the
siblings of a node are the two substrings beside it.  The blocks' tops are the
nodes of the next round, until one node is left; the roots of the groups are
nodes of a tree of their own, made by the same functions.  Proofs come down
again: a block gives each of its nodes the siblings inside it, and those above
from the block's own place in the next round.

Rows are ranked by range partitions and prefix sums, so no group, however
large, is in one task; blocks are bounded.  All work is done by DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm import common

FANOUT = 8
#: Levels that a block climbs by itself, and its nodes.
CLIMB = 3
BLOCK = FANOUT**CLIMB
WIDTH = 64


def digest(*parts) -> Column:
    """Hex sha256 of the parts, one after another."""
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def field(col: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*cols: Column) -> Column:
    return digest(*[field(c) for c in cols])


def _same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    on = F.lit(True)
    for n in names:
        on = on & left[n].eqNullSafe(right[n])
    return on


def ranked(nodes: DataFrame, order: list[str], group: str | None = "grp") -> DataFrame:
    """Add ``rank`` within the group, from 0 in ``order`` (null first), and ``total``, the group's rows.

    Range partitions are numbered by prefix sums over their counts: a table with
    a row for each partition and group.  ``order`` has to part rows that differ.
    """
    spark = nodes.sparkSession
    by = ([group] if group else []) + order
    keys = [F.col(c).asc_nulls_first() for c in by]
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = common.saved(
        nodes.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", within),
        "merkle-ranked",
    )
    held = [group] if group else []
    parts = placed.groupBy("_part", *held).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*held).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*held)
    parts = parts.select(
        "_part",
        *held,
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"),
        F.sum("_n").over(whole).alias("total"),
    )
    parts = common.if_small(common.saved(parts, "merkle-parts"))
    joined = placed.join(parts, _same(placed, parts, "_part", *held))
    return joined.select(
        *[placed[c] for c in nodes.columns], (F.col("_at") + F.col("_base")).alias("rank"), parts["total"]
    )


def _piece(level: Column, first: Column, count: Column) -> Column:
    """So many digests of a level's string from a place on, as bytes."""
    return F.substring(level, first * WIDTH + 1, count * WIDTH)


def _parents(level: Column) -> Column:
    """The next level's string; the last eight may be fewer."""
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / F.lit(FANOUT * WIDTH)).cast("int") - 1)
    each = F.transform(runs, lambda i: F.sha2(_piece(level, i * FANOUT, F.lit(FANOUT)), 256))
    return F.array_join(each, "").cast("binary")


def _height(total: Column) -> Column:
    """Levels that a block of a tree with so many nodes has to climb."""
    out = F.lit(CLIMB)
    for k in reversed(range(CLIMB)):
        out = F.when(total <= FANOUT**k, F.lit(k)).otherwise(out)
    return out


def blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """Aligned blocks of ``nodes(grp, rank, total, digest, and the carried columns)``.

    Returns per block grp, rank (its own among blocks), total (the blocks),
    height, members (the carried columns, in order), level_0 to level_2 and
    digest, its top.
    """
    member = F.struct("rank", "digest", *carried)
    out = nodes.groupBy("grp", F.expr(f"rank div {BLOCK}").alias("block")).agg(
        F.array_sort(F.collect_list(member)).alias("members"), F.first("total").alias("nodes")
    )
    out = out.withColumn("height", _height(F.col("nodes")))
    out = out.withColumn("level_0", F.array_join("members.digest", "").cast("binary"))
    for k in range(CLIMB):
        climbs = F.col("height") > k
        out = out.withColumn(f"level_{k + 1}", F.when(climbs, _parents(F.col(f"level_{k}"))).otherwise(F.col(f"level_{k}")))
    return out.select(
        "grp",
        F.col("block").alias("rank"),
        F.ceil(F.col("nodes") / BLOCK).cast("long").alias("total"),
        "height",
        F.transform("members", lambda m: F.struct(*[m[c].alias(c) for c in carried])).alias("members")
        if carried
        else F.size("members").alias("members"),
        *[f"level_{k}" for k in range(CLIMB)],
        F.col(f"level_{CLIMB}").cast("string").alias("digest"),
    )


def grown(nodes: DataFrame, carried: list[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of blocks from the nodes up, each written, and each group's root (grp, digest)."""
    rounds = [common.saved(blocks(nodes, carried), f"merkle-{name}")]
    while rounds[-1].where("total > 1").limit(1).count():
        tops = rounds[-1].where("total > 1").select("grp", "rank", "total", "digest")
        rounds.append(common.saved(blocks(tops, []), f"merkle-{name}"))
    roots = [r.where("total = 1").select("grp", "digest") for r in rounds]
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return rounds, out


def _inside(at: Column) -> Column:
    """(left, right) siblings of a block's node, level by level, as bytes."""
    steps = []
    for k in range(CLIMB):
        place = F.floor(at / FANOUT**k).cast("int")
        run = F.floor(place / FANOUT).cast("int") * FANOUT
        level = F.col(f"level_{k}")
        left = _piece(level, run, place - run)
        right = _piece(level, place + 1, run + FANOUT - 1 - place)
        steps.append(F.struct(left.alias("left"), right.alias("right")))
    return F.slice(F.array(*steps), F.lit(1), F.col("height"))


def _under(block: DataFrame, above: DataFrame, *names: str) -> DataFrame:
    """Blocks with ``above``, the siblings over their tops."""
    return block.join(above, _same(block, above, *names)).select(*[block[c] for c in block.columns], above["above"])


def _paths(rounds: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The lowest blocks with ``above``: siblings over each block's top, up to the root over all.

    ``roots`` has (grp, above), the siblings over each group's root.
    """
    above = None
    for r in reversed(rounds):
        joined = _under(r.where("total = 1"), roots, "grp")
        if above is not None:
            joined = joined.unionByName(_under(r.where("total > 1"), above, "grp", "rank"))
        if r is rounds[0]:
            return joined
        each = joined.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("members") - 1)))
        path = F.concat(_inside(F.col("at")), "above").alias("above")
        each = each.select("grp", (F.col("rank") * BLOCK + F.col("at")).alias("rank"), path)
        above = common.if_small(common.saved(each, "merkle-above"))
    raise ValueError("no rounds")


def fold(start: Column, path: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(
        path, start, lambda acc, s: F.sha2(F.concat(s["left"], acc.cast("binary"), s["right"]), 256)
    )


def manifest(
    rows: DataFrame,
    fields: list[str],
    group_col: str = "lang",
    id_col: str = "doc_id",
    tampered: dict[str, Column] | None = None,
) -> DataFrame:
    """Leaf, root and proof of every row, and whether the row as it is read now still gives the root.

    A leaf is the digest of ``fields``; within a group rows stand in the order
    of ``id_col`` (null first, rows of one id by their digests); runs of eight
    become their digest until one is left, the group's subroot (a lone leaf
    itself), and so do the subroots, in the order of the groups (null first).
    ``tampered`` names fields that are read differently when proofs are
    checked; the columns are evaluated on ``rows``.

    Returns per row the id, leaf, subroot, root, proof_sha256 (digest of all
    siblings from below), folded_root (from the row as tampered and its
    siblings) and verified.  Equal rows stand side by side and have leaves of
    their own.  An empty table gives an empty result; other columns are ignored.
    """
    now = [(tampered or {}).get(c, F.col(c)) for c in fields]
    leaves = rows.select(
        F.col(group_col).alias("grp"),
        F.col(id_col).alias("id"),
        leaf(*[F.col(c) for c in fields]).alias("digest"),
        leaf(*now).alias("now"),
    )
    # what is read differently is seldom different: its digest is kept only where it is
    leaves = leaves.withColumn("now", F.when(F.col("now") != F.col("digest"), F.col("now")))
    leaves = common.saved(leaves, "merkle-leaves")  # so that texts are read and hashed once, before ranges are sampled
    rounds, subroots = grown(ranked(leaves, ["id", "digest", "now"]), ["id", "now"], "block")
    of_group = subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("name"), "digest")
    tree, root = grown(ranked(of_group, ["name"], None), ["name"], "roots")
    top = root.withColumn("above", F.expr("array()").cast("array<struct<left: binary, right: binary>>"))
    over = _paths(tree, top.select("grp", "above"))
    named = over.select("*", F.posexplode("members").alias("at", "m")).select(
        F.col("grp").alias("tree"),
        F.col("m.name").alias("grp"),
        _piece(F.col("level_0"), F.col("at"), F.lit(1)).cast("string").alias("subroot"),
        F.concat(_inside(F.col("at")), "above").alias("above"),
    )
    one = root.select(F.col("grp").alias("tree"), F.col("digest").alias("root"))
    named = common.saved(named.join(F.broadcast(one), "tree").drop("tree"), "merkle-roots")
    low = _paths(rounds, common.if_small(named.select("grp", "above")))
    ends = common.if_small(named.select(F.col("grp").alias("g"), "subroot", "root"))
    each = low.join(ends, low["grp"].eqNullSafe(ends["g"])).select("*", F.posexplode("members").alias("at", "m"))
    each = each.select(
        F.col("m.id").alias(id_col),
        _piece(F.col("level_0"), F.col("at"), F.lit(1)).cast("string").alias("leaf"),
        "subroot",
        "root",
        F.concat(_inside(F.col("at")), "above").alias("path"),
        F.col("m.now").alias("now"),
    )
    siblings = F.aggregate("path", F.lit(b""), lambda acc, s: F.concat(acc, s["left"], s["right"]))
    folded = fold(F.coalesce("now", "leaf"), F.col("path"))
    return each.select(
        id_col, "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def documents_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` by language, with the case of A to Z in some texts tampered with.

    Tampered are rows whose id's unsigned crc32 is divisible by three; a null
    text stays null, and a null id is not tampered with.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hit = F.coalesce(common.crc32_of_id(F.col("doc_id")) % 3 == 0, F.lit(False))
    text = F.when(hit, F.translate("text", upper, lower)).otherwise(F.col("text"))
    return manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], tampered={"text": text})


#: The same rows: levels by recursion over all nodes, siblings by joins, and the crc32 bit by bit.
SQL = """
WITH RECURSIVE bytes AS (
  SELECT DISTINCT doc_id, list_transform(range(1, length(cast(doc_id AS varchar)) + 1),
    lambda i: ascii(substring(cast(doc_id AS varchar), i, 1))::bigint) AS b FROM documents WHERE doc_id IS NOT NULL),
crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda a, x:
    list_reduce(list_prepend(xor(a, x), range(8)), lambda c, r: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) AS c
  FROM bytes),
docs AS (
  SELECT doc_id, lang, md5(coalesce(text, '')) AS tie,
    coalesce(strlen(cast(doc_id AS varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(cast(n_chars AS varchar)) || ':' || n_chars, '-') AS head,
    text, CASE WHEN c % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS text2
  FROM documents LEFT JOIN crc USING (doc_id)),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text2) || ':' || text2, '-')) AS now FROM docs),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
    count(*) OVER (PARTITION BY lang) AS total FROM leaves),
nodes AS (
  SELECT lang, 0 AS level, rank, total, leaf AS d FROM placed
  UNION ALL
  SELECT lang, level + 1, rank // 8, (total + 7) // 8, sha256(string_agg(d, '' ORDER BY rank))
  FROM nodes WHERE total > 1 GROUP BY lang, level, total, rank // 8),
subs AS (
  SELECT lang, level AS height, d AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS rank,
    count(*) OVER () AS total FROM nodes WHERE total = 1),
tops AS (
  SELECT 0 AS level, rank, total, subroot AS d FROM subs
  UNION ALL
  SELECT level + 1, rank // 8, (total + 7) // 8, sha256(string_agg(d, '' ORDER BY rank))
  FROM tops WHERE total > 1 GROUP BY level, total, rank // 8),
steps AS (
  SELECT p.doc_id, n.level, coalesce(string_agg(n.d, '' ORDER BY n.rank) FILTER (WHERE n.rank < p.rank // (8 ** n.level)::bigint), '') AS l,
    coalesce(string_agg(n.d, '' ORDER BY n.rank) FILTER (WHERE n.rank > p.rank // (8 ** n.level)::bigint), '') AS r
  FROM placed p JOIN nodes n ON n.lang IS NOT DISTINCT FROM p.lang AND n.total > 1
    AND n.rank // 8 = p.rank // (8 ** (n.level + 1))::bigint
  GROUP BY p.doc_id, n.level
  UNION ALL
  SELECT p.doc_id, s.height + t.level,
    coalesce(string_agg(t.d, '' ORDER BY t.rank) FILTER (WHERE t.rank < s.rank // (8 ** t.level)::bigint), ''),
    coalesce(string_agg(t.d, '' ORDER BY t.rank) FILTER (WHERE t.rank > s.rank // (8 ** t.level)::bigint), '')
  FROM placed p JOIN subs s ON s.lang IS NOT DISTINCT FROM p.lang
    JOIN tops t ON t.total > 1 AND t.rank // 8 = s.rank // (8 ** (t.level + 1))::bigint
  GROUP BY p.doc_id, s.height, t.level),
folds AS (
  SELECT doc_id, 0 AS level, now AS d FROM placed
  UNION ALL
  SELECT f.doc_id, f.level + 1, sha256(s.l || f.d || s.r) FROM folds f JOIN steps s ON s.doc_id = f.doc_id AND s.level = f.level),
proofs AS (SELECT doc_id, string_agg(l || r, '' ORDER BY level) AS proof FROM steps GROUP BY doc_id),
ends AS (SELECT doc_id, arg_max(d, level) AS folded_root FROM folds GROUP BY doc_id)
SELECT p.doc_id, p.leaf, s.subroot, t.d AS root, sha256(coalesce(q.proof, '')) AS proof_sha256, e.folded_root,
  e.folded_root = t.d AS verified
FROM placed p JOIN subs s ON s.lang IS NOT DISTINCT FROM p.lang JOIN tops t ON t.total = 1
  JOIN ends e USING (doc_id) LEFT JOIN proofs q USING (doc_id)
"""
