"""A stored inverted index of blocks, and keyword retrieval that reads only the postings it needs.

A posting says that a block has a token.  Postings lie in folders by a hash of
the token, sorted by it, so a search opens the folders of its tokens alone and
skips row groups of others.  Each token's number of postings is kept beside.

A query's tokens are taken from the rarest on.  A block that has none of the
first m of n tokens scores (n - m) / n and the greatest bonus at most.  After
half of the tokens the best blocks so far give a limit that the last place of
the result can't fall below; tokens are read on only until what a block could
still reach without them is under it.  The commonest tokens, whose postings are
most of the index, are mostly never read.  Blocks that can still reach the
limit are then scored exactly by their own tokens, so the result equals that of
scoring every block that shares a token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.operators import retrieval as R
from lorewell.sources import scratch

#: Folders of postings.
PARTS = 64
#: Beyond this many different tokens asked for, row groups are not skipped by a list of them.
LISTED = 1000
_MOST_BONUS = max(R.TYPE_BONUS.get(k, 0.0) + R.RANK_BONUS.get(k, 0.0) for k in R.TYPE_BONUS)
#: What rounding to six places can do to a score and its rank.
_SLACK = 4e-6
_BLOCK = ["article_key", "ordinal", "block_type"]


def write_postings(blocks: DataFrame, path: str, parts: int = PARTS) -> None:
    """Index ``blocks(article_key, ordinal, block_type, text)``: postings by token, their numbers, and each block's tokens."""
    given = scratch.kept(blocks.select("article_key", F.col("ordinal").cast("int").alias("ordinal"), "block_type", R._hashes(F.col("text")).alias("tokens")))
    given.write.parquet(f"{path}/blocks")
    each = given.select(F.explode("tokens").alias("token"), *_BLOCK)
    each = each.withColumn("part", F.pmod("token", F.lit(parts)).cast("int"))
    # a token that most blocks have is in several tasks: files of one folder, each sorted
    spread = each.repartition("part", F.pmod(F.xxhash64("article_key"), F.lit(8)))
    spread.sortWithinPartitions("part", "token").write.partitionBy("part").parquet(f"{path}/postings")
    each.groupBy("token").agg(F.count("*").alias("n")).write.parquet(f"{path}/counts")
    blocks.sparkSession.createDataFrame([(parts,)], "parts int").coalesce(1).write.parquet(f"{path}/layout")


def asked_tokens(spark, path: str, queries: DataFrame) -> DataFrame:
    """(query_id, token, place, n): the tokens of ``queries(query_id, text)`` from the rarest (place 1) on; n is the query's size.

    Tokens that no block has are counted in n but have no row.
    """
    tokens = queries.select("query_id", R._hashes(F.col("text")).alias("tokens"))
    each = tokens.select("query_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    counts = spark.read.parquet(f"{path}/counts").withColumnRenamed("n", "postings")
    w = Window.partitionBy("query_id").orderBy("postings", "token")
    known = each.join(counts, "token").withColumn("place", F.row_number().over(w))
    return known.withColumn("known", F.count("*").over(Window.partitionBy("query_id"))).drop("postings")


def _postings(spark, path: str, wanted: DataFrame) -> DataFrame:
    """Postings of ``wanted(query_id, token)``, which is saved: (query_id, block) for each token of a query that a block has."""
    parts = spark.read.parquet(f"{path}/layout").first().parts
    part = F.pmod("token", F.lit(parts)).cast("int")
    folders = [r.p for r in wanted.select(part.alias("p")).distinct().collect()]  # PARTS at most
    rows = spark.read.parquet(f"{path}/postings").where(F.col("part").isin(folders))
    some = wanted.select("token").distinct().limit(LISTED + 1).collect()
    if len(some) <= LISTED:
        rows = rows.where(F.col("token").isin([r.token for r in some]))
    return rows.drop("part").join(wanted, "token")


def _limits(scored: DataFrame, limit: int, per_article: int | None) -> DataFrame:
    """(query_id, least): what the last place of a full list is ranked at least, by scores that may still grow."""
    top = R.top_blocks(scored, limit, per_article)
    rank = F.round(F.col("score") + R._by_type(R.RANK_BONUS), 6)
    return top.groupBy("query_id").agg(F.min(rank).alias("least"), F.count("*").alias("found")).where(F.col("found") == limit).drop("found")


def search(spark, path: str, queries: DataFrame, limit: int, per_article: int | None = R.PER_ARTICLE, count: bool = False):
    """As :func:`lorewell.operators.retrieval.keyword_top`, by the index at ``path``.

    With ``count``, also the number of postings that were read for the queries.
    """
    asked = scratch.kept(asked_tokens(spark, path, queries))
    early = F.col("place") <= F.ceil(F.col("known") / 2)
    bonus = R._by_type(R.TYPE_BONUS)

    def hits(which: DataFrame) -> DataFrame:
        found = _postings(spark, path, which.select("query_id", "token"))
        return found.groupBy("query_id", *_BLOCK).agg(F.count("*").alias("shared"))

    sizes = asked.groupBy("query_id").agg(F.first("n").alias("n"), F.first("known").alias("known"))
    half = scratch.kept(hits(scratch.kept(asked.where(early))))
    so_far = half.join(sizes, "query_id").withColumn("score", F.round(F.col("shared") / F.col("n") + bonus, 6))
    limits = scratch.kept(_limits(so_far.select("query_id", *_BLOCK, "score"), limit, per_article))
    # how many tokens a block may lack and still be under the limit with all the others
    under = F.col("least") - F.lit(_MOST_BONUS + _SLACK)
    spared = F.greatest(F.ceil(under * F.col("n")) - 1, F.lit(0))
    needed = F.when(F.col("least").isNull(), F.col("known")).otherwise(F.greatest(F.col("known") - spared, F.ceil(F.col("known") / 2)))
    plan = scratch.kept(sizes.join(limits, "query_id", "left").withColumn("needed", needed.cast("int")))
    more = asked.join(plan.select("query_id", "needed"), "query_id").where(~early & (F.col("place") <= F.col("needed")))
    more = scratch.kept(more.select("query_id", "token"))
    both = half.unionByName(hits(more)).groupBy("query_id", *_BLOCK).agg(F.sum("shared").alias("shared"))
    candidates = both.join(plan, "query_id")
    reach = (F.col("shared") + F.col("known") - F.col("needed")) / F.col("n") + bonus + R._by_type(R.RANK_BONUS)
    candidates = candidates.where(F.col("least").isNull() | (reach + F.lit(_SLACK) >= F.col("least")))
    sure = candidates.where("needed = known").select("query_id", *_BLOCK, "shared", "n")
    # the others' remaining tokens are looked up in the blocks
    last = asked.join(plan.select("query_id", "needed"), "query_id").where(F.col("place") > F.col("needed"))
    rest = last.groupBy("query_id").agg(F.collect_list("token").alias("rest"))  # a query's tokens at most
    open_ = scratch.kept(candidates.where("needed < known").select("query_id", *_BLOCK, "shared", "n"))
    own = spark.read.parquet(f"{path}/blocks")
    filled = open_.join(own, _BLOCK).join(rest, "query_id").select(
        "query_id", *_BLOCK, (F.col("shared") + F.size(F.array_intersect("tokens", "rest"))).alias("shared"), "n"
    )
    scored = sure.unionByName(filled).withColumn("score", F.round(F.col("shared") / F.col("n") + bonus, 6))
    out = R.top_blocks(scored.select("query_id", *_BLOCK, "score"), limit, per_article)
    if not count:
        return out
    read = asked.where(early).select("token").unionByName(more.select("token"))
    counts = spark.read.parquet(f"{path}/counts")
    return out, read.join(counts, "token").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
