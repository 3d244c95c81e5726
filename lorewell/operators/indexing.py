"""The index job: changed notes and all wiki pages as blocks with vectors, merged into a stored index."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.operators import blocks as B
from lorewell.operators import models
from lorewell.sources import files, scratch
from lorewell.sources.store import Change, Store


class Indexed(NamedTuple):
    """What a run gives; write ``fresh`` before the others are used, since they come from it."""

    index: DataFrame
    manifest: DataFrame
    failures: DataFrame
    summary: DataFrame


def fresh_blocks(
    notes: DataFrame, concepts: DataFrame, summaries: DataFrame, state: DataFrame, manifest: DataFrame, force: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(blocks to embed, articles with their state): blocks of new and changed notes, and of every wiki page.

    ``notes`` come with ``content``; of the manifest, hashes count.
    """
    current = notes.select("article_key", "status", B.index_hash(F.col("content")).alias("hash"))
    judged = B.changed_articles(current, manifest, force)
    todo = notes.join(judged.where("state <> 'same'").select("article_key"), "article_key", "left_semi")
    return B.all_blocks(B.article_blocks(todo), B.build_wiki_blocks(concepts, summaries, state)), judged


def embedded(fresh: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Blocks with ``embedding`` and ``embed_error``."""
    return models.with_embeddings(fresh, embed)


class Delta(NamedTuple):
    """What a run brings: blocks and manifest entries of articles that were indexed, and keys whose old blocks go."""

    blocks: DataFrame
    entries: DataFrame
    done: DataFrame
    failures: DataFrame
    summary: DataFrame

    def replaced(self) -> DataFrame:
        """Articles that were indexed again, and wiki pages that come anew: a changed page's old block has another id."""
        pages = self.blocks.where("kb_layer <> 'article'").select("article_key")
        return self.done.select("article_key").unionByName(pages).distinct()


def delta(vectors: DataFrame, judged: DataFrame) -> Delta:
    """What embedded blocks bring; an article or page with a block that failed brings nothing.

    Its old blocks and its old entry in the manifest stay, so the next run takes it again.
    """
    failed = vectors.where("embed_error IS NOT NULL").groupBy("article_key").agg(F.min("embed_error").alias("error"))
    good = vectors.join(failed.select("article_key"), "article_key", "left_anti").drop("embed_error")
    todo = judged.where("state <> 'same'")
    done = todo.join(failed.select("article_key"), "article_key", "left_anti")
    counts = good.where("kb_layer = 'article'").groupBy("article_key").agg(F.count("*").cast("int").alias("block_count"))
    entries = done.join(counts, "article_key", "left").select(
        "article_key", "hash", F.coalesce("block_count", F.lit(0)).alias("block_count"), F.col("status").alias("source_dir")
    )
    failures = failed.select(F.col("article_key").alias("key"), F.lit("embedding_error").alias("error_class"), "error")
    articles = judged.join(failed.withColumn("_f", F.lit(True)).select("article_key", "_f"), "article_key", "left")
    summary = articles.agg(
        F.count("*").alias("total"),
        F.count_if((F.col("state") != "same") & F.col("_f").isNull()).alias("success"),
        F.count_if(F.col("state") == "same").alias("skipped"),
        F.count_if((F.col("state") != "same") & F.col("_f").isNotNull()).alias("failed"),
    )
    return Delta(good, entries, done, failures, summary)


def merge(vectors: DataFrame, judged: DataFrame, index: DataFrame, manifest: DataFrame) -> Indexed:
    """The new index and manifest, failures by article, and one row of counts."""
    d = delta(vectors, judged)
    kept = manifest.join(d.done.select("article_key"), "article_key", "left_anti").select(*d.entries.columns)
    return Indexed(B.upsert_blocks(index, d.blocks, d.done), kept.unionByName(d.entries), d.failures, d.summary)


def index_job(
    notes: DataFrame,
    concepts: DataFrame,
    summaries: DataFrame,
    state: DataFrame,
    index: DataFrame,
    manifest: DataFrame,
    embed: Callable[[list[str]], list[list[float]]],
    keep: Callable[[DataFrame], DataFrame],
    force: bool = False,
) -> Indexed:
    """All steps in a row; ``keep`` writes a table and reads it again, so that no text is embedded twice."""
    fresh, judged = fresh_blocks(notes, concepts, summaries, state, manifest, force)
    return merge(keep(embedded(fresh, embed)), judged, index, manifest)


#: Tables of a stored index, and their keys.
STORED = {"blocks": "article_key", "manifest": "article_key"}


def index_into(
    store: Store,
    notes: DataFrame,
    concepts: DataFrame,
    summaries: DataFrame,
    state: DataFrame,
    embed: Callable[[list[str]], list[list[float]]],
    force: bool = False,
    present_only: bool = False,
) -> Indexed:
    """Index what changed since the store's last commit, and publish blocks and manifest together.

    Only buckets of articles and pages that changed are written, and only those
    are embedded; a run without changes writes nothing.  With ``present_only`` the blocks and entries of
    articles that are no longer among ``notes``, and of wiki pages that were not
    built again, go too.
    """
    spark = notes.sparkSession
    stored, manifest = store.read("blocks"), store.read("manifest")
    if manifest is None:
        manifest = spark.createDataFrame([], files.MANIFEST)
    fresh, judged = fresh_blocks(notes, concepts, summaries, state, manifest, force)
    judged, fresh = scratch.kept(judged), scratch.kept(fresh)  # as they were before the commit
    todo = fresh
    if stored is not None and not force:
        todo = fresh.join(unchanged_pages(fresh, stored), "block_id", "left_anti")
    d = delta(scratch.kept(embedded(todo, embed)), judged)
    replaced, entries_gone = d.replaced(), d.done.select("article_key")
    if present_only and stored is not None:
        there = notes.select("article_key").unionByName(fresh.where("kb_layer <> 'article'").select("article_key"))
        old = manifest.select("article_key").unionByName(stored.select("article_key")).distinct()
        gone = old.join(there, "article_key", "left_anti")
        replaced, entries_gone = replaced.unionByName(gone).distinct(), entries_gone.unionByName(gone).distinct()
    replaced = scratch.kept(replaced)
    if stored is None or replaced.limit(1).count():
        store.commit({"blocks": Change(d.blocks, replaced), "manifest": Change(d.entries, entries_gone)})
    return Indexed(store.read("blocks"), store.read("manifest"), d.failures, d.summary)


def unchanged_pages(blocks: DataFrame, stored: DataFrame) -> DataFrame:
    """(block_id) of wiki blocks that the store holds with all their columns equal, so that they needn't be embedded or written."""
    same = [c for c in blocks.columns if c in stored.columns and c != "embedding"]
    row = F.xxhash64(*[F.to_json(F.struct(c)) for c in same])
    old = stored.where("kb_layer <> 'article'").select("block_id", row.alias("was"))
    new = blocks.where("kb_layer <> 'article'").select("block_id", row.alias("now"))
    return new.join(old, "block_id").where("was = now").select("block_id").distinct()
