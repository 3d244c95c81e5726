"""Knowledge-base tables made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators import wiki_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note a document; its status comes from the labels."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    lines = F.split("text", "\n")
    status = (
        F.when(F.col("toxic") == 1, "rejected")
        .when((F.col("quality") == 1) & (F.col("doc_id") % 3 == 0), "high_value")
        .when(F.col("quality") == 1, "reviewed")
        .otherwise("raw")
    )
    return d.select(
        "doc_id",
        F.concat(F.lit("raw/"), F.col("doc_id").cast("string")).alias("article_key"),
        F.substring(F.get(lines, F.lit(0)), 1, 80).alias("title"),
        status.alias("status"),
        F.array("lang").alias("market"),
        F.transform(F.slice(lines, 2, 3), lambda x: F.substring(x, 1, 120)).alias("idea_blocks"),
        F.when(F.size(lines) >= 3, F.slice(lines, -1, 1)).alias("failure_modes"),
        F.col("text").alias("main_content"),
        F.sha2("text", 256).alias("hash"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth document's first line is a question."""
    d = table(spark, sf_dir, "documents").where("doc_id % 20 = 0")
    return d.select(F.col("doc_id").alias("query_id"), F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0)).alias("text"))


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector is a question's."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def vector_index(spark: SparkSession, sf_dir: str, blocks: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, embedding, kb_layer, slug, status, article_key, ordinal, block_type): every ``TOPIC``-th vector is a topic's, others an article block's.

    A vector belongs to the block of its document whose number is the id's remainder by 3, where there is one.
    """
    e = table(spark, sf_dir, "embeddings").withColumn("k", F.floor(F.col("vec_id") / TOPIC).cast("long"))
    e = e.withColumn("wiki", F.col("vec_id") % TOPIC == 0).withColumn("ordinal", (F.col("vec_id") % 3).cast("int"))
    of_topic = topics.select(F.col("slug"), F.col("status"))
    wiki = e.where("wiki").withColumn("slug", F.concat(F.lit("topic-"), F.col("k").cast("string"))).join(of_topic, "slug")
    wiki = wiki.select(
        F.col("vec_id").alias("id"), "embedding", F.lit("wiki_concept").alias("kb_layer"), "slug", "status",
        F.concat(F.lit("wiki/concepts/"), "slug", F.lit(".md")).alias("article_key"), F.lit(0).alias("ordinal"),
        F.lit("wiki_concept").alias("block_type"),
    )
    named = e.where("NOT wiki").withColumn("article_key", F.concat(F.lit("raw/"), F.col("vec_id").cast("string")))
    of_block = blocks.select("article_key", F.col("ordinal").cast("int").alias("ordinal"), "block_type")
    articles = named.join(of_block, ["article_key", "ordinal"]).select(
        F.col("vec_id").alias("id"), "embedding", F.lit("article").alias("kb_layer"), F.lit(None).cast("string").alias("slug"),
        F.lit(None).cast("string").alias("status"), "article_key", "ordinal", "block_type",
    )
    return wiki.unionByName(articles)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older state: some articles are missing, of some the hash is another."""
    d = table(spark, sf_dir, "documents").where("doc_id % 5 <> 0")
    return d.select(
        F.concat(F.lit("raw/"), F.col("doc_id").cast("string")).alias("article_key"),
        F.when(F.col("doc_id") % 7 == 0, "stale").otherwise(F.sha2("text", 256)).alias("hash"),
    )


#: Neighbouring documents that share their sources' concepts.
SPAN = 200


def concept_of(doc_id, source) -> F.Column:
    """The concept of a document: one for each source and ``SPAN`` neighbouring documents."""
    return F.concat(F.lit("concept-"), source, F.lit("-"), F.floor(doc_id / SPAN).cast("string"))


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concept for each source and span of documents, with a bullet of its first document and none to two without a source."""
    d = table(spark, sf_dir, "documents").withColumn("slug", concept_of(F.col("doc_id"), F.col("source")))
    return (
        d.groupBy("slug")
        .agg(
            F.count("*").alias("n"),
            F.min("doc_id").alias("low"),
            F.max("doc_id").alias("high"),
        )
        .select(
            "slug",
            F.when(F.col("low") % 3 == 2, "proposed").otherwise("stable").alias("status"),
            F.array(F.concat(F.lit("Alias "), (F.col("low") % 4).cast("string"))).alias("aliases"),
            F.when(F.col("low") % 2 == 0, F.array(F.col("low").cast("string")))
            .otherwise(F.array().cast("array<string>"))
            .alias("sources"),
            F.concat(
                F.array(F.concat(F.lit("first ["), F.col("low").cast("string"), F.lit("]"))),
                F.array_repeat(F.lit("second"), (F.col("low") % 3).cast("int")),
            ).alias("key_idea_blocks"),
            (F.col("high") % 2).cast("int").alias("compile_version"),
            F.when(F.col("n") % 2 == 0, "text").otherwise("_pending_").alias("synthesis"),
        )
    )


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as queries; each cites two concepts chosen by its conversation."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    of = lambda k: F.concat(F.lit("src"), ((F.col("conv_id") * k + F.col("turn")) % 20).cast("string"))
    cite = lambda k: concept_of(F.col("conv_id") * 3, of(k))
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.array_distinct(F.array(cite(1), cite(7))).alias("cited_concepts"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answer to each document, as JSON text: fenced, plain, or cut short for every eleventh."""
    d = table(spark, sf_dir, "documents")
    proposal = F.struct(
        F.concat(F.lit("topic-"), (F.col("doc_id") % 17).cast("string")).alias("slug"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Topic of "), F.col("source"))).otherwise("").alias("title"),
        F.array("lang").alias("aliases"),
        F.col("source").alias("rationale"),
        F.col("lang").alias("draft_synthesis"),
    )
    answer = F.to_json(
        F.struct(
            F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>"))
            .otherwise(F.array(concept_of(F.col("doc_id"), F.col("source")), F.lit(" ")))
            .alias("existing_concepts"),
            F.when(F.col("doc_id") % 4 == 0, F.array(proposal)).alias("proposed_new_concepts"),
        )
    )
    raw = (
        F.when(F.col("doc_id") % 11 == 0, F.substring(answer, 1, 12))
        .when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), answer, F.lit("\n```")))
        .otherwise(answer)
    )
    return d.select(F.concat(F.lit("raw/"), F.col("doc_id").cast("string")).alias("article_key"), raw.alias("raw"))


def ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An idea for each turn that is not the user's: its first 40 characters say what inspired it."""
    c = table(spark, sf_dir, "conversations").where("role <> 'user'")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("idea_id"),
        F.col("conv_id").alias("query_id"),
        F.when(F.col("conv_id") % 5 == 0, " ").otherwise(F.substring("text", 1, 40)).alias("inspired_by"),
        F.col("text").alias("core_logic"),
    )


def retrieved_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of each user turn as titles of its conversation."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    words = F.slice(F.split("text", " "), 1, 2)
    return c.select(F.col("conv_id").alias("query_id"), F.explode(words).alias("title"))


def enrichment_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's enrichment of each document, as JSON text; every thirteenth is cut short."""
    d = table(spark, sf_dir, "documents")
    first = F.get(F.split("text", "\n"), F.lit(0))
    answer = F.to_json(
        F.struct(
            F.concat(F.lit(" "), F.col("source"), F.lit(" ")).alias("summary"),
            F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("fx"), F.col("lang"), F.lit("bond"))).alias("market"),
            F.array(F.col("lang"), F.lit(" "), F.substring(first, 1, 20)).alias("idea_blocks"),
            F.when(F.col("doc_id") % 3 == 0, "high").otherwise("best").alias("brainstorm_value"),
            ((F.col("doc_id") % 8) / 4.0).alias("confidence"),
            F.lit("enter").alias("entry_rule"),
        )
    )
    raw = F.when(F.col("doc_id") % 13 == 0, F.substring(answer, 1, 9)).otherwise(answer)
    kind = F.when(F.col("doc_id") % 5 == 0, "strategy").otherwise("odd")
    return d.select(F.concat(F.lit("raw/"), F.col("doc_id").cast("string")).alias("article_key"), kind.alias("content_type"), raw.alias("raw"))


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn that is not the user's as a written answer with one idea, or two for every third conversation."""
    c = table(spark, sf_dir, "conversations").where("role <> 'user'")
    line = F.concat(F.lit("t"), F.get(F.split("text", "\n"), F.lit(0)), F.lit("t"))
    idea = F.concat(F.lit("### Idea Title\n"), line, F.lit("\n\n**Inspired By**\nturn "), F.col("turn").cast("string"))
    two = F.concat(idea, F.lit("\n---\n**Idea Title**\nother\nWhat Is New\n"), F.col("role"))
    text = F.when(F.col("conv_id") % 3 == 0, two).otherwise(idea)
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("output_id"), text.alias("text"))


def judge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's answer to each output: a list with an object an idea; some are no JSON, too short, or hold words for numbers.

    The second idea's coherence is missing and its actionability below 0.
    """
    out = outputs(spark, sf_dir).select("output_id")
    i, two = F.col("output_id"), F.floor(F.col("output_id") / 1000) % 3 == 0
    first = F.concat(F.lit('{"coherence": '), ((i % 8) / 5.0).cast("string"), F.lit(', "actionability": '), ((i % 4) / 4.0).cast("string"), F.lit("}"))
    first = F.when(i % 13 == 0, '{"coherence": "high", "actionability": 1}').otherwise(first)
    second = F.when(two, ', {"actionability": -3, "coherence_reasoning": "none"}').otherwise("")
    list_ = F.concat(F.lit("["), first, second, F.lit("]"))
    raw = F.when(i % 7 == 0, F.substring(list_, 1, 9)).when(i % 11 == 0, F.lit("[]")).when(i % 2 == 0, F.concat(F.lit("```json\n"), list_, F.lit("\n```"))).otherwise(list_)
    return out.select("output_id", raw.alias("raw"))


def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected sources: addresses of every fifth page, twice, with the later reason never counting."""
    p = table(spark, sf_dir, "pages").where("page_id % 5 = 0")
    row = lambda place, reason: p.select(
        (F.col("page_id") + place).alias("place"), F.col("url").alias("source_url"), F.lit("").alias("title"), F.lit(reason).alias("reason")
    )
    return row(0, "first").unionByName(row(1_000_000_000, "later"))


def concept_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the concepts; those of version 0 have lost a heading, and every page of source 3 or 13 its header."""
    both = concepts(spark, sf_dir).withColumn("title", F.upper("slug"))
    pages = wiki_pages.render_concept_pages(both)
    lost = F.when(F.col("content").contains("compile_version: 0"), F.regexp_replace("content", "## Failure Modes", "## Other"))
    lost = lost.otherwise(F.col("content"))
    return pages.withColumn("content", F.when(F.col("page_path").rlike(r"3-\d+\.md$"), F.substring(lost, 5, 1_000_000)).otherwise(lost))


#: Documents of one topic.
TOPIC = 25


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concept for every ``TOPIC`` neighbouring documents: bullets, sources and texts come from them, so concepts grow with the table."""
    d = table(spark, sf_dir, "documents")
    first = F.array_join(F.slice(F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), " "), 1, 5), " ")
    anchor = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" ["), F.col("doc_id").cast("string"), F.lit(", "), "source", F.lit("]")))
        .when(F.col("doc_id") % 3 == 1, " []")
        .otherwise("")
    )
    row = F.struct("doc_id", first.alias("words"), F.concat(first, anchor).alias("bullet"), "lang")
    k = F.floor(F.col("doc_id") / TOPIC).cast("long")
    g = d.groupBy(k.alias("k")).agg(F.array_sort(F.collect_list(row)).alias("d"))  # TOPIC rows a group

    def bullets(cond):
        return F.transform(F.filter("d", cond), lambda x: x["bullet"])

    n = F.col("k")
    none = F.array().cast("array<string>")
    low, high = F.get("d", F.lit(0)), F.element_at("d", -1)
    return g.select(
        F.concat(F.lit("topic-"), n.cast("string")).alias("slug"),
        F.concat(F.lit("Topic "), n.cast("string"), F.lit(" "), F.get(F.split(low["words"], " "), F.lit(0))).alias("title"),
        F.array(F.concat(F.lit("Alias "), (n % 9).cast("string")), F.concat(F.lit(" "), F.upper(low["lang"]))).alias("aliases"),
        F.when(n % 8 == 5, "proposed").when(n % 8 == 6, "deprecated").otherwise("stable").alias("status"),
        none.alias("related_concepts"),
        F.transform(
            F.filter("d", lambda x: x["doc_id"] % TOPIC < n % 7), lambda x: F.concat(F.lit("raw/"), x["doc_id"].cast("string"))
        ).alias("sources"),
        F.when(n % 6 == 0, none).otherwise(F.array(low["lang"])).alias("content_types"),
        F.when(n % 10 == 9, "")
        .otherwise(F.date_format(F.date_add(F.lit("2025-06-01").cast("date"), (n % 200).cast("int")), "yyyy-MM-dd"))
        .alias("last_compiled"),
        (n % 3).cast("int").alias("compile_version"),
        F.when(n % 4 == 3, "_pending_").when(n % 4 == 2, "").otherwise(low["words"]).alias("synthesis"),
        F.when(n % 5 == 4, "").otherwise(high["words"]).alias("definition"),
        bullets(lambda x: x["doc_id"] % 5 < 2).alias("key_idea_blocks"),
        bullets(lambda x: x["doc_id"] % 5 == 2).alias("variants"),
        bullets(lambda x: x["doc_id"] % TOPIC == 4).alias("common_combinations"),
        none.alias("transfer_targets"),
        bullets(lambda x: (x["doc_id"] % 5 == 3) & (n % 2 == 0)).alias("failure_modes"),
        bullets(lambda x: x["doc_id"] % TOPIC == 9).alias("open_questions"),
        none.alias("source_basenames"),
    )


def topic_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source summary a document; every third feeds no topic, every thirteenth has a value that is none."""
    d = table(spark, sf_dir, "documents")
    words = F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), " ")
    topic = F.concat(F.lit("topic-"), F.floor(F.col("doc_id") / TOPIC).cast("string"))
    return d.select(
        F.concat(F.lit("raw/"), F.col("doc_id").cast("string")).alias("article_key"),
        F.col("doc_id").cast("string").alias("name"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.col("lang").alias("content_type"),
        F.when(F.col("doc_id") % 13 == 0, "best").when(F.col("doc_id") % 2 == 0, "high").otherwise("").alias("brainstorm_value"),
        F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(topic)).alias("feeds_concepts"),
        F.concat(F.lit("take "), F.array_join(F.slice(words, 1, 4), " ")).alias("takeaway"),
        F.array(F.col("source"), F.lit("")).alias("top_idea_blocks"),
        F.lit("").alias("why_in_kb"),
        F.lit("raw").alias("source_path"),
        F.lit("2026-01-01").alias("ingested"),
        F.lit("2026-01-01").alias("last_compiled"),
    )


def source_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last compilation saw: some documents unseen, some changed since, some gone."""
    d = table(spark, sf_dir, "documents")
    k = F.floor(F.col("doc_id") / TOPIC).cast("long")
    topic = lambda c: F.concat(F.lit("topic-"), c.cast("string"))
    key = F.concat(F.lit("raw/"), F.col("doc_id").cast("string"))
    seen = d.where("doc_id % 9 <> 0").select(
        key.alias("path"),
        F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("content_hash"),
        F.lit("2025-12-31").alias("last_seen"),
        F.array(topic(k), topic(k + 1)).alias("feeds_concepts"),
    )
    gone = d.where("doc_id % 50 = 0").select(
        F.concat(F.lit("raw/gone-"), F.col("doc_id").cast("string")).alias("path"),
        F.lit("x").alias("content_hash"),
        F.lit("2025-12-31").alias("last_seen"),
        F.array(topic(k)).alias("feeds_concepts"),
    )
    return seen.unionByName(gone)


def article_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as files hold them: a header of JSON and plain values, then sections; every eleventh has no header."""
    d = table(spark, sf_dir, "documents")
    tick = F.col("doc_id")
    status = F.when(tick % 4 == 0, "reviewed").when(tick % 4 == 1, '"high_value"').when(tick % 4 == 2, "raw").otherwise("")
    market = F.when(tick % 3 == 0, F.concat(F.lit('["'), "lang", F.lit('", "fx"]'))).when(tick % 3 == 1, F.col("lang")).otherwise("[a, b]")
    ideas = F.when(tick % 5 == 0, "[one idea, no json]").otherwise(F.concat(F.lit('["i'), tick.cast("string"), F.lit('", "two: b"]')))
    header = F.concat(
        F.lit("---\ntitle: "), F.when(tick % 6 == 0, "").otherwise(F.concat(F.lit('"Doc '), tick.cast("string"), F.lit('"'))),
        F.lit("\nstatus: "), status, F.lit("\nmarket: "), market, F.lit("\nidea_blocks: "), ideas,
        F.lit("\nsummary: sum: "), "source", F.lit("\nno colon here\n---\n"),
    )
    line = F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0))
    body = F.concat(F.lit("# T\n\n## Main Content\n\nx"), line, F.lit("x\n\n## Next\n\nend\n"))
    return d.select(
        F.concat(F.lit("raw/"), tick.cast("string")).alias("article_key"),
        F.when(tick % 11 == 0, body).otherwise(F.concat(header, body)).alias("content"),
    )


def asked_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' user turns as a log of questions; each cites two topics, and every third row comes twice."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    n = table(spark, sf_dir, "documents").agg((F.floor(F.max("doc_id") / TOPIC) + 3).alias("n"))
    cite = lambda a: F.concat(F.lit("topic-"), ((F.col("conv_id") * a + F.col("turn")) % F.col("n")).cast("string"))
    log = c.crossJoin(F.broadcast(n)).select(  # one row
        (F.col("conv_id") * 1000 + F.col("turn")).alias("log_id"),
        F.concat(F.lit("Q "), F.col("conv_id").cast("string"), F.lit(" - t"), F.col("turn").cast("string"), F.lit("?")).alias("query"),
        F.array_distinct(F.array(cite(1), cite(7))).alias("cited_concepts"),
    )
    return log.unionByName(log.where("log_id % 3 = 0"))
