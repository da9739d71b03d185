"""The given tables cast in the roles of the jobs' inputs.

Every role is derived by Spark from whole tables; nothing is sampled, cut or
made up. The roles are stated in SQL once more in ``oracles.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.session import stage, tune
from labelloom.plans.metadata import metadata
from labelloom.plans.training import joined_rows, training_rows, with_model_texts

# Experiments whose predictions are derived, not fitted.
DERIVED_EXPERIMENTS = ("baseline", "summary_only", "combined")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts take CPU time, over all cores.

    The given tables are single files of a few row groups, each read by one task.
    A table of more splits than cores is read as it is.
    """
    scan = read(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() > cores else scan.repartition(cores)


# ---- orders as documents with large id arrays -------------------------------------

def order_documents(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders as documents, their suppliers and parts as foreign-id arrays."""
    lines = read(spark, sf_dir, "lineitem")
    source_id = F.col("l_orderkey").cast("string")
    documents = lines.groupBy("l_orderkey").agg(
        F.min("l_returnflag").alias("classification"),
        F.max("l_linestatus").alias("doc_subtype"),
        F.collect_set(F.col("l_suppkey").cast("string")).alias("area_ids"),
        F.collect_set(F.col("l_partkey").cast("string")).alias("regulation_ids"),
    ).select(
        source_id.alias("source_id"), F.concat(F.lit("Order "), "l_orderkey").alias("title"),
        "classification", "doc_subtype", "area_ids", "regulation_ids")
    return {
        "documents": documents,
        "attachments": lines.select(source_id.alias("source_id"), F.concat_ws(
            "/", "l_returnflag", "l_linestatus", "l_linenumber").alias("attachment_path")),
        "source_details": lines.select(source_id.alias("source_id"), F.concat(
            F.lit("order_"), "l_orderkey", F.lit("_line_"), "l_linenumber", F.lit(".pdf"))
            .alias("object_name")),
        "areas": read(spark, sf_dir, "supplier").select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        "regulations": read(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("name")),
    }


# ---- documents with languages as labels --------------------------------------------

def size_class(n_chars: Column) -> Column:
    return F.when(n_chars < 1000, "note").when(n_chars < 4000, "article").otherwise("report")


def long_words(text: Column) -> Column:
    """Stand-in for key terms: the distinct words of twelve and more letters."""
    return F.array_sort(F.array_distinct(
        F.regexp_extract_all(text, F.lit(r"\p{L}{12,}"), F.lit(0))))


def text_documents(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Texts as documents: languages and length as areas, label flags as regulations."""
    texts = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    flags = read(spark, sf_dir, "labels")
    conversations = read(spark, sf_dir, "conversations")
    source_id = F.col("doc_id").cast("string")
    documents = texts.join(flags, "doc_id", "left").select(
        source_id.alias("source_id"),
        F.concat_ws(" ", "source", F.lit("document"), "doc_id").alias("title"),
        F.col("source").alias("classification"),
        size_class(F.col("n_chars")).alias("doc_subtype"),
        F.when(F.col("n_chars") >= 4000, F.array("lang", F.lit("long")))
        .otherwise(F.array("lang")).alias("area_ids"),
        F.array(F.concat(F.lit("quality "), "quality"), F.concat(F.lit("toxic "), "toxic"))
        .alias("regulation_ids"),
    )
    names = F.explode(F.array(F.col("object_name"), F.concat(F.lit("scan of "), "object_name")))
    return {
        "documents": documents,
        "attachments": conversations.select(
            F.col("conv_id").cast("string").alias("source_id"),
            F.concat(F.col("role"), F.lit("/turn "), "turn", F.lit(".pdf")).alias("attachment_path")),
        "source_details": texts.select(
            source_id.alias("source_id"), F.concat(F.lit("Doc_"), "doc_id", F.lit(".PDF"))
            .alias("object_name")).select("source_id", names.alias("object_name")),
        "areas": documents.select(F.explode("area_ids").alias("id")).distinct().select(
            "id", F.concat(F.lit("Area "), "id").alias("name")),
        "regulations": flags.select(F.explode(F.array(
            F.concat(F.lit("quality "), "quality"), F.concat(F.lit("toxic "), "toxic"))).alias("id"))
        .distinct().select("id", F.initcap("id").alias("name")),
    }


def text_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata(**text_documents(spark, sf_dir))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts as summaries: the whole text is the summary."""
    joined = read_texts(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    good = F.col("quality") == 1
    return joined.select(
        F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("filename"),
        F.col("n_chars").alias("text_length"),
        F.col("quality").cast("double").alias("quality_score"),
        F.when(good, "high").otherwise("low").alias("llm_confidence"),
        F.when(good, 0.9).otherwise(0.3).alias("final_confidence"),
        F.when(good, "ml_training").otherwise("human_review").alias("routing"),
        F.when(F.col("toxic") == 0, "success").otherwise("failed").alias("llm_status"),
        F.col("text").alias("summary"),
        long_words(F.col("text")).alias("key_terms"),
    )


_stored: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """``build`` written once per session to the shared folder, then only read."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = stage(build(spark, sf_dir), name, spark.sparkContext.defaultParallelism)
    return _stored[key]


def stored_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "metadata", text_metadata)


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_rows(stored_metadata(spark, sf_dir), summaries(spark, sf_dir))


def stored_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training table, stored without the model texts, which are made of its other columns."""
    return with_model_texts(stored(spark, sf_dir, "training", lambda s, d: joined_rows(
        stored_metadata(s, d), summaries(s, d))))


def classed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with language and source as a class; some classes are rare."""
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("/", "lang", "source").alias("label"))


# ---- predictions ---------------------------------------------------------------------

def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived predictions of every text in every experiment.

    The raw score of a class is the number in the first seven hex digits of an
    MD5, so the same table can be stated in SQL; scores are divided by their sum.
    """
    texts = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    classes = texts.agg(F.sort_array(F.collect_set("lang")).alias("c")).scalar()
    raw = texts.select(
        "doc_id", "source", "n_chars", F.col("lang").alias("true"), classes.alias("classes"),
        F.explode(F.array(*[F.lit(e) for e in DERIVED_EXPERIMENTS])).alias("experiment"),
    ).withColumn("raw", F.transform("classes", lambda c: F.struct(
        c.alias("class"),
        F.conv(F.substring(F.md5(F.concat_ws("#", "experiment", "doc_id", c)), 1, 7), 16, 10)
        .cast("long").alias("s"))))
    total = F.aggregate("raw", F.lit(0).cast("long"), lambda t, c: t + c["s"])
    scored = raw.withColumn("total", total).select(
        "experiment", "doc_id", "source", "n_chars", "true",
        F.transform("raw", lambda c: F.struct(c["class"].alias("class"),
                                              (c["s"] / F.col("total")).alias("p"))).alias("probs"))
    best = F.aggregate("probs", F.get("probs", 0),
                       lambda top, c: F.when(c["p"] > top["p"], c).otherwise(top))
    return scored.withColumn("pred", best["class"])


def combined_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).where(F.col("experiment") == "combined")


# ---- extraction, replies, invoices -----------------------------------------------------

def page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways to strip a page's tags as extraction candidates, in one scan.

    The second one needs an article element; pages without one have no such
    candidate, as if the extractor had failed.
    """
    html = F.col("html")
    bare = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", "")
    article = F.regexp_extract(html, r"(?s)<article>(.*)</article>", 1)
    return read_texts(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc_id"),
        F.regexp_count(html, F.lit("<p>")).alias("pages"),
        F.explode(F.array(
            F.struct(F.lit("whole page").alias("method"), F.lit(1).alias("priority"),
                     F.regexp_replace(bare, r"<[^>]*>", "\n").alias("text")),
            F.struct(F.lit("article").alias("method"), F.lit(2).alias("priority"),
                     F.when(html.contains("<article>"),
                            F.regexp_replace(article, r"<[^>]*>", " ")).alias("text")),
        )).alias("c"),
    ).select("doc_id", "pages", "c.*").where(F.col("text").isNotNull())


def unusual_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written with characters that cleaning removes or replaces.

    Vowels become full-width letters and ``fi`` a ligature; after every ``n`` stand a
    control, a private-use and a replacement character.
    """
    text = F.replace(F.col("text"), F.lit("fi"), F.lit("\ufb01"))
    text = F.translate(text, "aeou", "\uff41\uff45\uff4f\uff55")
    return read_texts(spark, sf_dir, "documents").select(
        "doc_id", F.replace(text, F.lit("n"), F.lit("n\u0007\ue000\ufffd")).alias("text"))


def text_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as extraction candidates: as they are, and without digits."""
    return read_texts(spark, sf_dir, "documents").select(
        "doc_id", F.lit(1).alias("pages"),
        F.explode(F.array(
            F.struct(F.lit("plain").alias("method"), F.lit(1).alias("priority"), F.col("text")),
            F.struct(F.lit("no digits").alias("method"), F.lit(2).alias("priority"),
                     F.regexp_replace("text", "[0-9]+", "").alias("text")),
        )).alias("c"),
    ).select("doc_id", "pages", "c.*")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as replies: bare, fenced, inside prose or cut off, by language.

    Texts flagged toxic failed with status 500, and unlabelled ones lack a
    confidence.
    """
    texts = read_texts(spark, sf_dir, "documents")
    joined = texts.join(read(spark, sf_dir, "labels"), "doc_id", "left")
    body = F.to_json(F.struct(
        F.col("text").alias("summary"), long_words(F.col("text")).alias("key_terms"),
        F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
        .alias("llm_confidence"),
        F.col("source").alias("llm_confidence_reason")))
    shaped = (
        F.when(F.col("lang") == "de", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col("lang") == "fr", F.concat(F.lit("The result: "), body, F.lit("\nThat is all.")))
        .when(F.col("lang") == "es", F.substring(body, F.lit(1), F.length(body) - 1))
        .otherwise(body))
    return joined.select("doc_id", F.when(F.col("toxic") == 1, 500).otherwise(200)
                         .alias("status_code"), shaped.alias("body"))


def line_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("subtotal"),
        (F.col("l_discount") * 100).alias("discount_percent"))


def customer_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances as subtotals, some not positive; percentages up to 120, some absent."""
    return read(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("subtotal"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey") * 5.0)
        .alias("discount_percent"))
