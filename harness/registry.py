"""Registered queries by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harness import roles
from labelloom.functions.cleaning import clean_text
from labelloom.functions.replies import prompt_parts
from labelloom.functions.text import name_stem, scoring_text
from labelloom.model.certificate import certificate
from labelloom.model.classifier import Classifier, Settings, fit_classifier
from labelloom.operators import association, bootstrap, keyed, ranking, strata, terms
from labelloom.operators import evaluation as E
from labelloom.operators.candidates import best_candidates, with_quality
from labelloom.operators.profile import column_profile, table_diff
from labelloom.operators.stem_join import fan_out
from labelloom.plans import checks, experiments
from labelloom.plans import invoices as invoice_plans
from labelloom.plans.metadata import metadata, one_row_per_label
from labelloom.plans.replies import parsed_replies
from labelloom.plans.scoring import gated, routed, score_documents, score_unknown
from labelloom.plans.training import join_coverage, training_rows as plain_training_rows, usable_summaries
from labelloom.sources.inventory import documents_with_suffix
from labelloom.session import shared_folder, stage
from labelloom.sources.tables import overwrite_table, remove_table, stored_rows

Query = Callable[[SparkSession, str], DataFrame]


def joined_set(column: str) -> Column:
    """An array as one string in sorted order, so sets compare."""
    return F.array_join(F.sort_array(column), "|").alias(column)


def rounded(column: str | Column, name: str | None = None) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return F.round(col, 6).alias(name or column)


def metadata_sets(spark: SparkSession, d: str) -> DataFrame:
    return metadata(**roles.order_documents(spark, d)).select(
        "source_id", "title", "classification", "doc_subtype", "object_name", "attachment_path",
        joined_set("area_names"), joined_set("regulation_names"))


def text_metadata(spark: SparkSession, d: str) -> DataFrame:
    return roles.text_metadata(spark, d).select(
        "source_id", "title", "classification", "doc_subtype", "object_name", "attachment_path",
        joined_set("area_names"), joined_set("regulation_names"))


def _flat_training(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "regulation_names": joined_set("regulation_names"),
        "key_terms": F.array_join("key_terms", "|"),
    })


def training_rows(spark: SparkSession, d: str) -> DataFrame:
    return _flat_training(roles.training(spark, d))


def training_rows_sliced(spark: SparkSession, d: str) -> DataFrame:
    """The same rows with every repeated stem joined in slices."""
    return _flat_training(plain_training_rows(roles.stored_metadata(spark, d), roles.summaries(spark, d), 1))


def experiment_texts(spark: SparkSession, d: str) -> DataFrame:
    """The model text of each experiment, and the scoring text without metadata."""
    texts = {**experiments.experiment_texts(), "scoring": scoring_text(F.col("summary"), F.col("key_terms"))}
    return roles.stored_training(spark, d).select(
        "source_id", "filename", "label", *[text.alias(name) for name, text in texts.items()])


def part_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each class in the train and the test part."""
    return stratified_split(spark, d).groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"))


def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    out = checks.distribution(roles.stored_training(spark, d), "label")
    return out.withColumn("pct", F.col("pct").cast("double"))


def classification_counts(spark: SparkSession, d: str) -> DataFrame:
    return checks.value_counts(roles.stored_training(spark, d), "classification")


def length_buckets(spark: SparkSession, d: str) -> DataFrame:
    return checks.length_buckets(roles.stored_training(spark, d))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    return join_coverage(roles.stored_metadata(spark, d), roles.summaries(spark, d))


def leakage_preview(spark: SparkSession, d: str) -> DataFrame:
    return checks.leakage_preview(roles.stored_training(spark, d)).withColumn(
        "key_terms", F.array_join("key_terms", "|"))


def leakage_flags(spark: SparkSession, d: str) -> DataFrame:
    return checks.leakage_flags(roles.stored_training(spark, d))


def multi_label_documents(spark: SparkSession, d: str) -> DataFrame:
    return checks.repeated_documents(roles.stored_training(spark, d)).withColumn(
        "labels", F.array_join("labels", "|"))


def document_inventory(spark: SparkSession, d: str) -> DataFrame:
    suffix = F.when(F.col("lang") == "en", ".PDF").when(F.col("lang") == "de", ".pdf")
    path = F.concat(F.lit("/"), "source", F.lit("/Doc_"), "doc_id", suffix.otherwise(".txt"))
    return documents_with_suffix(roles.read(spark, d, "documents"), path, F.octet_length("text"))


def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    return roles.read_texts(spark, d, "documents").select("doc_id", clean_text(F.col("text")).alias("text"))


def text_quality(spark: SparkSession, d: str) -> DataFrame:
    scored = with_quality(roles.read_texts(spark, d, "documents").select("doc_id", "text"), "text")
    return scored.select("doc_id", rounded("letter_ratio"), rounded("word_ratio"),
                         rounded("special_ratio"), F.col("garbled_runs").cast("long"),
                         "quality_score", "quality_reason")


def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    documents = roles.read(spark, d, "pages").select(F.col("page_id").alias("doc_id"))
    return best_candidates(documents, roles.page_candidates(spark, d))


def frequent_classes(spark: SparkSession, d: str) -> DataFrame:
    kept = keyed.keep_frequent(roles.classed_texts(spark, d), "label")
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def dropped_classes(spark: SparkSession, d: str) -> DataFrame:
    return keyed.dropped_classes(roles.classed_texts(spark, d), "label")


def class_overview(spark: SparkSession, d: str) -> DataFrame:
    classed = roles.classed_texts(spark, d)
    return classed.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("label").alias("classes"))


def labelled_texts(spark: SparkSession, d: str) -> DataFrame:
    return roles.read(spark, d, "documents").select("doc_id", F.col("lang").alias("label"))


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return strata.with_holdout(labelled_texts(spark, d), "label", ["doc_id"])


def folds(spark: SparkSession, d: str) -> DataFrame:
    return strata.with_folds(labelled_texts(spark, d), "label", ["doc_id"])


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    weights = keyed.balanced_weights(labelled_texts(spark, d), "label")
    return weights.select("label", "n", rounded("weight"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return terms.token_counts(roles.read_texts(spark, d, "documents"), "doc_id", F.col("text"))


def text_grams(spark: SparkSession, d: str) -> DataFrame:
    return terms.gram_lists(roles.read_texts(spark, d, "documents"), "doc_id", F.col("text"))


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return terms.vocabulary(text_grams(spark, d))


def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    grams = text_grams(spark, d)
    weights = terms.tfidf_weights(grams, "doc_id", terms.vocabulary(grams))
    return weights.select("doc_id", "term", rounded("weight"))


def prediction_metrics(spark: SparkSession, d: str) -> DataFrame:
    metrics = E.prediction_metrics(roles.predictions(spark, d), ["experiment"])
    return metrics.select("experiment", rounded("accuracy"), rounded("macro_f1"),
                          rounded("weighted_f1"), "rows")


def class_report(spark: SparkSession, d: str) -> DataFrame:
    report = E.report_with_averages(roles.combined_predictions(spark, d))
    return report.select("label", rounded("precision"), rounded("recall"), rounded("f1"), "support")


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    cells = E.confusion_matrix(roles.combined_predictions(spark, d))
    return cells.select("true", "pred", "n", rounded("share"))


def label_set(spark: SparkSession, d: str) -> DataFrame:
    return E.label_set(E.pair_counts(roles.combined_predictions(spark, d)))


def top_k_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return E.top_k_accuracy(roles.combined_predictions(spark, d)).select("k", rounded("accuracy"))


def experiment_comparison(spark: SparkSession, d: str) -> DataFrame:
    out = experiments.experiment_comparison(roles.predictions(spark, d))
    return out.select("experiment", *[rounded(c) for c in out.columns
                                      if c not in ("experiment", "verdict")], "verdict")


def error_patterns(spark: SparkSession, d: str) -> DataFrame:
    return E.error_patterns(roles.combined_predictions(spark, d))


def error_share(spark: SparkSession, d: str) -> DataFrame:
    return E.share_correct(roles.combined_predictions(spark, d)).select(
        "rows", "wrong", rounded("accuracy"))


def misclassified_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = roles.combined_predictions(spark, d).withColumns({
        "title": F.concat_ws(" ", "source", F.lit("document"), "doc_id"),
        "classification": F.col("source"),
        "doc_subtype": roles.size_class(F.col("n_chars")),
    })
    return E.misclassified_sample(
        rows, ["doc_id", "title", "true", "pred", "classification", "doc_subtype"], "doc_id")


def fold_summary(spark: SparkSession, d: str) -> DataFrame:
    """Fold scores of the derived predictions, over the folds of the texts."""
    scored = roles.combined_predictions(spark, d).join(
        folds(spark, d).select("doc_id", "fold"), "doc_id")
    summary = E.fold_summary(E.prediction_metrics(scored, ["fold"]))
    return summary.select(*[rounded(c) for c in summary.columns])


def reply_parse(spark: SparkSession, d: str) -> DataFrame:
    """Parsed replies; of an error its kind, as it goes on with the reply's whole text."""
    return parsed_replies(roles.replies(spark, d)).withColumns({
        "key_terms": F.array_join("key_terms", "|"),
        "error": F.substring_index("error", ":", 1)})


def prompts(spark: SparkSession, d: str) -> DataFrame:
    return roles.read(spark, d, "documents").select(
        "doc_id", F.inline(prompt_parts(F.col("text"), "Summarise the document.")))


def ranked_predictions(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranking.ranked_predictions(roles.combined_predictions(spark, d))
    return ranked.select("doc_id", "rank", "class", rounded("probability"))


def review_routing(spark: SparkSession, d: str) -> DataFrame:
    """Derived predictions with label flags as reply states and confidences."""
    flags = roles.read(spark, d, "labels")
    quality = F.col("quality")
    scored = roles.combined_predictions(spark, d).join(flags, "doc_id", "left").select(
        "doc_id", "pred", "probs",
        F.when(quality.isNull(), "no_reply").when(F.col("toxic") == 1, "failed_reply")
        .when(F.col("n_chars") < 200, "low_quality").otherwise("ready").alias("state"),
        F.when(quality == 1, "high").when(quality == 0, "low").alias("llm_confidence"),
        F.split("source", "c").alias("key_terms"),
    )
    return routed(scored).select(
        "doc_id", "state", "prediction", rounded("top_probability"), "band", "review",
        "review_reason", "first_terms", "shown_terms")


def invoices(spark: SparkSession, d: str) -> DataFrame:
    return invoice_plans.invoices(roles.line_invoices(spark, d))


def invoice_rejects(spark: SparkSession, d: str) -> DataFrame:
    return invoice_plans.rejects(roles.customer_invoices(spark, d))


def join_fanout(spark: SparkSession, d: str) -> DataFrame:
    labelled = one_row_per_label(roles.stored_metadata(spark, d)).select(
        name_stem(F.col("object_name")).alias("stem"))
    texts = usable_summaries(roles.summaries(spark, d)).select(
        name_stem(F.col("filename")).alias("stem"))
    return fan_out(labelled, texts, "stem")


def profile(spark: SparkSession, d: str) -> DataFrame:
    labels = roles.read(spark, d, "labels")
    return column_profile(roles.read(spark, d, "documents").join(labels, "doc_id", "left"))


def schema_diff(spark: SparkSession, d: str) -> DataFrame:
    """Texts against conversations renamed to their columns."""
    other = roles.read(spark, d, "conversations").select(
        F.col("conv_id").alias("doc_id"), "text", F.col("turn").alias("lang"), "role")
    return table_diff(roles.read(spark, d, "documents"), other)


def _stored_split(spark: SparkSession, d: str) -> DataFrame:
    return roles.stored(spark, d, "split", lambda s, p: experiments.split_rows(
        roles.stored_training(s, p)))


def training_sink(spark: SparkSession, d: str) -> DataFrame:
    """The training table written to a catalog table twice, its counts, the table removed."""
    name = f"training_{uuid.uuid4().hex}"
    rows = roles.stored_training(spark, d)
    try:
        overwrite_table(rows.select("source_id"), name)
        written = overwrite_table(rows, name)
        counts = (written, stored_rows(spark, name), len(spark.table(name).columns))
    finally:
        remove_table(spark, name)
    return spark.createDataFrame([counts], "written long, stored long, columns int")


def _best_texts(spark: SparkSession, d: str) -> DataFrame:
    return best_candidates(roles.read(spark, d, "documents"), roles.text_candidates(spark, d))


def gated_documents(spark: SparkSession, d: str) -> DataFrame:
    """What is known of every document before a model sees it."""
    states = gated(_best_texts(spark, d), parsed_replies(roles.replies(spark, d)))
    return states.select("doc_id", "method", "pages", "chars", "quality_score", "state")


# The fits of these queries run on until errors of probabilities are a few millionths. They are
# compared to one digit, where no value of the small tables lies so near a border.
FIT = Settings(tolerance=1e-11)
_fitted: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, d: str, name: str, make: Callable):
    """What ``make`` gives, kept for the session, as several queries ask about one fit."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _fitted:
        _fitted[key] = make()
    return _fitted[key]


def _experiments(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, Classifier]]:
    def fit():
        predictions, models = experiments.run_experiments(_stored_split(spark, d), FIT)
        return stage(predictions, "predictions"), models
    return _once(spark, d, "experiments", fit)


def _fold_predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = roles.stored(spark, d, "fold-rows", lambda s, p: strata.with_folds(
        experiments.model_rows(roles.stored_training(s, p)), "label", experiments.IDENTITY))
    return _once(spark, d, "folds", lambda: stage(experiments.fold_predictions(rows, settings=FIT), "fold-predictions"))


def _scoring_model(spark: SparkSession, d: str) -> Classifier:
    return _once(spark, d, "scoring", lambda: fit_classifier(
        experiments.model_rows(roles.stored_training(spark, d)), "feature_text", settings=FIT))


def fit_checks(spark: SparkSession, d: str) -> DataFrame:
    """Properties that the fitted experiments' predictions must have, as row counts."""
    predictions, models = _experiments(spark, d)
    return experiments.reload_checks(_stored_split(spark, d), predictions, models)


def fold_checks(spark: SparkSession, d: str) -> DataFrame:
    """The same properties of the out-of-fold predictions."""
    return experiments.prediction_checks(_fold_predictions(spark, d), "fold")


def fit_certificate(spark: SparkSession, d: str) -> DataFrame:
    """The gradient of each experiment's objective at its fit, from relational weights."""
    _, models = _experiments(spark, d)
    rows = experiments.experiment_rows(_stored_split(spark, d))
    parts = [certificate(rows[name].where(F.col("part") == "train"), "text", "label", model, FIT).select(
        F.lit(name).alias("experiment"), "rows", "classes", "terms", rounded("objective"),
        F.round("norm", 3).alias("norm"), "optimal") for name, model in models.items()]
    return reduce(DataFrame.unionByName, parts)


def fit_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """The probability of every class for the held-out rows of every experiment."""
    predictions, _ = _experiments(spark, d)
    return predictions.select("experiment", "source_id", "filename", "true", "pred", F.explode("probs").alias("c")).select(
        "experiment", "source_id", "filename", "true", "pred", F.col("c.class").alias("class"),
        F.round("c.p", 1).alias("p"))


def fold_vocabularies(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary outside each fold of the texts, from one count per term and fold."""
    placed = folds(spark, d).select("doc_id", "fold")
    return terms.fold_vocabularies(text_grams(spark, d).join(placed, "doc_id"))


def document_split(spark: SparkSession, d: str) -> DataFrame:
    """Documents on one side each, with all of their labels."""
    parts = experiments.document_parts(experiments.model_rows(roles.stored_training(spark, d)))
    return parts.select("source_id", joined_set("labels"), "part")


def document_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per label: documents, held-out ones, and whether these are within one of a fifth."""
    parts = experiments.document_parts(experiments.model_rows(roles.stored_training(spark, d)))
    counts = parts.select("part", F.explode("labels").alias("label")).groupBy("label").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("part") == "test").alias("held_out"))
    return counts.withColumn("level", F.abs(5 * F.col("held_out") - F.col("documents")) <= 5)


def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Percentile intervals of the derived predictions' metrics."""
    found = bootstrap.bootstrap_intervals(roles.predictions(spark, d), ["experiment"], ["doc_id"])
    return found.select("experiment", "metric", rounded("low"), rounded("high"))


def uplift_test(spark: SparkSession, d: str) -> DataFrame:
    """Whether the derived predictions of two experiments differ by more than chance."""
    tested = bootstrap.paired_test(roles.predictions(spark, d), "baseline", "combined", ["doc_id"])
    return tested.select("pairs", "only_baseline", "only_candidate", rounded("p_value"))


def leakage_terms(spark: SparkSession, d: str) -> DataFrame:
    """The terms that speak most for each language of the texts."""
    found = association.associated_terms(labelled_texts_with_text(spark, d), F.col("text"), "label")
    return found.select("label", "rank", "term", "n", "with_term", rounded("chi_square"))


def label_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Languages whose code occurs in the texts of a language, in any case of letters."""
    return association.label_mentions(labelled_texts_with_text(spark, d), F.col("text"), "label")


def labelled_texts_with_text(spark: SparkSession, d: str) -> DataFrame:
    return roles.read_texts(spark, d, "documents").select("doc_id", F.col("lang").alias("label"), "text")


def incremental_scores(spark: SparkSession, d: str) -> DataFrame:
    """The training texts scored twice by one model: rows, texts the model saw, texts it saw again."""
    rows = roles.stored_training(spark, d).select("source_id", "filename", "label", "feature_text")
    folder = f"{shared_folder(spark).rstrip('/')}/scores-{uuid.uuid4().hex}"
    ids, model = ["source_id", "filename", "label"], _scoring_model(spark, d)
    _, seen = score_unknown(rows, ids, "feature_text", model, "1", folder)
    scored, again = score_unknown(rows, ids, "feature_text", model, "1", folder)
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.count("pred").alias("scored")).withColumns({
        "texts": F.lit(seen).cast("long"), "texts_again": F.lit(again).cast("long")})


def unusual_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts with control, private-use, replacement and compatibility characters, cleaned."""
    return roles.unusual_texts(spark, d).select("doc_id", clean_text(F.col("text")).alias("text"))


def text_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Per source, whether enough documents hold any digit to train on digits alone."""
    rows = roles.read_texts(spark, d, "documents").select(
        "source", F.regexp_replace("text", "[^0-9]+", "").alias("digits"))
    return experiments.text_readiness(rows, F.col("digits"), "source")


def scored_states(spark: SparkSession, d: str) -> DataFrame:
    """Scored documents per state: those with a prediction, and those sent to review without one."""
    return scored_documents(spark, d).groupBy("state").agg(
        F.count(F.lit(1)).alias("rows"), F.count("prediction").alias("predicted"),
        F.count("ranking").alias("ranked"),
        F.count_if(F.col("review") & F.col("prediction").isNull()).alias("waiting"))


def experiment_results(spark: SparkSession, d: str) -> DataFrame:
    """Three fitted experiments on the training table, compared."""
    out = experiments.comparison_of_all(_experiments(spark, d)[0])
    return out.select("experiment", *[rounded(c) for c in out.columns
                                      if c not in ("experiment", "verdict", "status")], "verdict", "status")


def cross_validation(spark: SparkSession, d: str) -> DataFrame:
    summary = E.fold_summary(E.prediction_metrics(_fold_predictions(spark, d), ["fold"]))
    return summary.select(*[rounded(c) for c in summary.columns])


def scored_documents(spark: SparkSession, d: str) -> DataFrame:
    """The whole job: extraction choice, reply, fitted model, routing."""
    def score():
        documents = roles.read(spark, d, "documents")
        info = documents.select("doc_id", roles.size_class(F.col("n_chars")).alias("doc_subtype"),
                                F.col("source").alias("classification"))
        return stage(score_documents(_best_texts(spark, d), parsed_replies(roles.replies(spark, d)),
                                     _scoring_model(spark, d), info), "scored")
    return _once(spark, d, "scored", score)


def document_scores(spark: SparkSession, d: str) -> DataFrame:
    """What the whole job predicts of every document, and how it is routed."""
    return scored_documents(spark, d).select(
        "doc_id", "state", "prediction", F.round("top_probability", 1).alias("top_probability"),
        "band", "review", "review_reason")


QUERIES: dict[str, Query] = {
    "metadata_sets": metadata_sets,
    "text_metadata": text_metadata,
    "training_rows": training_rows,
    "training_rows_sliced": training_rows_sliced,
    "experiment_texts": experiment_texts,
    "part_counts": part_counts,
    "label_distribution": label_distribution,
    "classification_counts": classification_counts,
    "length_buckets": length_buckets,
    "join_coverage": coverage,
    "leakage_preview": leakage_preview,
    "leakage_flags": leakage_flags,
    "multi_label_documents": multi_label_documents,
    "document_inventory": document_inventory,
    "clean_text": clean_texts,
    "text_quality": text_quality,
    "best_candidate": best_candidate,
    "frequent_classes": frequent_classes,
    "dropped_classes": dropped_classes,
    "class_overview": class_overview,
    "stratified_split": stratified_split,
    "folds": folds,
    "class_weights": class_weights,
    "token_counts": token_counts,
    "vocabulary": vocabulary,
    "tfidf_weights": tfidf_weights,
    "prediction_metrics": prediction_metrics,
    "class_report": class_report,
    "confusion_matrix": confusion_matrix,
    "label_set": label_set,
    "top_k_accuracy": top_k_accuracy,
    "experiment_comparison": experiment_comparison,
    "error_patterns": error_patterns,
    "error_share": error_share,
    "misclassified_sample": misclassified_sample,
    "fold_summary": fold_summary,
    "reply_parse": reply_parse,
    "prompt_text": prompts,
    "ranked_predictions": ranked_predictions,
    "review_routing": review_routing,
    "invoices": invoices,
    "invoice_rejects": invoice_rejects,
    "join_fanout": join_fanout,
    "column_profile": profile,
    "schema_diff": schema_diff,
    "experiment_results": experiment_results,
    "cross_validation": cross_validation,
    "scored_documents": scored_documents,
    "training_sink": training_sink,
    "gated_documents": gated_documents,
    "fit_checks": fit_checks,
    "fold_checks": fold_checks,
    "scored_states": scored_states,
    "fit_certificate": fit_certificate,
    "fit_probabilities": fit_probabilities,
    "document_scores": document_scores,
    "fold_vocabularies": fold_vocabularies,
    "document_split": document_split,
    "document_shares": document_shares,
    "bootstrap_intervals": bootstrap_intervals,
    "uplift_test": uplift_test,
    "leakage_terms": leakage_terms,
    "label_mentions": label_mentions,
    "incremental_scores": incremental_scores,
    "unusual_texts": unusual_texts,
    "text_readiness": text_readiness,
}
