"""The registered queries once more, as SQL for DuckDB on the same tables.

Written from the meaning of each query, so the plans differ: id arrays are
joined by membership, classes are ranked by windows, and replies are stated by
what they must parse to.
"""

from __future__ import annotations

from harness.fit_oracles import FIT_ORACLES
from harness.parts import (
    BUILD, CLASSED, DOCS, FOLDS, GATED, GRAMS, HOLDOUT, LABELLED, LONG_WORDS, ORDER_SETS,
    PAGE_CANDIDATES, PATHS, PREDICTIONS, RANKED, SIZE, SUMMARIES, TEXT_CANDIDATES, USABLE, WS,
    clean, profile, quality, r6, report, stem, with_)

_cents = "printf('%.2f', {0})::DOUBLE AS {1}".format

ORACLES: dict[str, str] = {
    "metadata_sets": ORDER_SETS,
    "text_metadata": with_(DOCS, PATHS) + """
SELECT docs.source_id, title, classification, doc_subtype, object_name, attachment_path,
       array_to_string(list_transform(list_sort(area_ids), lambda a: 'Area ' || a), '|') AS area_names,
       regulation_names
FROM docs LEFT JOIN paths ON paths.source_id = docs.source_id""",
    "training_rows": with_(*BUILD) + "SELECT * FROM training",
    "training_rows_sliced": with_(*BUILD) + "SELECT * FROM training",
    "experiment_texts": with_(*BUILD) + rf"""
SELECT source_id, filename, label, baseline_text AS baseline, feature_text AS combined,
       regexp_replace(summary || ' ' || doc_subtype, '^[{WS}]+|[{WS}]+$', '', 'g') AS summary_only,
       summary || ' ' || replace(key_terms, '|', ' ') AS scoring
FROM training""",
    "part_counts": with_(HOLDOUT) + """
SELECT label, CASE WHEN rn <= test_rows THEN 'test' ELSE 'train' END AS part, count(*) AS n
FROM ranked JOIN held USING (label) GROUP BY ALL""",
    "label_distribution": with_(*BUILD) + """
SELECT label, count(*) AS n,
       CAST(round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS DOUBLE) AS pct
FROM training GROUP BY label""",
    "classification_counts": with_(*BUILD) + """
SELECT classification, count(*) AS n FROM training GROUP BY 1""",
    "length_buckets": with_(*BUILD) + """
SELECT CASE WHEN length(feature_text) < 200 THEN '< 200'
            WHEN length(feature_text) < 1000 THEN '200-1000'
            WHEN length(feature_text) < 3000 THEN '1000-3000' ELSE '> 3000' END AS bucket,
       count(*) AS n FROM training GROUP BY 1""",
    "join_coverage": with_(DOCS, LABELLED, SUMMARIES) + f"""
SELECT CASE WHEN filename IS NULL THEN 'no_match' ELSE routing END AS status, count(*) AS n
FROM labelled LEFT JOIN summaries ON {stem('object_name')} = {stem('filename')} GROUP BY 1""",
    "leakage_preview": with_(*BUILD) + """
SELECT label, classification, doc_subtype, final_confidence, left(summary, 300) AS summary_preview,
       key_terms, left(feature_text, 400) AS feature_preview
FROM training ORDER BY label, source_id, filename LIMIT 20""",
    "leakage_flags": with_(*BUILD) + """
SELECT label, count(*) AS n,
       CAST(sum(contains(lower(feature_text), lower(label))::INT) AS BIGINT) AS with_label_in_text
FROM training GROUP BY 1""",
    "multi_label_documents": with_(*BUILD) + """
SELECT source_id, title, array_to_string(list_sort(list(DISTINCT label)), '|') AS labels,
       count(*) AS row_count, CAST(count(DISTINCT label) AS INTEGER) AS label_count
FROM training GROUP BY 1, 2 HAVING count(*) > 1""",
    "document_inventory": """
SELECT path, bytes FROM (
  SELECT '/' || source || '/Doc_' || doc_id || CASE lang WHEN 'en' THEN '.PDF' WHEN 'de' THEN '.pdf'
         ELSE '.txt' END AS path, CAST(strlen(text) AS BIGINT) AS bytes FROM documents)
WHERE lower(path) LIKE '%.pdf'""",
    "clean_text": f"SELECT doc_id, {clean('text')} AS text FROM documents",
    "text_quality": with_(quality("documents")) + f"""
SELECT doc_id, {r6('letter_ratio', 'letter_ratio')}, {r6('word_ratio', 'word_ratio')},
       {r6('special_ratio', 'special_ratio')}, garbled_runs, quality_score, quality_reason FROM scored""",
    "best_candidate": with_(PAGE_CANDIDATES, quality("cleaned")) + """
, best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality_score DESC, priority) AS rn
           FROM scored WHERE quality_score > 0)
SELECT p.page_id AS doc_id, method, CAST(pages AS INTEGER) AS pages, coalesce(text, '') AS text,
       coalesce(quality_score, 0) AS quality_score
FROM pages p LEFT JOIN best b ON b.doc_id = p.page_id AND rn = 1""",
    "frequent_classes": with_(CLASSED) + """
SELECT label, count(*) AS n FROM classed GROUP BY label HAVING count(*) >= 5""",
    "dropped_classes": with_(CLASSED) + """
SELECT label, count(*) AS n FROM classed GROUP BY label HAVING count(*) < 5""",
    "class_overview": with_(CLASSED) + """
SELECT count(*) AS rows, count(DISTINCT label) AS classes FROM classed""",
    "stratified_split": with_(HOLDOUT) + """
SELECT doc_id, label, CASE WHEN rn <= test_rows THEN 'test' ELSE 'train' END AS part
FROM ranked JOIN held USING (label)""",
    "folds": with_(FOLDS) + "SELECT doc_id, label, fold FROM folds",
    "class_weights": with_(RANKED) + f"""
SELECT label, n, {r6('sum(n) OVER () / (count(*) OVER () * n)::DOUBLE', 'weight')} FROM sizes""",
    "token_counts": with_(GRAMS) + """
SELECT doc_id, CAST(len(words) AS INTEGER) AS words,
       CAST(len(list_distinct(words)) AS INTEGER) AS distinct_words,
       CAST(len(grams) AS INTEGER) AS grams,
       CAST(len(list_distinct(grams)) AS INTEGER) AS distinct_grams FROM grams""",
    "vocabulary": with_(GRAMS) + "SELECT * FROM vocabulary",
    "tfidf_weights": with_(GRAMS) + f"""
, raw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents))
                 / (1 + document_count)::DOUBLE) + 1) AS w
          FROM tf JOIN vocabulary USING (term))
SELECT doc_id, term, {r6('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))', 'weight')} FROM raw""",
    "prediction_metrics": with_(PREDICTIONS, report("predictions", "experiment")) + f"""
SELECT grp AS experiment, {r6('accuracy', 'accuracy')}, {r6('macro_f1', 'macro_f1')},
       {r6('weighted_f1', 'weighted_f1')}, rows FROM metrics""",
    "class_report": with_(PREDICTIONS, report("combined", "1")) + f"""
, lines AS (
  SELECT label, precision, recall, f1, support FROM report
  UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, rows FROM metrics
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM report
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support)::DOUBLE,
                   sum(recall * support) / sum(support)::DOUBLE,
                   sum(f1 * support) / sum(support)::DOUBLE, sum(support) FROM report)
SELECT label, {r6('precision', 'precision')}, {r6('recall', 'recall')}, {r6('f1', 'f1')},
       CAST(support AS BIGINT) AS support FROM lines""",
    "confusion_matrix": with_(PREDICTIONS) + f"""
, labels_seen AS (SELECT "true" AS label FROM combined UNION SELECT pred FROM combined),
cells AS (SELECT t.label AS "true", p.label AS pred, count(c.doc_id) AS n
          FROM labels_seen t CROSS JOIN labels_seen p
          LEFT JOIN combined c ON c."true" = t.label AND c.pred = p.label GROUP BY ALL)
SELECT "true", pred, n, {r6('''coalesce(n / nullif(sum(n) OVER (PARTITION BY "true"), 0)::DOUBLE, 0)''',
                           'share')} FROM cells""",
    "label_set": with_(PREDICTIONS) + """
SELECT "true" AS label FROM combined UNION SELECT pred FROM combined""",
    "top_k_accuracy": with_(PREDICTIONS) + f"""
SELECT CAST(k AS INTEGER) AS k, {r6('avg((rank <= k)::INT)', 'accuracy')}
FROM ranking, (VALUES (1), (2), (3)) ks(k)
WHERE experiment = 'combined' AND class = "true" GROUP BY k""",
    "experiment_comparison": with_(PREDICTIONS, report("predictions", "experiment")) + f"""
, deltas AS (SELECT m.grp AS experiment, m.accuracy, m.macro_f1, m.weighted_f1,
                    m.accuracy - b.accuracy AS da, m.macro_f1 - b.macro_f1 AS dm,
                    m.weighted_f1 - b.weighted_f1 AS dw
             FROM metrics m, metrics b WHERE b.grp = 'baseline')
SELECT experiment, {r6('accuracy', 'accuracy')}, {r6('macro_f1', 'macro_f1')},
       {r6('weighted_f1', 'weighted_f1')}, {r6('da', 'delta_accuracy')},
       {r6('dm', 'delta_macro_f1')}, {r6('dw', 'delta_weighted_f1')},
       CASE WHEN experiment <> 'combined' THEN NULL WHEN dm > 0.02 THEN 'improves'
            WHEN dm > 0 THEN 'marginal' ELSE 'no improvement' END AS verdict FROM deltas""",
    "error_patterns": with_(PREDICTIONS) + """
SELECT "true", pred, count(*) AS count FROM combined WHERE "true" <> pred GROUP BY 1, 2
ORDER BY count DESC, "true", pred LIMIT 15""",
    "error_share": with_(PREDICTIONS) + f"""
SELECT count(*) AS rows, CAST(sum(("true" <> pred)::INT) AS BIGINT) AS wrong,
       {r6('avg(("true" = pred)::INT)', 'accuracy')} FROM combined""",
    "misclassified_sample": with_(PREDICTIONS) + f"""
SELECT doc_id, source || ' document ' || doc_id AS title, "true", pred, source AS classification,
       {SIZE} AS doc_subtype FROM combined WHERE "true" <> pred ORDER BY doc_id LIMIT 10""",
    "fold_summary": with_(PREDICTIONS, FOLDS, """folded AS (
  SELECT c.*, f.fold FROM combined c JOIN folds f USING (doc_id))""", report("folded", "fold")) + f"""
, summary AS (SELECT avg(weighted_f1) AS m, stddev_pop(weighted_f1) AS s FROM metrics)
SELECT {r6('m', 'mean')}, {r6('s', 'std')}, {r6('m - 2 * s', 'mean_minus_2sd')},
       {r6('m + 2 * s', 'mean_plus_2sd')} FROM summary""",
    "reply_parse": f"""
SELECT doc_id, status_code, parse_status,
       CASE parse_status WHEN 'http_error' THEN 'HTTP 500' WHEN 'no_json' THEN 'No JSON' END AS error,
       CASE WHEN parse_status = 'ok' THEN text END AS summary,
       CASE WHEN parse_status = 'ok' THEN coalesce(array_to_string(terms, '|'), '') END AS key_terms,
       CASE WHEN parse_status = 'ok' THEN CASE quality WHEN 1 THEN 'high' ELSE 'low' END END
            AS llm_confidence,
       CASE WHEN parse_status = 'ok' THEN source END AS llm_confidence_reason
FROM (SELECT d.doc_id, text, source, quality, {LONG_WORDS} AS terms,
             CASE WHEN toxic = 1 THEN 500 ELSE 200 END AS status_code,
             CASE WHEN toxic = 1 THEN 'http_error' WHEN lang <> 'es' THEN 'ok'
                  WHEN contains(text, '}}') THEN 'invalid_json' ELSE 'no_json' END AS parse_status
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
    "training_sink": with_(*BUILD) + """
SELECT count(*) AS written, count(*) AS stored, 17 AS columns FROM training""",
    "gated_documents": with_(TEXT_CANDIDATES, quality("cleaned"), GATED) + """
SELECT doc_id, method, CAST(pages AS INTEGER) AS pages, CAST(chars AS INTEGER) AS chars, quality_score, state
FROM gated""",
    "fit_checks": with_(*BUILD, USABLE) + """
SELECT experiment, rows, rows AS sums_to_one, rows AS likeliest, rows AS same_after_load
FROM (SELECT (n * 20 + 99) // 100 AS rows FROM usable),
     (VALUES ('baseline'), ('summary_only'), ('combined')) e(experiment)""",
    "fold_checks": with_(*BUILD, USABLE) + """
SELECT CAST(i AS INTEGER) AS fold, (n - i + 4) // 5 AS rows, (n - i + 4) // 5 AS sums_to_one,
       (n - i + 4) // 5 AS likeliest
FROM usable, range(5) folds(i)""",
    "scored_states": with_(TEXT_CANDIDATES, quality("cleaned"), GATED) + """
SELECT state, count(*) AS rows, CASE WHEN state = 'ready' THEN count(*) ELSE 0 END AS predicted,
       CASE WHEN state = 'ready' THEN count(*) ELSE 0 END AS ranked,
       CASE WHEN state = 'ready' THEN 0 ELSE count(*) END AS waiting FROM gated GROUP BY state""",
    "prompt_text": """
SELECT doc_id, part::INTEGER AS part, parts::INTEGER AS parts,
       'Summarise the document.' || chr(10) || chr(10) || '<<<' || chr(10)
       || substr(text, (part - 1) * 30000 + 1, 30000) || chr(10) || '>>>' AS prompt
FROM (SELECT doc_id, text, parts, unnest(range(1, parts + 1)) AS part
      FROM (SELECT doc_id, coalesce(text, '') AS text,
                   greatest(1, (length(coalesce(text, '')) + 29999) // 30000) AS parts FROM documents))""",
    "ranked_predictions": with_(PREDICTIONS) + f"""
SELECT doc_id, CAST(rank AS INTEGER) AS rank, class, {r6('p', 'probability')}
FROM ranking WHERE experiment = 'combined'""",
    "review_routing": with_(PREDICTIONS) + f"""
, states AS (
  SELECT c.doc_id, pred, top, source,
         CASE WHEN quality IS NULL THEN 'no_reply' WHEN toxic = 1 THEN 'failed_reply'
              WHEN n_chars < 200 THEN 'low_quality' ELSE 'ready' END AS state,
         CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' END AS confidence
  FROM combined c LEFT JOIN labels l ON l.doc_id = c.doc_id)
SELECT doc_id, state,
       CASE WHEN state = 'ready' THEN pred END AS prediction,
       CASE WHEN state = 'ready' THEN round(top, 6) END AS top_probability,
       CASE WHEN state = 'ready' THEN CASE WHEN top >= 0.70 THEN 'HIGH' WHEN top >= 0.40 THEN 'MEDIUM'
            ELSE 'LOW' END END AS band,
       state <> 'ready' OR confidence = 'low' OR top < 0.40 AS review,
       CASE state WHEN 'no_reply' THEN 'Reply missing' WHEN 'failed_reply' THEN 'Reply failed'
            WHEN 'low_quality' THEN 'Text quality too low'
            ELSE CASE WHEN confidence = 'low' THEN 'LLM confidence low'
                      WHEN top < 0.40 THEN 'Prediction probability low' END END AS review_reason,
       CASE WHEN state = 'ready' THEN replace(source, 'c', ', ') END AS first_terms,
       CASE WHEN state = 'ready' THEN replace(source, 'c', ', ') END AS shown_terms
FROM states""",
    "invoices": f"""
SELECT l_orderkey, l_linenumber, {_cents('subtotal', 'subtotal')},
       {_cents('pct', 'discount_percent')}, {_cents('subtotal * (pct / 100)', 'discount_amount')},
       {_cents('subtotal - subtotal * (pct / 100)', 'total')}
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS subtotal, l_discount * 100::DOUBLE AS pct
      FROM lineitem) WHERE subtotal > 0 AND pct BETWEEN 0 AND 100""",
    "invoice_rejects": """
SELECT c_custkey, subtotal, discount_percent,
       CASE WHEN subtotal <= 0 THEN 'subtotal not positive' ELSE 'discount outside 0 to 100' END
            AS reject_reason
FROM (SELECT c_custkey, c_acctbal AS subtotal,
             CASE WHEN c_mktsegment <> 'BUILDING' THEN c_nationkey * 5.0::DOUBLE ELSE 0::DOUBLE END
             AS discount_percent FROM customer)
WHERE subtotal <= 0 OR discount_percent > 100""",
    "join_fanout": with_(DOCS, LABELLED, SUMMARIES) + f"""
, l AS (SELECT {stem('object_name')} AS stem, count(*) AS n FROM labelled GROUP BY 1),
r AS (SELECT {stem('filename')} AS stem, count(*) AS m FROM summaries
      WHERE routing = 'ml_training' AND llm_status = 'success' AND length(trim(summary)) > 0 GROUP BY 1),
k AS (SELECT coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM l FULL JOIN r ON l.stem = r.stem)
SELECT CAST(sum(n) AS BIGINT) AS left_rows, CAST(sum(m) AS BIGINT) AS right_rows,
       count(*) FILTER (WHERE n > 0) AS left_keys, count(*) FILTER (WHERE m > 0) AS right_keys,
       count(*) FILTER (WHERE n > 1) AS left_repeated_keys,
       count(*) FILTER (WHERE m > 1) AS right_repeated_keys,
       count(*) FILTER (WHERE n * m > 0) AS matched_keys,
       CAST(sum(n * m) AS BIGINT) AS joined_rows, max(n * m) AS largest_key_rows FROM k""",
    "column_profile": with_("""joined AS (
  SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""")
    + profile("joined", ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]),
    "schema_diff": """
SELECT * FROM (VALUES ('doc_id', 'bigint', 'bigint', 'same'), ('text', 'string', 'string', 'same'),
  ('lang', 'string', 'bigint', 'changed'), ('source', 'string', NULL, 'only left'),
  ('n_chars', 'bigint', NULL, 'only left'), ('role', NULL, 'string', 'only right'))
  c(column_name, left_type, right_type, status)
LEFT JOIN (SELECT column_name, rows AS left_rows, nulls AS left_nulls FROM ("""
    + profile("documents", ["doc_id", "text", "lang", "source", "n_chars"])
    + """)) l USING (column_name)
LEFT JOIN (SELECT column_name, rows AS right_rows, nulls AS right_nulls FROM ("""
    + profile("(SELECT conv_id AS doc_id, text, turn AS lang, role FROM conversations)",
               ["doc_id", "text", "lang", "role"])
    + ")) r USING (column_name)",
    **FIT_ORACLES,
}
