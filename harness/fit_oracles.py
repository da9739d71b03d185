"""SQL that fits the regression once more, by another way than Spark's.

Coefficients are sums of training vectors, so the objective is minimised over one number
per training row and class, with products of the rows in place of their terms. The steps
are accelerated gradient steps in a recursive query; they contract the error by a factor
that the penalty fixes, and after ``STEPS`` of them nothing is left that twelve digits show.

``FITTED`` needs ``fit_rows`` (experiment, part, label, text, i), where the training rows of an
experiment are numbered from 1 and the others go on from there; there must be three classes or more.
"""

from __future__ import annotations

from harness.parts import (
    BUILD, GATED, LONG_WORDS, PREDICTIONS, SIZE, TEXT_CANDIDATES, WS, clean, quality, r6, report, with_)
from harness.parts import FOLDS as TEXT_FOLDS
from labelloom.operators import bootstrap

STEPS = 1000

MODEL_ROWS = """eligible AS (SELECT *, count(*) OVER (PARTITION BY label) AS class_rows FROM training),
model_rows AS (SELECT * FROM eligible WHERE class_rows >= 5),
model_ranked AS (SELECT *, row_number() OVER (PARTITION BY label
                 ORDER BY md5('42#' || source_id || '#' || filename)) AS rn FROM model_rows),
model_sizes AS (SELECT label, count(*) AS n FROM model_rows GROUP BY label)"""
SPLIT = """model_totals AS (SELECT *, sum(n) OVER () AS total FROM model_sizes),
model_kept AS (SELECT *, total - (total * 20 + 99) // 100 AS keep FROM model_totals),
model_shares AS (SELECT *, (n * keep) // total AS share, (n * keep) % total AS rest FROM model_kept),
model_dealt AS (SELECT *, row_number() OVER (ORDER BY rest DESC, label) AS place,
                       keep - sum(share) OVER () AS missing FROM model_shares),
model_held AS (SELECT label, n - share - CASE WHEN place <= missing THEN 1 ELSE 0 END AS test_rows FROM model_dealt),
split AS (SELECT model_ranked.*, CASE WHEN rn <= test_rows THEN 'test' ELSE 'train' END AS part
          FROM model_ranked JOIN model_held USING (label))"""
EXPERIMENTS = rf"""fit_rows AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY (part = 'test')::INT, label, source_id, filename) AS i
  FROM (SELECT 'baseline' AS experiment, source_id, filename, label, part, baseline_text AS text FROM split
        UNION ALL SELECT 'combined', source_id, filename, label, part, feature_text FROM split
        UNION ALL SELECT 'summary_only', source_id, filename, label, part,
               regexp_replace(summary || ' ' || doc_subtype, '^[{WS}]+|[{WS}]+$', '', 'g') FROM split))"""
FOLDS = """fold_places AS (SELECT label, n, sum(n) OVER (ORDER BY label) - n AS before FROM model_sizes),
fold_slots AS (SELECT label, (before + i) % 5 AS fold FROM fold_places, unnest(range(CAST(n AS BIGINT))) t(i)),
fold_slotted AS (SELECT label, fold, row_number() OVER (PARTITION BY label ORDER BY fold) AS rn FROM fold_slots),
fold_rows AS (SELECT * FROM model_ranked JOIN fold_slotted USING (label, rn)),
fit_rows AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY (part = 'test')::INT, label, source_id, filename) AS i
  FROM (SELECT held AS experiment, source_id, filename, label, feature_text AS text,
               CASE WHEN fold = held THEN 'test' ELSE 'train' END AS part
        FROM fold_rows, range(5) folds(held)))"""

UNITS = r"""fit_words AS (SELECT experiment, i, part, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS words
               FROM fit_rows),
fit_grams AS (SELECT experiment, i, part, unnest(list_concat(words, list_transform(range(1, len(words)),
              lambda k: words[k] || ' ' || words[k + 1]))) AS term FROM fit_words),
fit_tf AS (SELECT experiment, i, part, term, count(*) AS tf FROM fit_grams GROUP BY ALL),
fit_sizes AS (SELECT experiment, count(*) AS n, count(DISTINCT label) AS classes
              FROM fit_rows WHERE part = 'train' GROUP BY experiment),
fit_vocabulary AS MATERIALIZED (
  SELECT experiment, term, sum(tf) AS used, count(*) AS df FROM fit_tf WHERE part = 'train'
  GROUP BY experiment, term HAVING count(*) >= 2
  QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY sum(tf) DESC, term) <= 10000),
fit_raw AS (SELECT experiment, i, part, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w
            FROM fit_tf JOIN fit_vocabulary USING (experiment, term) JOIN fit_sizes USING (experiment)),
units AS MATERIALIZED (
  SELECT experiment, i, part, term, w / sqrt(sum(w * w) OVER (PARTITION BY experiment, i)) AS w FROM fit_raw)"""
PROBLEM = """products AS (
  SELECT a.experiment, a.i, b.i AS j, sum(a.w * b.w) AS product
  FROM units a JOIN units b ON a.experiment = b.experiment AND a.term = b.term WHERE b.part = 'train' GROUP BY ALL),
kernel AS MATERIALIZED (
  SELECT r.experiment, r.i, list(coalesce(product, 0) ORDER BY c.i) AS products
  FROM fit_rows r JOIN fit_rows c ON c.experiment = r.experiment AND c.part = 'train'
  LEFT JOIN products p ON p.experiment = r.experiment AND p.i = r.i AND p.j = c.i GROUP BY ALL),
class_rows AS (SELECT experiment, label, count(*) AS n FROM fit_rows WHERE part = 'train' GROUP BY ALL),
class_names AS (SELECT experiment, list(label ORDER BY label) AS names FROM class_rows GROUP BY experiment),
problem AS MATERIALIZED (
  SELECT r.experiment, s.n::DOUBLE AS n, s.classes, 1 / s.n::DOUBLE AS penalty, any_value(names) AS names,
         (1 - sqrt(penalty) / 1.5) / (1 + sqrt(penalty) / 1.5) AS speed, list(k.products ORDER BY r.i) AS kernel,
         list(s.n / (s.classes * c.n)::DOUBLE ORDER BY r.i) AS weights,
         list(list_position(names, r.label) ORDER BY r.i) AS truth
  FROM fit_rows r JOIN kernel k USING (experiment, i) JOIN fit_sizes s USING (experiment)
  JOIN class_rows c USING (experiment, label) JOIN class_names USING (experiment)
  WHERE r.part = 'train' GROUP BY r.experiment, s.n, s.classes)"""
SOLVE = f"""solve AS (
  SELECT experiment, 0 AS t, list_transform(range(classes), lambda k: list_transform(kernel, lambda r: 0::DOUBLE)) AS a,
         list_transform(range(classes), lambda k: 0::DOUBLE) AS b, a AS old_a, b AS old_b FROM problem
  UNION ALL
  SELECT experiment, t + 1, list_transform(list_zip(ahead_a, slopes), lambda z: list_transform(list_zip(z[1], z[2]),
             lambda x: x[1] - (x[2] + penalty * x[1]) / (1 + penalty))),
         list_transform(list_zip(ahead_b, slopes), lambda z: z[1] - list_sum(z[2]) / (1 + penalty)), a, b
  FROM (SELECT *, list_transform(range(1, classes + 1), lambda k: list_transform(residuals, lambda r: r[k])) AS slopes
  FROM (SELECT *, list_transform(powers, lambda e, i: list_transform(e, lambda x, k:
               weights[i] * (x / list_sum(e) - (k = truth[i])::INT) / n)) AS residuals
  FROM (SELECT *, list_transform(range(1, n::BIGINT + 1), lambda i:
               list_transform(scores, lambda s: exp(s[i]))) AS powers
  FROM (SELECT *, list_transform(list_zip(ahead_a, ahead_b), lambda z: list_transform(kernel, lambda row:
               list_inner_product(row, z[1]) + z[2])) AS scores
  FROM (SELECT s.*, p.* EXCLUDE (experiment),
               list_transform(list_zip(a, old_a), lambda z: list_transform(list_zip(z[1], z[2]),
                   lambda x: x[1] + speed * (x[1] - x[2]))) AS ahead_a,
               list_transform(list_zip(b, old_b), lambda x: x[1] + speed * (x[1] - x[2])) AS ahead_b
        FROM solve s JOIN problem p USING (experiment) WHERE t < {STEPS}))))))"""
RESULT = """solved AS MATERIALIZED (
  SELECT *, list_sum(list_transform(a, lambda x: list_inner_product(x, list_transform(kernel,
             lambda r: list_inner_product(r, x))))) AS squares
  FROM solve JOIN problem USING (experiment) WHERE t = (SELECT max(t) FROM solve)),
fit_scores AS (SELECT f.experiment, k.i, list_transform(list_zip(a, b), lambda z: exp(
               list_inner_product(k.products, z[1]) + z[2])) AS powers, names, n, weights, truth
               FROM solved f JOIN kernel k USING (experiment)),
fit_probs AS MATERIALIZED (
  SELECT experiment, i, names, n, weights, truth, list_transform(powers, lambda x: x / list_sum(powers)) AS probs,
         list_position(probs, list_max(probs)) AS best FROM fit_scores),
fitted_predictions AS MATERIALIZED (
  SELECT r.*, r.label AS "true", names[best] AS pred, probs, names, probs[best] AS top
  FROM fit_rows r JOIN fit_probs USING (experiment, i) WHERE part = 'test')"""
SOLUTION = (UNITS, PROBLEM, SOLVE, RESULT)


def _fitted(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join([*BUILD, MODEL_ROWS, *parts])


CERTIFICATE = _fitted(SPLIT, EXPERIMENTS, *SOLUTION) + f"""
SELECT f.experiment, CAST(n AS BIGINT) AS rows, CAST(classes AS INTEGER) AS classes,
       (SELECT count(*) FROM fit_vocabulary v WHERE v.experiment = f.experiment) AS terms,
       {r6('''(SELECT sum(-ln(probs[truth[i]]) * weights[i]) / any_value(p.n) FROM fit_probs p
               WHERE p.experiment = f.experiment AND i <= p.n) + penalty / 2 * squares''', 'objective')},
       round(sqrt(squares), 3) AS norm, true AS optimal
FROM solved f"""
PROBABILITIES = _fitted(SPLIT, EXPERIMENTS, *SOLUTION) + """
SELECT experiment, source_id, filename, label AS "true", pred, class, round(p, 1) AS p
FROM (SELECT *, unnest(names) AS class, unnest(probs) AS p FROM fitted_predictions)"""
RESULTS = _fitted(SPLIT, EXPERIMENTS, *SOLUTION, report("fitted_predictions", "experiment")) + f"""
, base AS (SELECT * FROM metrics WHERE grp = 'baseline')
SELECT m.grp AS experiment, {r6('m.accuracy', 'accuracy')}, {r6('m.macro_f1', 'macro_f1')},
       {r6('m.weighted_f1', 'weighted_f1')}, {r6('m.accuracy - b.accuracy', 'delta_accuracy')},
       {r6('m.macro_f1 - b.macro_f1', 'delta_macro_f1')}, {r6('m.weighted_f1 - b.weighted_f1', 'delta_weighted_f1')},
       CASE WHEN m.grp = 'combined' THEN CASE WHEN m.macro_f1 - b.macro_f1 > 0.02 THEN 'improves'
            WHEN m.macro_f1 - b.macro_f1 > 0 THEN 'marginal' ELSE 'no improvement' END END AS verdict, 'fitted' AS status
FROM metrics m, base b"""
CROSS_VALIDATION = _fitted(FOLDS, *SOLUTION, report("fitted_predictions", "experiment")) + f"""
SELECT {r6('avg(weighted_f1)', 'mean')}, {r6('stddev_pop(weighted_f1)', 'std')},
       {r6('avg(weighted_f1) - 2 * stddev_pop(weighted_f1)', 'mean_minus_2sd')},
       {r6('avg(weighted_f1) + 2 * stddev_pop(weighted_f1)', 'mean_plus_2sd')} FROM metrics"""
DOCUMENT_SCORES = _fitted(TEXT_CANDIDATES, quality("cleaned"), GATED, f"""fit_rows AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY (part = 'test')::INT, label, source_id, filename) AS i
  FROM (SELECT 'all' AS experiment, 'train' AS part, label, source_id, filename, feature_text AS text, NULL AS doc_id
        FROM model_rows
        UNION ALL
        SELECT 'all', 'test', NULL, CAST(d.doc_id AS VARCHAR), '', {SIZE} || ' ' || source || ' ' || text || ' '
               || coalesce(array_to_string({LONG_WORDS}, ' '), ''), d.doc_id
        FROM documents d JOIN gated g ON g.doc_id = d.doc_id AND state = 'ready'))""", *SOLUTION) + """
SELECT g.doc_id, g.state, pred AS prediction, round(top, 1) AS top_probability,
       CASE WHEN top >= 0.7 THEN 'HIGH' WHEN top >= 0.4 THEN 'MEDIUM' WHEN top IS NOT NULL THEN 'LOW' END AS band,
       CASE WHEN top IS NULL THEN true ELSE coalesce(quality, 0) = 0 OR top < 0.4 END AS review,
       CASE WHEN g.state = 'low_quality' THEN 'Text quality too low' WHEN g.state = 'failed_reply' THEN 'Reply failed'
            WHEN coalesce(quality, 0) = 0 THEN 'LLM confidence low' WHEN top < 0.4 THEN 'Prediction probability low' END
            AS review_reason
FROM gated g LEFT JOIN fitted_predictions f ON f.doc_id = g.doc_id LEFT JOIN labels l ON l.doc_id = g.doc_id"""
FOLD_VOCABULARIES = with_(TEXT_FOLDS, r"""fold_words AS (
  SELECT doc_id, fold, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS words
  FROM documents JOIN folds USING (doc_id)),
fold_grams AS (SELECT doc_id, fold, unnest(list_concat(words, list_transform(range(1, len(words)),
               lambda i: words[i] || ' ' || words[i + 1]))) AS term FROM fold_words),
fold_tf AS (SELECT doc_id, fold, term, count(*) AS tf FROM fold_grams GROUP BY ALL)""") + """
SELECT CAST(held AS INTEGER) AS fold, term, CAST(sum(tf) AS BIGINT) AS corpus_count, count(*) AS document_count
FROM fold_tf, range(5) h(held) WHERE fold <> held GROUP BY held, term HAVING count(*) >= 2
QUALIFY row_number() OVER (PARTITION BY held ORDER BY sum(tf) DESC, term) <= 10000"""

DOCUMENT_SETS = """doc_labels AS (
  SELECT source_id, list_sort(list(DISTINCT label)) AS labels FROM model_rows GROUP BY source_id),
label_sets AS (SELECT labels, '{"labels":["' || array_to_string(labels, '","') || '"]}' AS name, count(*) AS n
               FROM doc_labels GROUP BY labels),
label_sizes AS (SELECT label, sum(n)::BIGINT AS size FROM (SELECT unnest(labels) AS label, n FROM label_sets)
                GROUP BY label),
rarest AS (SELECT name, min({'size': size, 'label': label}) AS rarest
           FROM (SELECT name, unnest(labels) AS label FROM label_sets) JOIN label_sizes USING (label) GROUP BY name),
ordered AS (SELECT *, row_number() OVER (ORDER BY rarest, n DESC, name) AS i FROM label_sets JOIN rarest USING (name)),
dealt AS (
  SELECT 0::BIGINT AS i, ''::VARCHAR AS name, 0::BIGINT AS taken,
         (SELECT list({'label': label, 'owed': 0::BIGINT}) FROM label_sizes) AS debts
  UNION ALL
  SELECT i, name, taken, list_transform(debts, lambda d: {'label': d.label, 'owed': d.owed
             + CASE WHEN list_contains(labels, d.label) THEN 20 * n - 100 * taken ELSE 0 END})
  FROM (SELECT *, list_min(list_transform(
               list_filter(range(20 * n // 100 - 1, 20 * n // 100 + 3), lambda t: t >= 0 AND t <= n),
               lambda t: {'cost': list_max(list_transform(list_filter(debts, lambda d: list_contains(labels, d.label)),
                   lambda d: abs(d.owed + 20 * n - 100 * t))), 't': t})).t AS taken
        FROM (SELECT o.*, d.debts FROM dealt d JOIN ordered o ON o.i = d.i + 1))),
document_parts AS (
  SELECT source_id, labels, CASE WHEN row_number() OVER (PARTITION BY labels ORDER BY md5('42#' || source_id)) <= taken
         THEN 'test' ELSE 'train' END AS part
  FROM doc_labels JOIN label_sets USING (labels) JOIN dealt USING (name))"""
DOCUMENT_SPLIT = _fitted(DOCUMENT_SETS) + """
SELECT source_id, array_to_string(labels, '|') AS labels, part FROM document_parts"""
DOCUMENT_SHARES = _fitted(DOCUMENT_SETS) + """
SELECT label, count(*) AS documents, count_if(part = 'test')::BIGINT AS held_out, true AS level
FROM (SELECT unnest(labels) AS label, part FROM document_parts) GROUP BY label"""

_CUT = bootstrap.REPLICATES * 5 // 200
BOOTSTRAP = with_(PREDICTIONS, f"""blocks AS (
  SELECT experiment, ('0x' || substr(md5('42#' || doc_id), 1, 8))::BIGINT % {bootstrap.BLOCKS} AS block, "true", pred,
         count(*) AS n FROM predictions GROUP BY ALL),
draws AS (SELECT replicate, block, len(list_filter({bootstrap.STEPS!r}::DOUBLE[], lambda s: s <= ('0x' || substr(
               md5('draw#' || replicate || '#' || block), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)) AS k
          FROM range(1, {bootstrap.REPLICATES} + 1) r(replicate), range({bootstrap.BLOCKS}) b(block)),
drawn AS (SELECT experiment, replicate, "true", pred, sum(n * k) AS n FROM blocks JOIN draws USING (block)
          GROUP BY ALL HAVING sum(n * k) > 0),
sides AS (SELECT experiment, replicate, "true" AS label, n AS support, 0 AS predicted,
                 CASE WHEN "true" = pred THEN n ELSE 0 END AS hit FROM drawn
          UNION ALL SELECT experiment, replicate, pred, 0, n, 0 FROM drawn),
report AS (SELECT experiment, replicate, label, sum(support) AS support, sum(hit) AS hits,
                  2 * sum(hit) / (sum(support) + sum(predicted))::DOUBLE AS f1 FROM sides GROUP BY ALL),
metrics AS (SELECT experiment, sum(hits) / sum(support)::DOUBLE AS accuracy, avg(f1) AS macro_f1,
                   sum(f1 * support) / sum(support)::DOUBLE AS weighted_f1 FROM report GROUP BY experiment, replicate),
measured AS (UNPIVOT metrics ON accuracy, macro_f1, weighted_f1 INTO NAME metric VALUE value),
sorted AS (SELECT experiment, metric, list(value ORDER BY value) AS v FROM measured GROUP BY ALL)""") + f"""
SELECT experiment, metric, {r6(f'v[{_CUT} + 1]', 'low')}, {r6(f'v[len(v) - {_CUT}]', 'high')} FROM sorted"""
_TAIL = """CASE WHEN b + c = 0 THEN 1::DOUBLE ELSE least(1::DOUBLE, 2 * (
       SELECT sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2)))
       FROM range(least(b, c) + 1) r(k))) END"""
UPLIFT_TEST = with_(PREDICTIONS, """paired AS (
  SELECT doc_id, max(CASE WHEN experiment = 'baseline' THEN "true" = pred END) AS before,
         max(CASE WHEN experiment = 'combined' THEN "true" = pred END) AS after FROM predictions GROUP BY doc_id),
counted AS (SELECT count(*) AS pairs, count_if(before AND NOT after)::BIGINT AS b,
                   count_if(NOT before AND after)::BIGINT AS c FROM paired)""") + f"""
SELECT pairs, b AS only_baseline, c AS only_candidate, {r6(_TAIL, 'p_value')} FROM counted"""
LEAKAGE_TERMS = r"""WITH leak_words AS (
  SELECT doc_id, lang AS label, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS words
  FROM documents),
leak_grams AS (SELECT DISTINCT doc_id, label, unnest(list_concat(words, list_transform(range(1, len(words)),
               lambda i: words[i] || ' ' || words[i + 1]))) AS term FROM leak_words),
counts AS (SELECT term, label, count(*) AS n FROM leak_grams GROUP BY ALL),
totals AS (SELECT term, sum(n)::BIGINT AS with_term FROM counts GROUP BY term HAVING sum(n) >= 2),
sizes AS (SELECT lang AS label, count(*)::DOUBLE AS size, (SELECT count(*)::DOUBLE FROM documents) AS total
          FROM documents GROUP BY lang),
scored AS (SELECT label, term, n, with_term, with_term::DOUBLE * (total - with_term) * size * (total - size) AS spread,
                  CASE WHEN spread > 0 THEN total * (n * total - with_term * size) * (n * total - with_term * size)
                       / spread ELSE 0 END AS chi_square
           FROM counts JOIN totals USING (term) JOIN sizes USING (label) WHERE n * total > with_term * size),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY chi_square DESC, term) AS rank FROM scored)
SELECT label, CAST(rank AS INTEGER) AS rank, term, n, with_term, round(chi_square, 6) AS chi_square
FROM ranked WHERE rank <= 10"""

FIT_ORACLES = {
    "fit_certificate": CERTIFICATE,
    "fit_probabilities": PROBABILITIES,
    "experiment_results": RESULTS,
    "cross_validation": CROSS_VALIDATION,
    "document_scores": DOCUMENT_SCORES,
    "fold_vocabularies": FOLD_VOCABULARIES,
    "document_split": DOCUMENT_SPLIT,
    "document_shares": DOCUMENT_SHARES,
    "bootstrap_intervals": BOOTSTRAP,
    "uplift_test": UPLIFT_TEST,
    "leakage_terms": LEAKAGE_TERMS,
    "label_mentions": """
SELECT d.lang AS label, l.lang AS mentioned, count(*) AS n
FROM documents d, (SELECT DISTINCT lang FROM documents) l WHERE contains(lower(text), lower(l.lang)) GROUP BY ALL""",
    "incremental_scores": with_(*BUILD) + """
SELECT count(*) AS rows, count(*) AS scored, count(DISTINCT feature_text) AS texts, 0::BIGINT AS texts_again
FROM training""",
    "unusual_texts": f"SELECT doc_id, {clean('text')} AS text FROM documents",
    "text_readiness": """
SELECT source, count_if(regexp_matches(text, '[0-9]'))::BIGINT AS with_text,
       count_if(regexp_matches(text, '[0-9]')) > 10 AS enough FROM documents GROUP BY source""",
}
