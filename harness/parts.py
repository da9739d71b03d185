"""Parts of the SQL that several oracles share: the roles of the given tables, and measures."""

from __future__ import annotations

# White space a Unicode-aware class covers; RE2's \s is ASCII only.
WS = (r"\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
      r"\x{3000}")


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) AS {name}"


# ---- documents and training rows ------------------------------------------------------

ORDER_SETS = """
SELECT d.source_id, d.title, d.classification, d.doc_subtype, sd.object_name, a.attachment_path,
       coalesce(array_to_string(list_sort(list(DISTINCT s.s_name)
                FILTER (WHERE s.s_name IS NOT NULL)), '|'), '') AS area_names,
       coalesce(array_to_string(list_sort(list(DISTINCT p.p_name)
                FILTER (WHERE p.p_name IS NOT NULL)), '|'), '') AS regulation_names
FROM (SELECT l_orderkey, CAST(l_orderkey AS VARCHAR) AS source_id, 'Order ' || l_orderkey AS title,
             min(l_returnflag) AS classification, max(l_linestatus) AS doc_subtype
      FROM lineitem GROUP BY l_orderkey) d
JOIN lineitem l ON l.l_orderkey = d.l_orderkey
LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
LEFT JOIN part p ON p.p_partkey = l.l_partkey
LEFT JOIN (SELECT l_orderkey, min('order_' || l_orderkey || '_line_' || l_linenumber || '.pdf')
                  AS object_name FROM lineitem GROUP BY 1) sd ON sd.l_orderkey = d.l_orderkey
LEFT JOIN (SELECT l_orderkey, min(l_returnflag || '/' || l_linestatus || '/' || l_linenumber)
                  AS attachment_path FROM lineitem GROUP BY 1) a ON a.l_orderkey = d.l_orderkey
GROUP BY ALL
"""

SIZE = "CASE WHEN n_chars < 1000 THEN 'note' WHEN n_chars < 4000 THEN 'article' ELSE 'report' END"
LONG_WORDS = r"list_sort(list_distinct(regexp_extract_all(text, '\p{L}{12,}')))"

DOCS = f"""docs AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS source_id, source || ' document ' || d.doc_id AS title,
         source AS classification, {SIZE} AS doc_subtype,
         CASE WHEN n_chars >= 4000 THEN [lang, 'long'] ELSE [lang] END AS area_ids,
         CASE WHEN quality IS NULL THEN '' ELSE
              'Quality ' || quality || '|Toxic ' || toxic END AS regulation_names,
         'Doc_' || d.doc_id || '.PDF' AS object_name
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

PATHS = """paths AS (
  SELECT CAST(conv_id AS VARCHAR) AS source_id, min(role || '/turn ' || turn || '.pdf')
         AS attachment_path FROM conversations GROUP BY 1)"""

LABELLED = """labelled AS (
  SELECT * EXCLUDE (id, area_ids), 'Area ' || id AS label
  FROM (SELECT *, unnest(area_ids) AS id FROM docs))"""

SUMMARIES = f"""summaries AS (
  SELECT 'doc_' || l.doc_id || '.txt' AS filename, n_chars AS text_length,
         CAST(quality AS DOUBLE) AS quality_score,
         CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS llm_confidence,
         CASE WHEN quality = 1 THEN 0.9::DOUBLE ELSE 0.3::DOUBLE END AS final_confidence,
         CASE WHEN quality = 1 THEN 'ml_training' ELSE 'human_review' END AS routing,
         CASE WHEN toxic = 0 THEN 'success' ELSE 'failed' END AS llm_status,
         text AS summary, {LONG_WORDS} AS key_terms
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def stem(name: str) -> str:
    return rf"lower(regexp_replace({name}, '\.[^.]+$', ''))"


TRAINING = f"""training AS (
  SELECT source_id, title, object_name, label, classification, doc_subtype, regulation_names,
         filename, text_length, quality_score, llm_confidence, final_confidence, routing, summary,
         array_to_string(key_terms, '|') AS key_terms,
         doc_subtype || ' ' || classification || ' ' || summary || ' '
         || coalesce(array_to_string(key_terms, ' '), '') AS feature_text,
         title || ' ' || object_name AS baseline_text
  FROM labelled JOIN summaries ON {stem('object_name')} = {stem('filename')}
  WHERE routing = 'ml_training' AND llm_status = 'success' AND length(trim(summary)) > 0)"""

BUILD = (DOCS, LABELLED, SUMMARIES, TRAINING)

# ---- cleaning and quality ---------------------------------------------------------------


def clean(text: str) -> str:
    kept = (rf"regexp_replace(coalesce({text}, ''), "
            r"'[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\p{Cf}\p{Co}\x{FFFD}]', '', 'g')")
    squeezed = (f"regexp_replace(regexp_replace({kept}, '[ \\t]+', ' ', 'g'), "
                "'\\n{3,}', chr(10) || chr(10), 'g')")
    lines = (f"list_filter(string_split({squeezed}, chr(10)), lambda l: "
             rf"NOT regexp_matches(l, '[^{WS}]') "
             r"OR length(regexp_replace(l, '[^\p{L}]', '', 'g')) >= 2)")
    return rf"regexp_replace(array_to_string({lines}, chr(10)), '^[{WS}]+|[{WS}]+$', '', 'g')"


PUNCTUATION = r""" \t\n\r.,;:!?''"()\-/\\@#$%&*+=\[\]{}|<>~`_"""


def quality(source: str) -> str:
    """Measures and score of ``text`` in ``source``, keeping its other columns."""
    words = rf"list_filter(regexp_split_to_array(text, '[{WS}]+'), lambda w: w <> '')"
    return rf"""measured AS (
  SELECT *, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) / length(text)::DOUBLE AS letter_ratio,
         length(regexp_replace(text, '[\p{{L}}\p{{N}}{PUNCTUATION}]', '', 'g'))
             / length(text)::DOUBLE AS special_ratio,
         CASE WHEN len(words) = 0 THEN 0::DOUBLE ELSE len(list_filter(words, lambda w:
              length(regexp_replace(w, '[^\p{{L}}]', '', 'g')) >= 2)) / len(words)::DOUBLE END
              AS word_ratio,
         len(regexp_extract_all(text, '[^\p{{L}}\p{{N}}_{WS}]{{10,}}')) AS garbled_runs
  FROM (SELECT *, {words} AS words FROM {source})),
scored AS (
  SELECT *, CASE WHEN length(text) = 0 THEN 0::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE,
         printf('%.3f', 0.40::DOUBLE * letter_ratio
           + 0.25::DOUBLE * (1 - least(special_ratio * 10, 1::DOUBLE))
           + 0.25::DOUBLE * word_ratio
           + 0.10::DOUBLE * (1 - least(garbled_runs / 20::DOUBLE, 1::DOUBLE)))::DOUBLE)) END
         AS quality_score,
         CASE WHEN length(text) = 0 THEN 'No text' WHEN letter_ratio > 0.5 THEN 'clean'
              ELSE 'alpha=' || printf('%.0f', letter_ratio * 100) || '%' END AS quality_reason
  FROM measured)"""


PAGE_CANDIDATES = rf"""candidates AS (
  SELECT page_id AS doc_id, 'whole page' AS method, 1 AS priority,
         len(regexp_extract_all(html, '<p>')) AS pages,
         regexp_replace(regexp_replace(html,
           '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]*>', chr(10), 'g') AS raw
  FROM pages
  UNION ALL
  SELECT page_id, 'article', 2, len(regexp_extract_all(html, '<p>')),
         regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1),
           '<[^>]*>', ' ', 'g')
  FROM pages WHERE contains(html, '<article>')),
cleaned AS (SELECT * EXCLUDE (raw), {clean('raw')} AS text FROM candidates)"""

TEXT_CANDIDATES = f"""candidates AS (
  SELECT doc_id, 'plain' AS method, 1 AS priority, 1 AS pages, text AS raw FROM documents
  UNION ALL SELECT doc_id, 'no digits', 2, 1, regexp_replace(text, '[0-9]+', '', 'g') FROM documents),
cleaned AS (SELECT * EXCLUDE (raw), {clean('raw')} AS text FROM candidates)"""
GATED = """best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality_score DESC, priority) AS rn
          FROM scored WHERE quality_score > 0),
gated AS (
  SELECT d.doc_id, method, pages, length(coalesce(b.text, '')) AS chars,
         coalesce(quality_score, 0) AS quality_score,
         CASE WHEN coalesce(quality_score, 0) < 0.40 THEN 'low_quality'
              WHEN toxic = 1 OR lang = 'es' THEN 'failed_reply' ELSE 'ready' END AS state
  FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id AND rn = 1
  LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
USABLE = """usable AS (
  SELECT CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT count(*) AS n FROM training GROUP BY label HAVING count(*) >= 5))"""

# ---- classes, split, terms ----------------------------------------------------------------

CLASSED = "classed AS (SELECT doc_id, lang || '/' || source AS label FROM documents)"
RANKED = """ranked AS (
  SELECT doc_id, lang AS label, row_number() OVER (PARTITION BY lang ORDER BY md5('42#' || doc_id))
         AS rn FROM documents),
sizes AS (SELECT label, count(*) AS n FROM ranked GROUP BY label)"""
HOLDOUT = f"""{RANKED},
totals AS (SELECT *, sum(n) OVER () AS total FROM sizes),
kept AS (SELECT *, total - (total * 20 + 99) // 100 AS keep FROM totals),
shares AS (SELECT *, (n * keep) // total AS share, (n * keep) % total AS rest FROM kept),
dealt AS (SELECT *, row_number() OVER (ORDER BY rest DESC, label) AS place,
                 keep - sum(share) OVER () AS missing FROM shares),
held AS (SELECT label, n - share - CASE WHEN place <= missing THEN 1 ELSE 0 END AS test_rows FROM dealt)"""
FOLDS = f"""{RANKED},
placed AS (SELECT label, n, sum(n) OVER (ORDER BY label) - n AS before FROM sizes),
slots AS (SELECT label, (before + i) % 5 AS fold FROM placed, unnest(range(CAST(n AS BIGINT))) t(i)),
slotted AS (SELECT label, CAST(fold AS INTEGER) AS fold,
                   row_number() OVER (PARTITION BY label ORDER BY fold) AS rn FROM slots),
folds AS (SELECT doc_id, label, fold FROM ranked JOIN slotted USING (label, rn))"""

GRAMS = r"""words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS words
  FROM documents),
grams AS (
  SELECT doc_id, words, list_concat(words, list_transform(range(1, len(words)),
         lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM words),
tf AS (SELECT doc_id, term, count(*) AS tf
       FROM (SELECT doc_id, unnest(grams) AS term FROM grams) GROUP BY ALL),
vocabulary AS (
  SELECT term, CAST(sum(tf) AS BIGINT) AS corpus_count, count(*) AS document_count FROM tf
  GROUP BY term HAVING count(*) >= 2 ORDER BY corpus_count DESC, term LIMIT 10000)"""

# ---- predictions ---------------------------------------------------------------------------

PREDICTIONS = """raw AS (
  SELECT e.experiment, d.doc_id, d.source, d.n_chars, d.lang AS "true", c.lang AS class,
         CAST('0x' || substr(md5(e.experiment || '#' || d.doc_id || '#' || c.lang), 1, 7) AS BIGINT) AS s
  FROM documents d, (SELECT DISTINCT lang FROM documents) c,
       (VALUES ('baseline'), ('summary_only'), ('combined')) e(experiment)),
probs AS (SELECT *, s / sum(s) OVER (PARTITION BY experiment, doc_id)::DOUBLE AS p FROM raw),
ranking AS (SELECT *, row_number() OVER (PARTITION BY experiment, doc_id ORDER BY p DESC, class) AS rank
            FROM probs),
predictions AS (SELECT experiment, doc_id, source, n_chars, "true", class AS pred, p AS top
                FROM ranking WHERE rank = 1),
combined AS (SELECT * FROM predictions WHERE experiment = 'combined')"""


def report(source: str, by: str) -> str:
    """Class report of ``source`` grouped by the ``by`` column."""
    return f"""sides AS (
  SELECT {by} AS grp, "true" AS label, 1 AS support, 0 AS predicted, ("true" = pred)::INT AS hit FROM {source}
  UNION ALL SELECT {by}, pred, 0, 1, 0 FROM {source}),
report AS (
  SELECT grp, label, sum(support) AS support, sum(hit) AS hits,
         CASE WHEN sum(predicted) > 0 THEN sum(hit) / sum(predicted)::DOUBLE ELSE 0 END AS precision,
         CASE WHEN sum(support) > 0 THEN sum(hit) / sum(support)::DOUBLE ELSE 0 END AS recall,
         2 * sum(hit) / (sum(support) + sum(predicted))::DOUBLE AS f1
  FROM sides GROUP BY grp, label),
metrics AS (
  SELECT grp, sum(hits) / sum(support)::DOUBLE AS accuracy, avg(f1) AS macro_f1,
         sum(f1 * support) / sum(support)::DOUBLE AS weighted_f1,
         CAST(sum(support) AS BIGINT) AS rows FROM report GROUP BY grp)"""


# ---- profile ----------------------------------------------------------------------------------


def profile(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, "
        f"count(DISTINCT {c}) AS distinct_values, count({c}) - count(DISTINCT {c}) AS repeats "
        f"FROM {source}" for c in columns)
