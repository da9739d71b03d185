"""The registered queries of this package in SQL, where SQL can say what they return."""

from __future__ import annotations

from labelloom.llm import mixing, near_dup, phrases, risk_rules

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

OP6 = f"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len({WORDS}), 0)::BIGINT AS size FROM documents
), totals AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
           [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][
               (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
           sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget
    FROM totals
), filled AS (
    SELECT *, cap / weight <= (budget - coalesce(sum(cap) OVER below, 0))
                / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS stopped
    FROM weighed
    WINDOW below AS (ORDER BY cap / weight, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
    SELECT source, source_size, CASE WHEN stopped THEN cap ELSE weight * (
        (budget - sum(CASE WHEN stopped THEN cap ELSE 0 END) OVER ())
        / sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER ()) END AS target
    FROM filled
), rated AS (
    SELECT doc_id, size, source_size, target,
           CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
           ('0x' || md5('{mixing.SEED}#' || coalesce(doc_id::VARCHAR, 'null'))[1:13])::BIGINT
               / 4503599627370496.0::DOUBLE AS draw
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT) AS taken
FROM rated
"""


def _op10() -> str:
    rules = risk_rules.RULES
    limit = risk_rules.MAX_FALSE_REJECTION / len(rules)
    measure = {r.name: f"coalesce({r.over}::DOUBLE / nullif({r.per}, 0), 0)" for r in rules}
    steps = " UNION ALL ".join(
        f"SELECT '{r.name}' AS rule, {i} AS step, {c}::DOUBLE AS cutoff"
        for r in rules for i, c in enumerate(r.ladder))
    value = "CASE rule " + " ".join(f"WHEN '{n}' THEN {m}" for n, m in measure.items()) + " END"
    rejected = " OR ".join(
        f"coalesce({m} > (SELECT cutoff FROM chosen c WHERE c.rule = '{n}' "
        f"AND c.stratum IS NOT DISTINCT FROM b.stratum), false)" for n, m in measure.items())
    log_term = (f"lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)"
                f" + i * ln({limit}::DOUBLE) + (n - i) * ln(1 - {limit}::DOUBLE)")
    return rf"""
WITH cut AS (
    SELECT doc_id, lang AS stratum, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), windows AS (
    SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM cut)
), marked AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows
), covered AS (
    SELECT doc_id, count(DISTINCT i + shift) AS n_repeat_words
    FROM marked, (SELECT unnest([0, 1, 2]) AS shift) WHERE n > 1 GROUP BY doc_id
), lined AS (
    SELECT *, list_filter(string_split(text, chr(10)),
                          lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS filled
    FROM cut
), counted AS (
    SELECT l.doc_id, stratum, len(words)::BIGINT AS n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           (len(filled) - len(list_distinct(filled)))::BIGINT AS n_dup_lines,
           coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM lined l LEFT JOIN covered c ON l.doc_id = c.doc_id
), base AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
), good AS (
    SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1
), tested AS (
    SELECT stratum, rule, step, cutoff, count(*) AS n, count_if({value} > cutoff)::BIGINT AS k
    FROM base JOIN good USING (doc_id), ({steps}) WHERE NOT base_failed
    GROUP BY stratum, rule, step, cutoff
), tails AS (
    SELECT *, CASE WHEN k < n * {limit}::DOUBLE THEN list_sum(list_transform(
               list_transform(range(0, k + 1), lambda i: {log_term}),
               lambda x: exp(x))) ELSE 1 END AS tail,
           {risk_rules.ERROR}::DOUBLE / ((SELECT count(*) FROM (SELECT DISTINCT stratum FROM tested))
               * {len(rules)}) AS level
    FROM tested
), stops AS (
    SELECT stratum, rule, coalesce(min(step) FILTER (WHERE tail > level), count(*)) AS stop
    FROM tails GROUP BY stratum, rule
), chosen AS (
    SELECT t.stratum, t.rule, t.cutoff FROM tails t JOIN stops s
    ON t.stratum IS NOT DISTINCT FROM s.stratum AND t.rule = s.rule AND t.step = s.stop - 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({rejected}) AS kept
FROM base b
"""


_LINES = """
WITH lines AS (
    SELECT doc_id, place, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS place
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), repeated AS (
    SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10
    GROUP BY key HAVING count(DISTINCT doc_id) > 1
)
"""
OP5 = _LINES + """
SELECT doc_id, count(*)::BIGINT AS n_lines,
       count_if(first_doc IS NOT NULL AND first_doc <> doc_id)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place)
           FILTER (WHERE first_doc IS NULL OR first_doc = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN repeated USING (key) GROUP BY doc_id
"""


_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP12 = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), '{_UPPER}', '{_LOWERED}'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), worded AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), grams AS (
    SELECT lang, k AS size, array_to_string(words[i:i + k - 1], ' ') AS gram
    FROM worded, unnest([1, 2, 3, 4]) AS sizes(k), unnest(range(1, len(words) - k + 2)) AS places(i)
), counts AS (
    SELECT lang, gram, size, count(*)::BIGINT AS times FROM grams GROUP BY ALL
), often AS (
    SELECT * FROM counts WHERE times >= {phrases.LEAST}
), candidates AS (
    SELECT lang, gram AS phrase, size, times AS a, string_split(gram, ' ') AS words FROM often WHERE size > 1
), cuts AS (
    SELECT lang, phrase, size, a, k, array_to_string(words[:k], ' ') AS first_part,
           array_to_string(words[k + 1:], ' ') AS rest
    FROM candidates, unnest(range(1, size)) AS cut(k)
), scored AS (
    SELECT cuts.lang, phrase, cuts.size, a, x.times AS l, y.times AS r,
           (2000000::HUGEINT * a // (x.times::HUGEINT + y.times))::BIGINT AS score,
           row_number() OVER (PARTITION BY cuts.lang, phrase ORDER BY
               2000000::HUGEINT * a // (x.times::HUGEINT + y.times), k) AS weakest
    FROM cuts JOIN often x ON x.lang = cuts.lang AND x.gram = first_part
    JOIN often y ON y.lang = cuts.lang AND y.gram = rest
), around AS (
    SELECT lang, array_to_string(words[i:i + k - 1], ' ') AS phrase, max(a) AS around
    FROM candidates, unnest(range(2, size)) AS sizes(k), unnest(range(1, size - k + 2)) AS places(i)
    GROUP BY ALL
), ranked AS (
    SELECT scored.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
    FROM scored LEFT JOIN around USING (lang, phrase)
    WHERE weakest = 1 AND (around IS NULL OR 100 * around < {phrases.CONTAINED_PERCENT} * a)
), sizes AS (
    SELECT lang, sum(times)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= {phrases.TOP}
"""

OP1 = rf"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWERED}'),
                                      '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
    FROM worded
), sizes AS (
    SELECT doc_id, count(shingle)::BIGINT AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM shingles a JOIN shingles b USING (shingle)
    WHERE a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
    WHERE 100 * shared >= {near_dup.THRESHOLD_PERCENT} * (x.n + y.n - shared)
), reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, l.v FROM reached r JOIN (SELECT u, v FROM links UNION SELECT v, u FROM links) l ON l.u = r.other
)
SELECT doc_id, n AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reached JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""

ORACLES = {"op1_odd_sketch_dedup": OP1, "op5_cuckoo_lines": OP5, "op6_mixing": OP6, "op10_risk_rules": _op10(), "op12_phrase_graph": OP12}
