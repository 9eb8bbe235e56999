"""DuckDB SQL for the corpus operators that SQL can express, written plainly: every window as a row."""

from __future__ import annotations

from siltstone.llm import quality

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUBSTRINGS = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)),
lost AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM windows) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM lost),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

CONTAMINATION = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT n FROM items),
windows AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM windows JOIN wanted USING (n, k)),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def cutoffs(alpha: float = 0.05, delta: float = 0.05, least: int = 100) -> str:
    """Quality figures and verdicts; the binomial tail is a sum over a list."""
    steps = " ".join(f"WHEN {quality.RATIOS[ratio]} > {most}::DOUBLE THEN {n}" for n, (ratio, most) in enumerate(quality.CHAIN, 1))
    tail = f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln(1 - {alpha}))))"
    return f"""
    WITH docs AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
    windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) > 2))),
    again AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS p FROM windows WHERE n > 1) GROUP BY doc_id),
    rows AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS x FROM docs),
    base AS (
      SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda t: length(t))), 0) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(x) - len(list_distinct(x)) AS BIGINT) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(x) AS BIGINT) AS n_lines
      FROM docs JOIN rows USING (doc_id) LEFT JOIN again USING (doc_id)),
    figures AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed, CASE {steps} END AS step FROM base),
    held AS (SELECT lang, step, count(*) OVER (PARTITION BY lang) >= {least} AS large FROM figures WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
    counts AS (SELECT large, CASE WHEN large THEN lang END AS lang, s, count(*) AS n, count(*) FILTER (step <= s) AS k FROM held, (SELECT unnest(range(1, {len(quality.CHAIN) + 1})) AS s) GROUP BY ALL),
    tests AS (SELECT *, (SELECT count(*) FROM (SELECT DISTINCT large, lang FROM counts)) AS m FROM counts),
    judged AS (SELECT large, lang, s, k < {alpha} * n AND CASE WHEN k < {alpha} * n THEN {tail} ELSE 1 END <= {delta} / m AS safe FROM tests),
    steps AS (SELECT large, lang, max(s) AS last FROM (SELECT *, bool_and(safe) OVER (PARTITION BY large, lang ORDER BY s) AS passed FROM judged) WHERE passed GROUP BY large, lang),
    own AS (SELECT f.*, coalesce(a.last, CASE WHEN EXISTS (SELECT 1 FROM counts c WHERE c.large AND c.lang IS NOT DISTINCT FROM f.lang) THEN 0 ELSE coalesce((SELECT max(last) FROM steps WHERE NOT large), 0) END) AS last
            FROM figures f LEFT JOIN steps a ON a.large AND a.lang IS NOT DISTINCT FROM f.lang)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(step > last, true) AS kept
    FROM own
    """
