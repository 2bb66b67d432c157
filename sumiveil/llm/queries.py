"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from sumiveil.llm.bpe_codec import op9_bpe_codec
from sumiveil.llm.common import SPACE
from sumiveil.llm.licenses import op5_licenses
from sumiveil.llm.maxent import op3_maxent
from sumiveil.llm.packing import op7_pack
from sumiveil.llm.quality import BOILERPLATE, LINK, MAX_LOSS, NAVIGATION, SYMBOLS, op10_quality
from sumiveil.llm.simhash import op6_simhash
from sumiveil.llm.sketches import op1_fingerprints
from sumiveil.llm.substrings import op8_substrings
from sumiveil.llm.token_counts import op4_token_counts
from sumiveil.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_toxicity": op2_toxicity,
    "op3_maxent": op3_maxent,
    "op4_token_counts": op4_token_counts,
    "op5_licenses": op5_licenses,
    "op6_simhash": op6_simhash,
    "op7_pack": op7_pack,
    "op8_substrings": op8_substrings,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_quality": op10_quality,
    # what SQL can tell of op1: the texts whose sketches it compares
    "edited_texts": lambda spark, sf_dir: op1_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256"),
}
_QUALITY = rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, doc_id, t, [x for x in regexp_split_to_array(t, '{SPACE}') if x <> ''] AS w, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
    g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w WHERE len(w) >= 5)),
    h AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g) WHERE c > 1),
    n AS (SELECT r, sum(least(5, i - coalesce(p, i - 5))) AS n_repeat_words FROM h GROUP BY r),
    x AS (SELECT r, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT r, unnest(l) AS x FROM w)),
    b AS (SELECT r, count(*) AS n_bad_lines, sum(n) AS n_bad_words FROM x WHERE
        len(regexp_extract_all(x, '[#*$%&|<>{{}}\\^~=_]')) * 10 > length(x) OR len(regexp_extract_all(x, '[!?]')) > greatest(2, n / 2)
        OR (n >= 40 AND NOT regexp_matches(x, '[.!?;:,。！？]')) OR len(regexp_extract_all(x, '( \||\| | > | » | › | · )')) * 4 > n
        OR (n <= 6 AND regexp_matches(x, '(?i){NAVIGATION}')) OR len(regexp_extract_all(x, '{LINK}')) * 2 > n OR (n <= 25 AND regexp_matches(x, '(?i){BOILERPLATE}')) GROUP BY r),
    q AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
        CAST(coalesce(n_bad_lines, 0) AS BIGINT) AS n_bad_lines, CAST(coalesce(n_bad_words, 0) AS BIGINT) AS n_bad_words FROM w LEFT JOIN n USING (r) LEFT JOIN b USING (r))
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_bad_words <= {MAX_LOSS} * n_words AS kept FROM q"""

_EDITED = """
    SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - length(t) // 2) || left(u, length(t) // 2)) AS edited_sha256 FROM (
      SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS u FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""

ORACLE_SQL: dict[str, str] = {"op10_quality": _QUALITY, "edited_texts": _EDITED}
