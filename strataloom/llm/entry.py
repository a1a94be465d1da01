"""The queries of this subpackage and their SQL, for the repository's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .jaccard import op8_ngram_jaccard_join
from .langid import op9_language_id
from .neighbours import op10_nearest_neighbours
from .packing import op4_packing
from .passages import op6_substring_dedup
from .pieces import op7_sentencepiece
from .quality import op3_quality_rules
from .toxicity import op5_toxicity
from .warc import op1_warc
from .wrappers import op2_html_extraction

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_html_extraction": op2_html_extraction,
    "op3_quality_rules": op3_quality_rules,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_language_id": op9_language_id,
    "op10_nearest_neighbours": op10_nearest_neighbours,
}

SQL: dict[str, str] = {
    # A digit of base32 is five bits of two neighbouring hexadecimal digits of SHA-1.
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first, list_transform(range(41), lambda i: strpos('0123456789abcdef', substr(h || '0', i + 1, 1)) - 1) AS d FROM p)
        SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
            list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((d[1 + 5 * k // 4] * 16 + d[2 + 5 * k // 4]) >> (3 - 5 * k % 4)) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f""",
    "op3_quality_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars FROM d),
        line AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM w),
        again AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY pos) AS nth FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        lines AS (SELECT r, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS chars FROM again WHERE nth > 1 GROUP BY r),
        k AS (SELECT unnest(range(2, 11)) AS k),
        g AS (SELECT r, k, i, word_chars, array_to_string(ws[i : i + k - 1], ' ') AS g FROM w, k, unnest(range(1, len(ws) - k + 2)) x(i)),
        n AS (SELECT *, count(*) OVER (PARTITION BY r, k, g) AS c FROM g),
        top AS (SELECT r, bool_or(c * length(replace(g, ' ', '')) > (CASE k WHEN 2 THEN 0.20 WHEN 3 THEN 0.18 ELSE 0.16 END)::DOUBLE * word_chars) AS failed FROM n WHERE c > 1 AND k < 5 GROUP BY r),
        inside AS (SELECT DISTINCT r, k, i + o AS j FROM n, unnest(range(k)) y(o) WHERE c > 1 AND (k = 3 OR k >= 5)),
        dup AS (SELECT r, k, word_chars, count(*) AS n, sum(length(ws[j])) AS chars FROM inside JOIN w USING (r) GROUP BY ALL),
        dups AS (SELECT r, max(n) FILTER (k = 3) AS repeated, bool_or(k >= 5 AND chars > ((35 - k) / 100)::DOUBLE * word_chars) AS failed FROM dup GROUP BY r),
        m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
            coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated, 0)::BIGINT AS n_repeat_words, coalesce(top.failed, false) OR coalesce(dups.failed, false) OR coalesce(lines.chars > 0.30::DOUBLE * word_chars, false) AS failed
            FROM w LEFT JOIN lines USING (r) LEFT JOIN top USING (r) LEFT JOIN dups USING (r)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR failed) AS kept FROM b""",
    "op8_ngram_jaccard_join": """
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [list_aggregate(ws, 'string_agg', ' ')]
            ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS na, b.n AS nb, count(*) AS shared
            FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY ALL),
        l AS (SELECT x, y FROM c WHERE 100 * shared >= 90 * (na + nb - shared)),
        both_ways AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        r AS (SELECT doc_id, doc_id AS far FROM documents UNION SELECT r.doc_id, b.y FROM r JOIN both_ways b ON b.x = r.far)
        SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, m.component_id FROM s JOIN (SELECT doc_id, min(far) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = s.doc_id""",
}
