"""SQL that gives the same rows as those queries of the problems that SQL can express."""

from __future__ import annotations

from spandrel.llm.glyphs import LOOKALIKES

#: Addresses step by step: cut, taken apart, parts decoded and encoded again, parameters sorted.
CANON = r"""
    rows AS (SELECT 'pages' AS kind, page_id AS id, url FROM pages UNION ALL SELECT 'links', link_id, url FROM links),
    cut AS (SELECT kind, id, split_part(trim(regexp_replace(url, '[\t\r\n]', '', 'g')), '#', 1) AS u FROM rows),
    web AS (
        SELECT kind, id, lower(regexp_extract(u, '^(https?)://', 1, 'i')) AS scheme, lower(regexp_extract(u, '^https?://([^/?]*)', 1, 'i')) AS host,
            regexp_extract(u, '^https?://[^/?]*([^?]*)', 1, 'i') AS path, regexp_extract(u, '^[^?]*\?(.*)$', 1) AS query
        FROM cut WHERE regexp_matches(u, '^https?://', 'i')),
    parts AS (
        SELECT kind, id, scheme || '://' || rtrim(regexp_replace(host, CASE scheme WHEN 'http' THEN ':80$' ELSE ':443$' END, ''), '.') AS origin,
            '/' || array_to_string([url_encode(url_decode(s)) FOR s IN string_split(path, '/') IF s NOT IN ('', '.')], '/') || '/' AS path,
            array_to_string(list_sort([url_encode(url_decode(split_part(p, '=', 1))) || '=' || url_encode(url_decode(replace(split_part(p, '=', 2), '+', '%20'))) FOR p IN string_split(query, '&') IF p <> '']), '&') AS query
        FROM web),
    canon AS (
        SELECT kind, id, origin || CASE WHEN path = '//' THEN '/' ELSE rtrim(regexp_replace(regexp_replace(path, '/[^/.][^/]*/\.\./', '/', 'g'), '/[^/.][^/]*/\.\./', '/', 'g'), '/') END
            || CASE WHEN query = '' THEN '' ELSE '?' || query END AS address
        FROM parts)"""

INVISIBLE = r"[\p{Cf}\x{34F}\x{180B}-\x{180F}\x{FE00}-\x{FE0F}\x00-\x08\x0E-\x1B\x7F-\x{84}\x{86}-\x{9F}]"
WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]+"
#: Look-alike letters, those with a dieresis as a whole, and full-width forms.
FROM = "".join(x for x, _ in LOOKALIKES) + "ёЁїЇµ" + "".join(chr(0xFF01 + i) for i in range(94))
TO = "".join(y for _, y in LOOKALIKES) + "ëËïÏμ" + "".join(chr(0x21 + i) for i in range(94))


#: Bands by another way than the model's: a vote of the words that nearly only one band of the graded samples has.
BANDS = r"""
    WITH words AS (SELECT sample_id, band, unnest(list_distinct(regexp_extract_all(lower(text), '\pL+'))) AS w FROM graded_samples),
        sizes AS (SELECT band, count(*) AS n FROM graded_samples GROUP BY band),
        counts AS (SELECT w, band, count(*) AS k FROM words GROUP BY ALL),
        known AS (SELECT DISTINCT w, true AS known FROM words),
        function_words AS (SELECT w, true AS func FROM counts JOIN sizes USING (band) WHERE k >= 0.2 * n GROUP BY w HAVING count(*) = (SELECT count(*) FROM sizes)),
        marks AS (SELECT w, arg_max(band, k) AS band FROM counts GROUP BY w HAVING sum(k) >= 4 AND max(k) >= 0.8 * sum(k)),
        long AS (SELECT doc_id, text FROM documents WHERE doc_type IS DISTINCT FROM 'crawl_log' AND len([x FOR x IN regexp_split_to_array(text, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+') IF x <> '']) >= 50),
        parts AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\pL+')) AS w FROM long),
        prose AS (SELECT doc_id FROM parts LEFT JOIN known USING (w) LEFT JOIN function_words USING (w) GROUP BY doc_id HAVING count(known) >= 0.5 * count(*) AND count(func) >= 0.12 * count(*)),
        votes AS (SELECT doc_id, band, count(*) AS v FROM parts JOIN prose USING (doc_id) JOIN marks USING (w) GROUP BY ALL)
    SELECT doc_id, arg_max(band, v) AS band FROM votes GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    form = f"trim(regexp_replace(nfc_normalize(replace(translate(regexp_replace(value, '{INVISIBLE}', '', 'g'), '{FROM}', '{TO.replace(chr(39), chr(39) * 2)}'), 'ﬁ', 'fi')), '{WHITE}', ' ', 'g'))"
    texts = "texts AS (SELECT 'title' AS field, page_id, title AS value FROM pages UNION ALL SELECT 'meta_description', page_id, meta_description FROM pages UNION ALL SELECT 'og_title', page_id, open_graph.og_title FROM pages)"
    return {
        "p8_found": BANDS,
        "p1_found": f"WITH {CANON}, firsts AS (SELECT kind, address, min(id) AS first_id FROM canon GROUP BY ALL) SELECT kind, first_id, id AS copy_id FROM canon JOIN firsts USING (kind, address) WHERE id <> first_id",
        "p1_collapsed": f"WITH {CANON} SELECT kind, address, min(id) AS first_id, count(*) AS n FROM canon GROUP BY ALL",
        "p2_forms": f"WITH {texts} SELECT field, page_id, value, {form} AS form FROM texts",
        "p2_found": f"""WITH {texts},
            forms AS (SELECT *, {form} AS form FROM texts WHERE value IS NOT NULL),
            firsts AS (SELECT field, form, min(page_id) AS first_id, arg_min(value, page_id) AS first_value FROM forms WHERE form <> '' GROUP BY ALL)
            SELECT field, first_id, page_id FROM forms JOIN firsts USING (field, form) WHERE value <> first_value""",
    }
