"""DuckDB SQL for the queries that SQL can express, from shared pieces."""

from __future__ import annotations

from ..functions import text as tx
from .fixtures import SQL_BOXES, grown_values, values

_BLANK = r"[\s\p{Z}\x0b\x85]+"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '{_BLANK}', ' ', 'g'))"


def fold(x: str) -> str:
    return rf"regexp_replace(strip_accents({x}), '[^\x00-\x7F]', '', 'g')"


def search(x: str) -> str:
    return f"lower({fold(norm(x))})"


def form(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9ąćęłńóśźż\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def strip(x: str) -> str:
    word = lambda p: p.replace(r"\w", r"[\p{L}\p{M}\p{N}_]")
    t = f"regexp_replace({norm(x)}, '[,;:]+', ' ', 'g')"
    t = rf"regexp_replace({t}, '{tx.DIMENSIONS}', ' ', 'gi')"
    for tail in tx.TAILS:
        t = rf"regexp_replace({t}, '\b{word(tail)}\b.*$', '', 'gi')"
    t = rf"regexp_replace({t}, '{_BLANK}', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({t}, '^[ \-_.]+', ''), '[ \-_.]+$', '')"


def noise(x: str) -> str:
    pattern = "|".join(f"(?:{p})" for p in tx.NOISE)
    return f"(length({fold(norm(x))}) < 4 OR regexp_matches({fold(norm(x))}, '^(?:{pattern})$', 'i'))"


def grams(tokens: str, least: int, most: int) -> str:
    return "flatten([" + ", ".join(f"[{tokens}[i : i + {n - 1}] FOR i IN range(1, greatest(1, len({tokens}) - {n - 2}))]" for n in range(least, most + 1)) + "])"


WORDS = r"[\p{L}\p{M}\p{N}_-]+"
SQL: dict[str, str] = {}
SQL["normalize_text"] = f"SELECT doc_id, {norm('text')} AS normalized FROM documents"
SQL["ascii_fold"] = f"SELECT doc_id, {fold('text')} AS folded FROM documents"
SQL["strip_tail"] = rf"""
WITH l AS (SELECT doc_id, regexp_split_to_array(text, '[\n\r]+') AS l FROM documents),
e AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM l)
SELECT doc_id, line_no::BIGINT AS line_no, {strip("line || ' D=40 mm, gr. 12 mm; 3 mm thick acc. to specification'")} AS core FROM e"""
SQL["noise_filter"] = f"""
WITH f AS (SELECT p_partkey, [p_size::VARCHAR, p_size || ' mm', 'D = ' || p_size || ',5 cm', 'REI' || p_size, p_size || ' x ' || p_size || ' mm', p_name, substring(p_name, 1, 3), 'gr. ' || p_size || ' mm'] AS f FROM part),
e AS (SELECT p_partkey, unnest(range(8)) AS form, unnest(f) AS text FROM f)
SELECT p_partkey, form::BIGINT AS form, {noise('text')} AS noise FROM e"""
SQL["tokenize"] = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({norm('text')}, '{WORDS}') AS w FROM documents)
SELECT doc_id, len(w)::BIGINT AS tokens, len(list_distinct(w))::BIGINT AS different, array_to_string(w, '|') AS joined FROM w"""
SQL["safe_filename"] = rf"""
SELECT p_partkey, substring(trim(regexp_replace(regexp_replace({fold("' Żółć: ' || p_name || ' /#1*\"? ' || p_partkey || ' '")}, '[#%*:<>?/\\|"]', '', 'g'), '\s+', '_', 'g'), '_'), 1, 120) AS name FROM part"""
SQL["line_kind"] = rf"""
WITH f AS (SELECT p_partkey, [p_size::VARCHAR, '+' || p_size || '.56', p_name, p_size || ' ' || p_name, p_size || ' 1 2 3 ' || p_name] AS f FROM part),
e AS (SELECT p_partkey, unnest(range(5)) AS form, {form('x')} AS n FROM (SELECT p_partkey, unnest(f) AS x FROM f))
SELECT p_partkey, form::BIGINT AS form, n AS normalized, CASE WHEN regexp_full_match(n, '[+-]?\d+([.,]\d+)?') THEN 'elevation'
  WHEN n <> '' AND len(list_filter(string_split(n, ' '), lambda w: regexp_full_match(w, '\d+([.,]\d+)?'))) / len(string_split(n, ' ')) > 0.7 THEN 'number' ELSE 'text' END AS kind FROM e""".replace("SELECT p_partkey, unnest(range(5)) AS form, ", "SELECT p_partkey, form, ").replace("(SELECT p_partkey, unnest(f) AS x FROM f)", "(SELECT p_partkey, unnest(range(5)) AS form, unnest(f) AS x FROM f)")

_TEXTS = f"t AS (SELECT p_partkey::VARCHAR AS crop_id, {norm('p_name')} AS normalized_text, {search('p_name')} AS s FROM part)"


def _phrases(relation: str) -> str:
    return f"""SELECT ElementCode AS code, {search('Phrase')} AS phrase, row_ord AS o, Weight * CASE WHEN contains({search('Phrase')}, ' ') THEN 1.3 ELSE 1.0 END * CASE WHEN MatchType = 'fuzzy' THEN 0.7 ELSE 1.0 END AS c, true AS pos FROM {relation} WHERE Active"""


def _classified(dictionary: str, priorities: str) -> str:
    """Relations t, h (hits), s (scores), w (weighted), k (best codes)."""
    return f"""{_TEXTS}, {dictionary},
h AS (SELECT crop_id, code, phrase, c, pos, o FROM t JOIN d ON phrase <> '' AND contains(s, phrase)),
s AS (SELECT crop_id, code, round(sum(c), 9) AS score, min(o) AS first_ord, arg_max(phrase, (c, -o)) FILTER (pos) AS best_phrase, list_sort(coalesce(list(DISTINCT phrase) FILTER (pos), [])) AS phrases FROM h GROUP BY 1, 2),
pr AS ({priorities}),
w AS (SELECT s.*, coalesce(p, 100.0) AS priority, round(score * coalesce(p, 100.0) / 100, 9) AS weighted FROM s LEFT JOIN pr ON pr.code = s.code),
r AS (SELECT *, row_number() OVER (PARTITION BY crop_id, priority >= 40 ORDER BY weighted DESC, first_ord) AS k FROM w WHERE weighted >= 0.5),
k AS (SELECT crop_id, list({{'p': CASE WHEN priority >= 40 THEN k ELSE 2 + k END, 'c': code, 'w': weighted, 'x': phrases}} ORDER BY CASE WHEN priority >= 40 THEN k ELSE 2 + k END) AS top FROM r WHERE k <= CASE WHEN priority >= 40 THEN 2 ELSE 1 END GROUP BY 1),
total AS (SELECT crop_id, sum(greatest(weighted, 0)) AS total FROM w GROUP BY 1),
c AS (SELECT t.crop_id, normalized_text, coalesce([x.c FOR x IN top], []) AS codes, list_sort(list_distinct(flatten(coalesce([x.x FOR x IN top], [])))) AS keywords, coalesce(top[1].w, 0.0) AS match_score, CASE WHEN top IS NULL THEN 0.0 ELSE round(top[1].w / CASE WHEN total > 0 THEN total ELSE 1 END, 9) END AS confidence FROM t LEFT JOIN k USING (crop_id) LEFT JOIN total USING (crop_id)),
f AS (SELECT *, CASE WHEN len(codes) > 0 THEN array_to_string(codes, '-') ELSE 'UNMATCHED' END AS code, list_filter(keywords, lambda x: length(x) > 2 AND NOT regexp_full_match(x, '\\d+')) AS tags FROM c)"""


_SHOWN = """SELECT crop_id, code AS classification_code, array_to_string(codes, ',') AS elements, match_score::DOUBLE AS match_score, confidence::DOUBLE AS confidence, array_to_string(keywords, ',') AS keywords, array_to_string(tags, '; ') AS sharepoint_tags,
  trim(code || ' ' || array_to_string(tags, ' ') || ' ' || substring(normalized_text, 1, 120)) AS search_text, CASE WHEN len(codes) > 0 THEN 'matched' ELSE 'unmatched' END AS status, coalesce(codes[1], '') AS matched_dictionary_key, normalized_text FROM f"""
_D = f"{values('SYNONYMS', 'sy')}, {values('NEGATIVES', 'ne')}, {values('PRIORITIES', 'pi')}"
_FULL = f"{_D}, d AS ({_phrases('sy')} UNION ALL SELECT ElementCode, {search('Phrase')}, 1000 + row_ord, -Penalty, false FROM ne)"
_PRIORITIES = "SELECT ElementCode AS code, arg_max(Priority, row_ord) AS p FROM pi GROUP BY 1"
_FALLBACK_ROWS = f"""el AS (SELECT ElementCode AS code, row_ord * 10 + n AS o, {norm('v')} AS phrase, wt FROM (
  SELECT ElementCode, row_ord, 0 AS n, NamePL AS v, 1.0 AS wt FROM es UNION ALL SELECT ElementCode, row_ord, 1, NameEN, 1.0 FROM es UNION ALL SELECT ElementCode, row_ord, 2, Category, 0.35 FROM es)),
fb AS (SELECT code, phrase, min(o) AS o, arg_min(wt, o) AS wt FROM el WHERE phrase NOT IN ('', 'nan') GROUP BY 1, 2)"""
SQL["classify"] = f"WITH {_classified(_FULL, _PRIORITIES)} {_SHOWN}"
SQL["classify_scores"] = f"WITH {_classified(_FULL, _PRIORITIES)} SELECT crop_id, code, score::DOUBLE AS score, priority::DOUBLE AS priority, weighted::DOUBLE AS weighted, best_phrase, array_to_string(phrases, ',') AS phrases FROM w"
SQL["classify_large_dictionary"] = f"WITH {_classified(_FULL, _PRIORITIES)} SELECT crop_id, code, round(sum(c), 9)::DOUBLE AS score, count(*)::BIGINT AS hits FROM h GROUP BY 1, 2"
_FALLBACK = f"{values('ELEMENTS', 'es')}, {_FALLBACK_ROWS}, d AS (SELECT code, {search('phrase')} AS phrase, o, wt * CASE WHEN contains({search('phrase')}, ' ') THEN 1.3 ELSE 1.0 END AS c, true AS pos FROM fb)"
SQL["classify_fallback"] = f"WITH {_classified(_FALLBACK, 'SELECT ElementCode AS code, arg_max(Priority, row_ord) AS p FROM es GROUP BY 1')} {_SHOWN}"
SQL["synonyms_from_elements"] = f"WITH {grown_values('ELEMENTS', 'es')}, {_FALLBACK_ROWS} SELECT code, phrase, wt::DOUBLE AS weight FROM fb"
_TERM_ROWS = f"""te AS (SELECT code, {norm('v')} AS term, o FROM (
  SELECT ElementCode AS code, NamePL AS v, row_ord * 10 AS o FROM es UNION ALL SELECT ElementCode, NameEN, row_ord * 10 + 1 FROM es UNION ALL SELECT ElementCode, Phrase, 1000 + row_ord * 10 FROM sy) WHERE {norm('v')} NOT IN ('', 'nan'))"""
_TERMS = f"{values('ELEMENTS', 'es')}, {values('SYNONYMS', 'sy')}, {_TERM_ROWS}"
SQL["reference_terms"] = f"WITH {grown_values('ELEMENTS', 'es')}, {grown_values('SYNONYMS', 'sy')}, {_TERM_ROWS} SELECT code, term, o::BIGINT AS ord FROM te"
SQL["suggest_substring"] = f"""
WITH {_TERMS}, c AS (SELECT DISTINCT {fold(norm('p_name'))} AS candidate FROM part), r AS (SELECT code, {fold('term')} AS t, o FROM te)
SELECT candidate, arg_min(code, o) AS code FROM c JOIN r ON t <> '' AND (contains(t, candidate) OR contains(candidate, t)) GROUP BY 1"""
SQL["import_accepted"] = f"""
WITH {grown_values('SYNONYMS', 'sy')}, {grown_values('CANDIDATES', 'ca')},
u AS (SELECT ElementCode AS code, Phrase AS phrase, Weight AS weight, MatchType AS match_type, Active AS active, row_ord AS o FROM sy
  UNION ALL SELECT trim(SuggestedElementCode), trim(Phrase), 1.0, 'exact', true, 1000000000 + row_ord FROM ca WHERE lower(trim(Decision)) = 'accept' AND trim(coalesce(SuggestedElementCode, '')) <> '' AND trim(coalesce(Phrase, '')) <> '')
SELECT code, phrase, weight::DOUBLE AS weight, match_type, active FROM u QUALIFY row_number() OVER (PARTITION BY code, phrase ORDER BY o) = 1"""

_TOKENS = f"""k AS (SELECT list_filter(regexp_extract_all({norm('text')}, '{WORDS}'), lambda w: length(w) > 2 AND NOT regexp_full_match(w, '[\\p{{Nd}}\\p{{No}}]+') AND NOT list_contains({_list(tx.FREQUENCY_STOP_WORDS)}, w)) AS w FROM documents)"""
SQL["ngram_frequency"] = f"WITH {_TOKENS}, g AS (SELECT unnest({grams('w', 1, 3)}) AS g FROM k) SELECT array_to_string(g, ' ') AS phrase, count(*)::BIGINT AS n FROM g GROUP BY 1"
SQL["analyze_text"] = "WITH documents AS (SELECT p_name AS text FROM part), " + SQL["ngram_frequency"].removeprefix("WITH ")
_STOP = _list(tx.PHRASE_STOP_WORDS)
_CORE = rf"""l AS (SELECT doc_id, regexp_split_to_array(text, '[\n\r]+') AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS line FROM l), cr AS (SELECT doc_id, {strip('line')} AS core FROM e),
tk AS (SELECT doc_id, regexp_extract_all(lower({strip('core')}), '{WORDS}') AS w FROM cr WHERE NOT {noise('core')}),
gr AS (SELECT doc_id, unnest(list_concat(CASE WHEN len(w) <= 6 THEN [w] ELSE [] END, {grams('w', 2, 4)})) AS g FROM tk WHERE len(w) >= 2),
ph AS (SELECT doc_id, array_to_string(g, ' ') AS phrase FROM gr WHERE NOT list_contains({_STOP}, g[1]) AND NOT list_contains({_STOP}, g[-1])),
fd AS (SELECT doc_id, phrase, {fold(norm('phrase'))} AS normalized_phrase, count(*)::BIGINT AS occurrence_count FROM ph GROUP BY 1, 2),
cp AS (SELECT * FROM fd WHERE length({fold('phrase')}) >= 4 AND NOT regexp_full_match({fold('phrase')}, '[\d\s./x×+-]+'))"""
SQL["core_phrases"] = f"WITH {_CORE} SELECT doc_id, phrase, normalized_phrase, occurrence_count FROM cp"
SQL["phrase_rollup"] = f"""
WITH {_CORE}, i AS (SELECT normalized_phrase, list_sort(list(DISTINCT doc_id::VARCHAR)) AS ids FROM cp GROUP BY 1)
SELECT normalized_phrase, arg_min(phrase, (doc_id, -occurrence_count, phrase)) AS surface, any_value(len(ids))::BIGINT AS sources, sum(occurrence_count)::BIGINT AS occurrences, any_value(array_to_string(ids[1:5], ';')) AS ids FROM cp JOIN i USING (normalized_phrase) GROUP BY 1"""
SQL["token_window"] = f"""
WITH k AS (SELECT p_partkey::VARCHAR AS crop_id, list_filter(string_split({form("p_name || ' ' || p_name || ' end ' || p_name")}, ' '), lambda w: length(w) >= 4) AS w FROM part),
e AS (SELECT crop_id, w, unnest(range(len(w))) AS i FROM k)
SELECT crop_id, i::BIGINT AS token_index, r AS radius, array_to_string(w[greatest(1, i + 1 - r) : i + 1 + r], ' ') AS "window" FROM e, (VALUES (1), (2)) x(r)"""
_LINES = rf"""ln AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x85]') AS l FROM documents),
le AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS raw FROM ln), lf AS (SELECT doc_id, i, {form('raw')} AS n FROM le),
lt AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lf WHERE n <> '' AND NOT regexp_full_match(n, '[+-]?\d+([.,]\d+)?') AND len(list_filter(string_split(n, ' '), lambda w: regexp_full_match(w, '\d+([.,]\d+)?'))) / len(string_split(n, ' ')) <= 0.7)"""
SQL["line_segments"] = f"""
WITH {_LINES}
SELECT doc_id, '1_line' AS segment_type, i::BIGINT AS start_line, i::BIGINT AS end_line, n AS text FROM lt
UNION ALL SELECT a.doc_id, '2_line', a.i::BIGINT, b.i::BIGINT, a.n || ' ' || b.n FROM lt a JOIN lt b ON a.doc_id = b.doc_id AND b.k = a.k + 1
UNION ALL SELECT a.doc_id, '3_line', a.i::BIGINT, c.i::BIGINT, a.n || ' ' || b.n || ' ' || c.n FROM lt a JOIN lt b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN lt c ON a.doc_id = c.doc_id AND c.k = a.k + 2"""


def alias(x: str, table: dict[str, str]) -> str:
    return f"CASE {form(x)} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {form(x)} END"


def material(q: str) -> str:
    own = f"string_split({form(q)}, ' ')"
    return "list_filter([" + ", ".join(f"CASE WHEN list_has_any({own}, {_list(words)}) THEN '{name}' END" for name, words in sorted(tx.MATERIALS.items())) + "], lambda x: x IS NOT NULL)"


_ENTRY = f"""SELECT *, {form('v')} AS value, CASE WHEN contains({form('v')}, ' ') THEN 'specific' ELSE 'generic' END AS kind"""
SQL["unpivot_elements"] = f"""
WITH {grown_values('MATCHER', 'ma')}, u AS (SELECT *, Phrase1 AS v FROM ma UNION ALL SELECT *, Phrase2 FROM ma), n AS ({_ENTRY} FROM u)
SELECT ElementCode AS code, coalesce(Priority, 0.0) AS priority, {form('ContextGroup')} AS context_group, {form('MaterialGroup')} AS material_group, {alias('SideSignal', tx.SIDES)} AS side_signal, coalesce(SideWeight, 0.0) AS side_weight,
  {alias('PositionSignal', tx.POSITIONS)} AS position_signal, coalesce(PositionWeight, 0.0) AS position_weight, {form('IsStrongAnchor')} IN ('yes', 'true', '1', 'tak') AS is_strong_anchor, coalesce(AnchorWeight, 0.0) AS anchor_weight, value, kind FROM n WHERE value <> ''"""
SQL["context_keywords"] = f"""
WITH {grown_values('KEYWORDS', 'ke')}, u AS (SELECT *, Word1 AS v FROM ke UNION ALL SELECT *, Word2 FROM ke), n AS ({_ENTRY} FROM u)
SELECT {form('ContextSignal')} AS context_signal, {alias('SideSignal', tx.SIDES)} AS side_signal, coalesce(SideWeight, 0.0) AS side_weight, {alias('PositionSignal', tx.POSITIONS)} AS position_signal, coalesce(PositionWeight, 0.0) AS position_weight, value, kind FROM n WHERE value <> ''"""
SQL["canonical_maps"] = f"""
WITH w AS (SELECT p_partkey, ['EXT', 'zewnętrzny ', 'int', 'oba', 'any', '', 'left', 'dół', 'Góra', 'mid'][p_partkey % 10 + 1] AS w FROM part)
SELECT p_partkey, {alias('w', tx.SIDES)} AS side, {alias('w', tx.POSITIONS)} AS position FROM w"""
SQL["material_conflict"] = f"""
WITH q AS (SELECT p_partkey, ['steel ', 'concrete brick ', '', 'murowana '][p_partkey % 4 + 1] || p_name AS q, ['steel', 'rc', 'masonry', 'mixed', '', 'plasterboard'][p_partkey % 6 + 1] AS m FROM part),
n AS (SELECT p_partkey, q, m, {material('q')} AS a FROM q), c AS (SELECT *, len(a) > 0 AND m NOT IN ('', 'none', 'mixed', 'unknown') AND NOT list_contains(a, m) AS conflict FROM n)
SELECT p_partkey, array_to_string(a, ',') AS materials, conflict, NOT conflict AND (NOT contains({form('q')}, ' ') OR list_contains(string_split({form('q')}, ' '), 'steel')) AS valid FROM c"""
SQL["numbers"] = "SELECT p_partkey, [12.5, 1.5, 1.5, 1.5, 7.0][p_partkey % 5 + 1]::DOUBLE AS n FROM part"

# --- extraction and export ---


def _named(n: str) -> str:
    """The area of the n-th colour of the test rows."""
    return f"CASE WHEN {n} % 4 = 0 AND abs({n} % 9 - 4) <= 3 THEN 'detail' WHEN {n} % 4 = 1 AND abs({n} % 9 - 4) <= 3 THEN 'titleblock' WHEN {n} % 4 = 2 THEN 'ignore' END"


SQL["area_type"] = f"SELECT p_partkey, coalesce({_named('p_partkey')}, {_named('(p_partkey + 1)')}, 'unknown') AS area_type FROM part"


def _clip(p: str, right: str = "200") -> str:
    ok = " AND ".join(f"isfinite({p}{s})" for s in ("x0", "y0", "x1", "y1"))
    return f"CASE WHEN {ok} AND {p}x0 <> {p}x1 AND {p}y0 <> {p}y1 AND least({right}, greatest({p}x0, {p}x1)) > greatest(0, least({p}x0, {p}x1)) AND least({right}, greatest({p}y0, {p}y1)) > greatest(0, least({p}y0, {p}y1)) THEN {{'x0': greatest(0, least({p}x0, {p}x1)), 'y0': greatest(0, least({p}y0, {p}y1)), 'x1': least({right}, greatest({p}x0, {p}x1)), 'y1': least({right}, greatest({p}y0, {p}y1))}} END"


SQL["clip_sanitize"] = f"""
WITH r AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 11 = 0 THEN 'NaN'::DOUBLE WHEN p_partkey % 13 = 0 THEN 'Infinity'::DOUBLE ELSE (p_partkey * 7 % 300)::DOUBLE END AS x0, (p_partkey * 3 % 250)::DOUBLE AS y0, (p_partkey * 11 % 300)::DOUBLE AS x1, (p_partkey * 5 % 250)::DOUBLE AS y1 FROM part),
b AS (SELECT *, CASE WHEN n % 3 = 0 THEN x0 - 5 END AS bx0, CASE WHEN n % 3 = 0 THEN y0 - 5 END AS by0, CASE WHEN n % 3 = 0 THEN x1 - 5 END AS bx1, CASE WHEN n % 3 = 0 THEN y1 - 5 END AS by1 FROM r),
c AS (SELECT n, {_clip('')} AS s, coalesce({_clip('b')}, {_clip('')}) AS c FROM b)
SELECT n AS p_partkey, s.x0 AS s_x0, s.y0 AS s_y0, s.x1 AS s_x1, s.y1 AS s_y1, greatest(c.x0 - 10, 0) AS c_x0, greatest(c.y0 - 10, 0) AS c_y0, least(c.x1 + 10, 200) AS c_x1, least(c.y1 + 10, 200) AS c_y1 FROM c"""
SQL["clip_sanitize"] = SQL["clip_sanitize"].replace("greatest(c.x0 - 10, 0)", "CASE WHEN c IS NOT NULL THEN greatest(c.x0 - 10, 0) END").replace("greatest(c.y0 - 10, 0)", "CASE WHEN c IS NOT NULL THEN greatest(c.y0 - 10, 0) END").replace("least(c.x1 + 10, 200)", "CASE WHEN c IS NOT NULL THEN least(c.x1 + 10, 200) END").replace("least(c.y1 + 10, 200)", "CASE WHEN c IS NOT NULL THEN least(c.y1 + 10, 200) END")
SQL["extraction_report"] = f"""
WITH a AS (SELECT p_partkey AS n, p_name, floor(p_partkey / 50)::BIGINT AS page_index, row_number() OVER (ORDER BY floor(p_partkey / 50), p_partkey) AS i, (p_partkey * 7 % 180)::DOUBLE AS x0, (p_partkey * 3 % 180)::DOUBLE AS y0, (p_partkey * 9 % 180)::DOUBLE AS x1, (p_partkey * 5 % 180)::DOUBLE AS y1 FROM part),
c AS (SELECT *, {_clip('')} AS c, CASE WHEN n % 2 = 0 THEN p_name ELSE '' END AS t FROM a WHERE n % 5 <> 0),
k AS (SELECT *, printf('My_Project_page_%03d_detail_%03d', page_index + 1, i) AS name FROM c WHERE c IS NOT NULL AND n % 3 <> 0)
SELECT page_index, i::BIGINT AS annotation_index, 'ok' AS status, NULL::VARCHAR AS reason, name AS base_name, CASE WHEN length(t) >= 10 THEN t WHEN t = '' THEN 'read text' ELSE t || chr(10) || chr(10) || 'read text' END AS raw_text,
  CASE WHEN length(t) >= 10 THEN 'native_pdf_text' WHEN t = '' THEN 'ocr_text' ELSE 'native_pdf_text+ocr_text' END AS text_source FROM k
UNION ALL SELECT page_index, i::BIGINT, 'skipped', 'invalid_clip', NULL, NULL, NULL FROM c WHERE c IS NULL"""
SQL["export_metadata"] = f"""
WITH {_classified(_FULL, _PRIORITIES)}, x AS (SELECT p_partkey::VARCHAR AS crop_id, (p_partkey % 40)::BIGINT AS page_number, CASE WHEN p_partkey % 7 <> 0 THEN code END AS proposed_code FROM part JOIN f ON f.crop_id = p_partkey::VARCHAR)
SELECT crop_id, page_number, proposed_code, 'DET_' || coalesce(proposed_code, 'UNCLASSIFIED') || '_REF-PROJECT_S' || page_number || '_' || crop_id || '.pdf' AS file_name, 'Do weryfikacji' AS export_status FROM x"""

# --- boxes ---
_B = f"WITH RECURSIVE {SQL_BOXES}"
_W, _H = "greatest(0, x1 - x0)", "greatest(0, y1 - y0)"
_AREA = f"({_W}::BIGINT * {_H})"


def _area(p: str) -> str:
    return f"(greatest(0, {p}.x1 - {p}.x0)::BIGINT * greatest(0, {p}.y1 - {p}.y0))"


def _shared(p: str, q: str) -> str:
    return f"(greatest(0, least({p}.x1, {q}.x1) - greatest({p}.x0, {q}.x0))::BIGINT * greatest(0, least({p}.y1, {q}.y1) - greatest({p}.y0, {q}.y0)))"


def _touch(t: int, p: str = "a", q: str = "b") -> str:
    return f"({p}.x0 < {q}.x1 + {t} AND {q}.x0 < {p}.x1 + {t} AND {p}.y0 < {q}.y1 + {t} AND {q}.y0 < {p}.y1 + {t})"


def _within(m: int, p: str, q: str) -> str:
    return f"({q}.x0 >= {p}.x0 - {m} AND {q}.y0 >= {p}.y0 - {m} AND {q}.x1 <= {p}.x1 + {m} AND {q}.y1 <= {p}.y1 + {m})"


SQL["box_metrics"] = f"{_B} SELECT page, id, {_W}::BIGINT AS w, {_H}::BIGINT AS h, {_AREA} AS area, greatest(0, x0 - 35)::BIGINT AS ex0, least(2400, y1 + 35)::BIGINT AS ey1, round(x1 * 72.0::DOUBLE / 150, 4) AS px1 FROM boxes"
SQL["component_kind"] = f"{_B} SELECT page, id, CASE WHEN pixel_area < 20 THEN 'noise' WHEN text_overlap_ratio >= 0.8 AND ({_W} >= 150 OR {_H} >= 80 OR pixel_area >= 200) THEN 'geometry' WHEN text_overlap_ratio >= 0.8 THEN 'text_ink' WHEN pixel_area >= 40 THEN 'geometry' ELSE 'noise' END AS kind FROM boxes"
_ASPECT = f"(greatest({_W}, {_H}) / greatest(1, least({_W}, {_H})))"
_ROLE = f"CASE WHEN text_overlap_ratio > 0.3 OR {_W} <= 0 OR {_H} <= 0 THEN 'small' WHEN {_ASPECT} > 6 AND fill_ratio < 0.25 THEN 'small' WHEN {_AREA} < 7500 AND fill_ratio > 0.35 THEN 'small' WHEN {_AREA} >= 15000 AND fill_ratio > 0.12 THEN 'core' WHEN {_AREA} >= 11250 AND fill_ratio > 0.06 AND {_ASPECT} <= 6 THEN 'core' ELSE 'small' END"
SQL["geometry_role"] = f"{_B} SELECT page, id, {_ROLE} AS role FROM boxes"
SQL["fallback_cores"] = f"""{_B}, r AS (SELECT *, CASE WHEN page % 3 = 0 THEN 'small' ELSE {_ROLE} END AS role FROM boxes),
k AS (SELECT *, sum((role = 'core')::INT) OVER (PARTITION BY page) AS cores, row_number() OVER (PARTITION BY page ORDER BY {_AREA} DESC, id) AS k, greatest(1, least(5, count(*) OVER (PARTITION BY page) // 4)) AS few FROM r)
SELECT page, id, CASE WHEN cores > 0 THEN role WHEN k <= few THEN 'core' ELSE 'small' END AS role FROM k"""
_TOUCHING = f"tp AS (SELECT a.page, a.id AS a, b.id AS b FROM own a JOIN own b ON a.page = b.page AND a.id < b.id AND {_touch(6)})"
_ABSORBED = f"tp AS (SELECT a.page, a.id AS a, b.id AS b FROM own a JOIN own b ON a.page = b.page AND a.id < b.id AND ({_within(8, 'a', 'b')} OR {_within(8, 'b', 'a')} OR {_shared('a', 'b')} / greatest(1, least({_area('a')}, {_area('b')})) >= 0.25))"
SQL["touch_pairs"] = f"{_B}, own AS (SELECT * FROM boxes), {_TOUCHING} SELECT page, a, b FROM tp"
SQL["absorb_pairs"] = f"{_B}, own AS (SELECT * FROM boxes), {_ABSORBED} SELECT page, a, b FROM tp"
_LEVEL = lambda s: f"((b.y0 + b.y1) / 2 >= a.y0 - {s} AND (b.y0 + b.y1) / 2 <= a.y1 + {s})"
_CORES = "a AS (SELECT * FROM boxes WHERE l_linenumber = 1), b AS (SELECT * FROM boxes WHERE l_linenumber > 1)"
SQL["attach_small"] = f"{_B}, {_CORES} SELECT a.page, a.id AS core, b.id AS small FROM a JOIN b ON a.page = b.page AND ({_within(8, 'a', 'b')} OR {_shared('a', 'b')} / greatest(1, {_area('b')}) >= 0.25 OR {_touch(12)} OR ({_LEVEL(120)} AND ((b.x1 <= a.x0 AND a.x0 - b.x1 <= 360) OR (b.x0 >= a.x1 AND b.x0 - a.x1 <= 360))))"
SQL["attach_text"] = f"{_B}, {_CORES} SELECT a.page, a.id AS core, b.id AS text_id FROM a JOIN b ON a.page = b.page AND ({_within(-2, 'a', 'b')} OR {_touch(12)})"
SQL["side_knn"] = f"""{_B}, {_CORES}, s AS (SELECT a.page, a.id AS core, CASE WHEN b.x1 <= a.x0 THEN 'left' ELSE 'right' END AS side, b.id AS text_id, (CASE WHEN b.x1 <= a.x0 THEN a.x0 - b.x1 ELSE b.x0 - a.x1 END)::BIGINT AS dx FROM a JOIN b ON a.page = b.page AND {_LEVEL(25)} AND (b.x1 <= a.x0 OR b.x0 >= a.x1))
SELECT page, core, side, text_id, dx FROM s WHERE dx <= 45 QUALIFY row_number() OVER (PARTITION BY page, core, side ORDER BY dx, text_id) <= 4"""
SQL["percentile_split"] = f"{_B}, p AS (SELECT page, greatest(quantile_cont({_AREA}, 0.75), 15000) AS l FROM boxes GROUP BY 1) SELECT page, id, CASE WHEN {_AREA} >= l THEN 'large' ELSE 'small' END AS part FROM boxes JOIN p USING (page)"
SQL["unique_texts"] = f"{_B} SELECT page, id FROM boxes QUALIFY row_number() OVER (PARTITION BY page, x0 // 400, y0 // 400, x1 // 400, y1 // 400, id % 3 ORDER BY id) = 1"

# --- matcher on given scores ---
_HITS = f"""{values('MATCHER', 'ma')}, {values('KEYWORDS', 'ke')},
en AS (SELECT ElementCode AS code, coalesce(Priority, 0.0) AS priority, {form('ContextGroup')} AS context_group, {alias('SideSignal', tx.SIDES)} AS side_signal, coalesce(SideWeight, 0.0) AS side_weight, {alias('PositionSignal', tx.POSITIONS)} AS position_signal, coalesce(PositionWeight, 0.0) AS position_weight,
  {form('IsStrongAnchor')} IN ('yes', 'true', '1', 'tak') AS strong, coalesce(AnchorWeight, 0.0) AS anchor, {form('Phrase1')} AS value, CASE WHEN contains({form('Phrase1')}, ' ') THEN 'specific' ELSE 'generic' END AS kind, row_ord FROM ma),
hi AS (SELECT floor(p_partkey / 20)::BIGINT AS doc_id, p_partkey AS n, p_name AS query, en.*, 75.0 + p_partkey % 26 AS score, p_partkey % 3 + 1 AS pass, p_partkey % 4 AS token_index, p_partkey % 20 AS line_index FROM part JOIN en ON p_partkey % 5 = row_ord),
hs AS (SELECT *, printf('%.1f', (score + CASE pass WHEN 2 THEN 10 WHEN 3 THEN 15 ELSE 0 END - CASE WHEN kind = 'generic' AND pass > 1 THEN 15 ELSE 0 END + CASE WHEN strong THEN anchor * 0.15::DOUBLE ELSE 0 END)::DOUBLE)::DOUBLE AS final_score FROM hi),
be AS (SELECT * FROM hs QUALIFY row_number() OVER (PARTITION BY doc_id, code ORDER BY final_score DESC, score DESC, token_index, pass, line_index, row_ord) = 1),
kw AS (SELECT {form('ContextSignal')} AS context_signal, {alias('SideSignal', tx.SIDES)} AS side_signal, coalesce(SideWeight, 0.0) AS side_weight, {alias('PositionSignal', tx.POSITIONS)} AS position_signal, coalesce(PositionWeight, 0.0) AS position_weight, {form('Word1')} AS value, row_ord FROM ke),
ch AS (SELECT floor(p_partkey / 20)::BIGINT AS doc_id, kw.*, 80.0 + p_partkey % 21 AS score, p_partkey % 5 AS line_index FROM part JOIN kw ON p_partkey % 6 = row_ord QUALIFY row_number() OVER (PARTITION BY floor(p_partkey / 20), p_partkey % 5, context_signal, value ORDER BY 80.0 + p_partkey % 21 DESC, row_ord) = 1),
si AS (SELECT doc_id, side_signal, side_weight, position_signal, position_weight, final_score AS s, context_group AS g FROM be UNION ALL SELECT doc_id, side_signal, side_weight, position_signal, position_weight, score, context_signal FROM ch),
su AS (SELECT doc_id, {', '.join(f"round(sum(CASE WHEN side_signal = '{x}' THEN side_weight * (s / 100) WHEN side_signal = 'both' THEN side_weight * 0.5 * (s / 100) ELSE 0 END)::DOUBLE, 6) AS {x}" for x in ('external', 'internal'))}, {', '.join(f'round(sum(CASE WHEN position_signal = {chr(39)}{x}{chr(39)} THEN position_weight * (s / 100) ELSE 0 END)::DOUBLE, 6) AS {x}' for x in ('base', 'middle', 'top'))} FROM si GROUP BY 1),
gs AS (SELECT doc_id, array_to_string(list(g ORDER BY s DESC, g), ',') AS groups FROM (SELECT doc_id, g, round(sum(s)::DOUBLE, 6) AS s FROM si WHERE coalesce(g, '') <> '' GROUP BY 1, 2) GROUP BY 1),
cx AS (SELECT su.*, CASE WHEN greatest(external, internal) < 30 OR abs(external - internal) < 20 THEN 'unresolved' WHEN external >= internal THEN 'external' ELSE 'internal' END AS side, CASE WHEN greatest(base, middle, top) < 30 THEN 'unresolved' WHEN base = greatest(base, middle, top) THEN 'base' WHEN middle = greatest(base, middle, top) THEN 'middle' ELSE 'top' END AS position, coalesce(groups, '') AS groups FROM su LEFT JOIN gs USING (doc_id)),
bo AS (SELECT be.*, side, position, (CASE WHEN side = 'unresolved' THEN 0 WHEN side_signal = side THEN side_weight * 0.25 WHEN side_signal = 'both' THEN side_weight * 0.125 ELSE 0 END + CASE WHEN position <> 'unresolved' AND position_signal = position THEN position_weight * 0.25 ELSE 0 END)::DOUBLE AS boost FROM be JOIN cx USING (doc_id)),
bf AS (SELECT *, printf('%.1f', (boost)::DOUBLE)::DOUBLE AS context_boost, printf('%.1f', (final_score + boost)::DOUBLE)::DOUBLE AS final_score_context FROM bo),
fi AS (SELECT *, printf('%.1f', (final_score_context + CASE WHEN side = 'unresolved' THEN 0 WHEN side_signal = side THEN 20 WHEN side_signal NOT IN ('both', 'unknown') THEN -30 ELSE 0 END + CASE WHEN position = 'unresolved' THEN 0 WHEN position_signal = position THEN 20 WHEN position_signal NOT IN ('any', 'unknown') THEN -15 ELSE 0 END)::DOUBLE)::DOUBLE AS fit FROM bf)"""
SQL["dedupe_elements"] = f"WITH {_HITS} SELECT doc_id, code, n, score::DOUBLE AS score, final_score::DOUBLE AS final_score FROM be"
SQL["infer_context"] = f"WITH {_HITS} SELECT doc_id, side, position, external, internal, base, middle, top, groups FROM cx"
SQL["context_boost"] = f"WITH {_HITS} SELECT doc_id, code, context_boost, final_score_context::DOUBLE AS final_score_context, fit::DOUBLE AS fit FROM fi"
SQL["final_candidates"] = f"""WITH {_HITS}, st AS (SELECT *, CASE WHEN coalesce(context_group, '') = '' THEN 'unknown' ELSE context_group END AS "group" FROM fi WHERE final_score_context >= 100 AND NOT ((kind = 'generic' OR (pass = 1 AND NOT contains(query, ' ') AND kind = 'specific')) AND score < 95))
SELECT doc_id, "group", code, fit::DOUBLE AS detail_fit_score FROM st QUALIFY row_number() OVER (PARTITION BY doc_id, "group" ORDER BY fit DESC, kind = 'specific' DESC, final_score_context DESC, score DESC, priority DESC, code) = 1"""

ORACLE_SQL = {k: v for k, v in SQL.items()}

#: Longest common subsequences of pairs(q, v), a character of q a step: row l has those of q's beginning with each beginning of v.
_LCS = """s(q, v, i, l) AS (
  SELECT q, v, 0, list_transform(range(0, length(v) + 1), lambda x: 0) FROM pairs
  UNION ALL
  SELECT q, v, i + 1, list_prepend(0, list_transform(range(1, len(t) + 1), lambda j: list_max(t[1:j])))
  FROM (SELECT q, v, i, list_transform(range(1, length(v) + 1), lambda j: greatest(l[j + 1], CASE WHEN v[j] = q[i + 1] THEN l[j] + 1 ELSE 0 END)) AS t FROM s WHERE i < length(q))),
raw AS (SELECT q, v, 200.0::DOUBLE * l[length(v) + 1] / (length(q) + length(v)) AS raw FROM s WHERE i = length(q))"""

ORACLE_SQL["fuzzy_topk_indel"] = f"""
WITH RECURSIVE e AS (SELECT lower(p_type || ' ' || p_name) AS v, min(p_partkey) AS o, arg_min(p_brand, p_partkey) AS code FROM part GROUP BY 1),
pairs AS (SELECT q, v FROM (SELECT DISTINCT p_name AS q FROM part), e),
{_LCS},
k AS (SELECT q, v, code, raw, row_number() OVER (PARTITION BY q ORDER BY raw DESC, o) AS k FROM raw JOIN e USING (v))
SELECT q AS query, code, v AS value, round_even(raw, 1) AS score FROM k WHERE k <= 5 AND round_even(raw, 1) >= 60
"""

ORACLE_SQL["suggest_indel"] = f"""
WITH RECURSIVE c AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE array_to_string(list_reverse(string_split(p_name, ' ')), ' ') END AS q FROM part),
e AS (SELECT p_name AS v, min(p_partkey) AS o, arg_min(p_brand, p_partkey) AS code FROM part GROUP BY 1),
sub AS (SELECT q, arg_min(code, o) AS code FROM c JOIN e ON contains(v, q) OR contains(q, v) GROUP BY q),
pairs AS (SELECT q, v FROM c, e WHERE q NOT IN (SELECT q FROM sub)),
{_LCS},
best AS (SELECT q, code, raw FROM raw JOIN e USING (v) WHERE raw >= 60 QUALIFY row_number() OVER (PARTITION BY q ORDER BY raw DESC, o) = 1)
SELECT c.q AS phrase, coalesce(sub.code, best.code, '') AS code, CASE WHEN sub.code IS NOT NULL THEN 'substring' WHEN best.code IS NOT NULL THEN 'fuzzy' ELSE '' END AS by,
  CASE WHEN sub.code IS NOT NULL THEN 1.0 WHEN best.code IS NOT NULL THEN round(best.raw / 100, 3) ELSE 0.0 END::DOUBLE AS confidence
FROM c LEFT JOIN sub ON sub.q = c.q LEFT JOIN best ON best.q = c.q
"""

ORACLE_SQL["greedy_dedupe"] = f"""
WITH RECURSIVE {SQL_BOXES},
b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY area DESC, id, x0, y0, x1, y1) AS r FROM (SELECT DISTINCT page, id, x0, y0, x1, y1, (x1 - x0)::BIGINT * (y1 - y0) AS area FROM boxes)),
c AS (SELECT p.page, p.r AS i, q.r AS j FROM b p JOIN b q ON p.page = q.page AND p.r <> q.r AND p.x0 < q.x1 AND q.x0 < p.x1 AND p.y0 < q.y1 AND q.y0 < p.y1
  WHERE (least(p.x1, q.x1) - greatest(p.x0, q.x0))::BIGINT * (least(p.y1, q.y1) - greatest(p.y0, q.y0)) / least(p.area, q.area) >= 0.8),
n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY r) AS k FROM (SELECT page, i AS r, list(j) AS near FROM c GROUP BY page, i)),
s(page, k, kept) AS (
  SELECT page, k, [r] FROM n WHERE k = 1
  UNION ALL
  SELECT n.page, n.k, CASE WHEN list_has_any(kept, near) THEN kept ELSE list_append(kept, n.r) END FROM s JOIN n ON n.page = s.page AND n.k = s.k + 1),
w AS (SELECT page, unnest(arg_max(kept, k)) AS r FROM s GROUP BY page)
SELECT b.page, b.id FROM b LEFT JOIN n ON n.page = b.page AND n.r = b.r LEFT JOIN w ON w.page = b.page AND w.r = b.r WHERE n.r IS NULL OR w.r IS NOT NULL
"""
