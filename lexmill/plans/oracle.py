"""The core queries in DuckDB's SQL, over the same tables."""

from __future__ import annotations

import sys
import unicodedata

from lexmill.functions.text import KEPT_MARKS
from lexmill.functions.text import TRAILING_SECTIONS as TRAILING
from lexmill.operators.tokens import byte_letters
from lexmill.plans.queries import WIKI_INSIDE, WIKI_LEAD, WIKI_TAIL

#: All blanks of Unicode text as a class of DuckDB's regular expressions.
WS = r"[\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPLIT = "CASE WHEN lower(split) = 'validation' THEN 'valid' ELSE lower(split) END"


def key(c: str) -> str:
    """Case-folded text without blanks; of the letters whose folding isn't their lower case, those that occur in the tables."""
    return f"regexp_replace(replace(replace(replace(lower({c}), 'ß', 'ss'), 'ς', 'σ'), 'µ', 'μ'), '{WS}+', '', 'g')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda w: w <> '')"


def chars(c: str) -> str:
    return f"list_transform(range(1, length({c}) + 1), lambda i: unicode(substr({c}, i, 1)))"


NOISE = "^related links|^tags:|^subscribe|cookie|all rights reserved|share this"
SITE = (
    r"^DOE Explains offers straightforward|^It also describes how these concepts apply|Skip to main content|official websites use \.gov|writes and curates content|"
    r"communications specialist in the Vehicle|For more information please visit|Shannon Brescher Shea|^https?://"
)


def sentences_en(c: str) -> str:
    parts = f"list_transform(string_split(regexp_replace({c}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')})"
    return f"list_filter({parts}, lambda s: length(s) >= 25 AND NOT regexp_matches(s, '(?i)(?:{NOISE})') AND NOT regexp_matches(s, '(?i)(?:{SITE})'))"


def sentences_zh(c: str) -> str:
    parts = f"list_transform(string_split(regexp_replace({c}, '([。！？!?；;]){WS}*', '\\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')})"
    return f"list_filter({parts}, lambda s: length(s) >= 20)"


def chunks(s: str) -> str:
    """Chunks so far and the open one are parts of one string."""
    last = "length(string_split(a, chr(2))[-1])"
    fits = f"{last} + 1 + length(s) <= 380 AND ({last} >= 140 OR {last} + 1 + length(s) <= 290)"
    return f"string_split(list_reduce({s}, lambda a, s: CASE WHEN {fits} THEN a || ' ' || s ELSE a || chr(2) || s END), chr(2))"


def firsts(table: str, row: str, k: str, columns: str) -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {row}) AS rn FROM {table}) WHERE rn = 1"


def risk(c: str) -> str:
    n = lambda x: f"(length({c}) - length(replace({c}, '{x}', '')))"
    return f"""list_filter([
      CASE WHEN regexp_matches({c}, '\\\\[a-zA-Z]+|\\{{[^{{}}]*\\}}|[=+−]\\s*$') THEN 'possible_formula_extraction_damage' END,
      CASE WHEN regexp_matches({c}, '\\|.*\\||</?[a-z]+>|\\[\\[') THEN 'possible_table_or_markup_fragment' END,
      CASE WHEN {n('(')} <> {n(')')} THEN 'unbalanced_ascii_parentheses' END,
      CASE WHEN regexp_matches({c}, '(?i)skip to main content|related links|resources and related terms|all rights reserved') THEN 'possible_web_navigation_mixed_with_body' END
    ], lambda x: x IS NOT NULL)"""


def grams(table: str, row: str, language: str, more: str = "") -> str:
    """(r, l, sig): the sorted digests of the distinct 5-grams of each text."""
    k = "SELECT {row} AS r, {language} AS l, {key} AS k{more} FROM {table} WHERE text IS NOT NULL".format(row=row, language=language, key=key("text"), more=more, table=table)
    sig = "list_sort(list_distinct(list_transform(range(1, greatest(length(k) - 4, 1) + 1), lambda i: substr(md5(substr(k, i::INTEGER, 5)), 1, 16))))"
    return f"g0 AS ({k}), g AS (SELECT * EXCLUDE (k), {sig} AS sig FROM g0)"


#: Pairs of distinct sets of one language: two of the twelve smallest digests are shared, and the sets are similar.
NEAR = """
h AS (SELECT min(r) AS r, l, sig FROM g GROUP BY l, sig), e AS (SELECT r, l, len(sig) AS n, unnest(sig[1:12]) AS x FROM h),
c AS (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.x = b.x AND a.l IS NOT DISTINCT FROM b.l AND a.r < b.r AND least(a.n, b.n) >= greatest(a.n, b.n) * 0.85 GROUP BY 1, 2 HAVING count(*) >= 2),
j AS (SELECT c.a, c.b, len(list_intersect(x.sig, y.sig)) AS i, len(x.sig) + len(y.sig) AS n FROM c JOIN h x ON x.r = c.a JOIN h y ON y.r = c.b),
near AS (SELECT a, b, i / (n - i) AS jaccard FROM j WHERE i / (n - i) >= 0.85)
"""


#: Pre-tokens with the quote doubled for SQL; a run of blanks is cut before its last one beforehand, since RE2 looks at nothing ahead.
PRETOKENS = r"''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^" + WS[1:-1] + r"\x01\p{L}\p{N}]+|" + WS + "+"


LETTERS = ", ".join("'" + c.replace("'", "''") + "'" for c in byte_letters())
#: After d (word): n (word, k), the tokens of each distinct word under bpe_merges. A word is its bytes' letters between
#: marks; the pair of lowest rank is merged in each step, until there is none.
MERGED = f"""
r AS (SELECT first_piece AS a, second_piece AS b, min(rank_no) AS r FROM bpe_merges GROUP BY 1, 2), hx AS (SELECT word, hex(encode(word)) AS h FROM d),
s AS (SELECT word, chr(1) || array_to_string(list_transform(range(1, length(h)::BIGINT, 2), lambda i: [{LETTERS}][('0x' || substr(h, i::INTEGER, 2))::INTEGER + 1]), chr(1)) || chr(1) AS t FROM hx
  UNION ALL SELECT word, replace(t, x.p, chr(1) || x.a || x.b || chr(1)) FROM (
    SELECT word, t, arg_min({{'p': chr(1) || a || chr(1) || b || chr(1), 'a': a, 'b': b}}, r) AS x FROM (SELECT word, t, string_split(t, chr(1)) AS y FROM s) q, unnest(range(2, len(y) - 1)) u(i) JOIN r ON r.a = y[i] AND r.b = y[i + 1] GROUP BY word, t)),
n AS (SELECT word, min(len(string_split(t, chr(1))) - 2) AS k FROM s GROUP BY word)
"""


def pretokens(c: str) -> str:
    """The pre-tokens of a text, which has a mark before the last of several blanks."""
    return f"regexp_extract_all(regexp_replace({c}, '({WS}+)({WS}[^{WS[1:-1]}])', '\\1' || chr(1) || '\\2', 'g'), '{PRETOKENS}')"


def compatible() -> str:
    """m (o, v): what the tokenizer's normal form makes of each character but the marks it keeps, before composition."""
    kept = {ord(c) for c in KEPT_MARKS}
    each = ((o, unicodedata.normalize("NFKD", chr(o))) for o in range(0x80, sys.maxunicode + 1) if not 0xAC00 <= o <= 0xD7A3 and not 0xD800 <= o <= 0xDFFF and o not in kept)
    values = ", ".join(f"({o}, '{v.replace(chr(39), chr(39) * 2)}')" for o, v in each if v != unicodedata.normalize("NFD", chr(o)))
    return f"m(o, v) AS (VALUES {values})"


def picked(parts: tuple[str, ...]) -> str:
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    return f"[{', '.join(map(lit, parts))}][row_id % {len(parts)} + 1]"


def cleaned(c: str) -> str:
    """The cleaning of an encyclopedia extract, step by step. Numbers in brackets are gone after the first of the citation
    steps, so the two that look at the blanks before them find nothing more."""
    b, w = WS[1:-1], r"\p{L}\p{M}\p{N}_"
    greek, marks = "Δ|λ|μ|ρ|θ|φ|Ω", "−|→|←|⇒|⇐|∂|√|△|∑|∫"
    steps = [
        (r"(?s)\n=+ +(?:" + "|".join(TRAILING) + r") *=*\n.*$", ""), (rf"^{WS}*本條目[^\n]*。{WS}*", ""), (rf"^{WS}*本条[^\n]*。{WS}*", ""), (r"(?i)\[\[(?:File|Image|文件|Category):[^\]]*\]\]", " "),
        (rf"(?s){WS}*\{{\\displaystyle.*?\}}{WS}*", " "), (r"\[\[([^\]|]+\|)?([^\]]+)\]\]", r"\2"), (rf"[\[（(]\p{{Nd}}+[{b}.,，、-]*(?:\p{{Nd}}+[,，]?)*[）\])]", " "),
        (r"[（(][^（）()]{0,30}?原[^\n]*?[）)]", " "), (r"[（(][^（）()]{0,40}?存于互联网档案馆[）)]", " "), (r"&[a-zA-Z#0-9]+;", " "),
        (rf"{WS}*\{{[^{{}}\n]*\\[a-zA-Z]+[^{{}}]*\}}{WS}*", " "), (rf"{WS}*\\[a-zA-Z]+(?:\{{|\}}|\\?[^{{}}()\[\]]*)", " "),
        (rf"(^|{WS}+|([^{w}{b}]))(?:{greek})($|{WS}+|([^{w}{b}]))", r"\2 \4"), (rf"([{w}])(?:{marks})([{w}])", r"\1 \2"), (rf"([{w}])(?:{marks})([{w}])", r"\1 \2"),
        (r"\n=+ ?[^=\n]+? *=*\n", r"\n"), (r"[ \t　]+", " "), (rf"\n{WS}*\n+", r"\n"), (rf"{WS}*\n{WS}*", r"\n"), (r"[ \t]+", " "),
    ]
    for pattern, to in steps:
        to = "chr(10)" if to == r"\n" else f"'{to}'"
        c = f"regexp_replace({c}, '{pattern}', {to}, 'g')"
    return strip(c)


AFTER_ZH = "([，。！？；：、）》】」』”’])[ \\t]+"
SIGNAL = r"(?i)\b(?:copyright|license|credit|courtesy|permission)\b|版权|许可|授權|授权|署名"
HOST = r"nullif(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '')"

POLICIES = f"pol AS (SELECT {HOST.format('url')} AS h, min(url || 'policy') AS policy, min(source) AS agency FROM source_catalog GROUP BY 1)"
INVENTORY = f"""
WITH {POLICIES}, d AS (SELECT *, CASE WHEN source_url IS NOT NULL THEN 'url' WHEN source_title IS NOT NULL THEN 'title' END AS source_kind,
                  coalesce(source_url, source_title) AS source_key, regexp_matches(text, '{SIGNAL}') AS sig FROM article_en),
inv0 AS (SELECT source_kind, source_key, count(*) AS record_count, list(row_id ORDER BY row_id) AS ids,
               coalesce(list(row_id ORDER BY row_id) FILTER (WHERE sig), []) AS sigs, first(source_title ORDER BY row_id) AS source_title,
               CASE WHEN source_kind = 'url' THEN {HOST.format('source_key')} ELSE 'wiki.example' END AS host
        FROM d WHERE source_kind IS NOT NULL GROUP BY source_kind, source_key),
inv AS (SELECT inv0.*, policy, agency, CASE WHEN source_kind = 'url' THEN source_key ELSE 'https://wiki.example/wiki/' || replace(url_encode(source_key), '%2F', '/') END AS candidate_url,
          CASE WHEN source_kind = 'title' THEN 'current_page_found_original_revision_and_attribution_unconfirmed' WHEN policy IS NOT NULL THEN 'site_policy_found_page_specific_terms_unconfirmed' ELSE 'title_unresolved_requires_source_match' END AS rights_status
        FROM inv0 LEFT JOIN pol ON host = h)
"""

RULED = """
WITH e AS (SELECT row_id, text AS t0, (length(text) - length(replace(text, 'Back to top', ''))) / 11 AS n FROM article_en),
a AS (SELECT *, n > 0 AS has_a, n = 1 AND regexp_matches(replace(t0, 'Back to top', ''), '[^\\s\\x{a0}]') AS ok_a FROM e),
b AS (SELECT *, CASE WHEN ok_a THEN replace(t0, 'Back to top', '') ELSE t0 END AS t1, contains(t0, 'In simple terms') AS has_b, contains(t0, 'Toggle navigation') AS dropped FROM a),
c AS (SELECT *, CASE WHEN has_b THEN replace(t1, 'In simple terms', 'Put simply') ELSE t1 END AS t2 FROM b)
"""

SQL: dict[str, str] = {
    "exact_dedup_keep_first": firsts("documents", "doc_id", key("text"), "doc_id, lang, n_chars"),
    "dedup_decision_log": f"""
SELECT doc_id, kept_doc_id, 'EXACT_DUPLICATE_V1' AS rule_id, sha256(text) AS original_text_sha256
FROM (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY {key('text')}) AS kept_doc_id FROM documents) WHERE doc_id <> kept_doc_id""",
    "dedup_stats_by_lang": f"""
SELECT lang, count(*) AS n_docs, sum(coalesce(length(text), 0))::BIGINT AS n_chars, sum(coalesce(len({words('text')}), 0))::BIGINT AS n_tokens, avg(coalesce(len({words('text')}), 0)) AS mean_tokens
FROM ({firsts('documents', 'doc_id', key('text'), '*')}) GROUP BY lang""",
    "nfc_duplicates": f"""
SELECT row_id, kept_row_id FROM (SELECT row_id, min(row_id) OVER (PARTITION BY trim(regexp_replace(nfc_normalize(text), '{WS}+', ' ', 'g'), ' ')) AS kept_row_id FROM natural_zh)
WHERE row_id <> kept_row_id""",
    "prefix_duplicates": """
SELECT row_id, group_first, group_size FROM (
  SELECT row_id, min(row_id) OVER w AS group_first, count(*) OVER w AS group_size FROM english WHERE text IS NOT NULL WINDOW w AS (PARTITION BY substr(text, 1, 15))) WHERE group_size > 1""",
    "provenance_match": """
WITH old AS (SELECT text, first(source_title) AS st FROM documents WHERE source_title IS NOT NULL GROUP BY text HAVING count(*) = 1)
SELECT d.doc_id, o.st AS source_title, o.text IS NOT NULL AS matched FROM documents d LEFT JOIN old o ON d.text = o.text WHERE d.source_title IS NULL""",
    "title_group_fill": """
WITH one AS (SELECT source_title AS t, min(group_id) AS g FROM article_zh WHERE source_title IS NOT NULL AND group_id IS NOT NULL GROUP BY 1 HAVING min(group_id) = max(group_id))
SELECT row_id, source_title, g AS group_id FROM article_zh LEFT JOIN one ON source_title = t WHERE group_id IS NULL""",
    "corpus_stats_by_lang": f"""
SELECT lang, source, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars, sum(len({words('text')}))::BIGINT AS n_tokens, avg(len({words('text')})) AS mean_tokens
FROM documents WHERE len({words('text')}) > 0 GROUP BY lang, source""",
    "corpus_totals": f"""
WITH d AS (SELECT length(text) AS c, {words('text')} AS t FROM documents WHERE len({words('text')}) > 0),
w AS (SELECT count(DISTINCT x) AS k FROM (SELECT unnest(t) AS x FROM d))
SELECT count(*) AS n_docs, sum(c)::BIGINT AS n_chars, sum(len(t))::BIGINT AS n_tokens, any_value(k) AS n_distinct, sum(c) / count(*) AS mean_chars, sum(len(t)) / count(*) AS mean_tokens FROM d, w""",
    "split_counts": f"""
SELECT source, count(*) FILTER (WHERE s = 'train') AS train, count(*) FILTER (WHERE s = 'valid') AS valid, count(*) FILTER (WHERE s = 'test') AS test, count(*) AS n_rows
FROM (SELECT source, {SPLIT} AS s FROM article_en) GROUP BY source""",
    "metadata_coverage": """
SELECT domain, count(*) AS n_rows, count(source) AS has_source, count(source_url) AS has_source_url, count(source_title) AS has_source_title, count(group_id) AS has_group_id FROM article_en GROUP BY domain""",
    "risk_flags": f"SELECT row_id, array_to_string(f, ',') AS flags FROM (SELECT row_id, {risk('text')} AS f FROM article_en) WHERE len(f) > 0",
    "flag_counts": f"SELECT flag, count(*) AS n_rows FROM (SELECT unnest({risk('text')}) AS flag FROM article_en) GROUP BY flag",
    "manifest_delta": f"""
WITH a AS (SELECT source, count(*) AS r, sum(coalesce(len({words('text')}), 0)) AS t FROM documents GROUP BY source),
b AS (SELECT source, count(*) AS r, sum(coalesce(len({words('text')}), 0)) AS t FROM ({firsts('documents', 'doc_id', key('text'), '*')}) GROUP BY source)
SELECT a.source AS file, coalesce(b.r, 0) - a.r AS d_records, (coalesce(b.t, 0) - a.t)::BIGINT AS d_tokens FROM a LEFT JOIN b ON a.source IS NOT DISTINCT FROM b.source""",
    "token_weighted_ppl": """
WITH d AS (SELECT lang, length(text) - 1 AS v, doc_id % 7 / 4 + 1 AS loss FROM documents WHERE length(text) >= 2),
g AS (SELECT lang, sum(v)::BIGINT AS n, sum(loss * v) / sum(v) AS m FROM d WHERE lang IS NOT NULL GROUP BY lang)
SELECT l.lang, coalesce(n, 0) AS n_tokens, round(coalesce(m, 0), 9) AS mean_loss, round(CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE exp(m) END, 6) AS perplexity FROM (SELECT DISTINCT lang FROM documents) l LEFT JOIN g ON l.lang = g.lang""",
    "overall_ppl": """
WITH d AS (SELECT length(text) - 1 AS v, doc_id % 7 / 4 + 1 AS loss FROM documents WHERE length(text) >= 2 AND source IS NOT NULL)
SELECT sum(v)::BIGINT AS n_tokens, round(sum(loss * v) / sum(v), 9) AS mean_loss, round(exp(sum(loss * v) / sum(v)), 6) AS perplexity FROM d""",
    "early_stop_fold": """
WITH RECURSIVE l AS (SELECT source AS run, (year(ingested_at) * 12 + month(ingested_at))::BIGINT AS epoch, round(1000 / (avg(n_chars) + 1), 6) AS x FROM documents WHERE source IS NOT NULL AND ingested_at IS NOT NULL GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS k FROM l),
f AS (SELECT run, epoch, k, x AS eval_loss, x AS best, true AS improved, 0 AS waited, false AS stopped FROM o WHERE k = 1
  UNION ALL SELECT o.run, o.epoch, o.k, o.x, CASE WHEN f.best - o.x > 0.01 THEN o.x ELSE f.best END, f.best - o.x > 0.01, CASE WHEN f.best - o.x > 0.01 THEN 0 ELSE f.waited + 1 END, f.best - o.x <= 0.01 AND f.waited + 1 >= 3
  FROM f JOIN o ON o.run = f.run AND o.k = f.k + 1 WHERE NOT f.stopped)
SELECT run, epoch, eval_loss, best, improved, waited, stopped FROM f""",
    "fingerprint_combined": """
WITH f AS (SELECT 'title' AS name, sha256(string_agg(title || chr(10), '' ORDER BY title, id)) AS h FROM source_catalog UNION ALL SELECT 'url', sha256(string_agg(url || chr(10), '' ORDER BY url, id)) FROM source_catalog)
SELECT sha256(string_agg(name || ' ' || h || chr(10), '' ORDER BY name)) AS combined_sha256 FROM f""",
    "sentence_split_en": f"""
SELECT row_id, count(*) AS n_sentences, sum(length(s))::BIGINT AS n_chars, max(length(s))::INTEGER AS longest FROM (SELECT row_id, unnest({sentences_en('text')}) AS s FROM article_en) GROUP BY row_id""",
    "chunk_en": f"""
SELECT row_id, unnest(range(1, len(c) + 1))::INTEGER AS chunk_index, unnest(c) AS chunk FROM (SELECT row_id, {chunks('s')} AS c FROM (SELECT row_id, {sentences_en('text')} AS s FROM english) WHERE len(s) > 0)""",
    "zh_sentence_chunk": f"""
SELECT row_id, unnest(range(1, len(c) + 1))::INTEGER AS chunk_index, unnest(c) AS chunk FROM (SELECT row_id, {chunks('s')} AS c FROM (SELECT row_id, {sentences_zh('text')} AS s FROM article_zh) WHERE len(s) > 0)""",
    "zh_sentences": f"SELECT row_id, unnest(range(1, len(s) + 1))::INTEGER AS place, unnest(s) AS sentence FROM (SELECT row_id, {sentences_zh('text')} AS s FROM article_zh)",
    "zh_punct_space": f"SELECT row_id, len(regexp_extract_all(text, '{AFTER_ZH}'))::INTEGER AS n_removed, regexp_replace(text, '{AFTER_ZH}', '\\1', 'g') AS text FROM natural_zh WHERE regexp_matches(text, '{AFTER_ZH}')",
    "punct_changes_by_domain": f"""
SELECT domain, count(*) FILTER (WHERE n > 0) AS n_changed, sum(n)::BIGINT AS n_changes FROM (SELECT domain, coalesce(len(regexp_extract_all(text, '{AFTER_ZH}')), 0) AS n FROM natural_zh) GROUP BY domain""",
    "en_punct_space": "SELECT row_id, f AS fixed FROM (SELECT row_id, text, regexp_replace(text, '([A-Za-z]) +([,.;:!?])', '\\1\\2', 'g') AS f FROM article_en) WHERE text <> f",
    "url_group_ids": f"SELECT row_id, 'article-url-' || substr(sha256(source_url), 1, 16) AS url_group, {HOST.format('source_url')} AS host FROM article_en WHERE source_url IS NOT NULL",
    "title_group_ids": """
SELECT row_id, 'zhwiki-' || substr(sha256(source || chr(0) || source_title), 1, 16) AS title_group, replace(source_title, ' ', '_') AS page_name FROM article_zh WHERE source IS NOT NULL AND source_title IS NOT NULL""",
    "html_extract": f"""
SELECT row_id, coalesce({strip('source_title')}, '') AS title, {strip("regexp_replace(coalesce(topic, '') || ' ' || text, '" + WS + "+', ' ', 'g')")} AS text FROM article_en WHERE text IS NOT NULL""",
    "cyclic_replace": """
SELECT row_id, k AS place, replace(text, 'Under steady load', ['In calm weather', 'At constant load', 'With steady input'][k % 3 + 1]) AS text
FROM (SELECT row_id, text, row_number() OVER (ORDER BY row_id) - 1 AS k FROM english WHERE contains(text, 'Under steady load'))""",
    "fragment_removal_log": RULED + """
SELECT row_id::VARCHAR AS id, array_to_string(list_filter([CASE WHEN ok_a THEN 'BACK_TO_TOP' END, CASE WHEN has_b THEN 'SIMPLE_TERMS' END, CASE WHEN dropped THEN 'NAVIGATION' END], lambda x: x IS NOT NULL), ',') AS rules,
  CASE WHEN dropped THEN 'drop' WHEN has_a AND NOT ok_a THEN 'failed' ELSE 'edit' END AS decision, sha256(t0) AS before_sha256, CASE WHEN NOT dropped THEN sha256(t2) END AS after_sha256
FROM c WHERE has_a OR has_b OR dropped""",
    "records_after_rules": RULED + "SELECT row_id::VARCHAR AS id, sha256(t2) AS text_sha256 FROM c WHERE dropped IS NULL OR NOT dropped",
    "ordered_pair_replace": """
SELECT row_id, replace(t, 'trend stays for', 'trend is the same for') AS text FROM (SELECT row_id, replace(text, 'the trend holds', 'the trend stays') AS t FROM english WHERE contains(text, 'the trend holds'))
WHERE contains(t, 'trend stays for')""",
    "quarantine_restore": f"""
SELECT id, array_to_string(f, ',') AS flags FROM (SELECT row_id::VARCHAR AS id, chunk_index, {risk('text')} AS f FROM article_en) WHERE len(f) > 0 AND NOT coalesce(chunk_index <= 1, false)""",
    "topic_translate": """
WITH m AS (SELECT topic_zh AS t, min(topic) AS en FROM article_zh WHERE topic_zh IS NOT NULL AND regexp_matches(topic, '^[a-z][a-z0-9_]*$') GROUP BY 1)
SELECT row_id, coalesce(en, topic) AS topic, CASE WHEN en IS NOT NULL THEN topic ELSE topic_zh END AS topic_zh FROM article_zh LEFT JOIN m ON topic = t WHERE regexp_matches(topic, '[㐀-鿿]')""",
    "topic_map_gaps": """
WITH a AS (SELECT DISTINCT topic_zh AS key FROM article_zh WHERE topic_zh IS NOT NULL), n AS (SELECT DISTINCT topic_zh AS key FROM natural_zh WHERE topic_zh IS NOT NULL)
SELECT key, 'not in map' AS side FROM n WHERE key NOT IN (SELECT key FROM a) UNION ALL SELECT key, 'not used' FROM a WHERE key NOT IN (SELECT key FROM n)""",
    "origin_annotation": """
WITH d AS (SELECT row_id, coalesce(legacy_id, '') AS l FROM natural_zh)
SELECT row_id, CASE WHEN l = '' THEN 'AI-generated' END AS origin_class, sha256('{"legacy_id":"' || l || '","row_id":' || row_id || '}') AS before_sha256,
  sha256('{"legacy_id":"' || l || CASE WHEN l = '' THEN '","origin_class":"AI-generated' ELSE '' END || '","row_id":' || row_id || '}') AS after_sha256 FROM d""",
    "merged_origin": "SELECT 'train' AS split, split AS round15_split, count(*) AS n_rows FROM english GROUP BY split",
    "unique_id_violations": "SELECT id, count(*) AS n FROM english WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1",
    "unique_text_violations": f"SELECT sha256({key('text')}) AS key_sha256, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY {key('text')} HAVING count(*) > 1",
    "groups_in_several_splits": f"""
SELECT group_id, string_agg(s, ',' ORDER BY s) AS splits FROM (SELECT DISTINCT group_id, {SPLIT} AS s FROM article_en WHERE group_id IS NOT NULL AND split IS NOT NULL) GROUP BY group_id HAVING count(*) > 1""",
    "texts_in_several_splits": f"""
WITH d AS (SELECT {key('text')} AS k, {SPLIT} AS s FROM english WHERE split IS NOT NULL AND text IS NOT NULL)
SELECT sha256(k) AS key_sha256, string_agg(DISTINCT s, ',' ORDER BY s) AS splits, count(*) AS n FROM d GROUP BY k HAVING count(DISTINCT s) > 1""",
    "wrong_split_labels": f"SELECT row_id, split, {SPLIT} AS directory FROM english WHERE split IS NULL OR (split <> {SPLIT} AND split <> 'validation')",
    "overlap_train_eval": f"""
WITH a AS (SELECT *, {SPLIT} AS s FROM article_en),
m AS (SELECT s, unnest([{{'kind': 'id', 'marker': nullif(id, '')}}, {{'kind': 'group_id', 'marker': nullif(group_id, '')}}, {{'kind': 'source_url', 'marker': nullif(source_url, '')}},
      {{'kind': 'source_title', 'marker': nullif(source, '') || ':' || nullif(source_title, '')}}, {{'kind': 'text', 'marker': nullif({key('text')}, '')}}]) AS x FROM a),
t AS (SELECT x.kind AS kind, x.marker AS marker, count(*) AS n FROM m WHERE s = 'train' AND x.marker IS NOT NULL GROUP BY 1, 2),
v AS (SELECT x.kind AS kind, x.marker AS marker, count(*) AS n FROM m WHERE s IN ('valid', 'test') AND x.marker IS NOT NULL GROUP BY 1, 2)
SELECT t.kind, count(*) AS n_markers, sum(t.n)::BIGINT AS n_train, sum(v.n)::BIGINT AS n_valid FROM t JOIN v ON t.kind = v.kind AND t.marker = v.marker GROUP BY t.kind""",
    "merge_overlap": f"""
WITH a AS (SELECT *, {SPLIT} AS s FROM english),
m AS (SELECT s, unnest([{{'kind': 'id', 'marker': id}}, {{'kind': 'text', 'marker': sha256({key('text')})}}]) AS x FROM a)
SELECT x.kind AS kind, x.marker AS marker, count(*) AS n_train FROM m
WHERE s = 'train' AND x.marker IS NOT NULL AND (x.kind, x.marker) IN (SELECT (x.kind, x.marker) FROM m WHERE s IN ('valid', 'test') AND x.marker IS NOT NULL) GROUP BY 1, 2""",
    "count_gate": "SELECT source AS name, count(*) AS n_rows, count(DISTINCT text) AS n_expected FROM documents WHERE source IS NOT NULL GROUP BY source HAVING count(*) <> count(DISTINCT text)",
    "review_sheets": """
SELECT item_id::VARCHAR AS id, concat_ws(chr(10), '## ' || item_id::VARCHAR, '- language: ' || coalesce(language, ''), '- topic: ' || coalesce(topic, ''), '- domain: ' || coalesce(domain, ''), '', coalesce(text, ''), '', '[ ] pass  [ ] modify  [ ] delete') AS block FROM eval_items""",
    "review_results": "SELECT CASE WHEN domain = 'physics' THEN 'modify' ELSE 'pass' END AS choice, count(*) AS n FROM eval_items GROUP BY 1",
    "first_prompts": "SELECT language, item_id, question, place FROM (SELECT language, item_id, question, row_number() OVER (PARTITION BY language ORDER BY item_id)::INTEGER AS place FROM eval_items) WHERE place <= 3",
    "pack_blocks": f"""
WITH t AS (SELECT row_id, unnest(range(0, length(text) + 1)) AS i, unnest(list_append({chars('text')}, 0)) AS tok FROM english WHERE text IS NOT NULL),
p AS (SELECT tok, row_number() OVER (ORDER BY row_id, i) - 1 AS pos FROM t)
SELECT pos // 128 AS block, string_agg(tok::VARCHAR, ',' ORDER BY pos) AS tokens FROM p GROUP BY 1 HAVING count(*) = 128""",
    "eval_blocks": f"""
WITH d AS (SELECT item_id, {chars('text')} AS t FROM eval_items WHERE length(text) >= 2), b AS (SELECT item_id, t, unnest(range(0, (len(t) - 1) // 128 + 1)) AS block_no FROM d)
SELECT item_id, block_no::INTEGER AS block_no, len(t[block_no * 128 + 1:block_no * 128 + 128])::INTEGER AS n_tokens, t[block_no * 128 + 1]::INTEGER AS first_token FROM b WHERE len(t[block_no * 128 + 1:block_no * 128 + 128]) >= 2""",
    "prompt_budget": """
SELECT item_id, least(length(question), 63)::INTEGER AS prompt_size, CASE WHEN least(20, 64 - least(length(question), 63)) > 0 THEN least(20, 64 - least(length(question), 63)) END::INTEGER AS new_tokens FROM eval_items""",
    "qa_build": f"""
WITH d AS (SELECT item_id, CASE WHEN item_id % 9 = 0 THEN '' WHEN item_id % 4 = 0 THEN 'zh' ELSE coalesce(language, 'zh') END AS l, {strip('question')} AS q, {strip('answer')} AS a, CASE WHEN item_id % 11 = 0 THEN ' ' || question END AS given,
  CASE WHEN item_id % 4 = 1 THEN 'general' ELSE coalesce(domain, 'general') END AS domain, CASE WHEN item_id % 4 = 2 THEN 'general' ELSE coalesce(topic, 'general') END AS topic, CASE WHEN item_id % 4 = 3 THEN 'train' ELSE coalesce(split, 'train') END AS split FROM eval_items),
m AS (SELECT *, CASE WHEN l = 'zh' THEN '问：' || q || chr(10) || '答：' || a ELSE 'Q: ' || q || chr(10) || 'A: ' || a END AS made FROM d),
old AS (SELECT DISTINCT made FROM m WHERE item_id <= 10 AND given IS NULL), t AS (SELECT *, coalesce(given, made) AS text FROM m WHERE q <> '' AND a <> '' AND coalesce(given, made) NOT IN (SELECT made FROM old WHERE made IS NOT NULL)),
f AS (SELECT min(item_id) AS item_id FROM t GROUP BY text)
SELECT item_id, 'qa-' || lower(substr(l, 1, 2)) || '-' || lpad(((SELECT count(*) FROM old) + 2 * (row_number() OVER (ORDER BY item_id) - 1) + 1)::VARCHAR, 4, '0') AS id, split, lower(substr(l, 1, 2)) AS language, domain, topic, q AS question, a AS answer, text FROM t JOIN f USING (item_id)""",
    "id_continuation": """
SELECT item_id, 'natural-en-' || lpad((row_number() OVER (ORDER BY item_id) + (SELECT max(regexp_extract(id, '^natural-en-(\\d+)$', 1)::BIGINT) FROM english WHERE regexp_matches(id, '^natural-en-\\d+$')))::VARCHAR, 6, '0') AS id FROM eval_items""",
    "article_assembly": """
WITH c AS (SELECT topic, list(text ORDER BY text) FILTER (WHERE text IS NOT NULL) AS x FROM eval_items GROUP BY topic),
j AS (SELECT s.*, x, unnest(range(1, len(x) + 1)) AS k FROM source_catalog s JOIN c ON s.topic = c.topic)
SELECT id || '-' || lpad(k::VARCHAR, 2, '0') AS id, source, url AS source_url, title AS source_title, k::INTEGER AS chunk_index, sha256(x[k]) AS text_sha256 FROM j""",
    "source_inventory": INVENTORY + "SELECT source_kind, source_key, record_count, array_to_string(ids, ',') AS record_ids, array_to_string(sigs, ',') AS signal_ids, source_title, host, policy, candidate_url, rights_status FROM inv",
    "attribution_by_host": INVENTORY + f"""
, act AS (SELECT row_id AS r FROM article_en WHERE {SPLIT} = 'train'),
k AS (SELECT source_kind, source_key, host, len(sigs) AS s, count(r) AS n FROM (SELECT *, unnest(ids) AS i FROM inv) LEFT JOIN act ON i = r GROUP BY source_kind, source_key, host, sigs)
SELECT host, count(*) AS n_pages, sum(n)::BIGINT AS n_records, sum(s)::BIGINT AS n_signals FROM k WHERE n > 0 GROUP BY host""",
    "attribution_report": INVENTORY + """
, g AS (SELECT host, coalesce(any_value(agency), host) AS name, count(*) AS p, sum(record_count) AS r, any_value(policy) AS policy, bool_or(source_kind = 'title') AS titled FROM inv WHERE host IS NOT NULL GROUP BY host)
SELECT host, 0 AS part, '## ' || name || ': ' || p || ' pages, ' || r || ' records' AS line FROM g UNION ALL SELECT host, 1, '' FROM g UNION ALL SELECT host, 2, 'Site policy: [see](' || policy || ').' FROM g WHERE policy IS NOT NULL UNION ALL SELECT host, 3, '' FROM g
UNION ALL SELECT host, 4, CASE WHEN titled THEN '| Page | Authors | Records |' ELSE '| Page | Records |' END FROM g UNION ALL SELECT host, 5, CASE WHEN titled THEN '|---|---|---:|' ELSE '|---|---:|' END FROM g UNION ALL SELECT host, 7, '' FROM g
UNION ALL SELECT host, 6, '| [' || coalesce(source_title, source_key) || '](' || candidate_url || ') |' || CASE WHEN source_kind = 'title' THEN ' [history](' || candidate_url || '?action=history) |' ELSE '' END || ' ' || record_count || ' |' FROM inv WHERE host IS NOT NULL
UNION ALL SELECT '', * FROM (VALUES (0, '# Attribution'), (1, ''), (2, 'A draft.')) UNION ALL SELECT chr(65535), * FROM (VALUES (0, '## Before publication'), (1, ''), (2, '1. Check the pages.'))""",
    "audit_summary": INVENTORY + "SELECT count(*) AS n_pages, sum(record_count)::BIGINT AS n_records, count(*) FILTER (WHERE len(sigs) > 0) AS n_with_signal, 0::BIGINT AS n_found FROM inv",
    "title_resolution": """
WITH n AS (SELECT topic AS t, dense_rank() OVER (ORDER BY topic) AS k FROM (SELECT DISTINCT topic FROM eval_items WHERE topic IS NOT NULL))
SELECT t AS title_seed, CASE WHEN k % 3 = 0 THEN t || '_page' WHEN k % 5 <> 0 THEN t ELSE t || '_hit' END AS title FROM n""",
    "revision_lookup": """
WITH t AS (SELECT DISTINCT source_title AS title FROM article_en WHERE source_title IS NOT NULL), n AS (SELECT title, replace(title, ' ', '_') AS n FROM t),
c AS (SELECT title, CASE WHEN length(n) % 3 = 0 THEN n || '~' ELSE n END AS c FROM n), r AS (SELECT title, CASE WHEN length(c) % 2 = 0 THEN c || '*' ELSE c END AS r FROM c)
SELECT title, r AS resolved_title, length(r)::INTEGER AS page_id, (length(r) + 1000)::INTEGER AS revision_id, title <> r AS changed, length(r) % 5 <> 0 AS page_found FROM r""",
    "file_hashes": "SELECT 'title' AS name, sha256(string_agg(title || chr(10), '' ORDER BY title, id)) AS sha256 FROM source_catalog WHERE title IS NOT NULL UNION ALL SELECT 'url', sha256(string_agg(url || chr(10), '' ORDER BY url, id)) FROM source_catalog WHERE url IS NOT NULL",
    "file_manifest": f"""
WITH f AS (SELECT 'title' AS file, title AS x, id FROM source_catalog UNION ALL SELECT 'url', url, id FROM source_catalog),
m AS (SELECT file, count(*) AS n_records, sum(len({words('x')}))::BIGINT AS n_tokens, sha256(string_agg(x || chr(10), '' ORDER BY x, id)) AS sha256 FROM f WHERE x IS NOT NULL GROUP BY file)
SELECT * FROM m UNION ALL SELECT 'all', sum(n_records)::BIGINT, sum(n_tokens)::BIGINT, NULL FROM m""",
    "title_counts": "SELECT source_title, count(*) AS n_rows FROM article_zh GROUP BY source_title",
    "strict_loss": """
WITH d AS (SELECT doc_id % 7 AS part, length(text) - 1 AS v, CASE WHEN doc_id % 7 = 0 THEN 101.5 ELSE doc_id % 7 / 4 + 1 END AS loss FROM documents WHERE length(text) >= 2)
SELECT part, sum(v)::BIGINT AS n_tokens, round(sum(loss * v) / sum(v), 9) AS mean_loss, CASE WHEN part = 0 THEN -1.0 ELSE round(exp(sum(loss * v) / sum(v)), 6) END::DOUBLE AS perplexity FROM d GROUP BY part""",
    "near_dup_pairs": f"WITH {grams('natural_zh', 'row_id', 'language')}, {NEAR} SELECT a AS row_a, b AS row_b, round(jaccard, 6) AS jaccard FROM near",
    "near_dup_components": f"""
WITH RECURSIVE {grams('natural_zh', 'row_id', 'language')}, {NEAR},
links AS (SELECT a, b FROM near UNION ALL SELECT h.r, g.r FROM g JOIN h ON g.sig = h.sig AND g.l IS NOT DISTINCT FROM h.l WHERE g.r <> h.r AND len(g.sig) > 1),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT r AS a, r AS b FROM g UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT a AS row_id, min(b) AS component FROM reach GROUP BY a""",
    "separated_near_pairs": f"""
WITH {grams('english', 'row_id', 'language')}, {NEAR}, s AS (SELECT row_id AS r, {SPLIT} AS s FROM english)
SELECT a AS row_a, b AS row_b, x.s AS split_a, y.s AS split_b FROM near JOIN s x ON x.r = a JOIN s y ON y.r = b WHERE x.s <> y.s""",
    "cross_split_near_exhaustive": f"""
WITH d AS (SELECT row_id AS r, {SPLIT} AS s, {key('text')} AS k FROM english WHERE text IS NOT NULL),
g AS (SELECT r, s, list_distinct(list_transform(range(1, greatest(length(k) - 4, 1) + 1), lambda i: substr(k, i::INTEGER, 5))) AS sig FROM d WHERE s IS NOT NULL),
x AS (SELECT r, s, len(sig) AS n, unnest(sig) AS t FROM g),
c AS (SELECT a.r AS a, b.r AS b, a.n + b.n AS n, count(*) AS i FROM x a JOIN x b ON a.t = b.t AND a.s IN ('valid', 'test') AND b.s = 'train' AND least(a.n, b.n) >= greatest(a.n, b.n) * 0.85 GROUP BY ALL)
SELECT a AS held_row, b AS train_row, round(i / (n - i), 6) AS jaccard FROM c WHERE i / (n - i) >= 0.85""",
    "zh_clean": f"""
WITH w AS (SELECT row_id, {picked(WIKI_LEAD)} || substr(text, 1, 20) || {picked(WIKI_INSIDE)} || substr(text, 21) || {picked(WIKI_TAIL)} AS t FROM article_zh), c AS (SELECT row_id, t, {cleaned('t')} AS x FROM w)
SELECT row_id, length(x)::INTEGER AS n_chars, sha256(x) AS sha256, CASE WHEN t IS NULL THEN 'empty extract' WHEN length(x) < 230 THEN 'too short after clean' END AS skipped FROM c""",
    "bpe_pretoken_counts": f"SELECT word, count(*) AS n FROM (SELECT unnest({pretokens('text')}) AS word FROM english) GROUP BY word",
    "bpe_encode": f"""
WITH RECURSIVE e AS (SELECT row_id, {pretokens('text')} AS w FROM english WHERE text IS NOT NULL), d AS (SELECT DISTINCT unnest(w) AS word FROM e), {MERGED},
x AS (SELECT row_id, sum(k) AS k FROM (SELECT row_id, unnest(w) AS word FROM e) JOIN n USING (word) GROUP BY row_id)
SELECT e.row_id, (coalesce(k, 0) + 2)::INTEGER AS n_ids, true AS round_trip FROM e LEFT JOIN x ON e.row_id = x.row_id""",
    "tokenizer_form": f"""
WITH {compatible()}, x AS (SELECT row_id, unnest(range(1, length(text) + 1)) AS i, text FROM natural_zh),
s AS (SELECT row_id, any_value(text) AS text, nfc_normalize(string_agg(coalesce(v, substr(text, i::INTEGER, 1)), '' ORDER BY i)) AS f FROM x LEFT JOIN m ON o = unicode(substr(text, i::INTEGER, 1)) GROUP BY row_id)
SELECT row_id, f AS normal FROM s WHERE f <> text""",
    "zh_space_before_punct": "SELECT row_id, f AS fixed FROM (SELECT row_id, text, regexp_replace(text, '([㐀-䶿一-鿿]) +([，。！？；：、])', '\\1\\2', 'g') AS f FROM (SELECT row_id, regexp_replace(text, '([，。])', ' \\1', 'g') AS text FROM article_zh)) WHERE text <> f",
    "paren_balance": "SELECT row_id, length(replace(text, '(', '')) = length(replace(text, ')', '')) AS balanced, abs(length(replace(text, '(', '')) - length(replace(text, ')', ''))) < 3 AS nearly FROM natural_zh WHERE text IS NOT NULL",
    "title_links": """
SELECT source_title, p AS page, p || '?action=history' AS history FROM (SELECT source_title, 'https://pages.example/wiki/' || replace(url_encode(source_title), '%2F', '/') AS p FROM (SELECT DISTINCT source_title FROM article_zh WHERE source_title IS NOT NULL))""",
    "seed_priority": "SELECT DISTINCT topic AS title_seed, 'A' AS priority FROM eval_items WHERE length(topic) > 12",
    "preview": """
WITH f AS (SELECT min(row_id) AS r FROM article_zh WHERE text IS NOT NULL AND source_title IS NOT NULL GROUP BY source_title ORDER BY r LIMIT 3) SELECT source_title, row_id, substr(text, 1, 200) AS start FROM article_zh JOIN f ON row_id = r""",
    "whole_text_restore": """
WITH f AS (SELECT domain, arg_min(text, item_id) AS t FROM eval_items WHERE text IS NOT NULL AND domain IS NOT NULL GROUP BY domain)
SELECT row_id::VARCHAR AS id, sha256(f.t) AS text_sha256, sha256(text) AS before_sha256 FROM english e JOIN f ON e.domain = f.domain WHERE upper(text) = text""",
    "lenient_blocks": f"""
WITH q AS (SELECT item_id, lower(substr(language, 1, 2)) AS lang, question FROM eval_items WHERE question IS NOT NULL), t AS (SELECT lang, item_id, unnest(range(0, length(question) + 1)) AS i, unnest(list_append({chars('question')}, 0)) AS tok FROM q WHERE lang = 'en'),
p AS (SELECT lang, tok, row_number() OVER (ORDER BY item_id, i) - 1 AS pos FROM t)
SELECT lang, pos // 1000 AS block, sha256(string_agg(tok::VARCHAR, ',' ORDER BY pos)) AS tokens_sha256 FROM p GROUP BY 1, 2 HAVING count(*) = 1000""",
    "jsonl_round_trip": f"SELECT row_id, id, split, language, domain, topic, sha256(text) AS text_sha256, source FROM english WHERE {strip('text')} <> ''",
    "jsonl_lines": "SELECT row_id, row_number() OVER (ORDER BY row_id) AS line_no FROM natural_zh WHERE text IS NOT NULL AND trim(text, ' ') <> ''",
    "txt_lines": f"""
SELECT line_no, {strip('x')} AS text FROM (SELECT row_number() OVER (ORDER BY item_id) AS line_no, CASE WHEN item_id % 5 = 0 THEN '' ELSE regexp_replace(question, '[\\r\\n]', ' ', 'g') END AS x FROM eval_items WHERE question IS NOT NULL) WHERE {strip('x')} <> ''""",
    "corpus_files": f"""
SELECT {SPLIT} AS split, coalesce(topic, 'none') AS category, count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars FROM article_zh WHERE text IS NOT NULL AND trim(text, ' ') <> '' AND split IS NOT NULL GROUP BY 1, 2""",
    "catalog_read": "SELECT id, title, url, source, domain, topic FROM source_catalog",
    "replaced_table": "SELECT item_id, answer FROM eval_items WHERE item_id % 3 <> 0",
    "label_mapping": """
SELECT (row_number() OVER (ORDER BY topic) - 1)::INTEGER AS position, upper(topic) AS value, topic AS label FROM (SELECT DISTINCT topic FROM eval_items WHERE regexp_matches(topic, '^[a-z][a-z0-9_]*$'))""",
}
