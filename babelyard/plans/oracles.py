"""SQL of the queries in babelyard.plans.queries, for an engine that has no part of this library."""

from __future__ import annotations

from babelyard.functions import lookups as L

CATALOGUE = """
    own AS (
        SELECT doc_id, lang AS locale, text AS value,
               source || '-' || CAST(row_number() OVER (PARTITION BY lang, source ORDER BY doc_id NULLS FIRST, sha256(text) NULLS FIRST) AS VARCHAR) AS key
        FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL
    ), messages AS (SELECT locale, key, value FROM own
    ), valid AS (SELECT DISTINCT CASE WHEN doc_id % 5 = 0 THEN key || '.new' ELSE key END AS key FROM own WHERE doc_id IN (SELECT doc_id FROM labels)
    ), locales AS (SELECT DISTINCT locale FROM messages)
"""
CELLS = """
    cells AS (
        SELECT l.locale, k.key, m.key IS NOT NULL AS present, coalesce(m.value, '') <> '' AS filled
        FROM (SELECT DISTINCT key FROM messages WHERE locale = 'en' {semi}) k
        JOIN locales l ON l.locale <> 'en'
        LEFT JOIN messages m ON m.locale = l.locale AND m.key = k.key
    )
"""
VALID_CELLS = CELLS.format(semi="AND key IN (SELECT key FROM valid)")
NEW = "SELECT key FROM valid WHERE key NOT IN (SELECT key FROM messages WHERE locale = 'en')"
ORPHANS = "SELECT key FROM messages WHERE locale = 'en' AND key NOT IN (SELECT key FROM valid)"

PAGES = """
    p0 AS (SELECT page_id, html AS h0 FROM pages WHERE html IS NOT NULL),
    p1 AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(h0, '<body>', '<body><header></header>') ELSE h0 END AS h1 FROM p0),
    p2 AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(h1, '<html', '<html dir="ltr"') ELSE h1 END AS h2 FROM p1),
    p AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(h2, '<head>', '<head><meta name="viewport" content="x">') ELSE h2 END AS html FROM p2)
"""


def _missing(test: str, code: str) -> str:
    return f"SELECT page_id, '{code}' AS code FROM p WHERE NOT regexp_matches(html, '{test}', 'i')"


FINDINGS = "findings AS (" + " UNION ALL ".join(
    [_missing(f"<{t}[\\s>/]", f"MISSING_{t.upper()}") for t in ("header", "nav", "footer")]
    + [_missing("<meta\\b[^>]*\\bcharset\\b", "MISSING_META_CHARSET")]
    + [_missing(f"""<meta\\b[^>]*\\bname\\s*=\\s*["'']?{m}["''\\s/>]""", f"MISSING_META_{m.upper()}") for m in ("viewport", "description", "keywords", "author")]
    + [
        _missing(f"""<html\\b[^>]*\\s{a}\\s*=\\s*(?:"[^"]+"|''[^'']+''|[^\\s"''>]+)""", f"MISSING_{a.upper()}_ATTRIBUTE")
        + " AND regexp_matches(html, '<html[\\s>]', 'i')"
        for a in ("lang", "dir")
    ]
) + ")"
POINTS = "CASE WHEN code IN ('MISSING_HEADER', 'MISSING_NAV', 'MISSING_FOOTER') THEN 20 ELSE 5 END"
SCORED = f"""scored AS (
    SELECT p.page_id, greatest(0, 100 - coalesce(sum({POINTS}), 0)) AS score, count(code) AS n_findings
    FROM p LEFT JOIN findings f ON p.page_id = f.page_id GROUP BY p.page_id
)"""

TOKENS = [p + "4" for p, _ in L.CLASS_PREFIXES] + ["text-left", "text-right", "flex", "rtl:ml-2"]
VARIANT_STEPS = ["", "md:", "hover:", "md:hover:", "print:"]


def _pick(values: list[str], by: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][1 + CAST({by} AS BIGINT) % {len(values)}]"


CLASS_TOKENS = f"t AS (SELECT p_partkey, {_pick(VARIANT_STEPS, 'p_partkey // 22')} || {_pick(TOKENS, 'p_partkey')} AS token FROM part)"
SPLIT = "u AS (SELECT *, regexp_extract(token, '^((?:(?:sm|md|lg|xl|2xl|hover|focus|dark):)*)(.*)$', 1) AS variants, regexp_extract(token, '^((?:(?:sm|md|lg|xl|2xl|hover|focus|dark):)*)(.*)$', 2) AS utility FROM t)"


def _rewrite(v2: bool) -> str:
    cases = " ".join(f"WHEN utility = '{a}' THEN '{b}'" for a, b in L.CLASS_EXACT)
    for a, b in L.CLASS_PREFIXES:
        new = L.CLASS_PREFIXES_V2.get(a, b) if v2 else b
        cases += f" WHEN starts_with(utility, '{a}') THEN '{new}' || substr(utility, {len(a) + 1})"
    return f"variants || CASE {cases} ELSE utility END"


CLASSIFY = """CASE
    WHEN word IS NULL THEN NULL
    WHEN NOT regexp_matches(word, '\\S') THEN 'skip'
    WHEN regexp_matches(word, '^\\s*(?:[+-]?(?:Infinity|(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)\\s*$') THEN 'skip'
    WHEN word IN ('true', 'false') THEN 'skip'
    WHEN regexp_matches(word, '^https?://', 'i') THEN 'skip'
    WHEN regexp_matches(word, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN 'skip'
    WHEN regexp_matches(word, '^[0-9\\s()\\-+.]+$') AND length(regexp_replace(word, '[^0-9]', '', 'g')) >= 4 THEN 'skip'
    WHEN regexp_matches(word, '^\\s*[a-z][a-z0-9-]*(?:\\s+[a-z][a-z0-9-]+)+\\s*$') AND regexp_matches(word, '[-0-9]') THEN 'identifier'
    WHEN regexp_matches(word, '(/|\\\\|\\.[a-z]{2,4}$)', 'i') AND NOT contains(word, ' ') THEN 'skip'
    WHEN contains(word, ' ') THEN 'translatable'
    WHEN regexp_matches(word, '^[$€£¥]\\s?[0-9]+(?:\\.[0-9]+)?$') THEN 'translatable'
    WHEN regexp_matches(word, '^[A-Z][a-z]+$') THEN 'translatable'
    ELSE 'identifier' END"""

LINES = "SELECT source AS path, unnest(string_split(text, chr(10))) AS word, doc_id FROM documents WHERE text IS NOT NULL"
BASE = "role || '.' || lower(regexp_replace(text, '[^a-zA-Z]', '', 'g'))"
MARKED = "'Hi {{ ' || role || ' }} {{{' || CAST(conv_id AS VARCHAR) || '}}} {{open ' || text"
DIR = "CASE WHEN code IN ('" + "', '".join(L.RTL_LOCALES) + "') THEN 'rtl' ELSE 'ltr' END"
LABEL = "CASE code " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in L.LOCALE_LABELS.items()) + " ELSE upper(code) END"
CODES = "CASE prop " + " ".join(f"WHEN '{p}' THEN '{c}'" for p, _, c in L.CSS_PROPS) + " WHEN 'text-align' THEN 'FIX_TEXT_ALIGN' WHEN 'float' THEN 'FIX_FLOAT' ELSE 'none' END"
LOGICAL = "CASE prop " + " ".join(f"WHEN '{p}' THEN '{q}'" for p, q, _ in L.CSS_PROPS) + " ELSE prop END"
CSS_NAMES = [p for p, _, _ in L.CSS_PROPS] + ["text-align", "float", "color"]
RANGES = "r AS (SELECT CAST(conv_id AS VARCHAR) AS path, CAST(turn * 4 AS INTEGER) AS s, CAST(turn * 4 + 2 + length(text) % 5 AS INTEGER) AS e, role, turn FROM conversations WHERE text IS NOT NULL)"
SNAPSHOTS = """
    old AS (SELECT CAST(conv_id AS VARCHAR) AS path, 'turns.' || CAST(turn // 2 AS VARCHAR) AS dot_path, text AS v FROM conversations WHERE text IS NOT NULL AND turn % 2 = 0),
    new AS (SELECT CAST(conv_id AS VARCHAR) AS path, 'turns.' || CAST(turn // 2 AS VARCHAR) AS dot_path, text AS v FROM conversations WHERE text IS NOT NULL AND turn % 2 = 1)
"""

SHEET_PROPS = [p for p, _, _ in L.CSS_PROPS] + ["color"]
SHEETS = f"""
    rows AS (
        SELECT {_pick(SHEET_PROPS, 'p_partkey')} AS a, {_pick(['left', 'right', 'center'], 'p_partkey')} AS side,
               {_pick(['left', 'none', 'right'], 'p_partkey // 3')} AS fl, {_pick(['margin', 'padding', 'border-radius'], 'p_partkey')} AS sh,
               p_partkey % 2 = 0 AS four FROM part
    ), codes AS (
        SELECT CASE a {" ".join(f"WHEN '{p}' THEN '{c}'" for p, _, c in L.CSS_PROPS)} END AS code FROM rows
        UNION ALL SELECT 'FIX_TEXT_ALIGN' FROM rows WHERE side IN ('left', 'right')
        UNION ALL SELECT 'FIX_FLOAT' FROM rows WHERE fl IN ('left', 'right')
        UNION ALL SELECT 'FIX_' || upper(replace(sh, '-', '_')) || '_SHORTHAND' FROM rows WHERE four
    )
"""

PROJECTS = """
    k AS (SELECT c_custkey AS k FROM customer),
    d AS (
        SELECT k, ['^15.1.0', '^18.2.0', '~17.0'][1 + k % 3] AS react,
               CASE WHEN k % 2 = 0 THEN ['^4.9', '^5.3.0'][1 + (k // 2) % 2] END AS ts,
               CASE WHEN k % 3 = 0 THEN ['12.1', '^14.0'][1 + (k // 3) % 2] END AS nxt,
               k % 5 = 0 AS intl, k % 7 = 0 AS i18n,
               CASE WHEN k % 4 = 0 THEN ['^2.2', '^3.4', '>=4.0', 'latest'][1 + (k // 4) % 4] END AS tw,
               k % 2 = 0 AS app, k % 6 < 2 AS pgs FROM k
    )
"""

ADAPTER = """CASE
            WHEN k % 13 = 0 THEN ['next-i18next', 'flag', '-'] WHEN k % 17 = 0 THEN ['-', '-', 'Invalid --adapter value']
            WHEN intl AND NOT i18n THEN ['next-intl', 'dependency', '-'] WHEN i18n AND NOT intl THEN ['next-i18next', 'dependency', '-']
            WHEN intl AND i18n THEN ['-', '-', 'Ambiguous project: both packages are dependencies']
            WHEN app AND NOT pgs THEN ['next-intl', 'app directory', '-'] WHEN pgs AND NOT app THEN ['next-i18next', 'pages directory', '-']
            WHEN app AND pgs THEN ['-', '-', 'Ambiguous project: both app/ and pages/ exist']
            WHEN k % 11 = 0 THEN ['next-intl', 'appDir in configuration', '-'] ELSE ['-', '-', 'Detection failed or is ambiguous'] END"""

ATTRIBUTE = """'(?i) (placeholder|title|alt|aria-label)=(?:"([^"]+)"|''([^'']+)'')'"""

SQL: dict[str, str] = {
    "coverage_by_lang": f"""
        WITH {CATALOGUE}, {CELLS.format(semi="")}
        SELECT coalesce(locale, 'all') AS locale, count(key) AS total, count(*) FILTER (present) AS covered, count(*) FILTER (filled) AS filled,
               round(CASE WHEN count(key) = 0 THEN 100.0 ELSE 100.0 * CAST(count(*) FILTER (present) AS DOUBLE) / count(key) END, 6) AS percent
        FROM cells GROUP BY ROLLUP (locale)""",
    "reconciliation_report": f"""
        WITH {CATALOGUE}, {VALID_CELLS}, c AS (SELECT count(*) AS total, count(*) FILTER (present) AS covered FROM cells)
        SELECT (SELECT count(*) FROM ({NEW})) AS n_new, (SELECT count(*) FROM ({ORPHANS})) AS n_orphans, total - covered AS n_missing, total, covered,
               round(CASE WHEN total = 0 THEN 100.0 ELSE 100.0 * CAST(covered AS DOUBLE) / total END, 2) AS percent,
               (covered = total) AND (SELECT count(*) FROM ({ORPHANS})) = 0 AS ok FROM c""",
    "new_keys": f"WITH {CATALOGUE} {NEW}",
    "orphan_keys": f"WITH {CATALOGUE} {ORPHANS}",
    "missing_keys": f"WITH {CATALOGUE}, {VALID_CELLS} SELECT locale, key FROM cells WHERE NOT present",
    "write_back_pruned": f"""
        WITH {CATALOGUE}, out AS (
            SELECT locale, key, value FROM messages UNION ALL SELECT 'en', key, key FROM ({NEW})
        ) SELECT locale, key, sha256(value) AS value_hash FROM out WHERE NOT (locale = 'en' AND key IN ({ORPHANS}))""",
    "seed_locales": f"""
        WITH {CATALOGUE} SELECT locale, key, length(value) AS n_chars FROM messages
        UNION ALL SELECT l.locale, 'item-' || CAST(item_id AS VARCHAR), CASE WHEN l.locale = 'en' THEN length(text) ELSE 0 END
        FROM benchmark, locales l WHERE text IS NOT NULL""",
    "last_wins": "SELECT role AS key, sha256(arg_max(text, conv_id * 100000 + turn)) AS value_hash FROM conversations WHERE text IS NOT NULL GROUP BY role",
    "value_edits": f"""
        WITH {SNAPSHOTS} SELECT path, dot_path, sha256(o.v) AS old_hash, sha256(n.v) AS new_hash FROM old o JOIN new n USING (path, dot_path)
        WHERE o.v <> '' AND o.v <> n.v AND o.v NOT IN (SELECT v FROM new) AND n.v NOT IN (SELECT v FROM old)""",
    "migrated_messages": f"""
        WITH {CATALOGUE} SELECT m.locale, CASE WHEN v.key IS NULL THEN m.key ELSE m.key || '*' END AS key,
            sha256(CASE WHEN v.key IS NOT NULL AND m.locale = 'en' THEN m.key || '*' ELSE m.value END) AS value_hash
        FROM messages m LEFT JOIN valid v ON m.key = v.key""",
    "delta_merge": f"""
        WITH {CATALOGUE}, n AS (SELECT locale, key, 'new: ' || value AS v FROM messages WHERE length(value) > 1000),
             o AS (SELECT locale, key, value AS v FROM messages WHERE length(value) < 3000)
        SELECT locale, key, sha256(coalesce(n.v, o.v)) AS value_hash FROM o FULL JOIN n USING (locale, key)""",
    "incremental_changed": """
        SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL AND (doc_id % 2 = 1 OR doc_id % 20 = 0)""",
    "incremental_sync": r"""
        WITH f AS (SELECT conv_id, turn, 'chat' || conv_id || 'x' || turn || '.chat.' AS k,
                          regexp_replace(trim('Say ' || trim(regexp_replace(text, '[{}<>&"''`\\]', '', 'g'), E' \t\n\r'), E' \t\n\r'), '\s+', ' ', 'g') AS t FROM conversations WHERE text IS NOT NULL),
        m AS (SELECT 0 AS batch, k || 'title' AS key, t AS value FROM f WHERE conv_id % 4 <> 0 UNION ALL SELECT 1, k || 'title', t FROM f
              UNION ALL SELECT 1, k || 'body', 'More words' FROM f WHERE conv_id % 4 <> 0 AND turn % 2 = 0)
        SELECT batch, key, l AS locale, CASE WHEN l = 'en' THEN value ELSE '' END AS value FROM m, (SELECT unnest(['en', 'ar']) AS l)""",
    "html_findings_by_code": f"WITH {PAGES}, {FINDINGS} SELECT code, count(*) AS n FROM findings GROUP BY code",
    "html_score_histogram": f"""
        WITH {PAGES}, {FINDINGS}, {SCORED}
        SELECT CAST(score AS INTEGER) AS score, count(*) AS n_pages, CAST(sum(n_findings) AS BIGINT) AS n_findings FROM scored GROUP BY score""",
    "html_scores_parsed": f"WITH {PAGES}, {FINDINGS}, {SCORED} SELECT page_id AS doc, CAST(score AS INTEGER) AS score, n_findings FROM scored",
    "html_found_tags": f"""
        WITH {PAGES} SELECT tag, count(*) AS n FROM (SELECT html, unnest(['header', 'nav', 'main', 'footer']) AS tag FROM p)
        WHERE regexp_matches(html, '<' || tag || '[\\s>/]', 'i') GROUP BY tag""",
    "page_class_tokens": """
        SELECT token, count(*) AS n FROM (SELECT unnest(string_split(v, ' ')) AS token FROM (SELECT unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS v FROM pages))
        WHERE token <> '' GROUP BY token""",
    "page_shown_attributes": rf"""
        WITH u AS (SELECT html, regexp_replace(url, '[{{}}<>&"''`\\]', '', 'g') AS u FROM pages WHERE html IS NOT NULL AND url IS NOT NULL),
        p AS (SELECT replace(html, '<body>', '<body><img alt="Page ' || u || '" src=x ARIA-LABEL=''Show ' || u || '''>') AS h FROM u),
        a AS (SELECT unnest(regexp_extract_all(h, {ATTRIBUTE}, 1)) AS name, unnest(regexp_extract_all(h, {ATTRIBUTE}, 2)) AS v, unnest(regexp_extract_all(h, {ATTRIBUTE}, 3)) AS w FROM p)
        SELECT lower(name) AS name, coalesce(v, '') || coalesce(w, '') AS value, count(*) AS n FROM a GROUP BY 1, 2""",
    "page_headings": """
        SELECT page_id AS doc, page_id % 7 = 0 AS failed, CASE WHEN page_id % 7 = 0 THEN 0 ELSE len(regexp_extract_all(html, '<h[123][ >]')) END AS headings,
               CASE WHEN page_id % 7 = 0 THEN 0 ELSE len(regexp_extract_all(html, '<a[ >]')) END AS links FROM pages WHERE html IS NOT NULL""",
    "pruned_scan": "SELECT doc_id, sha256(text) AS text_hash FROM documents WHERE lang IS DISTINCT FROM 'de' AND doc_id IS NOT NULL",
    "static_keys": """
        SELECT key, count(*) AS n FROM (SELECT unnest(['chat.' || role, 'rich.' || turn]) AS key FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL) GROUP BY key""",
    "language_arrays": """
        SELECT 'src/a' || c_custkey || '.js' AS path, ['[''en'', ''ar'']', '[ "en" ,"ar" ]', NULL, NULL, '[''en'',' || chr(10) || ' ''ar'']'][1 + c_custkey % 5] AS found
        FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 5 NOT IN (2, 3)""",
    "css_fixed_text": f"""
        WITH r AS (
            SELECT p_partkey AS k, p_size || 'px' AS px, {_pick(SHEET_PROPS, 'p_partkey')} AS a, {_pick(['left', 'right', 'center'], 'p_partkey')} AS side,
                   {_pick(['left', 'none', 'right'], 'p_partkey // 3')} AS fl, {_pick(['margin', 'padding', 'border-radius'], 'p_partkey')} AS sh FROM part
        ), n AS (
            SELECT *, CASE a {" ".join(f"WHEN '{p}' THEN '{n}'" for p, n, _ in L.CSS_PROPS)} END AS b, CASE WHEN k % 5 = 0 THEN ' !important' ELSE '' END AS mark,
                   CASE sh {" ".join(f"WHEN '{p}' THEN [{', '.join(repr(x) for x in n)}]" for p, n in L.CSS_SHORTHANDS.items())} END AS parts FROM r
        )
        SELECT 'src/' || k || '.css' AS path, CAST((b IS NOT NULL)::INT + (side <> 'center')::INT + (fl <> 'none')::INT + (k % 2 = 0)::INT AS INTEGER) AS n_edits,
               '.a {{ ' || coalesce(b, a) || ': ' || px || '; text-align: ' || CASE side WHEN 'left' THEN 'start' WHEN 'right' THEN 'end' ELSE side END
               || '; float: ' || CASE fl WHEN 'none' THEN fl ELSE 'inline-' || CASE fl WHEN 'left' THEN 'start' ELSE 'end' END END || ' }}' || chr(10) || '.b {{ '
               || CASE WHEN k % 2 = 0 THEN array_to_string(list_transform(list_zip(parts, ['1px', px, '3px', 'calc(1px + 2px)']), lambda x: x[1] || ': ' || x[2] || mark), '; ')
                       ELSE sh || ': 1px ' || px || ' 3px' || mark END || '; }}' AS content FROM n""",
    "user_rules": f"""
        WITH {SHEETS}, c AS (SELECT code FROM codes WHERE code IS NOT NULL UNION ALL SELECT 'FIX_COLOR_LENGTH' FROM rows WHERE a = 'color')
        SELECT code, CASE code WHEN 'FIX_COLOR_LENGTH' THEN 'critical' ELSE 'warning' END AS severity, count(*) AS n,
               CAST(count(*) * CASE code WHEN 'FIX_COLOR_LENGTH' THEN 7 ELSE 5 END AS BIGINT) AS points FROM c GROUP BY code""",
    "user_rules_fixed": f"""
        SELECT 'src/' || p_partkey || '.css' AS path, 'font-size: ' || p_size || 'px; color: inherit' AS first FROM part WHERE {_pick(SHEET_PROPS, 'p_partkey')} = 'color'""",
    "user_rules_components": """
        SELECT code, count(*) AS n, CAST(count(*) * any_value(p) AS BIGINT) AS points
        FROM conversations, (VALUES ('AVOID_PHYSICAL_PROP', 5), ('AVOID_BARE_NUMBER', 3)) AS r(code, p) WHERE text IS NOT NULL GROUP BY code""",
    "verified_edits": r"""
        WITH f AS (SELECT 'src/chats/Chat' || conv_id || 'x' || turn || '.jsx' AS path, conv_id % 10 = 0 AS failed,
                          'Say ' || trim(regexp_replace(text, '[^A-Za-z ]', '', 'g')) AS t FROM conversations WHERE text IS NOT NULL)
        SELECT path, failed, CAST(CASE WHEN failed THEN 0 ELSE 1 END AS INTEGER) AS n_edits,
               sha256('export default function Chat() {' || chr(10) || '    return (' || chr(10) || '        <div className="ml-2 flex" style={{' || CASE WHEN failed THEN 'marginLeft' ELSE 'marginInlineStart' END
               || ': 4}}>' || chr(10) || '            <h1>' || t || '</h1>' || chr(10) || '            <p>Dear {name}, ' || t || '</p>' || chr(10)
               || '            <p>You have <strong>{count}</strong> mails</p>' || chr(10) || '            <p>{format(x)}!</p>' || chr(10)
               || '            <img alt="A face" src="a.png" />' || chr(10) || '        </div>' || chr(10) || '    );' || chr(10) || '}' || chr(10)) AS content FROM f""",
    "translation_memory": f"""
        WITH m AS (SELECT CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) AS key, text, text IN (SELECT text FROM conversations WHERE conv_id % 2 = 0) AS held FROM conversations WHERE text IS NOT NULL)
        SELECT l AS locale, key, CASE WHEN held THEN '[TEST_' || upper(l) || '] ' || text END AS value, NOT held AS failed FROM m, (SELECT unnest(['ar', 'es']) AS l)""",
    "css_findings_by_code": f"WITH {SHEETS} SELECT code, count(*) AS n FROM codes WHERE code IS NOT NULL GROUP BY code",
    "css_fixed": "SELECT 100 AS score, count(*) AS n FROM part HAVING count(*) > 0",
    "css_property_map": f"""
        WITH r AS (SELECT {_pick(CSS_NAMES, 'p_partkey')} AS prop, CASE WHEN p_size % 2 = 0 THEN 'left' ELSE 'right' END AS value FROM part)
        SELECT prop, value, {CODES} AS code, {LOGICAL} AS new_prop,
               CASE prop WHEN 'text-align' THEN CASE value WHEN 'left' THEN 'start' ELSE 'end' END
                         WHEN 'float' THEN CASE value WHEN 'left' THEN 'inline-start' ELSE 'inline-end' END ELSE value END AS new_value, count(*) AS n
        FROM r GROUP BY ALL""",
    "class_token_rewrite": f"WITH {CLASS_TOKENS}, {SPLIT} SELECT token, {_rewrite(False)} AS v3, {_rewrite(True)} AS v2, count(*) AS n FROM u GROUP BY ALL",
    "class_variants": f"WITH {CLASS_TOKENS}, {SPLIT} SELECT variants, utility, count(*) AS n FROM u GROUP BY ALL",
    "class_value_rewrite": f"""
        WITH {CLASS_TOKENS}, {SPLIT}, w AS (SELECT p_partkey, token, {_rewrite(False)} AS new, p_partkey % 4 = 0 AS abs, p_partkey % 3 = 0 AS moved FROM u),
        x AS (
            SELECT *, regexp_extract(new, '^((?:(?:sm|md|lg|xl|2xl|hover|focus|dark):)*)(.*)$', 2) AS own,
                   regexp_matches(new, '^-?(?:start-|end-|left-|right-|inset-|inline-start-|inline-end-)') AS placed FROM w
        ), y AS (SELECT *, token <> new AND regexp_matches(own, '^-?(?:inline-end-|inline-start-|inset-inline-|start-|end-)') AND moved AS mirror FROM x)
        SELECT p_partkey, CASE WHEN abs THEN 'absolute  ' ELSE '' END || new || CASE WHEN moved THEN ' -translate-x-2' ELSE '' END
               || CASE WHEN abs AND NOT placed THEN ' start-0 top-0' ELSE '' END || CASE WHEN mirror THEN ' rtl-mirror' ELSE '' END AS value,
               CAST((token <> new) AS INTEGER) + CASE WHEN abs AND NOT placed THEN 2 ELSE 0 END AS replacements, mirror AS needs_mirror FROM y""",
    "class_findings": f"""
        WITH {CLASS_TOKENS}, v AS (SELECT token || CASE WHEN p_partkey % 2 = 0 THEN ' text-right float-left' ELSE '' END AS v FROM t), c AS (
            SELECT 'DETECTED_DIRECTIONAL_CLASS_NAME' AS code FROM v WHERE regexp_matches(v, '\\b(?:text-left|text-right)\\b')
            UNION ALL SELECT 'DETECTED_DIRECTIONAL_CLASS_NAME' FROM v WHERE regexp_matches(v, '\\b(?:float-left|float-right)\\b')
            UNION ALL SELECT 'AVOID_PHYSICAL_MARGIN_PADDING_CLASS' FROM v WHERE regexp_matches(v, '\\b(?:ml-|mr-|pl-|pr-)[0-9]+')
        ) SELECT code, count(*) AS n FROM c GROUP BY code""",
    "classify_words_by_lang": f"""
        WITH w AS (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents) SELECT lang, {CLASSIFY} AS class, count(*) AS n FROM w GROUP BY ALL""",
    "text_slug_keys": """
        WITH a AS (SELECT doc_id, string_split_regex(trim(regexp_replace(regexp_replace(text, '[^ -~]', '', 'g'), '\\s+', ' ', 'g')), ' ')[1:4] AS w FROM documents WHERE text IS NOT NULL),
        b AS (SELECT doc_id, list_transform(w, lambda x, i: CASE WHEN i = 1 THEN lower(regexp_replace(x, '[^a-zA-Z0-9]', '', 'g'))
            ELSE upper(substr(regexp_replace(x, '[^a-zA-Z0-9]', '', 'g'), 1, 1)) || lower(substr(regexp_replace(x, '[^a-zA-Z0-9]', '', 'g'), 2)) END) AS p FROM a)
        SELECT doc_id, coalesce(array_to_string(list_filter(p, lambda x: x <> ''), ''), '') AS slug FROM b""",
    "text_hash_prefix": "SELECT doc_id, substr(sha256(text), 1, 8) AS text_hash FROM documents WHERE text IS NOT NULL",
    "duplicate_text_keys": "SELECT sha256(text) AS sha, count(*) AS n, max(doc_id) AS last_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "collision_counters": f"""
        WITH b AS (SELECT conv_id, turn, role, {BASE} AS base FROM conversations WHERE text IS NOT NULL),
             n AS (SELECT *, row_number() OVER (PARTITION BY role, base ORDER BY conv_id, turn) AS n FROM b)
        SELECT conv_id, turn, base || CASE WHEN n > 1 THEN CAST(n AS VARCHAR) ELSE '' END AS key FROM n""",
    "key_allocation": """
        WITH b AS (SELECT conv_id, lpad(CAST(conv_id AS VARCHAR), 12, '0') AS path, CAST(turn AS INTEGER) AS pos, 'chat' || CAST(conv_id AS VARCHAR) || '.' || role AS base
                   FROM conversations WHERE text IS NOT NULL),
             n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY pos) AS n FROM b WHERE conv_id % 10 <> 0)
        SELECT path, pos, base || '_' || CAST(pos AS VARCHAR) AS key FROM b WHERE conv_id % 10 = 0
        UNION ALL SELECT path, pos, base || CASE WHEN n > 1 THEN CAST(n AS VARCHAR) ELSE '' END FROM n""",
    "namespaces": """
        WITH p AS (SELECT page_id, regexp_extract(url, '/([a-z]+)/[0-9]+', 1) AS folder, 'page' || CAST(page_id % 40 AS VARCHAR) AS stem FROM pages WHERE url IS NOT NULL),
             s AS (SELECT stem, count(DISTINCT folder) AS n FROM p GROUP BY stem)
        SELECT page_id, CASE WHEN n > 1 AND folder <> '' THEN folder || '_' || stem ELSE stem END AS namespace FROM p JOIN s USING (stem)""",
    "element_roles": """
        WITH a AS (SELECT unnest(regexp_extract_all(html, '<(h1|h2|h3|p|li|a|span|td)[^>]*>[^<]+', 1)) AS tag FROM pages WHERE html IS NOT NULL)
        SELECT tag, CASE tag WHEN 'h1' THEN 'title' WHEN 'h2' THEN 'subtitle' WHEN 'h3' THEN 'heading' WHEN 'p' THEN 'body' WHEN 'a' THEN 'cta'
               WHEN 'li' THEN 'item' WHEN 'span' THEN 'label' ELSE 'slug' END AS role, count(*) AS n FROM a GROUP BY ALL""",
    "sibling_index": "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS INTEGER) AS idx FROM conversations",
    "locale_dir": f"""
        WITH c AS (SELECT CASE doc_id % 7 WHEN 0 THEN 'ar' WHEN 1 THEN 'he' ELSE lang END AS code FROM documents WHERE lang IS NOT NULL)
        SELECT code, {DIR} AS dir, {LABEL} AS label, count(*) AS n FROM c GROUP BY ALL""",
    "token_roundtrip": f"""
        SELECT conv_id, turn, replace(replace({MARKED}, '{{{{ ' || role || ' }}}}', '<v id="0" />'), '{{{{{{' || CAST(conv_id AS VARCHAR) || '}}}}}}', '<v id="1" />') AS tokenized,
               2 AS n_vars, role AS first_var, true AS same FROM conversations WHERE text IS NOT NULL""",
    "mock_translate": f"""
        WITH m AS (SELECT CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) AS key, {MARKED} AS value FROM conversations WHERE text IS NOT NULL)
        SELECT 'en' AS locale, key, value FROM m UNION ALL SELECT 'ar', key, '[TEST_AR] ' || value FROM m UNION ALL SELECT 'es', key, '[TEST_ES] ' || value FROM m""",
    "mock_translate_delta": """
        WITH m AS (SELECT turn, CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) AS key, text AS value FROM conversations WHERE text IS NOT NULL)
        SELECT 'en' AS locale, key, value FROM m UNION ALL SELECT 'ar', key, '[TEST_AR] ' || value FROM m WHERE turn = 0""",
    "translation_chunks": """
        WITH n AS (SELECT role, conv_id, (row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1) // 100 AS chunk FROM conversations)
        SELECT role, CAST(chunk AS INTEGER) AS chunk, count(*) AS n, min(conv_id) AS first_conv FROM n GROUP BY ALL""",
    "answers_by_position": """
        WITH n AS (SELECT conv_id, text AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS k FROM conversations WHERE text IS NOT NULL)
        SELECT conv_id, sha256(string_agg(CASE WHEN k % 3 <> 2 THEN upper(regexp_replace(t, '[^ -~]', '', 'g')) ELSE t END, '|' ORDER BY k)) AS joined FROM n GROUP BY conv_id""",
    "promote_insert_only": f"""
        WITH f AS ({LINES}), k AS (SELECT DISTINCT word FROM f WHERE {CLASSIFY} = 'translatable')
        SELECT 'en' AS locale, word AS key, word AS value FROM k WHERE word NOT IN (SELECT word FROM f WHERE doc_id % 3 = 0)""",
    "registry_values_per_file": f"WITH f AS ({LINES}) SELECT path, count(DISTINCT word) AS n_values FROM f WHERE {CLASSIFY} = 'translatable' GROUP BY path",
    "props_flatten": """
        SELECT 'v.kind' AS dot_path, 'kind' AS field, event_type AS value, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY event_type
        UNION ALL SELECT 'v.list.0', 'list', 'a', count(*) FROM events WHERE props IS NOT NULL
        UNION ALL SELECT 'v.list.1.n', 'n', 'x', count(*) FROM events WHERE props IS NOT NULL""",
    "edit_overlap": f"""
        WITH {RANGES}, n AS (SELECT path, s, e, lead(e) OVER (PARTITION BY path ORDER BY s DESC, e DESC) AS next_end FROM r)
        SELECT path, s AS start, e AS "end", next_end FROM n WHERE next_end > s""",
    "edit_first_of_range": f"""
        WITH {RANGES} SELECT path, s % 8 AS start, s % 8 + 3 AS "end", arg_min(role, turn) AS replacement FROM r GROUP BY path, s % 8""",
    "edit_apply": """
        WITH b AS (SELECT doc_id, substr(text, 1, 10) || '<B>' || substr(text, 11) AS t FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, sha256(substr(t, 1, 2) || '<A>' || substr(t, 5)) AS edited FROM b""",
    "project_adapter": f"""
        WITH {PROJECTS}, v AS (SELECT {ADAPTER} AS v FROM d)
        SELECT v[1] AS name, v[2] AS reason, v[3] AS error, count(*) AS n FROM v GROUP BY ALL""",
    "catalogue_paths": f"""
        WITH {PROJECTS}, v AS (SELECT k, {ADAPTER} AS v FROM d),
        f AS (SELECT k, unnest(CASE v[1] WHEN 'next-i18next' THEN ['src/i18n/messages/en.json', 'public/locales/en/common.json'] ELSE ['src/i18n/messages/en.json'] END) AS file FROM v)
        SELECT k || '/' || file AS file, 'en' AS locale, 'customer' AS key, c_name AS value FROM f JOIN customer ON c_custkey = k""",
    "catalogue_files": """
        SELECT replace(template, '*', lang) AS file, lang AS locale, CAST(doc_id AS VARCHAR) AS key, sha256(max(text)) AS value_hash
        FROM documents, (VALUES ('src/i18n/messages/*.json'), ('public/locales/*/common.json')) t(template)
        WHERE regexp_full_match(lang, '[A-Za-z0-9]+([-_][A-Za-z0-9]+)*') AND doc_id IS NOT NULL GROUP BY ALL""",
    "project_environment": f"""
        WITH {PROJECTS}, s AS (SELECT nxt, CASE WHEN react = '^15.1.0' THEN 'unsupported' WHEN ts = '^4.9' THEN 'legacy' ELSE 'supported' END AS status FROM d)
        SELECT status, CASE status WHEN 'legacy' THEN '^22.5.1' WHEN 'supported' THEN 'latest' ELSE '-' END AS i18next,
               status <> 'unsupported' AND coalesce(nxt = '12.1', false) AS noted, count(*) AS n FROM s GROUP BY ALL""",
    "project_tailwind": f"""
        WITH {PROJECTS}, v AS (SELECT k, CAST(nullif(regexp_extract(coalesce(tw, ''), '([0-9]+)', 1), '') AS INTEGER) AS version FROM d)
        SELECT version IS NOT NULL AS has_tailwind, coalesce(version, 0) AS version, CASE WHEN version IN (2, 3) AND k % 4 = 0 THEN 'tailwind.config.ts' ELSE '-' END AS config_path,
               CASE WHEN version = 4 AND k % 8 = 0 THEN 'src/index.css' ELSE '-' END AS css_entry_path, count(*) AS n FROM v GROUP BY ALL""",
    "project_frameworks": f"WITH {PROJECTS} SELECT k % 3 = 0 AND nxt IS NOT NULL AND (k % 2 = 0 OR k % 6 = 0) AS is_next, count(*) AS n FROM d GROUP BY ALL",
    "snapshot_history": """
        WITH RECURSIVE c AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL),
        e AS (SELECT a.turn AS step, a.text AS old, max(b.text) AS new FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
              WHERE a.text <> '' AND a.text <> b.text AND NOT EXISTS (SELECT 1 FROM c x WHERE x.turn = a.turn + 1 AND x.text = a.text)
                AND NOT EXISTS (SELECT 1 FROM c x WHERE x.turn = a.turn AND x.text = b.text) GROUP BY 1, 2),
        n AS (SELECT e.*, (SELECT min(f.step) FROM e f WHERE f.old = e.new AND f.step > e.step) AS next FROM e),
        w AS (SELECT old AS start, new, next FROM n WHERE (old, step) IN (SELECT (old, min(step)) FROM n GROUP BY old)
              UNION ALL SELECT w.start, n.new, n.next FROM w JOIN n ON n.old = w.new AND n.step = w.next)
        SELECT start AS old_key, new AS new_key FROM w WHERE next IS NULL AND start <> new""",
    "class_report": """
        SELECT count(*) AS files_modified, count(*) AS classes_replaced, 0 AS dynamic, 0 AS needs_mirror
        FROM conversations WHERE text IS NOT NULL""",
    "jsx_rewrite_scores": """
        WITH c AS (SELECT count(*) AS n FROM conversations WHERE text IS NOT NULL)
        SELECT 90 AS score, n, 'before' AS "when" FROM c UNION ALL SELECT 95, n, 'after' FROM c""",
    "jsx_extract": """
        WITH f AS (SELECT conv_id, turn, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS t FROM conversations WHERE text IS NOT NULL),
        n AS (SELECT conv_id || 'x' || turn AS c, regexp_replace(trim('Say ' || trim(t)), '\\s+', ' ', 'g') AS t FROM f),
        u AS (
            SELECT c, 0 AS pos, 'string' AS kind, t AS value, 'title' AS role, NULL AS reason FROM n
            UNION ALL SELECT c, 1, 'string', 'Dear {{name}}, ' || t, 'body', NULL FROM n
            UNION ALL SELECT c, 2, 'string', 'You have <strong>{{count}}</strong> mails', 'body2', NULL FROM n
            UNION ALL SELECT c, 3, 'skipped', NULL, NULL, 'complex-expression' FROM n
            UNION ALL SELECT c, 4, 'string', 'A face', 'aFace', NULL FROM n
        ) SELECT 'src/chats/Chat' || c || '.jsx' AS path, pos, kind, value, 'chat' || c || '.chat.' || role AS key, reason FROM u""",
}
