"""SQL of the training-data queries whose results SQL can express, whatever way they are reached."""

from __future__ import annotations

from babelyard.llm import licenses, quality

UPPER, LOWER = licenses.UPPER, licenses.LOWER


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


TOP_K = """
    WITH clean AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), ranked AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id) AS rank
        FROM clean q JOIN clean c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        WHERE q.vec_id % 50 = 0
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def license_scan(threshold: float = 0.8) -> str:
    apart = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = lambda x: f"list_filter(string_split_regex(translate({x}, '{UPPER}', '{LOWER}'), '{apart}'), lambda x: x <> '')"
    places = []
    for k, (phrase, _) in enumerate(licenses.PHRASES):
        test = " AND ".join(f"w[i + {n}] = '{part}'" for n, part in enumerate(phrase.split(), 1))
        places.append(f"list_filter(range(len(w)), lambda i: {test}) AS p{k}")
    every = "list_concat(" * (len(places) - 1) + "p0" + "".join(f", p{k})" for k in range(1, len(places)))
    labels = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(licenses.PHRASES))
    rows = []
    for label, text in licenses.TEMPLATES:
        own = licenses.template_words(text)
        must, never = licenses.TOLD_BY.get(label, ((), ()))
        lists = ", ".join(f"[{', '.join(map(_text, x))}]::VARCHAR[]" for x in (own, must, never))
        rows.append(f"({_text(label)}, {lists}, {licenses.window_length(text, threshold)}, {licenses.needed(len(own), threshold)})")
    templates = ", ".join(rows)
    joined = lambda x: f"coalesce(array_to_string(list_sort(list_distinct(list_filter({x}, lambda x: x IS NOT NULL))), ','), '')"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT r, doc_id, {words('text')} AS w FROM d),
        p AS (SELECT r, doc_id, w, {', '.join(places)} FROM w),
        b AS (SELECT r, doc_id, len(w) AS n_words, {every} AS hits, [{labels}] AS base FROM p),
        t AS (FROM (VALUES {templates}) AS t(label, words, must, never, span, need)),
        spans AS (SELECT r, label, words, must, never, need, w[i + 1 : i + span] AS own FROM (SELECT r, t.*, w, unnest(range(len(w))) AS i FROM w, t WHERE len(list_intersect(words, w)) >= need) WHERE list_contains(words, w[i + 1])),
        n AS (SELECT r, label, len(list_intersect(words, own)) / len(words) AS share FROM spans
              WHERE len(list_intersect(words, own)) >= need AND len(list_intersect(must, own)) = len(must) AND len(list_intersect(never, own)) = 0),
        g AS (SELECT r, list(label) AS more, max(share) AS best FROM n GROUP BY r)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(hits) AS BIGINT) AS n_base, list_min(hits) AS first_word, list_max(hits) AS last_word,
               {joined('base')} AS base_labels, {joined("list_concat(base, coalesce(more, []))")} AS labels,
               CASE WHEN len(hits) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
        FROM b LEFT JOIN g USING (r)
    """


JACCARD = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '(?:[a-z0-9]|[^\x00-\x7f])+') AS w FROM documents WHERE text IS NOT NULL),
    s AS (
        SELECT doc_id, list_sort(list_distinct(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1 : i + 5], ' ')))) AS s
        FROM w WHERE len(w) > 0
    ), sets AS (SELECT min(doc_id) AS id, count(*) AS n, s FROM s GROUP BY s),
    inv AS (SELECT id, n, len(s) AS size, unnest(s) AS x FROM sets),
    pairs AS (
        SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb
        FROM inv a JOIN inv b ON a.x = b.x AND a.id < b.id
        GROUP BY a.id, b.id HAVING count(*) >= 0.8 * (any_value(a.size) + any_value(b.size) - count(*)) - 1e-9
    ), edges AS (SELECT a, b, nb AS n FROM pairs UNION ALL SELECT b, a, na FROM pairs),
    reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
    lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
    links AS (SELECT a, sum(n) AS n FROM edges GROUP BY a)
    SELECT d.doc_id, coalesce(least(sets.id, lowest.b), sets.id, d.doc_id) AS class_id, coalesce(sets.n, 1) AS n_copies,
           CAST(coalesce(links.n, 0) + coalesce(sets.n, 1) - 1 AS BIGINT) AS n_links
    FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN sets ON s.s = sets.s
    LEFT JOIN lowest ON lowest.a = sets.id LEFT JOIN links ON links.a = sets.id
"""


def quality_rules(risk: float = 0.02, confidence: float = 0.95) -> str:
    rules, bands = quality.RULES, quality.BANDS
    level = (1 - confidence) / (len(bands) + 1)
    value = lambda rule: rule.value.replace("try_divide(", "(").replace(", ", " / nullif(").replace(")", ", 0))")
    cuts = lambda rule: "[" + ", ".join(f"{float(c)!r}::DOUBLE" for c in rule.cutoffs) + "]"
    rejected = " OR ".join(f"coalesce({value(rule)} > {cuts(rule)}[j + 1], false)" for rule in rules)
    failed = ", ".join(f"CASE WHEN {value(rule)} > {cuts(rule)}[taken + 1] THEN '{rule.name}' END" for rule in rules)
    band = " + ".join(f"CAST(n_words >= {end} AS INTEGER)" for end in bands)
    return rf"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS x FROM d),
        win AS (SELECT r, i, array_to_string(w[i + 1 : i + 8], ' ') AS win FROM (SELECT r, w, unnest(range(len(w) - 7)) AS i FROM w WHERE len(w) >= 8)),
        twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM win) WHERE n > 1),
        covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY r),
        c AS (SELECT r, doc_id, text, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                     length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(x) - len(list_distinct(x)) AS n_dup_lines, len(x) AS n_lines,
                     length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals FROM w),
        m AS (SELECT c.*, coalesce(v.n, 0) AS n_repeat_words, {band} AS band FROM c LEFT JOIN covered v USING (r)),
        told AS (SELECT doc_id, min(quality) AS q FROM labels GROUP BY doc_id HAVING min(quality) IS NOT NULL),
        good AS (SELECT first(m) AS m FROM m JOIN told USING (doc_id) GROUP BY m.text HAVING min(q) = 1),
        texts AS (SELECT unnest(m) FROM good),
        sizes AS (SELECT b.band, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range({len(bands) + 1})) AS INTEGER) AS band) b LEFT JOIN (SELECT band, count(*) AS n FROM texts GROUP BY band) USING (band)),
        pools AS (
            SELECT band, 0 AS lowest, n AS held FROM sizes WHERE band = 0
            UNION ALL SELECT s.band, CASE WHEN held >= {quality.fewest(risk, level)} THEN s.band ELSE lowest END, CASE WHEN held >= {quality.fewest(risk, level)} THEN n ELSE held + n END
            FROM pools p JOIN sizes s ON s.band = p.band + 1
        ), strata AS (
            SELECT p.band, CASE WHEN p.lowest = l.lowest AND l.lowest > 0 AND l.held < {quality.fewest(risk, level)}
                                THEN (SELECT lowest FROM pools WHERE band = l.lowest - 1) ELSE p.lowest END AS stratum
            FROM pools p, (SELECT * FROM pools WHERE band = {len(bands)}) l
        ),
        s AS (SELECT texts.*, stratum FROM texts JOIN strata USING (band)),
        totals AS (SELECT stratum, count(*) AS n FROM s GROUP BY stratum),
        terms AS (SELECT stratum, i, exp(lgamma(n + 1) - (CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END) - (CASE WHEN n = i THEN 0 ELSE lgamma(n - i + 1) END) + i * ln({risk!r}) + (n - i) * ln(1 - {risk!r})) AS p
                  FROM (SELECT stratum, n, unnest(range(CAST(ceil(n * {risk!r}) AS BIGINT) + 1)) AS i FROM totals)),
        tails AS (SELECT stratum, i, sum(p) OVER (PARTITION BY stratum ORDER BY i) AS p FROM terms),
        allowed AS (SELECT stratum, max(CASE WHEN p <= {level!r} THEN i ELSE -1 END) AS k FROM tails GROUP BY stratum),
        rejected AS (SELECT stratum, j, count(*) FILTER ({rejected}) AS n FROM s, (SELECT unnest(range({len(rules[0].cutoffs)})) AS j) GROUP BY stratum, j),
        chosen AS (SELECT o.stratum, max(j) AS taken FROM rejected o JOIN allowed a ON o.stratum = a.stratum AND o.n <= a.k GROUP BY o.stratum),
        j AS (SELECT m.*, t.stratum, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, list_filter([{failed}], lambda x: x IS NOT NULL) AS failed
              FROM m JOIN strata t USING (band) LEFT JOIN chosen USING (stratum))
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
               CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
               NOT base_failed AND len(failed) = 0 AS kept, stratum, coalesce(array_to_string(failed, ','), '') AS failed_rules FROM j
    """


#: The CRC-32 of decimal numbers, of ids in the column `id` of a table `of`, as `h`.
def _crc32(of: str, id_col: str) -> str:
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
        crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: {step}) AS v FROM range(256) r(i))),
        hashed AS (
            SELECT id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
            FROM (SELECT DISTINCT {id_col} AS id FROM {of} WHERE {id_col} IS NOT NULL), crc
        )"""


def repeats(words: int = 35) -> str:
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        win AS (SELECT r, i, md5(array_to_string(w[i + 1 : i + {words}], ' ')) AS x FROM (SELECT r, w, unnest(range(len(w) - {words - 1})) AS i FROM d WHERE len(w) >= {words})),
        twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY x) AS n FROM win) WHERE n > 1),
        gone AS (SELECT r, list(DISTINCT j) AS gone FROM (SELECT r, unnest(range(i, i + {words})) AS j FROM twice) GROUP BY r),
        word AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS j FROM d WHERE r IN (SELECT r FROM gone)),
        cut AS (SELECT r, unnest(gone) AS j FROM gone),
        kept AS (SELECT word.r, string_agg(x, ' ' ORDER BY word.j) AS kept FROM word LEFT JOIN cut ON word.r = cut.r AND word.j = cut.j WHERE cut.r IS NULL GROUP BY word.r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
        FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
    """


def periodic_runs() -> str:
    """Every pair of equal words at a lag, stretches of them, and of equal stretches the least lag."""
    return rf"""
        WITH {_crc32('documents', 'doc_id')},
        d AS (SELECT row_number() OVER () AS r, doc_id, h, h // 10 AS g, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
              FROM documents LEFT JOIN hashed ON doc_id = id),
        a AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN g % len(w) END AS a FROM d),
        p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
        t AS (SELECT r, doc_id, n, CASE WHEN coalesce(h % 10 = 0, false) AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM p),
        word AS (SELECT r, n, unnest(w) AS x, unnest(range(n)) AS i FROM t),
        same AS (SELECT a.r, a.i, b.i - a.i AS q FROM word a JOIN word b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
        island AS (SELECT r, q, min(i) AS s, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS z FROM same) GROUP BY r, q, z HAVING count(*) >= greatest(6 - q, 3 * q)),
        run AS (SELECT r, s, n + q AS l, min(q) AS q FROM (SELECT *, n + q AS e FROM island) GROUP BY r, s, l),
        listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS runs,
                          first(struct_pack(s := s, l := l, q := q) ORDER BY l DESC, s, q) AS best FROM run GROUP BY r),
        gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM run),
        kept AS (SELECT word.r, string_agg(x, ' ' ORDER BY word.i) AS kept FROM word LEFT JOIN gone ON word.r = gone.r AND word.i = gone.i WHERE gone.r IS NULL GROUP BY word.r)
        SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
               CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM t LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
    """


def prefix_trie() -> str:
    return rf"""
        WITH {_crc32('conversations', 'conv_id')},
        c AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, list(x ORDER BY turn NULLS FIRST, x) AS x, list(chars ORDER BY turn NULLS FIRST, x) AS chars FROM c GROUP BY conv_id),
        b AS (SELECT o.conv_id, h % 6 AS h, o.x, o.chars, coalesce(base.x, []) AS bx, coalesce(base.chars, []) AS bc FROM own o JOIN hashed ON o.conv_id = id LEFT JOIN own base ON base.conv_id = o.conv_id - o.conv_id % 100),
        m AS (SELECT conv_id, list_concat(bx[: h], x[h + 1 :]) AS x, list_concat(bc[: h], chars[h + 1 :]) AS chars FROM b),
        pre AS (SELECT conv_id, d, x[: d] AS p, CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS last, d = len(x) AS over FROM (SELECT *, unnest(range(len(x) + 1)) AS d FROM m)),
        node AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n, any_value(last) AS last, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (over), '')) AS ends FROM pre GROUP BY d, p),
        child AS (SELECT d - 1 AS d, p[: d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
        full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child ON node.d = child.d AND node.p = child.p),
        below AS (SELECT e, p[: e] AS p, sum((n - 1) * last) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS e FROM full_node) GROUP BY 1, 2)
        SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(f.n AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
               CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
        FROM full_node f JOIN below b ON b.e = f.d AND b.p = f.p LEFT JOIN node u ON f.d > 0 AND u.d = f.d - 1 AND u.p = f.p[: f.d - 1]
    """


SQL = {
    "op2_quality_rules": quality_rules(),
    "op4_jaccard_join": JACCARD,
    "op9_license_scans": license_scan(),
    "op10_exact_topk": TOP_K,
    "op11_substring_dedup": repeats(),
    "op12_periodic_runs": periodic_runs(),
    "op13_prefix_trie": prefix_trie(),
}
