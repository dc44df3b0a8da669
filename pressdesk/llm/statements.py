"""SQL that states what a query returns, in terms of the rules and not of the method."""

from __future__ import annotations

from . import importance, rules

WORD = r"[^\x20\x09-\x0D]+"


def _bucket(measure: str, errors: int = 0) -> str:
    over, under, step = rules.MEASURES[measure]
    count, of = f"{over}::double", f"greatest({under}, 1)::double"
    if errors:
        if measure in rules.LOWER:
            error = f"{rules.ERRORS}::double * {over}::double / sqrt({of})"
        else:
            error = f"{rules.ERRORS}::double * sqrt({over}::double)"
        count = f"greatest({count} {'-' if errors < 0 else '+'} {error}, 0::double)"
    return f"floor(ln({count} / {of} / {step}::double + 1.0::double) / ln({rules.GAMMA}::double))::bigint"


def quality_rules() -> str:
    sides = [f"{side}_{m}" for m in rules.MEASURES for side in ("low", "high")]
    wide = ", ".join(
        f"max(CASE WHEN measure = '{m}' THEN {fence} END) AS {side}_{m}"
        for m in rules.MEASURES
        for fence, side in (
            (f"q1 - {rules.SPREADS} * (q2 - q1)", "low"), (f"q3 + {rules.SPREADS} * (q3 - q2)", "high")
        )
    )

    def level(name: str, by: str) -> str:
        key = f"{by}, " if by else ""
        part = f"PARTITION BY {key}measure"
        quantiles = ", ".join(
            f"min(CASE WHEN {rules.TAIL} * upto >= {share} * total THEN bucket END) AS {q}"
            for share, q in ((1, "q1"), (rules.TAIL // 2, "q2"), (rules.TAIL - 1, "q3"))
        )
        return f"""
        {name}_u AS (SELECT {key}measure, bucket, sum(n) AS n FROM sketch GROUP BY {key}measure, bucket),
        {name}_r AS (SELECT *, sum(n) OVER ({part} ORDER BY bucket) AS upto, sum(n) OVER ({part}) AS total
            FROM {name}_u),
        {name}_q AS (SELECT {key}measure, max(total) AS total, {quantiles} FROM {name}_r GROUP BY {key}measure),
        {name}_f AS (SELECT {key}max(total)::bigint AS total, {wide} FROM {name}_q {"GROUP BY " + by if by else ""})"""

    def shrunk(own: str, total: str, above: str) -> str:
        return f"(({total} * {own})::double + {rules.PRIOR}::double * {above}) / ({total} + {rules.PRIOR})::double"

    chosen = ", ".join(
        f"{shrunk(f'o.{c}', 'o.total', '(' + shrunk(f'l.{c}', 'l.total', f'a.{c}::double') + ')')} AS {c}" for c in sides
    )
    inside = " AND ".join(
        [f"coalesce({_bucket(m, -1)} <= high_{m}, true)" for m in rules.MEASURES]
        + [f"coalesce({_bucket(m, 1)} >= low_{m}, true)" for m in rules.LOWER]
    )
    measures = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS measure, {_bucket(m)} AS bucket FROM counted WHERE NOT base_failed"
        for m in rules.MEASURES
    )
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
            regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
    places AS (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
    runs AS (SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS run FROM places),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM runs) WHERE n > 1),
    covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS s(k) GROUP BY r),
    lined AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
    counted AS (SELECT *, n_words < {rules.MIN_WORDS}
            OR 100 * n_repeat_words > {rules.MAX_REPEATED} * n_words AS base_failed FROM (
        SELECT doc_id, lang, source, len(w)::bigint AS n_words,
            length(array_to_string(w, ''))::bigint AS word_chars,
            length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
            (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines,
            coalesce(n, 0)::bigint AS n_repeat_words, len(l)::bigint AS n_lines
        FROM d JOIN lined USING (r) LEFT JOIN covered USING (r))),
    sketch AS (SELECT lang, source, measure, bucket, count(*) AS n FROM ({measures})
        GROUP BY lang, source, measure, bucket),
    {level("o", "lang, source")}, {level("l", "lang")}, {level("a", "")},
    fences AS (SELECT o.lang AS f_lang, o.source AS f_source, {chosen} FROM o_f o
        JOIN l_f l ON o.lang IS NOT DISTINCT FROM l.lang, a_f a)
    SELECT doc_id, {", ".join(rules.COUNTS)}, base_failed, NOT base_failed AND {inside} AS kept
    FROM counted LEFT JOIN fences ON lang IS NOT DISTINCT FROM f_lang AND source IS NOT DISTINCT FROM f_source
    """


def url_filter(rule_list: list[tuple[str, str, str]]) -> str:
    rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rule_list)
    return rf"""
    WITH parts AS (SELECT page_id, url,
            coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
            regexp_replace(regexp_replace(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1),
                '(^|&)(utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&', '') AS q FROM pages),
    named AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '')
        || regexp_replace(path, '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS c FROM parts),
    listed AS (SELECT c FROM named WHERE c IS NOT NULL GROUP BY c HAVING count(DISTINCT url) > 1),
    rules(v, h, p) AS (VALUES {rows}),
    ruled AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
        FROM named JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id)
    SELECT page_id, host, path, rule, coalesce(v, CASE WHEN l.c IS NULL THEN 'allow' ELSE 'block' END) AS verdict
    FROM named LEFT JOIN ruled USING (page_id) LEFT JOIN listed l ON named.c = l.c
    """


def warc_fixity(per_file: int) -> str:
    def record(html: str) -> str:
        return (
            "'WARC/1.0' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' "
            f"|| nl || 'WARC-Target-URI: ' || url || nl || 'Content-Type: text/html' || nl || 'Content-Length: ' "
            f"|| strlen({html}) || nl || nl || {html} || nl || nl"
        )

    return f"""
    WITH p AS (SELECT page_id, url, html, chr(13) || chr(10) AS nl, page_id // {per_file} AS file_no FROM pages),
    r AS (SELECT page_id, file_no, html, {record("html")} AS record,
        page_id % 97 = 13 AND strlen(html) > 0 AND html NOT LIKE '#%' AS changed,
        file_no % 5 = 2 AND page_id % {per_file} >= {per_file} - 100 AS missing FROM p),
    o AS (SELECT *, strlen(record)::bigint AS length, coalesce(sum(strlen(record)) OVER
        (PARTITION BY file_no ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start
        FROM r)
    SELECT page_id, file_no, start, length, CASE WHEN missing THEN 'missing' ELSE 'changed' END AS status,
        sha256(record) AS digest FROM o WHERE missing OR changed
    """


def near_duplicates() -> str:
    """Two-word shingles, similarity of at least 0.8, components by repeated smallest label."""
    return rf"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE
            list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s
            AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * c >= 80 * (x.n + y.n - c)),
    edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reached(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a)
    SELECT doc_id, coalesce(n, 0)::bigint AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
        doc_id <= coalesce(m, doc_id) AS kept
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reached GROUP BY a) USING (doc_id)
    """


def importance_resampling() -> str:
    """Counts of all features by bucket; crc32 byte by byte, by a table made from its polynomial."""
    buckets, share, seed, least = importance.BUCKETS, importance.SHARE, importance.SEED, importance.LEAST_WORDS
    return rf"""
    WITH crc AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k:
            CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) s(i)),
    d AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents
        UNION ALL SELECT 'b', row_number() OVER (), item_id, text FROM benchmark),
    w AS (SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
    f AS MATERIALIZED (SELECT side, r, f, count(*) AS n FROM (SELECT side, r, unnest(w) AS f FROM w UNION ALL
        SELECT side, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w) GROUP BY ALL),
    h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
    b AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(0, len(h) // 2),
            lambda i: ('0x' || substr(h, (2 * i + 1)::bigint, 2))::bigint),
            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % {buckets} AS b FROM h, crc),
    c AS (SELECT b, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM f JOIN b USING (f) GROUP BY b),
    a AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM c),
    g AS (SELECT b, floor(1000 * ln(((coalesce(c.t, 0) + 1)::double * (a.s + {buckets})::double)
            / ((coalesce(c.s, 0) + 1)::double * (a.t + {buckets})::double)))::bigint AS g FROM c, a),
    m AS (SELECT r, sum(n) AS n, floor(sum(n * g)::double / sum(n)::double)::bigint AS weight
        FROM f JOIN b USING (f) JOIN g USING (b) WHERE side = 'd' GROUP BY r),
    e AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::bigint AS n_features, coalesce(weight, 0)::bigint AS weight,
            ('0x' || left(sha256('{seed}:' || coalesce(doc_id::varchar, '')), 8))::bigint AS h
        FROM w LEFT JOIN m USING (r) WHERE side = 'd'),
    o AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint AS score,
        n_words >= {least} AS may FROM e),
    k AS (SELECT *, row_number() OVER (ORDER BY may DESC, score DESC, doc_id) AS place FROM o)
    SELECT doc_id, n_features, weight, score,
        CASE WHEN place <= {share} * (SELECT count(*) FROM o WHERE may) // 100 THEN place END::bigint AS rank,
        n_words::bigint AS n_words
    FROM k
    """
