"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

_COMPONENTS = """
    reach(a, b) AS (
        SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
    ), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""

OP1 = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) <= 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
meet AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
pairs AS (
    SELECT a, b FROM meet JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= 75 * (p.n + q.n - shared)
), links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), {_COMPONENTS}
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id
"""

def _op2() -> str:
    """Lines of the record's head end in carriage return and line feed."""
    end = "' || chr(13) || chr(10) || '"
    head = f"'WARC/1.0{end}WARC-Type: resource{end}WARC-Record-ID: <urn:weft:' || page_id || '>{end}WARC-Date: 2024-01-01T00:00:00Z{end}WARC-Target-URI: ' || coalesce(url, '') || '{end}Content-Type: text/html{end}Content-Length: '"
    return f"""
WITH records AS (
    SELECT page_id, page_id // 1000 AS file,
        octet_length(encode({head} || octet_length(encode(coalesce(html, ''))) || '{end}{end}' || coalesce(html, '') || '{end}{end}'))::BIGINT AS length
    FROM pages
), placed AS (SELECT *, (sum(length) OVER (PARTITION BY file ORDER BY page_id) - length)::BIGINT AS "offset" FROM records)
SELECT file, "offset", length, CASE WHEN page_id % 101 = 7 THEN 'missing' ELSE 'changed' END AS state, page_id
FROM placed WHERE page_id % 101 = 7 OR page_id % 97 = 13
"""


def _level(name: str, above: str | None, path: list[str], weight: str) -> str:
    """Budgets of the nodes with ``path``, as parts of those of the table ``above``."""
    own, up = ", ".join(path), path[:-1]
    part = ("PARTITION BY " + ", ".join(up)) if up else ""
    given = "a.budget" if above else "(SELECT sum(n_tokens) FROM sized)::HUGEINT"
    join = f"JOIN {above} a ON " + " AND ".join(f"a.{c} IS NOT DISTINCT FROM s.{c}" for c in up) if above else ""
    order = f"supply / weight, {', '.join(f'{c} NULLS FIRST' for c in path)}"
    return f"""
{name}_0 AS (
    SELECT {', '.join(f's.{c}' for c in path)}, s.supply, s.weight, {given} AS given
    FROM (SELECT {own}, (sum(n_tokens) * 4)::HUGEINT AS supply, {weight} AS weight FROM sized GROUP BY {own}) s {join}
), {name}_1 AS (
    SELECT *, coalesce(sum(supply) OVER ({part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS used,
        (sum(weight) OVER ({part} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS weights,
        row_number() OVER ({part} ORDER BY {order}) AS n
    FROM {name}_0
), {name}_2 AS (
    SELECT *, min(CASE WHEN supply * weights > greatest(given - used, 0) * weight THEN {{'n': n, 'rest': greatest(given - used, 0), 'weights': weights}} END) OVER ({part}) AS level FROM {name}_1
), {name} AS (
    SELECT {own}, CASE WHEN level IS NULL OR n < level.n THEN supply ELSE least(supply, weight * level.rest // level.weights) END::HUGEINT AS budget FROM {name}_2
)"""


def _op3() -> str:
    domain = "coalesce('d' || (try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 5), 'other')"
    by_domain = "CASE domain WHEN 'd0' THEN 30 WHEN 'd1' THEN 25 WHEN 'd2' THEN 20 WHEN 'd3' THEN 15 WHEN 'd4' THEN 10 ELSE 5 END"
    by_lang = "CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END"
    return rf"""
WITH sized AS (
    SELECT doc_id, {domain} AS domain, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents
), {_level('by_domain', None, ['domain'], by_domain)}, {_level('by_lang', 'by_domain', ['domain', 'lang'], by_lang)}, {_level('by_source', 'by_lang', ['domain', 'lang', 'source'], '1')},
plan AS (
    SELECT *, CASE WHEN tokens > 0 THEN (budget // tokens)::INT ELSE 0 END AS whole
    FROM by_source JOIN (SELECT domain AS d, lang AS l, source AS s, sum(n_tokens)::HUGEINT AS tokens FROM sized GROUP BY ALL) ON d = domain AND l IS NOT DISTINCT FROM lang AND s IS NOT DISTINCT FROM source
), ordered AS (
    SELECT z.*, whole, budget - whole * tokens AS rest,
        sum(n_tokens) OVER (PARTITION BY z.domain, z.lang, z.source ORDER BY ('0x' || substr(md5('1:' || whole || ':' || doc_id), 1, 15))::BIGINT, doc_id ROWS UNBOUNDED PRECEDING) AS upto
    FROM sized z JOIN plan p ON p.domain = z.domain AND p.lang IS NOT DISTINCT FROM z.lang AND p.source IS NOT DISTINCT FROM z.source
)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END))::INT AS epoch FROM ordered
"""


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP4 = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE {_FINITE}),
scored AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.r <> q.r
)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INT AS rank FROM scored) WHERE rank <= 20
"""

OP9 = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE label IS NOT NULL AND {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.93), {_COMPONENTS}
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(least.b, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(least.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id LEFT JOIN least ON least.a = e.vec_id
"""


def _crc_table() -> list[int]:
    """CRC-32 of each byte, by its polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def _crc32(digits: str) -> str:
    """The unsigned CRC-32 of the bytes whose hexadecimal digits are in the column ``digits``."""
    steps = f"list_transform(range(1, length({digits}), 2), lambda i: ('0x' || substr({digits}, i, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, b: xor(c >> 8, list_extract({_crc_table()}::BIGINT[], (xor(c, b) & 255) + 1))), 4294967295::BIGINT)"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '[a-z\x{{00C0}}-\x{{00FF}}]{{7,}}')) AS run FROM documents
), marked AS (
    SELECT run, times, {_crc32('digits')} AS h FROM (SELECT run, count(*) AS times, hex(encode(doc_id || ':' || run)) AS digits FROM runs GROUP BY doc_id, run)
), noisy AS (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM marked
), words AS (SELECT word, sum(times)::BIGINT AS n FROM noisy WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
less AS (SELECT DISTINCT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS gap, left(word, i - 1) || substr(word, i + 1) AS cut FROM words, unnest(range(1, length(word) + 1)) AS _(i)),
near AS (
    SELECT x.word, y.word AS other, y.n FROM less x JOIN less y ON x.gap = y.gap AND x.word <> y.word
    UNION SELECT x.word, y.word, y.n FROM less x JOIN words y ON x.cut = y.word
    UNION SELECT y.word, x.word, x.n FROM less x JOIN words y ON x.cut = y.word
), best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n FROM near GROUP BY word),
forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word
), follow(word, root, form) AS (
    SELECT word, word, form FROM forms UNION ALL SELECT f.word, f.form, g.form FROM follow f JOIN forms g ON g.word = f.form
)
SELECT f.word, f.form, follow.root, f.n, f.n_near, f.form_n FROM forms f JOIN follow ON follow.word = f.word AND follow.form IS NULL
"""

_WORDS = r"regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12 = f"""
WITH words AS (
    SELECT doc_id, 's' AS side, unnest({_WORDS}) AS word FROM documents UNION ALL SELECT item_id, 't', unnest({_WORDS}) FROM benchmark
), named AS (
    SELECT word, {_crc32('digits')} % 10000 AS bucket FROM (SELECT DISTINCT word, hex(encode(word)) AS digits FROM words)
), met AS (SELECT doc_id, side, bucket FROM words JOIN named USING (word)),
sums AS (SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM met GROUP BY bucket),
gains AS (
    SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM sums
), weights AS (
    SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS total FROM met JOIN gains USING (bucket) WHERE side = 's' GROUP BY doc_id
), weighed AS (
    SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce((total - (total % n_features + n_features) % n_features) // n_features, 0) AS weight,
        ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h
    FROM documents d LEFT JOIN weights w ON w.doc_id = d.doc_id
), scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank FROM scored s LEFT JOIN ranked r ON r.doc_id = s.doc_id
"""

OP13 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body ORDER BY length(text) DESC, doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1,
    "op2_merkle_fixity": _op2(),
    "op3_mixing_sources": _op3(),
    "op4_exact_topk": OP4,
    "op9_embedding_dedup": OP9,
    "op11_spelling_variants": OP11,
    "op12_target_resampling": OP12,
    "op13_exact_dedup": OP13,
}
