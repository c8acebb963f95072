"""DuckDB SQL that the queries must equal, for the operators that SQL can express."""

from __future__ import annotations

from attesta.llm import licenses

#: Every query vector's products with all others, whole numbers throughout.
TOP_K = """
WITH usable AS (
    SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), paired AS (
    SELECT q.uid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM usable q JOIN usable c ON q.uid <> c.uid
    WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS "rank" FROM paired
)
SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 10
"""

#: Sources fill up in the order of cap * size / weight; the first that does not tells the level of all that do not.
#: Within a source the mix takes documents by hash until the budget runs out.
MIXING = r"""
WITH docs AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '#' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS h
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM docs GROUP BY source
), steps AS (
    SELECT *, 3.0::DOUBLE * source_size AS most, 3.0::DOUBLE * source_size / weight AS place,
        (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER (filling ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (filling ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM sources WINDOW filling AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST)
), level AS (
    SELECT coalesce(min_by(level, place) FILTER (WHERE most > level * weight), 0) AS level FROM steps
), plan AS (
    SELECT source, source_size, least(most, level.level * weight) AS target,
        CASE WHEN source_size = 0 THEN 0 ELSE least(3, floor(target / source_size))::BIGINT END AS base,
        CASE WHEN base >= 3 THEN 0.0 ELSE greatest(0.0, target - base * source_size) END AS want
    FROM steps, level
), runs AS (
    SELECT source, h, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM docs GROUP BY source, h
), edges AS (
    SELECT r.source, min(r.h) AS h, min_by(r.size, r.h) AS size, min_by(r.upto, r.h) AS upto
    FROM runs r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source WHERE r.upto > p.want GROUP BY r.source
), limits AS (
    SELECT p.*, CASE WHEN base >= 3 THEN 0 WHEN e.h IS NULL THEN CASE WHEN want > 0 THEN 1::BIGINT << 60 ELSE 0 END
        WHEN (want - (e.upto - e.size)) * 2 >= e.size THEN e.h + 1 ELSE e.h END AS threshold
    FROM plan p LEFT JOIN edges e ON p.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, d.source, (base + CASE WHEN h < threshold THEN 1 ELSE 0 END)::INTEGER AS copies, size * copies AS taken
FROM docs d JOIN limits l ON d.source IS NOT DISTINCT FROM l.source
"""

#: All pairs of different texts that share an n-gram, and what they reach.
JACCARD = r"""
WITH RECURSIVE texts AS (
    SELECT min(doc_id) AS rep, count(*) AS copies, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, text
    FROM documents WHERE regexp_matches(text, '[^\x20\x09-\x0D]') GROUP BY text
), grams AS (
    SELECT rep, unnest(list_distinct(list_transform(range(1, greatest(1, len(words) - 4) + 1), lambda i: array_to_string(words[i:i + 4], ' ')))) AS gram FROM texts
), sizes AS (
    SELECT rep, count(*) AS n FROM grams GROUP BY rep
), pairs AS (
    SELECT a.rep AS a, b.rep AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.rep < b.rep GROUP BY a.rep, b.rep
), links AS (
    SELECT a, b FROM pairs p JOIN sizes x ON p.a = x.rep JOIN sizes y ON p.b = y.rep WHERE 9 * p.n >= 4 * (x.n + y.n)
), near AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
    SELECT a, b FROM near UNION SELECT r.a, l.b FROM reach r JOIN near l ON r.b = l.a
), classes AS (
    SELECT rep, least(rep, coalesce((SELECT min(b) FROM reach WHERE a = rep), rep)) AS class_id,
        copies - 1 + coalesce((SELECT sum(t.copies) FROM near JOIN texts t ON near.b = t.rep WHERE near.a = texts.rep), 0) AS links, copies, text
    FROM texts
)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(links, 0)::BIGINT AS links, coalesce(copies, 1)::BIGINT AS copies
FROM documents d LEFT JOIN classes c ON d.text = c.text
"""

#: SHA-1 in base32, five bits a letter; the page with the least id of equal ones is the response.
WARC = r"""
WITH hashed AS (
    SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), digests AS (
    SELECT *, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(hex, 5 * i + 1, 5))::BIGINT >> (15 - 5 * j)) % 32 + 1, 1)), '')), '') AS digest,
        min(page_id) OVER (PARTITION BY html) AS first
    FROM hashed
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to, array_to_string(list_transform(string_split(url, ''), lambda c: CASE WHEN regexp_matches(c, '[\x00-\x20\x7f]') THEN printf('%%%02X', unicode(c)) ELSE c END), '') AS target_uri
FROM digests
"""



def crc_table() -> list[int]:
    """CRC-32 of each byte, by its polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def hilbert_steps(bits: int) -> str:
    """Skilling's transform of x0, x1, x2 as one subquery for each bit and dimension, then the Gray code and its turn."""
    sql = "SELECT * FROM cells"
    other = {0: ("x1", "x2"), 1: ("x2",), 2: ("x1",)}
    for b in range(bits - 1, 0, -1):
        for i in range(3):
            low = (1 << b) - 1
            swap = f"(CASE WHEN x{i} >> {b} & 1 = 1 THEN 0 ELSE xor(x0, x{i}) & {low} END)"
            first = f"xor(x0, CASE WHEN x{i} >> {b} & 1 = 1 THEN {low} ELSE {swap} END)"
            mine = "" if i == 0 else f", xor(x{i}, {swap}) AS x{i}"
            kept = ", ".join(other[i])
            sql = f"SELECT doc_id, {first} AS x0{mine}, {kept} FROM ({sql})"
    sql = f"SELECT doc_id, x0, xor(x0, x1) AS x1, xor(xor(x0, x1), x2) AS x2 FROM ({sql})"
    turn = "0"
    for b in range(bits - 1, 0, -1):
        turn = f"xor({turn}, CASE WHEN x2 >> {b} & 1 = 1 THEN {(1 << b) - 1} ELSE 0 END)"
    sql = f"SELECT doc_id, xor(x0, {turn}) AS x0, xor(x1, {turn}) AS x1, xor(x2, {turn}) AS x2 FROM ({sql})"
    places = " + ".join(f"((x{i} >> {b} & 1) << {3 * b + 2 - i})" for b in range(bits) for i in range(3))
    return f"SELECT doc_id, ({places})::BIGINT AS curve FROM ({sql})"


#: CRC-32 byte by byte, cells from ranks and lengths, and runs of the curve that differ by one row at most.
SHARDING = f"""
WITH docs AS (
    SELECT doc_id, lang, source, md5(coalesce(text, '')) AS same, strlen(coalesce(text, ''))::BIGINT + 16 AS size, strlen(coalesce(text, ''))::BIGINT + 1 AS x, length(bin(strlen(coalesce(text, ''))::BIGINT + 1)) - 1 AS e,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::BIGINT) AS bytes
    FROM documents
), sized AS (
    SELECT *, e * 16 + (x * 16 >> e) - 16 AS scale, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor({crc_table()}[xor(c, b) % 256 + 1], c >> 8)), 4294967295::BIGINT) AS crc FROM docs
), named AS (
    SELECT doc_id, same, ((dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1) << 10) // (SELECT count(*) FROM (SELECT DISTINCT lang FROM docs)) AS x0,
        ((dense_rank() OVER (ORDER BY source NULLS FIRST) - 1) << 10) // (SELECT count(*) FROM (SELECT DISTINCT source FROM docs)) AS x1,
        ((scale - min(scale) OVER ())::BIGINT << 10) // (max(scale) OVER () - min(scale) OVER () + 1) AS x2
    FROM sized
), cells AS (
    SELECT doc_id, min(x0) OVER (PARTITION BY same) AS x0, min(x1) OVER (PARTITION BY same) AS x1, x2 FROM named
), curves AS ({hilbert_steps(10)}), ranked AS (
    SELECT *, row_number() OVER (ORDER BY curve, crc, same, doc_id) - 1 AS place, count(*) OVER () AS n FROM sized JOIN curves USING (doc_id)
)
SELECT doc_id, size, crc::BIGINT AS text_crc32, 'rows' AS law, (place * 40 // n)::INTEGER AS shard, (place - ((place * 40 // n) * n + 39) // 40)::BIGINT AS slot,
    NULL::INTEGER AS grown_shard, lang, source, curve
FROM ranked
"""



def url_models() -> str:
    """Witten-Bell probabilities of n-grams of 1 to 4 characters in both classes, and the escapes of their contexts."""
    out = []
    for n in range(1, 5):
        short = "1.0::DOUBLE / 32" if n == 1 else "s.p{}"
        joined = f"seen w JOIN contexts c ON w.n = c.n AND w.h = c.h{'' if n == 1 else f' JOIN p{n - 1} s ON substring(w.g, 2, {n - 1}) = s.g'} WHERE w.n = {n}"
        mixed = [f"CASE WHEN c.{x}_all > 0 THEN (w.{x} + c.{x}_kinds * ({short.format(x)})) / (c.{x}_all + c.{x}_kinds) ELSE {short.format(x)} END AS p{x}" for x in "ab"]
        out.append(f"p{n} AS (SELECT w.g, {', '.join(mixed)} FROM {joined})")
        e = [f"CASE WHEN {x}_all > 0 THEN ln({x}_kinds / ({x}_all + {x}_kinds)) ELSE 0.0::DOUBLE END" for x in "ab"]
        out.append(f"e{n} AS (SELECT h, {e[0]} - {e[1]} AS e FROM contexts WHERE n = {n})")
    return ", ".join(out)


def url_best() -> str:
    best = "0.0::DOUBLE"
    for n in range(1, 5):
        best = f"coalesce(ln(p{n}.pa) - ln(p{n}.pb), {best} + coalesce(e{n}.e, 0.0::DOUBLE))"
    return best


def gram(n: int) -> str:
    return f"substring(t, greatest(1, x - {n - 1}), least(x, {n}))"


#: Rules, character models of the URLs that rules decide, and the threshold with the least balanced error on those held out.
URL_FILTER = rf"""
WITH parsed AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
        nullif('^' || regexp_replace(regexp_replace(lower(regexp_replace(url, '(?s)^.*?://', '')), '[0-9]', '0', 'g'), '[^abcdefghijklmnopqrstuvwxyz./0-]', '_', 'g') || '$', '^$') AS t
    FROM pages
), ruled AS (
    SELECT *, CASE WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/' WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/' END AS rule,
        rule IN ('www.example.com/en/', 'com/') AS good
    FROM parsed
), known AS (
    SELECT DISTINCT t, good, ('0x' || substr(md5(t), 1, 8))::BIGINT % 5 = 0 AS held FROM ruled WHERE rule IS NOT NULL
), long AS (
    SELECT good, n, substring(t, greatest(1, x - n + 1), least(x, n)) AS g FROM (SELECT t, good, unnest(range(2, length(t) + 1)) AS x FROM known WHERE NOT held), (SELECT unnest([1, 2, 3, 4]) AS n)
), seen AS (
    SELECT n, g, substring(g, 1, n - 1) AS h, (count(*) FILTER (WHERE good))::DOUBLE AS a, (count(*) FILTER (WHERE NOT good))::DOUBLE AS b FROM long WHERE length(g) = n GROUP BY n, g
), contexts AS (
    SELECT n, h, sum(a) AS a_all, sum(b) AS b_all, (count(*) FILTER (WHERE a > 0))::DOUBLE AS a_kinds, (count(*) FILTER (WHERE b > 0))::DOUBLE AS b_kinds FROM seen GROUP BY n, h
), {url_models()}, asked AS (
    SELECT t, unnest(range(2, length(t) + 1)) AS x FROM (SELECT t FROM known WHERE held UNION SELECT t FROM ruled WHERE rule IS NULL AND t IS NOT NULL)
), scores AS (
    SELECT t, sum({url_best()}) / count(*) AS ratio
    FROM asked {' '.join(f"LEFT JOIN p{n} ON p{n}.g = {gram(n)} LEFT JOIN e{n} ON length({gram(n)}) = {n} AND e{n}.h = substring({gram(n)}, 1, {n - 1})" for n in range(1, 5))}
    GROUP BY t
), bins AS (
    SELECT least(399, greatest(0, floor((ratio + 4.0::DOUBLE) / 8.0::DOUBLE * 400)))::BIGINT AS bin, (count(*) FILTER (WHERE good))::DOUBLE AS a, (count(*) FILTER (WHERE NOT good))::DOUBLE AS r
    FROM known JOIN scores USING (t) WHERE held GROUP BY 1
), sums AS (
    SELECT *, sum(a) OVER () AS good, sum(r) OVER () AS bad, sum(a) OVER (ORDER BY bin) AS lost, sum(r) OVER () - sum(r) OVER (ORDER BY bin) AS kept, lead(bin) OVER (ORDER BY bin) AS after, row_number() OVER (ORDER BY bin) AS i FROM bins
), edges AS (
    SELECT 1.0::DOUBLE AS error, bin::DOUBLE AS edge FROM sums WHERE i = 1
    UNION ALL SELECT lost / good + kept / bad, CASE WHEN after IS NULL THEN bin + 1.0::DOUBLE ELSE (bin + 1 + after) / 2.0::DOUBLE END FROM sums
), level AS (
    SELECT coalesce((SELECT CASE WHEN (SELECT min(least(good, bad)) FROM sums) > 0 THEN edge / 400 * 2 * 4.0::DOUBLE - 4.0::DOUBLE END FROM edges ORDER BY error, abs(edge - 200), edge LIMIT 1), 0.0::DOUBLE) AS level
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE WHEN good THEN 'allow' ELSE 'block' END WHEN r.t IS NOT NULL AND ratio >= level THEN 'allow' ELSE 'block' END AS verdict,
    CASE WHEN rule IS NULL THEN round(coalesce(ratio, 0.0::DOUBLE), 6) END AS ratio
FROM ruled r LEFT JOIN scores s ON r.t = s.t AND r.rule IS NULL, level
"""


def sql_rows(rows: list[tuple]) -> str:
    quoted = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(quoted, r))})" for r in rows)


def words_sql(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


#: All blocks against all templates by the word pairs they share, and phrases place by place.
LICENSES = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS uid, doc_id, {words_sql('text')} AS w FROM documents
), phrases AS (
    SELECT label, {words_sql('phrase')} AS p FROM (VALUES {sql_rows(list(licenses.PHRASES))}) AS t(label, phrase)
), templates AS (
    SELECT template, label, family, {words_sql('text')} AS p FROM (VALUES {sql_rows([(i, *t) for i, t in enumerate(licenses.TEMPLATES)])}) AS t(template, label, family, text)
), tokens AS (
    SELECT DISTINCT template, label, family, unnest(list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1])) AS token FROM templates
), needs AS (
    SELECT template, count(*) AS m, ceil(count(*) * {licenses.SHARE} / 100.0) AS need, (SELECT max(len(p)) FROM templates) AS stride FROM tokens GROUP BY template
), places AS (
    SELECT uid, label, unnest(range(1, len(w) - len(p) + 2)) AS i, w, p FROM docs, phrases WHERE len(w) >= len(p)
), base AS (
    SELECT uid, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels, list(DISTINCT label) AS labels
    FROM places WHERE w[i:i + len(p) - 1] = p GROUP BY uid
), pairs AS (
    SELECT uid, i - 1 AS place, w[i] || ' ' || w[i + 1] AS token FROM (SELECT uid, w, unnest(range(1, len(w))) AS i FROM docs)
), met AS (
    SELECT p.uid, p.place, t.template, t.label, t.family, t.token, n.m, n.need, n.stride FROM pairs p JOIN tokens t USING (token) JOIN needs n USING (template)
), spread AS (
    SELECT *, place // stride AS block FROM met UNION ALL SELECT *, place // stride - 1 AS block FROM met WHERE place >= stride AND place % stride < stride - 1
), found AS (
    SELECT uid, block, template, label, family, count(DISTINCT token) / max(m)::DOUBLE AS share FROM spread GROUP BY uid, block, template, label, family HAVING count(DISTINCT token) >= max(need)
), best AS (
    SELECT * FROM (SELECT *, max(share) OVER (PARTITION BY uid, block, family) AS most FROM found) WHERE share = most
), method AS (
    SELECT uid, list(DISTINCT label) AS labels, max(share) AS share FROM best GROUP BY uid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM docs LEFT JOIN base b USING (uid) LEFT JOIN method m USING (uid)
"""

#: Every phrase of up to five words, counted; whole numbers of 128 bits.
COLLOCATIONS = r"""
WITH pieces AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), grams AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k
), counts AS (
    SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase
), totals AS (
    SELECT lang, sum(f)::HUGEINT AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS (
    SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 100
), cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, j, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
    FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ')
    JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ') JOIN totals t ON t.lang = c.lang
), worst AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM cuts) WHERE place = 1
), absorbed AS (
    SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN candidates x ON x.lang = c.lang AND x.k > c.k AND 100 * x.f >= 100 * c.f AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' ')
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst ANTI JOIN absorbed USING (lang, phrase)
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": MIXING, "op2_ngram_jaccard": JACCARD, "op5_warc": WARC, "op6_sharding": SHARDING, "op7_url_filter": URL_FILTER, "op9_top_k": TOP_K,
    "op12_licenses": LICENSES, "op13_collocations": COLLOCATIONS,
}
