"""DuckDB SQL for the queries of this package that SQL expresses."""

from __future__ import annotations

from triplake.llm import mixing, phrases, quality, vectors

_WORD = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_UNSPACED = "[" + "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in quality.UNSPACED) + "]"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, {_WORD})) AS word, generate_subscripts(regexp_extract_all(text, {_WORD}), 1) AS i FROM d),
counts AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars, count(DISTINCT word) AS n_distinct_words FROM w GROUP BY r),
win AS (SELECT r, i, word || ' ' || string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS g, count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS k FROM w),
dup AS (SELECT r, i, k = 8 AND count(*) OVER (PARTITION BY r, g, k) > 1 AS twice FROM win),
cover AS (SELECT r, max(CASE WHEN twice THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM dup),
covered AS (SELECT r, sum(c) AS n_repeat_words FROM cover GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
ln AS (SELECT r, row_number() OVER (PARTITION BY r, line ORDER BY i) AS k FROM l WHERE regexp_matches(line, {_WORD})),
lines AS (SELECT r, count(*) AS n_lines, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS n_dup_lines FROM ln GROUP BY r),
m AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, (length(text) - length(translate(text, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
 coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_distinct_words, 0)::BIGINT AS n_distinct_words, len(regexp_extract_all(text, '{_UNSPACED}'))::BIGINT AS n_unspaced
 FROM d LEFT JOIN counts USING (r) LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)),
b AS (SELECT *, ({" + ".join(f"CASE WHEN {test} THEN {quality.bit(rule)} ELSE 0 END" for rule, test in quality.RULES.items())})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {quality.mask("base-1")} <> 0 AS base_failed, fail_bits & {quality.mask("full-1")} = 0 AS kept, fail_bits FROM b"""

_ROWS = " UNION ALL ".join(
    f"SELECT '{policy}' AS policy, '{rule}' AS rule, count(*) FILTER (fail_bits & {quality.bit(rule)} <> 0) AS n_failed, count(*) FILTER (fail_bits & {quality.mask(policy)} = {quality.bit(rule)}) AS n_failed_alone,"
    f" count(*) FILTER (fail_bits & {quality.mask(policy) - quality.bit(rule)} = 0) AS n_kept_without FROM q"
    for policy, rules in quality.POLICIES.items() for rule in rules
)
ABLATION = f"WITH q AS ({QUALITY}) {_ROWS}"

MIX = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD}))::BIGINT AS size, coalesce(text, '') AS text FROM documents),
k AS (SELECT doc_id, source, size, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(1 << 48)}) /
 CASE WHEN length(text) > 0 THEN greatest(0.05::DOUBLE, 1 - (4 * (length(text) - length(translate(text, '{mixing.NOISE}', ''))))::DOUBLE / length(text)) ELSE 0.05::DOUBLE END AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM k GROUP BY source),
w AS (SELECT *, list_extract([5.0, 2.0, 1.0]::DOUBLE[], (rank % 3 + 1)::INT) AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, cap / weight AS ratio, coalesce(sum(cap) OVER before, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open, sum(source_size) OVER ()::DOUBLE AS total
 FROM w WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rate AS (SELECT (total - capped) / open AS rate FROM o WHERE (total - capped) / open <= ratio ORDER BY ratio, rank LIMIT 1),
t AS (SELECT w.*, least(cap, weight * rate) AS target FROM w, rate),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
r AS (SELECT *, round(target - epochs * source_size)::BIGINT AS rest FROM e),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM k)
SELECT p.doc_id, p.size, r.source_size, r.target, (r.epochs * p.size + greatest(0, least(p.size, r.rest - p.before)))::BIGINT AS taken FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source"""

DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
sh AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN [w[1]] ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM d),
cls AS (SELECT s, min(doc_id) AS id, len(s) AS n FROM sh WHERE len(s) > 0 GROUP BY s),
x AS (SELECT id, n, unnest(s) AS g FROM cls),
p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * shared >= 80 * (na + nb - shared)),
both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS id, a AS r FROM both_ UNION SELECT reach.id, both_.b FROM reach JOIN both_ ON reach.r = both_.a),
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
of_ AS (SELECT cls.s, coalesce(component_id, cls.id) AS component_id FROM cls LEFT JOIN comp USING (id))
SELECT sh.doc_id, len(sh.s)::BIGINT AS n_shingles, coalesce(of_.component_id, sh.doc_id) AS component_id, sh.doc_id = coalesce(of_.component_id, sh.doc_id) AS kept FROM sh LEFT JOIN of_ ON sh.s = of_.s"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
q AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, (i * 5 + 1)::INT, 5))::BIGINT) AS v FROM h),
b AS (SELECT *, list_aggregate(list_transform(v, lambda x: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s::INT) & 31)::INT + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest, max(page_id) OVER (PARTITION BY hex) AS keeper FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM b"""



def _vector_codes() -> str:
    """Full searches over all entries, round by round."""
    near = "min(struct_pack(d := (list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.c) + list_dot_product(c.c, c.c))::BIGINT, e := c.e))"
    steps = [
        f"k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({vectors.SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, p, v[(p * len(v) // {vectors.PARTS} + 1):((p + 1) * len(v) // {vectors.PARTS})] AS x FROM k, (SELECT unnest(range({vectors.PARTS})) AS p))",
        f"c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY e < {vectors.ENTRIES})",
    ]
    for t in range(vectors.ROUNDS + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT vec_id, label, p, any_value(p.x) AS x, {near} AS m FROM p JOIN c{t} c USING (p) GROUP BY vec_id, label, p)")
        if t < vectors.ROUNDS:
            each = f"SELECT p, m.e AS e, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM a{t}"
            means = f"SELECT p, e, i, sum(x::HUGEINT) AS s, count(*) AS n FROM ({each}) GROUP BY p, e, i"
            lists = f"SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS c FROM ({means}) GROUP BY p, e"
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.c, c.c) AS c FROM c{t} c LEFT JOIN ({lists}) m ON c.p = m.p AND c.e = m.e)")
    last = vectors.ROUNDS
    steps += [
        f"r AS (SELECT vec_id, label, string_agg(lower(lpad(to_hex(m.e), 2, '0')), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{last} GROUP BY vec_id, label)",
        f"b AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM c{last}))",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT h FROM b) AS codebooks_sha256 FROM r"


PHRASES = rf"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, {_LOWER} AS text FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT d, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
g AS (SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {phrases.LEAST}),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
parts AS (SELECT cuts.*, x.f AS l, y.f AS r, 1000000 * a * a // (x.f * y.f) AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cut + 1:cuts.k], ' ')),
lowest AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
most AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN most USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM kept JOIN n USING (lang)
QUALIFY rank <= {phrases.TOP}"""

ORACLES = {"op4_minhash_duplicates": DUPLICATES, "op5_warc_bundles": WARC, "op6_source_mix": MIX, "op7_quality_ledger": QUALITY, "quality_ablation": ABLATION, "op11_ball_codes": _vector_codes(), "op13_phrase_automata": PHRASES}
