"""SQL that checks the registered queries where SQL can express them."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
PLAIN = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def near_copies(size: int) -> str:
    """Groups of documents by shingles of ``size`` words; of all words if there are fewer."""
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, {SPACED.format(LOWER)} AS w FROM documents),
sets AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= {size}
    THEN list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' '))
    ELSE [array_to_string(w, ' ')] END)) AS shingle
  FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y USING (shingle)
  WHERE x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * shared.n >= 80 * (p.n + q.n - shared.n)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, CASE WHEN l.a = r.other THEN l.b ELSE l.a END
  FROM reach r JOIN links l ON l.a = r.other OR l.b = r.other)
SELECT doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""


DECONTAMINATE = f"""
WITH items AS (
  SELECT item_id, w, least(len(w), 13) AS n FROM (SELECT item_id, {PLAIN.format(LOWER)} AS w FROM benchmark) WHERE len(w) > 0),
grams AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
words AS (SELECT doc_id, {PLAIN.format(LOWER)} AS w FROM documents),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM words, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, n, i FROM places JOIN grams USING (n, gram)),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

def _pass(k: int) -> str:
    """Documents of a source by rank, while those that fit fill what is left."""
    return f"""pass{k} AS (
  SELECT * EXCLUDE (fits, upto, now) REPLACE (more OR now AS more,
    room - sum(CASE WHEN now THEN size ELSE 0 END) OVER (PARTITION BY source) AS room)
  FROM (SELECT *, fits AND upto <= room AS now FROM (
    SELECT *, sum(CASE WHEN fits THEN size END) OVER (PARTITION BY source ORDER BY place, doc_id
      RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM (SELECT *, NOT more AND size <= room AS fits FROM pass{k - 1}))))"""


MIX = f"""
WITH sized AS (
  SELECT doc_id, source, len({SPACED.format("coalesce(text, '')")}) AS size,
    (('0x' || substr(md5(concat_ws(chr(1), coalesce(doc_id::VARCHAR, chr(2)), md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5::DOUBLE)
      / 4503599627370496.0::DOUBLE AS u,
    CASE WHEN length(coalesce(text, '')) > 0
      THEN 0.25::DOUBLE + length(regexp_replace(text, '[#*$%&|<>!{{}}\\[\\]\\\\^~]', '', 'g'))::DOUBLE / length(text)::DOUBLE
      ELSE 0.25 END AS w
  FROM documents),
ranked AS (SELECT *, 1 - exp(ln(u) / w) AS place FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM ranked GROUP BY source),
stops AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS whole, sum(weight) OVER () AS weights FROM sources),
levels AS (
  SELECT *, cap / weight AS ratio,
    (whole - coalesce(sum(cap) OVER w, 0)) / (weights - coalesce(sum(weight) OVER w, 0)) AS level
  FROM stops WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size, coalesce(least(cap, weight * (
    SELECT level FROM levels WHERE ratio > level ORDER BY ratio, source NULLS LAST LIMIT 1)), cap) AS target FROM levels),
goal AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM goals),
pass0 AS (
  SELECT r.doc_id, r.source, r.place, r.size, g.source_size, g.target, g.epochs, target - epochs * source_size AS room, false AS more
  FROM ranked r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source),
{', '.join(_pass(k) for k in range(1, 6))}
SELECT doc_id, size, source_size, target, (size * (epochs + more::INT))::BIGINT AS taken
FROM pass5
"""

HOST_RULES = f"""
WITH parts AS (
  SELECT doc_id, source, coalesce(text, '') AS t, {SPACED.format("coalesce(text, '')")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS three
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM parts)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS n FROM windows),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM twice WHERE n > 1) GROUP BY doc_id),
measured AS (
  SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words
  FROM parts LEFT JOIN repeated r USING (doc_id)),
failing AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 50 * n_words AS bad
  FROM measured),
hosts AS (SELECT source, count(*)::DOUBLE AS n, sum(bad::INT)::DOUBLE AS failed FROM failing GROUP BY source),
prior AS (
  SELECT sum(n) AS total, sum(failed) / sum(n) AS mean, count(*) AS hosts,
    sum(failed * failed / n) AS squares, sum(n * n) AS nn FROM hosts),
between_hosts AS (
  SELECT *, CASE WHEN total - nn / total > 0
    THEN (squares - total * mean * mean - (hosts - 1) * mean * (1 - mean)) / (total - nn / total) ELSE 0 END AS between_ FROM prior),
strength AS (
  SELECT mean, least(greatest(CASE WHEN between_ > 0 THEN mean * (1 - mean) / between_ - 1 ELSE total / hosts END, 1), total / hosts) AS s
  FROM between_hosts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (failed + mean * s) / (n + s) <= 0.5 AS kept
FROM failing f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source, strength
"""

#: Phrases and their counts straight from the pieces.
PHRASES = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
one AS (SELECT lang, g, count(*) AS f FROM (SELECT lang, unnest(w) AS g FROM words) GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*) AS f
  FROM (SELECT lang, w[i] AS w1, w[i + 1] AS w2 FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM words)) GROUP BY ALL),
three AS (SELECT lang, w1, w2, w3, count(*) AS f
  FROM (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM words))
  GROUP BY ALL),
longer AS (
  SELECT lang, w1, w2, max(f) AS f
  FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) WHERE f >= 10 GROUP BY ALL),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM two t LEFT JOIN longer USING (lang, w1, w2) JOIN one x ON x.lang = t.lang AND x.g = w1 JOIN one y ON y.lang = t.lang AND y.g = w2
  WHERE t.f >= 10 AND (longer.f IS NULL OR 100 * longer.f < 50 * t.f)
  UNION ALL
  SELECT t.lang, concat_ws(' ', t.w1, t.w2, t.w3), t.f, 1, x.f, y.f
  FROM three t JOIN one x ON x.lang = t.lang AND x.g = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  WHERE t.f >= 10
  UNION ALL
  SELECT t.lang, concat_ws(' ', t.w1, t.w2, t.w3), t.f, 2, x.f, y.f
  FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.g = t.w3
  WHERE t.f >= 10),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

#: crc32 of a number's digits, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),
  lambda c: ascii(c)::BIGINT)), lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0],
  lambda z, y: xor(z >> 1, 3988292384 * (z & 1)))))"""

#: Pairs of equal windows of six words one period apart, in a row.
RUNS = f"""
WITH hashed AS (
  SELECT doc_id, {SPACED.format("coalesce(text, '')")} AS w, {CRC32} AS h FROM documents),
places AS (
  SELECT *, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, CASE WHEN len(w) > 0
    THEN 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) END AS p FROM hashed),
texts AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0
    THEN list_transform(range(0, len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[1 + a + (i - a) % p] END) ELSE w END AS w
  FROM places),
positions AS (SELECT doc_id, i, w[i + 1] AS word FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM texts)),
windows AS (
  SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 5)) AS i FROM texts WHERE len(w) >= 12)),
equal AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM windows x JOIN windows y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i),
stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS origin FROM equal) GROUP BY doc_id, q, origin),
runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(12, 2 * q) GROUP BY ALL),
digests AS (
  SELECT doc_id, count(*) AS n_runs,
    string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM positions ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM texts t LEFT JOIN digests USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: All products.
VECTORS = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""

ORACLE = {
    "op1_near_copies": near_copies(2),
    "op4_decontaminate": DECONTAMINATE,
    "op6_mix_sources": MIX,
    "op8_host_rules": HOST_RULES,
    "op11_phrases": PHRASES,
    "op12_periodic_runs": RUNS,
    "op13_vector_search": VECTORS,
}
