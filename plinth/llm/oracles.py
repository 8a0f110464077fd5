"""DuckDB SQL of the queries that SQL can express."""

# Every window of one to four words within a piece is counted; HUGEINT keeps products exact.
OP13_PHRASES = r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words
           FROM (SELECT lang, unnest(regexp_split_to_array(body, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs)),
spots AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces WHERE len(words) > 0),
grams AS (SELECT lang, n, words[i:i + n - 1] AS gram FROM spots, (SELECT unnest([1, 2, 3, 4]) AS n) AS lengths WHERE i + n - 1 <= len(words)),
freq AS (SELECT lang, n, gram, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS total FROM freq WHERE n = 1 GROUP BY lang),
cand AS (SELECT lang, n, gram, f AS a FROM freq WHERE n > 1 AND f >= 30),
cuts AS (SELECT lang, n, gram, a, unnest(range(1, n)) AS k FROM cand),
scored AS (SELECT c.lang, c.gram, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
           FROM cuts c JOIN freq x ON x.lang = c.lang AND x.gram = c.gram[1:c.k]
                       JOIN freq y ON y.lang = c.lang AND y.gram = c.gram[c.k + 1:c.n]),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1),
inner_spans AS (SELECT lang, a, gram, n, unnest([2, 3]) AS m FROM cand WHERE n > 2),
inner_parts AS (SELECT lang, a, gram[s:s + m - 1] AS part
                FROM (SELECT lang, a, gram, m, unnest(range(1, n - m + 2)) AS s FROM inner_spans WHERE m < n)),
longer AS (SELECT lang, part, max(a) AS longest FROM inner_parts GROUP BY ALL),
kept AS (SELECT w.* FROM worst w LEFT JOIN longer x ON x.lang = w.lang AND x.part = w.gram
         WHERE x.longest IS NULL OR 100 * x.longest < 80 * w.a),
ranked AS (SELECT *, array_to_string(gram, ' ') AS phrase,
                  row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(gram, ' ')) AS place FROM kept)
SELECT lang, place::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, total::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE place <= 2000
"""

# Equal payloads belong to the smallest page; five hash bytes give eight base-32 digits.
OP3_WARC = r"""
WITH pages_ AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
hashed AS (SELECT page_id, strlen(body) AS size, sha1(body) AS hex FROM pages_),
coded AS (SELECT page_id, size, array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + (((('0x' || substr(hex, 1 + 10 * (j // 8), 10))::BIGINT >> (35 - 5 * (j % 8))) & 31))::INTEGER, 1)), '') AS digest FROM hashed)
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = min(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> min(page_id) OVER same THEN min(page_id) OVER same END AS refers_to
FROM coded WINDOW same AS (PARTITION BY digest)
"""

# A bucket is the shortest hash prefix whose texts keep within the limit; texts beyond it do not occur in the tables.
OP4_SHARDS = r"""
WITH hashed AS (SELECT doc_id, strlen(coalesce(text, '')) AS size, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS code FROM documents),
prefixes AS (SELECT doc_id, size, d, code >> (60 - d)::INTEGER AS prefix FROM hashed, range(0, 61) AS depths(d)),
sized AS (SELECT *, sum(size) OVER (PARTITION BY d, prefix) AS total FROM prefixes),
found AS (SELECT * FROM sized WHERE total <= 1048576 OR d = 60 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d) = 1)
SELECT doc_id, size::BIGINT AS text_bytes, CASE WHEN d = 0 THEN '*' ELSE lpad(bin(prefix), d::INTEGER, '0') END AS shard,
       d::INTEGER AS depth, 0::BIGINT AS page, total::BIGINT AS shard_bytes FROM found
"""

# A line of ten code points or more stays in the smallest document that holds it.
OP5_LINE_DEDUP = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
spots AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS place FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM spots),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (owner < doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (owner IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN owners USING (key) GROUP BY doc_id
"""

ORACLES: dict[str, str] = {"op3_warc": OP3_WARC, "op4_extendible_shards": OP4_SHARDS, "op5_line_dedup": OP5_LINE_DEDUP, "op13_phrases": OP13_PHRASES}
