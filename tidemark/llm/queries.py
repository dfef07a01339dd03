"""One query per operator over a folder of tables, and SQL where it can express one."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tidemark.llm import conversation_repair, embedding_dedup, exact_topk, language_id, mixing, ngram_join, packing, ranked_search, substrings, token_files, toxicity, url_filters, warc
from tidemark.sources.scratch import scratch_path

QUERIES: dict = {}
ORACLES: dict = {}
MAX_TOKENS = 2048
#: fixed values: the contract's mixing weights and repeat limit
WEIGHTS, CAP = (5, 2, 1), 3.0


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@functools.cache
def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_best_fit_packing")
def op1(spark, folder):
    """Every document's pieces of at most 2048 tokens with their place in a sequence."""
    pieces = packing.token_pieces(table(spark, folder, "documents"), tokenizer_path(), MAX_TOKENS)
    return packing.pack(pieces, MAX_TOKENS)


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk FROM s),
w AS (
  SELECT *, CASE rk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS cap FROM n),
f AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT arg_min(level, (ratio, rk)) AS water FROM f WHERE level < ratio),
t AS (
  SELECT source, source_size, CASE WHEN water IS NULL OR ratio <= water THEN cap ELSE weight * water END AS target FROM f CROSS JOIN l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
    CASE WHEN t.source_size > 0 THEN CAST(floor(floor(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(epochs * size + least(greatest(CAST(floor(target) AS BIGINT) - epochs * source_size - ahead, 0), size) AS BIGINT) AS taken
FROM p
"""


@query("op7_mix_to_weights", OP7_SQL)
def op7(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents"), WEIGHTS, CAP)
    return mixed.selectExpr("doc_id", "_size AS size", "_source_size AS source_size", "_target AS target", "_taken AS taken")


@query("op9_token_orc")
def op9(spark, folder):
    path = scratch_path(spark, "token-orc")
    token_files.write_token_files(table(spark, folder, "documents"), tokenizer_path(), path)
    return token_files.token_digests(token_files.read_token_files(spark, path))


#: fixed values: the contract's rules
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]

OP6_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
o AS (
  SELECT p.host, CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1 WHEN l.quality IS NULL OR l.toxic IS NULL THEN NULL ELSE 0 END AS bad
  FROM p JOIN labels l ON l.doc_id = p.page_id),
h AS (
  SELECT host, regexp_extract(regexp_replace(host, ':[0-9]*$', ''), '[^.]*\.?[^.]*$') AS domain,
         regexp_extract(regexp_replace(host, ':[0-9]*$', ''), '[^.]*$') AS suffix,
         CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad FROM o WHERE bad IS NOT NULL GROUP BY ALL),
g AS (SELECT sum(bad) / sum(n) AS overall FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(overall) AS prior FROM h CROSS JOIN g GROUP BY suffix),
s1 AS (SELECT sum(n * pow(bad / n - prior, 2) / (prior * (1 - prior))) AS q, count(*) AS g, sum(n) AS n FROM s0 WHERE prior > 0 AND prior < 1),
s2 AS (SELECT CASE WHEN g = 0 OR n <= g THEN 999.0 ELSE 1 / least(greatest((q - g) / (n - g), 0.001), 0.5) - 1 END AS k FROM s1),
s3 AS (SELECT suffix, (bad + k * prior) / (n + k) AS prior FROM s0 CROSS JOIN s2),
d0 AS (SELECT domain, sum(n) AS n, sum(bad) AS bad, any_value(prior) AS prior FROM h JOIN s3 USING (suffix) GROUP BY domain),
d1 AS (SELECT sum(n * pow(bad / n - prior, 2) / (prior * (1 - prior))) AS q, count(*) AS g, sum(n) AS n FROM d0 WHERE prior > 0 AND prior < 1),
d2 AS (SELECT CASE WHEN g = 0 OR n <= g THEN 999.0 ELSE 1 / least(greatest((q - g) / (n - g), 0.001), 0.5) - 1 END AS k FROM d1),
d3 AS (SELECT domain, (bad + k * prior) / (n + k) AS prior FROM d0 CROSS JOIN d2),
h0 AS (SELECT host, n, bad, prior FROM h JOIN d3 USING (domain)),
h1 AS (SELECT sum(n * pow(bad / n - prior, 2) / (prior * (1 - prior))) AS q, count(*) AS g, sum(n) AS n FROM h0 WHERE prior > 0 AND prior < 1),
h2 AS (SELECT CASE WHEN g = 0 OR n <= g THEN 999.0 ELSE 1 / least(greatest((q - g) / (n - g), 0.001), 0.5) - 1 END AS k FROM h1),
h3 AS (SELECT host, (bad + k * prior) / (n + k) AS m, n + k AS ab FROM h0 CROSS JOIN h2),
b AS (SELECT host FROM h3 CROSS JOIN g WHERE m - 1.645 * sqrt(m * (1 - m) / (ab + 1)) > overall),
r AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN b.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN b ON r.host = b.host
"""


@query("op6_url_reputation", OP6_SQL)
def op6(spark, folder):
    """A page is bad if the label of its id says low quality or toxic."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    labels = table(spark, folder, "labels").selectExpr(
        "doc_id", "case when quality = 0 or toxic = 1 then 1 when quality is null or toxic is null then null else 0 end as bad")
    outcomes = pages.join(labels, pages.page_id == labels.doc_id).select("url", "bad")
    return url_filters.judge(pages, outcomes, RULES).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(list_sum(list_transform(list_zip(q.v, e.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op8_exact_topk", OP8_SQL)
def op8(spark, folder):
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    rows = table(spark, folder, "embeddings").select(
        "vec_id", F.when(exact_topk.usable(F.col("embedding")), whole).alias("v"))
    return exact_topk.top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


#: all links; the query finds a pair with a chance of 0.98 at least
OP10_SQL = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM e),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND a.size > 0 AND b.size > 0
  WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / a.size / b.size >= 0.95),
r(vec_id, node) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.node),
c AS (SELECT vec_id, min(node) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c
"""


@query("op10_embedding_near_dedup", OP10_SQL)
def op10(spark, folder):
    return embedding_dedup.links_and_components(table(spark, folder, "embeddings"), threshold=0.95)


OP2_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
t AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS low FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> low THEN low END AS refers_to
FROM t
"""


@query("op2_warc", OP2_SQL)
def op2(spark, folder):
    return warc.archive(table(spark, folder, "pages"), scratch_path(spark, "warc")).drop("url")


@query("op4_toxicity")
def op4(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, table(spark, folder, "labels"))
    return scored.select("doc_id", F.col("_held_out").alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM d, unnest(range(1, len(w) - 48)) u(i)),
firsts AS (SELECT k, min(doc_id) AS low FROM windows GROUP BY k),
gone AS (SELECT DISTINCT r, p FROM windows JOIN firsts USING (k), unnest(range(i, i + 50)) u(p) WHERE low < doc_id),
places AS (SELECT r, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) u(p)),
left_over AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM places ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (r)
"""


@query("op3_substring_dedup", OP3_SQL)
def op3(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substrings.without_repeats(docs).select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
x AS (SELECT doc_id, len(s) AS n, md5(unnest(s)) AS k FROM s),
h AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL
  HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.node),
c AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN c USING (doc_id)
"""


@query("op5_ngram_jaccard_join", OP5_SQL)
def op5(spark, folder):
    return ngram_join.similar_groups(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


OP13_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt,
    list_transform(string_split(conv_id::VARCHAR || ':' || turn::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS bytes FROM conversations),
keyed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 20 AS k FROM raw),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(txt, '.!?', '') ELSE txt END AS txt
  FROM keyed, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) WHERE k != 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(txt)) AS i,
    regexp_extract(txt, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM damaged),
judged AS (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY i) > 1 THEN 'duplicate'
      WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS initial,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
moves(q, r, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
initials(initial) AS (VALUES ('s'), ('u'), ('a'), ('-')),
ways AS (
  SELECT q, initial, 'K' AS letter, 0 AS price, q2 FROM moves JOIN initials ON r = initial
  UNION ALL SELECT q, initial, 'R', 1, q2 FROM moves JOIN initials ON r != initial WHERE r != 's'
  UNION ALL SELECT q, initial, 'D', 2, q FROM (VALUES (0), (1), (2), (3)) s(q), initials),
more(q, n, q2) AS (VALUES (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (0, 1, 2), (0, 2, 3), (1, 1, 2), (1, 2, 3), (2, 1, 3), (3, 1, 2)),
walk(conv_id, i, q, best) AS (
  SELECT conv_id, 0::BIGINT, more.q2, min(printf('%09d', 5 * n) || repeat('I', n)) FROM (SELECT DISTINCT conv_id FROM judged), more WHERE more.q = 0 GROUP BY ALL
  UNION ALL
  SELECT w.conv_id, j.i, more.q2,
    min(printf('%09d', left(w.best, 9)::INT + e.price + CASE WHEN j.fault = 'truncated' AND letter != 'D' THEN 5 ELSE 0 END + 5 * n)
        || substr(w.best, 10) || letter || repeat('I', n))
  FROM walk w JOIN judged j ON j.conv_id = w.conv_id AND j.i = w.i + 1 JOIN ways e ON e.q = w.q AND e.initial = j.initial
    JOIN more ON more.q = e.q2
  WHERE letter = 'D' OR j.fault NOT IN ('blank', 'duplicate') GROUP BY ALL),
totals AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
cheapest AS (
  SELECT t.*, left(min(best), 9)::BIGINT AS cost, substr(min(best), 10) AS audit FROM totals t JOIN walk w ON w.conv_id = t.conv_id AND w.i = t.n AND q IN (0, 3) GROUP BY ALL),
letters AS (
  SELECT conv_id, p, audit[p] AS letter, length(replace(left(audit, p), 'I', '')) AS i FROM cheapest, unnest(range(1, length(audit) + 1)) u(p)),
out AS (
  SELECT l.*, j.role, j.txt, row_number() OVER w AS m, first_value(letter = 'K' AND j.initial = 's') OVER w AS sys
  FROM letters l LEFT JOIN judged j ON j.conv_id = l.conv_id AND j.i = l.i WHERE letter != 'D' WINDOW w AS (PARTITION BY l.conv_id ORDER BY p)),
lines AS (
  SELECT conv_id, p, CASE WHEN letter = 'K' THEN role WHEN (m - sys::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
    || CASE WHEN letter = 'I' THEN '' ELSE txt END AS line FROM out),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS repaired FROM lines GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN cheapest USING (conv_id) LEFT JOIN texts USING (conv_id)
"""


@query("op13_conversation_repair", OP13_SQL)
def op13(spark, folder):
    return conversation_repair.repair_reports(table(spark, folder, "conversations"))


@query("op12_language_id")
def op12(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs).select("doc_id", F.col("_held_out").alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
sums AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS length FROM d WHERE len(terms) > 0),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, sums GROUP BY term),
s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), sums GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""


@query("op11_ranked_search", OP11_SQL)
def op11(spark, folder):
    return ranked_search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
