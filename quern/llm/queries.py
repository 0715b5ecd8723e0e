"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chat, decontaminate, jaccard, lines, mixing, passages, quality, sharding, topk, urls
from quern.llm.common import table

_DUCK_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {_DUCK_WORDS} AS w FROM documents),
gram AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM doc, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS t(i) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM gram a JOIN gram b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN size p ON x = p.doc_id JOIN size q ON y = q.doc_id WHERE 10 * c >= 8 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, link.y FROM reach r JOIN link ON r.y = link.x)
SELECT d.doc_id, c.class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links
FROM documents d JOIN (SELECT x, min(y) AS class_id FROM reach GROUP BY x) c ON c.x = d.doc_id
LEFT JOIN (SELECT x, count(*) AS n FROM link GROUP BY x) l ON l.x = d.doc_id
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "lang", F.round("perplexity", 4).alias("perplexity"), F.round("limit", 4).alias("limit"), "accepted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", "n_runs_removed", F.md5("text").alias("text_md5"))


OP3_SQL = """
WITH doc AS (SELECT DISTINCT doc_id, text FROM documents WHERE contains(text, chr(10))),
line AS (SELECT doc_id, text, i, l[i] AS s FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM doc), unnest(range(1, len(l) + 1)) AS t(i)),
roll AS (SELECT *, CASE WHEN i > 1 AND (substr(md5(s), 1, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7', '8', '9', 'a', 'b')
                OR i > 2 AND substr(md5(md5(lag(s, 2) OVER w) || md5(lag(s) OVER w)), 1, 1) IN ('0', '1', '2', '3')) THEN 1 ELSE 0 END AS starts
         FROM line WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, text ORDER BY i) AS c FROM roll),
chunk AS (SELECT doc_id, text, c, min(i) AS pos, count(*) AS n, string_agg(s, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, text, c),
often AS (SELECT * FROM chunk SEMI JOIN (SELECT body FROM chunk GROUP BY body HAVING count(*) > 1) USING (body)),
passage AS (SELECT doc_id, text, pos, n, body AS one, NULL AS two FROM often WHERE n > 1
            UNION ALL SELECT a.doc_id, a.text, a.pos, a.n + b.n, a.body, b.body FROM often a JOIN often b
            ON a.doc_id = b.doc_id AND a.text = b.text AND b.c = a.c + 1 WHERE a.n = 1 OR b.n = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY one, two ORDER BY doc_id, pos) AS nth, count(*) OVER (PARTITION BY one, two) AS times FROM passage),
covered AS (SELECT doc_id, text, bool_or(nth = 1) AS stays, t.i FROM ranked, unnest(range(pos, pos + n)) AS t(i) WHERE times > 1 GROUP BY ALL),
gone AS (SELECT doc_id, text, i, CASE WHEN lag(i) OVER (PARTITION BY doc_id, text ORDER BY i) = i - 1 THEN 0 ELSE 1 END AS fresh FROM covered WHERE NOT stays),
per AS (SELECT doc_id, text, count(*) AS n_removed, sum(fresh) AS n_runs FROM gone GROUP BY ALL),
kept AS (SELECT doc_id, text, string_agg(s, chr(10) ORDER BY i) AS rest FROM numbered ANTI JOIN gone USING (doc_id, text, i) GROUP BY doc_id, text)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs_removed,
       md5(CASE WHEN n_removed IS NULL THEN d.text ELSE coalesce(rest, '') END) AS text_md5
FROM documents d LEFT JOIN per USING (doc_id, text) LEFT JOIN kept USING (doc_id, text)
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP4_SQL = f"""
WITH item AS (SELECT item_id, {_DUCK_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
        FROM item, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_DUCK_WORDS} AS w FROM documents),
shape AS (SELECT DISTINCT n FROM win),
slid AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM doc, shape, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT r, i, n, g FROM slid SEMI JOIN (SELECT n AS n2, g AS g2 FROM win) ON n = n2 AND g = g2),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit JOIN win USING (n, g) WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "block", "slot", "place", "on_target")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(table(spark, sf_dir, "documents"), leaves=24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def _duck_url(url: str) -> str:
    rest = f"CASE WHEN position('://' IN {url}) > 0 THEN substr({url}, position('://' IN {url}) + 3) ELSE '' END"
    return f"""translate(regexp_extract({rest}, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
       regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract({rest}, '^[^?#]*\\?([^#]*)', 1) AS query"""


_DUCK_KEY = """CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') ||
       (SELECT CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END
        FROM (SELECT list_filter(string_split(query, '&'), lambda q: q <> '' AND NOT starts_with(q, 'utm_') AND NOT starts_with(q, 'ref=')) AS k)) END AS alias"""
_DUCK_RULE = """CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
       WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule"""

OP8_SQL = f"""
WITH RECURSIVE base AS (SELECT *, {_DUCK_RULE}, {_DUCK_KEY} FROM (SELECT page_id, html, {_duck_url("url")} FROM pages)),
raw AS (SELECT alias AS a, host, unnest([
          regexp_extract(regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0), '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1),
          regexp_extract(regexp_extract(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0), '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1)]) AS x
        FROM base WHERE alias IS NOT NULL),
target AS (SELECT a, CASE WHEN starts_with(x, '//') THEN 'http:' || x WHEN starts_with(x, '/') THEN 'http://' || host || x ELSE x END AS url FROM raw),
ends AS (SELECT *, {_DUCK_RULE}, {_DUCK_KEY} FROM (SELECT a, {_duck_url("url")} FROM target WHERE contains(url, '://'))),
edge AS (SELECT a, alias AS b FROM ends WHERE alias IS NOT NULL UNION SELECT alias, a FROM ends WHERE alias IS NOT NULL),
node AS (SELECT alias, rule FROM base WHERE alias IS NOT NULL UNION ALL SELECT alias, rule FROM ends WHERE alias IS NOT NULL),
reach AS (SELECT DISTINCT alias AS s, alias AS t FROM node UNION SELECT s, b FROM reach JOIN edge ON t = a),
said AS (SELECT s, bool_or(rule IN ('org/', 'com/fr/')) AS allowed, bool_or(rule IN ('example.org/es/', 'example.org/en/1', 'com/de/')) AS blocked
         FROM reach JOIN node ON t = alias GROUP BY s)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN blocked AND NOT coalesce(allowed, false) THEN 'block' ELSE 'allow' END AS verdict
FROM base LEFT JOIN said ON alias = s
"""

def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = chat.parse_transcripts(table(spark, sf_dir, "conversations"))
    first = F.get(F.col("parsed"), F.lit(0))["role"]
    return parsed.select("conv_id", "turn", "role", first.alias("found_role"), F.size("parsed").alias("n_turns"), F.sha2(chat.rendered(F.col("parsed")), 256).alias("rendered_sha256"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_top_k": op7_top_k,
    "op8_url_filter": op8_url_filter,
    "op9_chat_format": op9_chat_format,
    "op10_passages": op10_passages,
}
ORACLES = {"op1_jaccard_join": OP1_SQL, "op3_line_dedup": OP3_SQL, "op4_decontaminate": OP4_SQL, "op7_top_k": OP7_SQL, "op8_url_filter": OP8_SQL}
