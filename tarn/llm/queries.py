"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import ann, conversation, exact_dedup, html_extract, lm_scoring, near_dedup, packing, quality, sentencepiece, simhash, spelling, token_files, url_filter
from tarn.llm.common import own_folder

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_BPE_IDS = 50257
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut(spark.read.parquet(f"{sf_dir}/documents.parquet"), BYTE_BPE, capacity=2048, end_id=1)
    placed = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=2048)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = """
WITH d AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
"""

#: host, path, verdict, is_rule. The rules, then the first of the list: sites whose pages are blocked where no rule fits.
URL_LIST = [
    ("com", "/en/", "block", True),
    ("example.com", "/en/7", "allow", True),
    ("net", "/de/", "allow", True),
    ("example.net", "/de/8", "block", True),
    ("org", "/es/", "block", True),
    ("spam-farm.example.org", "/", "block", False),
    ("cheap-pills.example.com", "/", "block", False),
]
#: The rest of the list, by rule: as many sites and pages as a real list might have.
LISTED_SITES, LISTED_PAGES = 60_000, 40_000


def url_list(spark: SparkSession) -> DataFrame:
    """The rules and the listed canonical URLs."""
    named = spark.createDataFrame(URL_LIST, "host string, path string, verdict string, is_rule boolean")
    sites = spark.range(LISTED_SITES).select(F.format_string("farm-%d.example.org", "id").alias("host"), F.lit("/").alias("path"))
    pages = spark.range(LISTED_PAGES).select(F.format_string("board-%d.example.com", F.col("id") % 5000).alias("host"), F.format_string("/offers/%d", "id").alias("path"))
    return named.unionByName(sites.unionByName(pages).withColumns({"verdict": F.lit("block"), "is_rule": F.lit(False)}))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_list(spark))


OP3_SQL = f"""
WITH listed(host, path, verdict, is_rule) AS (
    VALUES {", ".join(f"('{h}', '{p}', '{v}', {r})" for h, p, v, r in URL_LIST)}
    UNION ALL SELECT 'farm-' || range || '.example.org', '/', 'block', false FROM range({LISTED_SITES})
    UNION ALL SELECT 'board-' || (range % 5000) || '.example.com', '/offers/' || range, 'block', false FROM range({LISTED_PAGES})
),
cut AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), p AS (
    SELECT page_id, translate(coalesce(raw, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(path, '') AS path FROM parts
), best AS (
    SELECT p.page_id, arg_max(l.host || l.path, (l.is_rule, length(l.host || l.path), l.verdict)) AS entry,
        arg_max(l.is_rule, (l.is_rule, length(l.host || l.path), l.verdict)) AS is_rule, arg_max(l.verdict, (l.is_rule, length(l.host || l.path), l.verdict)) AS verdict
    FROM p JOIN listed l ON (p.host = l.host OR ends_with(p.host, '.' || l.host)) AND starts_with(p.path, l.path) GROUP BY p.page_id
)
SELECT p.page_id, p.host, p.path, CASE WHEN b.is_rule THEN b.entry END AS rule, coalesce(b.verdict, 'allow') AS verdict FROM p LEFT JOIN best b USING (page_id)
"""


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{own_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, BYTE_BPE, BYTE_BPE_IDS, end_id=2)
    read = token_files.read_documents(spark, out)
    return read.select(F.col("doc").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether decoding them gives its text back."""
    coded = sentencepiece.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), PIECES)
    decoded = sentencepiece.decode(coded, PIECES, carried=["doc_id", "text", "n_tokens", "ids"])
    return decoded.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(vectors.where("vec_id % 20 = 0"), vectors, k=20)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=4, percent=80)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    return lm_scoring.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), learn)


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=3)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with a twentieth each dropped, emptied, without ends of sentences, repeated, said by the user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = plain.where("k != 0").select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy"))
    return rows.drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation.reported(conversation.repair(damaged(turns)), turns)


#: crc32 of an ASCII string s in SQL: a table made by rule, then a step for each byte.
CRC_TABLE = """tb(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM tb WHERE k < 8),
ct AS (SELECT list(c ORDER BY i) AS t FROM tb WHERE k = 8)"""
CRC = "xor(list_reduce(list_concat([4294967295], {bytes}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"
OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
k AS (SELECT c.*, {CRC.format(bytes="list_transform(string_split(name, ''), lambda x: CAST(ord(x) AS BIGINT))")} % 20 AS k FROM c, ct),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE k != 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS plain FROM d),
f AS (SELECT *, CASE WHEN plain = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN plain[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY 1),
grammar(g, r, h) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(g, h, cost, label) AS (SELECT g, g, 0, '' FROM range(4) s(g) UNION ALL VALUES (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 3, 5, 'I'), (2, 2, 10, 'II'), (3, 2, 5, 'I'), (3, 3, 10, 'II')),
edit(g, h, cost, label, initial) AS (SELECT g, g, 2, 'D', NULL FROM range(4) s(g) UNION ALL SELECT g, h, 0, 'K', r FROM grammar UNION ALL SELECT g, h, 1, 'R', NULL FROM grammar WHERE r != 's'),
move AS (SELECT ins.g, edit.h, ins.cost + edit.cost AS cost, ins.label || edit.label AS label, edit.label AS e, initial FROM ins JOIN edit ON ins.h = edit.g),
walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS g, {{'c': CAST(0 AS BIGINT), 'l': CAST('' AS VARCHAR)}} AS w FROM counts
    UNION ALL SELECT walk.conv_id, walk.i + 1, m.h, min({{'c': walk.w.c + m.cost + CASE WHEN fault = 'truncated' AND e != 'D' THEN 5 ELSE 0 END, 'l': walk.w.l || m.label}})
    FROM walk JOIN f ON walk.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = walk.i + 1 JOIN move m ON m.g = walk.g AND (m.initial IS NULL OR m.initial = f.r) AND (e = 'D' OR fault NOT IN ('blank', 'duplicate')) GROUP BY 1, 2, 3),
best AS (SELECT walk.conv_id, min({{'c': walk.w.c + ins.cost, 'l': walk.w.l || ins.label}}) AS w FROM walk JOIN counts ON walk.conv_id IS NOT DISTINCT FROM counts.conv_id AND walk.i = n JOIN ins ON ins.g = walk.g AND ins.h IN (0, 3) GROUP BY 1),
letters AS (SELECT conv_id, unnest(string_split(w.l, '')) AS e, generate_subscripts(string_split(w.l, ''), 1) AS pos FROM best WHERE w.l != ''),
placed AS (SELECT *, count(*) FILTER (e != 'I') OVER b AS i, count(*) FILTER (e != 'D') OVER b AS p, count(*) FILTER (e != 'D') OVER (PARTITION BY conv_id) AS m FROM letters WINDOW b AS (PARTITION BY conv_id ORDER BY pos)),
lines AS (SELECT placed.conv_id, pos, CASE WHEN e = 'K' THEN role WHEN (p + m) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS line FROM placed LEFT JOIN f ON placed.conv_id IS NOT DISTINCT FROM f.conv_id AND placed.i = f.i WHERE e != 'D'),
said AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY pos) AS said FROM lines GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.w.c, 0) AS cost, coalesce(best.w.l, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts ON a.conv_id IS NOT DISTINCT FROM counts.conv_id LEFT JOIN best ON a.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN said ON a.conv_id IS NOT DISTINCT FROM said.conv_id
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), every=31))


_UTF8 = "flatten(list_transform(string_split({s}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(192 + (ord(x) >> 6) AS BIGINT), CAST(128 + (ord(x) & 63) AS BIGINT)] END))"
OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00c0-\u00ff]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents WHERE text IS NOT NULL),
own AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY 1, 2),
summed AS (SELECT run, n, {CRC.format(bytes=_UTF8.format(s="coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))} AS h FROM own, ct),
results AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM results WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
del AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, b.word AS other, b.n FROM del a JOIN del b ON a.d = b.d AND a.i = b.i AND a.word != b.word
    UNION SELECT del.word, w.word, w.n FROM del JOIN w ON d = w.word UNION SELECT w.word, del.word, del.n FROM del JOIN w ON d = w.word),
best AS (SELECT word, count(*) AS n_near, min({{'less': -n, 'other': other}}) AS top FROM near GROUP BY 1),
found AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.less >= 10 * n THEN top.other END AS form, CASE WHEN -top.less >= 10 * n THEN -top.less END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS k FROM found UNION ALL SELECT chain.word, found.form, k + 1 FROM chain JOIN found ON chain.root = found.word WHERE found.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM found JOIN (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY 1) USING (word)
"""


QUERIES = {
    "op1_packing": op1_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_html_extraction": op4_html_extraction,
    "op5_token_files": op5_token_files,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES = {"op2_exact_dedup": OP2_SQL, "op3_url_filter": OP3_SQL, "op12_conversation_repair": OP12_SQL, "op13_spelling_variants": OP13_SQL}
