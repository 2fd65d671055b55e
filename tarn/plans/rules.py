"""Queries on text rules: layers, kinds, value, completeness, tags, titles, entities, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import rules as U
from tarn.functions import text as T
from tarn.functions.entities import entities
from tarn.operators import dedup as D
from tarn.operators import mailbox as M
from tarn.plans.registry import query
from tarn.plans.searching import MEM
from tarn.sources.importing import format_of
from tarn.sources.tables import memories, table


@query("layer_infer", f"""WITH {MEM}, s AS (SELECT id, content, title || ' ' || content AS whole FROM mem WHERE content IS NOT NULL)
SELECT id, CASE WHEN regexp_matches(content, '职位|联系方式|电话|邮箱|偏好|风格|档案|基本信息|技术特长|工作风格|沟通建议|协作', 'i') THEN 'entity' WHEN regexp_matches(whole, 'person|entity|人物|人员|同事|客户|团队|负责人|工具|产品', 'i') THEN 'entity'
WHEN regexp_matches(whole, 'preference|rule|principle|decision|project|architecture|repo|framework|偏好|习惯|风格|原则|规则|决定|结论|取舍|架构|方法论|框架|理论|约束|边界|必须|禁止', 'i') THEN 'long' ELSE 'short' END AS layer FROM s""")
def layer_infer(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = memories(spark, sf_dir).where("content IS NOT NULL")
    return rows.select("id", U.memory_layer(F.col("title"), F.col("content"), none, none, F.lit(None).cast("double")).alias("layer"))


@query("layer_scored", f"""WITH {MEM}, s AS (SELECT id, content, (id % 100) / 100 AS total FROM mem WHERE content IS NOT NULL)
SELECT id, CASE WHEN regexp_matches(content, '职位|联系方式|电话|邮箱|偏好|风格|档案|基本信息|技术特长|工作风格|沟通建议|协作', 'i') THEN 'entity' WHEN (total < 0.5 AND regexp_matches(content, '灵感|想法|想到|如果|试试|也许|假设|猜想|突发奇想|灵光一闪')) OR total < 0.35 THEN 'flash'
WHEN regexp_matches(content, 'roadmap|sprint|milestone|release|launch', 'i') AND regexp_matches(content, '\\[\\[([^\\]]+)\\]\\]') AND total >= 0.6 THEN 'long' WHEN regexp_matches(content, 'checklist|playbook|howto|how-to', 'i') AND total >= 0.65 THEN 'long'
WHEN regexp_matches(content, 'task|todo', 'i') THEN 'short' WHEN total >= 0.75 THEN 'long' WHEN total >= 0.4 THEN 'short' ELSE 'flash' END AS layer FROM s""")
def layer_scored(spark, sf_dir):
    """With a self-check's total, here by rule from the id."""
    none = F.lit(None).cast("string")
    rows = memories(spark, sf_dir).where("content IS NOT NULL")
    return rows.select("id", U.memory_layer(F.col("title"), F.col("content"), none, none, F.col("id") % 100 / 100).alias("layer"))


@query("value_check", """WITH t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x FROM documents WHERE text IS NOT NULL), b AS (SELECT *, lower(regexp_replace(regexp_replace(x, '[\\s。！!？?~～.…]+$', ''), '^[\\s。！!？?~～.…]+', '')) AS bare,
CAST(regexp_matches(x, '\\d{2,}') AS INT) + CAST(regexp_matches(x, 'https?://\\S+') AS INT) + CAST(regexp_matches(x, '[\\p{L}\\p{N}_\\-]+[/\\\\][\\p{L}\\p{N}_\\-.]+') AS INT) + CAST(regexp_matches(x, '[a-z]+[A-Z][\\p{L}\\p{N}]*') AS INT)
+ CAST(regexp_matches(x, '\\[\\[[^\\]]+\\]\\]') AS INT) + CAST(regexp_matches(x, '#[\\p{L}\\p{N}_\\-]+') AS INT) + CAST(regexp_matches(x, '决定|选择|改为|采用|放弃|拒绝|修复|解决|失败|成功|原因是|结论|目标|进度|截止|验收|交付|偏好|喜欢|不想要|习惯|踩坑|教训|经验|因为|所以') AS INT) AS n FROM t),
r AS (SELECT doc_id, n, bare IN ('', 'ok', 'okay', 'k', 'thx', 'thanks', 'thank you', 'got it', 'noted', 'ok, thanks', 'ok thanks', 'sounds good') OR (length(x) <= 80 AND n = 0 AND regexp_matches(x, 'let me know if|feel free to|best regards', 'i')) AS bad FROM b)
SELECT doc_id, CASE WHEN bad THEN 'reject' ELSE 'accept' END AS verdict, round(CASE WHEN bad THEN 0 ELSE least(1, 0.3 + 0.2 * n) END::DOUBLE, 6) AS score FROM r""")
def value_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", U.value_of(F.col("text")).alias("v"))
    return docs.select("doc_id", "v.verdict", F.round("v.score", 6).alias("score"))


@query("completeness", """WITH t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN x = '' THEN 'mid-sentence-cut' ELSE array_to_string(list_filter([CASE WHEN regexp_matches(x, '[，、,：:]$') THEN 'dangling-connector' END,
CASE WHEN regexp_matches(x, '(?:以及|但是|因为|所以|的|和|等)$') OR lower(regexp_extract(x, '([A-Za-z]+)$', 1)) IN ('the','a','an','and','or','but','to','of','in','on','at','for','with','by','from','via','is','are','was','were','be','that','which','as','vs') THEN 'dangling-connector' END,
CASE WHEN len(regexp_extract_all(x, '```')) % 2 = 1 THEN 'mid-sentence-cut' END], lambda i: i IS NOT NULL), ',') END AS issues FROM t""")
def completeness(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.array_join(U.completeness_issues(F.col("text")), ",").alias("issues"))


@query("extracted_tags", """WITH t AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, list_concat(regexp_extract_all(text, '#([\\p{L}\\p{N}_\\-]+)', 1), regexp_extract_all(text, '@([\\p{L}\\p{N}_\\-]+)', 1), regexp_extract_all(text, '\\[\\[([^\\]]+)\\]\\]', 1),
list_filter([CASE WHEN regexp_matches(text, 'bug|fix', 'i') THEN '问题修复' END, CASE WHEN regexp_matches(text, 'todo|task', 'i') THEN '待办' END, CASE WHEN regexp_matches(text, 'idea', 'i') THEN '想法' END, CASE WHEN regexp_matches(text, 'note', 'i') THEN '笔记' END,
CASE WHEN regexp_matches(text, 'meeting|talk', 'i') THEN '会议' END, CASE WHEN regexp_matches(text, 'code', 'i') THEN '代码' END, CASE WHEN regexp_matches(text, 'design|ui|ux', 'i') THEN '设计' END, CASE WHEN regexp_matches(text, 'study|book', 'i') THEN '学习' END], lambda x: x IS NOT NULL)) AS raw FROM t),
c AS (SELECT doc_id, list_filter(list_transform(raw, lambda x: regexp_replace(regexp_replace(trim(x), '^["''“‘「『]+', ''), '["''”’」』]+$', '')), lambda x: length(x) BETWEEN 2 AND 30 AND NOT regexp_matches(x, '^(type|source|kind|scope|domain|project|sensitivity|layer|status):|^v?\\d{4}-\\d{2}-\\d{2}|[/\\\\~\\r\\n（(]|^\\p{N}+$', 'i') AND regexp_matches(x, '[\\p{L}\\p{N}]')) AS tags FROM m)
SELECT doc_id, array_to_string(list_filter(tags, lambda x, i: list_position(list_transform(tags, lambda y: lower(y)), lower(x)) = i)[1:8], '|') AS tags FROM c""")
def extracted_tags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.array_join(U.extracted_tags(F.col("text")), "|").alias("tags"))


@query("stripped_titles", "SELECT item_id, regexp_replace('Idea: [note] ' || text, '^\\s*idea\\s*[:：]\\s*\\[note\\]\\s*', '', 'i') AS title FROM benchmark WHERE text IS NOT NULL")
def stripped_titles(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", U.stripped_title(F.concat(F.lit("Idea: [note] "), "text")).alias("title"))


@query("extracted_titles")
def extracted_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", U.extracted_title(F.col("text")).alias("title"))


@query("plain_lengths", """SELECT doc_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '`([^`]+)`', '\\1', 'g'), '!\\[[^\\]]*\\]\\([^)]+\\)', ' ', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[#>*_\\-~]', ' ', 'g'), '\\s+', ' ', 'g'))) AS n
FROM documents WHERE text IS NOT NULL""")
def plain_lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", U.plain_length(F.col("text")).cast("long").alias("n"))


@query("summaries", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x != '')[1:3], chr(10)) AS summary FROM documents WHERE text IS NOT NULL")
def summaries(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", U.summary(F.col("text")).alias("summary"))


@query("subject_check", """SELECT item_id, CASE WHEN NOT length(trim(text)) BETWEEN 5 AND 120 THEN 'length' WHEN regexp_full_match(trim(text), '[\\w\\x{4e00}-\\x{9fff}-]{1,12}') THEN 'noun' ELSE 'ok' END AS verdict FROM benchmark WHERE text IS NOT NULL""")
def subject_check(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", U.useful_subject(F.col("text")).alias("verdict"))


@query("open_items", """WITH m AS (SELECT conv_id, turn, '[ ] ' || text AS body FROM conversations WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8),
l AS (SELECT conv_id, turn, generate_subscripts(string_split(body, chr(10)), 1) AS k, trim(unnest(string_split(body, chr(10)))) AS line FROM m),
i AS (SELECT conv_id, turn, k, regexp_replace(regexp_replace(line, '^[-*]\\s*', ''), '^\\[ \\]\\s+', '') AS item FROM l WHERE regexp_matches(regexp_replace(line, '^[-*]\\s*', ''), '^(?:下一步|仍需|还需要|待确认|尚未|需要处理|需要确认)[：:]?|^\\[ \\]\\s+')),
f AS (SELECT conv_id, item, min(turn * 1000000 + k) AS w FROM i GROUP BY 1, 2)
SELECT conv_id, array_to_string(list(item ORDER BY w), '|') AS items FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY w, item) <= 8) GROUP BY 1""")
def open_items(spark, sf_dir):
    """Each message's first line is marked as open here, as these tables have no marks."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.concat(F.lit("[ ] "), "text").alias("body"))
    return M.open_items(turns, thread="conv_id").select("conv_id", F.array_join("items", "|").alias("items"))


@query("error_signatures", """WITH t AS (SELECT event_id, '2024-01-02T03:04:05Z fail at 0x1F in /srv/app/x' || event_id || '.py:12:7 code ' || user_id AS e FROM events)
SELECT event_id, '<ts> fail at <addr> in x' || event_id || '.py code #' AS signature FROM t""")
def error_signatures(spark, sf_dir):
    """Of an error text made from each event: what varies is masked, the file's name stays."""
    error = F.format_string("2024-01-02T03:04:05Z fail at 0x1F in /srv/app/x%d.py:12:7 code %d", "event_id", "user_id")
    return table(spark, sf_dir, "events").select("event_id", T.error_signature(error).alias("signature"))


@query("canonical_props", "SELECT event_id, sha256('{\"a\":1,\"k\":' || json_extract_string(props, '$.k') || '}') AS hash FROM events WHERE json_valid(props)")
def canonical_props(spark, sf_dir):
    """The same hash, whatever the order of the keys: here k comes before a."""
    made = F.concat(F.regexp_replace("props", "\\}\\s*$", ""), F.lit(', "a": 1}'))
    return table(spark, sf_dir, "events").where(F.try_parse_json("props").isNotNull()).select("event_id", F.sha2(U.canonical_json(made), 256).alias("hash"))


@query("specific_projects", "SELECT DISTINCT source AS name, length(trim(regexp_replace(regexp_replace(lower(source), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g'))) >= 4 AS specific FROM documents WHERE source IS NOT NULL")
def specific_projects(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("source").alias("name"), U.specific_project(F.col("source")).alias("specific")).distinct()


@query("entities", """WITH t AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), f AS (
SELECT id, unnest(regexp_extract_all(text, '@([\\p{L}\\p{N}_]+)', 1)) AS name, 'person' AS type, 0.95 AS c FROM t UNION ALL SELECT id, unnest(regexp_extract_all(text, '#([\\p{L}\\p{N}_]+)', 1)), 'concept', 0.9 FROM t
UNION ALL SELECT id, unnest(regexp_extract_all(text, '(Meta|OpenAI|Google|Microsoft|Apple|Amazon|Tesla|Nvidia|Intel|Samsung)', 1)), 'organization', 0.95 FROM t UNION ALL SELECT id, unnest(regexp_extract_all(text, '(\\d{4}-\\d{2}-\\d{2})', 1)), 'time', 0.95 FROM t
UNION ALL SELECT id, unnest(regexp_extract_all(text, '(Q[1-4](?:\\s*\\d{4})?)', 1)), 'time', 0.85 FROM t
UNION ALL SELECT id, unnest(regexp_extract_all(text, '(React|Vue|Angular|Svelte|Next.js|Nuxt|Gatsby|Vite|Webpack|Tailwind|Sass|Less|Node.js|Python|JavaScript|TypeScript|Go|Rust|Java|Kotlin|Swift|C\\+\\+|C#|Ruby|PHP|Dart|Lua|R|Scala|Elixir|Haskell|PostgreSQL|MySQL|SQLite|MongoDB|Redis|Elasticsearch|Cassandra|CockroachDB|TiDB|ClickHouse|Docker|Kubernetes|Terraform|AWS|Azure|GCP|GitHub|GitLab|Jenkins|CircleCI|GraphQL|REST|gRPC|WebSocket|MQTT|Linux|macOS|Windows|iOS|Android|Nginx|Apache|Caddy|Git|SVN|Mercurial|Bun|Deno|pnpm|yarn|npm|Electron|Tauri|Flutter|React Native|Unity|Unreal|Claude|GPT|LLM|RAG|Fine-tuning|Embedding|Transformer|Supabase|Firebase|Prisma|Drizzle)', 1)), 'tool', 0.9 FROM t
UNION ALL SELECT id, lower(unnest(regexp_extract_all(text, '([\\w.+-]+@[\\w-]+\\.[\\w.-]+)', 1))), 'tool', 0.95 FROM t UNION ALL SELECT id, unnest(regexp_extract_all(text, 'https?://([^/:?#\\s@]+)', 1)), 'tool', 0.7 FROM t)
SELECT id, name, type, max(c)::DOUBLE AS confidence FROM f GROUP BY 1, 2, 3""")
def entity_mentions(spark, sf_dir):
    return entities(table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


@query("chunks")
def chunks(spark, sf_dir):
    """Every chunk of every long text; the reference keeps a text's first 20."""
    return D.with_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", most=None)


@query("formats", "SELECT page_id, CASE lower(regexp_extract(url, '\\.([^./\\\\]+)$', 1)) WHEN 'json' THEN 'json' WHEN 'jsonl' THEN 'jsonl' WHEN 'ndjson' THEN 'jsonl' WHEN 'md' THEN 'markdown' WHEN 'markdown' THEN 'markdown' ELSE 'text' END AS format FROM pages WHERE url IS NOT NULL")
def formats(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", format_of(F.col("url")).alias("format"))


@query("attachments", "SELECT conv_id, turn, len(regexp_extract_all(text, '(?s)```([\\w-]*)\\n?(.*?)```')) AS blocks, length(regexp_replace(regexp_replace(text, '(?s)```([\\w-]*)\\n?(.*?)```', chr(10) || '[attached]' || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS n FROM conversations WHERE text IS NOT NULL")
def attachments(spark, sf_dir):
    rows = M.attachments(table(spark, sf_dir, "conversations").where("text IS NOT NULL"), "text")
    return rows.select("conv_id", "turn", F.size("blocks").cast("long").alias("blocks"), F.length("clean").cast("long").alias("n"))
