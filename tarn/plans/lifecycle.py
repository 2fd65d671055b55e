"""Queries on text scalars, scoring, mailbox and the loop log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.operators import lifecycle as L
from tarn.operators import loops as P
from tarn.operators import relational as R
from tarn.plans.registry import query
from tarn.plans.searching import STATE
from tarn.sources.tables import memory_state, table

NOW = "2024-12-31"


def today():
    return F.lit(NOW).cast("date")


def _redact_sql(x: str) -> str:
    for pattern, to, flags in [
        ("-----BEGIN [A-Z ]*PRIVATE KEY-----[\\s\\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED]:private_key", "g"),
        ("\\bsk-[A-Za-z0-9_-]{20,}\\b", "[REDACTED]:api_key", "g"),
        ("\\bsk-ant-[A-Za-z0-9_-]{20,}\\b", "[REDACTED]:api_key", "g"),
        ("\\b(?:ghp|gho|ghu|ghs|ghr|github_pat)_[A-Za-z0-9_]{20,}\\b", "[REDACTED]:token", "g"),
        ("\\b(?:AKIA|ASIA)[A-Z0-9]{16}\\b", "[REDACTED]:aws_key", "g"),
        ("\\beyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\b", "[REDACTED]:jwt", "g"),
        ("(//[^:\\s/@]+:)([^@\\s/]+)(@)", "\\1[REDACTED]:password\\3", "g"),
        ("([A-Za-z0-9_.-]*(?:password|passwd|pwd|secret|credential|api[_-]?key|access[_-]?token|refresh[_-]?token|private[_-]?key)[A-Za-z0-9_.-]*)\\s*[:=]\\s*[\"''`]?([^\\s\"''`,;]+)[\"''`]?", "\\1=[REDACTED]", "gi"),
        ("\\b([A-Z0-9_]*(?:API_KEY|TOKEN|SECRET|PASSWORD|PRIVATE_KEY|CREDENTIAL)[A-Z0-9_]*)\\s*=\\s*([^\\s\"''`,;#]+)", "\\1=[REDACTED]", "g"),
    ]:
        x = f"regexp_replace({x}, '{pattern}', '{to}', '{flags}')"
    return x


@query("redact", f"WITH r AS (SELECT doc_id, text, {_redact_sql('text')} AS clean FROM documents) SELECT doc_id, md5(clean) AS redacted, text != clean AS changed FROM r")
def redact(spark, sf_dir):
    """The nine rules of secrets; the SQL states them by hand."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("clean"))
    return T.without_secrets(docs, "clean", "findings").select("doc_id", F.md5("clean").alias("redacted"), (F.col("text") != F.col("clean")).alias("changed"))


@query("redact_secrets")
def redact_secrets(spark, sf_dir):
    """The nine rules of redact, with the texts and their counts by type."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("redacted"))
    return T.without_secrets(docs, "redacted", "findings").withColumn("changed", F.size("findings") > 0)


@query("token_estimate", """SELECT doc_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda w: greatest(1, floor(length(w) / 4 + 0.5)))), 0)
+ coalesce(list_sum(list_transform(regexp_extract_all(text, '[0-9]+'), lambda w: greatest(1, ceil(length(w) / 2)))), 0)
+ ceil(length(regexp_replace(text, '[A-Za-z0-9\\s]', '', 'g')) / 2) AS BIGINT) AS tokens FROM documents""")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("kind_infer", """SELECT doc_id, CASE WHEN regexp_matches(text, '偏好|喜欢|不喜欢|习惯|风格|prefer|preference|habit|style', 'i') THEN 'preference' WHEN regexp_matches(text, '决定|结论|取舍|选择|因为|所以|decision|decided|conclusion|tradeoff', 'i') THEN 'decision'
WHEN regexp_matches(text, '待办|任务|计划|截止|完成|推进|todo|task|follow[- ]?up|deadline', 'i') THEN 'task' WHEN regexp_matches(text, '流程|步骤|命令|配置|脚本|workflow|procedure|command|setup|config', 'i') THEN 'procedure'
WHEN regexp_matches(text, '必须|不能|约束|规则|边界|禁止|must|cannot|rule|constraint|required', 'i') THEN 'constraint' WHEN regexp_matches(text, '关系|同事|客户|团队|负责人|partner|customer|teammate|owner', 'i') THEN 'relationship'
WHEN regexp_matches(text, '会议|复盘|上线|发布|事故|里程碑|meeting|launch|release|incident|milestone', 'i') THEN 'event' WHEN regexp_matches(text, '概念|原则|方法论|框架|理论|学习|concept|principle|framework|theory', 'i') THEN 'concept'
WHEN regexp_matches(text, '项目|版本|需求|PRD|roadmap|sprint|project|requirement', 'i') OR regexp_matches(text, '\\[\\[[^\\]]+\\]\\]') THEN 'project_fact' ELSE 'raw_note' END AS kind FROM documents""")
def kind_infer(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.memory_kind(F.col("text")).alias("kind"))


@query("memory_kind")
def memory_kind(spark, sf_dir):
    """kind_infer under its first name."""
    return kind_infer(spark, sf_dir)


@query("decay_pass", f"""WITH {STATE}, idle AS (SELECT *, last_hit_at IS NULL OR last_hit_at <= DATE '{NOW}' - 14 AS i14, last_hit_at IS NULL OR last_hit_at <= DATE '{NOW}' - 30 AS i30, last_hit_at IS NULL OR last_hit_at <= DATE '{NOW}' - 60 AS i60, last_hit_at IS NULL OR last_hit_at <= DATE '{NOW}' - 90 AS i90, last_hit_at IS NULL OR last_hit_at <= DATE '{NOW}' - 180 AS i180 FROM st),
r AS (SELECT *, CASE WHEN status != 'active' OR decay_factor <= 0.01 THEN 1.0 WHEN layer = 'flash' AND i14 THEN 0.95 WHEN layer = 'short' AND i60 THEN 0.98 WHEN layer = 'long' AND i180 THEN 0.99 ELSE 1.0 END::DOUBLE AS rate FROM idle),
a AS (SELECT *, decay_factor * rate AS d1, CASE WHEN rate < 1 THEN greatest(0.1, confidence * rate) ELSE confidence END AS c1 FROM r),
b AS (SELECT *, status = 'active' AND layer = 'long' AND d1 < 0.3 AND i90 AS down FROM a), c AS (SELECT *, CASE WHEN down THEN 'short' ELSE layer END AS l2, CASE WHEN down THEN 0.5 ELSE d1 END AS d2 FROM b)
SELECT id, CASE WHEN status = 'active' AND l2 = 'short' AND d2 < 0.2 AND i30 THEN 'flash' ELSE l2 END AS layer, round(d2, 6) AS decay, round(c1, 6) AS confidence, CASE WHEN status = 'active' AND d2 <= 0.01 THEN 'decayed' ELSE status END AS status FROM c""")
def decay_pass(spark, sf_dir):
    rows = L.decayed(memory_state(spark, sf_dir), today())
    return rows.select("id", "layer", F.round("decay_factor", 6).alias("decay"), F.round("confidence", 6).alias("confidence"), "status")


QUALITY = f"""q AS (SELECT *, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title || chr(10) || content, '(?s)```.*?```', ' ', 'g'), '`([^`]+)`', '\\1', 'g'), '!\\[[^\\]]*\\]\\([^)]+\\)', ' ', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[#>*_\\-~]', ' ', 'g'), '\\s+', ' ', 'g'))) AS n, greatest(0, date_diff('day', updated, DATE '{NOW}')) AS age FROM st WHERE content IS NOT NULL),
w AS (SELECT *, CASE WHEN n < 40 THEN 20 ELSE 0 END + CASE WHEN project IS NULL AND layer != 'entity' AND NOT list_contains(tags, 'project:alpha') THEN 12 ELSE 0 END + CASE WHEN kind IS NULL AND NOT list_contains(tags, 'kind:task') THEN 10 ELSE 0 END + CASE WHEN source IS NULL THEN 8 ELSE 0 END
+ CASE WHEN len(list_filter(tags, lambda t: NOT regexp_matches(lower(t), '^(kind|scope|project|sensitivity):'))) = 0 THEN 8 ELSE 0 END + CASE WHEN confidence < 0.7 THEN 14 ELSE 0 END + CASE WHEN decay_factor < 0.5 THEN 10 ELSE 0 END
+ CASE WHEN layer = 'flash' AND age >= 7 THEN 10 ELSE 0 END + CASE WHEN layer = 'short' AND age >= 30 AND decay_factor < 0.8 THEN 6 ELSE 0 END AS cost FROM q)"""


@query("memory_quality", f"WITH {STATE}, {QUALITY} SELECT id, CAST(greatest(0, 100 - cost) AS BIGINT) AS quality, CASE WHEN 100 - cost >= 82 THEN 'trusted' WHEN 100 - cost >= 62 THEN 'usable' ELSE 'seed' END AS maturity FROM w")
def memory_quality(spark, sf_dir):
    rows = L.with_quality(memory_state(spark, sf_dir).where("content IS NOT NULL"), today())
    return rows.select("id", F.col("quality").cast("long").alias("quality"), "maturity")


DREAM = f"""asked AS (SELECT user_id AS id, count(DISTINCT event_type) AS n_asked FROM events GROUP BY 1), g AS (SELECT w.*, coalesce(n_asked, greatest(1, floor(hit_count * 0.6 + 0.5))) AS uq, greatest(1, date_diff('day', created, DATE '{NOW}')) AS days FROM w LEFT JOIN asked USING (id) WHERE status = 'active' AND layer IN ('short', 'long', 'flash') AND created >= DATE '{NOW}' - 365),
z AS (SELECT *, (0.30 * least(1, confidence) + 0.24 * least(1, hit_count / 20) + 0.15 * least(1, uq / 10) + 0.15 * exp(-days / 30.0) + 0.10 * CASE WHEN hit_count > 0 THEN least(1, 1.5 - decay_factor) ELSE 0 END + 0.06 * least(1, len(tags) / 5)) * (0.75 + greatest(0, 100 - cost) / 100 * 0.25) AS score FROM g)"""


def _dreamed(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("query"))
    return L.dream_scored(memory_state(spark, sf_dir).where("content IS NOT NULL"), asked, today(), lookback=365)


@query("dream_score", f"WITH {STATE}, {QUALITY}, {DREAM} SELECT id, CAST(uq AS BIGINT) AS unique_queries, round(CAST(score AS DOUBLE), 6) AS score FROM z")
def dream_score(spark, sf_dir):
    """Six signals times quality; the lookback is a year, as these memories are spread over one."""
    return _dreamed(spark, sf_dir).select("id", "unique_queries", F.round("score", 6).alias("score"))


@query("promotion_ready", f"WITH {STATE}, {QUALITY}, {DREAM} SELECT id, layer FROM z WHERE score >= 0.8 AND hit_count >= 3 AND uq >= 3 AND layer IN ('short', 'flash') AND 100 - cost >= 65 AND n >= 40")
def promotion_ready(spark, sf_dir):
    return L.promotion_ready(_dreamed(spark, sf_dir)).select("id", "layer")


@query("cohit_edges", """WITH h AS (SELECT DISTINCT user_id AS q, event_type || '-' || hour(ts) AS hit FROM events),
p AS (SELECT a.hit AS one, b.hit AS two, count(*) AS n FROM h a JOIN h b ON a.q = b.q AND a.hit < b.hit GROUP BY 1, 2)
SELECT one, two, n, round(CAST(least(1, 0.2 + 0.05 * (n - 3)) AS DOUBLE), 6) AS strength FROM p WHERE n >= 3""")
def cohit_edges(spark, sf_dir):
    hits = table(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", F.hour("ts").cast("string")).alias("hit"), F.col("user_id").alias("q"))
    pairs = R.co_occurring(hits, "hit", "q", 3)
    return pairs.select(F.col("hit").alias("one"), F.col("other").alias("two"), F.col("shared").alias("n"), F.round(F.least(F.lit(1.0), 0.2 + 0.05 * (F.col("shared") - 3)), 6).alias("strength"))


RUN = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


def _runs(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return R.streaks(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "purchase")


@query("failure_streak", f"""WITH i AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) {RUN} AS island FROM events)
SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i""")
def failure_streak(spark, sf_dir):
    return _runs(spark, sf_dir).select("event_id", "streak")


@query("token_running", f"SELECT event_id, round(sum(value) {RUN}, 2) AS used, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS sequence FROM events")
def token_running(spark, sf_dir):
    along = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(along.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("used"), F.row_number().over(along).alias("sequence"))


@query("breaker", f"""WITH e AS (SELECT user_id, event_id, ts, event_type = 'error' AS failed, CAST(value AS INTEGER) % 3 AS signature, value FROM events),
i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) {RUN} AS passed, sum(value) {RUN} AS used, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM e),
s AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, passed ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failures,
  CASE WHEN failed AND signature IS DISTINCT FROM lag(signature) OVER (PARTITION BY user_id, passed ORDER BY ts, event_id) THEN 1 ELSE 0 END AS new FROM i),
p AS (SELECT *, sum(new) OVER (PARTITION BY user_id, passed ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spell FROM s),
w AS (SELECT *, CASE WHEN failed THEN sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, passed, spell ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS same FROM p),
t AS (SELECT user_id, event_id, ts, CASE WHEN failures >= 3 AND same >= 3 THEN 'stagnation' WHEN failures >= 5 THEN 'no-progress' WHEN used >= 400 THEN 'token-budget' WHEN seq >= 10 THEN 'max-iterations' END AS reason FROM w)
SELECT user_id, event_id, reason FROM t WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def breaker(spark, sf_dir):
    """Failures are errors, their signature is by rule from the value (halves go to the even number), which also counts as tokens."""
    failed = F.coalesce(F.col("event_type") == "error", F.lit(False))
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", failed.alias("failed"), (F.rint("value").cast("int") % 3).alias("signature"), F.col("value").alias("tokens"))
    return P.tripped(events, "user_id", [F.asc_nulls_last("ts"), F.asc_nulls_last("event_id")], token_budget=400).select("user_id", "event_id", "reason")


@query("event_cursor", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS sequence FROM events QUALIFY sequence > user_id % 20 AND sequence <= user_id % 20 + 50")
def event_cursor(spark, sf_dir):
    """The next page of every run, each from a cursor of its own."""
    numbered = P.sequenced(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])
    return P.page_after(numbered, "user_id", F.col("user_id") % 20, 50).select("user_id", "event_id", "sequence")


@query("event_pages", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS sequence FROM events QUALIFY sequence > 10 AND sequence <= 60")
def event_pages(spark, sf_dir):
    """The first 50 events past a cursor that all runs share."""
    numbered = R.top_per_key(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 60)
    return numbered.where("rank > 10").select("user_id", "event_id", F.col("rank").alias("sequence"))


@query("unread_counts", """WITH r AS (SELECT conv_id, max(turn) AS read_to FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT c.conv_id, count(*) AS messages, count(*) FILTER (role = 'user' AND turn > coalesce(read_to, -1)) AS unread FROM conversations c LEFT JOIN r USING (conv_id) GROUP BY 1""")
def unread_counts(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations").groupBy("conv_id", "role", "turn").agg(F.count("*").alias("n"))
    read = messages.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("read_to"))
    unread = F.when((F.col("role") == "user") & (F.col("turn") > F.coalesce("read_to", F.lit(-1))), F.col("n")).otherwise(0)
    return messages.join(read, "conv_id", "left").groupBy("conv_id").agg(F.sum("n").alias("messages"), F.sum(unread).alias("unread"))


@query("last_messages", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) <= 5")
def last_messages(spark, sf_dir):
    return R.top_per_key(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn"), F.col("role"), F.col("text")], 5).select("conv_id", "turn", "role")


@query("subject_clean", "SELECT item_id, trim(regexp_replace('Re: FWD: ' || text, '^((re|fwd?)\\s*:\\s*)+', '', 'i')) AS subject FROM benchmark")
def subject_clean(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.clean_subject(F.concat(F.lit("Re: FWD: "), "text")).alias("subject"))


@query("hourly_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query("session_debounce", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)
SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions FROM g GROUP BY 1""")
def session_debounce(spark, sf_dir):
    sessions = table(spark, sf_dir, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes")).agg(F.count("*").alias("n"))
    return sessions.groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("digest_watermark", """WITH w AS (SELECT conv_id, max(turn) AS seen FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT c.conv_id, count(*) AS newer, CAST(sum(CAST('0x' || substr(md5(turn || '|' || coalesce(text, '')), 1, 15) AS BIGINT)) AS VARCHAR) AS fingerprint FROM conversations c JOIN w USING (conv_id) WHERE turn > seen GROUP BY 1""")
def digest_watermark(spark, sf_dir):
    """What came after the last answer. The fingerprint adds up hashes, so no conversation is gathered in one task."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.conv(F.substring(F.md5(F.concat_ws("|", "turn", F.coalesce("text", F.lit("")))), 1, 15), 16, 10).cast("decimal(38,0)").alias("h"))
    seen = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("seen"))
    newer = turns.join(seen, "conv_id").where("turn > seen")
    return newer.groupBy("conv_id").agg(F.count("*").alias("newer"), F.sum("h").cast("string").alias("fingerprint"))


@query("slugs", "SELECT doc_id, substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM documents")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))
