"""Mail threads: folders, readers, unread counts, contexts, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.textindex import TextIndex

from tarn.functions import rules as R


def in_folder(threads: DataFrame, messages: DataFrame, folder: str, me: str, now: Column) -> DataFrame:
    """The threads of a folder view: starred, snoozed, sent, drafts, scheduled, all, or a folder's name; the inbox hides what is snoozed."""
    asleep = F.col("snoozed_until").isNotNull() & (F.col("snoozed_until") > now)
    with_message = lambda keep: threads.join(messages.where(keep).select(F.col("thread_id").alias("id")).distinct(), "id", "left_semi")
    if folder == "starred":
        return threads.where(F.col("starred") & (F.col("folder") != "trash"))
    if folder == "snoozed":
        return threads.where(asleep & (F.col("folder") != "trash"))
    if folder == "sent":
        return with_message((F.col("sender_id") == me) & (F.col("status") == "sent"))
    if folder in ("drafts", "scheduled"):
        return with_message(F.col("status") == folder.removesuffix("s" if folder == "drafts" else ""))
    kept = threads if folder == "all" else threads.where(F.col("folder") == folder)
    return kept.where(~asleep) if folder == "inbox" else kept


def thread_list(threads: DataFrame, messages: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Threads with their message counts, the latest first, by the page."""
    counts = messages.groupBy(F.col("thread_id").alias("id")).agg(F.count("*").alias("messages"))
    rows = threads.join(counts, "id", "left").withColumn("messages", F.coalesce("messages", F.lit(0)))
    return rows.orderBy(F.desc("last_message_at"), "id").offset(max(0, offset)).limit(max(1, min(limit, 250)))


def matching_threads(threads: DataFrame, messages: DataFrame, text: str) -> DataFrame:
    """Threads whose subject, summary or any message holds the text."""
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.strip().lower()))
    held = messages.where(has("body")).select(F.col("thread_id").alias("id")).unionByName(threads.where(has("subject") | has("current_summary")).select("id")).distinct()
    return threads.join(held, "id", "left_semi")


def readers(messages: DataFrame, receipts: DataFrame, prefix: str = "agent:") -> DataFrame:
    """thread_id, recipient_id, read_at: when each agent last read a thread."""
    read = receipts.where(F.startswith("recipient_id", F.lit(prefix)) & F.col("read_at").isNotNull())
    return read.join(messages.select(F.col("id").alias("message_id"), "thread_id"), "message_id").groupBy("thread_id", "recipient_id").agg(F.max("read_at").alias("read_at"))


def participants(messages: DataFrame, receipts: DataFrame) -> DataFrame:
    """thread_id, participant: senders, recipients, and whoever has a receipt."""
    named = messages.select("thread_id", F.explode(F.array_append(F.coalesce("recipient_ids", F.array().cast("array<string>")), F.col("sender_id"))).alias("participant"))
    kept = receipts.join(messages.select(F.col("id").alias("message_id"), "thread_id"), "message_id").select("thread_id", F.col("recipient_id").alias("participant"))
    return named.unionByName(kept).where("participant IS NOT NULL AND participant != ''").distinct()


def marked_read(receipts: DataFrame, messages: DataFrame, reads: DataFrame) -> DataFrame:
    """receipts after reads (thread_id, recipient_id, at): all sent messages of the thread but one's own are read; an earlier receipt's time is replaced."""
    last = reads.groupBy("thread_id", "recipient_id").agg(F.max("at").alias("at"))
    new = messages.where("status = 'sent'").join(last, "thread_id").where(~F.col("sender_id").eqNullSafe(F.col("recipient_id"))).select(F.col("id").alias("message_id"), "recipient_id", "at")
    both = receipts.join(new, ["message_id", "recipient_id"], "full_outer")
    return both.select("message_id", "recipient_id", F.coalesce("delivered_at", "at").alias("delivered_at"), F.coalesce("at", "read_at").alias("read_at"))


def unread(messages: DataFrame, receipts: DataFrame, me: Column) -> DataFrame:
    """thread_id, unread: sent messages of others that have no receipt of mine with a time."""
    read = receipts.where((F.col("recipient_id") == me) & F.col("read_at").isNotNull()).select(F.col("message_id").alias("id")).distinct()
    mine = messages.where((F.col("status") == "sent") & ~F.col("sender_id").eqNullSafe(me))
    open_ = mine.join(read, "id", "left_anti").groupBy("thread_id").agg(F.count("*").alias("unread"))
    return messages.select("thread_id").distinct().join(open_, "thread_id", "left").select("thread_id", F.coalesce("unread", F.lit(0)).alias("unread"))


def last_messages(messages: DataFrame, n: int, order: str = "turn", thread: str = "thread_id") -> DataFrame:
    return messages.withColumn("_r", F.row_number().over(Window.partitionBy(thread).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")


def open_items(messages: DataFrame, recent: int = 8, most: int = 8, thread: str = "thread_id", order: str = "turn", body: str = "body") -> DataFrame:
    """thread, items: what the last messages say is still to do, each once, in their order, the first most."""
    last = messages.withColumn("_r", F.row_number().over(Window.partitionBy(thread).orderBy(F.desc(order)))).where(F.col("_r") <= recent)
    lines = last.select(thread, order, F.posexplode(R.open_items(F.col(body))).alias("_at", "item"))
    first = lines.groupBy(thread, "item").agg(F.min(F.struct(order, "_at")).alias("_when"))
    ranked = first.withColumn("_r", F.row_number().over(Window.partitionBy(thread).orderBy("_when", "item"))).where(F.col("_r") <= most)
    return ranked.groupBy(thread).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "item"))), lambda x: x["item"]).alias("items"))


def attachments(messages: DataFrame, body: str = "body") -> DataFrame:
    """messages with clean (the body without code) and blocks: kind and content of each fenced block."""
    fence = "(?s)```([\\w-]*)\\n?(.*?)```"
    languages, contents = F.regexp_extract_all(body, F.lit(fence), F.lit(1)), F.regexp_extract_all(body, F.lit(fence), F.lit(2))
    blocks = F.zip_with(languages, contents, lambda a, b: F.struct(F.when(a.rlike("(?i)log|text|console"), "log").otherwise("technical").alias("kind"), R.stripped(b).alias("content")))
    return messages.withColumns({"clean": R.stripped(F.regexp_replace(body, fence, "\n[attached]\n")), "blocks": blocks})


def fingerprint(memories: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sources, fingerprint: of each group's contents, whatever their order. A sum of hashes, so no group is gathered in one task."""
    part = F.xxhash64("id", "title", "content").cast("decimal(38,0)")
    return memories.groupBy(*keys).agg(F.count("*").alias("sources"), F.sum(part).cast("string").alias("fingerprint"))


def digests_due(linked: DataFrame, threads: DataFrame, last: DataFrame) -> DataFrame:
    """thread_id, sources, fingerprint, coverage_through: threads whose newer memories make a new digest.

    linked: thread_id, id, title, content, updated, source; threads: thread_id, last_message_at;
    last: thread_id, coverage_through, fingerprint of the latest digest. What is newer than
    the coverage counts, or than the last message where there is no coverage; an equal
    fingerprint is no news; archives of the mailbox are no source.
    """
    rows = linked.where(~F.coalesce(F.col("source") == "mailbox-archive", F.lit(False))).join(threads, "thread_id").join(last.withColumnRenamed("fingerprint", "_last"), "thread_id", "left")
    newer = rows.where(F.col("updated") > F.coalesce("coverage_through", "last_message_at"))
    made = fingerprint(newer, ["thread_id"]).join(newer.groupBy("thread_id").agg(F.max("updated").alias("_through"), F.first("_last").alias("_last")), "thread_id")
    return made.where(~F.col("fingerprint").eqNullSafe(F.col("_last"))).select("thread_id", "sources", "fingerprint", F.col("_through").alias("coverage_through"))


def unorganized(memories: DataFrame, organized: DataFrame, linked: DataFrame, limit: int = 60) -> DataFrame:
    """Active work memories in no thread that were never organized, or changed since; newest first."""
    does = "完成|推进|修复|发布|上线|迁移|验收|实现|开发|设计|调查|跟进|待确认|需要|正在|已经|计划|准备|问题|进展|决定"
    kinds = ["kind:task", "kind:project_fact", "kind:decision", "kind:event", "kind:project_journal"]
    work = F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, kinds))) | F.concat_ws(" ", "title", "content").rlike(does)
    rows = memories.where(F.col("status") == "active").join(linked.select(F.col("memory_id").alias("id")).distinct(), "id", "left_anti")
    rows = rows.where(~F.coalesce("source", F.lit("")).isin("mailbox", "mailbox-archive", "memory-secretary", "system"))
    seen = organized.groupBy(F.col("memory_id").alias("id")).agg(F.max("source_updated_at").alias("_seen"))
    due = rows.join(seen, "id", "left").where((F.col("_seen").isNull() | (F.col("_seen") < F.col("updated"))) & work)
    return due.orderBy(F.desc("updated"), "id").limit(limit).drop("_seen")


def stats(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """One row: threads by folder, starred ones, drafts."""
    by = threads.agg(*[F.count_if(F.col("folder") == f).alias(f) for f in ("inbox", "archive", "trash")], F.count_if("starred").alias("starred"))
    return by.join(F.broadcast(messages.agg(F.count_if(F.col("status") == "draft").alias("drafts"))))


def debounced(events: DataFrame, keys: list[str], seconds: int = 60, at: str = "ts") -> DataFrame:
    """events that are no later update of a record: one that comes within so many seconds of the one before belongs to it."""
    before = F.lag(at).over(Window.partitionBy(*keys).orderBy(at))
    return events.withColumn("_gap", F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))).where(F.col("_gap").isNull() | (F.col("_gap") >= seconds * 1_000_000)).drop("_gap")


def thread_history(threads: DataFrame, linked: DataFrame, memories: DataFrame, index: TextIndex, most: int = 5) -> DataFrame:
    """thread_id, rank, id: the memories of earlier days that say most of what a thread is about, and are not linked with it yet.

    threads: thread_id, subject, started; linked: thread_id, id; memories: id, created, of
    those that the index holds. A null subject finds nothing.
    """
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    # only rows of earlier days are scored, so that each thread's best can be bounded; so many more of them as are linked
    days = memories.groupBy(F.to_date("created").alias("day")).agg(F.count("*").alias("rows"))
    starts = threads.select(F.to_date("started").alias("start")).distinct()
    earlier = starts.crossJoin(F.broadcast(days)).groupBy("start").agg((F.sum(F.when(F.col("day") <= F.col("start"), F.col("rows")).otherwise(0)) / F.sum("rows")).alias("share"))
    links = linked.select("thread_id", "id").distinct()
    own = threads.select("thread_id", "started", F.to_date("started").alias("start")).join(earlier, "start", "left").join(links.groupBy("thread_id").agg(F.count("*").alias("links")), "thread_id", "left")
    limits = own.where("started IS NOT NULL").groupBy(F.col("thread_id").alias("query_id")).agg(F.max(at("started")).alias("until"), F.max(F.coalesce("share", F.lit(1.0))).alias("share"), (F.lit(most) + F.max(F.coalesce("links", F.lit(0)))).cast("int").alias("n"))
    stamps = memories.where("id IS NOT NULL AND created IS NOT NULL").groupBy("id").agg(F.min(at("created")).alias("stamp"))
    found = index.search(threads.select(F.col("thread_id").alias("query_id"), F.col("subject").alias("query")), limits=limits, stamps=stamps)
    free = found.withColumnRenamed("query_id", "thread_id").join(links, ["thread_id", "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("thread_id").orderBy(F.desc("score"), "id"))
    return free.withColumn("rank", rank).where(F.col("rank") <= most).select("thread_id", "rank", "id")
