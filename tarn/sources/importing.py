"""Import formats of memory files, file walks, previews, and the idempotent import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.operators.textindex import TextIndex
from pyspark.sql.types import ArrayType, StringType

# fixed values: an extension and its format; others are text
FORMATS = {"json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "md": "markdown", "markdown": "markdown", "txt": "text"}
# fixed values: folders that a walk leaves out
IGNORED = ["node_modules", ".git", "dist", "build", ".cache", "__pycache__"]
INNER, CONTENT = ("payload", "data", "item", "memory"), ("content", "text", "memory", "value", "note", "summary")


def format_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(F.regexp_extract(path, "\\.([^./\\\\]+)$", 1))), F.lit("text"))


def walk(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """path, format, bytes of the files below root, by path; ignored and hidden folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"))
    kept = files.where(~F.col("path").rlike(f"/(?:{'|'.join(x.replace('.', chr(92) + '.') for x in IGNORED)})/")).select("path", format_of(F.col("path")).alias("format"), "bytes").orderBy("path")
    return kept if most is None else kept.limit(most)


def _unwrapped(value: Column) -> Column:
    """The record inside its envelopes, two deep."""
    for _ in range(2):
        value = F.coalesce(*[F.when(F.get_json_object(value, f"$.{k}").startswith("{"), F.get_json_object(value, f"$.{k}")) for k in INNER], value)
    return value


def _record(value: Column) -> list[Column]:
    inner = _unwrapped(value)
    message = F.when(F.get_json_object(value, "$.type") == "event_msg", F.get_json_object(value, "$.payload.message"))
    content = F.coalesce(*[F.get_json_object(inner, f"$.{k}") for k in CONTENT], F.get_json_object(inner, "$.message.content"), message, F.get_json_object(inner, "$.message"))
    return [content.alias("content"), F.get_json_object(inner, "$.title").alias("title"), F.coalesce(F.get_json_object(inner, "$.id"), F.get_json_object(inner, "$.source_id")).alias("source_id")]


def _with_content(rows: DataFrame) -> DataFrame:
    return rows.where("content IS NOT NULL AND trim(content) != ''")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """content, title, source_id of lines of JSON, in envelopes or not; bad lines and lines without content go."""
    return _with_content(spark.read.text(path).where(F.try_parse_json("value").isNotNull()).select(*_record(F.col("value"))))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """content, title, source_id of whole JSON files: an array, a wrapper with memories or items, or one object. A malformed file gives nothing."""
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value")).where(F.try_parse_json("value").isNotNull())
    array = F.coalesce(F.get_json_object("value", "$.memories"), F.get_json_object("value", "$.items"), F.when(F.col("value").startswith("["), F.col("value")))
    items = F.when(array.isNotNull(), F.from_json(array, ArrayType(StringType()))).otherwise(F.array("value"))
    return _with_content(raw.select(F.explode(items).alias("item")).select(*_record(F.col("item"))))


def read_sections(spark: SparkSession, path: str, markdown: bool = True) -> DataFrame:
    """path, part, content: a text file's sections; Markdown is cut at rules or, without any, before headings; text at blank lines."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    by_rule, by_heading = F.split("value", "(?m)^---+\\s*$"), F.split("value", "(?m)(?=^#{1,3} )")
    parts = F.when(F.size(by_rule) > 1, by_rule).otherwise(by_heading) if markdown else F.split("value", "\\n{2,}")
    kept = F.filter(F.transform(parts, lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")), lambda x: x != "")
    return raw.select("path", F.posexplode(kept).alias("part", "content"))


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """What an import adds: rows whose keys are not there yet, each once: the first by order, or by all its columns."""
    first = Window.partitionBy(*keys).orderBy(*(order or [c for c in incoming.columns if c not in keys] or keys))
    once = incoming.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")
    return once.join(existing.select(*keys).distinct(), keys, "left_anti")


def import_report(incoming: DataFrame, existing: DataFrame, kind: Column) -> DataFrame:
    """kind, found, added, skipped of a dry run. incoming and existing: source, source_id, existing also status; deleted rows do not count as there."""
    there = existing.where("status != 'deleted'")
    added = new_rows(incoming, there, ["source", "source_id"]).groupBy(kind.alias("kind")).agg(F.count("*").alias("added"))
    found = incoming.groupBy(kind.alias("kind")).agg(F.count("*").alias("found"))
    return found.join(added, "kind", "left").select("kind", "found", F.coalesce("added", F.lit(0)).alias("added"), (F.col("found") - F.coalesce("added", F.lit(0))).alias("skipped"))


def preview(incoming: DataFrame, existing: DataFrame, most: int = 5) -> DataFrame:
    """place, id, tier of what each incoming row may repeat: an equal title (1), an equal title but for case and marks (2), equal content but for white space (3)."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", " ")
    keys = [("title", F.col("title")), ("plain", plain(F.col("title"))), ("text", F.sha2(F.trim(F.regexp_replace("content", "\\s+", " ")), 256))]
    found = None
    for tier, (_, key) in enumerate(keys, 1):
        one, two = incoming.select("place", key.alias("key")), existing.select("id", key.alias("key"))
        met = one.join(two, "key").select("place", "id", F.lit(tier).alias("tier"))
        found = met if found is None else found.unionByName(met)
    best = found.groupBy("place", "id").agg(F.min("tier").alias("tier"))
    return best.withColumn("_r", F.row_number().over(Window.partitionBy("place").orderBy("tier", "id"))).where(F.col("_r") <= most).drop("_r")


def ranked_preview(incoming: DataFrame, existing: DataFrame, index: TextIndex, each: int = 3, most: int = 5) -> DataFrame:
    """place, rank, id, tier of what each incoming row may repeat: a title that is equal but for case and ends (1), the best by full text of its title (2), of its content's first 600 characters (3).

    incoming: place, title, content; existing: id, title of the active rows, which the
    index holds. Each tier gives its first rows, a row counts where it comes first, and the
    first of all are shown. Null titles and contents find nothing.
    """
    low = lambda c: F.lower(F.trim(c))
    same = incoming.select("place", low("title").alias("t")).join(existing.select("id", low("title").alias("t")), "t").where("t != ''").select("place", F.lit(1).alias("tier"), "id", F.lit(0.0).alias("score"))
    asked = lambda c: incoming.select(F.col("place").alias("query_id"), c.alias("query"))
    titles, contents = index.search(asked(F.col("title")), each), index.search(asked(F.substring("content", 1, 600)), each, most_terms=6)
    found = same
    for tier, hits in ((2, titles), (3, contents)):
        found = found.unionByName(hits.select(F.col("query_id").alias("place"), F.lit(tier).alias("tier"), "id", "score"))
    order = [F.desc("score"), "id"]
    first = found.withColumn("_r", F.row_number().over(Window.partitionBy("place", "tier").orderBy(*order))).where(F.col("_r") <= each)
    once = first.groupBy("place", "id").agg(F.min(F.struct("tier", "_r")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("place").orderBy("at", "id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).select("place", "rank", "id", F.col("at.tier").alias("tier"))


def path_hint(metadata: Column, path: Column) -> Column:
    """A project path that an imported row suggests: of its metadata, else the folders of its file."""
    named = F.coalesce(*[F.get_json_object(metadata, f"$.{k}") for k in ("projectPath", "project_path", "project", "workspace")])
    return F.coalesce(named, F.nullif(F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.lit("")))
