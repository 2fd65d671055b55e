"""Several texts that say the same made into one, paragraph by paragraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import rules as R
from tarn.functions.text import jaccard
from tarn.lineage import kept
from tarn.operators.dedup import greedy_keepers

# fixed values: how alike paragraphs are that count as one, and that keep a place in the first text
SAME, PLACE = 0.7, 0.6


def alike(one: DataFrame, two: DataFrame, least: float) -> DataFrame:
    """a, b, similarity: ids of rows (id, group, tokens) of one group whose token sets are more alike than least (0.5 or more).

    Such sets share a token among the first 1 - least of each, in any order that is the
    same for all; with rare tokens first, few others meet.
    """
    rare = one.unionByName(two).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))

    def led(rows: DataFrame, name: str) -> DataFrame:
        counted = rows.select("id", "group", F.size("tokens").alias("size"), F.explode("tokens").alias("token")).join(rare, "token")
        placed = counted.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("n", "token")))
        return placed.where(F.col("r") <= F.floor((1 - least) * F.col("size") + 1e-9) + 1).select("group", "token", F.col("id").alias(name))

    met = led(one, "a").join(led(two, "b"), ["group", "token"]).where("a != b").select("a", "b").distinct()
    sets = [rows.select(F.col("id").alias(k), F.col("tokens").alias(f"t{k}")) for rows, k in ((one, "a"), (two, "b"))]
    return met.join(sets[0], "a").join(sets[1], "b").select("a", "b", jaccard(F.col("ta"), F.col("tb"), 1.0).alias("similarity")).where(F.col("similarity") > least)


def merged_texts(texts: DataFrame) -> DataFrame:
    """group, text: the texts of each group (group, place, text; place counts from 0) as one.

    Paragraphs, cut at empty lines, that are alike are one: the first that no earlier one
    took takes those like it, and the longest of them stands for them. One that is like a
    paragraph of the first text takes its place there, the first such for each; the others
    follow in their order. A group's only text stays as it is; null texts are left out.
    """
    some = texts.where("text IS NOT NULL")
    cut = F.filter(F.transform(F.split("text", "\\n\\n+"), lambda p: F.regexp_replace(p, "^\\s+|\\s+$", "")), lambda p: p != "")
    numbered = some.select("group", "place", F.posexplode(cut).alias("at", "text")).select(F.monotonically_increasing_id().alias("id"), "group", "place", (F.col("place").cast("long") * (1 << 32) + F.col("at")).alias("order"), "text")
    parts = kept(numbered.withColumn("tokens", R.similarity_tokens(F.col("text"))), "paragraphs")
    slim = parts.select("id", "group", "tokens")
    pairs = kept(alike(slim, slim, SAME).where("a < b").select(F.col("a").alias("one"), F.col("b").alias("two")), "pairs")
    # paragraphs of different groups never meet, so a group is a component
    linked = pairs.select(F.col("one").alias("id")).union(pairs.select("two")).distinct()
    components = parts.join(linked, "id").select("id", F.xxhash64("group").alias("component"))
    keepers = greedy_keepers(pairs, components, parts.select("id", F.col("order").alias("place")))
    taken = parts.join(keepers, "id", "left").withColumn("keeper", F.coalesce("keeper", "id"))
    longest = F.max(F.struct(F.length("text"), (-F.col("order")).alias("o"), "text", "tokens"))
    classes = kept(taken.groupBy("group", "keeper").agg(longest.alias("top"), F.min("order").alias("order")).select(F.col("keeper").alias("id"), "group", "order", F.col("top.text").alias("text"), F.col("top.tokens").alias("tokens")), "classes")

    first = parts.where("place = 0").withColumn("id", -1 - F.col("id"))  # apart from the classes' ids
    near = alike(first.select("id", "group", "tokens"), classes.select("id", "group", "tokens"), PLACE)
    led = near.join(first.select(F.col("id").alias("a"), F.col("order").alias("leads")), "a").join(classes.select(F.col("id").alias("b"), "order"), "b")
    own = led.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("order"))).where("r = 1").groupBy(F.col("b").alias("id")).agg(F.min("leads").alias("leads"))
    placed = classes.join(own, "id", "left").select("group", F.struct(F.col("leads").isNull(), "leads", "order", "text").alias("x"))
    joined = placed.groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "\n\n").alias("merged"))
    alone = some.groupBy("group").agg(F.count("*").alias("n"), F.first("text").alias("only"))
    return alone.join(joined, "group", "left").select("group", F.when(F.col("n") == 1, F.col("only")).otherwise(F.coalesce("merged", F.lit(""))).alias("text"))
