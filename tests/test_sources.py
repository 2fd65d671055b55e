"""Import formats, previews, backups."""

import json

import pytest
from pyspark.sql import functions as F

from tarn.sources import backup
from tarn.sources import importing as I


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_json_shapes(spark, tmp_path):
    write(tmp_path / "j" / "a.json", json.dumps({"memories": [{"content": "one", "title": "t"}, {"payload": {"text": "two", "id": 7}}]}))
    write(tmp_path / "j" / "b.json", json.dumps([{"note": "three"}, {"title": "no content"}, {"data": {"item": {"value": "four"}}}]))
    write(tmp_path / "j" / "c.json", '{"content": "five"}')
    write(tmp_path / "j" / "d.json", "{bad")
    got = sorted((r["content"], r["title"], r["source_id"]) for r in I.read_json(spark, str(tmp_path / "j")).collect())
    assert got == [("five", None, None), ("four", None, None), ("one", "t", None), ("three", None, None), ("two", None, "7")]


def test_jsonl(spark, tmp_path):
    lines = ['{"content":"a","title":"t"}', "{bad", "", '{"payload":{"data":{"summary":"b"}}}', '{"type":"event_msg","payload":{"message":"c"}}', '{"title":"x"}', '{"content":"  "}']
    write(tmp_path / "l.jsonl", "\n".join(lines))
    assert sorted(r["content"] for r in I.read_jsonl(spark, str(tmp_path / "l.jsonl")).collect()) == ["a", "b", "c"]


def test_sections(spark, tmp_path):
    write(tmp_path / "rules.md", "one\n---\ntwo\n\n# head\nx\n")
    write(tmp_path / "heads.md", "intro\n# A\na\n## B\nb\n#### deep\n")
    write(tmp_path / "t.txt", "p1\nstill\n\n\np2\n")
    read = lambda n, m=True: [r["content"] for r in I.read_sections(spark, str(tmp_path / n), m).orderBy("part").collect()]
    assert read("rules.md") == ["one", "two\n\n# head\nx"]
    assert read("heads.md") == ["intro", "# A\na", "## B\nb\n#### deep"]
    assert read("t.txt", False) == ["p1\nstill", "p2"]


def test_walk_and_formats(spark, tmp_path):
    for n in ("a.MD", "b/c.ndjson", "b/node_modules/x.json", "b/d", ".git/e.txt", "f.rst"):
        write(tmp_path / n, "x")
    got = [(r["path"].rsplit("/", 1)[1], r["format"], r["bytes"]) for r in I.walk(spark, str(tmp_path)).collect()]
    assert got == [("a.MD", "markdown", 1), ("c.ndjson", "jsonl", 1), ("d", "text", 1), ("f.rst", "text", 1)]
    assert I.walk(spark, str(tmp_path), 2).count() == 2


def test_import_skips_what_is_there(spark):
    incoming = spark.createDataFrame([("s", 1, "b"), ("s", 1, "a"), ("s", 2, "c"), ("s", 3, "d")], "source string, source_id long, content string")
    existing = spark.createDataFrame([("s", 2, "active"), ("s", 3, "deleted")], "source string, source_id long, status string")
    assert sorted(tuple(r) for r in I.new_rows(incoming, existing.where("status != 'deleted'"), ["source", "source_id"]).collect()) == [("s", 1, "a"), ("s", 3, "d")]
    assert [tuple(r) for r in I.import_report(incoming, existing, F.lit("k")).collect()] == [("k", 4, 2, 2)]
    again = incoming.select("source", "source_id", F.lit("active").alias("status"))
    assert [tuple(r) for r in I.import_report(incoming, again, F.lit("k")).collect()] == [("k", 4, 0, 4)]


def test_preview_tiers(spark):
    incoming = spark.createDataFrame([(1, "My Title", "text a"), (2, "other", "text  b "), (3, "none", "zzz")], "place long, title string, content string")
    existing = spark.createDataFrame([(10, "My Title", "x"), (11, "my-title", "y"), (12, "q", "text b")], "id long, title string, content string")
    assert sorted(tuple(r) for r in I.preview(incoming, existing).collect()) == [(1, 10, 1), (1, 11, 2), (2, 12, 3)]


def test_backup_round_trip(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", [1.5]), (2, None, None)], "id long, t string, v array<double>")
    b = spark.createDataFrame([], "k string")
    backup.save(spark, {"a": a, "b": b}, str(tmp_path / "k"))
    assert sorted(tuple(r) for r in backup.verify(spark, str(tmp_path / "k")).collect()) == [("a", 2, True), ("b", 0, True)]
    assert backup.restore(spark, str(tmp_path / "k")) == {}
    back = backup.restore(spark, str(tmp_path / "k"), dry_run=False)
    assert sorted(map(str, back["a"].collect())) == sorted(map(str, a.collect())) and back["b"].columns == ["k"]
    one, two = (backup.fingerprint(x).first() for x in (a, a.orderBy(F.desc("id")).repartition(3)))
    assert one == two != backup.fingerprint(a.limit(1)).first()
    spark.createDataFrame([(3, "y", None)], a.schema).write.mode("append").parquet(str(tmp_path / "k" / "a"))
    with pytest.raises(ValueError, match="'a'"):
        backup.restore(spark, str(tmp_path / "k"))


def test_offload(spark):
    r = backup.offloaded(spark.createDataFrame([(1, "é" * 3000), (2, "s")], "id int, content string")).orderBy("id").collect()
    assert (r[0]["bytes"], r[0]["content"], len(r[0]["summary"]), len(r[0]["ref"])) == (6000, None, 200, 64) and r[1]["content"] == "s" and r[1]["ref"] is None
