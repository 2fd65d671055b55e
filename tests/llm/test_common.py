import glob

from tarn.llm import common


def test_forgetting_what_was_written(spark):
    df = common.written(spark.range(5), "five")
    assert df.count() == 5 and df.inputFiles()
    folder = common.own_folder(spark).removeprefix("file://")
    assert glob.glob(f"{folder}/five-*")
    common.forget(spark)
    assert not glob.glob(f"{folder}/*")


def test_rows_go_by_their_ids(spark):
    rows = spark.createDataFrame([(1, "a", "z"), (2, "b", "z"), (None, "c", "z")], "doc_id long, text string, kept string")
    judged = spark.createDataFrame([(1, True), (1, False), (2, False), (None, False)], "doc_id long, kept boolean")
    assert [tuple(r) for r in common.without_dropped(rows, judged, "doc_id").collect()] == [(1, "a", "z")]


def test_one_thing_is_kept():
    made = []
    get = lambda k: common.kept((k,), lambda: made.append(k) or k)
    assert [get("a"), get("a"), get("b"), get("a")] == ["a", "a", "b", "a"] and made == ["a", "b", "a"]
