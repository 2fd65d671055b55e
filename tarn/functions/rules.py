"""Rules on memory texts as column expressions: tokens, overlap, tags, titles, layers, value, completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.text import jaccard

HAN = "[\\u4e00-\\u9fff]"

# fixed values: words that say nothing of a topic
TOPIC_STOP = ["今天", "现在", "目前", "已经", "需要", "一个", "这个", "系统", "项目", "任务", "工作", "用户", "内容", "记忆"]
# fixed values: words that do not count as shared
LEXICAL_STOP = ["记忆", "内容", "系统", "功能", "这个", "一个", "已经", "需要", "进行", "相关", "可以", "目前", "工作", "项目", "任务", "今天", "the", "and", "for", "with", "this", "that"]
# fixed values: names that are no entities of a conflict
NOISY_ENTITY = "(?i)^(?:今天|昨天|明天|现在|目前|系统|项目|任务|工作|用户|时间|Windows|Git|API|\\d{4}(?:[-年]\\d{1,2})?.*)$"
# fixed values: pairs of opposite words
OPPOSITES = [
    (["喜欢", "喜爱", "爱"], ["讨厌", "厌恶", "恨", "不喜欢"]),
    (["支持", "赞成", "同意"], ["反对", "否定", "拒绝", "不支持"]),
    (["正确", "准确", "无误"], ["错误", "有误", "不正确"]),
    (["开启", "打开", "启用"], ["关闭", "停用", "禁用"]),
]
# fixed values: marks of a change of mind, or of none
DIVERGENCE = ["迁移到", "改用", "换成", "替换为", "切换到", "变更为", "不再使用", "放弃", "仍在使用", "仍用", "继续使用", "保持使用"]
# fixed values: what marks off a title
TITLE_MARKS = "闪念|灵感|想法|思考|洞察|感悟|心得|备忘|笔记|记录|参考|idea|thought|note|flash"
# fixed values: tags that are no tags
TAG_NAMESPACES = "(?i)^(type|source|kind|scope|domain|project|sensitivity|layer|status):"
TAG_DATES = "(?i)^v?\\d{4}-\\d{2}-\\d{2}|^verified-\\d{4}|^fixed-\\d{4}|^global-rules-\\d{4}"
TAG_STATES = "(?i)^(step-\\d|cli-stage|final-result|pull-after-build|smoke-verification|\\d+-of-\\d+-pass)"
# fixed values: a keyword and the tag that it gives
KEYWORD_TAGS = [
    ("问题|bug|fix|修复|解决", "问题修复"),
    ("待办|todo|任务|task", "待办"),
    ("想法|idea|灵感|思考", "想法"),
    ("笔记|note|记录", "笔记"),
    ("会议|meeting|讨论|talk", "会议"),
    ("代码|code|编程|开发", "代码"),
    ("设计|design|ui|ux", "设计"),
    ("学习|study|阅读|book", "学习"),
]
# fixed values: signals of a text's layer
LAYER_SIGNALS = {
    "project": "项目|周会|会议纪要|决策记录|里程碑|roadmap|版本发布|上线|评审|复盘|冲刺|迭代|sprint|milestone|release|launch",
    "entity": "职位|联系方式|电话|邮箱|偏好|风格|档案|基本信息|技术特长|工作风格|沟通建议|协作",
    "knowledge": "方法论|最佳实践|教程|指南|框架|原理|理论|体系|原则|规范|checklist|playbook|howto|how-to",
    "task": "待办|本周|今天|明天|后天|截止日期|截止|安排|计划|task|todo|完成|推进|跟进|落实|执行",
    "idea": "灵感|想法|想到|如果|试试|也许|假设|猜想|突发奇想|灵光一闪",
}
ENTITY_WORDS = "person|entity|人物|人员|同事|客户|团队|负责人|工具|产品"
LONG_WORDS = "preference|rule|principle|decision|project|architecture|repo|framework|偏好|习惯|风格|原则|规则|决定|结论|取舍|架构|方法论|框架|理论|约束|边界|必须|禁止"
# fixed values: words that leave a sentence unfinished
DANGLING_HAN = [
    *("以及", "但是", "因为", "所以", "如果", "虽然", "然后", "接着", "还有", "另外", "比如", "例如", "包括", "关于", "对于", "至于", "除了"),
    *("的", "地", "得", "和", "与", "或", "及", "并", "但", "而", "把", "被", "将", "让", "使", "向", "往", "从", "对", "给", "等"),
]
DANGLING_LATIN = ["the", "a", "an", "and", "or", "but", "to", "of", "in", "on", "at", "for", "with", "by", "from", "via", "is", "are", "was", "were", "be", "that", "which", "as", "vs"]
PRONOUN_HEAD = "^(他|她|它|对方|这个人|那个人|这个|那个|该|此事|此方案)"
# fixed values: answers that say nothing
GREETINGS = [
    *("好的", "好", "行", "可以", "嗯", "嗯嗯", "收到", "明白", "明白了", "了解", "没问题", "辛苦了", "不客气", "谢谢", "感谢", "好的好的", "收到收到"),
    *("好的，谢谢", "收到，谢谢", "好的谢谢", "收到谢谢", "明白，谢谢", "好的，收到，谢谢", "好的好的，收到，谢谢", "收到收到，谢谢，辛苦了", "收到，辛苦了", "好的，辛苦", "感谢感谢"),
    *("ok", "okay", "k", "thx", "thanks", "thank you", "got it", "noted", "ok, thanks", "ok thanks", "sounds good", "没问题，谢谢"),
]
# fixed values: phrases of form letters
BOILERPLATE = [
    *("如有疑问.{0,12}(联系|沟通|找我)", "希望对您?有帮助", "祝(工作|生活|一切).{0,6}(顺利|愉快|安好)", "期待您的?回复", "我会继续跟进", "(有|有任何).{0,6}(进展|问题).{0,8}(同步|告知|联系)"),
    *("感谢(您|你)的?(支持|配合|理解|信任)", "后续.{0,6}(保持|随时).{0,6}(沟通|联系|交流)", "(?i)let me know if", "(?i)feel free to", "(?i)best regards", "此致", "顺祝"),
]
# fixed values: signals of information
SIGNALS = [
    *("\\d{2,}", "https?://\\S+", "[\\p{L}\\p{N}_\\-]+[/\\\\][\\p{L}\\p{N}_\\-.]+", "[a-z]+[A-Z][\\p{L}\\p{N}]*", "\\[\\[[^\\]]+\\]\\]", "#[\\p{L}\\p{N}_\\-]+"),
    "决定|选择|改为|采用|放弃|拒绝|修复|解决|失败|成功|原因是|结论|结论是|目标|进度|截止|验收|交付|偏好|喜欢|不喜欢|不想要|习惯|踩坑|教训|经验|因为|所以",
]
# fixed values: project names that name nothing
GENERIC_PROJECTS = [
    *("未分类", "工作", "学习", "笔记", "临时", "杂项", "其他", "其它", "默认", "全部", "所有", "日常", "琐事", "事项", "内容", "资料", "文档", "记录", "想法", "灵感", "待办", "任务"),
    *("uncategorized", "unclassified", "default", "general", "global", "misc", "miscellaneous", "migrated", "memory", "memories", "notes", "note", "temp", "tmp", "test", "tests", "testing"),
    *("dev", "devel", "develop", "development", "src", "source", "lib", "libs", "bin", "build", "docs", "doc", "work", "works", "study", "learning", "learn", "projects", "project"),
    *("stuff", "things", "other", "others", "all", "inbox", "draft", "drafts", "archive", "archived"),
]


def stripped(text: Column) -> Column:
    """Without white space at its ends, of which trim() takes spaces only."""
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _pairs(runs: Column) -> Column:
    """Neighbouring characters of each run."""
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])


def similarity_tokens(text: Column) -> Column:
    """Characters and Latin words of two letters or more, where over three tenths are ideographs; else words between white space."""
    low = F.lower(stripped(text))
    of_han = F.array_union(_all(low, HAN), _all(low, "[a-z0-9]{2,}"))
    of_words = F.array_distinct(F.filter(F.split(low, "\\s+"), lambda x: x != ""))
    return F.when(F.regexp_count(low, F.lit(HAN)) / F.greatest(F.lit(1), F.length(low)) > 0.3, of_han).otherwise(of_words)


def text_similarity(a: Column, b: Column) -> Column:
    """Of two texts' token sets; one if both are empty."""
    return jaccard(similarity_tokens(a), similarity_tokens(b), 1.0)


def topic_tokens(text: Column, entity: Column) -> Column:
    """Latin words of three characters or more and pairs of ideographs, without the entity's own name."""
    low = F.replace(F.lower(text), F.lower(entity), F.lit(" "))
    found = F.array_union(_all(low, "[a-z][a-z0-9._-]{2,}"), _pairs(_all(low, f"{HAN}{{2,}}")))
    return F.filter(found, lambda x: ~x.isin(TOPIC_STOP))


def shares_topic(a: Column, b: Column, entity: Column) -> Column:
    return F.size(F.array_intersect(topic_tokens(a, entity), topic_tokens(b, entity))) >= 2


def lexical_tokens(text: Column) -> Column:
    """Latin words, long numbers, short runs of ideographs and their pairs."""
    low = F.lower(text)
    runs = _all(low, f"{HAN}{{2,}}")
    found = F.array_distinct(F.concat(_all(low, "[a-z][a-z0-9._-]{2,}|\\d{3,}"), F.filter(runs, lambda r: F.length(r) <= 8), _pairs(runs)))
    return F.filter(found, lambda x: ~x.isin(LEXICAL_STOP))


def lexical_overlap(title_a: Column, content_a: Column, title_b: Column, content_b: Column) -> Column:
    """Shared tokens, those of titles three times more, over the smaller text's; at most 0.99."""
    whole_a, whole_b = (lexical_tokens(F.concat_ws(" ", *x)) for x in ((title_a, content_a), (title_b, content_b)))
    titles, all_ = F.size(F.array_intersect(lexical_tokens(title_a), lexical_tokens(title_b))), F.size(F.array_intersect(whole_a, whole_b))
    score = (3 * titles + all_) / F.greatest(F.lit(8), F.least(F.size(whole_a), F.size(whole_b)))
    return F.when((all_ < 2) & (titles == 0), 0.0).otherwise(F.least(F.lit(0.99), score))


def stripped_title(title: Column) -> Column:
    """Marks such as 'idea:' or '[note]' off the front, up to three of them."""
    for _ in range(3):
        title = F.regexp_replace(title, f"(?i)^\\s*(?:\\[({TITLE_MARKS})\\]\\s*|({TITLE_MARKS})\\s*[:：]\\s*)", "")
    return F.regexp_replace(title, "^\\s+", "")


def cleaned_tag(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^[\"'“‘「『]+|[\"'”’」』]+$", "")


def meaningful_tag(tag: Column) -> Column:
    """A short name: no namespace, date, state, path, number or bracket; a redaction's mark is one."""
    t = F.trim(tag)
    bad = reduce(Column.__or__, [t.rlike(p) for p in (TAG_NAMESPACES, TAG_DATES, TAG_STATES, "[/\\\\~]", "[\\r\\n]", "^\\p{N}+$", "[（(]")])
    return F.coalesce(F.length(t).between(2, 30) & ((F.lower(t) == "sensitivity:redacted") | (~bad & t.rlike("[\\p{L}\\p{N}]"))), F.lit(False))


def normalized_tags(tags: Column, most: int = 8) -> Column:
    """Cleaned meaningful tags, the first of those that differ in case only, at most so many."""
    clean = F.filter(F.transform(tags, cleaned_tag), meaningful_tag)
    first = F.filter(clean, lambda x, i: F.array_position(F.transform(clean, F.lower), F.lower(x)) == i + 1)
    return F.slice(first, 1, most)


def extracted_tags(text: Column) -> Column:
    """Hash tags, mentions, bracketed projects and keyword classes, normalized."""
    marked = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in ("#([\\p{L}\\p{N}_\\-]+)", "@([\\p{L}\\p{N}_\\-]+)", "\\[\\[([^\\]]+)\\]\\]")]
    words = [F.when(text.rlike(f"(?i){p}"), F.array(F.lit(tag))).otherwise(F.array().cast("array<string>")) for p, tag in KEYWORD_TAGS]
    return normalized_tags(F.concat(*marked, *words))


def project_refs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("\\[\\[([^\\]]+)\\]\\]"), F.lit(1))


def _cut(text: Column) -> Column:
    return F.when(F.length(text) > 50, F.concat(F.substring(text, 1, 50), F.lit("..."))).otherwise(text)


def extracted_title(text: Column) -> Column:
    """The first line if it reads as a title, else a bracketed project, else its first words."""
    line = F.coalesce(F.try_element_at(F.filter(F.transform(F.split(text, "\\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1)), F.lit(""))
    titled = line.rlike("^[\\p{L}\\p{N}\\s\\-_，。？！、：“”（）《》【】]+$") & F.length(line).between(5, 80)
    words = F.array_join(F.slice(F.filter(F.split(line, "\\s+"), lambda w: (F.length(w) > 1) & ~w.rlike("^[\\d\\W]+$")), 1, 6), " ")
    project = F.regexp_extract(text, "\\[\\[([^\\]]+)\\]\\]", 1)
    return F.when(line == "", "Untitled").when(titled, _cut(line)).when(project != "", _cut(project)).when(F.length(words) >= 5, _cut(words)).otherwise(_cut(line))


def memory_layer(title: Column, content: Column, importance: Column, category: Column, total: Column) -> Column:
    """The layer that a text belongs to: by importance, category, signals, and its self-check total or, without one, its keywords."""
    signal = {k: content.rlike(f"(?i){p}") for k, p in LAYER_SIGNALS.items()}
    text = F.concat_ws(" ", title, content)
    scored = (
        F.when((signal["idea"] & (total < 0.5)) | (total < 0.35), "flash")
        .when(signal["project"] & content.rlike("\\[\\[([^\\]]+)\\]\\]") & (total >= 0.6), "long")
        .when(signal["knowledge"] & (total >= 0.65), "long").when(signal["task"], "short")
        .when(total >= 0.75, "long").when(total >= 0.4, "short").otherwise("flash")
    )
    by_words = F.when(text.rlike(f"(?i){ENTITY_WORDS}"), "entity").when(text.rlike(f"(?i){LONG_WORDS}"), "long").otherwise("short")
    return (
        F.when(importance == "high", "long").when(importance == "low", "short")
        .when(category.isin("preference", "decision"), "long").when(category.isin("person", "entity"), "entity").when(category.isin("task", "todo"), "short")
        .when(signal["entity"], "entity").when(total.isNotNull(), scored).otherwise(by_words)
    )


def completeness_issues(content: Column) -> Column:
    """What shows that a text breaks off: an array of dangling-connector, mid-sentence-cut, unresolved-reference."""
    text = stripped(content)
    # longer words come first; a single ideograph after a Latin letter is none
    words = [w for w in DANGLING_HAN if len(w) > 1], [w for w in DANGLING_HAN if len(w) == 1]
    han = text.rlike(f"(?:{'|'.join(words[0])})$") | text.rlike(f"(?<![A-Za-z])(?:{'|'.join(words[1])})$")
    latin = F.lower(F.regexp_extract(text, "([A-Za-z]+)$", 1)).isin(DANGLING_LATIN)
    fences = F.regexp_count(text, F.lit("```")) % 2 == 1
    vague = text.rlike(PRONOUN_HEAD) & (F.length(text) <= 60) & ~text.rlike("\\[\\[[^\\]]+\\]\\]") & ~text.rlike("@[\\p{L}\\p{N}_\\-]")
    found = [(text.rlike("[，、,：:]$"), "dangling-connector"), (han | latin, "dangling-connector"), (fences, "mid-sentence-cut"), (vague, "unresolved-reference")]
    issues = F.filter(F.array(*[F.when(c, F.lit(k)) for c, k in found]), lambda x: x.isNotNull())
    return F.when(F.coalesce(text, F.lit("")) == "", F.array(F.lit("mid-sentence-cut"))).otherwise(issues)


def value_of(text: Column) -> Column:
    """verdict (accept or reject) and score: empty texts, greetings and form letters without information go."""
    trimmed = stripped(text)
    bare = F.lower(F.regexp_replace(F.regexp_replace(trimmed, "[\\s。！!？?~～.…]+$", ""), "^[\\s。！!？?~～.…]+", ""))
    signals = reduce(Column.__add__, [trimmed.rlike(p).cast("int") for p in SIGNALS])
    form = (F.length(trimmed) <= 80) & reduce(Column.__or__, [trimmed.rlike(p) for p in BOILERPLATE]) & (signals == 0)
    reject = F.coalesce(bare, F.lit("")).isin("", *GREETINGS) | F.coalesce(form, F.lit(False))
    score = F.when(reject, 0.0).otherwise(F.least(F.lit(1.0), 0.3 + 0.2 * signals))
    return F.struct(F.when(reject, "reject").otherwise("accept").alias("verdict"), score.alias("score"))


def plain_length(text: Column) -> Column:
    """Characters of a text without its Markdown."""
    for pattern, to in (("(?s)```.*?```", " "), ("`([^`]+)`", "$1"), ("!\\[[^\\]]*\\]\\([^)]+\\)", " "), ("\\[([^\\]]+)\\]\\([^)]+\\)", "$1"), ("[#>*_\\-~]", " "), ("\\s+", " ")):
        text = F.regexp_replace(text, pattern, to)
    return F.length(F.trim(text))


def first_sentence(text: Column, most: int = 180) -> Column:
    """The first sentence of a text without its code and list marks, cut at so many characters."""
    for pattern, to in (("(?s)```.*?```", " "), ("`[^`]+`", " "), ("(?m)^#{1,6}\\s+", ""), ("(?m)^[-*]\\s+", ""), ("\\s+", " ")):
        text = F.regexp_replace(text, pattern, to)
    one = F.try_element_at(F.split(F.trim(text), "(?<=[。！？.!?])\\s*"), F.lit(1))
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most - 1), F.lit("…"))).otherwise(one)


def useful_subject(subject: Column) -> Column:
    """ok, or why a thread's subject says too little: length, generic, noun."""
    s = F.trim(subject)
    does = "完成|解决|确认|推进|改进|建立|迁移|上线|发布|接入|设计|更新|修复|整理|调查|准备|讨论|跟进|需要|正在|已经"
    return (
        F.when(~F.length(s).between(5, 120), "length").when(s.rlike("^(飞书|项目|任务|事件|工作|开发|测试|前端|后端|资料|笔记|未分类)$"), "generic")
        .when(s.rlike("^[\\w\\u4e00-\\u9fff-]{1,12}$") & ~s.rlike(does), "noun").otherwise("ok")
    )


def open_items(body: Column) -> Column:
    """Lines of a message that say what is still to do."""
    lines = F.transform(F.split(body, "\\n"), lambda x: F.regexp_replace(F.trim(x), "^[-*]\\s*", ""))
    kept = F.filter(lines, lambda x: x.rlike("^(?:下一步|仍需|还需要|待确认|尚未|需要处理|需要确认)[：:]?") | x.rlike("^\\[ \\]\\s+"))
    return F.transform(kept, lambda x: F.regexp_replace(x, "^\\[ \\]\\s+", ""))


def specific_project(name: Column) -> Column:
    """Whether a name names a project: long enough, and not a generic word."""
    n = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[_\\-]+", " "), "\\s+", " "))
    least = F.when(n.rlike("[\\u3400-\\u9fff]"), 2).otherwise(4)
    return F.coalesce(~n.isin(GENERIC_PROJECTS) & (F.length(n) >= least), F.lit(False))


def summary(text: Column, lines: int = 3) -> Column:
    """The first lines that are not blank."""
    return F.array_join(F.slice(F.filter(F.transform(F.split(text, "\\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, lines), "\n")


def canonical_json(json: Column) -> Column:
    """The same JSON with its keys sorted; null if it is malformed."""
    return F.to_json(F.try_parse_json(json))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, max(0, most - 1))), F.lit("…")))


def with_grams(text: Column, chars: int = 8000, most: int = 4000) -> Column:
    """A text for the index with its pairs of ideographs after it, of its first characters, at most so many; as it is if it has none."""
    pairs = F.slice(_pairs(_all(F.substring(text, 1, chars), f"{HAN}{{2,}}")), 1, most)
    return F.when(F.size(pairs) > 0, F.concat_ws(" ", text, F.array_join(pairs, " "))).otherwise(text)


def embedding_text(title: Column, content: Column, tags: Column, metadata: Column) -> Column:
    """What a memory's vector is made of: title, content, tags, and the string and array values of its metadata."""
    values = F.map_values(F.from_json(metadata, "map<string,string>"))
    texts = F.filter(values, lambda v: v.isNotNull() & ~v.rlike("^(?:-?[0-9.]+(?:[eE][+-]?[0-9]+)?|true|false|\\{.*)$"))
    flat = F.transform(texts, lambda v: F.when(v.startswith("["), F.regexp_replace(F.regexp_replace(v, "[\\[\\]\"]", ""), ",", " ")).otherwise(v))
    none = F.array().cast("array<string>")
    return F.concat_ws(" ", title, content, F.array_join(F.coalesce(tags, none), " "), F.array_join(F.coalesce(flat, none), " "))


def clean_project(value: Column) -> Column:
    """A project path as a text names it, brought to one form; null if it names none."""
    for pattern, to in (
        ("^[\\s\"'「『《【]+|[\\s\"'」』》】。；;，,]+$", ""), ("\\s*(?:中|里|下|内|里面|之中)$", ""), ("(?i)\\s*(?:项目|工程|产品|仓库|repo|project)$", ""), ("\\s*(?:/|\\\\|>|::|->|→|›|＞|／)\\s*", "/"), ("^\\s+|\\s+$", "")
    ):
        value = F.regexp_replace(value, pattern, to)
    parts = F.filter(F.transform(F.split(value, "/"), lambda x: F.trim(x)), lambda x: x != "")
    empty = value.rlike("^(这个|那个|当前|本次|新的|一个|项目|工程|产品|仓库)$")
    fine = F.length(value).between(2, 120) & ~empty & (F.size(parts) > 0) & F.forall(parts, lambda x: F.length(x) <= 50) & ((F.size(parts) > 1) | specific_project(F.try_element_at(parts, F.lit(1))))
    return F.when(fine, F.array_join(parts, "/"))


# fixed values: where a text names its project, the first that names one counts
PROJECT_MARKS = [
    "\\[\\[([^\\]\\r\\n]{2,120})\\]\\]",
    "(?i)(?:projectPath|project_path|project\\s*path)\\s*[:=：]\\s*([^\\n\\r。；;，,]+)",
    "(?i)(?:项目路径|项目目录|项目名|项目名称|所属项目|归属项目|当前项目|项目|工程|产品|仓库|workspace|repo|project)\\s*[:=：]\\s*([^\\n\\r。；;，,]+)",
    "(?i)(?:项目|工程|产品|仓库|workspace|repo|project)[「『《【\"']([^」』》】\"']{2,120})[」』》】\"']",
    "(?i)(?:所属|归属|落到|归到|放到|记录到)\\s*(?:项目|工程|产品|仓库|workspace|repo|project)?\\s*[「『《【\"']([^」』》】\"']{2,120})[」』》】\"']",
]


def project_path(title: Column, content: Column) -> Column:
    """The project that a text says it belongs to."""
    text = F.concat_ws("\n", F.coalesce(title, F.lit("")), content)
    return F.coalesce(*[clean_project(F.nullif(F.regexp_extract(text, p, 1), F.lit(""))) for p in PROJECT_MARKS])


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n|[。！？!?]"), lambda x: F.trim(x)), lambda s: s != "")


def completed(fragment: Column, context: Column) -> Column:
    """The fragment made whole by a sentence of the context that has it: from where it stands, or the whole sentence if it ends so. Null without such evidence; nothing is made up."""
    core = F.regexp_replace(F.trim(fragment), "[，、,。.!！?？:：;；\\s]+$", "")
    long = F.filter(sentences(context), lambda s: (F.length(s) > F.length(core) + 2) & F.contains(s, core))
    tails = F.filter(long, lambda s: F.length(F.trim(F.substring(s, F.instr(s, core) + F.length(core), F.length(s)))) >= 2)
    tail = F.transform(tails, lambda s: F.substring(s, F.instr(s, core), F.length(s)))
    heads = F.filter(long, lambda s: F.endswith(s, core))
    return F.when((F.length(F.trim(fragment)) >= 6) & (F.length(core) >= 6), F.coalesce(F.get(tail, F.lit(0)), F.get(heads, F.lit(0))))
