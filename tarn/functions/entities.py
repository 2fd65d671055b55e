"""Names of persons, organizations, places, times, events and tools in a text, by patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HAN = "[\\u4e00-\\u9fa5]"
# fixed values: word lists of the entity patterns
ORG_SUFFIXES = ["公司", "集团", "有限公司", "有限责任公司", "股份公司", "工作室", "实验室", "研究所", "研究院", "协会", "联盟", "基金会", "银行", "医院", "大学", "学院", "学校"]
ORG_PREFIXES = ["我们", "我的", "他们", "她的", "他的", "小", "大", "那个", "这个", "某", "一些", "几个", "所有", "整个", "自己", "对方", "其他", "任何", "每个", "各种", "各类"]
NO_ORGS = ["小团队", "大团队", "我们团队", "他们团队", "你们团队", "自己团队", "小部门", "大部门", "我们部门", "某个部门", "整个团队", "整个部门", "小组织", "大组织", "个人开发者", "个人开发者或小团队", "来自个人开发者"]
KNOWN_ORGS = ["腾讯", "阿里", "阿里巴巴", "字节跳动", "字节", "百度", "京东", "美团", "华为", "小米", "微软", "谷歌", "苹果", "亚马逊", "Meta", "OpenAI", "Google", "Microsoft", "Apple", "Amazon", "Tesla", "Nvidia", "Intel", "Samsung"]
TITLES = ["老师", "同学", "先生", "女士", "经理", "总监", "老板", "工程师", "设计师", "教授", "博士", "主任", "院长", "校长", "CEO", "CTO", "CFO", "COO", "VP"]
VERBS = ["说", "觉得", "认为", "表示", "提到", "告诉", "建议", "推荐", "提醒", "指出", "强调", "发现", "提出", "解释", "确认", "否认", "同意", "反对"]
NO_PERSONS = [
    *("问题", "事情", "东西", "地方", "方面", "时候", "方法", "原因", "结果", "情况", "部分", "内容", "关系", "条件", "特点", "功能", "系统", "项目", "产品", "用户", "数据", "信息", "技术", "代码", "文件"),
    *("版本", "模块", "组件", "接口", "服务", "平台", "框架", "工具", "资源", "环境", "配置", "设置", "操作", "过程", "步骤", "方案", "策略", "规则", "模式", "结构", "类型", "状态", "属性", "参数", "变量"),
    *("对象", "实例", "元素", "节点", "标签", "分类", "目录", "路径", "链接", "页面", "视图", "模型", "控制", "逻辑", "算法", "流程", "事件", "请求", "响应", "错误", "异常", "警告", "通知", "消息", "记录"),
    *("日志", "报告", "统计", "分析", "测试", "调试", "部署", "发布", "更新", "升级", "迁移", "重构", "优化", "修复", "合并", "删除", "创建", "添加", "修改", "查询", "搜索", "过滤", "排序", "分组", "计算"),
    *("转换", "处理", "生成", "解析", "验证", "授权", "认证", "加密", "解密", "压缩", "解压", "编码", "解码", "序列化", "反序列化"),
]
PLACES = "北京|上海|广州|深圳|杭州|成都|武汉|南京|西安|重庆|苏州|天津|长沙|郑州|东莞|青岛|沈阳|宁波|昆明|厦门|福州|无锡|合肥|大连|珠海|佛山|济南|哈尔滨|长春|太原|贵阳|南宁|南昌|石家庄|兰州|海口|三亚|香港|澳门|台北"
EVENTS = "会议|大会|峰会|论坛|展览|展会|活动|发布会|研讨会|培训|讲座|沙龙|比赛|竞赛|面试|评审|复盘|回顾|规划|冲刺|迭代|版本发布|上线|发布"
NO_EVENTS = "没有会议|无会议|取消会议|不参加会议|避免活动|停止活动"
TECH = [
    *("React", "Vue", "Angular", "Svelte", "Next.js", "Nuxt", "Gatsby", "Vite", "Webpack", "Tailwind", "Sass", "Less", "Node.js", "Python", "JavaScript", "TypeScript", "Go", "Rust", "Java", "Kotlin", "Swift"),
    *("C\\+\\+", "C#", "Ruby", "PHP", "Dart", "Lua", "R", "Scala", "Elixir", "Haskell", "PostgreSQL", "MySQL", "SQLite", "MongoDB", "Redis", "Elasticsearch", "Cassandra", "CockroachDB", "TiDB", "ClickHouse"),
    *("Docker", "Kubernetes", "Terraform", "AWS", "Azure", "GCP", "GitHub", "GitLab", "Jenkins", "CircleCI", "GraphQL", "REST", "gRPC", "WebSocket", "MQTT", "Linux", "macOS", "Windows", "iOS", "Android"),
    *("Nginx", "Apache", "Caddy", "Git", "SVN", "Mercurial", "Bun", "Deno", "pnpm", "yarn", "npm", "Electron", "Tauri", "Flutter", "React Native", "Unity", "Unreal", "Claude", "GPT", "LLM", "RAG", "Fine-tuning"),
    *("Embedding", "Transformer", "Supabase", "Firebase", "Prisma", "Drizzle"),
]


def _starting(words: list[str]) -> str:
    """Looks at a place's first character before all the words are tried there."""
    return f"(?=[{''.join(sorted({w[0] for w in words if not w[0].islower()}))}]|{'|'.join(sorted({w for w in words if w[0].islower()})) or '(?!)'})"


#: pattern (its first group is the name), type, confidence
PATTERNS = [
    ("@([\\p{L}\\p{N}_]+)", "person", 0.95),
    ("#([\\p{L}\\p{N}_]+)", "concept", 0.9),
    (f"({HAN}{{2,4}})(?:{'|'.join(TITLES)})", "person", 0.85),
    (f"(?:^|[^a-zA-Z\\u4e00-\\u9fa5])({HAN}{{2,3}})(?:{'|'.join(VERBS)})", "person", 0.6),
    (f"{_starting(KNOWN_ORGS)}({'|'.join(KNOWN_ORGS)})", "organization", 0.95),
    (f"({HAN}{{2,8}}(?:{'|'.join(ORG_SUFFIXES)}))", "organization", 0.8),
    (f"({HAN}{{2,6}}(?:省|市|区|县|镇|乡|村|街|路|巷|弄|号|楼|层|室))", "location", 0.85),
    (f"({PLACES})", "location", 0.9),
    ("(\\d{4}年\\d{1,2}月\\d{1,2}日)", "time", 0.95),
    ("(\\d{4}年\\d{1,2}月)", "time", 0.9),
    ("(\\d{4}-\\d{2}-\\d{2})", "time", 0.95),
    ("(今天|昨天|前天|明天|后天|上周|下周|本周|上个月|下个月|今年|去年|前年|明年)", "time", 0.8),
    ("((?:Q[1-4]|第[一二三四]季度)(?:\\s*\\d{4})?)", "time", 0.85),
    (f"{_starting(TECH)}({'|'.join(TECH)})", "tool", 0.9),
    ("https?://([^/:?#\\s@]+)", "tool", 0.7),
]
# a match starts where a run of its characters does, or where the last match ended, so a run is read once
MAIL = "(?:\\G|(?<![\\w.+-]))([\\w.+-]+@[\\w-]+\\.[\\w.-]+)"
EVENT = f"({HAN}{{2,8}}(?:{EVENTS}))"


def _named(names: Column, kind: str, confidence: float, fine=None) -> Column:
    kept = F.filter(names, fine) if fine else names
    return F.transform(kept, lambda x: F.struct(x.alias("name"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence")))


def _no_org(name: Column) -> Column:
    known = reduce(Column.__or__, [F.contains(name, F.lit(o)) for o in KNOWN_ORGS])
    bare = name.rlike(f"^(?:{'|'.join(ORG_PREFIXES)})(?:{'|'.join(ORG_SUFFIXES)})$")
    return reduce(Column.__or__, [F.contains(name, F.lit(x)) for x in NO_ORGS]) | (bare & ~known)


def mentions(text: Column) -> Column:
    """All that the patterns find: an array of name, type, confidence, in the order of the patterns."""
    fine = {"person": lambda x: ~x.isin(NO_PERSONS), "organization": lambda x: ~_no_org(x)}
    none = F.array().cast("array<string>")
    han = text.rlike(HAN)

    def found(p: str, i: int = 1) -> Column:
        """What a pattern finds; a text without what every match holds is not searched."""
        names = F.regexp_extract_all(text, F.lit(p), F.lit(i))
        need = text.contains("@") if "@(" in p or p == MAIL else han if HAN in p or p.strip("(")[0] > "\u4e00" or "年" in p else None
        return names if need is None else F.when(need, names).otherwise(none)

    parts = [_named(found(p), kind, c, fine.get(kind)) for p, kind, c in PATTERNS]
    parts.append(_named(F.transform(found(MAIL), F.lower), "tool", 0.95))
    # an event counts unless its surroundings, 20 characters each way, deny it
    around = f"(?s)(?={HAN}{{3}})(?<=(^.{{0,19}}|.{{20}}))(?=(.{{0,20}})){EVENT}"
    before, after, names = (found(around, i) for i in (1, 2, 3))
    events = F.arrays_zip(F.zip_with(before, after, lambda a, b: F.concat(a, b)).alias("around"), names.alias("name"))
    parts.append(_named(F.transform(F.filter(events, lambda e: ~e["around"].rlike(NO_EVENTS)), lambda e: e["name"]), "event", 0.7))
    return F.concat(*parts)


def entities(rows: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """id, name, type, confidence: each name and type that a text holds, at its greatest confidence."""
    found = rows.select(F.col(id_col).alias("id"), F.explode(mentions(F.col(text_col))).alias("m"))
    return found.groupBy("id", "m.name", "m.type").agg(F.max("m.confidence").alias("confidence"))
