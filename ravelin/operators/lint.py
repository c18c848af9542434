"""Text-quality rules: each a function from a document's tables to diagnostics (doc_id, rule, severity, line_no, detail).

A rule looks for the first term of its list, in list order, as a part of the
text (not as a word); English terms in the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.operators.circles import components
from ravelin.sources import specs

# Term lists of the rules, Chinese first.
VAGUE_VERBS = (["处理", "管理", "支持", "优化", "改善", "增强", "完善"], ["handle", "manage", "support", "process", "optimize", "improve", "enhance"])
UNQUANTIFIED = (["快速", "高效", "及时", "合理", "适当", "足够", "良好"], ["fast", "efficient", "timely", "reasonable", "appropriate", "sufficient", "good", "quickly"])
UNTESTABLE = (["美观", "友好", "直观", "舒适", "合适", "自然"], ["beautiful", "user-friendly", "intuitive", "comfortable", "natural", "clean", "nice"])
NONDETERMINISTIC = (["大约", "大概", "可能", "也许", "随机", "有时"], ["approximately", "roughly", "maybe", "possibly", "random", "sometimes", "might", "could", "about"])
ERROR_TERMS = (["错误", "失败", "拒绝", "异常", "超时", "不存在", "无效", "禁止", "返回错误", "命令失败", "返回 error", "isError"], ["error", "fail", "reject", "invalid", "forbidden", "timeout", "not found", "not exist", "denied", "unauthorized", "4xx", "5xx", "non-2xx", "panic", "abort"])
UNIVERSAL = (["所有入口", "每个入口", "所有二进制", "每个二进制", "所有 bin", "每个 bin", "所有模块", "每个模块", "所有调用方", "每个调用方", "所有实现", "每个实现", "统一行为", "行为一致", "保持一致"], ["all entry points", "every entry point", "all binaries", "every binary", "all callers", "every caller", "all implementations", "every implementation", "all modules", "every module", "consistent behavior", "consistent behaviour", "behave identically", "behave consistently"])
UI_TERMS = (["点击", "输入", "访问", "填写", "选择", "打开页面", "查看页面", "拖拽"], ["click", "type ", "visit", "press ", "data-testid", "css selector", ".class", "#id", "navigate to"])
BUG_HUNTING = (["找出所有", "必须找到", "尽可能多地发现", "不要遗漏任何", "确保发现所有"], ["find all bugs", "find every bug", "must find", "discover as many", "do not miss any", "ensure you find all", "catch all issues", "identify all problems", "find all issues"])
OBSERVABLE = ["stdout", "stderr", "--json", "-o", "--output", "output", "fallback", "precedence", "priority", "cache", "local", "remote", "bundle", "timeout", "env", "force", "冷启动", "缓存", "本地", "远端", "远程", "回退", "优先", "顺序", "输出", "环境变量", "超时"]
DECISION_STOP = [*T.STOP_WORDS, "通过", "可以", "需要", "这个", "那个", "一个", "use", "using", "this", "that", "when", "if", "then", "will", "does", "do", "has", "have", "can"]
# Output modes: (mode, terms that ask for it, terms of a scenario that covers it).
OUTPUT_MODES = [
    ("json", ["--json", "json 输出", "json output", "json mode", "json 模式"], ["--json", "json"]),
    ("file-output", ["-o", "--output", "写文件", "write to file"], ["-o", "--output", "写文件", "write to file", "output path"]),
    ("stdout", ["stdout"], ["stdout"]),
    ("stderr", ["stderr"], ["stderr"]),
    ("human", ["human output", "人类模式", "默认输出"], ["human output", "人类模式", "默认输出"]),
]
ORDER_WORDS = ["fallback", "precedence", "priority", "prefer", "回退", "优先", "顺序"]
ORDER_COVERED = ["fallback", "precedence", "priority", "回退", "优先", "顺序"]
EXTERNAL_IO = ["http", "network", "registry.json", "bundle.tar.gz", "bundle", "filesystem", "file system", "disk", "path", "stdio", "protocol", "json-rpc", "4xx", "5xx", "non-2xx", "timeout", "网络", "文件系统", "磁盘", "路径", "协议", "超时", "4xx/5xx"]
WEAK_IO = ["mock", "mock-only", "inject", "injected", "closure", "stub only", "模拟", "注入", "闭包"]
STRONG_IO = ["fixture", "temp dir", "temporary directory", "local stub", "stub server", "http stub", "filesystem fixture", "real bytes", "真实", "临时目录", "本地 stub", "本地替身", "fixture 文件"]
ENTRY_POINTS = ["bin/", "main.rs", "main.py", "main.ts", "main.go", "index.ts", "index.js", "cli.rs", "server.rs"]
FLAGS = {
    "multiple ids (zh)": ["多个", "多 id", "batch", "多条目"],
    "multiple ids": ["multiple", "multi", "batch", "ids..."],
    "-o/--output": ["-o", "--output", "写文件", "写入文件", "输出到文件", "write to file", "output path"],
    "--full": ["--full", "全部文件", "所有文件", "all files", "full mode"],
    "--json": ["--json", "json 模式", "json 输出", "json mode", "json output"],
}
PLATFORM_TERMS = ["npm", "node_modules", "dist/", "bundled dist", "package.json", "pip", "site-packages", "__pycache__", "setup.py", "cargo install", "crate.io", "gem install", "nuget", "maven", "go install", "apt-get", "brew install"]
PLATFORM_MARKS = ["[js-only]", "[node-only]", "[npm-only]", "[python-only]", "[rust-only]", "[platform-specific]", "[不适用]", "[js 特有]", "[node 特有]", "[python 特有]", "[rust 特有]", "[平台特有]", "不实现", "not applicable", "n/a", "skipped", "跳过"]
CONTRADICTIONS = [("use ", "do not use "), ("使用 ", "不使用 "), ("enable ", "disable "), ("启用", "禁用"), ("allow ", "forbid "), ("允许", "禁止")]

DIMENSIONS = {"vague-verb": "clarity", "unquantified": "clarity", "testability": "testability", "determinism": "determinism", "explicit-test-binding": "testability", "scenario-presence": "coverage", "error-path": "coverage", "coverage": "coverage", "decision-coverage": "coverage", "bdd-scenario-shape": "clarity"}
ALL_DIMENSIONS = ["clarity", "consistency", "coverage", "determinism", "testability"]
COLUMNS = ["doc_id", "rule", "severity", "line_no", "detail"]


def term_in(x: Column, terms: tuple[list[str], list[str]], english_first: bool = False) -> Column:
    """The first listed term in a text; null if none."""
    native, english = T.first_term(x, terms[0]), T.first_term(F.lower(x), terms[1])
    return F.coalesce(english, native) if english_first else F.coalesce(native, english)


def _found(rows: DataFrame, rule: str, severity: str, detail: Column, line: str | None = None) -> DataFrame:
    at = F.col(line).cast("int") if line else F.lit(None).cast("int")
    return rows.select("doc_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), at.alias("line_no"), detail.cast("string").alias("detail")).where(F.col("detail").isNotNull())


def places(docs: DataFrame) -> DataFrame:
    """(doc_id, place, kind, line_no, text): what the term rules look at, in one table.

    place is item (constraints, decisions), intent (a section's whole content) or step.
    """
    rows = specs.section_lines(docs)
    item = T.strip(F.regexp_extract("line", r"^\s*-(.*)$", 1))
    items = rows.where(F.col("kind").isin("constraints", "decisions") & F.col("line").rlike(r"^\s*-") & (item != "")).select("doc_id", F.lit("item").alias("place"), "kind", "line_no", item.alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    intent = rows.where(F.col("kind") == "intent").groupBy("doc_id", "section_no").agg(T.strip(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("text"))
    none = F.lit(None).cast("int")
    steps = specs.steps(docs).select("doc_id", F.lit("step").alias("place"), "kind", none.alias("line_no"), F.col("step").alias("text"))
    return items.unionByName(intent.select("doc_id", F.lit("intent").alias("place"), F.lit("intent").alias("kind"), none.alias("line_no"), "text")).unionByName(steps)


#: Term rules: name -> [(kinds of sections or steps, severity)], terms, English first.
STEP_KINDS = ["given", "when", "then", "and", "but"]
TERM_RULES: dict[str, tuple] = {
    "vague-verb": ([(["constraints"], "warning"), (["intent"], "info")], VAGUE_VERBS, False),
    "unquantified": ([(["constraints"], "warning")], UNQUANTIFIED, False),
    "testability": ([(["then", "and"], "warning")], UNTESTABLE, False),
    "determinism": ([(STEP_KINDS, "warning")], NONDETERMINISTIC, False),
    "sycophancy": ([(["constraints", "intent", *STEP_KINDS], "warning")], BUG_HUNTING, False),
    "bdd-implementation-detail": ([(STEP_KINDS, "info")], UI_TERMS, True),
}


def term_diagnostics(docs: DataFrame, names: list[str]) -> DataFrame:
    """The named term rules in one pass over all places."""
    found = []
    for n in names:
        where, terms, english_first = TERM_RULES[n]
        for kinds, severity in where:
            term = F.when(F.col("kind").isin(kinds), term_in(F.col("text"), terms, english_first))
            found.append(F.struct(F.lit(n).alias("rule"), F.lit(severity).alias("severity"), term.alias("detail")))
    hits = places(docs).select("doc_id", F.col("line_no").cast("int").alias("line_no"), F.explode(F.filter(F.array(*found), lambda f: f["detail"].isNotNull())).alias("_f"))
    return hits.select("doc_id", "_f.rule", "_f.severity", "line_no", "_f.detail")


def task_level(docs: DataFrame) -> DataFrame:
    """The lines of documents whose level is task, as :func:`specs.parsed` tells them."""
    return specs._told(docs).where(F.col("level") == "task")


def scenario_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, scenario_no, t): names and steps of scenarios in lower case."""
    names = specs.scenario_lines(docs).where(F.col("line_no") == F.col("header_line")).select("doc_id", "scenario_no", F.lower("scenario").alias("t"))
    return names.unionByName(specs.steps(docs).select("doc_id", "scenario_no", F.lower("step").alias("t")))


def _with_texts(rows: DataFrame, docs: DataFrame, steps_only: bool = False) -> DataFrame:
    """``rows`` with ``_texts``, all scenario texts of the document (empty without any)."""
    texts = specs.steps(docs).select("doc_id", F.lower("step").alias("t")) if steps_only else scenario_texts(docs)
    whole = texts.groupBy("doc_id").agg(F.collect_set("t").alias("_texts"))
    return rows.join(whole, "doc_id", "left").withColumn("_texts", F.coalesce("_texts", F.array().cast("array<string>")))


def _any(texts: Column, terms: Column) -> Column:
    """Whether any of the texts contains any of the terms (array), case aside."""
    return F.exists(texts, lambda t: F.exists(terms, lambda k: F.contains(t, F.lower(k))))


def _words(terms: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in terms])


def decision_keywords(x: Column) -> Column:
    """Identifiers between backticks, then words of more than two bytes that are no stop words."""
    ticked = F.filter(F.regexp_extract_all(x, F.lit("`([^`]*)`"), 1), lambda k: k != "")
    plain = F.filter(F.split(x, r"[\s,、。`]"), lambda w: (F.octet_length(w) > 2) & ~F.array_contains(_words(DECISION_STOP), F.lower(w)))
    return F.concat(ticked, plain)


def _items(docs: DataFrame, *kinds: str) -> DataFrame:
    return places(docs).where((F.col("place") == "item") & F.col("kind").isin(*kinds)).select("doc_id", "kind", "line_no", "text")


def unbound_scenarios(docs: DataFrame) -> DataFrame:
    return _found(specs.scenarios(task_level(docs)).where(F.col("selector").isNull()), "explicit-test-binding", "error", F.col("scenario"), "line_no")


def missing_scenarios(docs: DataFrame) -> DataFrame:
    """Task documents without any scenario."""
    rows = task_level(docs).where(F.col("line_no") == 1)
    return _found(rows.where(F.col("n_scenarios") == 0), "scenario-presence", "error", F.lit("no scenario"))


def no_error_path(docs: DataFrame) -> DataFrame:
    """Task documents with scenarios of which none speaks of an error (names and steps as they are written)."""
    docs = task_level(docs)
    texts = specs.scenarios(docs).select("doc_id", F.col("scenario").alias("t")).unionByName(specs.steps(docs).select("doc_id", F.col("step").alias("t")))
    per = texts.groupBy("doc_id").agg(F.max(term_in(F.col("t"), ERROR_TERMS).isNotNull().cast("int")).alias("_e"))
    return _found(per.where("_e = 0"), "error-path", "warning", F.lit("no error scenario"))


def universal_claims(docs: DataFrame) -> DataFrame:
    """Universal wording in decisions and constraints of task documents with fewer than two scenarios."""
    few = task_level(docs).where((F.col("line_no") == 1) & (F.col("n_scenarios") < 2)).select("doc_id")
    return _found(_items(docs, "decisions", "constraints").join(few, "doc_id", "left_semi"), "universal-claim", "warning", term_in(F.col("text"), UNIVERSAL), "line_no")


def scenario_shape(docs: DataFrame) -> DataFrame:
    """Scenarios without a when or then step, or beginning with and or but."""
    shape = specs.steps(docs).groupBy("doc_id", "scenario_no", "scenario").agg(F.collect_set("kind").alias("kinds"), F.min_by("kind", "step_no").alias("first"))
    problems = F.array_compact(F.array(F.when(~F.array_contains("kinds", "when"), "no when"), F.when(~F.array_contains("kinds", "then"), "no then"), F.when(F.col("first").isin("and", "but"), "opens with and or but")))
    return _found(shape.withColumn("_p", F.explode(problems)), "bdd-scenario-shape", "warning", F.concat_ws(": ", "scenario", "_p"))


def malformed_rules(docs: DataFrame) -> DataFrame:
    return _found(specs.rules(docs).where(F.col("rule").isNull()), "bdd-rule-id", "error", F.col("content"), "line_no")


def empty_rules(docs: DataFrame) -> DataFrame:
    """Rules that no scenario belongs to, other than in capability documents."""
    lines = specs._told(docs).where(F.coalesce(F.col("level"), F.lit("")) != "capability")
    named = specs.rules(lines).where(F.col("rule").isNotNull())
    return _found(named.join(specs.scenarios(docs).select("doc_id", "rule").distinct(), ["doc_id", "rule"], "left_anti"), "bdd-rule-grouping", "warning", F.col("rule"), "line_no")


def ungrouped_scenarios(docs: DataFrame) -> DataFrame:
    """Three scenarios or more without a rule, where a document has no rules."""
    loose = specs.scenarios(docs).where(F.col("rule").isNull()).groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n >= 3")
    ruled = specs.rules(docs).where(F.col("rule").isNotNull()).select("doc_id").distinct()
    return _found(loose.join(ruled, "doc_id", "left_anti"), "bdd-rule-grouping", "info", F.concat(F.col("_n").cast("string"), F.lit(" scenarios")))


def unresolved_questions(docs: DataFrame) -> DataFrame:
    return _found(specs.open_questions(docs), "open-question", "warning", F.col("question"), "line_no")


def uncovered_constraints(docs: DataFrame) -> DataFrame:
    """Constraints none of whose keywords occurs in a step."""
    rows = _with_texts(_items(docs, "constraints"), docs, steps_only=True).withColumn("_k", T.keywords("text"))
    return _found(rows.where((F.size("_k") > 0) & ~_any(F.col("_texts"), F.col("_k"))), "coverage", "warning", F.col("text"), "line_no")


def uncovered_decisions(docs: DataFrame) -> DataFrame:
    """Decisions of task documents none of whose keywords occurs in a step or scenario name."""
    docs = task_level(docs)
    rows = _with_texts(_items(docs, "decisions"), docs).withColumn("_k", decision_keywords(F.col("text")))
    return _found(rows.where((F.size("_k") > 0) & ~_any(F.col("_texts"), F.col("_k"))), "decision-coverage", "warning", F.col("text"), "line_no")


def uncovered_observables(docs: DataFrame) -> DataFrame:
    """Decisions of task documents on visible behaviour of which no scenario speaks."""
    docs = task_level(docs)
    rows = _with_texts(_items(docs, "decisions").where(T.any_term(F.lower("text"), OBSERVABLE)), docs)
    return _found(rows.where(~_any(F.col("_texts"), decision_keywords(F.col("text")))), "observable-decision-coverage", "warning", F.col("text"), "line_no")


def uncovered_modes(docs: DataFrame) -> DataFrame:
    """Output modes that a task document's intent, constraints or decisions name and no scenario covers; one diagnostic per document."""
    docs = task_level(docs)
    text = F.lower("text")
    asked = F.array_compact(F.array(*[F.when(T.any_term(text, ask), F.lit(mode)) for mode, ask, _ in OUTPUT_MODES]))
    named = places(docs).where(F.col("place") != "step").select("doc_id", F.explode(asked).alias("_m")).groupBy("doc_id").agg(F.collect_set("_m").alias("_asked"))
    rows = _with_texts(named, docs)
    missing = F.array_compact(F.array(*[F.when(F.array_contains("_asked", mode) & ~_any(F.col("_texts"), _words(cover)), F.lit(mode)) for mode, _, cover in OUTPUT_MODES]))
    return _found(rows.withColumn("_m", missing).where(F.size("_m") > 0), "output-mode-coverage", "warning", F.array_join("_m", ", "))


def uncovered_orders(docs: DataFrame) -> DataFrame:
    """Decisions and constraints of task documents that state an order which no scenario verifies."""
    docs = task_level(docs)
    chain = F.filter(F.transform(F.split("text", "->"), lambda x: F.lower(T.strip(x))), lambda x: x != "")
    words = F.slice(F.filter(decision_keywords(F.col("text")), lambda w: F.octet_length(w) > 2), 1, 4)
    terms = F.when(F.contains("text", F.lit("->")) & (F.size(chain) >= 2), chain).when(T.any_term(F.lower("text"), ORDER_WORDS) & (F.size(words) >= 2), words)
    rows = _with_texts(_items(docs, "decisions", "constraints").withColumn("_terms", terms).where(F.col("_terms").isNotNull()), docs)
    held = F.exists("_texts", lambda t: (F.size(F.filter("_terms", lambda k: F.contains(t, k))) >= 2) | F.exists(_words(ORDER_COVERED), lambda w: F.contains(t, w)))
    return _found(rows.where(~held), "precedence-fallback-coverage", "warning", F.col("text"), "line_no")


def _io_scenarios(docs: DataFrame) -> DataFrame:
    """(doc_id, scenario_no, scenario, line_no, _blob, fields): scenarios of task documents that speak of files, networks and the like."""
    docs = task_level(docs)
    blob = scenario_texts(docs).groupBy("doc_id", "scenario_no").agg(F.array_join(F.collect_list("t"), " ").alias("_blob")).where(T.any_term(F.col("_blob"), EXTERNAL_IO))
    named = specs.scenarios(docs).select("doc_id", "scenario_no", "scenario", "line_no", "selector").join(specs.selector_fields(docs).drop("scenario"), ["doc_id", "scenario_no"])
    return blob.join(named, ["doc_id", "scenario_no"])


def weak_io_errors(docs: DataFrame) -> DataFrame:
    """Scenarios on failing I/O whose text or test selector names a mock and no real boundary."""
    rows = _io_scenarios(docs)
    label = F.lower(F.concat_ws(" ", "selector", "package", "filter", "level", "test_double", "targets"))
    both = F.concat_ws(" ", "_blob", label)
    failing = T.any_term(F.col("_blob"), [t.lower() for t in (*ERROR_TERMS[1], *ERROR_TERMS[0])])
    return _found(rows.where(failing & T.any_term(both, WEAK_IO) & ~T.any_term(both, STRONG_IO)), "external-io-error-strength", "warning", F.col("scenario"), "line_no")


def io_without_metadata(docs: DataFrame) -> DataFrame:
    """Scenarios on I/O whose selector says neither level, test double nor targets."""
    rows = _io_scenarios(docs).where(F.col("level").isNull() & F.col("test_double").isNull() & F.col("targets").isNull())
    return _found(rows, "verification-metadata-suggestion", "warning", F.col("scenario"), "line_no")


def unnamed_entry_points(docs: DataFrame) -> DataFrame:
    """Allowed entry points of task documents that list two or more, which no scenario names (by file name, or stem of more than two bytes)."""
    docs = task_level(docs)
    points = specs.boundaries(docs).where((F.col("category") == "allow") & T.any_term(F.lower("item"), ENTRY_POINTS))
    many = points.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n >= 2").select("doc_id")
    last = F.lower(F.regexp_replace(F.regexp_extract("item", r"([^/]*)$", 1), r"\**\.*$", ""))
    stem = F.regexp_extract(last, r"^([^.]*)", 1)
    rows = _with_texts(points.join(many, "doc_id", "left_semi").withColumn("_last", last).withColumn("_stem", stem), docs).where((F.col("_last") != "") | (F.col("_stem") != ""))
    named = F.exists("_texts", lambda t: ((F.col("_last") != "") & F.contains(t, F.col("_last"))) | ((F.octet_length("_stem") > 2) & F.contains(t, F.col("_stem"))))
    return _found(rows.where(~named), "boundary-entry-point", "warning", F.col("item"), "line_no")


def untested_flag_combinations(docs: DataFrame) -> DataFrame:
    """Task documents whose decisions and constraints name two flags or more, and no scenario two of them together."""
    docs = task_level(docs)
    of = lambda x: F.array_compact(F.array(*[F.when(T.any_term(F.lower(x), terms), F.lit(flag)) for flag, terms in FLAGS.items()]))
    named = _items(docs, "decisions", "constraints").select("doc_id", F.explode(of(F.col("text"))).alias("_f")).groupBy("doc_id").agg(F.array_sort(F.collect_set("_f")).alias("_flags")).where(F.size("_flags") >= 2)
    used = scenario_texts(docs).select("doc_id", "scenario_no", F.explode(of(F.col("t"))).alias("_f")).groupBy("doc_id", "scenario_no").agg(F.collect_set("_f").alias("_used"))
    held = named.join(used, "doc_id").where(F.size(F.array_intersect("_flags", "_used")) >= 2).select("doc_id").distinct()
    return _found(named.join(held, "doc_id", "left_anti"), "flag-combination-coverage", "warning", F.array_join("_flags", ", "))


def untagged_platforms(docs: DataFrame) -> DataFrame:
    """Decisions of task documents that name a platform's own tools and don't say so."""
    rows = _items(task_level(docs), "decisions").where(~T.any_term(F.lower("text"), PLATFORM_MARKS))
    return _found(rows, "platform-decision-tag", "info", T.first_term(F.lower("text"), PLATFORM_TERMS), "line_no")


def circular_dependencies(docs: DataFrame) -> DataFrame:
    """Scenarios that depend on themselves, over names within a document."""
    rows = specs.scenarios(docs).select("doc_id", "scenario", F.explode("depends_on").alias("_d"))
    key = lambda c: F.concat_ws("\x1f", F.col("doc_id").cast("string"), c)
    known = specs.scenarios(docs).select(key("scenario").alias("node"), "doc_id", "scenario", "line_no")
    found = components(rows.select(key("scenario").alias("a"), key("_d").alias("b")))
    return _found(known.join(found, "node"), "circular-dependency", "error", F.col("scenario"), "line_no")


def decision_contradictions(docs: DataFrame) -> DataFrame:
    """(positive, word, n_allow, n_deny, allow_line, deny_line): decisions of which some say a thing and others its negation on a shared word of more than three bytes.

    Counts and representatives (smallest document and line of each side) per
    pair of wordings and word, so no pair of documents is listed.  A text that
    holds the negation holds the plain wording as well, where that is a part
    of it; it counts for both sides, as either may contradict another.
    """
    text = F.lower("text")
    sides = F.array_compact(F.array(*[x for pos, neg in CONTRADICTIONS for x in (F.when(F.contains(text, F.lit(pos)), F.struct(F.lit(pos).alias("positive"), F.lit(1).alias("side"))), F.when(F.contains(text, F.lit(neg)), F.struct(F.lit(pos).alias("positive"), F.lit(0).alias("side"))))]))
    words = F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: F.octet_length(w) > 3))
    rows = _items(docs, "decisions").select("doc_id", "line_no", F.explode(sides).alias("_s"), words.alias("_w")).select("doc_id", "line_no", "_s.*", F.explode("_w").alias("word"))
    at = F.struct("doc_id", "line_no")
    side = lambda k: F.when(F.col("side") == k, at)
    out = rows.groupBy("positive", "word").agg(F.count(side(1)).alias("n_allow"), F.count(side(0)).alias("n_deny"), F.min(side(1)).alias("_a"), F.min(side(0)).alias("_d"), F.count_distinct("doc_id", "line_no").alias("_n"))
    return out.where((F.col("n_allow") > 0) & (F.col("n_deny") > 0) & (F.col("_n") > 1)).select("positive", "word", "n_allow", "n_deny", F.col("_a.doc_id").alias("allow_doc"), F.col("_d.doc_id").alias("deny_doc"))


def unbound_params(docs: DataFrame) -> DataFrame:
    """Quoted values of when, then steps that no given or and step before binds and that look like no literal."""
    rows = specs.steps(docs)
    bound = rows.where(F.col("kind").isin("given", "and")).groupBy("doc_id", "scenario_no").agg(F.flatten(F.collect_list("params")).alias("_bound"))
    used = rows.where(F.col("kind").isin("when", "then")).select("doc_id", "scenario_no", F.explode("params").alias("p"))
    free = used.join(bound, ["doc_id", "scenario_no"], "left").where(~F.array_contains(F.coalesce("_bound", F.array().cast("array<string>")), F.col("p")) & ~T.is_literal("p"))
    return _found(free.distinct(), "implicit-dep", "warning", F.col("p"))


def clause_rules(docs: DataFrame) -> DataFrame:
    """Requirement clauses without an id or keyword, and those that say several things at once."""
    rows = specs.clauses(docs)
    problem = F.array_compact(F.array(F.when(F.col("clause_id").isNull(), "requirement-id"), F.when(F.col("keyword").isNull(), "requirement-keyword"), F.when(F.col("n_keywords") > 1, "requirement-single-statement")))
    out = rows.withColumn("rule", F.explode(problem))
    return out.select("doc_id", "rule", F.lit("warning").alias("severity"), "line_no", F.col("clause").alias("detail"))


#: Extension point: name -> function from documents (doc_id, text) or parsed lines to diagnostics, in order of registration.
RULES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "explicit-test-binding": unbound_scenarios,
    "scenario-presence": missing_scenarios,
    "error-path": no_error_path,
    "universal-claim": universal_claims,
    "bdd-scenario-shape": scenario_shape,
    "bdd-rule-id": malformed_rules,
    "bdd-rule-grouping": lambda d: empty_rules(d).unionByName(ungrouped_scenarios(d)),
    "open-question": unresolved_questions,
    "implicit-dep": unbound_params,
    "coverage": uncovered_constraints,
    "decision-coverage": uncovered_decisions,
    "observable-decision-coverage": uncovered_observables,
    "output-mode-coverage": uncovered_modes,
    "precedence-fallback-coverage": uncovered_orders,
    "external-io-error-strength": weak_io_errors,
    "verification-metadata-suggestion": io_without_metadata,
    "boundary-entry-point": unnamed_entry_points,
    "flag-combination-coverage": untested_flag_combinations,
    "platform-decision-tag": untagged_platforms,
    "circular-dependency": circular_dependencies,
    "requirement-clauses": clause_rules,
}


def register(name: str, rule: Callable[[DataFrame], DataFrame]) -> None:
    """Adds a rule of the user's own."""
    RULES[name] = rule


def lint(docs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Diagnostics of the named rules (all) over all documents, which are parsed once for all rules."""
    names = list(names or [*TERM_RULES, *RULES])
    docs = specs.parsed(docs)
    terms = [n for n in names if n in TERM_RULES]
    parts = [term_diagnostics(docs, terms)] if terms else []
    return reduce(DataFrame.unionByName, parts + [RULES[n](docs) for n in names if n not in TERM_RULES])


def split_acknowledged(diagnostics: DataFrame, acks: DataFrame) -> DataFrame:
    """The diagnostics with ``acknowledged``: those that aren't errors and whose rule their document acknowledges."""
    codes = acks.select("doc_id", F.col("code").alias("rule"), F.lit(True).alias("_ack")).distinct()
    return diagnostics.join(codes, ["doc_id", "rule"], "left").withColumn("acknowledged", F.coalesce("_ack", F.lit(False)) & (F.col("severity") != "error")).drop("_ack")


def quality(docs: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(doc_id, determinism, testability, coverage, overall): shares without issues, from all diagnostics; their plain mean overall.

    Determinism is 0 without scenarios, testability 0 without steps, coverage 1 without items.
    """
    per = diagnostics.groupBy("doc_id").agg(*[F.count(F.when(F.col("rule") == r, 1)).alias(a) for r, a in (("determinism", "_d"), ("testability", "_t"), ("coverage", "_c"))])
    scen = specs.scenarios(docs).groupBy("doc_id").agg(F.count("*").alias("_ns"))
    stp = specs.steps(docs).groupBy("doc_id").agg(F.count("*").alias("_nt"))
    con = specs.constraints(docs).groupBy("doc_id").agg(F.count("*").alias("_nc"))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id").join(per, "doc_id", "left").join(scen, "doc_id", "left").join(stp, "doc_id", "left").join(con, "doc_id", "left").na.fill(0)
    share = lambda bad, n, empty: F.when(F.col(n) == 0, F.lit(empty)).otherwise(F.greatest(F.lit(0.0), 1 - F.col(bad) / F.col(n)))
    rows = rows.select("doc_id", share("_d", "_ns", 0.0).alias("determinism"), share("_t", "_nt", 0.0).alias("testability"), share("_c", "_nc", 1.0).alias("coverage"))
    return rows.withColumn("overall", (F.col("determinism") + F.col("testability") + F.col("coverage")) / 3)


def dimension_counts(diagnostics: DataFrame) -> DataFrame:
    """(dimension, n) for all five dimensions, 0 where there is nothing; unknown rules count as consistency."""
    spark = diagnostics.sparkSession
    pairs = [x for kv in DIMENSIONS.items() for x in map(F.lit, kv)]
    seen = diagnostics.select(F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("rule")), F.lit("consistency")).alias("dimension")).groupBy("dimension").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(d,) for d in ALL_DIMENSIONS], "dimension string")
    return every.join(seen, "dimension", "left").select("dimension", F.coalesce("n", F.lit(0)).alias("n"))


def audit(docs: DataFrame) -> DataFrame:
    """One row: documents, rules, scenarios, rules without scenario, ungrouped scenarios, open questions, malformed rules."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    s = specs.scenarios(docs)
    parts = [count(docs.where(F.col("text").isNotNull()), "n_docs"), count(specs.rules(docs).where(F.col("rule").isNotNull()), "n_rules"), count(s, "n_scenarios"), count(empty_rules(docs), "n_unproven_rules"), count(s.where(F.col("rule").isNull()), "n_ungrouped"), count(specs.open_questions(docs), "n_questions"), count(malformed_rules(docs), "n_malformed")]
    return _side_by_side(parts)


def _side_by_side(parts: list[DataFrame]) -> DataFrame:
    """One-row frames as one row."""
    keyed = [p.withColumn("_one", F.lit(1)) for p in parts]
    return reduce(lambda a, b: a.join(b, "_one"), keyed).drop("_one")
