"""Contract and requirement texts as tables: lines, front matter, sections, lists, scenarios, steps, clauses.

Everything is windows over a document's lines, so a document is never read into
one row of Python.  ``docs`` always has doc_id and text; null texts have no
lines.  A line belongs to the last heading before it.  Every function also takes
what :func:`parsed` returns: then lines, sections and scenarios are told once for
all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.session import cut

#: Extension of source files that the tree scan takes.
SOURCE_GLOB = "*.rs"


def read_texts(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, text) of all files of a folder and its subfolders, each whole."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_source_tree(spark: SparkSession, folder: str, exclude: str = r"(^|/)(target|vendor|\.git)(/|$)", glob: str = SOURCE_GLOB) -> DataFrame:
    """(path, hash, n_bytes) of the source files under a folder, without excluded paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.where(~F.col("path").rlike(exclude)).select("path", F.sha2("content", 256).alias("hash"), F.col("length").alias("n_bytes"))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) from 1."""
    if "scenario_no" in docs.columns:
        return docs.select("doc_id", "line_no", "line")
    split = docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("_i", "line"))
    return split.select("doc_id", (F.col("_i") + 1).alias("line_no"), "line")


def _so_far() -> Window:
    return Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)


def front_matter(docs: DataFrame) -> DataFrame:
    """(doc_id, key, value): the ``key: value`` lines before the separator ``---``; without a separator there are none.

    A separator on the first line only opens the front matter.  Quotation
    marks around a value are dropped; a key given twice keeps its last value.
    """
    rows = lines(docs).withColumn("_mark", (T.strip("line") == "---") & (F.col("line_no") > 1))
    rows = rows.withColumn("_seen", F.sum(F.col("_mark").cast("int")).over(_so_far())).withColumn("_any", F.max(F.col("_mark").cast("int")).over(Window.partitionBy("doc_id")))
    pairs = rows.where((F.col("_seen") == 0) & (F.col("_any") == 1) & F.col("line").rlike(r"^\s*[A-Za-z_]+\s*:"))
    key, value = F.lower(T.strip(F.regexp_extract("line", r"^\s*([A-Za-z_]+)\s*:", 1))), T.strip(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    kept = pairs.select("doc_id", key.alias("key"), F.regexp_replace(value, '^"(.*)"$', "$1").alias("value"), "line_no")
    return kept.groupBy("doc_id", "key").agg(F.max_by("value", "line_no").alias("value"))


def spec_meta(docs: DataFrame) -> DataFrame:
    """One row per document with front matter: level, kind, id, name, status, risk, tags, satisfies (upper case)."""
    get = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    listed = lambda x, up=False: F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\[\]]", ""), ","), lambda t: F.upper(T.strip(t)) if up else T.strip(t)), lambda t: t != "")
    return front_matter(docs).groupBy("doc_id").agg(get("spec").alias("level"), get("kind").alias("kind"), get("id").alias("id"), F.coalesce(get("name"), get("title")).alias("name"), get("status").alias("status"), get("risk").alias("risk"), listed(get("tags")).alias("tags"), listed(get("satisfies"), True).alias("satisfies"), listed(get("depends")).alias("depends"))


def _told(docs: DataFrame) -> DataFrame:
    """Every line with its section, scenario, rule and the document's level; all over one ordering of a document's lines."""
    if "scenario_no" in docs.columns:
        return docs
    rows = lines(docs).withColumn("head", F.col("line").rlike(r"^\s*##?\s+\S")).withColumn("_name", T.scenario_name("line")).withColumn("_rule", T.rule_header("line"))
    stop = F.col("head") & F.col("_name").isNull() & F.col("_rule").isNull()
    begins = F.col("_name").isNotNull() | stop | F.col("_rule").isNotNull()
    state = F.when(begins, F.struct(F.col("_name").alias("name"), F.col("line_no").alias("at")))
    group = F.when(F.col("_rule").isNotNull(), F.struct(T.rule_id("_rule").alias("id"))).when(stop, F.struct(F.lit(None).cast("string").alias("id")))
    so_far, doc = _so_far(), Window.partitionBy("doc_id")
    mark = (T.strip("line") == "---") & (F.col("line_no") > 1)
    rows = rows.withColumn("_mark", F.min(F.when(mark, F.col("line_no"))).over(doc))
    level = F.when((F.col("line_no") < F.col("_mark")) & F.col("line").rlike(r"^\s*(?i:spec)\s*:"), F.struct("line_no", F.lower(T.strip(F.regexp_replace(F.regexp_extract("line", r"^[^:]*:(.*)$", 1), '"', ""))).alias("v")))
    rows = rows.select(
        "doc_id", "line_no", "line", "head",
        F.sum(F.col("head").cast("int")).over(so_far).alias("section_no"),
        F.last(F.when(F.col("head"), T.unhashed("line")), ignorenulls=True).over(so_far).alias("heading"),
        F.sum(F.col("_name").isNotNull().cast("int")).over(so_far).alias("scenario_no"),
        F.last(state, ignorenulls=True).over(so_far).alias("_state"),
        F.last(group, ignorenulls=True).over(so_far)["id"].alias("rule"),
        F.max(level).over(doc).alias("_level"),
        F.count("_name").over(doc).alias("n_scenarios"),
    )
    return rows.select("doc_id", "line_no", "line", "head", "section_no", "heading", T.section_kind("heading").alias("kind"), "scenario_no", F.col("_state.name").alias("scenario"), F.col("_state.at").alias("header_line"), "rule", F.col("_level.v").alias("level"), "n_scenarios")


def parsed(docs: DataFrame) -> DataFrame:
    """All lines with what they belong to, written once; every function of this module takes it in place of documents.

    The level is that of the ``spec`` line before the separator, null without one.
    """
    return cut(_told(docs))


def section_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, section_no, heading, kind, line_no, line) of the lines below second-level headings, headings left out."""
    return _told(docs).where(~F.col("head") & (F.col("section_no") > 0)).select("doc_id", "section_no", "heading", "kind", "line_no", "line")


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section_no, heading, kind, n_lines): non-blank lines of each section with any."""
    rows = section_lines(docs).where(T.strip("line") != "")
    return rows.groupBy("doc_id", "section_no", "heading", "kind").agg(F.count("*").alias("n_lines"))


def list_items(docs: DataFrame, kind: str, categories: list[tuple[str, str]], default: str = "general") -> DataFrame:
    """(doc_id, line_no, category, item) of a section's list; a sub-heading sets the category until the next that names one.

    ``categories``: (regex over the sub-heading in lower case, category), the first that matches counts.
    """
    rows = section_lines(docs).where(F.col("kind") == kind)
    sub = T.strip("line").startswith("###")
    low = F.lower(T.unhashed("line"))
    named = F.when(sub, F.coalesce(*[F.when(low.rlike(p), F.lit(v)) for p, v in categories])) if categories else F.lit(None).cast("string")
    over = Window.partitionBy("doc_id", "section_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("category", F.coalesce(F.last(named, ignorenulls=True).over(over), F.lit(default)))
    item = T.strip(F.regexp_extract("line", r"^\s*-(.*)$", 1))
    return rows.where(F.col("line").rlike(r"^\s*-") & (item != "")).select("doc_id", "line_no", "category", item.alias("item"))


CONSTRAINT_CATEGORIES = [("必须做", "must"), ("^(?!.*not).*must", "must"), ("禁止|must not", "must_not"), ("已定|decided", "decided")]
BOUNDARY_CATEGORIES = [("允许修改|allow(?<!disallow)", "allow"), ("禁止|forbidden|must not|disallow", "deny"), ("symbols|符号", "symbols")]


def constraints(docs: DataFrame) -> DataFrame:
    return list_items(docs, "constraints", CONSTRAINT_CATEGORIES)


def boundaries(docs: DataFrame) -> DataFrame:
    return list_items(docs, "boundaries", BOUNDARY_CATEGORIES)


def decisions(docs: DataFrame) -> DataFrame:
    return list_items(docs, "decisions", []).drop("category")


def scenario_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, scenario_no, scenario, header_line, rule, line_no, line) of the lines below scenario headers."""
    return _told(docs).where(F.col("scenario").isNotNull()).select("doc_id", "scenario_no", "scenario", "header_line", "rule", "line_no", "line")


#: Fields below a scenario's test line: name -> words before the colon (fixed values).
SELECTOR_FIELDS = {"package": "package|包", "filter": "filter|过滤", "level": "level|层级", "test_double": "test double|替身", "targets": "targets|命中"}


def selector_fields(docs: DataFrame) -> DataFrame:
    """(doc_id, scenario_no, scenario, package, filter, level, test_double, targets) of every scenario; null where a field is missing, the last line of a field counts."""
    of = lambda words: F.max_by(F.when(T.unhashed("line").rlike(f"^(?i:{words})[:：]"), T.strip(F.regexp_extract("line", r"^[^:：]*[:：](.*)$", 1))), F.when(T.unhashed("line").rlike(f"^(?i:{words})[:：]"), F.col("line_no")))
    return scenario_lines(docs).groupBy("doc_id", "scenario_no", "scenario").agg(*[of(words).alias(name) for name, words in SELECTOR_FIELDS.items()])


def scenarios(docs: DataFrame) -> DataFrame:
    """(doc_id, scenario_no, scenario, rule, line_no, selector, tags, review, mode, depends_on, n_steps) of every scenario."""
    rows = scenario_lines(docs)
    field = lambda words: F.max(F.when(T.strip("line").rlike(f"^(?i:{words})[:：]"), T.strip(F.regexp_extract("line", r"^[^:：]*[:：](.*)$", 1))))
    listed = lambda x: F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), T.strip), lambda t: t != "")
    is_step = (F.col("line_no") > F.col("header_line")) & T.step_kind("line").isNotNull()
    out = rows.groupBy("doc_id", "scenario_no", "scenario", "rule", F.col("header_line").alias("line_no_")).agg(
        F.nullif(field("test|测试"), F.lit("")).alias("selector"), listed(field("tags?|标签")).alias("tags"), field("review|审核").alias("review"), F.coalesce(field("mode|模式"), F.lit("standard")).alias("mode"), listed(field("depends|依赖")).alias("depends_on"), F.count(F.when(is_step, 1)).alias("n_steps")
    )
    return out.withColumnRenamed("line_no_", "line_no")


def steps(docs: DataFrame) -> DataFrame:
    """(doc_id, scenario_no, scenario, step_no, kind, step, params): the step lines of scenarios."""
    rows = scenario_lines(docs).where(F.col("line_no") > F.col("header_line")).withColumn("kind", T.step_kind("line")).where(F.col("kind").isNotNull())
    order = Window.partitionBy("doc_id", "scenario_no").orderBy("line_no")
    return rows.select("doc_id", "scenario_no", "scenario", F.row_number().over(order).alias("step_no"), "kind", T.step_text("line").alias("step"), T.quoted("line").alias("params"))


def rules(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, content, rule): rule headers; ``rule`` is null where the id is malformed."""
    rows = lines(docs).withColumn("content", T.rule_header("line")).where(F.col("content").isNotNull())
    return rows.select("doc_id", "line_no", "content", T.rule_id("content").alias("rule"))


def lint_acks(docs: DataFrame) -> DataFrame:
    """(doc_id, code, reason) of the comments ``<!-- lint-ack: code — reason -->``."""
    pattern = r"<!--\s*lint-ack:\s*([a-z0-9-]+)\s*(?:—|:)?\s*(.*?)\s*-->"
    rows = lines(docs).where(F.col("line").rlike(pattern))
    return rows.select("doc_id", F.regexp_extract("line", pattern, 1).alias("code"), F.regexp_extract("line", pattern, 2).alias("reason"))


def clauses(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, clause_id, keyword, n_keywords, clause): the lines of the requirements section."""
    rows = section_lines(docs).where((F.lower("heading") == "requirements") & (T.strip("line") != "") & ~T.strip("line").startswith("<!--"))
    rest = T.strip(F.regexp_replace("line", r"^\s*\[[^\]]+\]", ""))
    return rows.select("doc_id", "line_no", T.id_prefix("line").alias("clause_id"), T.normative("line").alias("keyword"), T.normative_count("line").alias("n_keywords"), rest.alias("clause"))


def open_questions(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, question) of the questions that carry no mark of being resolved."""
    rows = section_lines(docs).where(F.lower("heading").isin("open questions", "questions") & (T.strip("line") != ""))
    item = T.strip(F.regexp_replace("line", r"^\s*-", ""))
    return rows.where(~F.lower(item).rlike(r"^\[x\]|\(resolved\)|^~~|已解决")).select("doc_id", "line_no", item.alias("question"))


def referenced_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, ref_id): the distinct requirement-like ids that a text names."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z]+(?:-[A-Z]+)*-\d+)\b"), 1))
    return docs.where(F.col("text").isNotNull()).select("doc_id", F.explode(found).alias("ref_id"))


def test_functions(docs: DataFrame) -> DataFrame:
    """(doc_id, name): functions whose definition follows a test attribute in source text."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines(docs).where(T.strip("line") != "").withColumn("_before", F.lag("line").over(order))
    name = F.regexp_extract("line", r"fn\s+([A-Za-z_0-9]+)", 1)
    return rows.where(F.col("_before").rlike(r"#\[(\w+::)?test\b") & (name != "")).select("doc_id", name.alias("name")).distinct()


def numstat(rows: DataFrame) -> DataFrame:
    """(doc_id, added, deleted): sums over numstat lines in ``text``; binary files (``-``) count nothing."""
    cells = lines(rows).select("doc_id", F.split("line", "\t").alias("c")).where(F.size("c") >= 3)
    number = lambda i: F.sum(F.coalesce(F.get("c", F.lit(i)).try_cast("bigint"), F.lit(0)))
    return cells.groupBy("doc_id").agg(number(0).alias("added"), number(1).alias("deleted"))
