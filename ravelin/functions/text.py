"""Scalar functions on lines, identifiers, globs and ids, all as JVM expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword tables of the document format.
STEP_WORDS = {"given": ("given ", "假设"), "when": ("when ", "当"), "then": ("then ", "那么"), "and": ("and ", "并且"), "but": ("but ", "但是")}
SECTION_WORDS = {
    "intent": ("意图", "intent"),
    "constraints": ("约束", "constraint"),
    "decisions": ("已定决策", "决策", "decision"),
    "boundaries": ("边界", "boundaries", "boundary"),
    "acceptance": ("验收标准", "acceptance criter", "完成条件", "completion criter"),
    "out_of_scope": ("排除范围", "out of scope"),
    "questions": ("问题", "待澄清", "questions"),
}
SCENARIO_HEADER = r"^(?:场景|示例|例子|(?i:scenario|example))[:：]\s*(.*)$"
RULE_HEADER = r"^(?:规则|(?i:rule))[:：]\s*(.*)$"
NORMATIVE = ["MUST NOT", "SHALL NOT", "SHOULD NOT", "NOT RECOMMENDED", "MUST", "SHALL", "REQUIRED", "SHOULD", "RECOMMENDED", "MAY", "OPTIONAL"]
NORMATIVE_CLASS = {"MUST NOT": "must_not", "SHALL NOT": "must_not", "SHOULD NOT": "should_not", "NOT RECOMMENDED": "should_not", "MUST": "must", "SHALL": "must", "REQUIRED": "must", "SHOULD": "should", "RECOMMENDED": "should", "MAY": "may", "OPTIONAL": "may"}
STOP_WORDS = ["的", "是", "在", "了", "和", "与", "或", "为", "被", "将", "不", "应", "必须", "使用", "所有", "每个", "a", "the", "is", "are", "must", "should", "all", "be", "to", "in", "of", "and", "or", "not", "no", "with", "for", "by"]


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c(x), r"^\s+|\s+$", "")


def unhashed(x: Column | str) -> Column:
    """A heading's text: without the # signs before it."""
    return strip(F.regexp_replace(strip(x), "^#+", ""))


def first_term(x: Column, terms: list[str]) -> Column:
    """The first of ``terms``, in list order, that occurs in ``x``; null if none does."""
    return F.coalesce(*[F.when(F.contains(x, F.lit(t)), F.lit(t)) for t in terms])


def any_term(x: Column, terms: list[str]) -> Column:
    """Whether any of ``terms`` occurs in ``x``; null ``x``: false."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(x, F.lit(t)) for t in terms]), F.lit(False))


def step_kind(line: Column | str) -> Column:
    """given, when, then, and, but; null for other lines.  English words need a space and any case."""
    s = strip(line)
    low = F.lower(s)
    native = F.coalesce(*[F.when(s.startswith(native), F.lit(k)) for k, (_, native) in STEP_WORDS.items()])
    return F.coalesce(native, *[F.when(low.startswith(word), F.lit(k)) for k, (word, _) in STEP_WORDS.items()])


def step_text(line: Column | str) -> Column:
    """The rest of a step line behind its keyword."""
    words = "|".join([n for _, n in STEP_WORDS.values()] + [f"(?i:{w.strip()}) " for w, _ in STEP_WORDS.values()])
    return strip(F.regexp_replace(strip(line), f"^(?:{words})", ""))


def section_kind(line: Column | str) -> Column:
    """The kind of section that a heading opens; null for other headings."""
    low = F.lower(unhashed(line))
    return F.coalesce(*[F.when(reduce(lambda a, b: a | b, [low.startswith(w) for w in words]), F.lit(k)) for k, words in SECTION_WORDS.items()])


def scenario_name(line: Column | str) -> Column:
    """The name behind a scenario header; null for other lines."""
    s = unhashed(line)
    return F.when(s.rlike(SCENARIO_HEADER), strip(F.regexp_extract(s, SCENARIO_HEADER, 1)))


def rule_header(line: Column | str) -> Column:
    """What stands behind a rule header; null for other lines."""
    s = unhashed(line)
    return F.when(s.rlike(RULE_HEADER), strip(F.regexp_extract(s, RULE_HEADER, 1)))


def rule_id(content: Column | str) -> Column:
    """The kebab-case id that a rule header begins with; null if malformed."""
    first = F.regexp_extract(strip(content), r"^([a-z0-9]+(?:-[a-z0-9]+)*)(?:\s*—|\s{2,}|$)", 1)
    return F.when(first != "", first)


def quoted(x: Column | str) -> Column:
    """Texts between straight or curly quotation marks, empty ones dropped."""
    return F.filter(F.regexp_extract_all(c(x), F.lit('["“]([^"“”]*)["”]'), 1), lambda q: q != "")


def identifier_segments(x: Column | str) -> Column:
    """Words of a camel, snake or mixed identifier, in lower case."""
    s = F.regexp_replace(c(x), "([a-z])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, "([A-Z])([A-Z][a-z])", "$1 $2")
    s = F.regexp_replace(s, "([A-Za-z])([0-9])", "$1 $2")
    s = F.regexp_replace(s, "([0-9])([A-Za-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(s, "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")


def normalized_identifier(x: Column | str) -> Column:
    """ASCII letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(c(x), "[^A-Za-z0-9]", ""))


def match_kind(node_id: Column, symbol: Column, query: str) -> Column:
    """How a node matches a query, 600 (same id) down to 100 (part of the bare symbol); null: not at all."""
    q = F.lit(query)
    bare = normalized_identifier(q)
    last = F.element_at(F.split(symbol, "::"), -1)
    words = identifier_segments(q)
    return (
        F.when(node_id == q, 600)
        .when(symbol == q, 500)
        .when((F.lower(node_id) == F.lower(q)) | (F.lower(symbol) == F.lower(q)), 400)
        .when(symbol.endswith("::" + query), 300)
        .when((F.size(words) > 0) & (identifier_segments(last) == words), 200)
        .when((bare != "") & F.contains(normalized_identifier(symbol), bare), 100)
    )


def normative(x: Column | str) -> Column:
    """The class of the earliest normative keyword in ``x`` (ties: list order); null if none."""
    at = [F.struct(F.instr(c(x), k).alias("at"), F.lit(i).alias("i"), F.lit(NORMATIVE_CLASS[k]).alias("k")) for i, k in enumerate(NORMATIVE)]
    return F.array_min(F.filter(F.array(*at), lambda s: s["at"] > 0))["k"]


def normative_count(x: Column | str) -> Column:
    """Whole normative words in ``x``."""
    return F.regexp_count(c(x), F.lit(r"(?<![A-Za-z])(?:MUST|SHALL|SHOULD|MAY|REQUIRED|RECOMMENDED|OPTIONAL)(?![A-Za-z])"))


def id_prefix(line: Column | str) -> Column:
    """The id in ``[ID] text``; null without one."""
    found = F.regexp_extract(strip(line), r"^\[([^\]]+)\]", 1)
    return F.when(found != "", strip(found))


def keywords(x: Column | str, least_bytes: int = 2) -> Column:
    """Words of a constraint that aren't stop words; length counts in bytes."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.split(c(x), r"[\s,、。]"), lambda w: (F.octet_length(w) >= least_bytes) & ~F.array_contains(stop, F.lower(w)))


def _escape(s: Column) -> Column:
    return F.regexp_replace(s, r"([.\\+^$(){}|\[\]])", r"\\$1")


def path_glob(pattern: Column | str) -> Column:
    """Regex of a path pattern by segments: ``*`` within one, ``**`` for any number of whole segments (also none)."""
    p = F.regexp_replace(F.regexp_replace(strip(pattern), "[`\\\\]", ""), "^\\./|/+$", "")
    p = F.replace(_escape(p), F.lit("?"), F.lit("\\?"))
    p = F.regexp_replace(p, r"(^|/)\*\*/", "$1\u0001")
    p = F.regexp_replace(p, r"/\*\*$", "\u0002")
    p = F.regexp_replace(p, r"^\*\*$", "\u0003")
    p = F.regexp_replace(p, r"\*+", "[^/]*")
    p = F.replace(F.replace(F.replace(p, F.lit("\u0001"), F.lit("(?:[^/]+/)*")), F.lit("\u0002"), F.lit("(?:/.*)?")), F.lit("\u0003"), F.lit(".*"))
    return F.concat(F.lit("^"), p, F.lit("$"))


def text_glob(pattern: Column | str) -> Column:
    """Regex of a guidance pattern, by characters: ``*`` and ``?`` stop at ``/``, ``**`` doesn't."""
    p = F.regexp_replace(_escape(c(pattern)), r"\*\*", "\u0001")
    p = F.regexp_replace(F.regexp_replace(p, r"\*", "[^/]*"), r"\?", "[^/]")
    return F.concat(F.lit("^"), F.replace(p, F.lit("\u0001"), F.lit(".*")), F.lit("$"))


def prefix_glob(pattern: str, path: Column) -> Column:
    """Whether a path matches the prefix dialect: ``**``, ``x/**``, ``x**``, ``x*`` or the path itself."""
    if pattern == "**":
        return F.lit(True)
    if pattern.endswith("/**"):
        return path.startswith(pattern[:-2])
    if pattern.endswith("*"):
        return path.startswith(pattern.rstrip("*"))
    return path == pattern


def slug(x: Column | str, prefix: str = "", separator: str = "_") -> Column:
    """ASCII letters and digits in lower case, every other run as one separator, none at the ends."""
    s = F.regexp_replace(F.lower(c(x)), "[^a-z0-9]+", separator)
    return F.concat(F.lit(prefix), F.regexp_replace(s, f"^{separator}+|{separator}+$", ""))


def truncated(x: Column | str, most: int) -> Column:
    """At most ``most`` characters, the last three dots if any were cut off."""
    return F.when(F.length(c(x)) > most, F.concat(F.substring(c(x), 1, most - 3), F.lit("..."))).otherwise(c(x))


def markdown_cell(x: Column | str) -> Column:
    """Text for a table cell: pipes escaped, line ends as spaces."""
    return F.regexp_replace(F.replace(F.coalesce(c(x), F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")


def mermaid_id(x: Column | str) -> Column:
    """A name that a graph text accepts."""
    return F.regexp_replace(c(x), "[^A-Za-z0-9_]", "_")


def file_name(x: Column | str) -> Column:
    """A safe file name: other characters than letters, digits, dot, dash and underscore become underscores."""
    return F.regexp_replace(c(x), r"[^A-Za-z0-9._-]", "_")


def is_literal(x: Column | str) -> Column:
    """Whether a quoted value looks like a literal: a number, digits and dots, an address."""
    return c(x).rlike(r"^[0-9.]+$") | c(x).startswith("http") | F.contains(c(x), F.lit("@"))


def is_hex(x: Column | str, length: int) -> Column:
    return c(x).rlike(f"^[0-9a-f]{{{length}}}$")


def restricted_path(path: Column | str) -> Column:
    """Tests, generated and vendored files, by any component of the path or the file's suffix."""
    return c(path).rlike(r"(^|/)(tests?|generated|gen|vendor|vendored|third_party)(/|$)|_(test|generated)\.[^/]*$")


def query_path(token: Column | str) -> Column:
    """A relative path in a query; null for absolute ones, ones with ``..`` and plain words."""
    t = F.regexp_replace(strip(token), r"^\./", "")
    ok = F.contains(t, F.lit("/")) & ~t.startswith("/") & ~t.rlike(r"(^|/)\.\.(/|$)")
    return F.when(ok, t)


def is_identifier(token: Column | str) -> Column:
    return c(token).rlike(r"^[A-Za-z_][A-Za-z0-9_]*(::[A-Za-z_][A-Za-z0-9_]*)*$")


def line_window(total: Column, start: Column, end: Column, most: int) -> Column:
    """(first, last) of at most ``most`` lines of a file around a span, within the file."""
    first = F.greatest(F.lit(1), start)
    last = F.least(total, F.greatest(end, first), first + F.lit(most - 1))
    return F.struct(first.alias("first"), last.alias("last"))


def retry_delay(attempt: Column | str, base: int = 100, most: int = 30_000, attempts: int = 5) -> Column:
    """Milliseconds before a retry: doubled each time up to ``most``; null outside 1..attempts."""
    a = c(attempt)
    return F.when(a.between(1, attempts), F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2), a - 1)).cast("bigint"))


def summary_counts(x: Column | str) -> Column:
    """(passed, total, failed, skipped) of "3/5 passed, 1 failed, 1 skipped"; null if any part is missing."""
    got = [F.regexp_extract(c(x), p, 1) for p in (r"(\d+)/\d+ passed", r"\d+/(\d+) passed", r"(\d+) failed", r"(\d+) skipped")]
    names = ["passed", "total", "failed", "skipped"]
    ok = reduce(lambda a, b: a & b, [g != "" for g in got])
    return F.when(ok, F.struct(*[F.try_to_number(g, F.lit("999999999")).cast("int").alias(n) for g, n in zip(got, names)]))
