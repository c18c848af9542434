"""Evidence for a question about the program: candidates of several kinds, merged, ordered and fitted into a byte budget."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.operators import graph as G
from ravelin.operators import relational as R
from ravelin.session import cut

# Words for relations, and the order of evidence classes for a question about a symbol.
RELATION_WORDS = {"calls": "calls", "call": "calls", "callers": "callers", "caller": "callers", "callees": "callees", "callee": "callees", "references": "references", "reference": "references", "refs": "references", "uses-type": "uses-type", "implements": "implements", "impl": "implements", "contains": "contains", "containment": "contains"}
CLASS_ORDER = ["named-symbol", "failure-evidence", "primary-spine", "boundary-site", "unique-implementation", "representative-implementation", "relationship", "adjacent-structure", "impact-path", "alternative-path", "off-spine-sibling"]
#: How far impact is followed.
IMPACT_DEPTH = 3
LEAST_BYTES, MOST_BYTES = 1024, 1_000_000


@dataclass
class Intent:
    """What a question names."""

    relations: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    identifiers: list[str] = field(default_factory=list)
    unrecognized: list[str] = field(default_factory=list)


def intent(question: str) -> Intent:
    """The words of a question as relations, relative paths, identifiers and the rest, each once in order."""
    import re

    out = Intent()
    for raw in question.split():
        word = raw.strip(",;()[]")
        if not word:
            continue
        if word.lower() in RELATION_WORDS:
            kind, value = out.relations, RELATION_WORDS[word.lower()]
        elif "/" in word or "\\" in word or word.endswith(".rs"):
            path = re.sub(r"^(\./)+", "", word.replace("\\", "/"))
            bad = path.startswith("/") or ".." in path.split("/") or re.match(r"^[A-Za-z]:", path)
            kind, value = (out.unrecognized, word) if bad else (out.paths, path)
        elif re.fullmatch(r":*[A-Za-z_]\w*(::\w+)*:*", word):
            kind, value = out.identifiers, word.strip(":")
        else:
            kind, value = out.unrecognized, word
        if value not in kind:
            kind.append(value)
    return out


def _evidence(rows: DataFrame, kind: str, score, required: bool, reason: str) -> DataFrame:
    score = F.lit(score) if isinstance(score, int) else score
    return rows.select("id", F.lit(kind).alias("class"), score.cast("int").alias("score"), F.lit(required).alias("required"), F.array(F.lit(reason)).alias("reasons"))


def candidates(hops: DataFrame, nodes: DataFrame, asked: Intent, depth: int = IMPACT_DEPTH) -> DataFrame:
    """(id, class, score, required, reasons): named symbols, their implementations, neighbours and what depends on them.

    Each (id, class) comes once, with its best score and all reasons.  A name
    that no node has gives nothing.
    """
    hops, nodes = cut(hops), cut(nodes)
    score = None
    for name in asked.identifiers:
        kind = T.match_kind(F.col("id"), F.col("symbol"), name)
        own = F.when(kind == 600, 1100).when(kind == 500, 1075).when(kind == 400, 900).when(kind == 300, 850).when(kind == 200, 550).when(kind == 100, 300)
        score = own if score is None else F.greatest(score, own)
    for path in asked.paths:
        own = F.when(F.col("file") == path, 1050)
        score = own if score is None else F.greatest(score, own)
    if score is None:
        score = F.lit(None).cast("int")
    named = cut(nodes.withColumn("_s", score).where(F.col("_s").isNotNull()).select("id", "_s"))
    seeds = named.where(F.col("_s") >= 550).select("id")
    parts = [_evidence(named.where(F.col("_s") >= 550), "named-symbol", F.col("_s"), True, "named"), _evidence(named.where(F.col("_s") < 550), "named-symbol", F.col("_s"), False, "resembles")]
    out = hops.join(seeds.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select(F.col("to_id").alias("id"))
    into = hops.join(seeds.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("id"))
    near = out.unionByName(into).distinct().join(seeds, "id", "left_anti")
    parts.append(_evidence(near, "adjacent-structure", 600, False, "adjacent"))
    impls = hops.where(F.col("kind").isin("impls-trait", "impl-for")).join(seeds.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct()
    stats = impls.agg(F.count("*").alias("n"), F.min("id").alias("first")).first()
    if stats["n"] == 1:
        parts.append(_evidence(impls, "unique-implementation", 950, True, "only implementation"))
    elif stats["n"]:
        first = F.col("id") == F.lit(stats["first"])
        parts += [_evidence(impls.where(first), "representative-implementation", 750, False, "first of several"), _evidence(impls.where(~first), "off-spine-sibling", 350, False, "sibling")]
    reached = G.impact(hops, seeds, depth)
    parts.append(_evidence(reached, "impact-path", F.greatest(F.lit(0), 900 - 75 * F.col("distance")), False, "depends on it"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    keyed = every.withColumn("id", F.struct("id", "class"))
    return R.merge_candidates(keyed).select("id.id", "id.class", "score", "required", "reasons")


def project(rows: DataFrame, sizes: DataFrame, budget: int, threshold: int = 0) -> DataFrame:
    """``rows`` with rank key, bytes and ``state``: kept, below threshold or over budget, in the order required, class, score, id.

    ``sizes``: (id, bytes); unknown ids take none.
    """
    if not LEAST_BYTES <= budget <= MOST_BYTES:
        raise ValueError(f"budget must be {LEAST_BYTES} to {MOST_BYTES}")
    place = F.array_position(F.array(*[F.lit(c) for c in CLASS_ORDER]), F.col("class"))
    order = F.concat_ws("|", F.lpad(place.cast("string"), 2, "0"), F.lpad((F.lit(9999) - F.col("score")).cast("string"), 4, "0"), "id")
    sized = rows.join(sizes.select("id", "bytes"), "id", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0))).withColumn("order", order).withColumn("_all", F.lit("all"))
    relevant = F.col("required") | (F.col("score") >= threshold)
    fitted = R.byte_budget(sized.where(relevant), "_all", "order", "bytes", budget, "required").withColumn("state", F.when(F.col("kept"), "kept").otherwise("over budget")).drop("kept")
    return fitted.unionByName(sized.where(~relevant).withColumn("state", F.lit("below threshold"))).drop("_all")
