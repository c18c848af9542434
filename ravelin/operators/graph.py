"""The program graph: current nodes, edge targets, lookups, ranked search, paths, impact, layers.

Traversals are joins of a frontier with the edges, cut after each step; only
counts come to the driver.  A visited node is never expanded again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.functions.ids import clean_id
from ravelin.operators.eager import edge_targets
from ravelin.session import cut, salted_join
from ravelin.sources.tables import earliest

#: Kinds that lead back from a change to what depends on it (fixed values).
DEPENDENCY_KINDS = ["calls", "references", "uses-type", "impls-trait", "impl-for"]
PROVENANCE = ["syn", "scip", "mir"]
#: A node with more than so many starts before it and ends behind it is a hub in :func:`best_two_hops`.
HUB = 64
#: Starts, and ends, in a cell of their product.
CELL = 512


def current_nodes(nodes: DataFrame, shared: DataFrame | None = None, more: list[str] = ()) -> DataFrame:
    """(id, symbol, kind, file, line_start, line_end and the columns ``more``): per id its latest row, unless that is deleted.

    Of equally late rows the greatest content counts; rows without id are left
    out; a row without arrival is the oldest.
    """
    columns = ["symbol", "kind", "file", "line_start", "line_end", *more, "deleted_at"]
    rows = nodes.select(clean_id("id").alias("id"), "arrived_at", *columns)
    if shared is not None:
        rows = rows.unionByName(shared.select(clean_id("id").alias("id"), "arrived_at", "symbol", "kind", "file"), allowMissingColumns=True)
    packed = F.struct(F.coalesce(F.unix_micros("arrived_at"), F.lit(0)).alias("_t"), F.struct(*columns).alias("_v"))
    last = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(packed).alias("_m")).select("id", "_m._v.*")
    return last.where(F.col("deleted_at").isNull()).drop("deleted_at")


def confidence_cost(confidence: Column, resolution: Column) -> Column:
    """0 for exact, 10 for bounded candidates, 100 for heuristic or unknown edges."""
    return F.when(confidence == "heuristic", 100).when(confidence == "bounded-candidates", 10).when(confidence.isNull() & (resolution == "unresolved"), 100).when(resolution != "resolved", 10).when((confidence == "exact") | (resolution == "resolved"), 0).otherwise(100)


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Every edge once, from its earliest arrival, ids trimmed."""
    columns = ["edge_id", "from_id", "to_id", "target_text", "resolution", "kind", "provenance", "confidence", "candidates"]
    rows = edges.select("edge_id", "arrived_at", clean_id("from_id").alias("from_id"), clean_id("to_id").alias("to_id"), *columns[3:])
    return earliest(rows, "edge_id", columns)


def hops(edges: DataFrame) -> DataFrame:
    """(edge_id, from_id, to_id, kind, provenance_rank, cost): each distinct edge once per target that it may have."""
    once = distinct_edges(edges)
    rank = F.array_position(F.array(*[F.lit(p) for p in PROVENANCE]), F.col("provenance")).cast("int")
    return once.select("edge_id", "from_id", F.explode(edge_targets()).alias("to_id"), "kind", F.coalesce(rank, F.lit(0)).alias("provenance_rank"), confidence_cost(F.col("confidence"), F.col("resolution")).alias("cost"), "resolution", "confidence", (F.size(F.coalesce("candidates", F.array().cast("array<string>"))) > 0).alias("bounded")).where(F.col("from_id").isNotNull())


def preferred(rows: DataFrame) -> DataFrame:
    """``hops`` without those of a lesser source: of resolved calls and references between two nodes only the best provenance stays."""
    judged = (F.col("resolution") == "resolved") & ~F.col("bounded") & F.col("kind").isin("calls", "references")
    best = rows.where(judged).groupBy("from_id", "to_id").agg(F.max("provenance_rank").alias("_best"))
    return rows.join(best, ["from_id", "to_id"], "left").where(~judged | (F.col("provenance_rank") == F.col("_best"))).drop("_best")


def best_hops(rows: DataFrame) -> DataFrame:
    """One hop per (from_id, to_id, kind): the cheapest, then the best provenance, then the smallest edge_id."""
    order = F.struct("cost", (-F.col("provenance_rank")).alias("p"), "edge_id")
    return rows.groupBy("from_id", "to_id", "kind").agg(F.min(order).alias("_o")).select("from_id", "to_id", "kind", F.col("_o.cost").alias("cost"), F.col("_o.edge_id").alias("edge_id"))


def search(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The best ``limit`` (1 to 200) matches, ranked by kind of match, symbol, file, line and id."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1 to 200")
    rows = nodes.withColumn("score", T.match_kind(F.col("id"), F.col("symbol"), query)).where(F.col("score").isNotNull())
    return rows.orderBy(F.desc("score"), "symbol", "file", "line_start", "id").limit(limit).select("id", "symbol", "file", "line_start", "score")


def search_all(nodes: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """(query, id, symbol, file, line_start, score, place): :func:`search` for many queries (column query) at once.

    The kinds of match are equi-joins on keys that both sides are taken apart
    into: ids, symbols, their lower case, the parts behind ``::``, the words of
    the last part.  A symbol that contains the bare query holds its rarest
    three letters in a row; nodes with those are looked through (queries of
    fewer letters: by all their letters' rows of one or two).  Null and empty
    queries match nothing.
    """
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1 to 200")
    q = queries.select("query").where(F.coalesce(F.col("query"), F.lit("")) != "").distinct()
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    words = lambda c: F.array_join(T.identifier_segments(c), " ")
    asked = F.array(key(600, F.col("query")), key(500, F.col("query")), key(400, F.lower("query")), key(300, F.col("query")), key(200, words(F.col("query"))))
    asked = q.select("query", F.explode(asked).alias("_k")).select("query", "_k.*").where(F.col("key") != "")
    parts = F.split("symbol", "::")
    tails = F.transform(F.slice(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: key(300, F.array_join(F.slice(parts, i, F.size(parts)), "::")))
    held = F.concat(F.array(key(600, F.col("id")), key(500, F.col("symbol")), key(400, F.lower("id")), key(400, F.lower("symbol")), key(200, words(F.element_at(parts, -1)))), tails)
    keyed = nodes.select("id", F.explode(F.array_distinct(held)).alias("_k")).select("id", "_k.*").where(F.col("key").isNotNull())
    by_key = keyed.join(asked, ["kind", "key"]).select("query", "id", F.col("kind").alias("score"))
    # containment of the bare query
    rows_of = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))
    bare = nodes.select("id", T.normalized_identifier("symbol").alias("_b")).where(F.col("_b") != "")
    letters = F.concat(*[F.transform(rows_of(F.col("_b"), n), lambda x: x) for n in (1, 2, 3)])
    held = cut(bare.select("id", "_b", F.explode(F.array_distinct(letters)).alias("_g")))
    often = held.groupBy("_g").agg(F.count("*").alias("_n"))
    asked = q.select("query", T.normalized_identifier("query").alias("_q")).where(F.col("_q") != "").withColumn("_l", F.least(F.length("_q"), F.lit(3)))
    wanted = asked.select("query", "_q", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_q") - F.col("_l") + 1), lambda i: F.substring("_q", i, F.col("_l"))))).alias("_g"))
    rarest = wanted.join(often, "_g", "left").groupBy("query", "_q").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_g").alias("g"))).alias("_m")).select("query", "_q", F.col("_m.g").alias("_g"))
    inside = held.join(rarest, "_g").where(F.contains("_b", F.col("_q"))).select("query", "id", F.lit(100).alias("score"))
    best = by_key.unionByName(inside).groupBy("query", "id").agg(F.max("score").alias("score")).join(nodes.select("id", "symbol", "file", "line_start"), "id")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "symbol", "file", "line_start", "id"))
    return best.withColumn("place", place).where(F.col("place") <= limit).select("query", "id", "symbol", "file", "line_start", "score", "place")


def locate(values: DataFrame, nodes: DataFrame) -> DataFrame:
    """(value, id, exact): nodes whose id or symbol is the value; only where there is none, those whose symbol ends with ``::value``.

    Suffixes are exploded from the symbols, so both steps are equi-joins.
    """
    v = values.select("value").where(F.col("value").isNotNull()).distinct()
    keys = nodes.select("id", F.explode(F.array_distinct(F.array("id", "symbol"))).alias("value")).where(F.col("value").isNotNull())
    exact = v.join(keys, "value").select("value", "id").distinct()
    parts = F.split("symbol", "::")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))
    suffix = nodes.where(F.size(parts) >= 2).select("id", F.explode(tails).alias("value"))
    rest = v.join(exact, "value", "left_anti").join(suffix, "value").select("value", "id").distinct()
    return exact.withColumn("exact", F.lit(True)).unionByName(rest.withColumn("exact", F.lit(False)))


def resolve_targets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(target_text, resolution, id): the one node with that symbol, else the one with it as last part, else external or unresolved."""
    t = texts.select("target_text").where(F.col("target_text").isNotNull()).distinct()
    unique = lambda key: nodes.groupBy(key.alias("target_text")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1")
    whole = unique(F.col("symbol")).select("target_text", F.col("id").alias("_whole"))
    last = unique(F.element_at(F.split("symbol", "::"), -1)).select("target_text", F.col("id").alias("_last"))
    joined = t.join(whole, "target_text", "left").join(last, "target_text", "left")
    found = F.coalesce("_whole", F.when(~F.contains("target_text", F.lit("::")), F.col("_last")))
    outside = F.col("target_text").rlike("^(std|core|alloc)::")
    return joined.select("target_text", F.when(found.isNotNull(), "resolved").when(outside, "external").otherwise("unresolved").alias("resolution"), found.alias("id"))


def enclosing(sites: DataFrame, nodes: DataFrame, block: int = 64) -> DataFrame:
    """(edge_id, node_id): the smallest node span around each site's line in the same file (smallest id on ties).

    Spans are cut into blocks of lines, so the range join is an equi-join on
    (file, block) with a bounded number of candidates per line.
    """
    spans = nodes.where(~F.col("kind").isin("crate", "module") & F.col("line_start").isNotNull() & (F.col("line_end") >= F.col("line_start")))
    spans = spans.select("file", F.col("id").alias("node_id"), "line_start", "line_end", F.explode(F.sequence(F.floor(F.col("line_start") / block), F.floor(F.col("line_end") / block))).alias("_block"))
    at = sites.where(F.col("file").isNotNull() & F.col("line").isNotNull()).withColumn("_block", F.floor(F.col("line") / block))
    inside = at.join(spans, ["file", "_block"]).where(F.col("line").between(F.col("line_start"), F.col("line_end")))
    return inside.groupBy("edge_id").agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("s"), "node_id")).alias("_m")).select("edge_id", F.col("_m.node_id").alias("node_id"))


def dispatch_candidates(rows: DataFrame, nodes: DataFrame, most: int = 64) -> DataFrame:
    """(edge_id, trait_id, method, n, candidates): exact calls (by the semantic index) of a trait's method, with the methods of that name in the trait's implementations.

    A trait's methods are the functions that it contains, an implementation's
    those that the implementing node contains.  Beyond ``most`` candidates
    there is no list.  Lists are made per trait and method, not per call.
    """
    last = F.element_at(F.split("symbol", "::"), -1)
    of_kind = lambda kind: nodes.where(F.col("kind") == kind)
    functions = of_kind("fn").select(F.col("id").alias("fn_id"), last.alias("method"))
    resolved = rows.where(F.col("resolution") == "resolved")
    holds = resolved.where(F.col("kind") == "contains").select(F.col("from_id").alias("owner"), F.col("to_id").alias("fn_id")).distinct().join(functions, "fn_id")
    traits = holds.join(of_kind("trait").select(F.col("id").alias("owner")), "owner", "left_semi").groupBy("fn_id").agg(F.max(F.struct(F.col("owner").alias("trait_id"), "method")).alias("_t")).select("fn_id", "_t.*")
    impls = resolved.where(F.col("kind") == "impls-trait").select(F.col("from_id").alias("owner"), F.col("to_id").alias("trait_id")).distinct().join(of_kind("impl").select(F.col("id").alias("owner")), "owner", "left_semi")
    methods = impls.join(holds, "owner").select("trait_id", "method", "fn_id").distinct()
    counted = methods.groupBy("trait_id", "method").agg(F.count("*").alias("n"))
    lists = methods.join(counted.where(F.col("n") <= most), ["trait_id", "method"], "left_semi").groupBy("trait_id", "method").agg(F.array_join(F.array_sort(F.collect_list("fn_id")), "|").alias("candidates"))
    calls = resolved.where((F.col("kind") == "calls") & (F.col("provenance_rank") == 2) & (F.col("confidence") == "exact")).select("edge_id", F.col("to_id").alias("fn_id"))
    return calls.join(traits, "fn_id").join(counted, ["trait_id", "method"]).join(lists, ["trait_id", "method"], "left").select("edge_id", "trait_id", "method", "n", "candidates")


def flow_pairs(rows: DataFrame, middle: DataFrame) -> DataFrame:
    """(from_id, through, to_id, cost): two-hop ways over the given nodes (column id), three distinct nodes each."""
    mid = middle.select(F.col("id").alias("through")).distinct()
    into = rows.select("from_id", F.col("to_id").alias("through"), F.col("cost").alias("_a")).join(mid, "through", "left_semi").groupBy("from_id", "through").agg(F.min("_a").alias("_a"))
    out = rows.select(F.col("from_id").alias("through"), "to_id", F.col("cost").alias("_b")).join(mid, "through", "left_semi").groupBy("through", "to_id").agg(F.min("_b").alias("_b"))
    ways = into.join(out, "through").where((F.col("from_id") != F.col("to_id")) & (F.col("from_id") != F.col("through")) & (F.col("to_id") != F.col("through")))
    return ways.select("from_id", "through", "to_id", (F.col("_a") + F.col("_b")).alias("cost"))


def flow_counts(rows: DataFrame, middle: DataFrame) -> DataFrame:
    """(through, cost, n): how many of :func:`flow_pairs` lead over each of the given nodes (column id), by cost.

    Ways are a product of counts per cost less those that return to where
    they came from, so no pair of a heavy node is listed.
    """
    side = lambda through, end, a, b: F.struct(F.col(through).alias("through"), F.col(end).alias("end"), a.cast("int").alias("_a"), b.cast("int").alias("_b"))
    both = F.explode(F.array(side("to_id", "from_id", F.col("cost"), F.lit(None)), side("from_id", "to_id", F.lit(None), F.col("cost"))))
    ends = rows.where(F.col("from_id") != F.col("to_id")).select(both.alias("_e")).select("_e.*").groupBy("through", "end").agg(F.min("_a").alias("_a"), F.min("_b").alias("_b"))
    ends = cut(ends.groupBy("through", "_a", "_b").agg(F.count("*").alias("n")))
    n_in = ends.where(F.col("_a").isNotNull()).groupBy("through", "_a").agg(F.sum("n").alias("_i"))
    n_out = ends.where(F.col("_b").isNotNull()).groupBy("through", "_b").agg(F.sum("n").alias("_o"))
    returns = ends.where(F.col("_a").isNotNull() & F.col("_b").isNotNull()).select("through", "_a", "_b", (-F.col("n")).alias("n"))
    ways = n_in.join(n_out, "through").select("through", "_a", "_b", (F.col("_i") * F.col("_o")).alias("n")).unionByName(returns)
    counts = ways.groupBy("through", (F.col("_a") + F.col("_b")).alias("cost")).agg(F.sum("n").alias("n")).where("n > 0")
    return counts.join(middle.select(F.col("id").alias("through")).distinct(), "through", "left_semi")


def simple_paths(rows: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start_id, node_id, depth, cost, path): all ways of up to ``depth`` hops that visit no node twice.

    ``starts`` (column id) should be few: ways may be exponentially many.
    """
    step = cut(rows.groupBy("from_id", "to_id").agg(F.min("cost").alias("_c")))
    level = starts.select(F.col("id").alias("start_id"), F.col("id").alias("node_id"), F.lit(0).alias("depth"), F.lit(0).alias("cost"), F.array("id").alias("path")).distinct()
    out = level.limit(0)
    for _ in range(depth):
        grown = level.join(step.withColumnRenamed("from_id", "node_id"), "node_id").where(~F.array_contains("path", F.col("to_id")))
        level = cut(grown.select("start_id", F.col("to_id").alias("node_id"), (F.col("depth") + 1).alias("depth"), (F.col("cost") + F.col("_c")).cast("int").alias("cost"), F.concat("path", F.array("to_id")).alias("path")))
        out = out.unionByName(level)
    return out


def bounded_paths(paths: DataFrame, most: int) -> DataFrame:
    """Per (start_id, node_id) the ``most`` shortest ways; the cheapest takes the last place if it isn't among them."""
    key = ["start_id", "node_id"]
    short = Window.partitionBy(*key).orderBy("depth", "cost", F.array_join("path", "\x1f"))
    cheap = Window.partitionBy(*key).orderBy("cost", "depth", F.array_join("path", "\x1f"))
    ranked = paths.withColumn("_s", F.row_number().over(short)).withColumn("_c", F.row_number().over(cheap))
    inside = F.max(F.when((F.col("_c") == 1) & (F.col("_s") <= most), 1).otherwise(0)).over(Window.partitionBy(*key))
    ranked = ranked.withColumn("_in", inside)
    keep = F.col("_s") <= F.lit(most) - F.when((F.col("_in") == 0) & F.lit(most >= 2), 1).otherwise(0)
    forced = (F.col("_c") == 1) & (F.col("_in") == 0) & F.lit(most >= 2)
    return ranked.where(keep | forced).drop("_s", "_c", "_in")


def best_two_hops(rows: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """What :func:`bounded_paths` keeps of the :func:`simple_paths` of up to two hops, from any number of ``starts`` (column id).

    Over a hub lead as many ways as it has starts times ends, nearly all of
    them results.  They are made last and never shuffled: starts that reach the
    same hubs at the same costs form a group, of whose ways the best are found
    once per end, and the result is the product of a group's starts and ends
    (``_cells``).  Pairs of start and end that have any other way are left out
    there and ranked by themselves, with the direct links and the ways over
    all other nodes, which are at most HUB times the links.
    """
    ids = cut(starts.select(F.col("id").alias("from_id")).where(F.col("from_id").isNotNull()).distinct())
    step = cut(rows.where(F.col("from_id") != F.col("to_id")).groupBy("from_id", "to_id").agg(F.min("cost").cast("int").alias("_c")))
    first = cut(step.join(ids, "from_id", "left_semi").select(F.col("from_id").alias("start_id"), F.col("to_id").alias("_mid"), F.col("_c").alias("_a")))
    n_in = first.groupBy("_mid").agg(F.count("*").alias("_n"))
    second = cut(step.withColumnRenamed("from_id", "_mid").join(n_in, "_mid", "left_semi").select("_mid", F.col("to_id").alias("node_id"), F.col("_c").alias("_b")), step)
    n_out = second.groupBy("_mid").agg(F.count("*").alias("_m"))
    hubs = cut(n_in.join(n_out, "_mid").where((F.col("_n") > HUB) & (F.col("_m") > HUB)).select("_mid"))
    way = lambda cost: ["start_id", "node_id", F.lit(2).alias("depth"), cost.alias("cost"), F.array("start_id", "_mid", "node_id").alias("path")]
    direct = first.select("start_id", F.col("_mid").alias("node_id"), F.lit(1).alias("depth"), F.col("_a").alias("cost"), F.array("start_id", "_mid").alias("path"))
    over = salted_join(first.join(hubs, "_mid", "left_anti"), second, "_mid", "inner", F.col("start_id")).where(F.col("start_id") != F.col("node_id"))
    near = cut(direct.unionByName(over.select(*way(F.col("_a") + F.col("_b")))))
    # groups of starts, and the best ways from a group to its ends
    sets = first.join(hubs, "_mid", "left_semi").groupBy("start_id").agg(F.array_sort(F.collect_list(F.struct("_mid", "_a"))).alias("_set"))
    sets = cut(sets.withColumn("_group", F.sha2(F.to_json("_set"), 256)))
    members = sets.groupBy("_group").agg(F.first("_set").alias("_set")).select("_group", F.inline("_set"))
    place = F.row_number().over(Window.partitionBy("_group", "node_id").orderBy("cost", F.concat_ws("\x1f", "_mid", "node_id")))
    far = members.join(second, "_mid").select("_group", "node_id", "_mid", (F.col("_a") + F.col("_b")).alias("cost"))
    far = cut(far.withColumn("_p", place).where(F.col("_p") <= most).drop("_p"))
    ends = far.select("_group", "node_id").distinct()
    shared = cut(near.select("start_id", "node_id").distinct().join(sets.select("start_id", "_group"), "start_id").join(ends, ["_group", "node_id"], "left_semi"))
    ranked = bounded_paths(near.unionByName(shared.join(far, ["_group", "node_id"]).select(*way(F.col("cost")))), most)
    return ranked.unionByName(_cells(sets.select("start_id", "_group"), far, shared).select(*way(F.col("cost"))))


def _cells(starts: DataFrame, ends: DataFrame, without: DataFrame) -> DataFrame:
    """Each start of a group with each end of that group, but a node with itself and the pairs (start_id, node_id) of ``without``.

    A group is a grid of cells of about CELL starts by CELL ends, so that no
    task gets all of a large group, and only 2/CELL as many rows as there
    are pairs are shuffled.
    """
    tiles = lambda df, c, name: df.groupBy("_group").agg(F.ceil(F.count_distinct(c) / CELL).cast("int").alias(name))
    grid = cut(tiles(starts, "start_id", "_rows").join(tiles(ends, "node_id", "_columns"), "_group"))
    tile = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    gone = without.join(grid, "_group").groupBy("_group", "start_id", tile("node_id", "_columns").alias("_j")).agg(F.collect_list("node_id").alias("_gone"))
    left = starts.join(grid, "_group").select("_group", "start_id", tile("start_id", "_rows").alias("_i"), every("_columns").alias("_j")).join(gone, ["_group", "start_id", "_j"], "left")
    right = ends.join(grid, "_group").select(*ends.columns, tile("node_id", "_columns").alias("_j"), every("_rows").alias("_i"))
    # the number is given, as the adaptive one follows the rows read, not those that come out
    key, tasks = ["_group", "_i", "_j"], int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.repartition(tasks, *key).join(right.repartition(tasks, *key).hint("merge"), key)
    return pairs.where((F.col("start_id") != F.col("node_id")) & (F.col("_gone").isNull() | ~F.array_contains("_gone", F.col("node_id"))))


def impact(rows: DataFrame, seeds: DataFrame, depth: int = 3, most: int | None = None) -> DataFrame:
    """(id, distance) of what depends on the seeds (column id): containment is followed down at no distance, dependencies back at 1 each.

    Seeds themselves are left out.  A node keeps its smallest distance.
    ``most``: only so many, the nearest (by id among equals).  A round joins
    what came nearer in the last one with the links and writes it once.
    """
    inside = F.col("kind") == "contains"
    links = rows.where(inside | F.col("kind").isin(DEPENDENCY_KINDS)).select(F.when(inside, F.col("from_id")).otherwise(F.col("to_id")).alias("at"), F.when(inside, F.col("to_id")).otherwise(F.col("from_id")).alias("id"), F.when(inside, 0).otherwise(1).alias("step"))
    links = cut(links.distinct())
    layer = cut(seeds.select("id").distinct().withColumn("distance", F.lit(0)))
    layers = [layer]
    while layer.limit(1).count():
        known = reduce(DataFrame.unionByName, layers).groupBy("id").agg(F.min("distance").alias("_d"))
        reached = links.join(layer.withColumnRenamed("id", "at"), "at").select("id", (F.col("distance") + F.col("step")).alias("distance")).where(F.col("distance") <= depth).groupBy("id").agg(F.min("distance").alias("distance"))
        layer = cut(reached.join(known, "id", "left").where(F.col("_d").isNull() | (F.col("distance") < F.col("_d"))).select("id", "distance"))
        layers.append(layer)
    settled = reduce(DataFrame.unionByName, layers).groupBy("id").agg(F.min("distance").alias("distance")).join(seeds.select("id").distinct(), "id", "left_anti")
    return settled if most is None else settled.orderBy("distance", "id").limit(most)


def affected(rows: DataFrame, nodes: DataFrame, files: DataFrame, depth: int = 3) -> DataFrame:
    """:func:`impact` of all nodes of the changed files (column file)."""
    return impact(rows, nodes.join(files.select("file").distinct(), "file", "left_semi").select("id"), depth)


def references_of(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct incoming calls and references of the targets (column id)."""
    wanted = rows.where(F.col("kind").isin("calls", "references")).select("from_id", "to_id", "kind").distinct()
    return wanted.join(targets.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi")


def implementations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, n_edges, n_open, first_edge): implementation relations that touch a name, the last part of a symbol.

    An edge touches the names of the nodes at both ends, and those that its
    target text or target id end in, so that targets which were never
    resolved are found as well.  ``n_open``: edges that aren't resolved.
    ``edges``: what :func:`distinct_edges` returns.
    """
    last = lambda c: F.element_at(F.split(c, "::"), -1)
    impls = edges.where(F.col("kind").isin("impls-trait", "impl-for"))
    ends = impls.select("edge_id", "resolution", F.explode(F.array("from_id", "to_id")).alias("id"))
    placed = ends.join(nodes.select("id", last(F.col("symbol")).alias("name")), "id").select("edge_id", "resolution", "name")
    texts = impls.select("edge_id", "resolution", F.explode(F.array(last(F.col("target_text")), last(F.col("to_id")))).alias("name"))
    every = placed.unionByName(texts).where(F.col("name").isNotNull()).distinct()
    return every.groupBy("name").agg(F.count("*").alias("n_edges"), F.count(F.when(F.col("resolution") != "resolved", 1)).alias("n_open"), F.min("edge_id").alias("first_edge"))


def layers(links: DataFrame) -> DataFrame:
    """(node, layer) of (before, after) links: the longest way from a node without prerequisites; nodes on and behind circles are left out.

    A round keeps the links whose start still has a prerequisite; a node's
    layer is the number of rounds in which it had one.
    """
    links = cut(links.where(F.col("before").isNotNull() & F.col("after").isNotNull()).select("before", "after").distinct())
    nodes = links.select(F.explode(F.array("before", "after")).alias("node")).distinct()
    waiting = lambda df: df.select(F.col("after").alias("node")).distinct()
    rounds, n = [], links.count()
    while n:
        rounds.append(waiting(links).withColumn("_n", F.lit(len(rounds) + 1)))
        links = cut(links.join(waiting(links).withColumnRenamed("node", "before"), "before", "left_semi").select("before", "after"))
        left = links.count()
        if left == n:
            break
        n = left
    if not rounds:
        return nodes.select("node", F.lit(0).alias("layer"))
    last = reduce(DataFrame.unionByName, rounds).groupBy("node").agg(F.max("_n").alias("_n"))
    return nodes.join(last, "node", "left").join(waiting(links), "node", "left_anti").select("node", F.coalesce("_n", F.lit(0)).alias("layer"))


def rebuild_frontier(old_nodes: DataFrame, new_nodes: DataFrame, old_edges: DataFrame, new_edges: DataFrame, most: int = 2048) -> DataFrame:
    """(file, reason): files to be resolved again after a change from old to new nodes and edges.

    Changed declarations are nodes that came, went or changed their symbol;
    their files are taken (if they are still there), and the files of edges of
    the syntax layer (containment aside) that lead to a changed id, name a
    changed symbol, or the last part of one without a path; if any
    implementation relation changed, all files with such relations as well.
    Beyond ``most`` files, all.
    """
    place = lambda df, name: df.select("id", F.col("symbol").alias(name), F.col("file").alias(f"{name}_file"))
    both = place(old_nodes, "_a").join(place(new_nodes, "_b"), "id", "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    changed = cut(both)
    files = new_nodes.select("file").where(F.col("file").isNotNull()).distinct()
    own = changed.select(F.explode(F.array("_a_file", "_b_file")).alias("file")).distinct().join(files, "file", "left_semi")
    symbols = changed.select(F.explode(F.array("_a", "_b")).alias("key")).where(F.col("key").isNotNull())
    parts = symbols.select(F.element_at(F.split("key", "::"), -1).alias("key"))
    keys = changed.select(F.col("id").alias("key"), F.lit("id").alias("what")).unionByName(symbols.withColumn("what", F.lit("symbol"))).unionByName(parts.withColumn("what", F.lit("last"))).distinct()
    named = F.coalesce("target_text", "to_id")
    asked = F.array(F.struct(F.col("to_id").alias("key"), F.lit("id").alias("what")), F.struct(named.alias("key"), F.lit("symbol").alias("what")), F.struct(F.when(~F.contains(named, F.lit("::")), named).alias("key"), F.lit("last").alias("what")))
    syntax = new_edges.where((F.col("provenance") == "syn") & (F.col("kind") != "contains"))
    users = syntax.select("from_id", F.explode(asked).alias("_k")).select("from_id", "_k.*").join(keys, ["key", "what"], "left_semi").select(F.col("from_id").alias("id")).distinct()
    impls = lambda df: df.where(F.col("kind").isin("impls-trait", "impl-for")).select("from_id", "to_id", "kind", "target_text").distinct()
    a, b = impls(old_edges), impls(new_edges)
    if a.exceptAll(b).unionByName(b.exceptAll(a)).limit(1).count():
        users = users.unionByName(syntax.where(F.col("kind").isin("impls-trait", "impl-for")).select(F.col("from_id").alias("id"))).distinct()
    near = new_nodes.join(users, "id", "left_semi").select("file").where(F.col("file").isNotNull()).distinct().join(own, "file", "left_anti")
    out = cut(own.withColumn("reason", F.lit("changed")).unionByName(near.withColumn("reason", F.lit("depends"))))
    return files.withColumn("reason", F.lit("frontier too large")) if out.limit(most + 1).count() > most else out


def change_frontier(rows: DataFrame, nodes: DataFrame, changed: DataFrame, most: int = 2048) -> DataFrame:
    """(file, reason): files to resolve again after changes (column file): themselves and those with edges to their nodes; all of them beyond ``most``."""
    files = changed.select("file").distinct()
    ids = nodes.join(files, "file", "left_semi").select(F.col("id").alias("to_id"))
    users = rows.join(ids, "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct()
    near = nodes.join(users, "id", "left_semi").select("file").distinct().join(files, "file", "left_anti")
    out = files.withColumn("reason", F.lit("changed")).unionByName(near.withColumn("reason", F.lit("refers")))
    if out.limit(most + 1).count() > most:
        return nodes.select("file").distinct().withColumn("reason", F.lit("frontier too large"))
    return out


def change_frontiers(rows: DataFrame, nodes: DataFrame, most: int = 2048) -> DataFrame:
    """(changed, file, reason): :func:`change_frontier` of every file, each changed by itself."""
    place = cut(nodes.where(F.col("file").isNotNull()).select("id", "file"))
    links = cut(rows.select("from_id", "to_id"))
    users = cut(salted_join(links, place.withColumnRenamed("id", "from_id"), "from_id", "inner", F.col("to_id")).select("to_id", "file"))
    targets = place.select(F.col("id").alias("to_id"), F.col("file").alias("changed"))
    near = cut(salted_join(users, targets, "to_id", "inner", F.col("file")).where(F.col("changed") != F.col("file")).select("changed", "file").distinct())
    large = cut(near.groupBy("changed").agg(F.count("*").alias("_n")).where(F.col("_n") + 1 > most).select("changed"))
    files = place.select("file").distinct()
    own = files.select(F.col("file").alias("changed"), "file", F.lit("changed").alias("reason"))
    fitting = own.unionByName(near.withColumn("reason", F.lit("refers"))).join(large, "changed", "left_anti")
    return fitting.unionByName(large.crossJoin(files).withColumn("reason", F.lit("frontier too large")))


def stale_files(recorded: DataFrame, present: DataFrame) -> DataFrame:
    """(file, state): files whose recorded and present digest differ; a missing side counts as different."""
    joined = recorded.select("file", F.col("hash").alias("_a"), F.lit(True).alias("_r")).join(present.select("file", F.col("hash").alias("_b"), F.lit(True).alias("_p")), "file", "full")
    state = F.when(F.col("_r").isNull(), "added").when(F.col("_p").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return joined.select("file", state.alias("state")).where(F.col("state").isNotNull())


def outline(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, parent, n_children): containment, parents being the smallest container."""
    contains = rows.where((F.col("kind") == "contains") & (F.col("from_id") != F.col("to_id")))
    parents = contains.groupBy(F.col("to_id").alias("id")).agg(F.min("from_id").alias("parent"))
    children = contains.groupBy(F.col("from_id").alias("id")).agg(F.count_distinct("to_id").alias("n_children"))
    return nodes.select("id").join(parents, "id", "left").join(children, "id", "left").select("id", "parent", F.coalesce("n_children", F.lit(0)).alias("n_children"))
