"""Bounded walks over edges: impact, hierarchies, ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import CALLABLE, HIDDEN, LOW_SIGNAL
from tessera.operators.hierarchy import follow
from tessera.session import cut

MAX_DEPTH, CEILING = 5, 200


def clamp_depth(depth: int) -> int:
    """0 stands for 2; more than MAX_DEPTH is cut."""
    return min(depth, MAX_DEPTH) if depth > 0 else 2


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, depth) of every node that reaches a seed backwards over edges (src, dst) within depth steps, at its
    least depth; seeds themselves are never returned. All seeds walk at once: a level is one join of the frontier with
    the edges and one anti join against what was seen, so cycles end and each node is expanded once per seed.

    Defined results: null ends are no edges; repeated edges and seeds count once; no seeds give no rows.
    """
    step = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    frontier = seeds.select(F.col("seed"), F.col("seed").alias("node")).where("seed IS NOT NULL").distinct().withColumn("depth", F.lit(0))
    seen = frontier
    for d in range(1, depth + 1):
        nxt = frontier.select("seed", F.col("node").alias("dst")).join(step, "dst").select("seed", F.col("src").alias("node")).distinct()
        frontier = nxt.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(d))
        if d >= 3:  # a deep plan would repeat the levels before it
            frontier = cut(frontier, "frontier")
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def impact(edges: DataFrame, symbols: DataFrame, seeds: DataFrame, depth: int = 2, limit: int = CEILING, low_signal: bool = False) -> DataFrame:
    """Who is affected by a change of each seed: (seed, symbol_id, name, kind, path, start_line, depth, is_test, reason,
    place), tests and other symbols apart, each in the order of depth, path, line and id and cut at limit (at most CEILING).

    symbols: symbol_id, name, kind, path, start_line, is_test. Low-signal kinds are hidden unless asked for; tests stay.
    """
    found = reach(edges, seeds, clamp_depth(depth))
    s = symbols.select("symbol_id", "name", "kind", "path", "start_line", F.coalesce("is_test", F.lit(False)).alias("is_test"))
    rows = found.withColumnRenamed("node", "symbol_id").join(s, "symbol_id")
    if not low_signal:
        rows = rows.where(F.col("is_test") | ~F.col("kind").isin(*LOW_SIGNAL))
    w = Window.partitionBy("seed", "is_test").orderBy("depth", F.col("path").asc_nulls_first(), F.col("start_line").asc_nulls_first(), "symbol_id")
    reason = F.when(F.col("depth") == 1, "direct caller").otherwise(F.format_string("indirect caller [depth %d]", "depth"))
    rows = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= min(limit, CEILING))
    return rows.select("seed", "symbol_id", "name", "kind", "path", "start_line", "depth", "is_test", reason.alias("reason"), "place")


def impact_flags(edges: DataFrame, symbols: DataFrame, seeds: DataFrame, depth: int = 2, limit: int = CEILING) -> DataFrame:
    """For each seed with callers: impacted, tests (numbers found), the flags impacted_truncated, tests_truncated and
    ceiling_reached, stopped_at_depth (the depth, if callers exist beyond it and it could be greater), and
    tests_past_depth: further tests that a walk of MAX_DEPTH finds.

    The walk goes to the depth asked for. Whether there is more is one further join of its last level; only seeds for
    which there is are walked on, to count the tests past the depth.
    """
    d = clamp_depth(depth)
    s = symbols.select(F.col("symbol_id").alias("node"), F.coalesce("is_test", F.lit(False)).alias("is_test"))
    near = cut(reach(edges, seeds, d), "near")
    n = lambda c: F.count_if(c)
    test = F.col("is_test")
    counts = near.join(s, "node").groupBy("seed").agg(n(~test).alias("impacted"), n(test).alias("tests"))
    step = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    next_ = near.where(F.col("depth") == d).select("seed", F.col("node").alias("dst")).join(step, "dst").select("seed", F.col("src").alias("node")).where("seed <> node")
    beyond = cut(next_.distinct().join(near, ["seed", "node"], "left_anti").select("seed").distinct(), "beyond")
    far = reach(edges, beyond, MAX_DEPTH).where(F.col("depth") > d).join(s, "node").where("is_test").groupBy("seed").agg(F.count("*").alias("tests_past_depth"))
    j = counts.join(beyond.withColumn("more", F.lit(True)), "seed", "left").join(far, "seed", "left")
    return j.select("seed", "impacted", "tests", (F.col("impacted") > limit).alias("impacted_truncated"), (F.col("tests") > limit).alias("tests_truncated"),
                    (F.col("impacted") + F.col("tests") > CEILING).alias("ceiling_reached"),
                    F.when(F.col("more") & F.lit(d < MAX_DEPTH), F.lit(d)).alias("stopped_at_depth"), F.coalesce("tests_past_depth", F.lit(0)).alias("tests_past_depth"))


def open_ends(edges: DataFrame, found: DataFrame) -> DataFrame:
    """(seed, node) of the reached nodes that nothing calls."""
    called = edges.where("dst IS NOT NULL AND src IS NOT NULL").select(F.col("dst").alias("node")).distinct()
    return found.select("seed", "node").join(called, "node", "left_anti").select("seed", "node")


def ancestors(symbols: DataFrame, max_depth: int = 31) -> DataFrame:
    """(symbol_id, ancestor_id, depth) over parent links, at most max_depth up; by the recursion of Spark SQL's engine in
    DataFrame form: levels are joined until none is left. Circles end at max_depth or where a symbol meets itself."""
    up = symbols.where("parent_symbol_id IS NOT NULL").select("symbol_id", F.col("parent_symbol_id").alias("ancestor_id"))
    ids = symbols.select(F.col("symbol_id").alias("ancestor_id"))
    level = cut(up.join(ids, "ancestor_id").select("symbol_id", "ancestor_id", F.lit(1).alias("depth")), "level")
    step = level.select(F.col("symbol_id").alias("ancestor_id"), F.col("ancestor_id").alias("next"))
    out = level
    for d in range(2, max_depth + 1):
        level = cut(level.where("symbol_id <> ancestor_id").join(step, "ancestor_id").select("symbol_id", F.col("next").alias("ancestor_id"), F.lit(d).alias("depth")), "level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def hidden_symbols(symbols: DataFrame, up: DataFrame) -> DataFrame:
    """symbol_id of the symbols that are private, protected or fileprivate, or have an ancestor that is."""
    low = symbols.where(F.lower("visibility").isin(*HIDDEN)).select("symbol_id").distinct()
    below = up.join(low.withColumnRenamed("symbol_id", "ancestor_id"), "ancestor_id", "left_semi").select("symbol_id")
    return low.unionByName(below).distinct()


def local_variables(symbols: DataFrame) -> DataFrame:
    """symbol_id of variables with a callable ancestor, climbing only through variables, however deep; circles are no
    locals. Chains of variables are followed by pointer doubling."""
    links = symbols.where("kind = 'variable' AND parent_symbol_id IS NOT NULL").select(F.col("symbol_id").alias("node"), F.col("parent_symbol_id").alias("parent"))
    inside = symbols.where(F.col("kind").isin(*CALLABLE)).select(F.col("symbol_id").alias("top"))
    return follow(links).where("NOT circular").join(inside, "top", "left_semi").select(F.col("node").alias("symbol_id"))


def namespace_of(up: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, namespace): the name of the nearest namespace, from the symbol itself upwards; else that of the file's
    only namespace; symbols in neither have no row."""
    spaces = symbols.where("kind = 'namespace'").select(F.col("symbol_id").alias("ancestor_id"), "name", "path")
    own = symbols.select("symbol_id", F.col("symbol_id").alias("ancestor_id"), F.lit(0).alias("depth"))
    around = own.unionByName(up).join(spaces.drop("path"), "ancestor_id").groupBy("symbol_id").agg(F.min_by("name", F.struct("depth", "ancestor_id")).alias("around"))
    single = spaces.where("path IS NOT NULL").groupBy("path").agg(F.count("*").alias("n"), F.min("name").alias("single")).where("n = 1").drop("n")
    j = symbols.select("symbol_id", "path").join(around, "symbol_id", "left").join(single, "path", "left")
    return j.select("symbol_id", F.coalesce("around", "single").alias("namespace")).where("namespace IS NOT NULL")


def merge_depths(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two walks by key, each at its lesser depth."""
    x, y = a.withColumnRenamed("depth", "d1"), b.withColumnRenamed("depth", "d2")
    return x.join(y, keys, "full").select(*keys, F.least("d1", "d2").alias("depth"))
