"""Impact beyond resolved calls: fixtures and set-up members, the callers that a report adds, and seeds of all kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import is_test_name, is_test_path
from tessera.functions.paths import folder
from tessera.operators import diff, lookup
from tessera.operators.walk import reach


def _folders(path):
    """All folders above a path, '' first."""
    parts = F.split(folder(path), "/")
    return F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))


def fixture_edges(fixtures: DataFrame, users: DataFrame) -> DataFrame:
    """(src, dst): tests and fixtures (users: symbol_id, path, parameters) that take a fixture (symbol_id, name, path) as a
    parameter. A fixture serves its own file, one in a conftest.py all files below its folder; of several of one name the
    nearest serves. A fixture that takes its own name means the one further out."""
    shared = F.regexp_extract("path", r"([^/\\]*)$", 1) == "conftest.py"
    f = fixtures.select(F.col("symbol_id").alias("dst"), "name", F.col("path").alias("own"), F.when(shared, folder(F.col("path"))).otherwise(F.concat(F.lit("="), "path")).alias("scope"))
    u = users.select(F.col("symbol_id").alias("src"), "path", F.explode(F.array_distinct("parameters")).alias("name"))
    at = u.select("src", "path", "name", F.posexplode(F.concat(_folders(F.col("path")), F.array(F.concat(F.lit("="), "path")))).alias("near", "scope"))
    j = at.join(f, ["name", "scope"]).where("src <> dst")
    best = j.groupBy("src", "name").agg(F.max(F.struct("near", "dst")).alias("m"))
    return best.select("src", "m.dst")


def setup_edges(symbols: DataFrame) -> DataFrame:
    """(src, dst): tests of a class that its set-up and tear-down members (test_lifecycle) run around."""
    life = F.coalesce("test_lifecycle", F.lit(False))
    s = symbols.where("parent_symbol_id IS NOT NULL")
    dst = s.where(life).select("parent_symbol_id", F.col("symbol_id").alias("dst"))
    return s.where(F.coalesce("is_test", F.lit(False)) & ~life).select("parent_symbol_id", F.col("symbol_id").alias("src")).join(dst, "parent_symbol_id").select("src", "dst")


def all_edges(resolved: DataFrame, claimed: DataFrame, *more: DataFrame) -> DataFrame:
    """(src, dst): resolved edges, calls that evidence ties to one definition (from_symbol_id, target), and others."""
    e = resolved.select("src", "dst").unionByName(claimed.where("target IS NOT NULL AND from_symbol_id IS NOT NULL").select(F.col("from_symbol_id").alias("src"), F.col("target").alias("dst")))
    for d in more:
        e = e.unionByName(d.select("src", "dst"))
    return e.distinct()


def report_callers(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """(seed, node, reason) of the callers that a report knows: its proven and likely sites (target, from_symbol_id, label,
    basis, call), by caller. A caller that makes no call refers; one whose sites are likely by their name only says so.
    Tests and their containers are no callers here; they have a list of their own."""
    s = sites.where("target IS NOT NULL AND from_symbol_id IS NOT NULL").where(F.col("label").isin("proven", "likely"))
    name_only = (F.col("label") == "likely") & F.startswith("basis", F.lit("name only"))
    g = s.groupBy(F.col("target").alias("seed"), F.col("from_symbol_id").alias("node")).agg(F.bool_or("call").alias("call"), F.bool_and(name_only).alias("by_name"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    test = yes("is_test") | yes("test_container") | (is_test_path(F.col("path")) & is_test_name(F.col("name")))
    keep = symbols.where(~test).select(F.col("symbol_id").alias("node"))
    reason = F.concat(F.when(F.col("call"), "direct caller").otherwise("direct reference"), F.lit(" (report"), F.when(F.col("by_name"), ", name only").otherwise(""), F.lit(")"))
    return g.join(keep, "node", "left_semi").where("seed <> node").select("seed", "node", reason.alias("reason"))


def join_callers(walked: DataFrame, callers: DataFrame) -> DataFrame:
    """(seed, node, depth, reason, added): a walk's rows (seed, node, depth) with a report's callers at depth 1. added: the
    report has put it there, as the walk had it deeper or not at all."""
    c = callers.select("seed", "node", F.col("reason").alias("said"), F.lit(True).alias("called"))
    j = walked.select("seed", "node", F.col("depth").alias("was")).join(c, ["seed", "node"], "full")
    added = F.coalesce(F.col("called"), F.lit(False)) & F.coalesce(F.col("was") > 1, F.lit(True))
    depth = F.when(added, 1).otherwise(F.col("was"))
    reason = F.when(added, F.col("said")).when(depth == 1, "direct caller").otherwise(F.format_string("indirect caller [depth %d]", depth))
    return j.select("seed", "node", depth.cast("int").alias("depth"), reason.alias("reason"), added.alias("added"))


def walk_on(joined: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(seed, node, depth, reason): the joined rows and those that a walk from the added ones finds within what is left of
    the depth, one level deeper than from there, each at its least depth. Seeds are never reached."""
    if depth <= 1:
        return joined.select("seed", "node", "depth", "reason")
    added = joined.where("added").select("seed", F.col("node").alias("via"))
    far = reach(edges, added.select(F.col("via").alias("seed")), depth - 1).select(F.col("seed").alias("via"), "node", (F.col("depth") + 1).alias("d"))
    found = added.join(far, "via").where("seed <> node").groupBy("seed", "node").agg(F.min("d").alias("d"))
    j = joined.join(found, ["seed", "node"], "full")
    least = F.least("depth", "d")
    reason = F.when(F.col("depth") == least, F.col("reason")).otherwise(F.format_string("indirect caller [depth %d]", least))
    return j.select("seed", "node", least.cast("int").alias("depth"), reason.alias("reason"))


def merge_flags(a: DataFrame, b: DataFrame) -> DataFrame:
    """Flags and numbers of two walks by seed: a flag holds if one of them has it, of stopped_at_depth the first that is
    known counts, and numbers are the greater ones."""
    flags = ("impacted_truncated", "tests_truncated", "ceiling_reached")
    u = a.unionByName(b)
    return u.groupBy("seed").agg(*[F.max(c).alias(c) for c in ("impacted", "tests", "tests_past_depth")], *[F.bool_or(c).alias(c) for c in flags], F.max("stopped_at_depth").alias("stopped_at_depth"))


def seeds_by_name(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, seed, candidates): what names mean as seeds (query, and perhaps path): a plain name its definitions, one of
    several segments those whose owners fit; a path narrows them. More than one candidate is ambiguous."""
    plain = queries.where(~F.col("query").rlike(r"::|\."))
    own = plain.join(symbols.select("symbol_id", F.col("name").alias("query"), F.col("path").alias("at")), "query").select("query", "path", F.col("symbol_id").alias("seed"), "at")
    chains = lookup.qualified(symbols, queries.where(F.col("query").rlike(r"::|\.")).select("query")).select("query", "symbol_id")
    far = queries.join(chains, "query").join(symbols.select("symbol_id", F.col("path").alias("at")), "symbol_id").select("query", "path", F.col("symbol_id").alias("seed"), "at")
    hit = own.unionByName(far).where("path IS NULL OR path = at").select("query", "path", "seed").distinct()
    n = hit.groupBy("query", "path").agg(F.count("*").alias("candidates"))
    return hit.withColumnRenamed("path", "p").join(n.withColumnRenamed("query", "q"), (F.col("query") == F.col("q")) & F.col("p").eqNullSafe(F.col("path"))).select("query", "seed", "candidates")


def seeds_by_file(symbols: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, seed): all symbols of files."""
    return symbols.join(paths.select("path").distinct(), "path").select("path", F.col("symbol_id").alias("seed"))


def seeds_by_hunks(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """(path, seed): the innermost symbols of changed lines; where a line is in none, all symbols of its file."""
    t = diff.touched(symbols, hunks)
    inner = t.where("symbol_id IS NOT NULL").select("path", F.col("symbol_id").alias("seed"))
    whole = seeds_by_file(symbols, t.where("symbol_id IS NULL"))
    return inner.unionByName(whole).distinct()


def file_report(walked: DataFrame, symbols: DataFrame, callers: DataFrame) -> DataFrame:
    """(path, node, depth): who is affected by a change of a file as a whole: the walks and report callers of all its
    symbols, each node at its least depth, the file's own symbols left out."""
    of = symbols.select(F.col("symbol_id").alias("seed"), "path")
    node = symbols.select(F.col("symbol_id").alias("node"), F.col("path").alias("node_path"))
    both = walked.select("seed", "node", "depth").unionByName(callers.select("seed", "node", F.lit(1).alias("depth")))
    j = both.join(of, "seed").join(node, "node").where(~F.col("path").eqNullSafe(F.col("node_path")) & F.col("path").isNotNull())
    return j.groupBy("path", "node").agg(F.min("depth").alias("depth"))
