"""Imports between files and hierarchies of types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import folder
from tessera.operators.walk import reach


def imported_stems(lines: DataFrame) -> DataFrame:
    """(path, stem): what the import lines of a file name, by the last part of the name: import a.b, use a::b, using A.B,
    #include "a/b.h", import ... from './a/b'. Lower case."""
    name = F.coalesce(
        F.nullif(F.regexp_extract("text", r"""^\s*import\s.*from\s+['"][^'"]*?([A-Za-z0-9_]+)['"]""", 1), F.lit("")),
        F.nullif(F.regexp_extract("text", r'^\s*#include\s+"(?:[^"]*/)?([A-Za-z0-9_]+)\.\w+"', 1), F.lit("")),
        F.nullif(F.regexp_extract("text", r"^\s*(?:import|use|using)\s+(?:[\w.:]*[.:])?([A-Za-z0-9_]+);?\s*$", 1), F.lit("")))
    return lines.select("path", F.lower(name).alias("stem")).where("stem IS NOT NULL").distinct()


def import_edges(stems: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): files and the files of the same project (first folder, below monorepo/ the second) whose name begins
    with what they import."""
    project = lambda c: F.regexp_extract(c, r"^(monorepo/[^/]+|[^/]+)", 1)
    stem = F.lower(F.regexp_extract("path", r"([^/.]*)[^/]*$", 1))
    f = files.select(F.col("path").alias("dst"), project(F.col("path")).alias("project"), stem.alias("stem"))
    s = stems.select(F.col("path").alias("src"), project(F.col("path")).alias("project"), "stem")
    return s.join(f, ["project", "stem"]).where("src <> dst").select("src", "dst").distinct()


def follow_imports(edges: DataFrame, seeds: DataFrame, hops: int = 4, most: int = 64) -> DataFrame:
    """(seed, node, depth): the files that a file imports, directly or through others, at most `hops` steps and the `most`
    nearest (of equal ones by path)."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = reach(turned, seeds, hops)
    w = Window.partitionBy("seed").orderBy("depth", "node")
    return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


def hierarchy(edges: DataFrame, seeds: DataFrame, depth: int = 8, most: int = 50) -> DataFrame:
    """(seed, node, depth): the types above each seed over (src extends dst), nearest first; turn the edges for those
    below."""
    return follow_imports(edges, seeds, depth, most)


#: Kinds that extend others.
EXTENDING = ("class", "struct", "interface", "trait", "record")
#: What follows a type's name in its signature: after extends, implements or a colon, or in brackets (Python).
_BASES = r"(?:\b(?:extends|implements)\b|:|^\s*class\s+\w+\s*\()\s*(.*)$"
BASES_SQL = f"regexp_extract(signature, '{_BASES}', 1)"


def base_names(symbols: DataFrame) -> DataFrame:
    """(src, name): the names that the signatures of types extend or implement."""
    t = symbols.where(F.col("kind").isin(*EXTENDING))
    return t.select(F.col("symbol_id").alias("src"), F.explode(F.regexp_extract_all(F.regexp_extract("signature", _BASES, 1), F.lit(r"([A-Z]\w*)"), 1)).alias("name")).distinct()


def _only_types(symbols: DataFrame) -> DataFrame:
    t = symbols.where(F.col("kind").isin(*EXTENDING) & F.col("name").isNotNull())
    return t.groupBy("name").agg(F.count("*").alias("n"), F.min("symbol_id").alias("dst")).where("n = 1").select("name", "dst")


def type_edges(symbols: DataFrame) -> DataFrame:
    """(src, dst): symbol ids of types and of the only types of the names that their signatures extend or implement."""
    return base_names(symbols).join(_only_types(symbols), "name").where("src <> dst").select("src", "dst").distinct()


def pending_type_edges(symbols: DataFrame) -> DataFrame:
    """(src, name): the other names that types extend or implement, of no type or of several."""
    return base_names(symbols).join(_only_types(symbols), "name", "left_anti").select("src", "name")


def nearest_types(edges: DataFrame, types: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(src, dst): what edges to a name (src, name, path) extend: the type (symbol_id, name, path) of that name that shares
    the most leading folders with the edge's file; several equally near ones all count. A name that its file binds to
    another one by an import (aliases: path, alias, name) stands for that. Types are compared by folder prefix, so a name
    with many types is joined by (name, prefix)."""
    e = edges.select("src", "name", "path")
    if aliases is not None:
        real = aliases.select("path", F.col("alias").alias("name"), F.col("name").alias("real")).distinct()
        e = e.join(real, ["path", "name"], "left").select("src", F.coalesce("real", "name").alias("name"), "path")
    up = lambda c: F.transform(F.sequence(F.lit(0), F.size(F.split(folder(c), "/"))), lambda i: F.array_join(F.slice(F.split(folder(c), "/"), 1, i), "/"))
    t = types.select(F.col("symbol_id").alias("dst"), "name", F.explode(F.array_distinct(up(F.col("path")))).alias("prefix"))
    w = e.distinct().select("src", "name", "path", F.posexplode(up(F.col("path"))).alias("depth", "prefix"))
    n = t.groupBy("name", "prefix").agg(F.count("*").alias("n"))
    best = w.join(n, ["name", "prefix"]).groupBy("src", "name", "path").agg(F.max_by("prefix", "depth").alias("prefix"))
    return best.join(t, ["name", "prefix"]).where("src <> dst").select("src", "dst").distinct()


def unique_owner(members: DataFrame, owners: DataFrame) -> DataFrame:
    """(member, owner): for each member (member, owner_name, path, package) that stands outside its type the one type (owner,
    name, path, package) of that name in its folder; of several in the folder the one of the same package, of several
    there the one in the same file; else none. Each step counts the types by what it looks at."""
    o = owners.select("owner", F.col("name").alias("owner_name"), F.col("path").alias("o_path"), F.col("package").alias("o_package"), folder(F.col("path")).alias("folder"))
    keys = [["owner_name", "folder"], ["owner_name", "folder", "o_package"], ["owner_name", "folder", "o_path"]]
    m = members.select("member", "owner_name", folder(F.col("path")).alias("folder"), F.col("package").alias("o_package"), F.col("path").alias("o_path"))
    # in the last step only types of the member's own package are left
    same = m.select("member", "owner_name", "folder", "o_package", "o_path")
    one = lambda k, extra=(): o.groupBy(*k, *extra).agg(F.count("*").alias("n"), F.min("owner").alias("owner"))
    first = same.join(one(keys[0]), keys[0])
    second = first.where("n > 1").drop("n", "owner").join(one(keys[1]), keys[1])
    third = second.where("n > 1").drop("n", "owner").join(one(keys[2], ("o_package",)), [*keys[2], "o_package"])
    pick = lambda d: d.where("n = 1").select("member", "owner")
    return pick(first).unionByName(pick(second)).unionByName(pick(third))


def nearest_depth(rows: DataFrame, key: str, depth: str = "depth") -> DataFrame:
    """The rows of each key at its least depth, all of them where several share it."""
    return rows.withColumn("_least", F.min(depth).over(Window.partitionBy(key))).where(F.col(depth) == F.col("_least")).drop("_least")


def inherited(methods: DataFrame, above: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, method_id, depth): for types (seed) the methods (symbol_id, name, owner_id) of the types above them, of each
    name the nearest, names that the type itself has left out."""
    m = methods.select(F.col("symbol_id").alias("method_id"), "name", F.col("owner_id").alias("node"))
    own = m.select(F.col("node").alias("seed"), "name").distinct()
    j = seeds.join(above, "seed").join(m, "node").join(own, ["seed", "name"], "left_anti")
    return j.groupBy("seed", "name").agg(F.min(F.struct("depth", "method_id")).alias("m")).select("seed", "m.method_id", "m.depth")


def reaches(sites: DataFrame, definitions: DataFrame, closure: DataFrame) -> DataFrame:
    """(site, definition): the definitions (definition, name, path) that a use (site, name, path) can see: in its file or in
    one that its file includes or loads, directly or through others (closure: seed, node). Joined by name and file."""
    d = definitions.select("definition", "name", F.col("path").alias("node"))
    own = sites.select("site", "name", F.col("path").alias("node"))
    far = sites.select("site", "name", F.col("path").alias("seed")).join(closure.select("seed", "node"), "seed").select("site", "name", "node")
    return own.unionByName(far).distinct().join(d, ["name", "node"]).select("site", "definition")


def receiver_chain(chains: DataFrame, members: DataFrame, most: int = 8192) -> DataFrame:
    """(chain, owner, complete): the type that a chain of members (chain, start, names) ends at: from a type's id each name
    leads on to the type of the member (owner, name, type) of that name, at most eight steps. complete is false, and the
    owner null, where a member is not known or has several types, or where more than `most` are."""
    one = members.groupBy("owner", "name").agg(F.countDistinct("type").alias("n"), F.min("type").alias("type")).where(f"n <= {most}")
    state = chains.select("chain", F.col("start").alias("owner"), "names", F.lit(True).alias("complete"))
    for k in range(8):
        step = state.select("chain", "owner", "names", "complete", F.get("names", F.lit(k)).alias("name")).join(one, ["owner", "name"], "left")
        on = F.col("name").isNull()
        state = step.select("chain", F.when(on, F.col("owner")).when(F.col("n") == 1, F.col("type")).alias("owner"), "names", (F.col("complete") & (on | F.coalesce(F.col("n") == 1, F.lit(False)))).alias("complete"))
    whole = F.col("complete") & (F.size("names") <= 8)
    return state.select("chain", F.when(whole, F.col("owner")).alias("owner"), whole.alias("complete"))


def overrides(members: DataFrame, above: DataFrame) -> DataFrame:
    """(symbol_id, overridden_id, depth): methods whose owner has a type above it with a method of that name; the nearest.
    members: symbol_id, name, owner_id; above: (seed, node, depth) of a hierarchy."""
    up = members.select(F.col("symbol_id").alias("overridden_id"), "name", F.col("owner_id").alias("node"))
    j = members.join(above.withColumnRenamed("seed", "owner_id"), "owner_id").join(up, ["node", "name"])
    return j.groupBy("symbol_id").agg(F.min(F.struct("depth", "overridden_id")).alias("m")).select("symbol_id", "m.overridden_id", "m.depth")


def related_types(symbols: DataFrame) -> DataFrame:
    """(symbol_id, type_id): types that a callable's signature names, each name having one definition only."""
    t = symbols.where(F.col("kind").isin("class", "struct", "interface", "trait", "record", "enum") & F.col("name").isNotNull()).groupBy("name").agg(F.count("*").alias("n"), F.min("symbol_id").alias("type_id")).where("n = 1")
    words = F.array_distinct(F.regexp_extract_all("signature", F.lit(r"\b([A-Z]\w*)\b"), 1))
    return symbols.where(F.col("kind").isin("function", "method", "constructor")).select("symbol_id", F.explode(words).alias("name")).join(t, "name").select("symbol_id", "type_id").distinct()
