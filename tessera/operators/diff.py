"""Comparison of two snapshots of the symbols: pairs, renames, moves, changes, and what they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import intervals
from tessera.operators.intervals import innermost

KEY = ["path", "owner", "kind", "name"]


def keyed(symbols: DataFrame) -> DataFrame:
    """Rows with owner: the name of the parent, '' at the top."""
    p = symbols.select(F.col("symbol_id").alias("parent_symbol_id"), F.col("name").alias("owner"))
    return symbols.join(p, "parent_symbol_id", "left").withColumn("owner", F.coalesce("owner", F.lit("")))


def signature_tail(signature: Column) -> Column:
    """A signature from its first bracket, blanks aside."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(signature, F.lit("")), r"^[^(]*", ""), r"\s+", "")


def pair(base: DataFrame, current: DataFrame) -> DataFrame:
    """(base_id, current_id) of the same symbols in two snapshots; one side is null for removed and added ones.

    Rows are grouped by file, owner, kind and name. In groups of equal size on both sides rows pair in source order; in
    others first rows with equal signature tails pair in source order, then the rest in source order. Both sides stand in
    one table that is shuffled once, by group; numbers inside it say which rows meet, so a group of any size is sorted,
    not paired out.
    """
    order = [F.col("start_line").asc_nulls_first(), F.col("start_byte").asc_nulls_first(), F.col("symbol_id")]

    def side(df, tag):
        return df.select(*KEY, "start_line", "start_byte", "symbol_id", signature_tail(F.col("signature")).alias("tail"), F.lit(tag).alias("side"))

    group = Window.partitionBy(*KEY)
    rows = side(base, 0).unionByName(side(current, 1))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*KEY, "side").orderBy(*order)))
    rows = rows.withColumn("even", F.count_if(F.col("side") == 0).over(group) == F.count_if(F.col("side") == 1).over(group))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*KEY, "side", "tail").orderBy("rn")))
    rows = rows.withColumn("slot", F.when(F.col("even"), F.concat(F.lit("e"), "rn")).otherwise(F.concat(F.lit("t"), "k", F.lit(":"), "tail")))
    rows = rows.withColumn("met", F.count("*").over(Window.partitionBy(*KEY, "slot")) == 2)
    rest = F.row_number().over(Window.partitionBy(*KEY, "side", "met").orderBy("rn"))
    rows = rows.withColumn("slot", F.when(F.col("met"), F.col("slot")).otherwise(F.concat(F.lit("r"), rest)))
    one = lambda n: F.max(F.when(F.col("side") == n, F.col("symbol_id")))
    return rows.groupBy(*KEY, "slot").agg(one(0).alias("base_id"), one(1).alias("current_id")).select("base_id", "current_id")


def renames(base: DataFrame, current: DataFrame, pairs: DataFrame) -> DataFrame:
    """(base_id, current_id) of removed and added symbols with the same file, owner, kind and body, the body hash being
    alone among the leftovers on both sides."""
    keys = ["path", "owner", "kind", "body_hash"]
    left = base.join(pairs.where("current_id IS NULL").select(F.col("base_id").alias("symbol_id")), "symbol_id", "left_semi")
    new = current.join(pairs.where("base_id IS NULL").select(F.col("current_id").alias("symbol_id")), "symbol_id", "left_semi")
    alone = lambda d, tag: d.where("body_hash IS NOT NULL AND body_hash <> ''").groupBy(*keys).agg(F.count("*").alias("n"), F.min("symbol_id").alias(f"{tag}_id")).where("n = 1").drop("n")
    return alone(left, "base").join(alone(new, "current"), keys).select("base_id", "current_id")


def moves(base: DataFrame, current: DataFrame, pairs: DataFrame) -> DataFrame:
    """(base_id, current_id) of removed and added symbols that agree in kind, name, owner and body but for the file, alone
    on both sides."""
    keys = ["kind", "name", "owner", "body_hash"]
    left = base.join(pairs.where("current_id IS NULL").select(F.col("base_id").alias("symbol_id")), "symbol_id", "left_semi")
    new = current.join(pairs.where("base_id IS NULL").select(F.col("current_id").alias("symbol_id")), "symbol_id", "left_semi")
    alone = lambda d, tag: d.where("body_hash IS NOT NULL AND body_hash <> ''").groupBy(*keys).agg(F.count("*").alias("n"), F.min("symbol_id").alias(f"{tag}_id"), F.min("path").alias(f"{tag}_path")).where("n = 1").drop("n")
    return alone(left, "base").join(alone(new, "current"), keys).where("base_path <> current_path").select("base_id", "current_id")


def changes(base: DataFrame, current: DataFrame, pairs: DataFrame) -> DataFrame:
    """(base_id, current_id, change) for pairs that differ: signature (its tail differs), visibility, body."""
    b = base.select(F.col("symbol_id").alias("base_id"), signature_tail(F.col("signature")).alias("t1"), F.col("visibility").alias("v1"), F.col("body_hash").alias("h1"))
    c = current.select(F.col("symbol_id").alias("current_id"), signature_tail(F.col("signature")).alias("t2"), F.col("visibility").alias("v2"), F.col("body_hash").alias("h2"))
    j = pairs.join(b, "base_id").join(c, "current_id")
    change = F.when(F.col("t1") != F.col("t2"), "signature").when(~F.col("v1").eqNullSafe(F.col("v2")), "visibility").when(~F.col("h1").eqNullSafe(F.col("h2")), "body")
    return j.select("base_id", "current_id", change.alias("change")).where("change IS NOT NULL")


def member_changes(base: DataFrame, current: DataFrame) -> DataFrame:
    """(path, owner, added, removed): names of the fields and properties that an owner gains and loses, sorted."""
    def sets(d, n):
        return d.where(F.col("kind").isin("field", "property", "enum_member") & (F.col("owner") != "") & F.col("path").isNotNull()).groupBy("path", "owner").agg(F.array_sort(F.collect_set("name")).alias(n))
    none = F.array().cast("array<string>")
    j = sets(base, "b").join(sets(current, "c"), ["path", "owner"], "full").select("path", "owner", F.coalesce("b", none).alias("b"), F.coalesce("c", none).alias("c"))
    j = j.select("path", "owner", F.array_join(F.array_except("c", "b"), ",").alias("added"), F.array_join(F.array_except("b", "c"), ",").alias("removed"))
    return j.where("added <> '' OR removed <> ''")


def touched(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """(path, line, symbol_id): for each line of each hunk (path, start_line, end_line) the innermost symbol that holds it,
    the shortest one, null where none does."""
    at = hunks.where("end_line >= start_line").select("path", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()
    spans = symbols.select("path", "start_line", "end_line", F.col("symbol_id").alias("span"))
    return at.join(innermost(at, spans, "path", F.col("end_line") - F.col("start_line")), ["path", "line"], "left").select("path", "line", F.col("span").alias("symbol_id"))


def overlapping(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """(symbol_id, hunks): how many hunks of its file overlap each symbol's lines."""
    h = hunks.select("path", F.col("start_line").alias("from_line"), F.col("end_line").alias("to_line"))
    j = intervals.overlapping(symbols.select("symbol_id", "path", "start_line", "end_line"), h, "path")
    return j.groupBy("symbol_id").agg(F.count("*").alias("hunks"))


def tests_to_run(direct: DataFrame, walked: DataFrame, limit: int = 50) -> DataFrame:
    """(test_id, why, place): tests that use a change directly, the first of each change before the second, then tests
    that a walk finds; each test once, at most `limit`. direct and walked: (change, test_id)."""
    d = direct.withColumn("turn", F.row_number().over(Window.partitionBy("change").orderBy("test_id"))).groupBy("test_id").agg(F.min("turn").alias("turn")).select("test_id", F.lit("direct").alias("why"), F.lit(0).alias("g"), "turn")
    w = walked.select("test_id").distinct().join(d.select("test_id"), "test_id", "left_anti").select("test_id", F.lit("walked").alias("why"), F.lit(1).alias("g"), F.lit(0).alias("turn"))
    return d.unionByName(w).orderBy("g", "turn", "test_id").limit(limit).select("test_id", "why")


def content_digest(files: DataFrame) -> DataFrame:
    """One row: a digest of all (path, content) in the order of the paths' digests, from digests of the files. Files are
    digested by the first six digits of their path's digest, these by the first three, and these 4,096 into one: with 10^9
    files a row holds some 60, 4,096 and 4,096 digests."""
    level = files.select(F.sha2("path", 256).alias("p"), F.sha2(F.concat(F.sha2("path", 256), F.sha2(F.coalesce("content", F.lit("")), 256)), 256).alias("h"))
    of = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("h")
    for digits in (6, 3):
        level = level.groupBy(F.substring("p", 1, digits).alias("q")).agg(of).select(F.col("q").alias("p"), "h")
    return level.agg(of).select(F.col("h").alias("digest"))
