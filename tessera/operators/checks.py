"""What an edit breaks: candidates from two snapshots, and the sites that they concern."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import CALLABLE
from tessera.operators import diff
from tessera.operators.intervals import holding
from tessera.operators.report import label_rank
from tessera.operators.scan import excluded

MOST_FILES, MOST_CANDIDATES = 200, 30


def candidate_files(changed: DataFrame, files: DataFrame) -> DataFrame:
    """The changed files (path) that a check can read: not excluded, no folders, and either indexed or with an ending that
    some indexed file has."""
    ending = lambda c: F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9_]+)$", 1))
    known = files.select(ending(F.col("path")).alias("ending")).where("ending <> ''").distinct()
    c = changed.where(~excluded(F.col("path")) & ~F.endswith("path", F.lit("/"))).withColumn("ending", ending(F.col("path")))
    own = c.join(files.select("path").distinct(), "path", "left_semi")
    other = c.join(files.select("path").distinct(), "path", "left_anti").join(known, "ending", "left_semi").select(*own.columns)
    return own.unionByName(other).drop("ending")


def prepare(changed: DataFrame, files: DataFrame, texts: DataFrame, most: int = MOST_FILES) -> tuple[DataFrame, DataFrame]:
    """(the first `most` candidate files by path, each with the number of all; one row with a digest of their contents)."""
    c = candidate_files(changed.select("path").distinct(), files)
    listed = c.orderBy("path").limit(most).withColumn("found", F.lit(c.count()).cast("bigint"))  # one number
    return listed, diff.content_digest(listed.join(texts.groupBy("path").agg(F.max("content").alias("content")), "path", "left").select("path", "content"))


def parent_names(symbols: DataFrame, up: DataFrame) -> DataFrame:
    """symbols with owner: the names of all enclosing symbols, outermost first, joined by a unit separator; '' at the top."""
    names = symbols.select(F.col("symbol_id").alias("ancestor_id"), F.coalesce("name", F.lit("")).alias("n"))
    chain = up.join(names, "ancestor_id").groupBy("symbol_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "n"))).alias("c"))
    chain = chain.select("symbol_id", F.array_join(F.transform("c", lambda x: x["n"]), "\x1f").alias("owner"))
    return symbols.drop("owner").join(chain, "symbol_id", "left").withColumn("owner", F.coalesce("owner", F.lit("")))


def parameter_names(signature: Column) -> Column:
    """The names of a signature's parameters, receivers aside: of `name: Type`, `Type name`, `name = 1`, `*name`."""
    inner = F.regexp_extract(F.coalesce(signature, F.lit("")), r"\(([^()]*)\)", 1)
    parts = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.split(x, "=")[0], r":.*$", ""), r"^[\s*&.]+", ""))), lambda x: x != "")
    names = F.transform(parts, lambda x: F.regexp_extract(x, r"([A-Za-z_$][\w$]*)\??\s*$", 1))
    return F.filter(names, lambda x: (x != "") & ~x.isin("self", "this", "cls"))


def keywords(signature: Column) -> Column:
    """The words in front of a callable's name that change how it is called."""
    head = F.regexp_extract(F.coalesce(signature, F.lit("")), r"^([^(]*)", 1)
    return F.array_sort(F.array_intersect(F.split(F.lower(head), r"\W+"), F.array(*map(F.lit, ("static", "async", "abstract", "const", "unsafe", "override", "virtual", "final", "suspend")))))


def callable_changes(base: DataFrame, current: DataFrame, pairs: DataFrame) -> DataFrame:
    """(base_id, current_id, change, detail) of paired callables that are called in another way: parameters (their number),
    renamed (a parameter has another name in its place), keywords (static, async and the like), signature (else)."""
    cols = lambda d, t: d.where(F.col("kind").isin(*CALLABLE)).select(F.col("symbol_id").alias(f"{t}_id"), parameter_names(F.col("signature")).alias(f"{t}_p"), keywords(F.col("signature")).alias(f"{t}_k"),
                                                                      diff.signature_tail(F.col("signature")).alias(f"{t}_t"))
    j = pairs.join(cols(base, "base"), "base_id").join(cols(current, "current"), "current_id")
    renamed = F.filter(F.zip_with("base_p", "current_p", lambda a, b: F.when(~a.eqNullSafe(b), F.concat(a, F.lit(">"), b))), lambda x: x.isNotNull())
    change = (F.when(F.size("base_p") != F.size("current_p"), F.struct(F.lit("parameters").alias("c"), F.concat(F.size("base_p").cast("string"), F.lit(">"), F.size("current_p").cast("string")).alias("d")))
              .when(F.size(renamed) > 0, F.struct(F.lit("renamed").alias("c"), F.array_join(renamed, ",").alias("d")))
              .when(~F.col("base_k").eqNullSafe(F.col("current_k")), F.struct(F.lit("keywords").alias("c"), F.concat(F.array_join("base_k", " "), F.lit(">"), F.array_join("current_k", " ")).alias("d")))
              .when(F.col("base_t") != F.col("current_t"), F.struct(F.lit("signature").alias("c"), F.lit("").alias("d"))))
    return j.select("base_id", "current_id", change.alias("v")).where("v IS NOT NULL").select("base_id", "current_id", F.col("v.c").alias("change"), F.col("v.d").alias("detail"))


def shapes(base: DataFrame, current: DataFrame, pairs: DataFrame) -> DataFrame:
    """(base_id, current_id, change, detail): every change that may break code elsewhere: renamed and moved symbols, removed
    ones that are neither, callables that are called in another way, and other visibility."""
    names = current.select(F.col("symbol_id").alias("current_id"), F.col("name").alias("new_name"), F.col("path").alias("new_path"))
    moved = diff.moves(base, current, pairs).join(names, "current_id").select("base_id", "current_id", F.lit("move").alias("change"), F.col("new_path").alias("detail"))
    renamed = diff.renames(base, current, pairs).join(names, "current_id").select("base_id", "current_id", F.lit("rename").alias("change"), F.col("new_name").alias("detail"))
    kept = moved.select("base_id").unionByName(renamed.select("base_id"))
    removed = pairs.where("current_id IS NULL").select("base_id").join(kept, "base_id", "left_anti").select("base_id", F.lit(None).cast("string").alias("current_id"), F.lit("removed").alias("change"), F.lit("").alias("detail"))
    seen = diff.changes(base, current, pairs.where("base_id IS NOT NULL AND current_id IS NOT NULL")).where("change = 'visibility'").select("base_id", "current_id", "change", F.lit("").alias("detail"))
    called = callable_changes(base, current, pairs.where("base_id IS NOT NULL AND current_id IS NOT NULL"))
    return reduce(DataFrame.unionByName, [moved, renamed, removed, seen, called])


def takes(least: Column, most: Column) -> Column:
    """How many arguments a range means, in words."""
    return F.when(most.isNull(), F.concat(least.cast("string"), F.lit(" or more"))).when(least == most, least.cast("string")).otherwise(F.concat_ws(" to ", least.cast("string"), most.cast("string")))


def _noun(n: Column) -> Column:
    return F.when(n == 1, "argument").otherwise("arguments")


def place_calls(sites: DataFrame, ranges: DataFrame, hunks: DataFrame) -> DataFrame:
    """(target, site, place, note): the calls (site, target, path, line, label, args; null args: not known) of changed
    callables (symbol_id, least, most as they are now). Excluded ones and such that still fit outside the diff say nothing;
    one whose number of arguments is not taken any more keeps its label, with a note; one that fits or says nothing inside
    the diff is in_diff; one whose arguments are not known is unresolved."""
    touched = holding(sites.select("path", "line").distinct(), hunks.select("path", "start_line", "end_line"), "path").select("path", "line", F.lit(True).alias("touched")).distinct()
    r = ranges.select(F.col("symbol_id").alias("target"), "least", "most")
    j = sites.where("label <> 'excluded'").join(r, "target").join(touched, ["path", "line"], "left")
    known, fits = F.col("args").isNotNull(), (F.col("args") >= F.col("least")) & (F.col("most").isNull() | (F.col("args") <= F.col("most")))
    inside = F.coalesce("touched", F.lit(False))
    note = F.when(known & ~fits, F.concat(F.lit("passes "), F.col("args").cast("string"), F.lit(" "), _noun(F.col("args")), F.lit("; takes "), takes(F.col("least"), F.col("most"))))
    place = F.when(known & ~fits, F.col("label")).when(inside, "in_diff").when(~known, "unresolved")
    return j.select("target", "site", place.alias("place"), note.alias("note")).where("place IS NOT NULL")


def removed_overloads(sites: DataFrame, remaining: DataFrame, hunks: DataFrame) -> DataFrame:
    """(name, site, place, note): the calls (site, name, path, line, label, args) of a name that lost an overload, against
    the ranges of those that remain (name, least, most): what one of them takes says nothing; what none takes keeps its
    label; what is not known is unresolved, unless it stands in the diff."""
    touched = holding(sites.select("path", "line").distinct(), hunks.select("path", "start_line", "end_line"), "path").select("path", "line", F.lit(True).alias("touched")).distinct()
    ok = F.bool_or((F.col("args") >= F.col("least")) & (F.col("most").isNull() | (F.col("args") <= F.col("most"))))
    need = sites.select("name", "args").where("args IS NOT NULL").distinct().join(remaining, "name").groupBy("name", "args").agg(ok.alias("fits"))
    j = sites.where("label <> 'excluded'").join(need, ["name", "args"], "left").join(touched, ["path", "line"], "left")
    unknown = F.col("args").isNull()
    place = F.when(unknown & F.col("touched").isNull(), "unresolved").when(~unknown & ~F.coalesce("fits", F.lit(False)), F.col("label"))
    note = F.when(~unknown & ~F.coalesce("fits", F.lit(False)), F.concat(F.lit("passes "), F.col("args").cast("string"), F.lit(" "), _noun(F.col("args")), F.lit("; no remaining overload takes it")))
    return j.select("name", "site", place.alias("place"), note.alias("note")).where("place IS NOT NULL")


def import_lines(removed: DataFrame, bindings: DataFrame) -> DataFrame:
    """(symbol_id, path, line): the lines that import a removed symbol (symbol_id, name, path) by its name from its file
    (bindings: path, line, name, imported)."""
    b = bindings.select(F.col("path").alias("at"), "line", "name", F.col("imported").alias("path"))
    return removed.join(b, ["name", "path"]).select("symbol_id", F.col("at").alias("path"), "line")


def broken_constructions(builds: DataFrame, added: DataFrame) -> DataFrame:
    """(owner, path, line, missing): constructions (owner, path, line, text) that name their fields one by one but not all
    of the added ones (owner, field, required); one that takes the rest from elsewhere (.., ...) breaks nothing."""
    named = F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w*)\s*[:=]"), 1)
    rest = F.col("text").rlike(r"\.\.")
    need = added.where("required").groupBy("owner").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    j = builds.where(~rest & F.col("text").rlike(r"[({]")).join(need, "owner").withColumn("missing", F.array_except("fields", named))
    return j.where("size(missing) > 0").select("owner", "path", "line", F.array_join("missing", ",").alias("missing"))


def missing_arms(arms: DataFrame, added: DataFrame) -> DataFrame:
    """(owner, match, missing): matches over an enumeration (arms: match, owner, variant; null variant: an arm for all else)
    that have no arm for a variant that was added (owner, variant) and none for all else."""
    open_ = arms.groupBy("match").agg(F.bool_or(F.col("variant").isNull()).alias("rest"), F.min("owner").alias("owner"), F.collect_set("variant").alias("has")).where("NOT rest")
    new = added.groupBy("owner").agg(F.array_sort(F.collect_set("variant")).alias("new"))
    j = open_.join(new, "owner").withColumn("missing", F.array_except("new", "has"))
    return j.where("size(missing) > 0").select("owner", "match", F.array_join("missing", ",").alias("missing"))


def edited_since(blocked: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, line, edited): whether a blocked site's line (path, line, digest as it was) reads otherwise now, or is gone."""
    now = lines.select("path", "line", F.md5("text").alias("now"))
    return blocked.join(now, ["path", "line"], "left").select("path", "line", (~F.col("digest").eqNullSafe(F.col("now"))).alias("edited"))


def cap_candidates(changes: DataFrame, uses: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """The first changes by how often their name is used (uses: name, uses), then by path and line, each with its place and
    the number of all (found)."""
    n = changes.count()  # one number
    j = changes.join(uses.select("name", "uses"), "name", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    top = j.orderBy(F.col("uses").desc(), F.col("path").asc_nulls_last(), F.col("start_line").asc_nulls_last(), "base_id").limit(most)
    return top.withColumn("found", F.lit(n).cast("bigint"))


def sections(rows: DataFrame, section: str, order: list, offset: int, limit: int) -> DataFrame:
    """One page of each section, each row with its place and its section's number of rows (found), and whether rows follow
    the page (more)."""
    if not 0 <= limit <= 200 or offset < 0:
        raise ValueError("limit must lie in 0..200 and offset must not be negative")
    found = rows.groupBy(section).agg(F.count("*").alias("found"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(section).orderBy(*order))).where((F.col("place") > offset) & (F.col("place") <= offset + limit))
    return placed.join(found, section).withColumn("more", F.col("found") > offset + limit)


def fit(levels: DataFrame, budget: int = 32_000) -> DataFrame:
    """(key, level, text): for each key the richest text (levels: key, level from 0, text) that the budget of characters
    holds; where none fits, the barest one, cut."""
    w = Window.partitionBy("key")
    ok = F.length("text") <= budget
    pick = F.coalesce(F.min(F.when(ok, F.col("level"))).over(w), F.max("level").over(w))
    return levels.withColumn("pick", pick).where("level = pick").select("key", "level", F.substring("text", 1, budget).alias("text"))


def outline_levels(symbols: DataFrame, key: Column, steps: tuple[int, ...] = (5, 3, 2, 1, 0)) -> DataFrame:
    """(key, level, text): an outline of each key's files with ever fewer names a file, for fit()."""
    order = Window.partitionBy("path").orderBy(F.col("start_line").asc_nulls_last(), "symbol_id")
    s = symbols.where("path IS NOT NULL").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= max(steps) + 1)
    file_ = s.groupBy(key.alias("key"), "path").agg(F.array_sort(F.collect_list(F.struct("rn", F.coalesce("name", F.lit("")).alias("name")))).alias("names"))
    out = None
    for level, n in enumerate(steps):
        names = F.array_join(F.transform(F.filter("names", lambda x: x["rn"] <= n), lambda x: x["name"]), ", ")
        line = F.when(names == "", F.col("path")).otherwise(F.concat("path", F.lit(": "), names))
        one = file_.select("key", F.struct("path", line.alias("line")).alias("l")).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("text")).select("key", F.lit(level).alias("level"), "text")
        out = one if out is None else out.unionByName(one)
    return out


def stop_text(placed: DataFrame, most: int = 15) -> DataFrame:
    """(target, sites, found): what an edit is stopped for: the first proven sites outside the diff; likely ones, and all
    that only a changed signature concerns, never stop it. found counts all of them."""
    p = placed.where("place = 'proven'")
    w = Window.partitionBy("target").orderBy(label_rank(F.col("place")), "site")
    r = p.withColumn("rn", F.row_number().over(w))
    return r.groupBy("target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= most, F.struct("rn", "site")))), lambda x: x["site"]), "\n").alias("sites"), F.count("*").alias("found"))
