"""Evidence that ties uses of names to definitions, over the edge tables of an extractor.

sites: site (unique), from_symbol_id, name, path, line, language, receiver, namespace (array of names in front of the
receiver or of `::`), and perhaps args. symbols: symbol_id, name, kind, path, language, parent_symbol_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import CALLABLE, TYPES, family
from tessera.functions.paths import folder
from tessera.operators.intervals import holding
from tessera.session import cut

# Receivers that stand for the object itself, and languages in which a bare name may be a member of it.
SELF = ("self", "this", "cls", "Self", "super")
IMPLICIT = ("java", "csharp", "kotlin", "swift", "cpp", "scala", "dart", "ruby", "vbnet", "php")
#: Languages whose files of one folder see each other's top-level names.
PACKAGES = ("go", "java")
#: Tables of counts with at most so many rows go to all tasks; larger ones are left to Spark's own size check.
LOOKUP_ROWS = 100_000
#: The kinds of evidence in the order in which they count.
BASES = ("qualified path", "class chain", "import", "receiver type", "same file", "enclosing scope", "same package")


def import_spans(symbols: DataFrame, relationships: DataFrame, pending: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(path, start_line, end_line) of what imports names, from the four tables that know of imports."""
    kinds = F.col("kind").isin("import", "imports")
    line = lambda d: d.where(kinds).select("path", "start_line", F.col("start_line").alias("end_line"))
    own = symbols.where(kinds).select("path", "start_line", F.coalesce("end_line", "start_line").alias("end_line"))
    return reduce(DataFrame.unionByName, [own, line(relationships), line(pending), line(identifiers)]).where("start_line IS NOT NULL").distinct()


def name_rows(symbols: DataFrame, relationships: DataFrame, pending: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(src, from_symbol_id, name, kind, path, line, column, receiver, namespace, target_id): all that uses a name, from
    resolved edges (src R), edges to a name (P) and identifiers (I). What stands in an import or, for identifiers, on the
    line where a symbol of that name begins, uses nothing. Broken namespace JSON gives no namespace."""
    names = symbols.select(F.col("symbol_id").alias("to_symbol_id"), "name")
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    cols = lambda d, src, name, receiver, namespace, target: d.select(
        F.lit(src).alias("src"), "from_symbol_id", name.alias("name"), "kind", "path", F.col("start_line").alias("line"), F.col("start_column").alias("column"), receiver.alias("receiver"),
        F.coalesce(namespace, empty).alias("namespace"), target.alias("target_id"))
    r = cols(relationships.where("kind NOT IN ('import', 'imports')").join(names, "to_symbol_id"), "R", F.col("name"), none, empty, F.col("to_symbol_id"))
    p = cols(pending.where("kind NOT IN ('import', 'imports')"), "P", F.col("target_terminal_name"), F.nullif("target_receiver", F.lit("")), F.from_json("target_namespace_json", "array<string>"), none)
    i = cols(identifiers.where("kind <> 'import'").withColumnRenamed("containing_symbol_id", "from_symbol_id"), "I", F.col("name"), F.get_json_object("metadata_json", "$.receiver"), empty, none)
    begins = symbols.select("path", F.col("start_line").alias("line"), "name").where("name IS NOT NULL").distinct()
    i = i.join(begins, ["path", "line", "name"], "left_anti")
    rows = r.unionByName(p).unionByName(i).where("name IS NOT NULL")
    spans = import_spans(symbols, relationships, pending, identifiers)
    inside = holding(rows.select("path", "line").distinct(), spans, "path").select("path", "line").distinct()
    return rows.join(inside, ["path", "line"], "left_anti")


def ancestor_names(type_edges: DataFrame, pending_types: DataFrame, types: DataFrame, depth: int = 8) -> DataFrame:
    """(symbol_id, name, depth): names of the types above each type, 0 for its own, over resolved edges (src, dst) and edges
    to a name (src, name), which lead on where only one type bears the name. Circles end; a name counts at its least depth."""
    own = types.select("symbol_id", "name", F.lit(0).alias("depth"))
    named = types.select(F.col("symbol_id").alias("dst"), "name")
    one = types.groupBy("name").agg(F.count("*").alias("n"), F.min("symbol_id").alias("dst")).where("n = 1").select("name", "dst")
    steps = type_edges.join(named, "dst").select("src", "name", "dst").unionByName(pending_types.join(one, "name", "left").select("src", "name", "dst")).distinct()
    steps = cut(steps, "steps")
    out, level = own, own.select("symbol_id", F.col("symbol_id").alias("at"))
    seen = level
    for d in range(1, depth + 1):
        nxt = cut(level.join(steps.withColumnRenamed("src", "at"), "at").select("symbol_id", "name", F.col("dst").alias("at")), "above")
        if nxt.isEmpty():
            break
        out = out.unionByName(nxt.select("symbol_id", "name", F.lit(d).alias("depth")))
        level = cut(nxt.where("at IS NOT NULL").select("symbol_id", "at").distinct().join(seen, ["symbol_id", "at"], "left_anti"), "above")
        seen = seen.unionByName(level)
    return out.groupBy("symbol_id", "name").agg(F.min("depth").alias("depth"))


def scopes(up: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, scope, depth): each symbol itself (0) and what encloses it."""
    return symbols.select("symbol_id", F.col("symbol_id").alias("scope"), F.lit(0).alias("depth")).unionByName(up.select("symbol_id", F.col("ancestor_id").alias("scope"), "depth"))


def receiver_types(sites: DataFrame, around: DataFrame, variables: DataFrame) -> DataFrame:
    """(site, type): the type of a site's receiver by the nearest scope that declares it. variables: (scope, name, type) of
    parameters, locals and fields; a scope that declares the name with several types says nothing, nor does any beyond it."""
    one = variables.groupBy("scope", "name").agg(F.countDistinct("type").alias("n"), F.min("type").alias("type")).withColumnRenamed("name", "receiver")
    s = sites.where("receiver IS NOT NULL").select("site", F.col("from_symbol_id").alias("symbol_id"), "receiver")
    j = s.join(around, "symbol_id").join(one, ["scope", "receiver"])
    best = j.groupBy("site").agg(F.min(F.struct("depth", "n", "type")).alias("b"))
    return best.where("b.n = 1").select("site", "b.type")


def built_types(variables: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, line, variable, type): lines that make a variable by building a type: v = T(...), v = new T(...), let v = T::new(...)."""
    pat = F.lit(r"([A-Za-z_]\w*)\s*(?::=|=)\s*(?:new\s+|&)?([A-Z]\w*)(?:::new|\.new)?[({]")
    z = F.arrays_zip(F.regexp_extract_all("text", pat, 1).alias("variable"), F.regexp_extract_all("text", pat, 2).alias("type"))
    found = lines.select("path", "line", F.explode(z).alias("z")).select("path", "line", "z.variable", "z.type").distinct()
    return found.join(variables.select("type").distinct(), "type", "left_semi") if "type" in variables.columns else found


def _definitions(symbols: DataFrame) -> DataFrame:
    owner = symbols.select(F.col("symbol_id").alias("parent_symbol_id"), F.col("name").alias("owner"))
    d = symbols.where(F.col("kind").isin(*CALLABLE) & F.col("name").isNotNull()).select("symbol_id", "name", "path", "language", "parent_symbol_id", family(F.col("language")).alias("fam"), folder(F.col("path")).alias("folder"))
    return d.join(owner, "parent_symbol_id", "left")


def claims(sites: DataFrame, symbols: DataFrame, around: DataFrame, above: DataFrame, typed: DataFrame, imports: DataFrame) -> DataFrame:
    """(site, basis, n, target): the strongest evidence for each site and the definitions that it speaks for: their number,
    and the one if there is one. Sites without any have no row.

    In order: names in front of it name the definition's owner; it stands for the object itself and an enclosing type or
    one above it owns the definition; its receiver names the owner; its receiver names an imported file of the
    definition; its receiver's type or one above it owns the definition; and for bare names: a top-level definition in
    the same file, one inside an enclosing scope, a member of the own type where the language allows it, a top-level
    definition in an imported file, one of the same package. Of several owners in a chain the nearest counts.

    around: scopes(); above: ancestor_names(); typed: receiver_types(); imports: (path, imported) files.
    Definitions are first counted by what each kind of evidence looks at, so no name meets all its definitions.
    """
    d = _definitions(symbols)
    s = sites.select("site", "from_symbol_id", "name", "path", "language", family(F.col("language")).alias("fam"), folder(F.col("path")).alias("folder"), "receiver", F.coalesce("namespace", F.array().cast("array<string>")).alias("namespace"))
    by = lambda where, *keys: d.where(where).groupBy("name", *keys).agg(F.count("*").alias("n"), F.min("symbol_id").alias("one"))
    top, inner = "parent_symbol_id IS NULL", "parent_symbol_id IS NOT NULL"
    has_ns, has_rec = F.size("namespace") > 0, F.col("receiver").isNotNull()
    bare = ~has_ns & ~has_rec
    own = F.coalesce(F.col("receiver").isin(*SELF), F.lit(False)) | F.array_contains("namespace", "Self")
    found = []

    def add(rank: int, basis: str, rows: DataFrame) -> None:
        depth = F.col("depth") if "depth" in rows.columns else F.lit(0)
        found.append(rows.select("site", F.lit(rank).alias("rank"), depth.alias("depth"), F.lit(basis).alias("basis"), "n", "one"))

    owners = by(inner, "fam", "owner")
    add(1, "qualified path", s.where(has_ns).withColumn("owner", F.explode(F.array_distinct("namespace"))).join(owners, ["name", "fam", "owner"]))
    add(2, "qualified path", s.where(has_ns).join(by(top, "fam"), ["name", "fam"]))
    types = symbols.where(F.col("kind").isin(*TYPES)).select(F.col("symbol_id").alias("scope"))
    enclosing = around.join(types, "scope")
    near = enclosing.groupBy("symbol_id").agg(F.min_by("scope", "depth").alias("type_id"))
    members = by(inner, "fam", "parent_symbol_id")
    mine = s.where(own).withColumnRenamed("from_symbol_id", "symbol_id").join(near, "symbol_id")
    add(3, "class chain", mine.withColumnRenamed("type_id", "parent_symbol_id").join(members, ["name", "fam", "parent_symbol_id"]))
    chain = above.where("depth > 0").select(F.col("symbol_id").alias("type_id"), F.col("name").alias("owner"), "depth")
    add(4, "class chain", mine.join(chain, "type_id").join(owners, ["name", "fam", "owner"]))
    add(5, "qualified path", s.where(has_rec & ~own).withColumn("owner", F.col("receiver")).join(owners, ["name", "fam", "owner"]))
    stem = F.lower(F.regexp_extract("imported", r"([^/.]*)[^/]*$", 1))
    seen = imports.select("path", "imported", stem.alias("stem")).distinct()
    in_file = by(top, "fam", "path").withColumnRenamed("path", "imported")
    add(6, "import", s.where(has_rec & ~own).withColumn("stem", F.lower("receiver")).join(seen, ["path", "stem"]).join(in_file, ["name", "fam", "imported"]))
    of_type = s.where(has_rec).join(typed, "site")
    type_ids = symbols.where(F.col("kind").isin(*TYPES)).select("symbol_id", F.col("name").alias("type"))
    over = type_ids.join(above, "symbol_id").groupBy("type", F.col("name").alias("owner")).agg(F.min("depth").alias("depth"))
    over = over.unionByName(of_type.select("type", F.col("type").alias("owner"), F.lit(0).alias("depth")).distinct()).groupBy("type", "owner").agg(F.min("depth").alias("depth"))
    add(7, "receiver type", of_type.join(over, "type").join(owners, ["name", "fam", "owner"]))
    b = s.where(bare)
    add(8, "same file", b.join(by(top, "fam", "path"), ["name", "fam", "path"]))
    add(9, "enclosing scope", b.withColumnRenamed("from_symbol_id", "symbol_id").join(around.join(types, "scope", "left_anti").withColumnRenamed("scope", "parent_symbol_id"), "symbol_id").join(members, ["name", "fam", "parent_symbol_id"]))
    add(10, "class chain", b.where(F.col("language").isin(*IMPLICIT)).withColumnRenamed("from_symbol_id", "symbol_id").join(near, "symbol_id").withColumnRenamed("type_id", "parent_symbol_id").join(members, ["name", "fam", "parent_symbol_id"]))
    add(11, "import", b.join(seen, "path").join(in_file, ["name", "fam", "imported"]))
    add(12, "same package", b.where(F.col("language").isin(*PACKAGES)).join(by(top, "language", "folder"), ["name", "language", "folder"]))
    every = reduce(DataFrame.unionByName, found)
    # of one rank and depth several keys may speak (two imports): their definitions add up
    level = every.groupBy("site", "rank", "depth", "basis").agg(F.sum("n").alias("n"), F.min("one").alias("one"))
    best = level.groupBy("site").agg(F.min(F.struct("rank", "depth", "basis", "n", "one")).alias("b"))
    return best.select("site", "b.basis", "b.n", F.when(F.col("b.n") == 1, F.col("b.one")).alias("target"))


def surroundings(symbols: DataFrame, around: DataFrame, variables: DataFrame, local_names: DataFrame) -> DataFrame:
    """(symbol_id, type_id, types, inside, own): one row for each symbol in which calls can stand, with what its place says of
    them: the nearest type around it; types of receivers by name, as receiver_types() finds them; definitions (n, one) inside
    the scopes around it that are no types, by name and family, the nearest scope's; names that a scope around it declares
    (local_names: scope, name). Symbols of which nothing is known have no row."""
    around = around.distinct()
    kinds = symbols.where(F.col("kind").isin(*TYPES)).select(F.col("symbol_id").alias("scope")).distinct()
    near = around.join(kinds, "scope").groupBy("symbol_id").agg(F.min_by("scope", "depth").alias("type_id"))
    one = variables.where("name IS NOT NULL").groupBy("scope", "name").agg(F.countDistinct("type").alias("n"), F.min("type").alias("type"))
    best = around.join(one, "scope").groupBy("symbol_id", "name").agg(F.min(F.struct("depth", "n", "type")).alias("b")).where("b.n = 1")
    types = best.groupBy("symbol_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "b.type"))).alias("types"))
    members = _definitions(symbols).where("parent_symbol_id IS NOT NULL AND fam IS NOT NULL").groupBy(F.col("parent_symbol_id").alias("scope"), "name", "fam").agg(F.count("*").alias("n"), F.min("symbol_id").alias("one"))
    level = around.join(kinds, "scope", "left_anti").join(members, "scope").groupBy("symbol_id", "name", "fam", "depth").agg(F.sum("n").alias("n"), F.min("one").alias("one"))
    nearest = level.groupBy("symbol_id", "name", "fam").agg(F.min(F.struct("depth", "n", "one")).alias("b")).select("symbol_id", F.struct("name", "fam").alias("k"), F.struct("b.n", "b.one").alias("v"))
    inside = nearest.groupBy("symbol_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("inside"))
    own = around.join(local_names.where("name IS NOT NULL").select("scope", "name").distinct(), "scope").groupBy("symbol_id").agg(F.collect_set("name").alias("own"))
    parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [near, types, inside, own])
    return parts.groupBy("symbol_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("type_id", "types", "inside", "own")])


def placed() -> list[Column]:
    """Of sites (name, path, language, receiver, namespace) that are joined with their symbol's surroundings(): type_id; type,
    that of the receiver; inner_n and inner_one, definitions of the name inside the scopes around; own_name, whether one of
    them declares the name; fam and folder; self, whether it is called on the object itself."""
    inner = F.try_element_at("inside", F.struct("name", family(F.col("language")).alias("fam")))
    self_ = F.coalesce(F.col("receiver").isin(*SELF), F.lit(False)) | F.array_contains("namespace", "Self")
    return [F.col("type_id"), F.try_element_at("types", F.col("receiver")).alias("type"), inner["n"].alias("inner_n"), inner["one"].alias("inner_one"), F.coalesce(F.array_contains("own", F.col("name")), F.lit(False)).alias("own_name"),
            family(F.col("language")).alias("fam"), folder(F.col("path")).alias("folder"), self_.alias("self")]


def _look(rows: DataFrame, counted: DataFrame, by: str, /, **keys: Column) -> DataFrame:
    """rows with the columns of the counts that bear these keys, named by_n, by_one and so on; null where there are none."""
    counted = cut(counted, "counted")
    if counted.count() <= LOOKUP_ROWS:  # one number
        counted = F.broadcast(counted)
    t = counted.select(*[F.col(c).alias(f"{by}_{c}") for c in counted.columns])
    return rows.join(t, reduce(lambda a, b: a & b, [k == t[f"{by}_{c}"] for c, k in keys.items()]), "left").drop(*[f"{by}_{c}" for c in keys])


def _apart(rows: DataFrame) -> DataFrame:
    """rows as they are, in the same partitions. Spark makes one method of all joins up to here and none beyond; that of a
    dozen joins is too long for the JVM, which then interprets it."""
    return rows.coalesce(1 << 20)


def weigh(sites: DataFrame, symbols: DataFrame, above: DataFrame, imports: DataFrame) -> DataFrame:
    """sites (site, name, path, language, receiver, namespace and the columns of placed()) with the claims() on each: basis, n
    and target, null without any.

    The same evidence as that of claims(), but each kind is counted by all that it looks at first, so that a site finds
    its counts by one key in each kind and keeps its place: sites are neither shuffled nor grouped where the counts are
    small (LOOKUP_ROWS), and what is counted are only the files, types and namespaces that sites have."""
    d = cut(_definitions(symbols), "definitions")
    asked = cut(sites.select("path", "type_id", "type", "namespace").distinct(), "asked")
    some = lambda c, name: asked.where(F.col(c).isNotNull()).select(F.col(c).alias(name)).distinct()
    by = lambda where, *keys: d.where(where).groupBy("name", *keys).agg(F.count("*").alias("n"), F.min("symbol_id").alias("one"))
    total = lambda rows, *keys: rows.groupBy("name", "fam", *keys).agg(F.sum("n").alias("n"), F.min("one").alias("one"))
    # of several owners in a chain the nearest counts; those of one distance add up
    nearest = lambda rows, key: total(rows, key, "depth").groupBy("name", "fam", key).agg(F.min(F.struct("depth", "n", "one")).alias("b")).select("name", "fam", key, "b.n", "b.one")
    top, inner = "parent_symbol_id IS NULL", "parent_symbol_id IS NOT NULL"
    owners = cut(by(inner, "fam", "owner"), "owners")
    in_front = total(some("namespace", "namespace").withColumn("owner", F.explode(F.array_distinct("namespace"))).join(owners, "owner"), "namespace")
    members = by(inner, "fam", "parent_symbol_id").withColumnRenamed("parent_symbol_id", "type_id").join(some("type_id", "type_id"), "type_id", "left_semi")
    chain = above.where("depth > 0").select(F.col("symbol_id").alias("type_id"), F.col("name").alias("owner"), "depth").join(some("type_id", "type_id"), "type_id", "left_semi")
    seen = _seen(imports).join(some("path", "path"), "path", "left_semi")
    in_file = by(top, "fam", "path")
    imported = cut(seen.join(in_file.withColumnRenamed("path", "imported"), "imported"), "imported")
    own = some("type", "type")
    over = symbols.where(F.col("kind").isin(*TYPES)).select("symbol_id", F.col("name").alias("type")).join(own, "type", "left_semi").join(above, "symbol_id").select("type", F.col("name").alias("owner"), "depth")
    over = over.unionByName(own.select("type", F.col("type").alias("owner"), F.lit(0).alias("depth"))).groupBy("type", "owner").agg(F.min("depth").alias("depth"))
    c, only = F.col, lambda cond, key: F.when(cond, F.col(key))
    has_ns, has_rec = F.size("namespace") > 0, c("receiver").isNotNull()
    through, bare = has_rec & ~c("self"), ~has_ns & ~has_rec
    s = sites.withColumn("b", F.lit(None).cast("struct<basis:string,n:bigint,one:string>"))

    def say(s: DataFrame, basis: str, by: str, cond: Column) -> DataFrame:
        """Where no stronger evidence has spoken. Said after each look, as code of all of them at once is too long for the compiler."""
        here = F.when(cond & c(f"{by}_n").isNotNull(), F.struct(F.lit(basis).alias("basis"), c(f"{by}_n").alias("n"), c(f"{by}_one").alias("one")))
        return s.withColumn("b", F.coalesce("b", here))

    def ask(s: DataFrame, basis: str, by: str, counted: DataFrame, cond: Column, **keys: Column) -> DataFrame:
        return say(_look(s, counted, by, name=only(cond & c("b").isNull(), "name"), **keys), basis, by, cond).drop(f"{by}_n", f"{by}_one")

    fam = {"fam": c("fam")}
    s = ask(s, "qualified path", "q1", in_front, has_ns, **fam, namespace=c("namespace"))
    s = ask(s, "qualified path", "q2", by(top, "fam"), has_ns, **fam)
    s = _look(s, members, "mine", name=c("name"), **fam, type_id=c("type_id"))
    s = say(s, "class chain", "mine", c("self"))
    s = ask(s, "class chain", "up", nearest(chain.join(owners, "owner"), "type_id"), c("self"), **fam, type_id=c("type_id"))
    s = _apart(s)
    s = ask(s, "qualified path", "rec", owners, through, **fam, owner=c("receiver"))
    s = ask(s, "import", "module", total(imported, "path", "stem"), through, **fam, path=c("path"), stem=F.lower("receiver"))
    s = ask(s, "receiver type", "typed", nearest(over.join(owners, "owner"), "type"), has_rec, **fam, type=c("type"))
    s = _apart(s)
    s = ask(s, "same file", "file", in_file.join(some("path", "path"), "path", "left_semi"), bare, **fam, path=c("path"))
    s = say(s, "enclosing scope", "inner", bare)
    s = say(s, "class chain", "mine", bare & c("language").isin(*IMPLICIT))
    s = ask(s, "import", "seen", total(imported, "path"), bare, **fam, path=c("path"))
    s = ask(s, "same package", "pack", by(top, "language", "folder"), bare & c("language").isin(*PACKAGES), language=c("language"), folder=c("folder"))
    return _apart(s).select(*sites.columns, "b.basis", "b.n", F.when(F.col("b.n") == 1, F.col("b.one")).alias("target"))


def _qualified() -> Column:
    return F.col("receiver").isNotNull() | F.coalesce(F.size("namespace") > 0, F.lit(False))


def _seen(imports: DataFrame) -> DataFrame:
    """(path, imported, stem): files that a file imports, with the names by which it may call them."""
    stem = F.lower(F.regexp_extract("imported", r"([^/.]*)[^/]*$", 1))
    return imports.select("path", "imported", stem.alias("stem")).distinct()


def decide_weighed(weighed: DataFrame, symbols: DataFrame) -> DataFrame:
    """decide() on what weigh() gives, in place: its columns with label, basis and target of the verdict."""
    d = cut(_definitions(symbols), "definitions")
    s = _look(weighed, d.groupBy("name").agg(F.count("*").alias("all")), "n", name=F.col("name"))
    s = _look(s, d.groupBy("name", "fam").agg(F.count("*").alias("n"), F.min("symbol_id").alias("one")), "fam", name=F.col("name"), fam=F.col("fam"))
    s = s.withColumnRenamed("fam_n", "n_fam").withColumnRenamed("fam_one", "single").withColumn("qualified", _qualified())
    kept = [c for c in weighed.columns if c not in ("basis", "n", "target")]
    return _apart(s).select(*kept, _verdict().alias("v")).select(*kept, "v.*")


def rivals_decided(decided: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """rivals() of what decide_weighed() gives, in place."""
    d = cut(_definitions(symbols), "definitions")
    top = d.where("parent_symbol_id IS NULL")
    far = top.groupBy("name", "fam", F.col("path").alias("imported"), F.col("folder").alias("other")).agg(F.count("*").alias("n"))
    seen = _seen(imports).withColumn("folder", folder(F.col("path")))
    outside = seen.join(far, "imported").where("folder <> other").groupBy("name", "fam", "path").agg(F.sum("n").alias("n"))
    key = {"name": F.col("name"), "fam": F.col("fam")}
    s = _look(decided, d.where("parent_symbol_id IS NOT NULL").groupBy("name", "fam").agg(F.count("*").alias("n")), "m", **key)
    s = _look(s, top.groupBy("name", "fam", "folder").agg(F.count("*").alias("n")), "f", **key, folder=F.col("folder"))
    s = _look(s, outside, "i", **key, path=F.col("path"))
    return s.select("site", _rivals(F.col("m_n"), F.col("f_n"), F.col("i_n")).alias("rivals"))


def shadow_decided(decided: DataFrame) -> DataFrame:
    """exclude_shadowed() on what decide_weighed() gives, in place."""
    return _without(decided, F.coalesce("own_name", F.lit(False)) & ~_qualified(), "local name")


def _verdict() -> Column:
    """The verdict over a site's counts of definitions (n_all, n_fam, single), its claim (n, basis, target), type and qualified."""
    none = F.lit(None).cast("string")
    say = lambda label, basis, target=none: F.struct(F.lit(label).alias("label"), (F.lit(basis) if isinstance(basis, str) else basis).alias("basis"), target.alias("target"))
    many = lambda c: F.format_string("%d definitions", c)
    return (F.when(F.col("n_all").isNull(), say("external", "no definition")).when(F.col("n_fam").isNull(), say("excluded", "other language"))
         .when(F.col("n") == 1, say("proven", F.col("basis"), F.col("target"))).when(F.col("n") > 1, say("unresolved", many("n")))
         .when(F.col("type").isNotNull(), say("excluded", F.concat(F.lit("receiver is "), F.col("type"))))
         .when(F.col("n_fam") > 1, say("unresolved", many("n_fam"))).when(F.col("qualified"), say("likely", "receiver not typed", F.col("single"))).otherwise(say("likely", "name only", F.col("single"))))


def decide(sites: DataFrame, symbols: DataFrame, claimed: DataFrame, typed: DataFrame) -> DataFrame:
    """(site, label, basis, target): the verdict on each site. No definition of the name: external. None in its language
    family: excluded. One claimed definition: proven; several: unresolved. A receiver of a known type that owns none:
    excluded. Else one definition is likely (its receiver not being typed, or by name only), several are unresolved."""
    d = _definitions(symbols)
    all_ = d.groupBy("name").agg(F.count("*").alias("n_all"))
    fam = d.groupBy("name", "fam").agg(F.count("*").alias("n_fam"), F.min("symbol_id").alias("single"))
    s = sites.select("site", "name", family(F.col("language")).alias("fam"), (F.col("receiver").isNotNull() | (F.size(F.coalesce("namespace", F.array().cast("array<string>"))) > 0)).alias("qualified"))
    j = s.join(all_, "name", "left").join(fam, ["name", "fam"], "left").join(claimed, "site", "left").join(typed, "site", "left")
    return j.select("site", _verdict().alias("v")).select("site", "v.*")


def rivals(sites: DataFrame, symbols: DataFrame, decided: DataFrame, imports: DataFrame) -> DataFrame:
    """(site, rivals): how many definitions other than the verdict's could a site reach: those of its file, its folder and
    the files that it imports, and the members of any type. Counted by these keys, not paired out."""
    d = _definitions(symbols).withColumn("top", F.col("parent_symbol_id").isNull())
    s = sites.select("site", "name", "path", family(F.col("language")).alias("fam"), folder(F.col("path")).alias("folder"))
    members = d.where("NOT top").groupBy("name", "fam").agg(F.count("*").alias("m"))
    near = d.where("top").groupBy("name", "fam", "folder").agg(F.count("*").alias("f"))
    far = d.where("top").select("name", "fam", F.col("path").alias("imported"), "folder").groupBy("name", "fam", "imported", "folder").agg(F.count("*").alias("i"))
    seen = imports.select("path", "imported").distinct()
    imported = s.join(seen, "path").join(far.withColumnRenamed("folder", "other"), ["name", "fam", "imported"]).where("folder <> other").groupBy("site").agg(F.sum("i").alias("i"))
    j = s.join(members, ["name", "fam"], "left").join(near, ["name", "fam", "folder"], "left").join(imported, "site", "left").join(decided.select("site", "target"), "site", "left")
    return j.select("site", _rivals(F.col("m"), F.col("f"), F.col("i")).alias("rivals"))


def _rivals(*counts: Column) -> Column:
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in counts])
    return F.greatest(total - F.when(F.col("target").isNotNull(), 1).otherwise(0), F.lit(0))


def exclude_external_imports(decided: DataFrame, sites: DataFrame, bindings: DataFrame, files: DataFrame) -> DataFrame:
    """decided, with sites excluded whose name or receiver their file binds to an import (path, name, stem) that names no
    file known: what they use stands outside. Proven sites stay."""
    known = files.select(F.lower(F.regexp_extract("path", r"([^/.]*)[^/]*$", 1)).alias("stem")).distinct()
    outside = bindings.join(known, "stem", "left_anti").select("path", F.col("name").alias("bound")).distinct()
    s = sites.select("site", "path", F.explode(F.array_compact(F.array_distinct(F.array("name", "receiver")))).alias("bound")).join(outside, ["path", "bound"]).select("site", F.lit(True).alias("out")).distinct()
    j = decided.join(s, "site", "left")
    hit = F.coalesce(F.col("out"), F.lit(False)) & F.col("label").isin("likely", "unresolved")
    return j.select("site", F.when(hit, "excluded").otherwise(F.col("label")).alias("label"), F.when(hit, "external import").otherwise(F.col("basis")).alias("basis"), F.when(~hit, F.col("target")).alias("target"))


def exclude_by_count(decided: DataFrame, sites: DataFrame, ranges: DataFrame, groups: DataFrame) -> DataFrame:
    """decided, with likely and unresolved sites excluded whose number of arguments (args; null says nothing) no definition
    in question takes: the target's range (symbol_id, least, most) or, for unresolved ones, all of the name's (name, least,
    most). In Go a single argument may stand for several values, so it excludes nothing."""
    s = sites.select("site", "name", "language", "args")
    t = ranges.select(F.col("symbol_id").alias("target"), F.col("least").alias("l1"), F.col("most").alias("m1"), F.lit(True).alias("k1"))
    g = groups.select("name", F.col("least").alias("l2"), F.col("most").alias("m2"), F.lit(True).alias("k2"))
    j = decided.join(s, "site").join(t, "target", "left").join(g, "name", "left")
    out = lambda least, most: (F.col("args") < F.col(least)) | F.coalesce(F.col("args") > F.col(most), F.lit(False))
    counts = F.col("args").isNotNull() & ~((F.col("language") == "go") & (F.col("args") == 1))
    wrong = F.coalesce(counts & F.when(F.col("label") == "likely", F.col("k1") & out("l1", "m1")).when(F.col("label") == "unresolved", F.col("k2") & out("l2", "m2")), F.lit(False))
    return j.select("site", F.when(wrong, "excluded").otherwise(F.col("label")).alias("label"), F.when(wrong, "argument count").otherwise(F.col("basis")).alias("basis"), F.when(~wrong, F.col("target")).alias("target"))


def widen(ranges: DataFrame, overridden: DataFrame) -> DataFrame:
    """(symbol_id, least, most) of callables, widened by what the methods that they override take (symbol_id,
    overridden_id): a call through the base may have any of their numbers of arguments."""
    base = ranges.withColumnRenamed("symbol_id", "overridden_id")
    over = overridden.select("symbol_id", "overridden_id").join(base, "overridden_id").select("symbol_id", "least", "most")
    g = ranges.unionByName(over).groupBy("symbol_id")
    return g.agg(F.min("least").alias("least"), F.when(~F.bool_or(F.col("most").isNull()), F.max("most")).alias("most"))


def member_access(sites: DataFrame) -> DataFrame:
    """(path, name, rows): uses of members through a receiver, grouped by file."""
    return sites.where("receiver IS NOT NULL").groupBy("path", "name").agg(F.count("*").alias("rows"))


def related(a: Column, b: Column, names_above: Column) -> Column:
    """Whether type name b is a or one of the names above a."""
    return (a == b) | F.coalesce(F.array_contains(names_above, b), F.lit(False))


def type_parameters(signature: Column) -> Column:
    """Names that a signature declares as type parameters: a receiver of such a type may be anything."""
    inner = F.regexp_extract(signature, r"^[^(]*?<([^<>]*)>", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_extract(F.trim(x), r"^(?:const\s+|in\s+|out\s+)?([A-Za-z_]\w*)", 1)), lambda x: x != "")


def report(sites: DataFrame, symbols: DataFrame, around: DataFrame, above: DataFrame, typed: DataFrame, imports: DataFrame, ranges: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(site, label, basis, target): the whole judgement of sites: claims, verdicts and, where ranges and groups of them
    are given, the exclusion by arguments. A report for an edit leaves these out, as the edit changes them."""
    judged = decide(sites, symbols, claims(sites, symbols, around, above, typed, imports), typed)
    return judged if ranges is None else exclude_by_count(judged, sites, ranges, groups)


def with_removed(symbols: DataFrame, removed: DataFrame) -> DataFrame:
    """symbols with those that an edit has removed (the same columns) put back, so that their old uses can be judged."""
    return symbols.unionByName(removed.join(symbols.select("symbol_id"), "symbol_id", "left_anti"), allowMissingColumns=True)


def rebound(judged: DataFrame, sites: DataFrame, removed: DataFrame, bindings: DataFrame) -> DataFrame:
    """The verdicts for removed definitions, without those by their old file where that file now imports the name (path,
    name): there the name means what is imported."""
    gone = removed.select(F.col("symbol_id").alias("target"), "name", "path")
    now = gone.join(bindings.select("path", "name").distinct(), ["path", "name"]).select("target", F.col("path").alias("old_path"))
    j = judged.join(sites.select("site", "path"), "site").join(now, "target", "left")
    void = F.coalesce((F.col("basis") == "same file") & (F.col("path") == F.col("old_path")), F.lit(False))
    return j.select("site", F.when(void, "excluded").otherwise(F.col("label")).alias("label"), F.when(void, "imported now").otherwise(F.col("basis")).alias("basis"), F.when(~void, F.col("target")).alias("target"))


def bind_overloads(calls: DataFrame, overloads: DataFrame) -> DataFrame:
    """(site, symbol_id): the one overload that each call can mean. calls: site, scope, name, args, arg_names and arg_types
    (arrays, null where nothing is known of an argument). overloads: symbol_id, scope, name, least, most, names and types of
    the parameters. An overload must take so many arguments, have all their names, and no argument may be of a type that
    is known and another than the parameter's. Calls that several or none fit are left out. Shapes of calls are judged,
    each once for a group of overloads, however many calls have it."""
    shape = ["scope", "name", "args", "arg_names", "arg_types"]
    none = F.array().cast("array<string>")
    c = calls.select("site", "scope", "name", "args", F.coalesce("arg_names", none).alias("arg_names"), F.coalesce("arg_types", none).alias("arg_types"))
    o = overloads.select("scope", "name", "symbol_id", "least", "most", F.coalesce("names", none).alias("names"), F.coalesce("types", none).alias("types"))
    j = c.select(*shape).distinct().join(o, ["scope", "name"])
    count = (F.col("args") >= F.col("least")) & (F.col("most").isNull() | (F.col("args") <= F.col("most")))
    named = F.size(F.array_except(F.array_compact("arg_names"), "names")) == 0
    wrong = F.exists(F.zip_with("arg_types", F.slice("types", F.lit(1), F.size("arg_types")), lambda a, b: a.isNotNull() & b.isNotNull() & (a != b)), lambda x: x)
    fit = j.where(count & named & ~F.coalesce(wrong, F.lit(False))).groupBy(*shape).agg(F.count("*").alias("n"), F.min("symbol_id").alias("symbol_id")).where("n = 1").drop("n")
    return c.join(fit, shape).select("site", "symbol_id")


def exclude_other_overloads(judged: DataFrame, bound: DataFrame, groups: DataFrame) -> DataFrame:
    """judged (site, label, basis, target), with sites excluded that bind (site, symbol_id) another overload of their
    target's group (symbol_id, group)."""
    g = groups.select("symbol_id", "group")
    of = bound.join(g, "symbol_id").select("site", F.col("symbol_id").alias("bound_id"), F.col("group").alias("bound_group"))
    j = judged.join(of, "site", "left").join(g.select(F.col("symbol_id").alias("target"), "group"), "target", "left")
    other = F.coalesce((F.col("bound_group") == F.col("group")) & (F.col("bound_id") != F.col("target")), F.lit(False))
    return j.select("site", F.when(other, "excluded").otherwise(F.col("label")).alias("label"), F.when(other, "binds another overload").otherwise(F.col("basis")).alias("basis"), F.when(~other, F.col("target")).alias("target"))


def exclude_shadowed(judged: DataFrame, sites: DataFrame, around: DataFrame, local_names: DataFrame) -> DataFrame:
    """judged, with bare sites excluded whose name an enclosing scope declares as its own (scope, name: parameters and
    local variables): what they use is that. Sites that something else than a bare name proves stay."""
    bare = sites.where("receiver IS NULL AND (namespace IS NULL OR size(namespace) = 0)").select("site", F.col("from_symbol_id").alias("symbol_id"), "name")
    own = bare.join(around, "symbol_id").join(local_names.select("scope", "name").distinct(), ["scope", "name"]).select("site", F.lit(True).alias("own")).distinct()
    j = judged.join(own, "site", "left")
    return _without(j, F.coalesce("own", F.lit(False)), "local name")


def _without(judged: DataFrame, hit: Column, why: str) -> DataFrame:
    return judged.select("site", F.when(hit, "excluded").otherwise(F.col("label")).alias("label"), F.when(hit, why).otherwise(F.col("basis")).alias("basis"), F.when(~hit, F.col("target")).alias("target"))


def type_identity(uses: DataFrame, types: DataFrame, imports: DataFrame) -> DataFrame:
    """(site, type_id, how): which type (symbol_id, name, path) a type name at a site (site, name, path) means: the one in
    the same file, else in an imported file (path, imported), else in the same folder, else the only one of the name;
    several at the first of these that has any say nothing."""
    t = types.select("symbol_id", "name", "path", folder(F.col("path")).alias("folder"))
    one = lambda *keys: t.groupBy("name", *keys).agg(F.count("*").alias("n"), F.min("symbol_id").alias("id"))
    u = uses.select("site", "name", "path", folder(F.col("path")).alias("folder"))
    add = lambda rank, how, d: d.select("site", F.lit(rank).alias("rank"), F.lit(how).alias("how"), "n", "id")
    seen = imports.select("path", "imported").distinct()
    far = u.join(seen, "path").join(one("path").withColumnRenamed("path", "imported"), ["name", "imported"]).groupBy("site").agg(F.sum("n").alias("n"), F.min("id").alias("id"))
    rows = [add(1, "same file", u.join(one("path"), ["name", "path"])), add(2, "import", far), add(3, "same folder", u.join(one("folder"), ["name", "folder"])), add(4, "only one", u.join(one(), "name"))]
    best = reduce(DataFrame.unionByName, rows).groupBy("site").agg(F.min(F.struct("rank", "n", "id", "how")).alias("b"))
    return best.where("b.n = 1").select("site", F.col("b.id").alias("type_id"), "b.how")
