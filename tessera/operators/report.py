"""Evidence for uses of names: verdicts, merged sites, counts, callees, arity, conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import CALLABLE, TYPES, family
from tessera.functions.paths import folder
from tessera.operators.intervals import holding

#: Labels in report order.
LABELS = ("proven", "likely", "unresolved", "excluded", "external")


def label_rank(label: Column) -> Column:
    out = F.lit(len(LABELS))
    for i, x in enumerate(LABELS):
        out = F.when(label == x, i).otherwise(out)
    return out


def parameters(signature: Column) -> Column:
    """The parameters of a signature as texts, without receivers; empty where it has no brackets."""
    inner = F.regexp_extract(F.coalesce(signature, F.lit("")), r"[A-Za-z0-9_>]\s*\(([^()]*)\)", 1)
    parts = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(parts, lambda x: ~x.rlike(r"^(&?(mut )?self|&?'\w+ self|self|cls|this)$"))


def arity(symbols: DataFrame) -> DataFrame:
    """(symbol_id, least, most) arguments that each callable with a bracketed signature takes; most is null where a
    parameter takes any number. A parameter with a default, a `?` or a star need not be given."""
    p = parameters(F.col("signature"))
    optional = lambda x: x.rlike(r"=|\?:|\?$|^\*|^\.\.\.|\.\.\.")
    many = F.exists(p, lambda x: x.rlike(r"^\*|^\.\.\.|\.\.\."))
    s = symbols.where(F.col("kind").isin(*CALLABLE) & F.contains("signature", F.lit("(")))
    return s.select("symbol_id", F.size(F.filter(p, lambda x: ~optional(x))).alias("least"), F.when(~many, F.size(p)).alias("most"))


def arity_of_groups(ranges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, file_id, kind, parent_symbol_id, least, most, members): the union of the ranges of each overload group."""
    j = ranges.join(symbols.select("symbol_id", "name", "file_id", "kind", "parent_symbol_id"), "symbol_id")
    return j.groupBy("name", "file_id", "kind", "parent_symbol_id").agg(
        F.min("least").alias("least"), F.when(~F.bool_or(F.col("most").isNull()), F.max("most")).alias("most"), F.count("*").alias("members"))


def call_arguments(lines: DataFrame) -> DataFrame:
    """(file_id, line, name, args): calls without inner brackets, with their number of arguments."""
    pat = F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\(([^()]*)\)")
    z = F.arrays_zip(F.regexp_extract_all("text", pat, 1).alias("name"), F.regexp_extract_all("text", pat, 2).alias("inner"))
    c = lines.select("file_id", "line", F.explode(z).alias("c")).select("file_id", "line", "c.name", F.trim("c.inner").alias("inner"))
    return c.select("file_id", "line", "name", F.when(F.col("inner") == "", 0).otherwise(F.size(F.split("inner", ","))).alias("args"))


def verdicts(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """One label and basis for each site (file_id, path, line, name, language of its file): the first that holds of
    external (no definition of the name), excluded (definitions in other language families only), proven (one definition
    in the same file; else one in the same folder), likely (one definition in the family: name only), unresolved (several).
    target is the one definition that the verdict ties the site to, else null; fam is the site's language family.

    Each name's definitions are counted once, by file, folder and family, so a name with many definitions and many sites
    is never paired out.
    """
    defs = symbols.where(F.col("kind").isin(*CALLABLE) & F.col("name").isNotNull()).select("symbol_id", "name", "file_id", folder(F.col("path")).alias("folder"), family(F.col("language")).alias("fam"))
    one = lambda *keys: defs.groupBy("name", *keys).agg(F.count("*").alias("n_" + (keys[-1] if keys else "all")), F.min("symbol_id").alias("id_" + (keys[-1] if keys else "all")))
    s = sites.withColumn("folder", folder(F.col("path"))).withColumn("fam", family(F.col("language")))
    j = s.join(one(), "name", "left").join(one("fam"), ["name", "fam"], "left").join(one("fam", "folder"), ["name", "fam", "folder"], "left").join(one("fam", "file_id"), ["name", "fam", "file_id"], "left")
    say = lambda label, basis, target=None: F.struct(F.lit(label).alias("label"), (F.lit(basis) if isinstance(basis, str) else basis).alias("basis"), (F.lit(None).cast("string") if target is None else F.col(target)).alias("target"))
    out = (F.when(F.col("n_all").isNull(), say("external", "no definition")).when(F.col("n_fam").isNull(), say("excluded", "other language"))
           .when(F.col("n_file_id") == 1, say("proven", "same file", "id_file_id")).when(F.col("n_folder") == 1, say("proven", "same package", "id_folder"))
           .when(F.col("n_fam") == 1, say("likely", "name only", "id_fam")).otherwise(say("unresolved", F.format_string("%d definitions", "n_fam"))))
    return j.select("file_id", "path", "line", "name", "fam", out.alias("v")).select("file_id", "path", "line", "name", "fam", "v.label", "v.basis", "v.target")


def exclude_by_arguments(judged: DataFrame, calls: DataFrame, ranges: DataFrame) -> DataFrame:
    """The verdicts, with likely sites excluded whose every call in the line has a number of arguments that the target
    does not take."""
    r = ranges.withColumnRenamed("symbol_id", "target")
    j = judged.where("label = 'likely'").join(calls, ["file_id", "line", "name"]).join(r, "target")
    fits = (F.col("args") >= F.col("least")) & (F.col("most").isNull() | (F.col("args") <= F.col("most")))
    bad = j.groupBy("file_id", "line", "name").agg(F.bool_or(fits).alias("fits")).where("NOT fits").select("file_id", "line", "name", F.lit(True).alias("bad"))
    k = judged.join(bad, ["file_id", "line", "name"], "left")
    wrong = F.coalesce(F.col("bad") & (F.col("label") == "likely"), F.lit(False))
    return k.select("file_id", "path", "line", "name", F.when(wrong, "excluded").otherwise(F.col("label")).alias("label"), F.when(wrong, "argument count").otherwise(F.col("basis")).alias("basis"), "target")


def merge_sites(rows: DataFrame) -> DataFrame:
    """One site for each (path, line) with its greatest end_line: the row that comes first by label, then one that binds
    another overload, one that is claimed, one that is a call, by column and by name; and how many rows the line has.
    rows: path, line, name, label, basis, other_overload, claimed, call, column, end_line."""
    last = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    best = F.struct(label_rank(F.col("label")).alias("r"), last("other_overload").alias("o"), last("claimed").alias("c"), last("call").alias("k"), F.col("column").alias("column"),
                    F.col("name").alias("name"), F.col("label").alias("label"), F.col("basis").alias("basis"))
    return rows.groupBy("path", "line").agg(F.min(best).alias("b"), F.count("*").alias("names"), F.max("end_line").alias("end_line")).select("path", "line", "b.name", "b.label", "b.basis", "b.column", "names", "end_line")


def label_counts(judged: DataFrame, symbols: DataFrame) -> DataFrame:
    """(target, proven, likely, unresolved, excluded): the sites that are tied to each callable, and those of its name in
    its language family that are tied to none of several. Unresolved sites are counted by name first, so a name with many
    definitions and many sites is not paired out. Callables without any site have no row."""
    tied = judged.where("target IS NOT NULL").groupBy("target").agg(*[F.count_if(F.col("label") == x).alias(x) for x in ("proven", "likely", "excluded")])
    open_ = judged.where("label = 'unresolved'").groupBy("name", "fam").agg(F.count("*").alias("unresolved"))
    s = symbols.where(F.col("kind").isin(*CALLABLE) & F.col("name").isNotNull()).select(F.col("symbol_id").alias("target"), "name", family(F.col("language")).alias("fam"))
    j = s.join(open_, ["name", "fam"]).select("target", "unresolved").join(tied, "target", "full")
    return j.select("target", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("proven", "likely", "unresolved", "excluded")])


#: Ways in which a line uses a field, in report order.
ACCESSES = ("write", "read_write", "read")


def access_counts(sites: DataFrame) -> DataFrame:
    """One row: writes, read_writes, reads and unclassified of sites (access)."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    a = F.col("access")
    return sites.agg(n(a == "write").alias("writes"), n(a == "read_write").alias("read_writes"), n(a == "read").alias("reads"), F.count_if(a.isNull()).alias("unclassified"))


def line_access(rows: DataFrame) -> DataFrame:
    """(path, line, access): how each line uses a field, from its rows (path, line, label, access). Excluded rows say
    nothing, unless the whole line is excluded."""
    kept = F.coalesce(F.col("label") != "excluded", F.lit(True))
    of = lambda c: merge_access(F.collect_set(F.when(c, F.col("access"))))
    g = rows.groupBy("path", "line").agg(F.bool_or(kept).alias("some"), of(kept).alias("a"), of(F.lit(True)).alias("b"))
    return g.select("path", "line", F.when(F.col("some"), F.col("a")).otherwise(F.col("b")).alias("access"))


def access_rank(access: Column) -> Column:
    """The place of an access inside a label: writes first, unknown last."""
    out = F.lit(len(ACCESSES))
    for i, x in enumerate(ACCESSES):
        out = F.when(access == x, i).otherwise(out)
    return out


def report_order(sites: DataFrame, key: str = "target") -> DataFrame:
    """sites with place: their number in their report, by label, access (where known), path, line and column; and first:
    the place of the first site of their file in it."""
    known = access_rank(F.col("access")) if "access" in sites.columns else F.lit(0)
    w = Window.partitionBy(key).orderBy(label_rank(F.col("label")), known, "path", "line", "column", "name")
    placed = sites.withColumn("place", F.row_number().over(w))
    return placed.withColumn("first", F.min("place").over(Window.partitionBy(key, "path")))


def first_per_label(judged: DataFrame, k: int = 8) -> DataFrame:
    """The first k sites of each target and label in the order of path and line."""
    w = Window.partitionBy("target", "label").orderBy("path", "line", "name")
    return judged.where("target IS NOT NULL").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("target", "label", "path", "line", "place")


def merge_access(accesses: Column) -> Column:
    """How a line uses a field, from the uses in it: none known gives null, one kind itself, several read_write."""
    known = F.array_distinct(F.array_compact(accesses))
    return F.when(F.size(known) == 1, F.element_at(known, 1)).when(F.size(known) > 1, "read_write")


def text_accounting(words: DataFrame, sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each name, its lines by the first that holds: site, definition, text only. words: (path, line, name) of all
    lines that hold the name as a word."""
    d = symbols.select("path", F.col("start_line").alias("line"), "name", F.lit(True).alias("d")).distinct()
    s = sites.select("path", "line", "name", F.lit(True).alias("s")).distinct()
    j = words.join(s, ["path", "line", "name"], "left").join(d, ["path", "line", "name"], "left")
    what = F.when(F.col("s"), "site").when(F.col("d"), "definition").otherwise("text")
    return j.groupBy("name").agg(*[F.count_if(what == x).alias(x) for x in ("site", "definition", "text")])


def callees(edges: DataFrame) -> DataFrame:
    """(from_symbol_id, to_symbol_id, first_line): the known callables that each callable calls, each once."""
    return edges.where("to_symbol_id IS NOT NULL").groupBy("from_symbol_id", "to_symbol_id").agg(F.min("line").alias("first_line"))


def callees_top(found: DataFrame, k: int = 10) -> DataFrame:
    """The first k callees of each callable; distinct before the cut."""
    w = Window.partitionBy("from_symbol_id").orderBy("first_line", "to_symbol_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def calling_tests(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, test_id): tests that call a symbol directly, never itself."""
    t = symbols.where(F.coalesce("is_test", F.lit(False))).select(F.col("symbol_id").alias("test_id"))
    return edges.where("to_symbol_id IS NOT NULL AND to_symbol_id <> from_symbol_id").select(F.col("to_symbol_id").alias("symbol_id"), F.col("from_symbol_id").alias("test_id")).distinct().join(t, "test_id")


def constructions(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, path, line): lines that build a type whose name only one type has, one row a line."""
    t = symbols.where(F.col("kind").isin(*TYPES) & F.col("name").isNotNull()).groupBy("name").agg(F.min("symbol_id").alias("symbol_id"), F.count("*").alias("n")).where("n = 1")
    return sites.join(t, "name").select("symbol_id", "path", "line").distinct()


def nearest_owner(wanted: DataFrame, owners: DataFrame) -> DataFrame:
    """(id, owner_id): for each wanted (id, name, folder) the owner (owner_id, name, folder) of that name that shares the
    most leading folders; two equally near ones are refused. Owners are compared by folder prefix, so a name with many
    owners is joined by (name, prefix), not paired out."""
    up = lambda c: F.transform(F.sequence(F.lit(0), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), 1, i), "/"))
    o = owners.select("owner_id", "name", F.explode(F.array_distinct(up(F.col("folder")))).alias("prefix"))
    o = o.groupBy("name", "prefix").agg(F.countDistinct("owner_id").alias("n"), F.min("owner_id").alias("owner_id"))
    w = wanted.select("id", "name", F.posexplode(up(F.col("folder"))).alias("depth", "prefix"))
    best = w.join(o, ["name", "prefix"]).groupBy("id").agg(F.max_by(F.struct("n", "owner_id"), "depth").alias("b"))
    return best.where("b.n = 1").select("id", "b.owner_id")


def nearest_preceding(sites: DataFrame, declarations: DataFrame) -> DataFrame:
    """(site, declaration): for each site (site, scope, name, line) the declaration (declaration, scope, name, line) of the
    scope that stands last at or before it, else the first after it. Sites and declarations are sorted together, so none
    meets all others of its name."""
    # both in one order of lines: the last declaration carried forward, else the first one carried back
    d = declarations.groupBy("scope", "name", "line").agg(F.min("declaration").alias("declaration")).select("scope", "name", "line", F.lit(0).alias("is_site"), F.lit(None).cast("string").alias("site"), "declaration")
    rows = sites.select("scope", "name", "line", F.lit(1).alias("is_site"), F.col("site").cast("string"), F.lit(None).cast("string").alias("declaration")).unionByName(d)
    w = Window.partitionBy("scope", "name").orderBy("line", "is_site", "site")
    before = F.last("declaration", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("declaration", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("b", before).withColumn("a", after).where("is_site = 1").select("site", F.coalesce("b", "a").alias("declaration")).where("declaration IS NOT NULL")


def line_unique(rows: DataFrame) -> DataFrame:
    """(path, line, symbol_id) where exactly one symbol begins in the line."""
    return rows.groupBy("path", "start_line").agg(F.count("*").alias("n"), F.min("symbol_id").alias("symbol_id")).where("n = 1").select("path", F.col("start_line").alias("line"), "symbol_id")


def pair_greedily(edges: DataFrame, uses: DataFrame) -> DataFrame:
    """(edge, use): pairs calls (edge, caller, name, line, caller_end) with identifiers (use, caller, name, line) of the same
    caller and name. Calls take their turn in source order; each takes the first identifier that is not taken yet and
    stands between the call's line and the end of the caller (null: no end). Calls without one are left out.

    As lines only grow, an identifier that is passed over is never taken later: call k (from 0) takes number
    max over j <= k of (p_j - j), plus k, where p_j identifiers stand before call j. So two windows do what a loop would.
    Calls behind the end of their caller can only take identifiers of their own line, so each such line is on its own.
    """
    e = edges.select("caller", "name", "line", F.lit(0).alias("is_use"), F.col("edge").alias("id"), "caller_end")
    u = uses.select("caller", "name", "line", F.lit(1).alias("is_use"), F.col("use").alias("id"), F.lit(None).cast("int").alias("caller_end"))
    end = F.max("caller_end").over(Window.partitionBy("caller", "name"))
    rows = e.unionByName(u).withColumn("part", F.when(F.col("line") > end, F.col("line")).otherwise(-1)).drop("caller_end")
    keys = ["caller", "name", "part"]
    group = Window.partitionBy(*keys)
    sorted_ = group.orderBy("line", "is_use", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("uses", F.sum("is_use").over(sorted_)).withColumn("calls", F.sum(1 - F.col("is_use")).over(sorted_))
    k = F.col("calls") - 1
    calls = rows.where("is_use = 0").withColumn("slot", F.max(F.col("uses") - k).over(group.orderBy("calls").rowsBetween(Window.unboundedPreceding, 0)) + k)
    taken = rows.where("is_use = 1").select(*keys, (F.col("uses") - 1).alias("slot"), F.col("id").alias("use"))
    return calls.join(taken, [*keys, "slot"]).select(F.col("id").alias("edge"), "use")


def conventions(symbols: DataFrame, marks: Column) -> DataFrame:
    """(parent_symbol_id, kind, mark, carriers, siblings): marks that at least two thirds of at least two siblings of one
    parent and kind carry."""
    s = symbols.where("parent_symbol_id IS NOT NULL").select("symbol_id", "parent_symbol_id", "kind", F.array_distinct(marks).alias("marks"))
    n = s.groupBy("parent_symbol_id", "kind").agg(F.count("*").alias("siblings")).where("siblings >= 2")
    c = s.select("parent_symbol_id", "kind", F.explode("marks").alias("mark")).groupBy("parent_symbol_id", "kind", "mark").agg(F.count("*").alias("carriers"))
    return c.join(n, ["parent_symbol_id", "kind"]).where("3 * carriers >= 2 * siblings")


def test_command(language: Column, path: Column, name: Column) -> Column:
    """The command that runs one test, null for languages without a known runner."""
    stem = F.regexp_extract(path, r"([^/]*)\.[^.]*$", 1)
    return (F.when(language == "python", F.concat(F.lit("pytest "), path, F.lit("::"), name)).when(language == "rust", F.concat(F.lit("cargo test "), name))
            .when(language == "go", F.concat(F.lit("go test ./"), folder(path), F.lit(" -run '^"), name, F.lit("$'"))).when(language.isin("javascript", "typescript"), F.concat(F.lit("npx jest "), path, F.lit(" -t '"), name, F.lit("'")))
            .when(language == "java", F.concat(F.lit("mvn test -Dtest="), stem, F.lit("#"), name)).when(language == "csharp", F.concat(F.lit("dotnet test --filter "), name)))


def shorten(rows: DataFrame, key: str, order: list, text: str, budget: int) -> DataFrame:
    """(key, shown, more): the texts of each key in order, joined while they fit the budget of characters, and how many
    are left."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    upto = rows.withColumn("upto", F.sum(F.length(text)).over(w)).withColumn("rn", F.count("*").over(w))
    fits = F.col("upto") <= budget
    return upto.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(fits, F.struct("rn", text)))), lambda x: x[text]), ", ").alias("shown"), F.count_if(~fits).alias("more"))


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page of rows in order, each with the number of all rows."""
    if not 0 <= limit <= 200 or offset < 0:
        raise ValueError("limit must lie in 0..200 and offset must not be negative")
    total = rows.count()  # one number
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("total", F.lit(total).cast("bigint"))


def interleave(rows: DataFrame, group: str, order: list) -> DataFrame:
    """rows with turn: the first of each group, then the second of each, and so on."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("turn", k)


def merge_streams(events: DataFrame) -> DataFrame:
    """(path, seq, time, place_time): a total order of per-path event queues by time that keeps each path's own order: an
    event counts at the latest time of its path so far."""
    w = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("place_time", F.max("time").over(w))


def place_sites(judged: DataFrame, hunks: DataFrame) -> DataFrame:
    """The sites with place: in_diff where a hunk (path, start_line, end_line) of the file holds the line, else the label."""
    inside = holding(judged.select("path", "line").distinct(), hunks.select("path", "start_line", "end_line"), "path").select("path", "line", F.lit(True).alias("inside")).distinct()
    return judged.join(inside, ["path", "line"], "left").withColumn("place", F.when(F.col("inside"), "in_diff").otherwise(F.col("label"))).drop("inside")


def blocking(placed: DataFrame, most: int = 15) -> DataFrame:
    """What may stop an edit: proven sites outside the diff, the first `most` of each target; nothing else ever does."""
    w = Window.partitionBy("target").orderBy("path", "line", "name")
    return placed.where("place = 'proven' AND target IS NOT NULL").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).select("target", "path", "line", "rn")


def unique_bodies(symbols: DataFrame, texts: DataFrame, most: int = 8000) -> DataFrame:
    """(name, symbol_id, text) of callables that are the only ones of their name, where the text has at most `most`
    characters. texts: (symbol_id, text)."""
    one = symbols.where(F.col("kind").isin(*CALLABLE) & F.col("name").isNotNull()).groupBy("name").agg(F.count("*").alias("n"), F.min("symbol_id").alias("symbol_id")).where("n = 1")
    return one.join(texts, "symbol_id").where(F.length("text") <= most).select("name", "symbol_id", "text")


def snippets(texts: DataFrame, word: str, around: int = 20) -> DataFrame:
    """(symbol_id, snippet): the first place of a word in each text with some characters around it. Case does not matter."""
    at = F.instr(F.lower("text"), word.lower())
    start = F.greatest(F.lit(1), at - around)
    return texts.where(at > 0).select("symbol_id", F.substring("text", start, at - start + len(word) + around).alias("snippet"))


def receivers(lines: DataFrame) -> DataFrame:
    """(path, line, receiver, name, uses): what stands before the dot of a call."""
    pat = F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\.([A-Za-z_][A-Za-z0-9_]*)\(")
    z = F.arrays_zip(F.regexp_extract_all("text", pat, 1).alias("receiver"), F.regexp_extract_all("text", pat, 2).alias("name"))
    return lines.select("path", "line", F.explode(z).alias("c")).groupBy("path", "line", "c.receiver", "c.name").agg(F.count("*").alias("uses"))


def continued_chains(lines: DataFrame) -> DataFrame:
    """(path, line): lines that go on with a chain of calls (they begin with a dot) and whose line before is not blank."""
    w = Window.partitionBy("path").orderBy("line")
    return lines.withColumn("before", F.lag("text").over(w)).where(F.ltrim("text").startswith(".") & (F.trim("before") != "")).select("path", "line")


def is_lambda_name(name: Column) -> Column:
    """Names that an extractor gives to lambdas."""
    return F.coalesce(name.rlike(r"^lambda_\d+$"), F.lit(False))


def variants_used(sites: DataFrame, variants: DataFrame) -> DataFrame:
    """(owner, containing_symbol_id, variants, first_line): how many different variants (owner, name) each caller uses.
    Names that several owners have say nothing about any of them and are left out, so a name is joined with one owner."""
    one = variants.groupBy("name").agg(F.countDistinct("owner").alias("owners"), F.min("owner").alias("owner")).where("owners = 1").drop("owners")
    j = sites.where("containing_symbol_id IS NOT NULL").join(one, "name")
    return j.groupBy("owner", "containing_symbol_id").agg(F.countDistinct("name").alias("variants"), F.min("line").alias("first_line"))


def name_rows(symbols: DataFrame, sites: DataFrame) -> DataFrame:
    """(name, path, line, source): definitions and uses of names in one table, tagged by where they come from."""
    d = symbols.where("name IS NOT NULL AND path IS NOT NULL").select("name", "path", F.col("start_line").alias("line"), F.lit("definition").alias("source"))
    return d.unionByName(sites.select("name", "path", "line", F.lit("use").alias("source")))


def most_used(names: DataFrame, uses: DataFrame, n: int = 30) -> DataFrame:
    """The n most used of some symbols (symbol_id, name, path), unused ones last; ties by path and id."""
    return names.join(uses, "name", "left").select("symbol_id", "name", "path", F.coalesce("uses", F.lit(0)).alias("uses")).orderBy(F.col("uses").desc(), F.col("path").asc_nulls_first(), "symbol_id").limit(n)


def uncovered(languages: DataFrame, gaps: dict[str, str]) -> DataFrame:
    """(language, gap): which of the languages in use (language) have a known gap in what is extracted."""
    known = languages.sparkSession.createDataFrame(sorted(gaps.items()), "language string, gap string")
    return known.join(languages.select("language").distinct(), "language", "left_semi")


def fact_counts(facts: DataFrame, families: dict[str, str]) -> DataFrame:
    """(family, patterns, facts): structural facts (pattern_id) by the family that a pattern's first part names; patterns
    of no known family stand for themselves."""
    head = F.split("pattern_id", "[./]")[0]
    name = head
    for part, family_ in families.items():
        name = F.when(head == part, family_).otherwise(name)
    return facts.groupBy(name.alias("family")).agg(F.countDistinct("pattern_id").alias("patterns"), F.count("*").alias("facts"))


def caller_rows(judged: DataFrame, sites: DataFrame) -> DataFrame:
    """(target, caller, sites, first_line, surest): the callers of each target at depth 1, by the label of their best site.
    sites adds containing_symbol_id."""
    s = sites.select("file_id", "line", "name", F.col("containing_symbol_id").alias("caller")).where("caller IS NOT NULL")
    j = judged.where("target IS NOT NULL").join(s, ["file_id", "line", "name"])
    best = F.min(F.struct(label_rank(F.col("label")).alias("r"), F.col("label").alias("label")))
    return j.groupBy("target", "caller").agg(F.count("*").alias("sites"), F.min("line").alias("first_line"), best.alias("b")).select("target", "caller", "sites", "first_line", F.col("b.label").alias("surest"))


def bind_overloads(calls: DataFrame, ranges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, line, name, args, symbol_id): calls (file_id, line, name, args) of names that their file defines more than
    once, bound to the one overload that takes so many arguments; calls that fit none or several are left out. Overloads
    of a name in a file are first reduced to one row for each number of arguments."""
    s = symbols.where(F.col("kind").isin(*CALLABLE)).select("symbol_id", "file_id", "name")
    several = s.groupBy("file_id", "name").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    need = calls.select("file_id", "name", "args").distinct().join(several, ["file_id", "name"])
    r = ranges.join(s, "symbol_id")
    fit = need.join(r, ["file_id", "name"]).where((F.col("args") >= F.col("least")) & (F.col("most").isNull() | (F.col("args") <= F.col("most"))))
    one = fit.groupBy("file_id", "name", "args").agg(F.count("*").alias("n"), F.min("symbol_id").alias("symbol_id")).where("n = 1").drop("n")
    return calls.select("file_id", "line", "name", "args").distinct().join(one, ["file_id", "name", "args"]).select("file_id", "line", "name", "args", "symbol_id")
