"""How files reach each other by their own words: script modules, loaded files, names that a line binds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import folder
from tessera.session import cut

# Endings under which a script module may be meant without its ending, in the order in which they are tried.
ENDINGS = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".vue", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def joined_path(base: Column, relative: Column) -> Column:
    """A path relative to a folder, without . and .. segments; null where it leads out of the root."""
    whole = F.when(F.startswith(relative, F.lit("/")), F.substring(relative, 2, 1 << 20)).otherwise(F.concat_ws("/", F.nullif(base, F.lit("")), relative))
    step = lambda a, p: F.when((p == ".") | (p == ""), a).when(p == "..", F.when(F.size(a) > 0, F.slice(a, 1, F.size(a) - 1)).otherwise(F.array(F.lit("\0")))).otherwise(F.array_append(a, p))
    parts = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step)
    return F.when(~F.array_contains(parts, "\0"), F.array_join(parts, "/"))


def script_imports(lines: DataFrame) -> DataFrame:
    """(path, line, name, alias, specifier, exported) of the names that lines of scripts import, or export from elsewhere
    (exported): named ones with their aliases, default ones as default, whole modules as *."""
    pat = r"""^\s*(import|export)\s+(?:type\s+)?(.*?)\s*from\s+['"]([^'"]+)['"]"""
    s = lines.where(F.col("text").rlike(pat)).select("path", "line", F.regexp_extract("text", pat, 1).alias("word"), F.regexp_extract("text", pat, 2).alias("what"), F.regexp_extract("text", pat, 3).alias("specifier"))
    inner = F.regexp_extract("what", r"\{([^}]*)\}", 1)
    named = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")
    named = F.transform(named, lambda x: F.struct(F.regexp_extract(x, r"^(?:type\s+)?([\w$]+)", 1).alias("name"), F.coalesce(F.nullif(F.regexp_extract(x, r"\bas\s+([\w$]+)", 1), F.lit("")), F.regexp_extract(x, r"^(?:type\s+)?([\w$]+)", 1)).alias("alias")))
    star = F.regexp_extract("what", r"^\*(?:\s+as\s+([\w$]+))?", 1)
    head = F.regexp_extract("what", r"^([A-Za-z_$][\w$]*)\s*(?:,|$)", 1)
    one = lambda name, alias: F.struct(F.lit(name).alias("name"), alias.alias("alias"))
    more = F.array_compact(F.array(F.when(F.startswith("what", F.lit("*")), one("*", star)), F.when(head != "", one("default", head))))
    return s.select("path", "line", F.explode(F.concat(named, more)).alias("n"), "specifier", (F.col("word") == "export").alias("exported")).select("path", "line", "n.name", "n.alias", "specifier", "exported")


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, specifier, imported, verdict): the file that a specifier means in its file's folder, by the first ending that
    a file has; verdict is file, missing (relative, but no such file) or package (not relative)."""
    want = imports.select("path", "specifier").distinct()
    relative = F.col("specifier").rlike(r"^\.{1,2}(/|$)")
    whole = joined_path(folder(F.col("path")), F.col("specifier"))
    tried = F.array(*[F.concat(whole, F.lit(e)) for e in ENDINGS], F.regexp_replace(whole, r"\.js$", ".ts"))
    at = want.where(relative).select("path", "specifier", F.posexplode(tried).alias("turn", "imported"))
    hit = at.join(files.select(F.col("path").alias("imported")).distinct(), "imported").groupBy("path", "specifier").agg(F.min_by("imported", "turn").alias("imported"))
    j = want.join(hit, ["path", "specifier"], "left")
    return j.select("path", "specifier", "imported", F.when(F.col("imported").isNotNull(), "file").when(relative, "missing").otherwise("package").alias("verdict"))


def follow_names(imports: DataFrame, resolved: DataFrame, hops: int = 4) -> DataFrame:
    """(path, alias, file, name, hops): where the names that files bind by imports come from: through re-exports of the same
    name, of another one or of whole modules, at most so many steps. Every file on the way is given, circles end."""
    bound = imports.join(resolved.where("imported IS NOT NULL").select("path", "specifier", "imported"), ["path", "specifier"])
    level = bound.where("NOT exported").select("path", "alias", F.col("imported").alias("file"), "name").distinct()
    out = level.withColumn("hops", F.lit(1))
    seen = level
    again = bound.where("exported").select(F.col("path").alias("file"), F.col("alias").alias("out_name"), F.col("name").alias("in_name"), F.col("imported").alias("next"))
    for h in range(2, hops + 1):
        j = level.join(again, "file")
        named = j.where("in_name <> '*' AND out_name = name").select("path", "alias", F.col("next").alias("file"), F.col("in_name").alias("name"))
        whole = j.where("in_name = '*' AND out_name = ''").select("path", "alias", F.col("next").alias("file"), "name")
        level = cut(named.unionByName(whole).distinct().join(seen, ["path", "alias", "file", "name"], "left_anti"), "names")
        if level.isEmpty():
            break
        out = out.unionByName(level.withColumn("hops", F.lit(h)))
        seen = seen.unionByName(level)
    return out


# How languages load other files by path, by the language of the loading file.
_LOADS = {
    "bash": r"^\s*(?:source|\.)\s+[\"']?(?:\$\{?\w+\}?/)?([^\"'\s;]+)", "powershell": r"^\s*\.\s+[\"']?(?:\$PSScriptRoot[\\/])?([^\"'\s;]+)", "r": r"\bsource\(\s*[\"']([^\"']+)[\"']",
    "php": r"\b(?:require|include)(?:_once)?\s*\(?\s*(?:__DIR__\s*\.\s*)?[\"']/?([^\"']+)[\"']", "ruby": r"\brequire_relative\s*\(?\s*[\"']([^\"']+)[\"']", "c": r"^\s*#\s*include\s+\"([^\"]+)\"", "cpp": r"^\s*#\s*include\s+\"([^\"]+)\"",
    "dart": r"^\s*(?:import|export|part)\s+[\"'](?!dart:|package:)([^\"']+)[\"']", "gdscript": r"\b(?:preload|load)\(\s*[\"']res://([^\"']+)[\"']",
}
_FROM_ROOT = ("gdscript",)
_ENDING = {"ruby": ".rb"}


def load_edges(lines: DataFrame, languages: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): files that load others by path (bash, powershell, r, php, ruby, c, cpp, dart, gdscript), as their own
    lines say; languages: (path, language). Of a C include that is not found beside its file, the only file whose path
    ends so is meant."""
    l = lines.join(languages, "path")
    found = [l.where(F.col("language") == lang).select("path", F.regexp_extract("text", pat, 1).alias("to"), F.lit(lang).alias("language")).where("to <> ''") for lang, pat in _LOADS.items()]
    rel = reduce(DataFrame.unionByName, found).distinct().withColumn("to", F.replace("to", F.lit("\\"), F.lit("/")))
    ending = reduce(lambda c, kv: F.when((F.col("language") == kv[0]) & ~F.endswith("to", F.lit(kv[1])), kv[1]).otherwise(c), _ENDING.items(), F.lit(""))
    base = F.when(F.col("language").isin(*_FROM_ROOT), "").otherwise(folder(F.col("path")))
    rel = rel.withColumn("to", F.concat("to", ending)).withColumn("dst", joined_path(base, F.col("to")))
    known = files.select(F.col("path").alias("dst")).distinct()
    near = rel.join(known, "dst").select(F.col("path").alias("src"), "dst", "to")
    headers = rel.where(F.col("language").isin("c", "cpp")).join(near.select(F.col("src").alias("path"), "to"), ["path", "to"], "left_anti").select("path", "to").distinct()
    parts = F.split("dst", "/")
    tails = known.select("dst", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("to"))
    only = headers.join(tails, "to").groupBy("path", "to").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).where("n = 1").select(F.col("path").alias("src"), "dst")
    return near.select("src", "dst").unionByName(only).where("src <> dst").distinct()


def bound_by_line(lines: DataFrame) -> DataFrame:
    """(path, line, name, how) of names that a line of a script binds for what follows in it: parameters of callbacks,
    loop variables, caught errors."""
    pats = {"loop": r"\bfor\s*(?:await\s*)?\(\s*(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s+(?:of|in)\b", "catch": r"\bcatch\s*\(\s*([A-Za-z_$][\w$]*)", "single": r"(?<![\w$.)\]])([A-Za-z_$][\w$]*)\s*=>"}
    rows = [lines.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(p), 1)).alias("name"), F.lit("callback" if k == "single" else k).alias("how")) for k, p in pats.items()]
    lists = lines.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(r"\(([^()]*)\)\s*=>|\bfunction\s*\w*\s*\(([^()]*)\)"), 0)).alias("inner"))
    inner = F.regexp_extract("inner", r"\(([^()]*)\)", 1)
    many = lists.select("path", "line", F.explode(F.split(inner, ",")).alias("p")).select("path", "line", F.regexp_extract(F.trim("p"), r"^(?:\.\.\.)?([A-Za-z_$][\w$]*)", 1).alias("name"), F.lit("callback").alias("how")).where("name <> ''")
    return reduce(DataFrame.unionByName, rows).unionByName(many).distinct()


def unspelled_returns(symbols: DataFrame, type_facts: DataFrame) -> DataFrame:
    """(symbol_id, type): types that an extractor knows a callable to return (symbol_id, resolved_type) and that its
    signature does not spell."""
    t = type_facts.where("resolved_type IS NOT NULL").groupBy("symbol_id").agg(F.min("resolved_type").alias("type"), F.countDistinct("resolved_type").alias("n")).where("n = 1")
    return symbols.select("symbol_id", F.coalesce("signature", F.lit("")).alias("signature")).join(t, "symbol_id").where(~F.contains("signature", F.col("type"))).select("symbol_id", "type")


# Names under which kinds of structural facts are asked for, and how their patterns begin.
FACT_ALIASES = {"sql": "sql.", "route": "route", "config": "config", "signal": "signal", "signals": "signal", "import": "import", "imports": "import", "binding": "binding", "bindings": "binding", "component": "component", "components": "component",
                "module": "module", "modules": "module", "pragma": "pragma", "property": "property", "properties": "property"}


def fact_patterns(facts: DataFrame) -> DataFrame:
    """(pattern_id): the patterns that occur, each once."""
    return facts.select("pattern_id").where("pattern_id IS NOT NULL").distinct()


def list_facts(facts: DataFrame, literals: DataFrame, asked: str, scope: str | None, limit: int) -> tuple[DataFrame, DataFrame]:
    """Structural facts by pattern or alias, and literals of that kind, below a path; each of the two up to the whole limit,
    by path, line and id."""
    from tessera.functions.names import in_path

    head = FACT_ALIASES.get(asked.lower())
    of = F.startswith("pattern_id", F.lit(head)) if head else (F.col("pattern_id") == asked)
    here = (lambda d: d.where(in_path(F.col("path"), scope))) if scope else (lambda d: d)
    f = here(facts.where(of)).orderBy("path", "start_line", "structural_fact_id").limit(limit)
    l = here(literals.where(F.lower("kind") == asked.lower())).orderBy("path", "start_line", "literal_id").limit(limit)
    return f, l


def context(symbol_id: str, symbols: DataFrame, edges: DataFrame, judged: DataFrame, owners: DataFrame, texts: DataFrame, type_facts: DataFrame, limit: int = 10) -> dict[str, DataFrame]:
    """All that is known of one symbol, by part: itself, body, members, overloads, callers (its proven and likely sites),
    callees, tests, and returns. Nothing is run until a part is read."""
    from tessera.operators import lookup, report, scan, testing

    one = symbols.where(F.col("symbol_id") == symbol_id)
    sites = judged.where((F.col("target") == symbol_id) & F.col("label").isin("proven", "likely"))
    calls = edges.where((F.col("from_symbol_id") == symbol_id) & F.col("to_symbol_id").isNotNull())
    callers = edges.where(F.col("to_symbol_id") == symbol_id).select(F.col("to_symbol_id").alias("symbol_id"), F.col("from_symbol_id").alias("caller"))
    names = one.select("name", "file_id", "kind", F.col("parent_symbol_id").alias("up"))
    same = symbols.join(names, ["name", "file_id", "kind"]).where(F.col("parent_symbol_id").eqNullSafe(F.col("up"))).drop("up")
    return {
        "symbol": one, "body": scan.symbol_text(one, texts), "members": lookup.members(symbols.where((F.col("symbol_id") == symbol_id) | (F.col("parent_symbol_id") == symbol_id))), "overloads": same.where(F.col("symbol_id") != symbol_id),
        "callers": sites.orderBy(report.label_rank(F.col("label")), "path", "line").limit(limit), "callees": report.callees_top(report.callees(calls), limit), "tests": testing.related_tests(callers, owners, symbols, limit),
        "returns": unspelled_returns(one, type_facts),
    }
