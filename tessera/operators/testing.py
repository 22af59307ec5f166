"""Tests: which test a piece of code belongs to, which tests a symbol has, and how they are run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import CALLABLE, is_test_name, is_test_path
from tessera.functions.paths import folder

#: Enclosing callables up to which a helper belongs to its test.
CLIMB = 4


def reads_as_test(symbols: DataFrame) -> Column:
    """Whether a callable is marked as a test, or is one by the names of its path and its own."""
    marked = F.coalesce(F.col("is_test"), F.lit(False))
    return F.col("kind").isin(*CALLABLE) & (marked | (is_test_path(F.col("path")) & is_test_name(F.col("name"))))


def test_of(symbols: DataFrame) -> DataFrame:
    """(symbol_id, test_id): the test that each callable belongs to: itself, or the nearest of up to CLIMB enclosing
    callables that reads as a test. What lies in a set-up or tear-down member belongs to none."""
    s = symbols.where(F.col("kind").isin(*CALLABLE)).select("symbol_id", "parent_symbol_id", reads_as_test(symbols).alias("test"), F.coalesce("test_lifecycle", F.lit(False)).alias("life"))
    up = s.select(F.col("symbol_id").alias("at"), F.col("parent_symbol_id").alias("next"), F.col("test").alias("hit"), F.col("life").alias("stop"))
    level, out = s.select("symbol_id", F.col("symbol_id").alias("at")), None
    for _ in range(CLIMB + 1):
        j = level.join(up, "at").where("NOT stop")
        found = j.where("hit").select("symbol_id", F.col("at").alias("test_id"))
        out = found if out is None else out.unionByName(found)
        level = j.where("NOT hit AND next IS NOT NULL").select("symbol_id", F.col("next").alias("at"))
    return out


def test_cases(above: DataFrame) -> DataFrame:
    """symbol_id of the classes that derive from a test case by any of the names above them (symbol_id, name, depth)."""
    return above.where((F.col("depth") > 0) & F.endswith("name", F.lit("TestCase"))).select("symbol_id").distinct()


def related_tests(callers: DataFrame, owners: DataFrame, symbols: DataFrame, limit: int = 5) -> DataFrame:
    """(symbol_id, test_id, flagged, place): the tests of each symbol (callers: symbol_id, caller; owners: test_of()), those
    that are marked as tests before those by name, by path and line; never itself, at most `limit`."""
    t = symbols.select(F.col("symbol_id").alias("test_id"), F.coalesce("is_test", F.lit(False)).alias("flagged"), "path", "start_line")
    j = callers.join(owners.select(F.col("symbol_id").alias("caller"), "test_id"), "caller").where("symbol_id <> test_id").select("symbol_id", "test_id").distinct().join(t, "test_id")
    w = Window.partitionBy("symbol_id").orderBy(F.col("flagged").desc(), F.col("path").asc_nulls_last(), F.col("start_line").asc_nulls_last(), "test_id")
    return j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("symbol_id", "test_id", "flagged", "place")


def starting_at(places: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line, test_id): for places (path, line) the first callable that reads as a test and begins there."""
    s = symbols.where(reads_as_test(symbols)).select("path", F.col("start_line").alias("line"), F.col("symbol_id").alias("test_id"), F.coalesce("start_byte", F.lit(0)).alias("b"))
    return places.select("path", "line").distinct().join(s, ["path", "line"]).groupBy("path", "line").agg(F.min(F.struct("b", "test_id")).alias("m")).select("path", "line", "m.test_id")


def nearest_marker(paths: DataFrame, markers: DataFrame) -> DataFrame:
    """(path, folder, names): for each path the nearest folder at or above it that holds one of the marker files (path), and
    the sorted names of all markers there."""
    m = markers.select(folder(F.col("path")).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name")).groupBy("folder").agg(F.array_sort(F.collect_set("name")).alias("names"))
    parts = F.split(folder(F.col("path")), "/")
    up = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    at = paths.select("path").distinct().select("path", F.posexplode(up).alias("depth", "folder"))
    return at.join(m, "folder").groupBy("path").agg(F.max(F.struct("depth", "folder", "names")).alias("m")).select("path", "m.folder", "m.names")


def quoted(text: Column) -> Column:
    """A word of a command: in single quotes where it has characters that a shell reads."""
    return F.when(text.rlike(r"^[A-Za-z0-9_./:=@%+,-]+$"), text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def run_command(language: Column, path: Column, name: Column, owner: Column, line: Column, markers: Column) -> Column:
    """The command that runs one test by the usual runner of its language, null where none is known. owner: the class it
    stands in, if any; markers: names of the project files near it, by which JVM and script projects choose a runner."""
    has = lambda *names: F.coalesce(F.arrays_overlap(markers, F.array(*map(F.lit, names))), F.lit(False))
    q = quoted
    at = F.when(folder(path) == "", "./").otherwise(_text("./", folder(path)))
    member = F.when(owner.isNotNull(), _text(owner, "#", name)).otherwise(name)
    dotted = F.when(owner.isNotNull(), _text(owner, ".", name)).otherwise(name)
    stem = F.regexp_extract(path, r"([^/]*)\.[^.]*$", 1)
    jvm = (F.when(has("pom.xml"), _text("mvn test -Dtest=", q(member))).when(has("build.gradle", "build.gradle.kts"), _text("gradle test --tests ", q(dotted)))
           .when(has("build.sbt"), _text("sbt ", q(_text("testOnly *", F.coalesce(owner, stem)))))
           .when(language != "scala", _text("mvn test -Dtest=", q(member))))
    script = (F.when(has("vitest.config.ts", "vitest.config.js"), _text("npx vitest run ", q(path), " -t ", q(name))).when(has(".mocharc.json", ".mocharc.js"), _text("npx mocha ", q(path), " -g ", q(name)))
              .otherwise(_text("npx jest ", q(path), " -t ", q(name))))
    arms = [
        (["python"], _text("pytest ", q(F.when(owner.isNotNull(), _text(path, "::", owner, "::", name)).otherwise(_text(path, "::", name))))), (["rust"], _text("cargo test ", q(name))),
        (["go"], _text("go test ", q(at), " -run ", q(_text("^", name, "$")))), (["javascript", "typescript", "tsx", "jsx"], script), (["java", "kotlin", "scala"], jvm),
        (["csharp", "fsharp", "vbnet"], _text("dotnet test --filter ", q(_text("FullyQualifiedName~", dotted)))),
        (["ruby"], F.when(F.endswith(path, F.lit("_spec.rb")), _text("bundle exec rspec ", q(_text(path, ":", line.cast("string"))))).otherwise(_text("ruby -Itest ", q(path), " -n ", q(name)))),
        (["swift"], _text("swift test --filter ", q(F.when(owner.isNotNull(), _text(owner, "/", name)).otherwise(name)))), (["dart"], _text("dart test ", q(path), " --plain-name ", q(name))),
        (["cpp", "c"], _text("ctest -R ", q(_text("^", dotted, "$")))), (["zig"], _text("zig test ", q(path), " --test-filter ", q(name))), (["qml"], _text("qmltestrunner -input ", q(path), " ", q(F.when(owner.isNotNull(), _text(owner, "::", name)).otherwise(name)))),
        (["php"], _text("vendor/bin/phpunit --filter ", q(_text("/::", name, "$/")), " ", q(path))), (["elixir"], _text("mix test ", q(_text(path, ":", line.cast("string"))))), (["erlang"], _text("rebar3 eunit --module=", q(stem))),
        (["lua"], _text("busted --filter ", q(name), " ", q(path))), (["r"], _text("Rscript -e ", q(_text("testthat::test_file(\"", path, "\")")))), (["powershell"], _text("pwsh -Command ", q(_text("Invoke-Pester -Path ", path)))),
        (["bash"], _text("bats -f ", q(_text("^", name, "$")), " ", q(path))), (["gdscript"], _text("godot --headless -s addons/gut/gut_cmdln.gd -gtest=", q(path), " -gunit_test_name=", q(name))),
    ]
    out = None
    for languages, command in arms:
        out = F.when(language.isin(*languages), command) if out is None else out.when(language.isin(*languages), command)
    return out


# Project files and the commands that run all tests of the project they belong to.
SUITES = (("Cargo.toml", "cargo test"), ("go.mod", "go test ./..."), ("package.json", "npm test"), ("pom.xml", "mvn test"), ("build.gradle", "gradle test"), ("build.gradle.kts", "gradle test"), ("build.sbt", "sbt test"),
          ("pyproject.toml", "pytest"), ("pytest.ini", "pytest"), ("mix.exs", "mix test"), ("rebar.config", "rebar3 eunit"), ("Package.swift", "swift test"), ("pubspec.yaml", "dart test"), ("build.zig", "zig build test"))


def suite_command(names: Column, at: Column) -> Column:
    """The command that runs all tests of the project whose files (names) are these, from its folder; null where they ask
    for none or for several different ones."""
    known = F.array_distinct(F.array_compact(F.array(*[F.when(F.array_contains(names, name), command) for name, command in SUITES])))
    one = F.when(F.size(known) == 1, known[0])
    return F.when(at == "", one).otherwise(F.concat(F.lit("cd "), quoted(at), F.lit(" && "), one))
