"""Path helpers, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_root(root: Column) -> Column:
    r"""The canonical spelling of a workspace root: `/` for `\`, no leading `\\?\`, no doubled or trailing separator,
    no `.` segment, an upper-case drive letter. Null for null and blank roots; the root folder stays `/`."""
    messy = F.lit(False)
    for sign in ("\\", "//", "/./"):
        messy = messy | F.contains(root, F.lit(sign))
    for sign in ("/", "/."):
        messy = messy | F.endswith(root, F.lit(sign))
    messy = messy | F.startswith(root, F.lit("./")) | (F.substring(root, 2, 1) == ":")
    p = F.replace(root, F.lit("\\"), F.lit("/"))
    p = F.regexp_replace(p, "^//\\?/", "")
    p = F.regexp_replace(F.concat(p, F.lit("/")), "/+", "/")
    p = F.regexp_replace(p, "/(\\./)+", "/")
    p = F.regexp_replace(p, "^(\\./)+", "")
    p = F.regexp_replace(p, "(?<=.)/+$", "")
    # a drive letter: its two parts are matched apart, so that no part of the expression is repeated
    p = F.transform(F.array(p), lambda x: F.when(x.rlike("^[a-z]:"), F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))).otherwise(x))[0]
    # most roots are clean already; only the others take the slow way
    return F.when(F.trim(root) == "", None).when(~messy, root).otherwise(F.nullif(p, F.lit("")))


#: The same rule in DuckDB's SQL, for a column {0}.
CANONICAL_ROOT_SQL = r"""
CASE WHEN trim({0}) = '' THEN NULL ELSE (
  SELECT CASE WHEN q = '' THEN NULL WHEN regexp_matches(q, '^[a-z]:') THEN upper(q[1]) || q[2:] ELSE q END FROM (
    SELECT CASE WHEN p = '/' THEN p ELSE regexp_replace(p, '/+$', '') END AS q FROM (
      SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        replace({0}, '\', '/'), '^//\?/', '') || '/', '/+', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', '') AS p))) END
"""


def folder(path: Column) -> Column:
    """The part before the last separator, '' where there is none."""
    return F.when(path.rlike("[/\\\\]"), F.regexp_replace(path, "[/\\\\][^/\\\\]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def normal_path(path: Column) -> Column:
    """A path for comparison: `/` for `\\`, ASCII lower case, as the fact store matches paths."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.replace(path, F.lit("\\"), F.lit("/")), upper, lower)


def shared_segments(a: Column, b: Column) -> Column:
    """How many leading folder segments two paths share."""
    same = F.zip_with(F.split(folder(a), "/"), F.split(folder(b), "/"), lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    return F.when((folder(a) == "") | (folder(b) == ""), 0).otherwise(
        F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
                    lambda s, x: F.struct((s.n + (s.on & x).cast("int")).alias("n"), (s.on & x).alias("on")), lambda s: s.n))
