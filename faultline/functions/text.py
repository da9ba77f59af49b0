"""Column builders for plain text and paths.  Nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(P.WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(P.WHITESPACE))


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(blank_if_null(c), P.ANSI_ESCAPE, "")


def split_lines(c: Column) -> Column:
    """Lines without their terminators; a final terminator adds no empty line."""
    parts = F.split(c, P.LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines_matching(c: Column, pattern: str) -> Column:
    kept = F.filter(split_lines(c), lambda line: line.rlike("(?iU)" + pattern))
    return F.array_join(F.transform(kept, rstrip), "\n")


def contains_any(text: Column, signals: Column) -> Column:
    low = F.lower(text)
    return F.exists(signals, lambda s: (s != "") & F.contains(low, s))


def lines_with_signals(c: Column, signals: Column) -> Column:
    kept = F.filter(split_lines(c), lambda line: contains_any(line, signals))
    return F.array_join(F.transform(kept, rstrip), "\n")


def cap(c: Column, limit: int | Column) -> Column:
    """Stripped text, cut with a marker once it is longer than ``limit``."""
    body = strip(blank_if_null(c))
    n = F.lit(limit) if isinstance(limit, int) else limit
    cut = F.concat(rstrip(F.substring(body, F.lit(1), n)), F.lit("\n[truncated]"))
    return F.when(F.length(body) > n, cut).otherwise(body)


def head_tail(c: Column, limit: int) -> Column:
    """Keep both ends of an over-long text around a marker that counts what went."""
    if limit <= 0:
        return c
    dropped = F.length(c) - limit
    marker = F.concat(
        F.lit("\n\n" + P.CUT_MARK[0]), dropped.cast("string"), F.lit(P.CUT_MARK[1] + "\n\n"),
    )
    budget = F.lit(limit) - F.length(marker)
    head = F.floor(budget / 2).cast("int")
    tail = (budget - head).cast("int")
    both = F.concat(
        F.substring(c, F.lit(1), head), marker, F.substring(c, F.length(c) - tail + 1, tail)
    )
    return (
        F.when(F.length(c) <= limit, c)
        .when(budget <= 0, F.substring(c, 1, limit))
        .otherwise(both)
    )


# --- paths -----------------------------------------------------------------------------

def slashes(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/*\z", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?s)\A(.+)\.[^.]+\z", "$1")


def suffix(path: Column) -> Column:
    """Last extension with its dot, lower-cased; empty when there is none."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)\A.+(\.[^.]+)\z", 1))


def has_part(path: Column, part: str) -> Column:
    return F.array_contains(F.split(path, "/"), part)


def is_yaml(path: Column) -> Column:
    return suffix(path).isin(".yml", ".yaml")


def source_path(raw: Column) -> Column:
    """Project-relative source path, or null when the text is not one.

    The listed directories are tried in their own order and found anywhere in the text.
    """
    path = slashes(F.btrim(strip(raw), F.lit(P.PUNCTUATION)))
    low = F.lower(path)
    extension_ok = F.lit(False)
    for ext in P.SOURCE_EXTENSIONS:
        extension_ok = extension_ok | F.endswith(low, F.lit(ext))
    cut = [
        F.when(F.instr(path, d + "/") > 0, F.substring(path, F.instr(path, d + "/"), F.length(path)))
        for d in P.SOURCE_DIRS
    ]
    plain = F.when(~F.contains(F.concat(F.lit("/"), path), F.lit("/target/")), path)
    return F.when((raw != "") & extension_ok, F.coalesce(*cut, plain))


def repo_file_path(raw: Column, project: Column) -> Column:
    """Prefix the project unless the path already starts with its name (plain prefix test)."""
    path = slashes(strip(raw))
    joined = F.when(F.startswith(path, F.lit("/")), path).otherwise(
        F.concat(project, F.lit("/"), path)
    )
    # the path library of the reference folds repeated slashes and "." parts
    tidy = F.regexp_replace(F.regexp_replace(joined, r"/(?:\./)+", "/"), r"(?<=.)/{2,}", "/")
    tidy = F.regexp_replace(tidy, r"(?<=.)/\.?\z", "")
    return (
        F.when((project != "") & F.startswith(path, project), path)
        .when(project == "", F.when(path == "", F.lit(".")).otherwise(path))
        .otherwise(tidy)
    )


# --- repository links ------------------------------------------------------------------

def _bare_link(link: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(link), r"\.git\z", ""), r"/+\z", "")


def repo_parts(link: Column) -> Column:
    """struct(namespace, name), both null when the link has fewer than two path parts."""
    bare = _bare_link(link)
    path = F.when(F.startswith(bare, F.lit("git@")), F.regexp_extract(bare, r"(?s)\A[^:]*:(.*)\z", 1)).otherwise(
        F.regexp_extract(bare, r"\A(?:https?://)?(?:www\.)?[^/\s]+/(.+)\z", 1)
    )
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    usable = F.size(parts) >= 2
    return F.struct(
        F.when(usable, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).alias("namespace"),
        F.when(usable, F.element_at(parts, -1)).alias("name"),
    )


def clone_link(link: Column) -> Column:
    return (
        F.when(blank_if_null(link) == "", F.lit(""))
        .when(F.endswith(link, F.lit(".git")), link)
        .otherwise(F.concat(F.regexp_replace(link, r"/+\z", ""), F.lit(".git")))
    )


def gitlab_project(link: Column) -> Column:
    """struct(api_base, project) with the project path percent-encoded; null if unsupported."""
    bare = _bare_link(link)
    ssh = F.startswith(bare, F.lit("git@"))
    web = r"\A(?:https?://)?([^/\s]+)/(.+)\z"
    host = F.when(ssh, F.regexp_extract(bare, r"(?s)\Agit@([^:]*):", 1)).otherwise(F.regexp_extract(bare, web, 1))
    path = F.when(ssh, F.regexp_extract(bare, r"(?s)\A[^:]*:(.*)\z", 1)).otherwise(F.regexp_extract(bare, web, 2))
    quoted = F.url_encode(F.btrim(path, F.lit("/")))
    for found, wanted in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        quoted = F.replace(quoted, F.lit(found), F.lit(wanted))
    return F.when(
        host != "",
        F.struct(
            F.concat(F.lit("https://"), host, F.lit("/api/v4")).alias("api_base"), quoted.alias("project")
        ),
    )
