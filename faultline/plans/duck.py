"""Pieces of check SQL, in DuckDB's dialect."""

from __future__ import annotations

from ..functions import patterns as P

_WS = " || ".join(f"chr({ord(c)})" for c in P.WHITESPACE)
_PUNCT = "'" + P.PUNCTUATION.replace("'", "''") + "'"
_STOP = ", ".join(f"'{w}'" for w in P.STOP_WORDS)
_BUILTIN = ", ".join(f"'{w}'" for w in P.BUILTIN_MACROS)
# RE2's \w and \b know ASCII only: spell the Unicode class out, and end words by greed
W = r"[\p{L}\p{N}_]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {_WS})"


def unpunct(x: str) -> str:
    return f"trim({strip(x)}, {_PUNCT})"


def last_part(x: str) -> str:
    return f"list_extract(string_split({unpunct(x)}, '.'), -1)"


def symbol(x: str) -> str:
    return f"lower({last_part(x)})"


def symbols(values: str) -> str:
    return (
        f"list_filter(list_distinct(list_transform({values}, lambda v: {symbol('v')})), "
        f"lambda s: s <> '' and s not in ({_STOP}))"
    )


def found(x: str, pattern: str, group: int = 1, flags: str = "i") -> str:
    return f"regexp_extract_all({x}, {lit((f'(?{flags})' if flags else '') + pattern)}, {group})"


def refs(x: str) -> str:
    pat = r"\b(?:ref|source)\s*\(\s*['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?"
    return symbols(f"list_filter(list_concat({found(x, pat, 1)}, {found(x, pat, 2)}), lambda r: r <> '')")


def macro_calls(x: str) -> str:
    pat = r"\{\{\s*([A-Za-z_][\w.]*)\s*\("
    return f"list_filter({symbols(found(x, pat))}, lambda c: c not in ({_BUILTIN}))"


def aliases(x: str) -> str:
    return symbols(found(x, rf"(?:^|[^\p{{L}}\p{{N}}_])as\s+([A-Za-z_](?:{W}|\$)*)"))


def ctes(x: str) -> str:
    return symbols(found(x, r"(?:\bwith|,)\s+([A-Za-z_][\w$]*)\s+as\s*\("))


def union(*lists: str) -> str:
    return "list_distinct(list_concat(" + ", ".join(lists) + "))"


def error_signals(x: str) -> str:
    key = r"\b(?:column|field|identifier|relation|table|model|macro|source|alias)\s+[`'\"]?([A-Za-z_][\w$.]*)"
    quoted = r"[`'\"]([A-Za-z_][\w$.]*)[`'\"]"
    marked = f"list_filter({found(x, r'\b[A-Za-z_][\w$]*\b', 0, '')}, lambda t: contains(t, '_') or contains(t, '$'))"
    return union(symbols(found(x, key)), symbols(found(x, quoted, 1, "")), refs(x), macro_calls(x), symbols(marked))


def node_symbols(name: str, path: str, text: str) -> str:
    return union(f"[{symbol(name)}, {symbol(stem(path))}]", refs(text), macro_calls(text), aliases(text), ctes(text))


def basename(x: str) -> str:
    return rf"regexp_extract({x}, '([^/]+)/*$', 1)"


def stem(x: str) -> str:
    return rf"regexp_replace({basename(x)}, '^(.+)\.[^.]+$', '\1')"


def source_path(x: str) -> str:
    p = f"replace({unpunct(x)}, '\\', '/')"
    dirs = " ".join(f"when strpos({p}, '{d}/') > 0 then substr({p}, strpos({p}, '{d}/'))" for d in P.SOURCE_DIRS)
    return (
        f"case when {x} = '' or not regexp_matches(lower({p}), '[.](sql|yml|yaml)$') then null {dirs} "
        f"when contains('/' || {p}, '/target/') then null else {p} end"
    )


def joined(values: str, sep: str = ",") -> str:
    return f"array_to_string(list_sort({values}), '{sep}')"


def head_tail(x: str, limit: int) -> str:
    """A text's head and tail around the cut mark, if it is longer than ``limit``."""
    m = f"(chr(10) || chr(10) || '{P.CUT_MARK[0]}' || cast(length({x}) - {limit} as varchar) || '{P.CUT_MARK[1]}' || chr(10) || chr(10))"
    room = f"({limit} - length({m}))"
    half = f"cast(floor({room} / 2.0) as int)"
    return (
        f"case when length({x}) <= {limit} then {x} else substr({x}, 1, {half}) || {m} || "
        f"substr({x}, length({x}) - ({room} - {half}) + 1) end"
    )
