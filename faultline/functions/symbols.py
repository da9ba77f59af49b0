"""Column builders that pull symbols out of SQL and log text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import text as T


def _found(c: Column, pattern: str, group: int = 1, flags: str = "iU") -> Column:
    return F.regexp_extract_all(T.blank_if_null(c), F.lit(f"(?{flags})" + pattern), F.lit(group))


def clean_symbol(c: Column) -> Column:
    return F.lower(clean_name(c))


def clean_name(c: Column) -> Column:
    """Resource name without wrapping punctuation or qualifiers; case is kept."""
    return F.substring_index(F.btrim(T.strip(c), F.lit(P.PUNCTUATION)), ".", -1)


def symbols(values: Column) -> Column:
    """Distinct cleaned symbols of an array, stop words left out."""
    return _distinct(F.transform(values, clean_symbol))


def _identifiers(values: Column) -> Column:
    """The same for plain identifiers, which hold nothing to strip off."""
    return _distinct(F.transform(values, F.lower))


def _dotted(values: Column) -> Column:
    """The same for dotted identifiers; only dots can stand at their end."""
    return _distinct(F.transform(values, lambda v: F.lower(F.substring_index(F.rtrim(v, F.lit(".")), ".", -1))))


def _distinct(values: Column) -> Column:
    return F.array_except(values, F.array(*[F.lit(w) for w in ("", *P.STOP_WORDS)]))


def refs(c: Column) -> Column:
    calls = _found(c, P.REF_CALL, 0)

    def argument(group: int) -> Column:
        return F.transform(calls, lambda m: F.regexp_extract(m, "(?iU)" + P.REF_CALL, group))

    return symbols(F.filter(F.concat(argument(1), argument(2)), lambda v: v != ""))


def macro_calls(c: Column) -> Column:
    return F.array_except(
        _dotted(_found(c, P.MACRO_CALL)), F.array(*[F.lit(m) for m in P.BUILTIN_MACROS])
    )


def aliases(c: Column) -> Column:
    return _identifiers(_found(c, P.ALIAS))


def ctes(c: Column) -> Column:
    return _identifiers(_found(c, P.CTE))


def leading_signals(c: Column) -> Column:
    """The keyword-led name that a text begins with, if any."""
    name = F.regexp_extract(c, r"(?iU)\A" + P.KEYWORD_SIGNAL, 1)
    return _dotted(F.when(name != "", F.array(name)).otherwise(F.array().cast("array<string>")))


def error_signals(c: Column) -> Column:
    """Hints in error text: keyword-led names, quoted names, refs, macros, odd identifiers."""
    marked = F.filter(
        _found(c, P.IDENTIFIER, 0, "U"), lambda t: F.contains(t, F.lit("_")) | F.contains(t, F.lit("$"))
    )
    return union(
        _dotted(_found(c, P.KEYWORD_SIGNAL)),
        _dotted(_found(c, P.QUOTED_IDENTIFIER, 1, "U")),
        refs(c),
        macro_calls(c),
        _identifiers(marked),
    )


def source_symbols(source: Column) -> Column:
    """What a source defines or uses."""
    return union(refs(source), macro_calls(source), aliases(source), ctes(source))


def node_symbols(name: Column, path: Column, source: Column) -> Column:
    """What a node defines or uses; its own name and file stem skip the stop words."""
    return named_symbols(name, path, source_symbols(source))


def named_symbols(name: Column, path: Column, used: Column) -> Column:
    """The same from the ``source_symbols`` that its source has been taken apart to."""
    own = F.array(clean_symbol(T.blank_if_null(name)), clean_symbol(T.stem(T.blank_if_null(path))))
    return union(own, used)


def union(first: Column, *rest: Column) -> Column:
    out = F.array_distinct(first)
    for other in rest:
        out = F.array_union(out, other)
    return out


def relevance(symbols_col: Column, lowered_source: Column, signals: Column) -> Column:
    """3 per signal that is a symbol, else 1 per signal found inside the source."""
    points = F.transform(
        signals,
        lambda s: F.when(F.array_contains(symbols_col, s), 3)
        .when((s != "") & F.contains(lowered_source, s), 1)
        .otherwise(0),
    )
    return F.coalesce(F.aggregate(points, F.lit(0), lambda acc, v: acc + v), F.lit(0))
