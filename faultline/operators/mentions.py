"""Find every place where a log names a failing resource or a source file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..sources.logs import LOOKAHEAD, with_lookahead

# pattern rank -> (pattern, groups that hold resource / name / path)
PATTERNS = {
    1: (P.ERROR_REF, {"resource": 1, "name": 2, "path": 3}),
    2: (P.FAILURE_REF, {"resource": 1, "name": 2, "path": 3}),
    3: (P.SOURCE_PATH, {"path": 1}),
    4: (P.STATUS_REF, {"name": 1}),
    5: (P.NATURAL_REF, {"name": 1}),
}
TIER_OF_PATTERN = {1: 1, 2: 1, 3: 2, 4: 3, 5: 3}

# a match may begin in the line itself, never in the look-ahead below it
_STARTS_HERE = r"(?=(?:[^\n]*\n){%d})" % LOOKAHEAD
_POINTER_HINT = r"(?i)compiled code at|\bline\b|\[\d+:\d+\]"
_ANY_HINT = r"(?i)error|failure|\.sql|\.ya?ml|(?:database|compilation|runtime|parsing)\s*\z"


def _pattern(rank: int, start: str = "") -> str:
    raw = PATTERNS[rank][0]
    return "(?iU)" + (raw if rank == 3 else raw.format(start=start))


def _matches(rank: int) -> Column:
    """Array of whole matches; their groups are read from the short match text."""
    if rank == 3:
        whole = F.regexp_extract_all("line", F.lit(_pattern(3)), F.lit(0))
    else:
        whole = F.regexp_extract_all(
            F.concat_ws("\n", "line", "ahead"), F.lit(_pattern(rank, _STARTS_HERE)), F.lit(0)
        )
    groups = PATTERNS[rank][1]

    def parts(m: Column) -> Column:
        def pick(field: str) -> Column:
            if field not in groups:
                return F.lit(None).cast("string")
            return F.nullif(F.regexp_extract(m, _pattern(rank), groups[field]), F.lit(""))

        return F.struct(
            F.lit(rank).alias("pattern"),
            pick("resource").alias("resource"),
            pick("name").alias("name"),
            pick("path").alias("path"),
        )

    return F.transform(whole, parts)


def mentions(lines: DataFrame, block_lines: int | None = None) -> DataFrame:
    """(run_key, line_no, pattern, idx, resource, name, path), one row per match.

    Lines that cannot start a match are dropped by one cheap test before the patterns run.
    Input that already carries an ``ahead`` column is not shuffled at all.
    """
    clean = lines.withColumn("line", T.strip_ansi(F.col("line")))
    hint = F.col("line").rlike(_ANY_HINT)
    if "ahead" in lines.columns:
        open_lines = clean.filter(hint)
    else:
        open_lines = with_lookahead(clean, hint, **({"block_lines": block_lines} if block_lines else {}))
    found = F.flatten(
        F.array(*[F.transform(_matches(r), lambda m, i: m.withField("idx", i)) for r in PATTERNS])
    )
    return open_lines.select("run_key", "line_no", F.inline(found)).select(
        "run_key", "line_no", "pattern", "idx", "resource", "name", "path"
    )


def compiled_mentions(lines: DataFrame) -> DataFrame:
    """(run_key, path, location): first compiled file named per run, first error location."""
    clean = lines.withColumn("line", T.strip_ansi(F.col("line")))
    hint = F.col("line").rlike(_POINTER_HINT)
    # path and number may stand on the next line, as its first word
    text = F.concat("line", F.lit("\n"), F.substring_index("ahead", "\n", 1))
    path = F.regexp_extract(text, "(?iU)" + P.COMPILED_SQL, 1)
    place = F.regexp_extract(text, "(?U)" + P.ERROR_LOCATION, 0)
    return (
        with_lookahead(clean, hint, head=r"\A\S+").select("run_key", "line_no", path.alias("path"), place.alias("place"))
        .filter((F.col("path") != "") | (F.col("place") != ""))
        .groupBy("run_key")
        .agg(
            F.min_by("path", F.when(F.col("path") != "", F.col("line_no"))).alias("path"),
            F.min_by("place", F.when(F.col("place") != "", F.col("line_no"))).alias("location"),
        )
        .filter(F.col("path").isNotNull())
    )
