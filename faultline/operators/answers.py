"""Prompts out, answers in: message tables, the responder, and strict checks of answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..settings import LIMITS, SHRINKING_PROVIDER

# fixed value: system text of the format-repair request
REPAIR_INSTRUCTION = "You repair output format only. Return tags only."
_BLOCK = "(?sU)" + P.SOLUTION_BLOCK
BLOCK_LINES = 1 << 12
VALUE_CHARS = 500_000_000  # what one text value can surely hold (2 GB, up to four bytes a character)


# --- prompts ---------------------------------------------------------------------------

def log_blocks(slice_lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(run_key, block, text): the run's log in blocks of line numbers, to be joined by line ends in block order.

    No block holds more than ``block_lines`` lines, so a log of any size is spread over tasks.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return slice_lines.groupBy("run_key", F.expr(f"line_no div {block_lines}").alias("block")).agg(
        F.array_join(ordered.getField("line"), "\n").alias("text")
    )


def log_texts(blocks: DataFrame, max_chars: int = VALUE_CHARS) -> DataFrame:
    """(run_key, log): each run's ``log_blocks`` as one text.

    A log that one value cannot hold stops the query with the run's key; nothing is left out.  Such
    runs are prompted in parts (:func:`prompt_parts`).
    """
    sizes = blocks.groupBy("run_key").agg(F.sum(F.length("text") + 1).alias("chars"))
    text = F.array_join(F.array_sort(F.collect_list(F.struct("block", "text"))).getField("text"), "\n")
    refused = F.raise_error(F.concat(F.lit("log is too long for one text, use prompt_parts: "), F.col("run_key")))
    checked = sizes.select("run_key", F.when(F.col("chars") <= max_chars, F.col("chars")).otherwise(refused.cast("long")).alias("chars"))
    # an inner join on the checked size: the check runs before a log is gathered
    return blocks.join(checked.filter("chars >= 0"), "run_key").groupBy("run_key").agg(text.alias("log"))


def prompt_parts(contexts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(run_key, file, part, text): what surrounds the log in each prompt, and the log's blocks once per run.

    A prompt is its row of part 0, the run's blocks (file null, parts from 1) joined by line ends, and its
    last row (part null).  Blocks are stored once per run, however many files it blames.
    """
    head, tail = solution_frame(F.col("context"))
    order = Window.partitionBy("run_key").orderBy("block")
    body = blocks.select(
        "run_key", F.lit(None).cast("string").alias("file"), F.row_number().over(order).alias("part"), "text"
    )
    first = contexts.select("run_key", "file", F.lit(0).alias("part"), head.alias("text"))
    last = contexts.select("run_key", "file", F.lit(None).cast("int").alias("part"), tail.alias("text"))
    return first.unionByName(body).unionByName(last)


def solution_frame(context: Column) -> tuple[Column, Column]:
    """What stands before and after the log in a prompt."""
    # fixed values: tags of the prompt
    return F.lit("<DBT_ERROR>\n"), F.concat(F.lit("\n</DBT_ERROR>\n\n<SOURCE_CONTEXT>\n"), context, F.lit("\n</SOURCE_CONTEXT>"))


def solution_prompt(log: Column, context: Column) -> Column:
    head, tail = solution_frame(context)
    return F.concat(head, T.blank_if_null(log), tail)


def repair_prompt(context: Column, bad: Column) -> Column:
    # fixed value: wording of the repair request
    return F.format_string(
        "Your previous response did not match the required tags.\n"
        "Return only one valid block for this exact file path: %1$s\n\n"
        "If the previous response contains full corrected file content, put that content in <solution>.\n"
        "Otherwise return NO_FIX.\n\n"
        "Valid fallback:\n<solution>NO_FIX</solution>\n<file>\n%1$s\n</file>\n\n"
        "Previous response:\n%2$s\n",
        first_path(context), bad,
    )


def messages(system: Column, user: Column, max_user_chars: int = 0) -> Column:
    """array<struct<role, content>>; only the user text is ever shortened."""
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), T.head_tail(user, max_user_chars).alias("content")),
    )


def prompts(contexts: DataFrame, logs: DataFrame, instruction: str, max_user_chars: int = 0) -> DataFrame:
    """(run_key, file, context, messages) for ``contexts(run_key, file, context)``."""
    user = solution_prompt(F.col("log"), F.col("context"))
    return contexts.join(logs, "run_key", "left").select(
        "run_key", "file", "context", messages(F.lit(instruction), user, max_user_chars).alias("messages")
    )


def prompt_limit(provider: str) -> int:
    """Characters of user text that a provider takes; 0 means any number."""
    return LIMITS.prompt_chars if provider.strip().lower() == SHRINKING_PROVIDER else 0


def repair_prompts(responses: DataFrame, max_user_chars: int = 0) -> DataFrame:
    """Requests to mend the format of rejected ``responses(run_key, file, context, response)``."""
    clean = normalize(T.blank_if_null(F.col("response")))
    return responses.filter(~is_valid(F.col("response"), F.col("context"))).select(
        "run_key", "file", "context",
        messages(F.lit(REPAIR_INSTRUCTION), repair_prompt(F.col("context"), clean), max_user_chars).alias("messages"),
    )


# --- responder -------------------------------------------------------------------------

Responder = Callable[[list[dict[str, str]]], str]


def call_with_retry(
    call: Callable[[], str],
    transient: tuple[type[Exception], ...] = (ConnectionError, TimeoutError),
    attempts: int = 3,
    first_delay: float = 2.0,
    sleep: Callable[[float], None] = time.sleep,
) -> str:
    for left in reversed(range(attempts)):
        try:
            return call()
        except transient:
            if not left:
                raise
            sleep(first_delay * 2 ** (attempts - 1 - left))
    raise ValueError("attempts must be positive")


def respond(df: DataFrame, responder: Responder, out: str, only: str | None = None, **retry) -> DataFrame:
    """Add ``out``: the responder's text for each row's ``messages``.

    Rows stream through Arrow batches in the partitions they are in.  With ``only``, rows
    where that flag is false are passed on without a call.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wanted = batch[only] if only else [True] * len(batch)
            texts = [
                call_with_retry(lambda m=m: responder([dict(x) for x in m]), **retry) if w else None
                for m, w in zip(batch["messages"], wanted)
            ]
            yield batch.assign(**{out: pd.Series(texts, index=batch.index, dtype=object)})

    return df.mapInPandas(run, f"{fields}, `{out}` string")


def answer(asked: DataFrame, responder: Responder, max_user_chars: int = 0, **retry) -> DataFrame:
    """(run_key, file, context, response, repaired, solution): ask, check, mend once, settle.

    ``max_user_chars`` limits the repair request as ``prompts`` limits the first one.
    Both calls sit in one line of stages, so no branch of the plan asks twice.
    """
    first = respond(asked, responder, "response", **retry)
    checked = first.withColumn("rejected", ~is_valid(F.col("response"), F.col("context"))).withColumn(
        "messages",
        messages(
            F.lit(REPAIR_INSTRUCTION), repair_prompt(F.col("context"), normalize(T.blank_if_null(F.col("response")))), max_user_chars
        ),
    )
    second = respond(checked, responder, "repaired", only="rejected", **retry)
    return second.select(
        "run_key", "file", "context", "response", "repaired",
        final_solution(F.col("context"), F.col("response"), F.col("repaired")).alias("solution"),
    )


# --- checks ----------------------------------------------------------------------------

def source_paths(context: Column) -> Column:
    """Distinct paths named by ``SOURCE OF <path>:`` lines, in order."""
    found = F.regexp_extract_all(context, F.lit("(?dU)" + P.SOURCE_OF), F.lit(1))
    return F.array_distinct(F.transform(found, T.strip))


def first_path(context: Column) -> Column:
    return F.coalesce(F.get(source_paths(context), 0), F.lit(P.NO_FILE))


def normalize(response: Column) -> Column:
    """Text after the last ``</think>`` where thinking was shown, stripped."""
    spoken = F.when(F.contains(response, F.lit("<think>")), F.substring_index(response, "</think>", -1))
    return T.strip(F.coalesce(spoken, response))


def is_valid(response: Column, context: Column) -> Column:
    """True when the answer is nothing but complete blocks for allowed files."""
    text = normalize(T.blank_if_null(response))
    allowed = source_paths(context)
    bodies = F.transform(F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(1)), T.strip)
    targets = F.transform(F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(2)), T.strip)
    rest = F.regexp_replace(F.regexp_replace(text, _BLOCK, ""), r"(?U)[\s\x1c-\x1f]*----[\s\x1c-\x1f]*", "")
    good_body = lambda b: (b != "") & ~F.startswith(b, F.lit("```")) & ~F.startswith(b, F.lit("diff --git"))
    return (
        F.startswith(text, F.lit("<solution>"))
        & (F.size(allowed) > 0)
        & (F.size(bodies) > 0)
        & (T.strip(rest) == "")
        & F.forall(bodies, good_body)
        & F.forall(targets, lambda t: F.array_contains(allowed, t))
    )


def no_fix(context: Column) -> Column:
    return F.format_string("<solution>NO_FIX</solution>\n<file>\n%s\n</file>", first_path(context))


def final_solution(context: Column, response: Column, repaired: Column) -> Column:
    return F.coalesce(
        F.when(is_valid(response, context), normalize(response)),
        F.when(is_valid(repaired, context), normalize(repaired)),
        no_fix(context),
    )


def solution_parts(solutions: DataFrame) -> DataFrame:
    """(run_key, ord, idx, content, file): tagged parts of ``solutions(run_key, ord, solution)``.

    Answers split on the separator wherever it stands; pieces without both tags are dropped
    and contents keep their white space.  A run's answers are joined by that very separator
    line, so splitting each answer on its own gives the same parts, in (ord, idx) order, and
    no run is ever gathered.
    """
    piece = F.col("piece")
    content = F.regexp_extract(piece, r"(?s)<solution>(.*?)</solution>", 1)
    file = F.regexp_extract(piece, r"(?s)<file>(.*?)</file>", 1)
    complete = piece.rlike(r"(?s)<solution>.*?</solution>") & piece.rlike(r"(?s)<file>.*?</file>")
    return (
        solutions.select("run_key", "ord", F.posexplode(F.split("solution", P.PART_SEPARATOR, -1)).alias("idx", "piece"))
        .filter(complete)
        .select("run_key", "ord", "idx", content.alias("content"), file.alias("file"))
    )


def fixing_parts(parts: DataFrame) -> DataFrame:
    return parts.filter(T.strip(F.col("content")) != P.NO_FIX)
