import pytest
from pyspark.sql import functions as F

from faultline.operators import answers as A

CONTEXT = "SOURCE OF models/fin/sales.sql:\nselect 1\nSOURCE OF macros/m.sql : x\nSOURCE OF models/fin/sales.sql:"
GOOD = "<solution>\nselect 2\n</solution>\n<file>\nmodels/fin/sales.sql\n</file>"


def test_source_paths(column):
    assert column(A.source_paths, CONTEXT) == ["models/fin/sales.sql", "macros/m.sql"]


@pytest.mark.parametrize(
    "response, valid",
    [
        (GOOD, True),
        ("<think>hm</think> " + GOOD, True),
        (GOOD + "\n----\n<solution>NO_FIX</solution><file>macros/m.sql</file>", True),
        (GOOD + " trailing", False),
        ("Sure: " + GOOD, False),
        (GOOD.replace("fin", "other"), False),
        (GOOD.replace("select 2", "```sql"), False),
        (GOOD.replace("select 2", "diff --git a b"), False),
        (GOOD.replace("select 2", " "), False),
        ("", False),
    ],
)
def test_validity(column, response, valid):
    assert column(A.is_valid, response, CONTEXT) is valid
    assert column(A.is_valid, response, "no sources") is False


def test_final_solution_falls_back(column):
    assert column(A.final_solution, CONTEXT, "prose", GOOD) == GOOD
    assert column(A.final_solution, CONTEXT, "prose", "more prose") == "<solution>NO_FIX</solution>\n<file>\nmodels/fin/sales.sql\n</file>"
    assert "NO_FILE" in column(A.final_solution, "nothing", "prose", None)


def test_parts_split_even_inside_sql(spark):
    text = "<solution> a </solution><file>f</file>----<solution>b ---- c</solution><file>g</file>----<solution>NO_FIX\n</solution><file>h</file>"
    df = spark.createDataFrame([("r", 0, text)], "run_key string, ord int, solution string")
    parts = A.solution_parts(df).collect()
    assert [(p["content"], p["file"]) for p in parts] == [(" a ", "f"), ("NO_FIX\n", "h")]
    assert [p["file"] for p in A.fixing_parts(A.solution_parts(df)).collect()] == ["f"]


@pytest.mark.parametrize("failures, answered", [(0, True), (1, True), (2, True), (3, False)])
def test_retry(failures, answered):
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) <= failures:
            raise ConnectionError
        return "ok"

    if answered:
        assert A.call_with_retry(flaky, sleep=waits.append) == "ok"
    else:
        with pytest.raises(ConnectionError):
            A.call_with_retry(flaky, sleep=waits.append)
    assert waits == [2.0, 4.0][: min(failures, 2)]


def test_answer_mends_once(spark):
    def responder(messages):
        return GOOD if messages[0]["content"] == A.REPAIR_INSTRUCTION else "prose"

    asked = spark.createDataFrame([("r", "f", CONTEXT)], "run_key string, file string, context string").withColumn(
        "messages", A.messages(F.lit("s"), F.lit("u"))
    )
    row = A.answer(asked, responder).first()
    assert (row["response"], row["solution"]) == ("prose", GOOD)


def test_no_log_is_left_out(spark):
    lines = spark.createDataFrame([("big", n, "x" * 10) for n in range(9)] + [("small", 0, "y")], "run_key string, line_no long, line string")
    blocks = A.log_blocks(lines, 4)
    assert {r["run_key"]: r["log"] for r in A.log_texts(blocks).collect()} == {"big": "\n".join(["x" * 10] * 9), "small": "y"}
    with pytest.raises(Exception, match="too long for one text.*big"):
        A.log_texts(blocks, 50).collect()
    contexts = spark.createDataFrame([("big", "f", "ctx")], "run_key string, file string, context string")
    parts = A.prompt_parts(contexts, blocks).filter("run_key = 'big'").collect()
    head = next(r["text"] for r in parts if r["part"] == 0)
    tail = next(r["text"] for r in parts if r["part"] is None)
    body = [r["text"] for r in sorted((r for r in parts if r["part"]), key=lambda r: r["part"])]
    whole = A.prompts(contexts, A.log_texts(blocks), "s").first()["messages"][1]["content"]
    assert head + "\n".join(body) + tail == whole


def test_limits_of_providers():
    assert A.prompt_limit(" Ollama ") == 24000 and A.prompt_limit("other") == 0
