import pytest
from pyspark.sql import functions as F

from faultline.functions import chunks as C
from faultline.functions import symbols as S
from faultline.functions import text as T


@pytest.mark.parametrize(
    "raw, wanted",
    [
        (" (models/a/b.sql) ", "models/a/b.sql"),
        ("C:\\work\\dwh\\macros\\m.SQL", "macros/m.SQL"),
        ("tests/models/x.sql", "models/x.sql"),  # directory list order, not text order
        ("target/run/x.sql", None),
        ("target/run/seeds/x.yml", "seeds/x.yml"),
        ("other/x.sql", "other/x.sql"),
        ("models/readme.md", None),
        ("", None),
    ],
)
def test_source_path(column, raw, wanted):
    assert column(T.source_path, raw) == wanted


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\n\nb", "a\r\nb\rc", "x\x0by\x1cz w", "\n", "é\n "])
def test_split_lines_matches_python(column, text):
    assert column(T.split_lines, text) == text.splitlines()


def test_strip_removes_all_python_white_space(column):
    text = "\t\x1f  a b \x85　"
    assert column(T.strip, text) == text.strip()


@pytest.mark.parametrize("path", ["a/b.sql", "b.tar.gz", ".env", "a/.x.yml", "noext", "d/"])
def test_stem_and_suffix_match_pathlib(column, path):
    from pathlib import PurePosixPath

    assert column(T.stem, path) == PurePosixPath(path).stem
    assert column(T.suffix, path) == PurePosixPath(path).suffix


def test_cap_keeps_marker_beyond_the_limit(column):
    assert column(lambda c: T.cap(c, 5), "  abcd efgh ") == "abcd\n[truncated]".replace("abcd", "abcd")
    assert column(lambda c: T.cap(c, 50), "  abcd ") == "abcd"


@pytest.mark.parametrize("n, limit", [(90, 100), (500, 300), (500, 20), (1001, 301)])
def test_head_tail(column, n, limit):
    text = "".join(chr(97 + i % 26) for i in range(n))
    out = column(lambda c: T.head_tail(c, limit), text)
    assert len(out) == min(n, limit)
    if n > limit > 150:
        assert out.startswith(text[:20]) and out.endswith(text[-20:]) and f"truncated {n - limit} chars" in out
    elif n > limit:
        assert out == text[:limit]


@pytest.mark.parametrize(
    "path, project, wanted",
    [(" models\\a.sql", "dwh", "dwh/models/a.sql"), ("dwh/a.sql", "dwh", "dwh/a.sql"), ("dwh2/a.sql", "dwh", "dwh2/a.sql"), ("./a.sql", "dwh", "dwh/a.sql")],
)
def test_repo_file_path(column, path, project, wanted):
    assert column(T.repo_file_path, path, project) == wanted


def test_links(column):
    assert tuple(column(T.repo_parts, "https://www.h.org/a/b/c.git")) == ("a/b", "c")
    assert tuple(column(T.repo_parts, "git@h.org:a/b.git")) == ("a", "b")
    assert tuple(column(T.repo_parts, "h.org/only")) == (None, None)
    assert column(T.clone_link, "https://h/a/b/") == "https://h/a/b.git"
    assert tuple(column(T.gitlab_project, "git@h:a b/c~d*e+f.git")) == ("https://h/api/v4", "a%20b%2Fc~d%2Ae%2Bf")


def test_error_signals(column):
    text = "column \"Cust_Id\" missing; Relation dwh.sales.Orders and ref('stg_x', \"y z\") {{ util.fn(1) }} plain $tmp_1 from `q`"
    assert set(column(S.error_signals, text)) == {"cust_id", "orders", "stg_x", "y z", "fn", "tmp_1", "q"}


def test_symbols_skip_stop_words_but_node_names_do_not(column):
    assert column(S.aliases, "select 1 as end, 2 as total") == ["total"]
    found = column(S.node_symbols, "Order", "models/select.sql", "with a as (select 1), b as (select 2) select * from a as x")
    assert set(found) == {"order", "select", "a", "b", "x"}


def test_relevance_counts_symbols_and_substrings(spark):
    df = spark.createDataFrame([(["abc"], "xx abc key", ["abc", "key", "no", ""])], "sym array<string>, low string, sig array<string>")
    assert df.select(S.relevance(F.col("sym"), F.col("low"), F.col("sig"))).first()[0] == 4


@pytest.mark.parametrize("n", [0, 1, 899, 900, 901, 1680, 1681, 2460, 5000])
def test_raw_chunks(column, n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    wanted, start = [], 0
    while start < n:
        wanted.append(text[start:start + 900])
        if start + 900 >= n:
            break
        start += 780
    got = column(C.raw_chunks, text)
    assert [c["body"] for c in got] == wanted
    assert [c["title"] for c in got] == [f"RAW_CHUNK_{i + 1}" for i in range(len(wanted))]


def test_focused_context_keeps_what_matters(spark):
    filler = "\n".join(f"select {n} as col_{n}" for n in range(150))
    text = "{{ config(enabled=true) }}\n" + filler + "\nselect invoice_no from billed_items where invoice_no > 0"
    df = spark.createDataFrame([("a", text, ["invoice_no"]), ("b", "select 1", ["x"])], "key string, text string, signals array<string>")
    out = {r["key"]: r["focus"] for r in C.focused_context(df, "text", "signals", "focus", 800).collect()}
    assert out["b"] == "select 1"
    assert out["a"].startswith(f"[RAG lexical retrieval from {len(text)} chars]\nFINAL_SELECT:\nselect invoice_no from billed_items")
    assert len(out["a"]) <= 800 + len("\n[truncated]")


def test_vector_hits_replace_lexical_ones(spark):
    text = "select long_one from t\n" * 100
    schema = "key string, text string, signals array<string>, hits array<struct<title: string, body: string>>"
    df = spark.createDataFrame([("v", text, ["q"], [("REFS", "picked")]), ("l", text, ["q"], None)], schema)
    out = {r["key"]: r["focus"] for r in C.focused_context(df, "text", "signals", "focus", retrieved="hits").collect()}
    assert "[RAG vector" in out["v"] and "REFS:\npicked" in out["v"]
    assert "[RAG lexical" in out["l"]
