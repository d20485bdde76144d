from sparkcover.functions.text import split_lines, split_words
from sparkcover.operators.wordcount import (
    char_count,
    popular_char_count,
    popular_words,
    word_count,
)
from sparkcover.sources.text import document_lines, read_lines

# The sample corpus of the reference application (9 lines, the last one empty).
INPUT_LINES = [
    "apple",
    "banana counter",
    "counter one two three",
    "three one",
    "five seven eight",
    "twenty one three five counter six",
    "one siz helga",
    "apple banana fiver",
    "",
]


def lines_df(spark):
    return spark.createDataFrame([(x,) for x in INPUT_LINES], "line string")


def test_split_words_edge_cases(spark):
    cases = ["", "  ", "a  b ", " a", "x\ty z"]
    df = spark.createDataFrame([(c,) for c in cases], "line string")
    got = [r[0] for r in df.select(split_words("line")).collect()]
    assert got == [[""], [], ["a", "", "b"], ["", "a"], ["x\ty", "z"]]


def test_split_lines(spark):
    cases = ["", "a", "a\n", "a\n\nb", "a\r\nb\rc\n\n", "\n"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in df.select(split_lines("t")).collect()]
    assert got == [[], ["a"], ["a"], ["a", "", "b"], ["a", "b", "c", ""], [""]]


def test_word_count_golden(spark):
    got = {r["word"]: r["n"] for r in word_count(lines_df(spark)).collect()}
    assert got == {
        "": 1, "apple": 2, "banana": 2, "counter": 3, "eight": 1, "five": 2, "fiver": 1,
        "helga": 1, "one": 4, "seven": 1, "six": 1, "siz": 1, "three": 3, "twenty": 1, "two": 1,
    }


def _chars(spark, t):
    return {r["ch"]: r["n"] for r in popular_char_count(lines_df(spark), t).collect()}


def test_char_count_goldens(spark):
    assert _chars(spark, 1) == dict(
        a=5, b=1, c=1, e=12, f=2, g=2, h=3, i=5, l=2, n=6, o=3, p=2, r=3, s=3, t=6, u=1, v=3,
        w=2, x=1, y=1, z=1,
    )
    assert _chars(spark, 2) == dict(
        a=4, b=1, c=1, e=6, f=1, h=1, i=1, l=1, n=4, o=2, p=2, r=2, t=2, u=1, v=1
    )
    assert _chars(spark, 3) == dict(c=1, e=4, h=1, n=2, o=2, r=2, t=2, u=1)


def test_chars_are_code_points(spark):
    df = spark.createDataFrame([("a\U0001F600b",)], "word string")
    assert {r["ch"] for r in char_count(df).collect()} == {"a", "\U0001F600", "b"}


def test_read_lines_from_file(spark, tmp_path):
    p = tmp_path / "input.txt"
    p.write_text("\n".join(INPUT_LINES) + "\n")
    lines = read_lines(spark, str(p))
    assert lines.count() == 9
    got = {r["word"]: r["n"] for r in popular_words(word_count(lines), 3).collect()}
    assert got == {"counter": 3, "one": 4, "three": 3}


def test_document_lines_numbering(spark):
    docs = spark.createDataFrame([(1, "a\nb\n"), (2, ""), (3, "x\r\n\r\ny")], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in document_lines(docs).collect())
    assert got == [(1, 1, "a"), (1, 2, "b"), (3, 1, "x"), (3, 2, ""), (3, 3, "y")]


def test_plan_has_two_exchanges_and_partial_aggs(spark, capsys):
    popular_char_count(lines_df(spark), 2).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 2
    assert "partial_count" in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
