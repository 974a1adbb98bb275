import pytest
from pyspark.sql import functions as F

from quarry.functions import scalars
from quarry.operators import chunk


def run(spark, chunker, body, path="a/Title"):
    df = spark.createDataFrame([(1, path, body)], "id long, path string, body string")
    return sorted((r.line_start, r.line_end, r.text) for r in chunker(df).collect())


@pytest.mark.parametrize(
    ("body", "expected"),
    [("First.\n\nSecond.", ["First.", "Second."]), ("", []), ("   \n\n   ", []), ("Only body.", ["Only body."]), ("a\r\n\r\nb", ["a\r\n\r\nb"])],
)
def test_paragraphs(spark, body, expected):
    assert run(spark, chunk.chunk_paragraphs, body) == [(i, i, t) for i, t in enumerate(expected)]


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("First.\n\nSecond.", [(0, 0, "First."), (2, 2, "Second.")]),
        ("A\nB\nC\n\nD", [(0, 2, "A\nB\nC"), (4, 4, "D")]),
        ("\n\nActual paragraph.", [(2, 2, "Actual paragraph.")]),
        ("", [(0, 0, "Title")]),
        ("a\nb\n\n c\n\n\n\nd", [(0, 1, "a\nb"), (3, 3, "c"), (7, 7, "d")]),
        ("　x \n", [(0, 0, "x")]),
    ],
)
def test_markdown_lines(spark, body, expected):
    assert run(spark, chunk.chunk_markdown, body) == expected
    assert run(spark, chunk.chunk_markdown_by_window, body) == expected


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ('{"name":"A","mes":"hi"}\n{"name":"B","mes":"yo"}', [(0, 0, "A: hi"), (1, 1, "B: yo")]),
        ('{"role":"user","content":"hello"}', [(0, 0, "user: hello")]),
        ('{"content":"a"}\n\n{"content":"b"}\n', [(0, 0, "a"), (2, 2, "b")]),
        ('{"content":"a"}\n{not json', [(0, 0, "a"), (1, 1, "{not json")]),
        ("", [(0, 0, "empty.jsonl")]),
        ('{"content":"a\\n\\nb"}', [(0, 0, "a\nb")]),
        ('{"content":"a"}\r\n{"content":"b"}\r\n', [(0, 0, "a"), (1, 1, "b")]),
    ],
)
def test_jsonl(spark, body, expected):
    assert run(spark, chunk.chunk_jsonl, body, "x/empty.jsonl") == expected


def test_jsonl_array_agrees(spark):
    body = '{"content":"a"}\n\n{not json\n'
    df = spark.createDataFrame([(1, "x/f.jsonl", body)], "id long, path string, body string")
    row = df.select(chunk.jsonl_array(F.col("body"), F.lit("f.jsonl")).alias("c")).first()
    assert [(c.line_start, c.line_end, c.text) for c in row.c] == run(spark, chunk.chunk_jsonl, body, "x/f.jsonl")


def test_jsonl_append_keeps_earlier_lines(spark):
    before = '{"content":"a"}\n{"content":"b"}\n'
    assert run(spark, chunk.chunk_jsonl, before + '{"content":"c"}\n')[:2] == run(spark, chunk.chunk_jsonl, before)


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ('{"mes": 5, "content": "x"}', "x"),
        ('{"name": "", "role": "user", "content": "x"}', "x"),
        ('{"name": 1, "role": "user", "content": "x"}', "user: x"),
        ('{"role": "user", "content": ""}', "user:"),
        ('"top"', '"top"'),
        ("[1,2]", "[1,2]"),
        ('{"b": "2", "a": "1", "n": 3}', "a: 1\nb: 2"),
        ('{"n": 3}', '{"n":3}'),
        ("not json", "not json"),
        ("a\n\n\n\nb", "a\n\nb"),
    ],
)
def test_message_text(spark, line, expected):
    df = spark.createDataFrame([(line,)], "line string")
    assert df.select(scalars.message_text(F.col("line")).alias("t")).first().t == expected


def fnv(text):
    h = 14695981039346656037
    for b in text.encode():
        h = (h ^ b) * 1099511628211 % 2**64
    return h - 2**64 if h >= 2**63 else h


def test_fnv(spark):
    paths = ["", "/ws/a.md", "/ws/ü/日本.md", "x" * 300]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(scalars.fnv1a64(F.col("p"))).collect()] == [fnv(p) for p in paths]


def test_path_uuid_matches_python(spark, tmp_path):
    from quarry.workspace import workspace_id

    df = spark.createDataFrame([(str(tmp_path),)], "p string")
    assert df.select(scalars.path_uuid(F.col("p"))).first()[0] == str(workspace_id(tmp_path))


def test_markdown_of_very_many_paragraphs(spark):
    """In time proportional to the text; lines that look like numbered ones stay as they are."""
    body = "\n\n".join(f"{i}\x01 line\n{i}\x01" for i in range(200_000))
    rows = chunk.chunk_markdown(spark.createDataFrame([(1, body, "/a.md")], "id long, body string, path string")).collect()
    assert len(rows) == 200_000
    assert all((r.line_start, r.line_end, r.text) == (3 * i, 3 * i + 1, f"{i}\x01 line\n{i}\x01") for i, r in enumerate(rows))
