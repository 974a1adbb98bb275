import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators import chunk, chunkers
from quarry.sources import files, indexer
from quarry.sources.store import Store
from quarry.workspace import Workspace

BODIES = ["First.\n\nSecond.", "A\nB\nC\n\nD", "\n\nActual paragraph.", "", "a\nb\n\n c\n\n\n\nd", "　x \n", "a\r\n\r\nb", " \n\n\n x\n\n\n", None]
LINES = [
    '{"name":"A","mes":"hi"}\n{"name":"B","mes":"yo"}', '{"content":"a"}\n\n{"content":"b"}\n', '{"content":"a"}\n{not json', "", '{"content":"a\\n\\nb"}', '{"content":"a"}\r\n{"content":"b"}\r\n',
    '{"role":"","content":"x"}\n[1,2]\n"text"\n7\n{"b":"2","a":"1"}\n{"n":1}\n{"mes":7,"text":"t"}\n   \n{"content":""}',
]


def rows(df):
    return sorted((r.doc_id, r.line_start, r.line_end, r.text, r.doc_path) for r in df.collect())


def docs(spark, bodies, name):
    return spark.createDataFrame([(i, f"a/{i}{name}", b) for i, b in enumerate(bodies)], "id long, path string, body string")


def test_same_rows_as_in_the_row(spark):
    texts, logs = docs(spark, BODIES, ".md"), docs(spark, LINES, ".JSONL")
    filled = texts.fillna("")
    assert rows(chunkers.chunk_with(texts, chunkers.Chunkers.standard())) == rows(chunk.chunk_markdown(filled))
    assert rows(chunkers.chunk_with(texts, chunkers.Chunkers(default=chunkers.ordinals), check=False)) == rows(chunk.chunk_paragraphs(filled))
    assert rows(chunkers.chunk_with(logs, chunkers.Chunkers.standard())) == rows(chunk.chunk_jsonl(logs))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a#\n \t`", max_size=60))
def test_sections_keep_the_rules(text):
    found = list(chunkers.checked(chunkers.sections("t", text), "t"))
    source = text.split("\n")
    kept = [i for s, e, _ in found for i in range(s, e + 1)]
    assert len(kept) == len(set(kept))
    if text.strip():
        assert {i for i, line in enumerate(source) if line.strip()} <= set(kept)


def test_sections():
    text = "intro\n\n# One\ntext\n\n```\n# no heading\n```\n## Two\n\nend\n"
    assert list(chunkers.sections("t", text)) == [(0, 0, "intro"), (2, 7, "# One\ntext\n```\n# no heading\n```"), (8, 10, "## Two\nend")]
    assert list(chunkers.sections("t", "\n")) == [(0, 0, "t")]


@pytest.mark.parametrize("bad", [[(0, 0, "a"), (0, 0, "b")], [(1, 0, "a")], [(0, 0, "a\n\nb")], [], [(2, 2, "a"), (1, 1, "b")]])
def test_rules_are_checked(spark, bad):
    with pytest.raises(chunkers.ChunkerError):
        list(chunkers.checked(bad, "t"))
    with pytest.raises(Exception, match="ChunkerError"):
        chunkers.chunk_with(docs(spark, ["x"], ".md"), chunkers.Chunkers(default=lambda title, content: bad)).collect()


def test_registered_chunkers_in_a_workspace(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.md").write_text("one\n\ntwo")
    (root / "b.csv").write_text("x,y\n1,2\n3,4")
    (root / "c.bin").write_text("no")

    def table_rows(title, content):
        head, *lines = content.split("\n")
        for i, line in enumerate(lines, 1):
            yield i, i, "; ".join(f"{k}: {v}" for k, v in zip(head.split(","), line.split(","), strict=False))

    own = chunkers.Chunkers().register(table_rows, ".CSV")
    store = Store(spark, str(tmp_path / "store"))
    assert indexer.sync(spark, store, str(root), chunkers=own) == (2, 0)
    assert sorted(r.text for r in store.chunks().collect()) == ["one", "two", "x: 1; y: 2", "x: 3; y: 4"]
    assert {r.path[-5:] for r in files.listing(spark, str(root)).collect()} == {"/a.md"}
    w = Workspace(spark, root, store_path=str(tmp_path / "other"), chunkers=own)
    w.write_file("b.csv", "x,y\n5,6")
    assert [r.text for r in w.store.chunks().collect()] == ["x: 5; y: 6"]
    assert store.check().count() == 0


def test_no_shuffle(spark):
    plan = chunkers.chunk_with(docs(spark, ["x"], ".md"), chunkers.Chunkers.standard())._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" in plan and "Exchange" not in plan
