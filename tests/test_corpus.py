import os

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repoloom.operators import chunking, filters, rollups
from repoloom.operators.code_facts import project_totals
from repoloom.sources import files as src

TREE = {
    "src/main.py": b"import os\n",
    "src/test_util.py": b"x = 1\n",
    "venv/x.py": b"",
    ".venv/y.py": b"",
    "docs/guide.md": b"# g",
    "app.min.js": b"a()",
    "conf/a.json": b"{}",
    "README.md": b"hello",
    "pkg/__init__.py": b"p = 1\n",
    "_private/_mod.py": b"m = 1\n",
    "bad.py": b"\xff\xfe\x00",
    "yarn.lock": b"",
    "Main.java": b"class Main {}",
    "Upper.PY": b"u",
}


def make_tree(root):
    for path, data in TREE.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(data)


def test_read_repositories(spark, tmp_path):
    make_tree(str(tmp_path))
    rows = {r.path: r for r in src.read_repositories(spark, {"demo": str(tmp_path)}).collect()}
    # Underscore names are present, excluded folders and minified files are not, each file comes once.
    assert sorted(rows) == [
        "Main.java", "README.md", "_private/_mod.py", "bad.py", "conf/a.json", "pkg/__init__.py", "src/main.py", "src/test_util.py",
    ]
    assert rows["bad.py"].text is None and rows["bad.py"].error == "invalid utf-8"
    assert rows["src/main.py"].text == "import os\n" and rows["src/main.py"].is_implementation
    assert not rows["src/test_util.py"].is_implementation
    assert rows["README.md"].is_code is False and rows["README.md"].type == "md"


def test_read_repositories_compat_keeps_minified(spark, tmp_path):
    make_tree(str(tmp_path))
    paths = {r.path for r in src.read_repositories(spark, {"demo": str(tmp_path)}, compat=True).select("path").collect()}
    assert "app.min.js" in paths and "venv/x.py" not in paths


def test_inclusion_switches_exclusions_off(spark, tmp_path):
    make_tree(str(tmp_path))
    got = src.read_repositories(spark, {"demo": str(tmp_path)}, included_dirs=["venv/"], included_files=["lock", "Main.java"])
    assert {r.path for r in got.select("path").collect()} == {"venv/x.py", "Main.java"}


def test_project_files_enter_every_directory(spark, tmp_path):
    make_tree(str(tmp_path))
    got = {r.path for r in src.project_files(spark, {"demo": str(tmp_path)}).select("path").collect()}
    assert {".venv/y.py", "venv/x.py", "Upper.PY", "app.min.js", "Main.java"} <= got and "README.md" not in got
    assert [r.path for r in src.java_files(spark, {"demo": str(tmp_path)}).select("path").collect()] == ["Main.java"]


def test_missing_file_gives_error_row(spark, tmp_path):
    paths = spark.createDataFrame([("file://" + str(tmp_path), "gone.py")], "root string, path string")
    row = src.read_bytes(paths).first()
    assert row.content is None and row.read_error == "FileNotFoundError"


def test_tree_and_readme(spark):
    df = spark.createDataFrame(
        [("r", "b/readme.MD", "deep"), ("r", "README.md", "top"), ("r", "a.py", ""), ("r", ".git/x", ""), ("r", "p/__init__.py", "")],
        "repo string, path string, text string",
    )
    row = rollups.repository_tree(df).first()
    assert row.file_tree == "README.md\na.py\nb/readme.MD" and row.readme == "top"
    parts = rollups.tree_parts(df, part_rows=2).orderBy("part_no").collect()
    assert "\n".join(p.file_tree for p in parts).split("\n") == sorted(r.path for r in df.collect())


def test_project_totals(spark):
    df = spark.createDataFrame([("r", None), ("r", "bad"), ("s", None)], "repo string, error string")
    assert {tuple(r) for r in project_totals(df).collect()} == {("r", 2, 1), ("s", 1, 1)}


def test_clean_dir_modes():
    assert filters.clean_dir("./.venv/") == ".venv" and filters.clean_dir("./.venv/", compat=True) == "venv"


def test_word_chunks_cover_and_overlap(spark):
    texts = [" ".join(str(i) for i in range(n)) for n in (0, 1, 999, 1000, 1001, 1700, 1701, 5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    chunks = {}
    for r in chunking.word_chunks(df).orderBy("id", "chunk_no").collect():
        chunks.setdefault(r.id, []).append(r.text.split(" "))
    for i, t in enumerate(texts):
        words, got = t.split(" "), chunks[i]
        n = len(words)
        assert len(got) == (1 if n <= 1000 else -(-(n - 1000) // 700) + 1)
        assert got[0] + [w for c in got[1:] for w in c[300:]] == words
        assert all(a[-300:] == b[:300] for a, b in zip(got, got[1:]))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400))
def test_character_split_properties(text):
    chunks = chunking.split_characters(text, size=40, overlap=10)
    assert all(0 < len(c) <= 40 for c in chunks)
    assert set("".join(chunks)) - {" ", "\n"} == set(text) - {" ", "\n"}
    assert sum(c.count("a") for c in chunks) >= text.count("a")


def test_character_split_examples(spark):
    text = "aaa\n\nbbb ccc\n\n" + "d" * 25
    want = ["aaa", "bbb ccc", "d" * 9, "d" * 10, "d" * 10, "d" * 5]
    assert chunking.split_characters(text, 10, 3) == want
    df = spark.createDataFrame([(1, "x y")], "id int, text string")
    assert [(r.chunk_no, r.text) for r in chunking.character_chunks(df).collect()] == [(0, "x y")]


def test_token_counter(spark):
    count = chunking.token_counter(lambda t: list(t))
    df = spark.createDataFrame([("abc",), (None,)], "t string")
    assert [r.n for r in df.select(count(F.col("t")).alias("n")).collect()] == [3, 0]
