import time

from repoloom.operators import code_facts as cf
from repoloom.operators.call_graph import java_call_facts

FILES = {
    "a.py": "import os\nfrom a.b import c\n# note\nclass A(B):\n    def f(self, x) -> int:\n        pass\ndef g():\n    pass\n",
    "A.java": "import java.util.List;\npublic class A {\n  public int add(int a, int b) {\n    return foo(x);\n  }\n}\n",
    "a.c": "#include <stdio.h>\nint main(int argc) {\nstatic void * make node(int n) {\n",
    "a.js": "import x from 'm'\nclass A extends B {\n  run(a) {\nconst h = (p) =>\n",
    "a.go": "package main\nimport (\n\"fmt\"\n)\nfunc F(a int) (string) {\nfunc (r *T) M(b int) {\n/* func G() {\n*/\n",
    "a.rs": "use std::io;\nfn f(x: i32) -> i32 {\npub fn g() {\n",
    "b.ts": "async go(a) {\nclass K {\nasync stop(a): void {\nif (x) {\n",
}


def facts(spark, compat=False, files=FILES):
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files.items())], "file_id long, path string, text string")
    return {(r.path, r.line_no): r for r in cf.file_facts(df, compat).collect()}


def test_facts(spark):
    f = facts(spark)
    assert (f[("a.py", 1)].module, f[("a.py", 2)].module, f[("a.py", 2)].import_path) == ("os", "a.b", "c")
    assert f[("a.py", 4)].inheritance == "B" and ("a.py", 3) not in f
    for line, name in ((5, "f"), (7, "g")):
        assert (f[("a.py", line)].kind, f[("a.py", line)].class_name, f[("a.py", line)].name) == ("method", "A", name)
    assert f[("a.py", 5)].signature == "f(self, x) -> int"
    add = f[("A.java", 3)]
    assert (add.kind, add.modifiers, add.return_type, add.params) == ("method", "public", "int", "int a, int b")
    assert ("A.java", 4) not in f
    assert f[("a.c", 1)].module == "stdio.h" and f[("a.c", 2)].kind == "function"
    assert (f[("a.c", 3)].name, f[("a.c", 3)].return_type) == ("node", "static void * make")
    assert (f[("a.js", 1)].module, f[("a.js", 1)].import_path) == ("m", "x")
    assert f[("a.js", 3)].kind == "method" and f[("a.js", 4)].kind == "function" and f[("a.js", 4)].class_name is None
    assert f[("a.rs", 2)].return_type.strip() == "i32" and ("a.rs", 3) not in f


def test_go(spark):
    f = facts(spark)
    assert f[("a.go", 3)].import_path == "fmt"
    assert f[("a.go", 5)].signature == "func F(a int) -> (string)"
    assert (f[("a.go", 6)].receiver, f[("a.go", 6)].signature) == ("r *T", "func (r *T) M(b int)")
    assert ("a.go", 7) not in f and f[("a.go", 1)].kind == "package"


def test_typescript_method_needs_a_class(spark):
    f = facts(spark)
    assert ("b.ts", 1) not in f and f[("b.ts", 3)].kind == "method" and ("b.ts", 4) not in f
    assert facts(spark, compat=True)[("b.ts", 4)].name == "if"


def test_compat_keeps_statements(spark):
    assert facts(spark, compat=True)[("A.java", 4)].name == "foo"


def test_long_c_line_is_fast(spark):
    start = time.time()
    facts(spark, files={"x.c": " ".join(["word"] * 20000) + " f(int a"})
    assert time.time() - start < 30


def test_dependencies(spark):
    df = spark.createDataFrame([(1, "a.py", FILES["a.py"])], "file_id long, path string, text string")
    f = cf.file_facts(df)
    assert cf.dependencies(f).first().dependencies == ["a.b", "os"]
    assert cf.dependencies(f, compat=True).first().dependencies == ["c", "os"]


def test_long_runs_do_not_exhaust_the_stack(spark):
    blanks = " " * 50_000
    f = facts(spark, files={"L.java": f"public{blanks}static int add(int a) {{", "L.cs": f"public{blanks}int add(int a) {{"})
    assert (f[("L.java", 1)].name, f[("L.java", 1)].return_type) == ("add", "int")
    assert f[("L.cs", 1)].name == "add"


def test_java_annotations_and_characters(spark):
    text = """package p.q;
@Named("x") class A {
  void f(@Named("y(") String s, @Other final int n) { g(); }
  @Test(a = @Inner(1)) void h() { char c = '"'; k(); String z = "q"; char d = '\\''; m(); }
}"""
    df = spark.createDataFrame([(1, "A.java", text)], "file_no int, path string, text string")
    rows = [(r.kind, r.name, r.param_types) for r in java_call_facts(df).orderBy("pos").collect()]
    assert rows == [("decl", "f", ["String", "int"]), ("call", "g", []), ("decl", "h", []), ("call", "k", []), ("call", "m", [])]


def test_first_class_with_package(spark):
    df = spark.createDataFrame(
        [(1, "A.java", "package a.b;\nclass A {\nclass B {"), (2, "C.java", "class C {")], "file_id int, path string, text string"
    )
    lines = cf.code_lines(df)
    got = {tuple(r) for r in cf.first_classes(cf.line_facts(lines, languages=["java"]), lines).collect()}
    assert got == {(1, "A", "a.b"), (2, "C", "default")}


def test_go_counts_like_the_other_languages(spark):
    text = 'package main\nimport "fmt"\nimport (\n"os"\n)\nfunc F(a int) (string) {\nfunc (r *T) M(b int) {'
    facts = cf.file_facts(spark.createDataFrame([(1, "m.go", text), (2, "m.py", "import os")], "file_id int, path string, text string"))
    got = {tuple(r) for r in cf.file_statistics(facts).collect()}
    assert got == {(1, 2, 0, 1, 1), (2, 1, 0, 0, 0)}
    deps = {r.file_id: r.dependencies for r in cf.dependencies(facts).collect()}
    assert deps == {1: ["fmt", "os"], 2: ["os"]}
