from repoloom.operators import call_graph as cg

FACTS = [
    (1, 1, "call", "A.java", None, "A", "early", None, []),
    (1, 2, "decl", "A.java", None, "A", "f", None, ["int"]),
    (1, 3, "call", "A.java", None, "A", "g", None, []),
    (1, 4, "call", "A.java", None, "A", "run", "x.svc", []),
    (1, 5, "decl", "A.java", None, "A", "g", None, []),
    (1, 6, "call", "A.java", None, "A", "f", None, []),
]
SCHEMA = (
    "file_no long, pos long, kind string, file_path string, package string, class string, name string, qualifier string, "
    "param_types array<string>"
)


def test_edges_and_nodes(spark):
    for hot_rows in (0, 10**6):
        nodes, edges = cg.build_graph(spark.createDataFrame(FACTS, SCHEMA), hot_rows)
        assert {tuple(r) for r in edges.collect()} == {
            ("A.f(int)", "unknown.g()"), ("A.f(int)", "svc.run()"), ("A.g()", "A.f(int)"),
        }
        assert {r.id: r.file_path for r in nodes.collect()} == {
            "A.f(int)": "A.java", "A.g()": "A.java", "svc.run()": "external", "unknown.g()": "unknown",
        }
        assert {tuple(r) for r in cg.in_house(edges, nodes).collect()} == {("A.g()", "A.f(int)")}


def edges_of(spark, text):
    return spark.createDataFrame([tuple(e) for e in text.split()], "src string, dst string")


def test_simple_paths(spark):
    edges = edges_of(spark, "ab bc ac ca cd")
    pairs = spark.createDataFrame([("a", "d"), ("d", "a"), ("a", "zz")], "start string, end string")
    got = {"".join(r.path) for r in cg.simple_paths(edges, pairs, 3).collect()}
    assert got == {"acd", "abcd"}
    assert {"".join(r.path) for r in cg.simple_paths(edges, pairs, 2).collect()} == {"acd"}


def test_simple_paths_against_brute_force(spark):
    import itertools
    import random

    rnd = random.Random(5)
    nodes = "abcdefg"
    es = {(x, y) for x in nodes for y in nodes if x != y and rnd.random() < 0.35}
    pairs = [(x, y) for x in nodes for y in nodes if x != y]
    want = set()
    for n in range(2, 6):
        for p in itertools.permutations(nodes, n):
            if all(e in es for e in zip(p, p[1:])):
                want.add("".join(p))
    got = cg.simple_paths(
        spark.createDataFrame(sorted(es), "src string, dst string"), spark.createDataFrame(pairs, "start string, end string"), 4
    ).collect()
    assert sorted("".join(r.path) for r in got) == sorted(want)


def test_callers_and_callees(spark):
    edges = edges_of(spark, "ab bc ac ca cd")
    asked = spark.createDataFrame([("c",), ("none",)], "method string")
    assert {r.caller for r in cg.callers_of(edges, asked).collect()} == {"a", "b"}
    assert {r.callee for r in cg.callees_of(edges, asked).collect()} == {"a", "d"}


JAVA = '''
package p.q;
// void no() { x(); }
public class Shop {
  private int count = init();
  /* skip(); */
  public List<String> list(final Map<String, Integer> m, java.util.Set s, int[] a) throws IOException {
    String t = "fake(1)";
    if (check(t)) { return this.load(t); }
    a.b.svc.run(new Item(1));
    return helper.go();
  }
  abstract void later(int x);
  void load(String t) { list(null, null, null); }
}
class Second { void other() { x(); } }
'''


def test_java_facts_by_pattern(spark):
    df = spark.createDataFrame([(1, "Shop.java", JAVA), (2, "E.java", "interface X {}")], "file_no long, path string, text string")
    rows = cg.java_call_facts(df).orderBy("pos").collect()
    assert all((r["class"], r.package) == ("Shop", "p.q") for r in rows)
    got = [(r.kind, r.qualifier, r.name, list(r.param_types)) for r in rows]
    assert got == [
        ("call", None, "init", []),
        ("decl", None, "list", ["Map", "Set", "int"]),
        ("call", None, "check", []),
        ("call", None, "load", []),
        ("call", "a.b.svc", "run", []),
        ("call", "helper", "go", []),
        ("decl", None, "later", ["int"]),
        ("decl", None, "load", ["String"]),
        ("call", None, "list", []),
        ("decl", None, "other", []),
        ("call", None, "x", []),
    ]


def test_chain_record_parts(spark):
    nodes, edges = cg.build_graph(spark.createDataFrame(FACTS, SCHEMA))
    rows = cg.chain_record(nodes, edges, part_rows=2).collect()
    assert sorted(x for r in rows if r.section == "edges" for x in r["items"]) == sorted(
        ["A.f(int) -> svc.run()", "A.f(int) -> unknown.g()", "A.g() -> A.f(int)"]
    )
    assert max(len(r["items"]) for r in rows) == 2


def test_java_facts_with_long_literals(spark):
    code = 'class A { void f() { g("' + "x\\\"" * 20_000 + '"); } }'
    df = spark.createDataFrame([(1, "A.java", code)], "file_no long, path string, text string")
    assert [(r.kind, r.name) for r in cg.java_call_facts(df).orderBy("pos").collect()] == [("decl", "f"), ("call", "g")]
