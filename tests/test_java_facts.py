"""The Java scanner: expected facts of ordinary and broken sources, and its time."""

import time

import pytest

from repoloom.operators import call_graph as cg
from repoloom.operators.java_facts import scan, scanned_call_facts

SHOP = r'''
package p.q; // package x.y;
import java.util.*;
/** class Fake { void no() { x(); } } */
@Service(value = "a", run = @Run(call()))
public class Shop<T extends Comparable<T>> extends Base<T> implements A, B {
  private int count = init(1);
  static final Map<String, List<Integer>> M = new HashMap<>() {{ put("a(", list()); }};
  public Shop(int a) throws IOException { this(a, 0); setup(); }
  public <R> List<R> list(final Map<String, Integer> m, @Nullable java.util.Set<? super T> s, int[] a, String... more) throws IOException {
    String t = "fake(1)", u = """
       text block " call(2) """;
    char c = '\'', d = '(';
    if (check(t) && a.length > size()) { return this.load(t); }
    a.b.svc.run(new Item(1), other(x -> { deep(x); return y(); }));
    stream
      .filter(Objects::nonNull)
      .map(v -> v.name())
      .collect(toList());
    new Thread(new Runnable() { @Override public void run() { tick(); super.run(); } }).start();
    Foo.<String>make(1).then();
    outer.new Inner(3);
    for (int i = 0; i < n; i++) call(i);
    Shop.this.load(t); this.f.go(); arr[0].hit();
    boolean b = (x < y) || (z > limit(3));
    switch (kind()) { case A -> go(); default -> { stop(); } }
    return helper.go();
  }
  abstract void later(int x);
  int old()[] { return null; }
  void load(String t) { list(null, null, null); }
  enum Color { RED(rgb(1)) { int v() { return one(); } }, BLUE(2); Color(int x) { set(x); } int v() { return 0; } }
  interface Shape { double area(); default void p() { draw(); } }
  @interface Mark { int level() default 3; String[] names() default {}; }
  record Point(int x, int y) implements Z { Point { valid(x); } int sum() { return x() + y(); } }
  static class Nested { class Deep { void d() { e(); } } void after() {} }
}
class Second { void other() { x(); } }
'''

# d: declaration (owner, name, parameters); c: call (owner, name, qualifier).
EXPECTED = """
c Shop init -|c Shop put -|c Shop list -|c Shop setup -|d Shop list Map,Set,int,String|c Shop check -|c Shop size -|c Shop load -|c Shop run a.b.svc|c Shop other -
c Shop deep -|c Shop y -|c Shop filter stream|c Shop map -|c Shop name v|c Shop collect -|c Shop toList -|d Shop run|c Shop tick -|c Shop start -|c Shop make Foo|c Shop then -
c Shop call -|c Shop load -|c Shop go -|c Shop hit -|c Shop limit -|c Shop kind -|c Shop go -|c Shop stop -|c Shop go helper|d Shop later int|d Shop old|d Shop load String|c Shop list -
c Color rgb -|d Color v|c Color one -|c Color set -|d Color v|d Shape area|d Shape p|c Shape draw -|c Point valid -|d Point sum|c Point x -|c Point y -
d Deep d|c Deep e -|d Nested after|d Second other|c Second x -
"""


def told(facts):
    return [f"d {f.owner} {f.name} {','.join(f.params)}".strip() if f.kind == "decl" else f"c {f.owner} {f.name} {f.qualifier or '-'}" for f in facts]


def test_facts_of_a_whole_source():
    package, first, facts = scan(SHOP)
    assert (package, first) == ("p.q", "Shop")
    assert told(facts) == EXPECTED.strip().replace("\n", "|").split("|")


@pytest.mark.parametrize(
    ("code", "facts"),
    [
        ("", []),
        ("interface X { void f(int... a); }", ["d X f int"]),
        ("class A { void f( { g(; } } } ) void h() {} ", ["c A f -", "c A g -"]),
        ("'l'an (d'une) \"abc (x) \n class B { void m() { n(); } }", ["d B m", "c B n -"]),
        ("class A { void f() { /* } } g(); ", ["d A f"]),
        ("class A { void f() { g(h(), \"\\\"x(\", '\\u0041', 'ab', new int[] {k()}); } }", ["d A f", "c A g -", "c A h -", "c A k -"]),
        ("class A { Runnable r = () -> { go(); }; B b = new B<C>() { void z() {} }; void after() {} }", ["c A go -", "d A z", "d A after"]),
        ("class A { @X(y = z()) @W void f(@P(q()) final java.util.Map<K, List<V>>[] m, A this) {} }", ["d A f Map"]),
        ("class Größe { int größe(Größe é) { return this.größe(é); } }", ["d Größe größe Größe", "c Größe größe -"]),
        ("class A { void f() { if (a < b && c > g(1)) {} int x = a < b ? h() : i(); class L { void m() {} } n(); } }", ["d A f", "c A g -", "c A h -", "c A i -", "d L m", "c A n -"]),
        ("}}}} ) ) class A { void f() { g(); } }", ["d A f", "c A g -"]),
    ],
)
def test_facts_of_small_sources(code, facts):
    assert told(f for f in scan(code)[2] if f.owner) == facts


def test_time_in_proportion_to_the_source():
    def seconds(n):
        start = time.perf_counter()
        scan("class A { void f() { " + "a.b(c(d<e>(x)));\n" * n + "g(" * n + "}}")
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40_000) < 30 * seconds(4000) + 1


def test_rows_and_resolved_calls(spark):
    files = [(1, "Shop.java", SHOP), (2, "X.java", "package z; interface X { void f(); }"), (3, "N.java", None), (4, "E.java", ""), (5, None, "class A { void f() { f(); g(); } }")]
    df = spark.createDataFrame(files, "file_no long, path string, text string")
    rows = scanned_call_facts(df).orderBy("file_no", "pos").collect()
    assert {(r.file_no, r.package) for r in rows} == {(1, "p.q"), (2, "z"), (5, "default")}
    first = scanned_call_facts(df, compat=True).collect()
    assert {(r.file_no, r["class"]) for r in first} == {(1, "Shop"), (5, "A")}
    calls = {(r.file_no, r.caller, r.callee) for r in cg.resolved_calls(scanned_call_facts(df)).collect()}
    assert {(5, "A.f()", "A.f()"), (5, "A.f()", "unknown.g()"), (1, "Deep.d()", "unknown.e()"), (1, "Shop.load(String)", "Shop.list(Map, Set, int, String)")} <= calls
    assert scanned_call_facts(df.filter("false")).count() == 0
