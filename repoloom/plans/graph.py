"""Call-graph queries over call facts, and path queries over key relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from repoloom.operators import call_graph as cg
from repoloom.operators.java_facts import scanned_call_facts
from repoloom.operators.ordered import fill_forward
from repoloom.plans.catalog import register
from repoloom.plans.views import CALLS_SQL, CODE_SQL, CODE_TEMPLATE_SQL, TEMPLATES, call_facts, code_files, resolved_sql, table


def _calls(spark, sf_dir):
    return cg.resolved_calls(call_facts(spark, sf_dir))


@register("e2_caller_attribution", f"WITH {CALLS_SQL} SELECT file_no, pos, caller FROM calls0 WHERE kind = 'call' AND caller IS NOT NULL")
def caller_attribution(spark, sf_dir):
    label = F.concat("class", F.lit("."), "name", F.lit("("), F.array_join("param_types", ", "), F.lit(")"))
    rows = call_facts(spark, sf_dir).select("file_no", "pos", "kind", F.when(F.col("kind") == "decl", label).alias("decl"))
    filled = fill_forward(rows, ["file_no"], ["pos"], F.col("decl"), "caller")
    return filled.filter("kind = 'call' AND caller IS NOT NULL").select("file_no", "pos", "caller")


@register("c9_j1_resolved_calls", f"WITH {CALLS_SQL} SELECT file_no, pos, caller, callee, callee_kind FROM calls")
def resolved_calls(spark, sf_dir):
    return _calls(spark, sf_dir)


@register("g4_call_edges", f"WITH {CALLS_SQL} SELECT src, dst FROM edges")
def call_edges(spark, sf_dir):
    return cg.call_edges(_calls(spark, sf_dir))


@register("j2_call_nodes", f"WITH {CALLS_SQL} SELECT id, file_path, class_name, method_name, parameters FROM nodes")
def call_nodes(spark, sf_dir):
    facts = call_facts(spark, sf_dir)
    return cg.call_nodes(facts, cg.resolved_calls(facts)).withColumn("parameters", F.array_join("parameters", ", "))


_ASKED_SQL = "asked AS (SELECT DISTINCT 'C' || (o_orderkey % 40) || '.m' || (o_custkey % 25) || '(int)' AS method FROM orders)"


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.concat(
            F.lit("C"), (F.col("o_orderkey") % 40).cast("string"), F.lit(".m"), (F.col("o_custkey") % 25).cast("string"), F.lit("(int)")
        ).alias("method")
    ).distinct()


@register(
    "j3_callers",
    f"WITH {CALLS_SQL}, {_ASKED_SQL} SELECT dst AS method, src AS caller FROM edges WHERE dst IN (SELECT method FROM asked)",
)
def callers(spark, sf_dir):
    return cg.callers_of(cg.call_edges(_calls(spark, sf_dir)), _asked(spark, sf_dir))


@register(
    "j4_callees",
    f"WITH {CALLS_SQL}, {_ASKED_SQL} SELECT src AS method, dst AS callee FROM edges WHERE src IN (SELECT method FROM asked)",
)
def callees(spark, sf_dir):
    return cg.callees_of(cg.call_edges(_calls(spark, sf_dir)), _asked(spark, sf_dir))


@register(
    "j8_in_house_edges",
    f"""WITH {CALLS_SQL}, own AS (SELECT id FROM nodes WHERE class_name IS NOT NULL)
    SELECT src, dst FROM edges WHERE src IN (SELECT id FROM own) AND dst IN (SELECT id FROM own)""",
)
def in_house(spark, sf_dir):
    nodes, edges = cg.build_graph(call_facts(spark, sf_dir))
    return cg.in_house(edges, nodes)


@register(
    "d7_nodes_by_file",
    f"""WITH {CALLS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY id) - 1 AS r FROM nodes)
    SELECT file_path, r // 50 AS part_no, string_agg(id, '|' ORDER BY id) AS ids FROM n GROUP BY 1, 2""",
)
def nodes_by_file(spark, sf_dir):
    facts = call_facts(spark, sf_dir)
    return cg.node_parts(cg.call_nodes(facts, cg.resolved_calls(facts)), 50)


@register(
    "j6_call_chain_record",
    f"""WITH {CALLS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY id) - 1 AS r FROM nodes),
    e AS (SELECT src || ' -> ' || dst AS e, row_number() OVER (ORDER BY src || ' -> ' || dst) - 1 AS r FROM edges)
    SELECT 'nodes' AS section, file_path AS key, r // 500 AS part_no, string_agg(id, '|' ORDER BY id) AS items FROM n GROUP BY 2, 3
    UNION ALL SELECT 'edges', '', r // 500, string_agg(e, '|' ORDER BY e) FROM e GROUP BY r // 500""",
)
def call_chain_record(spark, sf_dir):
    nodes, edges = cg.build_graph(call_facts(spark, sf_dir))
    return cg.chain_record(nodes, edges, 500)


# Regions own nations, nations own suppliers and customers, and each nation points to another one.
_GEO_SQL = """geo AS (
  SELECT DISTINCT * FROM (
    SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
    UNION ALL SELECT 'n' || n_nationkey, 'n' || ((n_nationkey * 7 + 3) % 25) FROM nation
    UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
    UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)),
pairs AS (
  SELECT 'r' || n_regionkey AS start, 'c' || c_custkey AS end FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"""


def _geo(spark, sf_dir):
    def name(prefix: str, c):
        return F.concat(F.lit(prefix), (F.col(c) if isinstance(c, str) else c).cast("string"))

    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    parts = [
        nation.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst")),
        nation.select(name("n", "n_nationkey").alias("src"), name("n", (F.col("n_nationkey") * 7 + 3) % 25).alias("dst")),
        customer.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")),
        supplier.select(name("n", "s_nationkey").alias("src"), name("s", "s_suppkey").alias("dst")),
    ]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    pairs = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        name("r", "n_regionkey").alias("start"), name("c", "c_custkey").alias("end")
    ).unionByName(supplier.select(name("n", "s_nationkey").alias("start"), name("s", "s_suppkey").alias("end")))
    return edges, pairs


@register(
    "j5_simple_paths",
    f"""WITH RECURSIVE {_GEO_SQL}, walk AS (
      SELECT start, "end", start AS node, [start] AS path FROM pairs
      UNION ALL SELECT w.start, w."end", g.dst, list_append(w.path, g.dst) FROM walk w JOIN geo g ON g.src = w.node
      WHERE w.node <> w."end" AND len(w.path) <= 3 AND NOT list_contains(w.path, g.dst))
    SELECT start, "end", array_to_string(path, '|') AS path, (len(path) - 1)::BIGINT AS edges FROM walk WHERE node = "end" AND len(path) > 1""",
)
def simple_paths(spark, sf_dir):
    edges, pairs = _geo(spark, sf_dir)
    return cg.simple_paths(edges, pairs, max_depth=3)


@register("u5_java_call_facts")
def java_call_facts(spark, sf_dir):
    """Facts of the derived Java files by pattern; exact cases are unit tests."""
    java = code_files(spark, sf_dir).filter(F.col("path").endswith(".java"))
    return cg.java_call_facts(java.withColumnRenamed("file_id", "file_no"))


# Template lines of Java, from 0: 0 a package, 3 and 10 classes, 4 and 7 declarations, 5 and 11 calls.
_JAVA_SQL = f"""{CODE_SQL.split("code_lines AS (")[0]}java AS (
  SELECT file_id, i, (i - 1) % {len(TEMPLATES["java"])} AS t, {CODE_TEMPLATE_SQL} AS line, repo || '/java/' || file_id || ext AS file_path FROM raw_lines WHERE lang = 'java'),
owned AS (SELECT *, max(CASE WHEN t IN (3, 10) THEN i END) OVER (PARTITION BY file_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS class_at,
    min(CASE WHEN t = 0 THEN i END) OVER (PARTITION BY file_id) AS package_at,
    CASE WHEN t IN (3, 10) THEN regexp_extract(line, 'class (\\w+)', 1) END AS class_name FROM java),
facts AS (
  SELECT f.file_id AS file_no, row_number() OVER (PARTITION BY f.file_id ORDER BY f.i) - 1 AS pos, CASE WHEN f.t IN (4, 7) THEN 'decl' ELSE 'call' END AS kind, f.file_path,
    regexp_extract(p.line, 'package ([\\w.]+);', 1) AS package, c.class_name AS class,
    CASE f.t WHEN 5 THEN regexp_extract(f.line, 'return (\\w+)', 1) WHEN 11 THEN regexp_extract(f.line, '[.](\\w+)', 1) ELSE regexp_extract(f.line, ' (\\w+)[(]', 1) END AS name,
    CASE WHEN f.t = 11 THEN regexp_extract(f.line, '(\\w+)[.]', 1) END AS qualifier,
    CASE f.t WHEN 4 THEN 'int, ' || regexp_extract(f.line, ', (\\w+) b', 1) WHEN 7 THEN 'String' ELSE '' END AS params
  FROM owned f JOIN owned c ON c.file_id = f.file_id AND c.i = f.class_at JOIN owned p ON p.file_id = f.file_id AND p.i = f.package_at WHERE f.t IN (4, 5, 7, 11))"""


def _scanned(spark, sf_dir, compat: bool = False):
    java = code_files(spark, sf_dir).filter(F.col("path").endswith(".java"))
    return scanned_call_facts(java.withColumnRenamed("file_id", "file_no"), compat)


@register(
    "u5_scanned_call_facts",
    f"WITH {_JAVA_SQL} SELECT file_no, pos, kind, file_path, package, class, name, qualifier, replace(params, ', ', '|') AS param_types FROM facts",
)
def scanned_facts(spark, sf_dir):
    """Facts of the derived Java files by the scanner; their classes are never closed, so each class is inside the one before."""
    return _scanned(spark, sf_dir)


@register(
    "u5_scanned_call_facts_compat",
    f"""WITH {_JAVA_SQL} SELECT file_no, pos, kind, file_path, package, first_value(class) OVER (PARTITION BY file_no ORDER BY pos) AS class, name, qualifier,
    replace(params, ', ', '|') AS param_types FROM facts""",
)
def scanned_facts_compat(spark, sf_dir):
    return _scanned(spark, sf_dir, compat=True)


@register("j1_scanned_calls", f"WITH {_JAVA_SQL}, {resolved_sql()} SELECT file_no, pos, caller, callee, callee_kind FROM calls")
def scanned_calls(spark, sf_dir):
    """Calls of the derived Java files, from source to callee."""
    return cg.resolved_calls(_scanned(spark, sf_dir))
