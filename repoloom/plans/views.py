"""Domain tables derived from the driver tables, each with the same definition in SQL.

The driver tables hold prose, pages, chats and a star schema, not repositories; these
views turn them into files, code, call facts and wikis, row for row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.functions import fixed
from repoloom.functions.literals import literal_list, literal_map
from repoloom.operators.columns import spread_small


TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; text tables that come as few splits are spread over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_small(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_text(value: str) -> str:
    """A SQL literal for DuckDB, with newlines as chr(10)."""
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def pick(values: list[str], index: Column) -> Column:
    return F.try_element_at(literal_list(values), (index % len(values) + 1).cast("int"))


def sql_pick(values: list[str], index: str) -> str:
    return f"{sql_list(values)}[({index}) % {len(values)} + 1]"


# ---------------------------------------------------------------- files

DIRS = [
    "src", "lib/core", "docs", ".venv/lib", "venv", "src/test", "node_modules/x", "build", ".github", "pkg/api", "app",
]
PREFIXES = ["file_", "test_", "app_", "main_", ".hidden_", "util_", "Test"]
EXTS = fixed.CODE_EXTENSIONS + fixed.DOC_EXTENSIONS + [".min.js", ".PY", ".bin"]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: file_no, repo, path, text, lang."""
    d = F.col("doc_id")
    s = d.cast("string")
    name = (
        F.when(d % 37 == 5, F.concat(F.lit("d"), s, F.lit("/README.md")))
        .when(d % 41 == 3, F.concat(F.lit("n"), s, F.lit("/yarn.lock")))
        .when(d % 43 == 4, F.concat(F.lit("p"), s, F.lit("/__init__.py")))
        .otherwise(F.concat(pick(PREFIXES, d), s, pick(EXTS, d)))
    )
    return table(spark, sf_dir, "documents").select(
        d.alias("file_no"),
        F.col("source").alias("repo"),
        F.concat_ws("/", pick(DIRS, d), F.col("lang"), name).alias("path"),
        "text",
        "lang",
    )


FILES_SQL = f"""files AS (
  SELECT doc_id AS file_no, source AS repo, lang, text,
    {sql_pick(DIRS, 'doc_id')} || '/' || lang || '/' ||
    CASE WHEN doc_id % 37 = 5 THEN 'd' || doc_id || '/README.md'
         WHEN doc_id % 41 = 3 THEN 'n' || doc_id || '/yarn.lock'
         WHEN doc_id % 43 = 4 THEN 'p' || doc_id || '/__init__.py'
         ELSE {sql_pick(PREFIXES, 'doc_id')} || doc_id || {sql_pick(EXTS, 'doc_id')} END AS path
  FROM documents)"""

# Name and extension of a path in SQL.
NAME_SQL = "regexp_extract(path, '([^/]*)$', 1)"
EXT_SQL = f"regexp_extract({NAME_SQL}, '^[.]*[^.].*?([.][^.]*)$', 1)"


def sql_in(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


# ---------------------------------------------------------------- code

CODE_EXT = {
    "python": ".py", "java": ".java", "c_cpp": ".cpp", "javascript": ".js", "typescript": ".ts",
    "go": ".go", "rust": ".rs", "php": ".php", "swift": ".swift", "csharp": ".cs",
}
CODE_LANGS = list(CODE_EXT)
TEMPLATES = {
    "python": [
        "import W1", "from W1.W2 import W2", "# W1", "class W1(W2):", "    def W1(self, W2) -> int:", "W1 = W2(1)",
        "", "def W2(W1):", "class W2:", "    def get_W1(self):", "return W1", "def W1(W2) -> List[W1]:",
    ],
    "java": [
        "package W1.W2;", "import java.util.W1;", "// W1", "public class W1 {", "public static int add_W2(int a, W1 b) {",
        "return W1(x);", "* W2", "private List<W2> run_W1(String[] s) {", "if (W1) {", "import static W1.*;",
        "abstract class W2 {", "W1.W2(x);",
    ],
    "c_cpp": [
        "#include <W1.h>", '#include "W2.h"', "/* W1 */", "struct W1 {", "int W2(int a) {", "static void * make_W1(W2 n) {",
        "return W1(W2);", "class W2 : public W1 {", "else if (W1) {", "W1(W2);", "", "unsigned long W1 (void) {",
    ],
    "javascript": [
        "import W1 from 'W2'", "import 'W1'", "// W1", "class W1 extends W2 {", "run_W1(a) {", "const W2 = (p) =>",
        "const W1 = require('W2')", "function toW1(x) {", "if (W1) {", "W1(W2);", "getW2(a, b) {", "class W2 {",
    ],
    "typescript": [
        "import { W1 } from 'W2'", "run_W2(a: W1): void {", "public W2(a: W1): number {", "class W1 {",
        "const W1 = (p: W2): W1 =>", "let W1 = require('W2')", "function W2(x) {", "else if (W1) {", "// W2",
        "async getW1() {", "interface W1 {", "class W2 extends W1 {",
    ],
    "go": [
        "package W1", "import (", '"W1"', 'W2 "x/W2"', ")", "/* W1", "func W1() {", "*/",
        "func W1(a int) (string, error) {", "func (r *W1) W2(b int) {", 'import "W2"', "// W1",
    ],
    "rust": [
        "use std::W1;", "mod W1 {", "fn W1(x: i32) -> W2 {", "pub fn W2() {", "fn W2() {", "// W1", "struct W1 {", "",
        "use W1::{W2};", "fn x_W1(a: W2, b: W1) {", "impl W1 {", "let W1 = W2(1);",
    ],
    "php": [
        "namespace W1;", "use W1;", "class W1 extends W2 {", "function W1($a) {", "function W2($a): W1 {", "// W1",
        "$W1 = W2();", "class W2 implements W1 {", "use W1 as W2;", "function get_W2() {", "", "* W1",
    ],
    "swift": [
        "import W1", "class W1: W2 {", "func W1(a: Int) -> W2 {", "func W2() {", "// W2", "class W2 {", "let W1 = 2",
        "func x_W1(b: W2) {", "import W1.W2", "}", "W1(W2)", "func y_W2(c: W1) -> [W1] {",
    ],
    "csharp": [
        "using W1.W2;", "namespace W1 {", "public class W1 {", "public static int W2(int a) {", "W1 W2(string b) {",
        "// W1", "return W1(W2);", "sealed class W2 {", "using W1;", "protected override List<W1> X_W2() {", "}", "if (W1) {",
    ],
}


def _word(line: Column, n: int) -> Column:
    return F.concat(F.lit("w"), F.regexp_replace(F.split_part(line, F.lit(" "), F.lit(n)), "[^A-Za-z]", ""))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as source files: every text line becomes a code line of the file's language, and follows it as a whole.

    It follows as a comment in Java and behind every second line, else as it is.
    """
    d = F.col("doc_id")
    lang = pick(CODE_LANGS, d)
    templates = literal_map({k: "\x1e".join(v) for k, v in TEMPLATES.items()})
    rows = table(spark, sf_dir, "documents").select(
        d.alias("file_id"), F.col("source").alias("repo"), lang.alias("code_lang"), "text",
        F.split(F.try_element_at(templates, lang), "\x1e").alias("tpl"),
    )
    mark = F.when(F.col("code_lang") == "python", "# ").otherwise("// ")
    line = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.concat(
            F.replace(F.replace(F.get(F.col("tpl"), i % F.size("tpl")), F.lit("W1"), _word(x, 1)), F.lit("W2"), _word(x, 2)),
            F.lit("\n"),
            F.when((F.col("code_lang") == "java") | (i % 2 == 1), mark).otherwise(F.lit("")),
            x,
        ),
    )
    ext = pick(list(CODE_EXT.values()), F.col("file_id"))
    return rows.select(
        "file_id",
        "repo",
        F.concat("repo", F.lit("/"), "code_lang", F.lit("/"), F.col("file_id").cast("string"), ext).alias("path"),
        F.array_join(line, "\n").alias("text"),
    )


def _sql_word(n: int) -> str:
    return f"'w' || regexp_replace(split_part(raw, ' ', {n}), '[^A-Za-z]', '', 'g')"


CODE_TEMPLATE_SQL = f"""replace(replace(CASE lang
        {' '.join(f"WHEN '{k}' THEN {sql_pick(v, 'i - 1')}" for k, v in TEMPLATES.items())} END,
        'W1', {_sql_word(1)}), 'W2', {_sql_word(2)})"""
CODE_SQL = f"""raw_lines AS (
  SELECT doc_id AS file_id, source AS repo, {sql_pick(CODE_LANGS, 'doc_id')} AS lang,
         {sql_pick(list(CODE_EXT.values()), 'doc_id')} AS ext,
         unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents),
code_lines AS (
  SELECT * FROM (
    SELECT file_id, repo, repo || '/' || lang || '/' || file_id || ext AS path, lang, 2 * i - 1 AS line_no, trim({CODE_TEMPLATE_SQL}) AS line FROM raw_lines
    UNION ALL
    SELECT file_id, repo, repo || '/' || lang || '/' || file_id || ext, lang, 2 * i,
      trim(CASE WHEN lang <> 'java' AND i % 2 = 1 THEN '' WHEN lang = 'python' THEN '# ' ELSE '// ' END || raw) FROM raw_lines) WHERE line <> '')"""


# ---------------------------------------------------------------- call facts


def call_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as call facts: an order is a file, its lines declare and call methods."""
    k = F.col("l_orderkey")
    pos = (F.col("l_linenumber").cast("long") * 100_000_000 + F.col("l_partkey")) * 1_000_000 + F.col("l_suppkey")
    decl = (F.col("l_returnflag") == "N") | (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A")
    return spread_small(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        k.alias("file_no"),
        pos.alias("pos"),
        F.when(decl, "decl").otherwise("call").alias("kind"),
        F.concat(F.lit("src/F"), k.cast("string"), F.lit(".java")).alias("file_path"),
        F.when(k % 3 == 0, "default").otherwise(F.concat(F.lit("p"), (k % 3).cast("string"))).alias("package"),
        F.concat(F.lit("C"), (k % 40).cast("string")).alias("class"),
        F.concat(F.lit("m"), (F.col("l_partkey") % 25).cast("string")).alias("name"),
        F.when(
            ~decl & (F.col("l_suppkey") % 4 == 0), F.concat(F.lit("x.svc"), (F.col("l_suppkey") % 7).cast("string"))
        ).alias("qualifier"),
        F.when(
            decl, F.slice(F.array(F.lit("int"), F.lit("String")), F.lit(1), (F.col("l_suppkey") % 3).cast("int"))
        ).otherwise(F.array().cast("array<string>")).alias("param_types"),
    )


def resolved_sql() -> str:
    """CTEs ending in ``calls`` over ``facts``."""
    return """labelled AS (
  SELECT *, package || '.' || class AS full_class,
    CASE WHEN kind = 'decl' THEN class || '.' || name || '(' || params || ')' END AS decl_label FROM facts),
calls0 AS (
  SELECT *, last_value(decl_label IGNORE NULLS) OVER (PARTITION BY file_no ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS caller FROM labelled),
decls AS (SELECT full_class, name, file_no, pos, decl_label, file_no * 1000000000000000000::HUGEINT + pos AS ord
  FROM labelled WHERE kind = 'decl'),
calls AS (
  SELECT c.file_no, c.pos, c.caller,
    CASE WHEN c.qualifier IS NOT NULL THEN split_part(c.qualifier, '.', -1) || '.' || c.name || '()'
         WHEN d.decl_label IS NOT NULL THEN d.decl_label ELSE 'unknown.' || c.name || '()' END AS callee,
    CASE WHEN c.qualifier IS NOT NULL THEN 'external' WHEN d.decl_label IS NOT NULL THEN 'declared' ELSE 'unknown' END AS callee_kind
  FROM (SELECT *, file_no * 1000000000000000000::HUGEINT + pos AS ord FROM calls0 WHERE kind = 'call' AND caller IS NOT NULL) c
  ASOF LEFT JOIN decls d ON c.full_class = d.full_class AND c.name = d.name AND c.ord > d.ord)"""


_DECL = "(l_returnflag = 'N' OR (l_linestatus = 'F' AND l_returnflag = 'A'))"
CALLS_SQL = f"""facts AS (
  SELECT l_orderkey AS file_no, (l_linenumber::BIGINT * 100000000 + l_partkey) * 1000000 + l_suppkey AS pos,
    CASE WHEN {_DECL} THEN 'decl' ELSE 'call' END AS kind, 'src/F' || l_orderkey || '.java' AS file_path,
    CASE WHEN l_orderkey % 3 = 0 THEN 'default' ELSE 'p' || (l_orderkey % 3) END AS package,
    'C' || (l_orderkey % 40) AS class, 'm' || (l_partkey % 25) AS name,
    CASE WHEN NOT {_DECL} AND l_suppkey % 4 = 0 THEN 'x.svc' || (l_suppkey % 7) END AS qualifier,
    CASE WHEN {_DECL} THEN ['', 'int', 'int, String'][l_suppkey % 3 + 1] ELSE '' END AS params
  FROM lineitem),
{resolved_sql()},
edges AS (SELECT DISTINCT caller AS src, callee AS dst FROM calls),
refs AS (
  SELECT decl_label AS id, file_no, pos, file_path, full_class, name, params, NULL AS ref_kind FROM labelled WHERE kind = 'decl'
  UNION ALL SELECT callee, file_no, pos, NULL, NULL, NULL, NULL, callee_kind FROM calls WHERE callee_kind <> 'declared'),
nodes AS (
  SELECT id, coalesce(arg_max(file_path, file_no * 1000000000000000000::HUGEINT + pos) FILTER (ref_kind IS NULL),
      arg_min(ref_kind, file_no * 1000000000000000000::HUGEINT + pos) FILTER (ref_kind IS NOT NULL)) AS file_path,
    arg_max(full_class, file_no * 1000000000000000000::HUGEINT + pos) FILTER (ref_kind IS NULL) AS class_name,
    arg_max(name, file_no * 1000000000000000000::HUGEINT + pos) FILTER (ref_kind IS NULL) AS method_name,
    arg_max(params, file_no * 1000000000000000000::HUGEINT + pos) FILTER (ref_kind IS NULL) AS parameters
  FROM refs GROUP BY id)"""


# ---------------------------------------------------------------- wiki

TITLE_WORDS = [
    "Overview of", "System design", "Core feature", "Widget module", "API endpoint", "Data flow", "ML integration",
    "Frontend page", "Setup and deploy", "Notes on", "History of",
]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as wiki pages, one wiki per source."""
    d = F.col("doc_id")
    s = d.cast("string")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("wiki_id"),
        d.alias("pos"),
        F.concat(F.lit("page-"), s).alias("id"),
        F.concat(pick(TITLE_WORDS, d), F.lit(" "), s).alias("title"),
        F.concat(F.lit("# "), F.col("lang"), F.lit("\n\n"), F.col("text")).alias("content"),
        pick(["high", "medium", "low", "medium"], d).alias("importance"),
        F.array(F.concat(F.lit("src/"), s, F.lit(".py"))).alias("file_paths"),
        F.when(d % 5 == 0, F.array().cast("array<string>"))
        .otherwise(
            F.array(
                F.concat(F.lit("page-"), (d + 1).cast("string")),
                F.concat(F.lit("page-"), (F.floor(d / 2)).cast("string")),
                F.concat(F.lit("page-"), (d + 3).cast("string")),
            )
        )
        .alias("related_pages"),
    )


PAGES_SQL = f"""pages_v AS (
  SELECT source AS wiki_id, doc_id AS pos, 'page-' || doc_id AS id,
    {sql_pick(TITLE_WORDS, 'doc_id')} || ' ' || doc_id AS title,
    '# ' || lang || chr(10) || chr(10) || text AS content,
    {sql_pick(['high', 'medium', 'low', 'medium'], 'doc_id')} AS importance,
    ['src/' || doc_id || '.py'] AS file_paths,
    CASE WHEN doc_id % 5 = 0 THEN []::VARCHAR[]
      ELSE ['page-' || (doc_id + 1), 'page-' || (doc_id // 2), 'page-' || (doc_id + 3)] END AS related_pages
  FROM documents)"""


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated contents: the labelled documents; low quality stands for an empty or unfinished answer."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    content = (
        F.when((F.col("quality") == 0) & (F.col("doc_id") % 2 == 0), "")
        .when((F.col("quality") == 0) & (F.col("doc_id") % 3 == 0), "Loading...")
        .otherwise(F.col("text"))
    )
    return docs.join(labels, "doc_id").select(
        F.col("source").alias("wiki_id"), F.concat(F.lit("page-"), F.col("doc_id").cast("string")).alias("id"),
        content.alias("content"),
    )


GENERATED_SQL = """generated AS (
  SELECT source AS wiki_id, 'page-' || doc_id AS id,
    CASE WHEN quality = 0 AND doc_id % 2 = 0 THEN '' WHEN quality = 0 AND doc_id % 3 = 0 THEN 'Loading...' ELSE text END AS content
  FROM documents JOIN labels USING (doc_id))"""


def _key(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, nation and supplier as a three-level section tree, one wiki per region."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    top = region.select(
        _key("w", "r_regionkey").alias("wiki_id"), F.lit(0).cast("long").alias("pos"),
        _key("r", "r_regionkey").alias("id"), F.col("r_name").alias("title"),
    )
    mid = nation.select(
        _key("w", "n_regionkey").alias("wiki_id"), (F.col("n_nationkey") + 1).cast("long").alias("pos"),
        _key("n", "n_nationkey").alias("id"), F.col("n_name").alias("title"),
    )
    low = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        _key("w", "n_regionkey").alias("wiki_id"), (F.col("s_suppkey") + 1000).alias("pos"),
        _key("s", "s_suppkey").alias("id"), F.col("s_name").alias("title"),
    )
    return top.unionByName(mid).unionByName(low)


def section_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions list nations and one unknown id, nations list suppliers."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    wiki = _key("w", "n_regionkey").alias("wiki_id")
    a = nation.select(
        wiki, _key("r", "n_regionkey").alias("parent_id"), F.col("n_nationkey").cast("long").alias("n"),
        _key("n", "n_nationkey").alias("id"),
    )
    b = region.select(
        _key("w", "r_regionkey").alias("wiki_id"), _key("r", "r_regionkey").alias("parent_id"),
        F.lit(1_000_000).cast("long").alias("n"), F.lit("missing").alias("id"),
    )
    c = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        wiki, _key("n", "n_nationkey").alias("parent_id"), F.col("s_suppkey").alias("n"), _key("s", "s_suppkey").alias("id")
    )
    return a.unionByName(b).unionByName(c)


def page_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations list their customers as pages."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        _key("w", "n_regionkey").alias("wiki_id"), _key("n", "n_nationkey").alias("section_id"),
        F.col("c_custkey").alias("n"), _key("c", "c_custkey").alias("id"),
    )


SECTIONS_SQL = """sections AS (
  SELECT 'w' || r_regionkey AS wiki_id, 0::BIGINT AS pos, 'r' || r_regionkey AS id, r_name AS title FROM region
  UNION ALL SELECT 'w' || n_regionkey, n_nationkey + 1, 'n' || n_nationkey, n_name FROM nation
  UNION ALL SELECT 'w' || n_regionkey, s_suppkey + 1000, 's' || s_suppkey, s_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
refs AS (
  SELECT 'w' || n_regionkey AS wiki_id, 'r' || n_regionkey AS parent_id, n_nationkey::BIGINT AS n, 'n' || n_nationkey AS id FROM nation
  UNION ALL SELECT 'w' || r_regionkey, 'r' || r_regionkey, 1000000, 'missing' FROM region
  UNION ALL SELECT 'w' || n_regionkey, 'n' || n_nationkey, s_suppkey, 's' || s_suppkey
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
page_refs AS (
  SELECT 'w' || n_regionkey AS wiki_id, 'n' || n_nationkey AS section_id, c_custkey AS n, 'c' || c_custkey AS id
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
