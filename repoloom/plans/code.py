"""Code-fact queries over the derived source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from repoloom.functions import fixed
from repoloom.operators import code_facts as cf
from repoloom.operators import rollups
from repoloom.plans.catalog import register
from repoloom.plans.views import CODE_SQL, code_files, sql_in, table
from repoloom.session import cut_lineage

_P = fixed.LINE_PATTERNS


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _m(lang: str, p: str, col: str = "line") -> str:
    return f"regexp_matches({col}, {_lit(_P[lang][p])})"


def _g(lang: str, p: str, n: int, col: str = "line") -> str:
    return f"regexp_extract({col}, {_lit(_P[lang][p])}, {n})"


def _first(cases: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + " END"


def _rule(column: str, rules: list, field: str) -> str:
    cases = []
    for i, r in enumerate(rules):
        g = r[-1].get(field)
        if g is None:
            continue
        one = _g(r[0], r[1], g) if isinstance(g, int) else "coalesce(" + ", ".join(f"nullif({_g(r[0], r[1], x)}, '')" for x in g) + ")"
        cases.append((f"{column} = {i}", one))
    return _first(cases) if cases else "NULL"


_KEYWORDS = sql_in(fixed.CODE_KEYWORDS)
_COMMENT = " OR ".join(
    f"(lang = '{x}' AND ({' OR '.join(f'starts_with(line, {_lit(p)})' for p in ps)}))" for x, ps in fixed.COMMENT_PREFIXES.items()
)
_CLASS_RULES = [(x, "class") for x in _P if "class" in _P[x]]
_ARROWS = sql_in([str(i) for i, r in enumerate(cf.FUNCTION_RULES) if r[1] == "arrow_function"])
_TS_METHOD = [i for i, r in enumerate(cf.FUNCTION_RULES) if r[1] == "method"][0]
_JS_RETURN = """CASE WHEN starts_with(name, 'get') OR starts_with(name, 'is') OR starts_with(name, 'has') THEN 'boolean'
  WHEN starts_with(name, 'create') OR starts_with(name, 'make') THEN 'object'
  WHEN starts_with(name, 'calculate') OR starts_with(name, 'compute') THEN 'number'
  WHEN starts_with(name, 'to') AND length(name) > 2 THEN lower(substr(name, 3)) ELSE 'any' END"""


def facts_sql(compat: bool = False) -> str:
    """CTEs ending in ``facts`` for all languages."""
    imp = _first([(f"lang = '{r[0]}' AND {_m(r[0], r[1])}", str(i)) for i, r in enumerate(cf.IMPORT_RULES)])
    cls = _first([(f"lang = '{x}' AND {_m(x, p)}", str(i)) for i, (x, p) in enumerate(_CLASS_RULES)])
    fun = _first([(f"lang = '{r[0]}' AND {_m(r[0], r[1])}", str(i)) for i, r in enumerate(cf.FUNCTION_RULES)])
    imports = _rule("imp", cf.IMPORT_RULES, "imports")
    module, package = _rule("imp", cf.IMPORT_RULES, "module"), _rule("imp", cf.IMPORT_RULES, "package")
    others = ", ".join(_rule("imp", cf.IMPORT_RULES, f) for f in ("file", "namespace", "name"))
    import_type = _first([(f"imp = {i}", f"'{r[2]}'") for i, r in enumerate(cf.IMPORT_RULES)])
    cls_name = _first([(f"cls = {i}", _g(x, p, 1)) for i, (x, p) in enumerate(_CLASS_RULES)])
    noise = "" if compat else f"WHERE NOT (kind = 'function' AND (name IN {_KEYWORDS} OR (lang IN ('java', 'csharp', 'c_cpp') AND coalesce(rt IN {_KEYWORDS}, false))))"
    return f"""{CODE_SQL},
imp0 AS (SELECT *, {imp} AS imp FROM code_lines WHERE lang <> 'go'),
imp1 AS (SELECT *, CASE WHEN imp IS NULL THEN {cls} END AS cls FROM imp0 WHERE imp IS NOT NULL OR NOT ({_COMMENT})),
hit AS (SELECT * FROM (SELECT *, CASE WHEN imp IS NULL AND cls IS NULL THEN {fun} END AS fun FROM imp1) WHERE imp IS NOT NULL OR cls IS NOT NULL OR fun IS NOT NULL),
named AS (SELECT file_id, repo, path, lang, line_no, line, imp, cls, fun,
  CASE WHEN imp IS NOT NULL THEN 'import' WHEN cls IS NOT NULL THEN 'class' ELSE 'function' END AS kind,
  coalesce({cls_name}, {_rule('fun', cf.FUNCTION_RULES, 'name')}) AS name, {_rule('fun', cf.FUNCTION_RULES, 'params')} AS params,
  nullif(CASE WHEN lang IN ('java', 'csharp', 'c_cpp') THEN trim({_rule('fun', cf.FUNCTION_RULES, 'return_type')})
    ELSE {_rule('fun', cf.FUNCTION_RULES, 'return_type')} END, '') AS rt,
  nullif(trim({_rule('fun', cf.FUNCTION_RULES, 'modifiers')}), '') AS modifiers,
  CASE WHEN cls IS NOT NULL AND lang = 'python' THEN nullif({_g('python', 'class', 2)}, '') END AS inheritance,
  {import_type} AS import_type, coalesce({module}, {package}, {others}) AS module,
  CASE WHEN imp IS NOT NULL THEN coalesce({package},
    CASE WHEN lang IN ('javascript', 'typescript') AND {import_type} = 'import' THEN coalesce(nullif({imports}, ''), '*') ELSE {imports} END,
    {module}) END AS import_path FROM hit),
quiet AS (SELECT * FROM named {noise}),
scoped AS (SELECT *, last_value(CASE WHEN kind = 'class' THEN {{'n': name, 'l': line_no}} END IGNORE NULLS)
  OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM quiet),
owned AS (SELECT *, kind = 'function' AND c IS NOT NULL AND fun::VARCHAR NOT IN {_ARROWS} AND lang <> 'rust' AS in_class FROM scoped
  WHERE NOT (coalesce(fun = {_TS_METHOD}, false) AND NOT {_m('typescript', 'function')} AND c IS NULL)),
facts0 AS (SELECT file_id, repo, path, lang, line_no, CASE WHEN in_class THEN 'method' ELSE kind END AS kind, name, params,
  CASE WHEN kind <> 'function' THEN NULL WHEN lang = 'javascript' THEN {_JS_RETURN} ELSE rt END AS return_type, modifiers, inheritance, import_type, module, import_path,
  CASE WHEN in_class OR kind = 'class' THEN c.n END AS class_name, CASE WHEN in_class OR kind = 'class' THEN c.l END AS class_line FROM owned),
line_facts AS (SELECT *, CASE WHEN kind IN ('function', 'method') THEN name || '(' || coalesce(params, '') || ')' ||
  CASE WHEN coalesce(return_type, '') <> '' THEN ' -> ' || return_type ELSE '' END END AS signature FROM facts0),
{_GO_STEPS},
facts AS (SELECT * FROM line_facts UNION ALL SELECT file_id, repo, path, lang, line_no, CASE k WHEN 'block' THEN 'import' ELSE k END, name, params, return_type, NULL, NULL,
  CASE WHEN k IN ('block', 'import') THEN 'import' END, import_path, import_path, NULL, NULL, {_GO_SIGNATURE} FROM c5)"""


_GO = _P["go"]
_GO_SIGNATURE = """CASE WHEN k IN ('function', 'method') THEN 'func ' || CASE k WHEN 'method' THEN '(' || receiver || ') ' ELSE '' END || name || '(' || params || ')' ||
      CASE WHEN return_type IS NOT NULL THEN ' -> (' || return_type || ')' ELSE '' END END"""
_GO_STEPS = f"""c0 AS (SELECT *, contains(line, '/*') AND NOT contains(line, '*/') AS opens FROM code_lines WHERE lang = 'go'),
c1 AS (SELECT *, coalesce(last_value(CASE WHEN opens THEN true WHEN contains(line, '*/') THEN false END IGNORE NULLS) OVER w, false) AS in_comment
  FROM c0 WINDOW w AS (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c2 AS (SELECT * FROM c1 WHERE NOT in_comment AND NOT opens AND NOT starts_with(line, '//')),
c3 AS (SELECT *, coalesce(last_value(CASE WHEN {_m('go', 'package')} THEN NULL WHEN line = 'import (' THEN true WHEN line = ')' THEN false END IGNORE NULLS) OVER w, false) AS in_block
  FROM c2 WINDOW w AS (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c4 AS (SELECT *, CASE WHEN {_m('go', 'package')} THEN 'package' WHEN line = 'import (' OR (in_block AND line = ')') THEN NULL
  WHEN in_block THEN CASE WHEN {_m('go', 'block_path')} THEN 'block' END WHEN {_m('go', 'import')} THEN 'import'
  WHEN {_m('go', 'function')} THEN 'function' WHEN {_m('go', 'method')} THEN 'method' END AS k FROM c3),
c5 AS (SELECT file_id, repo, path, lang, line_no, k, CASE k WHEN 'package' THEN {_g('go', 'package', 1)} WHEN 'function' THEN {_g('go', 'function', 1)} WHEN 'method' THEN {_g('go', 'method', 2)} END AS name,
  CASE k WHEN 'function' THEN {_g('go', 'function', 2)} WHEN 'method' THEN {_g('go', 'method', 3)} END AS params,
  nullif(CASE k WHEN 'function' THEN {_g('go', 'function', 3)} WHEN 'method' THEN {_g('go', 'method', 4)} END, '') AS return_type,
  CASE k WHEN 'method' THEN {_g('go', 'method', 1)} END AS receiver,
  CASE k WHEN 'block' THEN {_g('go', 'block_path', 1)} WHEN 'import' THEN coalesce(nullif({_g('go', 'import', 1)}, ''), nullif({_g('go', 'import', 2)}, ''), {_g('go', 'import', 3)}) END AS import_path
  FROM c4 WHERE k IS NOT NULL)"""

FACTS_SQL = facts_sql()
_COLS = "file_id, line_no, kind, name, params, return_type, modifiers, inheritance, import_type, module, import_path, class_name, signature"
_COL_LIST = _COLS.split(", ")


def facts(spark, sf_dir, compat: bool = False, languages: list[str] | None = None):
    files = code_files(spark, sf_dir)
    return cf.file_facts(files, compat) if languages is None else cf.line_facts(cf.code_lines(files), compat, languages)


def stored_facts(spark, sf_dir):
    """Facts written once for queries that read them several times."""
    return cut_lineage(facts(spark, sf_dir))


def _language_query(name: str, condition: str, compat: bool = False, lang: str | None = None) -> None:
    condition = f"lang = '{lang}' AND {condition}" if lang else condition
    sql = FACTS_SQL if not compat else facts_sql(True)

    @register(name, f"WITH {sql} SELECT {_COLS} FROM facts WHERE {condition}")
    def query(spark, sf_dir):
        return facts(spark, sf_dir, compat, [lang] if lang else None).filter(condition).select(*_COL_LIST)


@register(
    "p1_detect_language",
    f"WITH {CODE_SQL} SELECT file_id, lang, count(*) AS lines FROM code_lines GROUP BY 1, 2",
)
def detect_language(spark, sf_dir):
    return cf.code_lines(code_files(spark, sf_dir)).groupBy("file_id", "lang").agg(F.count(F.lit(1)).alias("lines"))


_language_query("p2_p3_imports", "kind = 'import'")
_language_query("p4_classes", "kind = 'class'")
_language_query("p5_python_functions", "kind IN ('function', 'method')", lang="python")
_language_query("p6_java_methods", "kind IN ('function', 'method')", lang="java")
_language_query("p6_java_methods_compat", "kind IN ('function', 'method')", compat=True, lang="java")
_language_query("p7_c_functions", "kind IN ('function', 'method')", lang="c_cpp")
_language_query("p8_javascript_functions", "kind IN ('function', 'method')", lang="javascript")
_language_query("p9_typescript_functions", "kind IN ('function', 'method')", lang="typescript")
_language_query("p11_rust_functions", "kind IN ('function', 'method')", lang="rust")
_language_query("p12_php_functions", "kind IN ('function', 'method')", lang="php")
_language_query("p13_swift_functions", "kind IN ('function', 'method')", lang="swift")
_language_query("p14_csharp_methods", "kind IN ('function', 'method')", lang="csharp")
_language_query("e1_scope_attribution", "class_name IS NOT NULL")

GO_SQL = f"{CODE_SQL},\n{_GO_STEPS}"


@register(
    "p10_go_facts",
    f"""WITH {GO_SQL} SELECT file_id, line_no, CASE k WHEN 'block' THEN 'import' ELSE k END AS kind, name, params, return_type, receiver, import_path,
    {_GO_SIGNATURE} AS signature FROM c5""",
)
def go_facts(spark, sf_dir):
    return cf.go_facts(cf.code_lines(code_files(spark, sf_dir))).select(
        "file_id", "line_no", "kind", "name", "params", "return_type", "receiver", "import_path", "signature"
    )


@register(
    "b13_code_lines",
    f"WITH {CODE_SQL} SELECT file_id, line_no, lang, line FROM code_lines WHERE NOT ({_COMMENT})",
)
def code_lines(spark, sf_dir):
    lines = cf.code_lines(code_files(spark, sf_dir))
    return lines.filter(~cf.is_comment(F.col("lang"), F.col("line"))).select("file_id", "line_no", "lang", "line")


@register(
    "p15_html_tags",
    f"""WITH l AS (SELECT page_id, i AS line_no, trim(x) AS line FROM (SELECT page_id, unnest(string_split(replace(html, '>', '>' || chr(10)), chr(10))) AS x,
      generate_subscripts(string_split(replace(html, '>', '>' || chr(10)), chr(10)), 1) AS i FROM pages))
    SELECT page_id, line_no, {_g('html', 'tag', 1)} AS name FROM l WHERE line <> '' AND NOT starts_with(line, '<!--') AND {_m('html', 'tag')} AND NOT line LIKE '%/>'""",
)
def html_tags(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("file_id"), F.col("url").alias("path"), F.regexp_replace("html", ">", ">\n").alias("text")
    )
    return cf.line_facts(cf.code_lines(pages, F.lit("html")), languages=["html"]).select(
        F.col("file_id").alias("page_id"), "line_no", "name"
    )


@register(
    "p15_css_selectors",
    """SELECT doc_id, i AS line_no, CASE WHEN i % 2 = 1 THEN 'selector' ELSE 'import' END AS kind, CASE WHEN i % 2 = 1 THEN '.a' || i || ' > ' || l || '.b' END AS name,
    CASE WHEN i % 2 = 0 THEN 'x' || i || l || '.css' END AS module FROM (SELECT doc_id, i, regexp_replace(l, '[^A-Za-z]+', ' ', 'g') AS l FROM (
      SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS l FROM documents))""",
)
def css_selectors(spark, sf_dir):
    words = lambda l: F.regexp_replace(l, "[^A-Za-z]+", " ")
    line = F.transform(
        F.split("text", "\n"),
        lambda l, i: F.when((i + 1) % 2 == 1, F.concat(F.lit(".a"), (i + 1).cast("string"), F.lit(" > "), words(l), F.lit(".b {"))).otherwise(
            F.concat(F.lit("@import url('x"), (i + 1).cast("string"), words(l), F.lit(".css');"))
        ),
    )
    css = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), F.lit("a.css").alias("path"), F.array_join(line, "\n").alias("text")
    )
    return cf.line_facts(cf.code_lines(css, F.lit("css")), languages=["css"]).select(
        F.col("file_id").alias("doc_id"), "line_no", "kind", "name", "module"
    )


@register(
    "d4_file_statistics",
    f"""WITH {FACTS_SQL} SELECT file_id, count(*) FILTER (kind = 'import') AS total_imports, count(*) FILTER (kind = 'class') AS total_classes,
    count(*) FILTER (kind = 'function') AS total_functions, count(*) FILTER (kind = 'method') AS total_methods FROM facts GROUP BY 1""",
)
def file_statistics(spark, sf_dir):
    return cf.file_statistics(facts(spark, sf_dir))


@register(
    "d6_dependencies",
    f"WITH {FACTS_SQL} SELECT file_id, string_agg(module, '|' ORDER BY module) AS dependencies FROM (SELECT DISTINCT file_id, module FROM facts WHERE kind = 'import' AND module IS NOT NULL) GROUP BY 1",
)
def dependencies(spark, sf_dir):
    return cf.dependencies(facts(spark, sf_dir))


@register(
    "d6_dependencies_compat",
    f"WITH {FACTS_SQL} SELECT file_id, string_agg(import_path, '|' ORDER BY import_path) AS dependencies FROM (SELECT DISTINCT file_id, import_path FROM facts WHERE kind = 'import' AND import_path IS NOT NULL) GROUP BY 1",
)
def dependencies_compat(spark, sf_dir):
    return cf.dependencies(facts(spark, sf_dir), compat=True)


def _key_sql(limit: int) -> str:
    return f"""{FACTS_SQL},
m AS (SELECT file_id, class_line, name, line_no, row_number() OVER (PARTITION BY file_id, class_line ORDER BY line_no) AS r FROM facts WHERE kind = 'method'),
keys AS (SELECT c.file_id, c.class_line, c.name AS class_name, coalesce(string_agg(m.name, '|' ORDER BY m.line_no) FILTER (r <= {limit}), '') AS methods, count(m.name) AS method_count
  FROM facts c LEFT JOIN m ON m.file_id = c.file_id AND m.class_line = c.class_line WHERE c.kind = 'class' GROUP BY 1, 2, 3)"""


@register("f3_key_methods", f"WITH {_key_sql(2)} SELECT * FROM keys")
def key_methods(spark, sf_dir):
    return cf.key_methods(stored_facts(spark, sf_dir), 2)


@register(
    "e10_first_classes",
    f"""WITH {FACTS_SQL}, p AS (SELECT file_id, arg_min(regexp_extract(line, '^package\\s+([\\w.]+)\\s*;', 1), line_no) AS package FROM code_lines
      WHERE lang = 'java' AND regexp_matches(line, '^package\\s+([\\w.]+)\\s*;') GROUP BY 1)
    SELECT c.file_id, class_name, coalesce(package, 'default') AS package
    FROM (SELECT file_id, arg_min(name, line_no) AS class_name FROM facts WHERE lang = 'java' AND kind = 'class' GROUP BY 1) c LEFT JOIN p USING (file_id)""",
)
def first_classes(spark, sf_dir):
    lines = cf.code_lines(code_files(spark, sf_dir)).filter("lang = 'java'")
    return cf.first_classes(cf.line_facts(lines, languages=["java"]), lines)


@register(
    "p16_signatures",
    f"WITH {FACTS_SQL} SELECT file_id, string_agg(signature, '|' ORDER BY line_no) AS signatures, count(*) AS n FROM facts WHERE signature IS NOT NULL GROUP BY 1",
)
def signatures(spark, sf_dir):
    files = code_files(spark, sf_dir)
    f = stored_facts(spark, sf_dir)
    nested = cf.file_analysis(files, f)
    both = F.array_sort(
        F.concat(
            F.transform("functions", lambda x: F.struct(x["line_no"].alias("l"), x["signature"].alias("s"))),
            F.transform("methods", lambda x: F.struct(x["line_no"].alias("l"), x["signature"].alias("s"))),
        )
    )
    return nested.select(
        "file_id", F.transform(both, lambda x: x["s"]).alias("signatures"),
        F.size(both).alias("n"),
    ).filter("n > 0")


@register(
    "p17_error_rows",
    """SELECT doc_id, CASE WHEN doc_id % 6 <> 0 THEN text END AS text, CASE WHEN doc_id % 6 = 0 THEN 'invalid utf-8' END AS error FROM documents""",
)
def error_rows(spark, sf_dir):
    bad = F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("FFFE")))
    raw = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 6 == 0, bad).otherwise(F.encode("text", "utf-8")).alias("content")
    )
    return cf.decode_files(raw)


@register(
    "h33_key_info",
    f"""WITH {_key_sql(fixed.KEY_METHODS)},
    k AS (SELECT file_id, string_agg(class_name || '[' || methods || ']' || method_count, ';' ORDER BY class_line) AS key_classes FROM keys GROUP BY 1),
    f AS (SELECT file_id, string_agg(name || '(' || coalesce(params, '') || ')' || coalesce(return_type, 'unknown'), ';' ORDER BY line_no) AS key_functions FROM facts WHERE kind = 'function' GROUP BY 1),
    s AS (SELECT file_id, count(*) FILTER (kind = 'import') AS n FROM facts GROUP BY 1),
    d AS (SELECT file_id, string_agg(module, '|' ORDER BY module) AS dependencies FROM (SELECT DISTINCT file_id, module FROM facts WHERE kind = 'import' AND module IS NOT NULL) GROUP BY 1)
    SELECT doc_id AS file_id, coalesce(k.key_classes, '') AS key_classes, coalesce(f.key_functions, '') AS key_functions, coalesce(s.n, 0) AS imports_count, coalesce(d.dependencies, '') AS dependencies
    FROM documents LEFT JOIN k ON k.file_id = doc_id LEFT JOIN f ON f.file_id = doc_id LEFT JOIN s ON s.file_id = doc_id LEFT JOIN d ON d.file_id = doc_id""",
)
def key_info(spark, sf_dir):
    files = code_files(spark, sf_dir).select("file_id")
    f = stored_facts(spark, sf_dir)
    info = rollups.key_info(
        files, cf.file_statistics(f), cf.key_methods(f), f.filter("kind = 'function'"), cf.dependencies(f)
    )
    cls = F.transform(
        "key_classes",
        lambda c: F.concat(c["name"], F.lit("["), F.array_join(c["methods"], "|"), F.lit("]"), c["method_count"].cast("string")),
    )
    fun = F.transform(
        "key_functions", lambda x: F.concat(x["name"], F.lit("("), x["parameters"], F.lit(")"), x["return_type"])
    )
    return info.select(
        "file_id", F.coalesce(F.array_join(cls, ";"), F.lit("")).alias("key_classes"),
        F.coalesce(F.array_join(fun, ";"), F.lit("")).alias("key_functions"), "imports_count",
        F.coalesce(F.array_join("dependencies", "|"), F.lit("")).alias("dependencies"),
    )
