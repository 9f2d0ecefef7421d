"""Line-level code facts: one row per import, class, function, method, tag or selector.

Files are exploded into lines, each line is classified by literal patterns chosen
by language, and only matching lines go on; groups are extracted from those. The
class a function belongs to is the last class line above it in the same file. A
file is one input row, so a window over one file is bounded by what a row can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoloom.functions import fixed
from repoloom.functions.paths import language_of, strip
from repoloom.functions.text import js_return_type
from repoloom.operators.columns import settle

_P = fixed.LINE_PATTERNS

# (language, pattern) -> fields of an import row by group number.
IMPORT_RULES = [
    ("python", "import", "import", {"module": 1}),
    ("python", "from_import", "from_import", {"module": 1, "imports": 2}),
    ("java", "import", "import", {"package": 1}),
    ("c_cpp", "include", "include", {"file": (1, 2)}),
    ("javascript", "import", "import", {"imports": 1, "module": 2}),
    ("javascript", "require", "require", {"module": 1}),
    ("typescript", "import", "import", {"imports": 1, "module": 2}),
    ("typescript", "require", "require", {"module": 1}),
    ("rust", "use", "use", {"module": 1}),
    ("rust", "mod", "mod", {"name": 1}),
    ("php", "namespace", "namespace", {"name": 1}),
    ("php", "use", "use", {"name": 1}),
    ("swift", "import", "import", {"module": 1}),
    ("csharp", "using", "using", {"namespace": 1}),
    ("csharp", "namespace", "namespace", {"name": 1}),
    ("css", "import", "import", {"file": 1}),
]
# (language, pattern, kind) -> groups of a function row.
FUNCTION_RULES = [
    ("python", "function", {"name": 1, "params": 2, "return_type": 3}),
    ("java", "function", {"modifiers": 1, "return_type": 2, "name": 3, "params": 4}),
    ("c_cpp", "function", {"return_type": 1, "name": 2, "params": 3}),
    ("javascript", "function", {"name": 1, "params": 2}),
    ("javascript", "arrow_function", {"name": 1, "params": 2}),
    ("typescript", "method", {"name": 1, "params": 2, "return_type": 3}),
    ("typescript", "function", {"name": 1, "params": 2, "return_type": 3}),
    ("typescript", "arrow_function", {"name": 1, "params": 2, "return_type": 3}),
    ("rust", "function", {"name": 1, "params": 2, "return_type": 3}),
    ("php", "function", {"name": 1, "params": 2, "return_type": 3}),
    ("swift", "function", {"name": 1, "params": 2, "return_type": 3}),
    ("csharp", "function", {"modifiers": 1, "return_type": 2, "name": 3, "params": 4}),
    ("html", "tag", {"name": 1}),
    ("css", "selector", {"name": 1}),
]
FACT_COLUMNS = [
    "file_id", "path", "lang", "line_no", "kind", "name", "params", "return_type", "modifiers", "inheritance",
    "receiver", "import_type", "module", "import_path", "class_name", "class_line", "signature",
]


def _null() -> Column:
    return F.lit(None).cast("string")


def _rx(pattern: str) -> str:
    # Unicode classes and \n as the only line end, as the patterns expect. A run of blanks is taken
    # at once: Java matches a repeated alternative recursively, and a long run would exhaust the stack.
    return "(?Ud)" + pattern.replace(r"|\s)*", r"|\s++)*")


def _group(line: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(line, _rx(pattern), group)


def _optional(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _case(branches: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    default, out = _null() if default is None else default, None
    for cond, value in branches:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return default if out is None else out.otherwise(default)


def code_lines(files: DataFrame, lang: Column | None = None) -> DataFrame:
    """Stripped, numbered lines of files (file_id, path, text)."""
    return (
        files.select(
            "file_id",
            "path",
            (language_of(F.col("path")) if lang is None else lang).alias("lang"),
            F.posexplode(F.split("text", "\r\n|\r|\n")).alias("i", "raw"),
        )
        .select("file_id", "path", "lang", (F.col("i") + 1).alias("line_no"), strip(F.col("raw")).alias("line"))
        .filter(F.col("line") != "")
    )


def is_comment(lang: Column, line: Column) -> Column:
    """True for a line that starts like a comment of its language."""
    by_prefix: dict[tuple[str, ...], list[str]] = {}
    for language, prefixes in fixed.COMMENT_PREFIXES.items():
        by_prefix.setdefault(tuple(prefixes), []).append(language)
    cond = F.lit(False)
    for prefixes, languages in by_prefix.items():
        starts = F.lit(False)
        for p in prefixes:
            starts = starts | line.startswith(p)
        cond = cond | (lang.isin(languages) & starts)
    return cond


_CLASS_RULES = [(language, "class") for language in _P if "class" in _P[language]]
_CLASS_BASE, _FUNCTION_BASE = 100, 200


def _rule(lang: Column, line: Column, languages: list[str]) -> Column:
    """Number of the rule a line matches: imports, then (behind comments) classes and functions; null for none."""
    def own(rules: list, language: str, base: int) -> list[tuple[Column, Column]]:
        return [
            (line.rlike(_rx(_P[language][r[1]])), F.lit(base + i)) for i, r in enumerate(rules) if r[0] == language
        ]

    none = F.lit(None).cast("int")
    per_language = []
    for x in languages:
        starts = [(line.startswith(p), none) for p in fixed.COMMENT_PREFIXES[x]]
        branches = own(IMPORT_RULES, x, 0) + starts + own(_CLASS_RULES, x, _CLASS_BASE) + own(FUNCTION_RULES, x, _FUNCTION_BASE)
        per_language.append((lang == x, _case(branches, none)))
    return _case(per_language, none)


def _pick(rule: Column, line: Column, languages: list[str], rules: list, field: str, base: int = 0) -> Column:
    branches = []
    for i, r in enumerate(rules):
        groups, language, p = r[-1], r[0], r[1]
        if field in groups and language in languages:
            g = groups[field]
            pattern = _P[language][p]
            value = (
                _group(line, pattern, g)
                if isinstance(g, int)
                else F.coalesce(*[_optional(_group(line, pattern, x)) for x in g])
            )
            branches.append((rule == base + i, value))
    return _case(branches)


def _scope(df: DataFrame) -> DataFrame:
    """Attach the last class line above each row of the file."""
    w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    cls = F.when(F.col("kind") == "class", F.struct(F.col("name").alias("n"), F.col("line_no").alias("l")))
    scoped = df.withColumn("__c", F.last(cls, ignorenulls=True).over(w))
    return scoped.withColumn("class_name", F.col("__c.n")).withColumn("class_line", F.col("__c.l")).drop("__c")


def line_facts(lines: DataFrame, compat: bool = False, languages: list[str] | None = None) -> DataFrame:
    """Facts of all languages but Go, or of the given ones; ``compat`` keeps statements that look like functions."""
    lang, line, rule = F.col("lang"), F.col("line"), F.col("rule")
    languages = [x for x in _P if x != "go" and (languages is None or x in languages)]
    rows = settle(lines.filter(lang.isin(languages)), rule=_rule(lang, line, languages)).filter("rule IS NOT NULL")

    is_import, is_class = rule < _CLASS_BASE, rule.between(_CLASS_BASE, _FUNCTION_BASE - 1)
    # An import statement without names stands for everything.
    all_names = rule.isin([i for i, r in enumerate(IMPORT_RULES) if r[1] == "import" and "imports" in r[3]])
    imports = _pick(rule, line, languages, IMPORT_RULES, "imports")
    imports = F.when(all_names, F.coalesce(_optional(strip(imports)), F.lit("*"))).otherwise(imports)
    module = _pick(rule, line, languages, IMPORT_RULES, "module")
    package = _pick(rule, line, languages, IMPORT_RULES, "package")
    place = F.coalesce(module, package, *[_pick(rule, line, languages, IMPORT_RULES, x) for x in ("file", "namespace", "name")])
    class_name = _case([(rule == _CLASS_BASE + i, _group(line, _P[x][p], 1)) for i, (x, p) in enumerate(_CLASS_RULES) if x in languages])
    bases = F.when(is_class & (lang == "python"), _optional(_group(line, _P["python"]["class"], 2)))

    def function(field: str) -> Column:
        return _pick(rule, line, languages, FUNCTION_RULES, field, _FUNCTION_BASE)

    rules = [r[1] for r in FUNCTION_RULES]
    is_arrow = rule.isin([_FUNCTION_BASE + i for i, r in enumerate(rules) if r == "arrow_function"])
    # The TypeScript method form counts inside a class only, unless the line is a function as well.
    only_method = (rule == _FUNCTION_BASE + rules.index("method")) & ~line.rlike(_rx(_P["typescript"]["function"]))
    rows = settle(
        rows,
        kind=F.when(is_import, "import").when(is_class, "class").when(lang == "html", "tag")
        .when(lang == "css", "selector").otherwise("function"),
        name=F.coalesce(class_name, F.when(lang == "css", strip(function("name"))).otherwise(function("name"))),
        params=function("params"),
        returned=_optional(
            F.when(lang.isin("java", "csharp", "c_cpp"), strip(function("return_type"))).otherwise(function("return_type"))
        ),
        modifiers=_optional(strip(function("modifiers"))),
        inheritance=bases,
        import_type=_case([(rule == i, F.lit(r[2])) for i, r in enumerate(IMPORT_RULES)]),
        module=place,
        import_path=F.when(is_import, F.coalesce(package, imports, module)),
        only_method=only_method,
        never_method=is_arrow | lang.isin("rust", "html", "css"),
    )
    returns = F.when((lang == "javascript") & (F.col("kind") == "function"), js_return_type(F.col("name"))).otherwise(
        F.col("returned")
    )
    facts = rows.filter(~((lang == "html") & line.endswith("/>"))).select(
        "file_id", "path", "lang", "line_no", "kind", "name", "params", returns.alias("return_type"), "modifiers",
        "inheritance", _null().alias("receiver"), "import_type", "module", "import_path", "only_method", "never_method",
    )
    if not compat:
        noise = F.col("name").isin(fixed.CODE_KEYWORDS) | (
            lang.isin("java", "csharp", "c_cpp")
            & F.coalesce(F.col("return_type").isin(fixed.CODE_KEYWORDS), F.lit(False))
        )
        facts = facts.filter(~((F.col("kind") == "function") & noise))
    scoped = _scope(facts)
    in_class = (F.col("kind") == "function") & F.col("class_name").isNotNull() & ~F.col("never_method")
    scoped = scoped.filter(~(F.col("only_method") & F.col("class_name").isNull()))
    kind = F.when(in_class, "method").otherwise(F.col("kind"))
    owned = F.when(in_class | (F.col("kind") == "class"), F.col("class_name"))
    owned_line = F.when(in_class | (F.col("kind") == "class"), F.col("class_line"))
    out = scoped.withColumn("class_name", owned).withColumn("class_line", owned_line).withColumn("kind", kind)
    signature = F.concat(
        F.col("name"), F.lit("("), F.coalesce("params", F.lit("")), F.lit(")"),
        F.when(F.coalesce("return_type", F.lit("")) != "", F.concat(F.lit(" -> "), F.col("return_type"))).otherwise(""),
    )
    return out.withColumn(
        "signature", F.when(F.col("kind").isin("function", "method"), signature)
    ).select(*FACT_COLUMNS)


def go_facts(lines: DataFrame) -> DataFrame:
    """Facts of Go files: package, single and block imports, functions and receiver methods."""
    line, p = F.col("line"), _P["go"]
    w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    outside = (
        F.when(line.rlike(_rx(p["import"])), "import")
        .when(line.rlike(_rx(p["function"])), "function")
        .when(line.rlike(_rx(p["method"])), "method")
    )
    # Each line is matched where it is read; only lines that are a fact or open or close something are sorted.
    rows = settle(
        lines.filter(F.col("lang") == "go"),
        opens=line.contains("/*") & ~line.contains("*/"),
        closes=line.contains("*/"),
        is_package=line.rlike(_rx(p["package"])),
        block_path=line.rlike(_rx(p["block_path"])),
        outside=outside,
    )
    opens, is_package = F.col("opens"), F.col("is_package")
    rows = rows.filter(opens | F.col("closes") | is_package | line.isin("import (", ")") | F.col("block_path") | F.col("outside").isNotNull())
    comment_mark = F.when(opens, True).when(F.col("closes"), False)
    rows = rows.withColumn("in_comment", F.coalesce(F.last(comment_mark, ignorenulls=True).over(w), F.lit(False))).filter(
        ~F.col("in_comment") & ~opens & ~line.startswith("//")
    )
    block_mark = F.when(is_package, F.lit(None)).when(line == "import (", True).when(line == ")", False)
    rows = rows.withColumn("in_block", F.coalesce(F.last(block_mark, ignorenulls=True).over(w), F.lit(False)))
    in_block = F.col("in_block")
    kind = (
        F.when(is_package, "package")
        .when(line == "import (", None)
        .when(in_block & (line == ")"), None)
        .when(in_block, F.when(F.col("block_path"), "block_import"))
        .otherwise(F.col("outside"))
    )
    rows = settle(rows, k=kind).filter("k IS NOT NULL")
    k = F.col("k")
    import_path = (
        F.when(k == "block_import", _group(line, p["block_path"], 1))
        .when(k == "import", F.coalesce(*[_optional(_group(line, p["import"], i)) for i in (1, 2, 3)]))
    )
    name = (
        F.when(k == "package", _group(line, p["package"], 1))
        .when(k == "function", _group(line, p["function"], 1))
        .when(k == "method", _group(line, p["method"], 2))
    )
    params = strip(
        F.when(k == "function", _group(line, p["function"], 2)).when(k == "method", _group(line, p["method"], 3))
    )
    returns = _optional(
        strip(F.when(k == "function", _group(line, p["function"], 3)).when(k == "method", _group(line, p["method"], 4)))
    )
    receiver = F.when(k == "method", strip(_group(line, p["method"], 1)))
    head = F.when(k == "method", F.concat(F.lit("func ("), receiver, F.lit(") "))).otherwise("func ")
    signature = F.concat(
        head, name, F.lit("("), params, F.lit(")"),
        F.when(returns.isNotNull(), F.concat(F.lit(" -> ("), returns, F.lit(")"))).otherwise(""),
    )
    values = {
        "kind": F.when(k == "block_import", "import").otherwise(k),
        "name": name,
        "params": params,
        "return_type": returns,
        "receiver": receiver,
        "import_type": F.when(k.isin("import", "block_import"), "import"),
        "module": import_path,
        "import_path": import_path,
        "signature": F.when(k.isin("function", "method"), signature),
        "class_line": F.lit(None).cast("int"),
    }
    return rows.select(
        *[
            values[c].alias(c) if c in values else (F.col(c) if c in rows.columns else _null().alias(c))
            for c in FACT_COLUMNS
        ]
    )


def file_facts(files: DataFrame, compat: bool = False) -> DataFrame:
    """Facts of files (file_id, path, text) in all supported languages."""
    lines = code_lines(files)
    return line_facts(lines, compat).unionByName(go_facts(lines))


def dependencies(facts: DataFrame, compat: bool = False) -> DataFrame:
    """Distinct sorted dependencies per file; ``compat`` takes the imported names over the module."""
    dep = "import_path" if compat else "module"
    return (
        facts.filter((F.col("kind") == "import") & F.col(dep).isNotNull())
        .select("file_id", F.col(dep).alias("dependency"))
        .distinct()
        .groupBy("file_id")
        .agg(F.sort_array(F.collect_list("dependency")).alias("dependencies"))
    )


def file_statistics(facts: DataFrame) -> DataFrame:
    """Counts of imports, classes, functions and methods per file."""
    return facts.groupBy("file_id").agg(
        *[
            F.count_if(F.col("kind") == kind).alias(name)
            for kind, name in (
                ("import", "total_imports"),
                ("class", "total_classes"),
                ("function", "total_functions"),
                ("method", "total_methods"),
            )
        ]
    )


def key_methods(facts: DataFrame, limit: int = fixed.KEY_METHODS) -> DataFrame:
    """Classes with their first ``limit`` method names and the full method count."""
    w = Window.partitionBy("file_id", "class_line").orderBy("line_no")
    classes = facts.filter(F.col("kind") == "class").select(
        "file_id", "class_line", F.col("name").alias("class_name")
    )
    methods = facts.filter((F.col("kind") == "method") & F.col("class_line").isNotNull())
    counts = methods.groupBy("file_id", "class_line").agg(F.count(F.lit(1)).alias("n"))
    firsts = (
        methods.withColumn("r", F.row_number().over(w))
        .filter(F.col("r") <= limit)
        .groupBy("file_id", "class_line")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("methods"))
    )
    on = ["file_id", "class_line"]
    return (
        classes.join(counts, on, "left")
        .join(firsts, on, "left")
        .select(
            *on,
            "class_name",
            F.coalesce("methods", F.array().cast("array<string>")).alias("methods"),
            F.coalesce("n", F.lit(0)).alias("method_count"),
        )
    )


def file_analysis(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Nested analysis per file: metadata, imports, classes, functions, methods and statistics."""
    def rows(kind: str, *fields: str) -> Column:
        item = F.when(F.col("kind") == kind, F.struct("line_no", *fields))
        return F.array_sort(F.collect_list(item)).alias({"class": "classes"}.get(kind, kind + "s"))

    nested = facts.groupBy("file_id").agg(
        F.max(F.when(F.col("kind") == "package", F.col("name"))).alias("package"),
        rows("import", "import_type", "import_path", "module"),
        rows("class", "name", "inheritance"),
        rows("function", "name", "params", "return_type", "signature"),
        rows("method", "class_name", "receiver", "name", "params", "return_type", "modifiers", "signature"),
    )
    return files.select(
        "file_id", "path", language_of(F.col("path")).alias("lang")
    ).join(nested, "file_id", "left").join(file_statistics(facts), "file_id", "left")


def first_classes(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """First class of each Java file, which names all its methods, and the file's package (``default`` without one)."""
    cls = facts.filter((F.col("lang") == "java") & (F.col("kind") == "class"))
    first = cls.groupBy("file_id").agg(F.min_by("name", "line_no").alias("class_name"))
    stated = lines.select("file_id", "line_no", _optional(F.regexp_extract("line", r"^package\s+([\w.]+)\s*;", 1)).alias("p")).filter("p IS NOT NULL")
    packages = stated.groupBy("file_id").agg(F.min_by("p", "line_no").alias("p"))
    return first.join(packages, "file_id", "left").select("file_id", "class_name", F.coalesce("p", F.lit("default")).alias("package"))


def project_totals(files: DataFrame) -> DataFrame:
    """Files per repository: all, and those without an error."""
    return files.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("error").isNull()).alias("processed_files")
    )


def decode_files(raw: DataFrame, content: str = "content") -> DataFrame:
    """Bytes -> text; invalid UTF-8 becomes a null text with an error instead of failing the job."""
    as_text = F.col(content).cast("string")
    ok = F.is_valid_utf8(as_text)
    return raw.select(
        *[c for c in raw.columns if c != content],
        F.when(ok, as_text).alias("text"),
        F.when(~ok, F.lit("invalid utf-8")).alias("error"),
    )
