"""Call graph from call facts.

Facts: file_no, pos (unique per file), kind (decl | call), file_path, package,
class, name, qualifier, param_types ARRAY<STRING>. Nodes are labels such as
``Class.method(T1, T2)``; edges are distinct (src, dst) pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.functions import fixed
from repoloom.operators.ordered import HOT_ROWS, fill_forward, number_rows
from repoloom.session import cut_lineage


def _labels(facts: DataFrame) -> DataFrame:
    label = F.concat(F.col("class"), F.lit("."), F.col("name"), F.lit("("), F.array_join("param_types", ", "), F.lit(")"))
    full = F.concat(F.coalesce("package", F.lit("default")), F.lit("."), F.col("class"))
    return facts.select(
        "*", full.alias("full_class"), F.when(F.col("kind") == "decl", label).alias("decl_label")
    )


def resolved_calls(facts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Calls with their caller and callee.

    The caller is the last declaration above the call in its file (none: the call
    is dropped). An unqualified callee is the declaration of the same class and
    name seen last before the call; a class or file that holds most of the calls
    is spread over many tasks by ``fill_forward``.
    """
    rows = _labels(facts).select(
        "file_no", "pos", "kind", "full_class", "name", "qualifier", "decl_label"
    )
    labelled = rows
    rows = fill_forward(rows, ["file_no"], ["pos"], F.col("decl_label"), "caller", hot_rows=hot_rows)
    near = fill_forward(
        rows.filter((F.col("kind") == "decl") | F.col("caller").isNotNull()),
        ["full_class", "name"], ["file_no", "pos"], F.col("decl_label"), "declared", include_current=False,
        hot_rows=hot_rows, measure=labelled,
    )
    qualified = F.coalesce("qualifier", F.lit("")) != ""
    outer = F.concat(F.substring_index("qualifier", ".", -1), F.lit("."), F.col("name"), F.lit("()"))
    unknown = F.concat(F.lit("unknown."), F.col("name"), F.lit("()"))
    return near.filter(F.col("kind") == "call").select(
        "file_no", "pos", "caller",
        F.when(qualified, outer).otherwise(F.coalesce("declared", unknown)).alias("callee"),
        F.when(qualified, "external").when(F.col("declared").isNotNull(), "declared").otherwise("unknown").alias("callee_kind"),
    )


def call_edges(calls: DataFrame) -> DataFrame:
    """Distinct edges of resolved calls."""
    return calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()


def call_nodes(facts: DataFrame, calls: DataFrame) -> DataFrame:
    """Nodes with file path: the last declaration wins, else the kind of the first reference."""
    declared = _labels(facts).filter(F.col("kind") == "decl").select(
        F.col("decl_label").alias("id"), "file_no", "pos", "file_path", "full_class", "name", "param_types",
        F.lit(None).cast("string").alias("ref_kind"),
    )
    none = F.lit(None)
    referred = calls.filter(F.col("callee_kind") != "declared").select(
        F.col("callee").alias("id"), "file_no", "pos", none.cast("string").alias("file_path"),
        none.cast("string").alias("full_class"), none.cast("string").alias("name"),
        none.cast("array<string>").alias("param_types"), F.col("callee_kind").alias("ref_kind"),
    )
    at = F.struct("file_no", "pos")
    is_decl = F.col("ref_kind").isNull()
    decl = F.struct("file_path", "full_class", "name", "param_types")
    return (
        declared.unionByName(referred)
        .groupBy("id")
        .agg(
            F.max_by(F.when(is_decl, decl), F.when(is_decl, at)).alias("d"),
            F.min_by("ref_kind", F.when(~is_decl, at)).alias("r"),
        )
        .select(
            "id",
            F.coalesce("d.file_path", "r").alias("file_path"),
            F.col("d.full_class").alias("class_name"),
            F.col("d.name").alias("method_name"),
            F.col("d.param_types").alias("parameters"),
        )
    )


def build_graph(facts: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of call facts; the resolved calls feed both, so they are computed once."""
    calls = cut_lineage(resolved_calls(facts, hot_rows))
    return call_nodes(facts, calls), call_edges(calls)


def callers_of(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """(method, caller) rows for each method of a table."""
    return edges.join(methods.select(F.col("method").alias("dst")), "dst", "left_semi").select(
        F.col("dst").alias("method"), F.col("src").alias("caller")
    )


def callees_of(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """(method, callee) rows for each method of a table."""
    return edges.join(methods.select(F.col("method").alias("src")), "src", "left_semi").select(
        F.col("src").alias("method"), F.col("dst").alias("callee")
    )


def in_house(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between declared methods only."""
    own = nodes.filter(F.col("class_name").isNotNull()).select("id")
    return edges.join(own.select(F.col("id").alias("src")), "src", "left_semi").join(
        own.select(F.col("id").alias("dst")), "dst", "left_semi"
    ).select("src", "dst")


def simple_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = fixed.PATH_DEPTH) -> DataFrame:
    """All paths without repeated nodes from start to end with 1 to ``max_depth`` edges.

    pairs: (start, end). A backward pass first finds the nodes that reach each end
    and in how many steps, so the forward pass only extends prefixes that can still
    arrive in time. Each level is checkpointed; the output is every path there is.
    """
    edges = edges.select("src", "dst").distinct()
    pairs = pairs.select("start", "end").distinct()

    # near: fewest steps from a node to the end.
    level = cut_lineage(pairs.select("end", F.col("end").alias("node")).distinct().withColumn("steps", F.lit(0)))
    near = level
    for depth in range(1, max_depth):
        back = (
            level.join(edges, level["node"] == edges["dst"])
            .select("end", F.col("src").alias("node"))
            .distinct()
            .join(near.select("end", "node"), ["end", "node"], "left_anti")
            .withColumn("steps", F.lit(depth))
        )
        level = cut_lineage(back)
        if level.isEmpty():
            break
        near = near.unionByName(level)

    useful = cut_lineage(
        edges.join(near, edges["dst"] == near["node"]).select("end", "src", F.col("dst").alias("next"), "steps")
    )
    frontier = pairs.filter("start != end").select(
        "start", "end", F.col("start").alias("node"), F.array("start").alias("path")
    )
    found = None
    for depth in range(1, max_depth + 1):
        left = max_depth - depth
        grown = (
            frontier.alias("f")
            .join(useful.alias("u"), (F.col("f.end") == F.col("u.end")) & (F.col("f.node") == F.col("u.src")))
            .filter((F.col("u.steps") <= left) & ~F.array_contains("f.path", F.col("u.next")))
            .select("f.start", "f.end", F.col("u.next").alias("node"), F.array_append("f.path", F.col("u.next")).alias("path"))
        )
        grown = cut_lineage(grown)
        done = grown.filter("node = end").select("start", "end", "path")
        found = done if found is None else found.unionByName(done)
        frontier = grown.filter("node != end")
        if depth < max_depth and frontier.isEmpty():
            break
    return found.withColumn("edges", F.size("path") - 1)


def node_parts(nodes: DataFrame, part_rows: int = 10_000) -> DataFrame:
    """Node labels grouped by file path, sorted, in parts of at most ``part_rows`` labels.

    ``external`` and ``unknown`` gather the labels of a whole project; they are
    spread over several rows instead of one.
    """
    numbered = number_rows(nodes.select("file_path", "id"), ["file_path"], ["id"], "n")
    return numbered.groupBy("file_path", F.floor(F.col("n") / part_rows).alias("part_no")).agg(
        F.sort_array(F.collect_list("id")).alias("ids")
    )


def chain_record(nodes: DataFrame, edges: DataFrame, part_rows: int = 10_000) -> DataFrame:
    """Call-chain record as rows (section, key, part_no, items): nodes by file, then edges."""
    by_file = node_parts(nodes, part_rows).select(
        F.lit("nodes").alias("section"), F.col("file_path").alias("key"), "part_no", F.col("ids").alias("items")
    )
    arrow = F.concat("src", F.lit(" -> "), "dst")
    numbered = number_rows(edges.select(arrow.alias("e")), [], ["e"], "n")
    listed = numbered.groupBy(F.floor(F.col("n") / part_rows).alias("part_no")).agg(
        F.sort_array(F.collect_list("e")).alias("items")
    )
    return by_file.unionByName(
        listed.select(F.lit("edges").alias("section"), F.lit("").alias("key"), "part_no", "items")
    )


# Order matters: a declaration is tried before a call.
_DECLARATION = (
    r"(?:(?:public|private|protected|static|final|abstract|synchronized|native)\s+)*"
    r"(?:<[^>();{}]*>\s*)?[A-Za-z_][\w.]*(?:<[^();{}]*?>)?(?:\[\])*\s+[A-Za-z_]\w*\s*\([^()]*\)\s*(?:throws\s+[\w.,\s]+)?[{;]"
)
_CALL = r"(?:new\s+)?[A-Za-z_]\w*(?:\s*\.\s*[A-Za-z_]\w*)*\s*\("


def java_call_facts(files: DataFrame) -> DataFrame:
    """Call facts of Java sources (file_no, path, text) by pattern, without a grammar.

    Comments, string and character literals and annotations with their arguments are
    blanked, then declarations and calls are taken in source order. Constructors, control statements and ``super`` calls are
    skipped. Replaceable: any function that returns the facts columns fits.
    """
    code = F.regexp_replace("text", r'(?s)/\*.*?\*/|//[^\n]*|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|\'(?:[^\'\\\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))\'', " ")
    # Arguments of an annotation may hold parentheses two levels deep.
    nested = r"(?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+"
    code = F.regexp_replace(code, rf"@(?!interface\b)[A-Za-z_][\w.]*+(?:\s*+\({nested}\))?", " ")
    first_class = F.nullif(F.regexp_extract(code, r"\bclass\s+([A-Za-z_]\w*)", 1), F.lit(""))
    package = F.nullif(F.regexp_extract(code, r"\bpackage\s+([\w.]+)\s*;", 1), F.lit(""))
    found = F.regexp_extract_all(code, F.lit(f"{_DECLARATION}|{_CALL}"), F.lit(0))
    rows = (
        files.select(
            "file_no", F.col("path").alias("file_path"), F.coalesce(package, F.lit("default")).alias("package"),
            first_class.alias("class"), F.posexplode(found).alias("i", "m"),
        )
        .filter(F.col("class").isNotNull())
    )
    m = F.col("m")
    head = F.trim(F.substring_index(m, "(", 1))
    last_word = F.regexp_extract(head, r"([A-Za-z_]\w*)\s*\z", 1)
    type_word = F.regexp_extract(head, r"([A-Za-z_]\w*)(?:<[^()]*>)?(?:\[\])*\s+[A-Za-z_]\w*\s*\z", 1)
    is_decl = m.rlike(r"[{;]\z") & ~type_word.isin(fixed.CODE_KEYWORDS) & (type_word != "")
    params = F.regexp_extract(m, r"\(([^()]*)\)", 1)
    for _ in range(3):  # type arguments, innermost first
        params = F.regexp_replace(params, r"<[^<>]*>", "")
    types = F.transform(
        F.filter(F.split(params, ","), lambda x: F.trim(x) != ""),
        # The word before the parameter's name, without type arguments.
        lambda x: F.regexp_extract(x, r"(?:final\s+)?(?:@\w+\s+)*(?:\w+\.)*([A-Za-z_]\w*)", 1),
    )
    # A statement such as "return f(x);" matches the declaration form; it is a call.
    chain = F.regexp_replace(F.regexp_extract(head, r"([A-Za-z_]\w*(?:\s*\.\s*[A-Za-z_]\w*)*)\s*\z", 1), r"\s+", "")
    qualifier = F.when(chain.contains("."), F.regexp_replace(chain, r"\.[^.]*\z", ""))
    qualifier = F.when(~qualifier.isin("this"), qualifier)
    # new X(, if (, super( are neither declarations nor calls.
    skipped = ~is_decl & (head.rlike(r"\bnew\s") | last_word.isin(fixed.CODE_KEYWORDS) | head.startswith("super."))
    return rows.filter(~skipped).select(
        "file_no", F.col("i").cast("long").alias("pos"), F.when(is_decl, "decl").otherwise("call").alias("kind"),
        "file_path", "package", "class", last_word.alias("name"),
        F.when(~is_decl, qualifier).alias("qualifier"),
        F.when(is_decl, types).otherwise(F.array().cast("array<string>")).alias("param_types"),
    )
