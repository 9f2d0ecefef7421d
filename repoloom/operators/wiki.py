"""Wiki structures, pages, sections and exports.

Pages: wiki_id, pos, id, title, content, importance, file_paths, related_pages.
Sections: wiki_id, pos, id, title, pages, subsections. ``pos`` is the 0-based
position in the wiki's list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoloom.functions import fixed
from repoloom.functions import payloads as pl
from repoloom.functions import text as tx
from repoloom.functions.paths import strip
from repoloom.operators.columns import join_salted, settle
from repoloom.operators.ordered import number_rows, text_parts
from repoloom.session import cut_lineage

_PAGE = (
    "struct<_id:string,title:string,importance:string,"
    "relevant_files:struct<file_path:array<string>>,related_pages:struct<related:array<string>>>"
)
_SECTION = (
    "struct<_id:string,title:string,pages:struct<page_ref:array<string>>,subsections:struct<section_ref:array<string>>>"
)
STRUCTURE_SCHEMA = (
    f"title string, description string, pages struct<page:array<{_PAGE}>>, sections struct<section:array<{_SECTION}>>"
)


def _unescape(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _inner(c: Column, tag: str) -> Column:
    pattern = rf"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(c.rlike(pattern), _unescape(strip(F.regexp_extract(c, pattern, 1))))


def _inner_all(c: Column, tag: str) -> Column:
    found = F.regexp_extract_all(c, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.transform(found, lambda x: _unescape(strip(x)))


def _elements_by_pattern(xml: Column, tag: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf'(?s)<{tag} id="[^"]*">.*?</{tag}>'), F.lit(0))


def _attribute(c: Column, tag: str) -> Column:
    return _unescape(F.regexp_extract(c, rf'<{tag} id="([^"]*)"', 1))


def parse_structures(responses: DataFrame) -> DataFrame:
    """Structure blocks of responses (wiki_id, response), parsed as XML; ``well_formed`` tells if that worked."""
    block = settle(responses.select("wiki_id", "response"), block=pl.wiki_block(F.col("response")))
    fixed_xml = block.filter("block IS NOT NULL").select("wiki_id", pl.repair_xml(F.col("block")).alias("xml"))
    # The corrupt-record column separates a broken document from one with absent parts.
    schema = STRUCTURE_SCHEMA + ", _broken string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    parsed = settle(fixed_xml, s=F.from_xml("xml", schema, options))
    return parsed.withColumn("well_formed", F.col("s").isNotNull() & F.col("s._broken").isNull())


def wiki_heads(structures: DataFrame) -> DataFrame:
    """Title and description per wiki."""
    ok = F.col("well_formed")
    return structures.select(
        "wiki_id",
        F.coalesce(F.when(ok, F.col("s.title")).otherwise(_inner(F.col("xml"), "title")), F.lit("")).alias("title"),
        F.coalesce(
            F.when(ok, F.col("s.description")).otherwise(_inner(F.col("xml"), "description")), F.lit("")
        ).alias("description"),
    )


def _filled(a: Column) -> Column:
    return F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")


def structure_pages(structures: DataFrame) -> DataFrame:
    """Page rows; a document that is no valid XML falls back to patterns."""
    xml = F.col("xml")
    by_xml = F.transform(
        F.col("s.pages.page"),
        lambda p: F.struct(
            p["_id"].alias("id"), p["title"].alias("title"), p["importance"].alias("importance"),
            p["relevant_files"]["file_path"].alias("file_paths"), p["related_pages"]["related"].alias("related_pages"),
        ),
    )
    by_pattern = F.transform(
        _elements_by_pattern(xml, "page"),
        lambda p: F.struct(
            _attribute(p, "page").alias("id"), _inner(p, "title").alias("title"), _inner(p, "importance").alias("importance"),
            _inner_all(p, "file_path").alias("file_paths"), _inner_all(p, "related").alias("related_pages"),
        ),
    )
    rows = structures.select(
        "wiki_id", F.posexplode(F.when(F.col("well_formed"), by_xml).otherwise(by_pattern)).alias("pos", "p")
    )
    importance = (
        F.when(F.col("p.importance").isNull(), "medium")
        .when(F.col("p.importance").isin("high", "medium"), F.col("p.importance"))
        .otherwise("low")
    )
    return rows.select(
        "wiki_id",
        "pos",
        ordinal_id(F.col("p.id"), "page", F.col("pos")).alias("id"),
        F.coalesce("p.title", F.lit("")).alias("title"),
        importance.alias("importance"),
        _filled(F.col("p.file_paths")).alias("file_paths"),
        _filled(F.col("p.related_pages")).alias("related_pages"),
    )


def structure_sections(structures: DataFrame) -> DataFrame:
    """Section rows with page and subsection references."""
    xml = F.col("xml")
    by_xml = F.transform(
        F.col("s.sections.section"),
        lambda p: F.struct(
            p["_id"].alias("id"), p["title"].alias("title"), p["pages"]["page_ref"].alias("pages"),
            p["subsections"]["section_ref"].alias("subsections"),
        ),
    )
    by_pattern = F.transform(
        _elements_by_pattern(xml, "section"),
        lambda p: F.struct(
            _attribute(p, "section").alias("id"), _inner(p, "title").alias("title"),
            _inner_all(p, "page_ref").alias("pages"), _inner_all(p, "section_ref").alias("subsections"),
        ),
    )
    rows = structures.select(
        "wiki_id", F.posexplode(F.when(F.col("well_formed"), by_xml).otherwise(by_pattern)).alias("pos", "p")
    )
    return rows.select(
        "wiki_id",
        "pos",
        ordinal_id(F.col("p.id"), "section", F.col("pos")).alias("id"),
        F.coalesce("p.title", F.lit("")).alias("title"),
        _filled(F.col("p.pages")).alias("pages"),
        _filled(F.col("p.subsections")).alias("subsections"),
    )


def ordinal_id(given: Column, kind: str, pos: Column) -> Column:
    """The given id, or ``kind-N`` by position when it is missing."""
    return F.coalesce(F.nullif(given, F.lit("")), F.concat(F.lit(kind + "-"), (pos + 1).cast("string")))


def section_refs(sections: DataFrame) -> DataFrame:
    """(wiki, parent, position, child) rows of the subsection lists."""
    return sections.select("wiki_id", F.col("id").alias("parent_id"), F.posexplode("subsections").alias("n", "id"))


def page_refs(sections: DataFrame) -> DataFrame:
    """(wiki, section, position, page) rows of the page lists."""
    return sections.select("wiki_id", F.col("id").alias("section_id"), F.posexplode("pages").alias("n", "id"))


def root_sections(sections: DataFrame, refs: DataFrame) -> DataFrame:
    """Sections that no section of the wiki lists as a subsection."""
    return sections.join(refs.select("wiki_id", "id"), ["wiki_id", "id"], "left_anti")


def section_pages(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """Page references with the pages' titles; unknown page ids are skipped."""
    return refs.join(pages.select("wiki_id", "id", "title", "importance"), ["wiki_id", "id"]).select(
        "wiki_id", "section_id", "n", F.col("id").alias("page_id"), "title", "importance"
    )


def section_tree(sections: DataFrame, refs: DataFrame) -> DataFrame:
    """Walk from the root sections: one row per visit with level, trail and position path.

    Unknown ids end a branch; a section is not entered again below itself, so the walk ends at
    any depth. Levels are joined one after the other, each checkpointed.
    """
    table = sections.select("wiki_id", "id", "title")
    cols = ["wiki_id", "id", "title", "level", "trail", "order_path"]
    level = root_sections(sections, refs).select(
        "wiki_id", "id", "title", F.lit(0).alias("level"), F.array("id").alias("trail"),
        F.array(F.col("pos").cast("long")).alias("order_path"),
    )
    level = cut_lineage(level)
    out = level
    while True:
        up = level.select("wiki_id", F.col("id").alias("parent_id"), "level", "trail", "order_path")
        below = up.join(refs, ["wiki_id", "parent_id"]).filter(~F.array_contains("trail", F.col("id")))
        level = cut_lineage(
            below.join(table, ["wiki_id", "id"]).select(
                "wiki_id", "id", "title", (F.col("level") + 1).alias("level"),
                F.array_append("trail", F.col("id")).alias("trail"),
                F.array_append("order_path", F.col("n").cast("long")).alias("order_path"),
            ).select(cols)
        )
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def with_content(pages: DataFrame, generated: DataFrame) -> DataFrame:
    """Pages with their generated content, or the standard text without one."""
    return pages.drop("content").join(generated.select("wiki_id", "id", "content"), ["wiki_id", "id"], "left").withColumn(
        "content", F.coalesce(F.nullif("content", F.lit("")), F.lit("Content not generated"))
    )


def savable_wikis(pages: DataFrame, generated: DataFrame) -> DataFrame:
    """Wikis whose pages all have content and that hold at least as many contents as pages."""
    has = F.coalesce("content", F.lit("")).isin("", "Loading...")
    joined = pages.select("wiki_id", "id").join(generated.select("wiki_id", "id", "content"), ["wiki_id", "id"], "left")
    complete = joined.groupBy("wiki_id").agg(
        F.bool_and(~has).alias("all_filled"), F.count(F.lit(1)).alias("pages")
    )
    counts = generated.groupBy("wiki_id").agg(F.count(F.lit(1)).alias("contents"))
    return complete.join(counts, "wiki_id").filter(
        F.col("all_filled") & (F.col("contents") >= F.col("pages"))
    ).select("wiki_id", "pages", "contents")


def related_titles(pages: DataFrame) -> DataFrame:
    """Per page the ``[title](#id)`` links of its related pages, in order; unknown ids are dropped."""
    refs = pages.select("wiki_id", F.col("id").alias("page_id"), F.posexplode("related_pages").alias("n", "id"))
    linked = refs.join(pages.select("wiki_id", "id", "title"), ["wiki_id", "id"])
    link = F.concat(F.lit("["), F.col("title"), F.lit("](#"), F.col("id"), F.lit(")"))
    return linked.groupBy("wiki_id", "page_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("n", link.alias("l")))), lambda x: x["l"]), ", "
        ).alias("links")
    )


def title_category(title: Column) -> Column:
    """First section category with a keyword in the title, ``other`` for none."""
    t, out = F.lower(title), None
    for name, _, words in fixed.SECTION_CATEGORIES:
        if not words:
            continue
        hit = F.lit(False)
        for w in words:
            hit = hit | t.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def _grouped_sections(pages: DataFrame, group: Column, groups: list[tuple[str, str]], part_pages: int) -> DataFrame:
    rank = {name: i for i, (name, _) in enumerate(groups)}
    names = F.create_map(*[F.lit(x) for kv in groups for x in kv])
    ranks = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    rows = pages.select("wiki_id", group.alias("g"), "pos", "id").filter("g IS NOT NULL")
    part = F.floor(F.col("pos") / part_pages)
    return (
        rows.groupBy("wiki_id", "g", part.alias("part_no"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("pages"))
        .select(
            "wiki_id", F.try_element_at(ranks, F.col("g")).alias("section_no"),
            F.concat(F.lit("section-"), F.col("g")).alias("id"), F.try_element_at(names, F.col("g")).alias("title"),
            "part_no", "pages",
        )
    )


def title_sections(pages: DataFrame, part_pages: int = 100_000) -> DataFrame:
    """Sections built from title keywords, in category order, without empty ones.

    A section's page list comes in parts by page position; a wiki of usual size has one part.
    """
    groups = [(name, title) for name, title, _ in fixed.SECTION_CATEGORIES]
    return _grouped_sections(pages, title_category(F.col("title")), groups, part_pages)


def importance_sections(pages: DataFrame, part_pages: int = 100_000) -> DataFrame:
    """Sections by importance, the fallback without title sections."""
    known = F.when(F.col("importance").isin("high", "medium", "low"), F.col("importance"))
    return _grouped_sections(pages, known, fixed.IMPORTANCE_SECTIONS, part_pages)


def first_pages(pages: DataFrame) -> DataFrame:
    """The page shown first."""
    return pages.groupBy("wiki_id").agg(F.min_by("id", "pos").alias("page_id"))


def markdown_parts(pages: DataFrame, repo_url: Column, generated_at: Column, part_pages: int = 1000) -> DataFrame:
    """Markdown export as ordered parts (wiki_id, section_no, part_no, text).

    Section 0 is the head, 1 the contents list, 2 its end, 3 the pages; the
    document is their concatenation. Parts hold at most ``part_pages`` pages.
    """
    rows = pages.withColumn("__url", repo_url).withColumn("__at", generated_at)
    head = rows.groupBy("wiki_id").agg(F.max("__url").alias("u"), F.max("__at").alias("a"))
    heads = head.select(
        "wiki_id",
        F.explode(
            F.array(
                F.struct(
                    F.lit(0).alias("section_no"),
                    F.concat(
                        F.lit("# Wiki Documentation for "), F.col("u"), F.lit("\n\nGenerated on: "), F.col("a"),
                        F.lit("\n\n## Table of Contents\n\n"),
                    ).alias("text"),
                ),
                F.struct(F.lit(2).alias("section_no"), F.lit("\n").alias("text")),
            )
        ).alias("s"),
    ).select("wiki_id", "s.section_no", F.lit(0).cast("long").alias("part_no"), "s.text")
    pos = F.col("pos")
    entry = F.concat(F.lit("- ["), F.col("title"), F.lit("](#"), F.col("id"), F.lit(")\n"))
    contents = text_parts(rows, ["wiki_id"], pos, entry, pos, "", part_pages).withColumn("section_no", F.lit(1))
    linked = rows.join(
        related_titles(pages).withColumnRenamed("page_id", "id"), ["wiki_id", "id"], "left"
    )
    related = F.when(
        F.size("related_pages") > 0,
        F.concat(
            F.lit("### Related Pages\n\n"),
            F.when(F.col("links").isNotNull(), F.concat(F.lit("Related topics: "), F.col("links"), F.lit("\n\n"))).otherwise(""),
        ),
    ).otherwise("")
    body = F.concat(
        F.lit("<a id='"), F.col("id"), F.lit("'></a>\n\n## "), F.col("title"), F.lit("\n\n"), related,
        F.col("content"), F.lit("\n\n---\n\n"),
    )
    documents = text_parts(linked, ["wiki_id"], pos, body, pos, "", part_pages).withColumn("section_no", F.lit(3))
    cols = ["wiki_id", "section_no", "part_no", "text"]
    return heads.select(cols).unionByName(contents.select(cols)).unionByName(documents.select(cols))


def json_parts(pages: DataFrame, repo_url: Column, generated_at: Column, part_pages: int = 1000) -> DataFrame:
    """JSON export: one document per wiki with metadata and pages, as ordered text fragments.

    The fragments of a wiki, one after the other by ``part_no``, are one valid document (line feeds between them do no harm); a
    wiki of usual size has a single one. A fragment holds at most ``part_pages`` pages.
    """
    rows = pages.withColumn("__url", repo_url).withColumn("__at", generated_at)
    counts = rows.groupBy("wiki_id").agg(
        F.max("__url").alias("repository"), F.max("__at").alias("generated_at"), F.count(F.lit(1)).alias("page_count"),
        F.min(F.floor(F.col("pos") / part_pages)).alias("first_part"), F.max(F.floor(F.col("pos") / part_pages)).alias("last_part"),
    )
    page = F.struct(
        F.col("pos"),
        F.struct(
            "id", "title", "content", F.col("file_paths").alias("filePaths"), "importance",
            F.col("related_pages").alias("relatedPages"),
        ).alias("p"),
    )
    parts = rows.groupBy("wiki_id", F.floor(F.col("pos") / part_pages).alias("part_no")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(page)), lambda x: F.to_json(x["p"])), ",").alias("pages")
    )
    head = F.concat(F.lit('{"metadata":'), F.to_json(F.struct("repository", "generated_at", "page_count")), F.lit(',"pages":['))
    fragment = F.concat(
        F.when(F.col("part_no") == F.col("first_part"), head).otherwise(","),
        F.col("pages"),
        F.when(F.col("part_no") == F.col("last_part"), "]}").otherwise(""),
    )
    return join_salted(parts, counts, ["wiki_id"], F.col("part_no")).select("wiki_id", "part_no", fragment.alias("json"))


def export_name(repo_url: Column, stamp: Column, extension: str) -> Column:
    """``{repo}_wiki_{stamp}.{extension}``."""
    repo = F.substring_index(F.rtrim(repo_url, F.lit("/")), "/", -1)
    return F.concat(repo, F.lit("_wiki_"), stamp, F.lit("." + extension))


MAX_CHOSEN = 2_000_000  # chosen pages that travel to the pages; more are joined by a shuffle


def budget_context(pages: DataFrame, budget: int = fixed.WIKI_CONTEXT_CHARS) -> DataFrame:
    """Wiki text within a character budget, one row per wiki.

    High-importance pages come first, until the budget is exceeded; if it is not,
    the others follow, each as its first paragraph when the full text would not fit.

    Pages are chosen by the lengths of their texts alone. A page adds at least the characters of its frame, so no more than
    ``budget / frame + 2`` pages of each group can be reached, and none whose predecessors alone exceed the budget; only the lengths of those are
    gathered. Contents are fetched for the chosen pages, a list of bounded length per wiki, which goes to the pages and not they to it.
    """
    frame = len("## \n\n\n")
    reach = budget // frame + 2
    is_high = F.col("importance") == "high"
    filled = pages.filter(F.coalesce("content", F.lit("")) != "").withColumn(
        "phase", F.when(is_high, 0).otherwise(1)
    )
    high = F.col("phase") == 0
    head = F.length("title") + frame
    lengths = filled.select(
        "wiki_id", "phase", "pos", (head + F.length("content")).alias("full"), (head + F.length(tx.first_paragraph(F.col("content")))).alias("short")
    )
    w = Window.partitionBy("wiki_id", "phase").orderBy("pos")
    near = number_rows(lengths, ["wiki_id", "phase"], ["pos"], "r").filter(F.col("r") < reach)
    least = F.when(high, F.col("full")).otherwise(F.least("full", "short"))
    before = F.sum(least).over(w.rowsBetween(Window.unboundedPreceding, -1))
    near = near.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") <= budget)
    gathered = near.groupBy("wiki_id").agg(F.array_sort(F.collect_list(F.struct("phase", "pos", "full", "short"))).alias("items"))

    picks = "array<struct<phase:int,pos:bigint,whole:boolean>>"
    start = F.struct(
        F.lit(0).alias("used"),
        F.lit(False).alias("entered"),
        F.lit(False).alias("stopped"),
        F.array().cast(picks).alias("picks"),
    )
    limit = F.lit(budget)

    def step(acc: Column, x: Column) -> Column:
        first = x["phase"] == 0
        closed = acc["stopped"] | (~acc["entered"] & (acc["used"] >= limit))
        skip = F.when(first, acc["used"] > limit).otherwise(closed)
        fits = first | (acc["used"] + x["full"] <= limit)
        used = acc["used"] + F.when(fits, x["full"]).otherwise(x["short"])
        pick = F.struct(x["phase"].alias("phase"), x["pos"].cast("long").alias("pos"), fits.alias("whole"))
        added = F.struct(
            used.alias("used"),
            (~first).alias("entered"),
            (~first & (used > limit)).alias("stopped"),
            F.array_append(acc["picks"], pick).cast(picks).alias("picks"),
        )
        return F.when(skip, acc).otherwise(added)

    decided = cut_lineage(gathered.select(F.col("wiki_id").alias("w"), F.aggregate("items", start, step).alias("d")))
    chosen = decided.select("w", F.inline("d.picks"))
    few = (decided.agg(F.sum(F.size("d.picks"))).first()[0] or 0) <= MAX_CHOSEN
    same = filled["wiki_id"].eqNullSafe(chosen["w"]) & (filled["phase"] == chosen["phase"]) & (filled["pos"] == chosen["pos"])
    texts = filled.join(F.broadcast(chosen) if few else chosen, same).select(
        filled["wiki_id"],
        F.struct(
            filled["phase"],
            filled["pos"],
            F.concat(
                F.lit("## "), F.col("title"), F.lit("\n"), F.when(F.col("whole"), F.col("content")).otherwise(tx.first_paragraph(F.col("content"))), F.lit("\n\n")
            ).alias("text"),
        ).alias("t"),
    )
    contexts = texts.groupBy("wiki_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["text"]), "").alias("c"))
    return decided.join(contexts, F.col("w").eqNullSafe(contexts["wiki_id"]), "left").select(
        F.col("w").alias("wiki_id"), F.coalesce("c", F.lit("")).alias("context"), F.col("d.used").cast("long").alias("used")
    )
