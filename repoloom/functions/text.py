"""Text and Markdown expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoloom.functions import fixed
from repoloom.functions.literals import bound, literal_map
from repoloom.functions.paths import strip


def _has(c: Column, *phrases: str) -> Column:
    cond = F.lit(False)
    for p in phrases:
        cond = cond | c.contains(p)
    return cond


def drop_fences(c: Column, language: str) -> Column:
    """Remove an opening fence (with or without the language name) and a closing fence."""
    return F.regexp_replace(F.regexp_replace(c, rf"(?i)\A```(?:{language})?\s*", ""), r"```\s*\z", "")


def drop_fences_exact(c: Column, language: str) -> Column:
    """Remove an opening fence that names the language and a closing fence."""
    return F.regexp_replace(F.regexp_replace(c, rf"(?i)\A```{language}\s*", ""), r"```\s*\z", "")


def drop_control(c: Column) -> Column:
    """Remove control characters other than tab, line feed and carriage return."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def is_metadata_piece(c: Column) -> Column:
    return c.startswith("model=") | c.startswith("created_at=")


def clean_piece(c: Column) -> Column:
    """Remove thinking tags from a stream piece."""
    return F.replace(F.replace(c, F.lit("<think>"), F.lit("")), F.lit("</think>"), F.lit(""))


def headings(c: Column) -> Column:
    """Second-level headings in order."""
    return F.regexp_extract_all(c, F.lit(r"(?m)^## (.*)$"), F.lit(1))


def slug(c: Column) -> Column:
    """Link form of a heading."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\w\s-]", ""), r"\s+", "-")


def contents_list(c: Column) -> Column:
    lines = F.transform(headings(c), lambda h: F.concat(F.lit("- ["), h, F.lit("](#"), slug(h), F.lit(")\n")))
    return F.concat(F.lit("## Table of Contents\n\n"), F.array_join(lines, ""), F.lit("\n"))


def insert_contents(c: Column) -> Column:
    """Insert a contents list before the first second-level heading after the title."""
    intro = F.locate("# ", c)
    # Positions are 1-based: the search starts one past the title mark.
    at = _locate_from("## ", c, intro + 1)
    wanted = (
        ~_has(c, "## Table of Contents", "## Contents") & (F.size(headings(c)) > 0) & (at - 1 > intro)
    )
    return F.when(wanted, F.concat(F.substr(c, F.lit(1), at - 1), contents_list(c), F.substr(c, at))).otherwise(c)


def _locate_from(mark: str, c: Column, start: Column) -> Column:
    """1-based position of ``mark`` at or after ``start``; 0 when absent."""
    tail = F.locate(mark, F.substr(c, start))
    return F.when(tail > 0, tail + start - 1).otherwise(0)


def insert_after_line(c: Column, line_start: Column, note: Column) -> Column:
    """Insert ``note`` after the line in which ``line_start`` first occurs; unchanged without a line end."""
    at = F.instr(c, line_start)
    end = _locate_from("\n", c, F.greatest(at, F.lit(1)))
    return F.when(
        (at > 0) & (end > 0), F.concat(F.substr(c, F.lit(1), end), note, F.substr(c, end + 1))
    ).otherwise(c)


def insert_project_note(c: Column) -> Column:
    """Insert the time note after the final-project heading."""
    note = F.lit(fixed.NOTE_OPEN + fixed.PROJECT_NOTE + fixed.NOTE_CLOSE)
    return F.when(c.rlike(r"(?m)^## Final Project"), insert_after_line(c, F.lit("## Final Project"), note)).otherwise(c)


def exercise_headings(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?m)^## Exercise \d+:"), F.lit(0))


def exercise_minutes(index: Column, total: Column) -> Column:
    """Time estimate of the exercise with 0-based ``index``."""
    return (
        F.when(index == 0, 5).when(index == total - 1, 15).when(index > F.floor(total / 2), 12).otherwise(10)
    )


def annotate_exercises(c: Column) -> Column:
    """Insert a progress line after each exercise heading."""
    def annotated(found: Column) -> Column:
        total = F.size(found)
        items = F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def step(acc: Column, x: Column) -> Column:
            note = F.concat(
                F.lit(fixed.NOTE_OPEN + "Exercise "), (x["i"] + 1).cast("string"), F.lit("/"), total.cast("string"),
                F.lit(" | about "), exercise_minutes(x["i"], total).cast("string"), F.lit(" min" + fixed.NOTE_CLOSE),
            )
            return insert_after_line(acc, x["h"], note)

        return F.aggregate(items, c, step)

    # The pattern runs over the text once, not once more for every heading.
    return bound(exercise_headings(c), annotated)


def first_paragraph(c: Column) -> Column:
    """First single-line paragraph after a heading, or the default text."""
    pattern = r"# .*?\n\n(.*?)(?:\n\n|\z)"
    return F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, 1))).otherwise("No summary available")


def slide_items(c: Column, repo: Column) -> Column:
    """Slide plan lines: four list forms tried in order, then seven default slides."""
    dotted = F.regexp_extract_all(c, F.lit(r"\d+\.\s+(.*?)(?=\n\d+\.|\n*\z)"), F.lit(1))
    bracketed = F.regexp_extract_all(c, F.lit(r"\d+\)\s+(.*?)(?=\n\d+\)|\n*\z)"), F.lit(1))
    named = F.regexp_extract_all(c, F.lit(r"(?i)Slide\s+\d+\s*:?\s*(.*?)(?=\nSlide|\n*\z)"), F.lit(1))
    plain = F.filter(
        F.regexp_extract_all(c, F.lit(r"(?m)^([^:\n]+)(?::\s*(.*?))?$"), F.lit(1)),
        lambda t: (F.length(t) > 3) & ~F.lower(t).contains("please") & ~F.lower(t).contains("here"),
    )
    defaults = F.array(*[F.replace(F.lit(s), F.lit("{repo}"), repo) for s in fixed.DEFAULT_SLIDES])

    def if_any(a: Column) -> Column:
        return F.when(F.size(a) > 0, a)

    return F.coalesce(if_any(dotted), if_any(bracketed), if_any(named), if_any(plain), defaults)


def slide_title(item: Column) -> Column:
    return strip(F.get(F.split(item, ":"), 0))


def slide_description(item: Column) -> Column:
    return F.coalesce(strip(F.get(F.split(item, ":"), 1)), F.lit(""))


# Stand-in layout for slides without own styling: heading beside the body.
SLIDE_WRAPPER = (
    '<section class="page"><header><h1>{title}</h1></header><main>{body}</main></section>\n<style></style>'
)


def slide_html(c: Column, title: Column, wrapper: str = SLIDE_WRAPPER) -> Column:
    """HTML of a slide response: fenced block, slide element, first tag pair, or the raw text; then wrapped."""
    fence = r"(?s)```(?:html)?\s*(.*?)\s*```"
    block = r'(?s)<div class="slide".*?</div>\s*</div>'
    first_tag = F.regexp_extract(F.regexp_extract(c, r"(?s)<.*?>", 0), r"(?i)<([a-z][a-z0-9]*)", 1)
    pair_pattern = F.concat(F.lit("(?is)<"), first_tag, F.lit(".*?</"), first_tag, F.lit(">"))
    pair = F.when(first_tag != "", F.regexp_substr(c, pair_pattern))
    found = (
        F.when(c.rlike(fence), F.regexp_extract(c, fence, 1))
        .when(c.contains('<div class="slide"'), F.regexp_extract(c, block, 0))
        .when(c.contains("<") & c.contains(">"), pair)
    )
    html = F.coalesce(F.nullif(found, F.lit("")), c)
    styled = html.contains("<style>") | html.contains('<link rel="stylesheet"')
    head, rest = wrapper.split("{title}")
    middle, tail = rest.split("{body}")
    return F.when(styled, html).otherwise(F.concat(F.lit(head), title, F.lit(middle), html, F.lit(tail)))


def research_stage(c: Column, iteration: Column) -> Column:
    """Struct(title, type) of a research answer; null when it shows no stage."""
    update = F.concat(F.lit("Research Update "), iteration.cast("string"))
    return (
        F.when(
            (iteration == 1) & c.contains("## Research Plan"),
            F.struct(F.lit("Research Plan").alias("title"), F.lit("plan").alias("type")),
        )
        .when(
            iteration.between(1, 4) & c.contains(F.concat(F.lit("## "), update)),
            F.struct(update.alias("title"), F.lit("update").alias("type")),
        )
        .when(
            c.contains("## Final Conclusion"),
            F.struct(F.lit("Final Conclusion").alias("title"), F.lit("conclusion").alias("type")),
        )
    )


def research_complete(c: Column) -> Column:
    """True when an answer announces the end of the research."""
    closing = _has(c, *fixed.CLOSING_HEADINGS) & ~_has(c, *fixed.CLOSING_DENIALS)
    phrases = _has(c, *fixed.CLOSING_PHRASES) | (c.contains("Final") & c.contains("Conclusion"))
    topic = (
        c.contains("Dockerfile") & _has(c, *fixed.TOPIC_PHRASES) & ~_has(c, *fixed.TOPIC_DENIALS)
    )
    return c.contains("## Final Conclusion") | closing | phrases | topic


def with_completion_note(c: Column, iteration: Column) -> Column:
    """Append the closing note when the last iteration ends without a conclusion."""
    forced = (iteration >= fixed.FINAL_ITERATION) & ~research_complete(c)
    return F.when(forced, F.concat(c, F.lit(fixed.COMPLETION_NOTE))).otherwise(c)


def retrieval_query(question: Column, path: Column) -> Column:
    """Search text of a question: the named file when there is one."""
    named = F.coalesce(path, F.lit("")) != ""
    return F.when(named, F.concat(F.lit("Contexts related to "), path)).otherwise(question)


def token_estimate(c: Column) -> Column:
    """A quarter of the character count."""
    return F.floor(F.length(c) / 4).cast("long")


def word_count(c: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.when(strip(c) == "", 0).otherwise(F.size(F.split(strip(c), r"(?U)\s+"))).cast("long")


def js_return_type(name: Column) -> Column:
    """Return type guessed from a JavaScript function's name."""
    def starts(*prefixes: str) -> Column:
        cond = F.lit(False)
        for p in prefixes:
            cond = cond | name.startswith(p)
        return cond

    return (
        F.when(starts("get", "is", "has"), "boolean")
        .when(starts("create", "make"), "object")
        .when(starts("calculate", "compute"), "number")
        .when(name.startswith("to") & (F.length(name) > 2), F.lower(F.substr(name, F.lit(3))))
        .otherwise("any")
    )


def response_error(c: Column) -> Column:
    """Known error texts that reject a response; null for a usable one."""
    missing_key = c.contains("Error preparing retriever: Environment variable OPENAI_API_KEY must be set")
    missing_model = c.contains("Ollama model") & c.contains("not found")
    return F.when(missing_key, "missing_api_key").when(missing_model, "missing_model")


def language_name(code: Column) -> Column:
    """Display name of a language code, ``English`` for unknown ones."""
    return F.coalesce(F.try_element_at(literal_map(fixed.LANGUAGE_NAMES), code), F.lit("English"))


def known_language(code: Column) -> Column:
    """The code when supported, the default language otherwise."""
    return F.when(code.isin(list(fixed.LANGUAGE_NAMES)), code).otherwise(fixed.DEFAULT_LANGUAGE)
