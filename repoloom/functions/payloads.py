"""JSON and XML payload expressions: host listings, file contents, model responses, wiki structures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoloom.functions import fixed
from repoloom.functions import text as tx
from repoloom.functions.paths import strip


def json_texts(c: Column) -> Column:
    """Texts of a JSON list or object: the ``text`` field, else the item itself as JSON."""
    items = F.from_json(c, "array<string>")
    as_list = F.when(strip(c).startswith("["), items).otherwise(F.array(c))
    return F.transform(as_list, lambda x: F.coalesce(F.get_json_object(x, "$.text"), x))


def listed_files(c: Column) -> Column:
    """File paths of a host's tree listing, in listing order."""
    tree = F.from_json(c, "tree array<struct<type:string,path:string>>")["tree"]
    values = F.from_json(c, "values array<struct<type:string,path:string>>")["values"]
    rows = F.coalesce(tree, values, F.from_json(c, "array<struct<type:string,path:string>>"))
    return F.transform(F.filter(rows, lambda r: r["type"].isin("blob", "commit_file")), lambda r: r["path"])


def file_payload(c: Column) -> Column:
    """Struct(text, error) of a host's file answer: error object, base64 content, or an unknown form."""
    message = F.get_json_object(c, "$.message")
    encoding = F.get_json_object(c, "$.encoding")
    content = F.get_json_object(c, "$.content")
    bytes_ = F.try_to_binary(F.replace(content, F.lit("\n"), F.lit("")), F.lit("base64"))
    is_error = message.isNotNull() & F.get_json_object(c, "$.documentation_url").isNotNull()
    error = (
        F.when(is_error, F.concat(F.lit("host error: "), message))
        .when(content.isNull() | encoding.isNull(), "content not found")
        .when(encoding != "base64", F.concat(F.lit("unexpected encoding: "), encoding))
        .when(bytes_.isNull(), "invalid base64")
        .when(~F.is_valid_utf8(bytes_.cast("string")), "invalid utf-8")
    )
    return F.struct(F.when(error.isNull(), F.try_validate_utf8(bytes_.cast("string"))).alias("text"), error.alias("error"))


def usage_totals(c: Column) -> Column:
    """Struct(prompt_tokens, completion_tokens, total_tokens) of a response; nulls when absent."""
    return F.from_json(c, "usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>")["usage"]


def model_provider(model_id: Column) -> Column:
    """First part of a dotted model id, ``amazon`` without a dot."""
    return F.when(model_id.contains("."), F.substring_index(model_id, ".", 1)).otherwise("amazon")


def response_text(provider: Column, c: Column) -> Column:
    """Generated text of a provider's response object."""
    other = F.coalesce(*[F.get_json_object(c, f"$.{k}") for k in fixed.RESPONSE_KEYS], c)
    out = None
    for name, (key, path) in fixed.RESPONSE_PATHS.items():
        value = F.coalesce(F.get_json_object(c, f"$.{key}[0].{path}"), F.lit(""))
        out = F.when(provider == name, value) if out is None else out.when(provider == name, value)
    return out.otherwise(other)


def token_logprobs(c: Column) -> Column:
    """Array of choices, each an array of struct(token, logprob)."""
    parsed = F.from_json(
        c, "choices array<struct<logprobs:struct<content:array<struct<token:string,logprob:double>>>>>"
    )["choices"]
    return F.transform(parsed, lambda x: x["logprobs"]["content"])


def wiki_block(c: Column) -> Column:
    """First wiki-structure block of a response without fences and control characters; null when absent."""
    body = F.regexp_extract(tx.drop_fences(c, "xml"), r"(?s)<wiki_structure>.*?</wiki_structure>", 0)
    return F.nullif(tx.drop_control(body), F.lit(""))


def repair_xml(c: Column) -> Column:
    """Escape bare ampersands and close up loose tag ends."""
    escaped = F.regexp_replace(strip(c), r"&(?!amp;|lt;|gt;|apos;|quot;)", "&amp;")
    return F.replace(escaped, F.lit("  >"), F.lit(">"))
