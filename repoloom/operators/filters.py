"""File filters, classification and gates."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.functions import fixed
from repoloom.functions.literals import literal_list
from repoloom.functions.paths import extension, file_name
from repoloom.functions.text import token_estimate


def clean_dir(name: str, compat: bool = False) -> str:
    """Directory name behind a list entry.

    ``compat`` strips the characters ``.`` and ``/`` from both ends, so
    ``./.venv/`` stands for ``venv``; the default only drops a leading ``./``.
    """
    if compat:
        return name.strip("./").rstrip("/")
    return (name[2:] if name.startswith("./") else name).rstrip("/")


def merged_list(*lists: Iterable[str] | None) -> list[str]:
    """Union of several lists, first position kept."""
    return list(dict.fromkeys(x for part in lists for x in (part or [])))


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def in_dirs(path: Column, dirs: Iterable[str], compat: bool = False) -> Column:
    """True when any path part equals one of the directory names."""
    names = sorted({clean_dir(d, compat) for d in dirs})
    if not names:
        return F.lit(False)
    return F.arrays_overlap(_parts(path), literal_list(names))


def glob_regex(pattern: str) -> str:
    """``*`` matches within one path part."""
    return "[^/]*".join(re.escape(p) for p in pattern.split("*"))


def excluded_name(path: Column, patterns: Iterable[str], compat: bool = False) -> Column:
    """True when the file is named on the list; ``compat`` compares wildcard entries literally."""
    patterns = list(patterns)
    exact = patterns if compat else [p for p in patterns if "*" not in p]
    cond = file_name(path).isin(exact) if exact else F.lit(False)
    if compat:
        return cond
    names = [glob_regex(p) for p in patterns if "*" in p and "/" not in p]
    nested = [glob_regex(p) for p in patterns if "*" in p and "/" in p]
    if names:
        cond = cond | file_name(path).rlike(r"\A(?:" + "|".join(names) + r")\z")
    if nested:
        cond = cond | path.rlike(r"(?:\A|/)(?:" + "|".join(nested) + r")(?:/|\z)")
    return cond


def keep_path(
    path: Column,
    excluded_dirs: Iterable[str] | None = None,
    excluded_files: Iterable[str] | None = None,
    included_dirs: Iterable[str] | None = None,
    included_files: Iterable[str] | None = None,
    compat: bool = False,
) -> Column:
    """The path filter: any inclusion list switches all exclusions off."""
    included_dirs, included_files = list(included_dirs or []), list(included_files or [])
    if included_dirs or included_files:
        name = file_name(path)
        by_name = F.lit(False)
        for p in included_files:
            by_name = by_name | name.endswith(p)
        return in_dirs(path, included_dirs, compat) | by_name
    dirs = merged_list(fixed.EXCLUDED_DIRS, excluded_dirs)
    names = merged_list(fixed.EXCLUDED_FILES, excluded_files)
    return ~(in_dirs(path, dirs, compat) | excluded_name(path, names, compat))


def classify(files: DataFrame, path: str = "path") -> DataFrame:
    """Keep files with a known extension; add type, is_code, is_implementation and title."""
    ext, p = extension(F.col(path)), F.col(path)
    is_code = ext.isin(fixed.CODE_EXTENSIONS)
    implementation = (
        is_code & ~p.startswith("test_") & ~p.startswith("app_") & ~F.lower(p).contains("test")
    )
    return files.filter(ext.isin(fixed.CODE_EXTENSIONS + fixed.DOC_EXTENSIONS)).select(
        "*",
        F.substr(ext, F.lit(2)).alias("type"),
        is_code.alias("is_code"),
        implementation.alias("is_implementation"),
        p.alias("title"),
    )


def size_gate(
    files: DataFrame,
    tokens: Column,
    code_limit: int = fixed.CODE_TOKEN_LIMIT,
    doc_limit: int = fixed.DOC_TOKEN_LIMIT,
) -> DataFrame:
    """Drop files above the token limit of their class."""
    limit = F.when(F.col("is_code"), F.lit(code_limit)).otherwise(F.lit(doc_limit))
    return files.withColumn("token_count", tokens).filter(F.col("token_count") <= limit)


def visible_in_tree(path: Column) -> Column:
    """False for hidden, cache and package files of the repository tree."""
    parts = _parts(path)
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    name = file_name(path)
    hidden_dir = F.exists(dirs, lambda d: d.startswith(".") | d.isin(fixed.TREE_HIDDEN_DIRS))
    return ~hidden_dir & ~name.startswith(".") & ~name.isin(fixed.TREE_HIDDEN_FILES)


def search_projects(projects: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring search over name, owner, repo and repo_type; a blank query keeps all."""
    if not query.strip():
        return projects
    q = F.lit(query.lower())
    cond = F.lit(False)
    for c in ("name", "owner", "repo", "repo_type"):
        cond = cond | F.lower(F.col(c)).contains(q)
    return projects.filter(cond)


def size_route(
    chars: Column, limit: int = fixed.CALL_CHAIN_BYTES_LIMIT, within: str = "whole", beyond: str = "similarity_search"
) -> Column:
    """Route of a record by its size."""
    return F.when(chars > limit, beyond).otherwise(within)


def question_too_large(question: Column, limit: int = fixed.SOCKET_QUESTION_TOKENS, tokens=token_estimate) -> Column:
    """True when retrieval is skipped because the question exceeds the token limit."""
    return F.coalesce(tokens(question) > limit, F.lit(False))
