"""URL, repository-name and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoloom.functions import fixed
from repoloom.functions.literals import bound, literal_map

def strip(c: Column, chars: str = fixed.PY_WHITESPACE) -> Column:
    """Trim a set of characters on both sides."""
    return F.btrim(c, F.lit(chars))


def _drop_git(c: Column) -> Column:
    return F.replace(c, F.lit(".git"), F.lit(""))


def _drop_git_suffix(c: Column) -> Column:
    return F.regexp_replace(c, r"\.git\z", "")


def after_first(c: Column, mark: str) -> Column:
    """Text after the first ``mark``; null when it is absent."""
    at = F.locate(mark, c)
    return F.when(at > 0, F.substr(c, at + F.lit(len(mark))))


def before_first(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, 1)


def repo_name(url: Column, kind: Column) -> Column:
    """``owner_repo`` for a hosted URL, else the last path part; ``.git`` removed."""
    parts = F.split(F.rtrim(url, F.lit("/")), "/")
    last = _drop_git(F.try_element_at(parts, F.lit(-1)))
    owner = F.try_element_at(parts, F.lit(-2))
    hosted = kind.isin(fixed.HOST_TYPES) & (F.size(parts) >= 5)
    return F.when(hosted, F.concat_ws("_", owner, last)).otherwise(last)


def owner_repo(url: Column, compat: bool = False) -> Column:
    """Struct(name, error) for ssh addresses, scheme URLs and ``owner/repo``.

    ``compat`` trims the characters of ``.git`` from the end of ssh paths
    instead of the suffix.
    """
    return bound(strip(url), lambda s: _owner_repo(s, compat))


def _owner_repo(s: Column, compat: bool) -> Column:
    is_ssh = s.startswith("git@")
    is_url = s.contains("://")

    ssh_host = before_first(s, ":")
    ssh_path = after_first(s, ":")
    ssh_path = F.rtrim(ssh_path, F.lit(".git")) if compat else _drop_git_suffix(ssh_path)
    ssh_ok_host = ssh_host.rlike(r"(?:github\.com|gitlab\.com|bitbucket\.org)\z")

    host = F.regexp_extract(s, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    url_path = _drop_git_suffix(F.btrim(F.regexp_extract(s, r"^[^:]*://[^/?#]*([^?#]*)", 1), F.lit("/")))
    url_parts = F.split(url_path, "/")

    plain = _drop_git_suffix(s)
    plain_owner, plain_repo = before_first(plain, "/"), after_first(plain, "/")

    error = (
        F.when(is_ssh & ~s.contains(":"), "invalid ssh address")
        .when(is_ssh & ~ssh_ok_host, "unsupported host")
        .when(is_ssh & ~ssh_path.contains("/"), "owner/repo expected")
        .when(is_ssh, F.lit(None).cast("string"))
        .when(is_url & (host == ""), "no host")
        .when(is_url & ~host.isin(fixed.HOSTS), "unsupported host")
        .when(is_url & (F.size(url_parts) < 2), "owner or repo not found")
        .when(is_url, F.lit(None).cast("string"))
        .when(~s.contains("/"), "owner/repo expected")
        .when((plain_owner == "") | (F.coalesce(plain_repo, F.lit("")) == ""), "owner or repo is empty")
    )
    name = (
        F.when(is_ssh, F.concat_ws("_", before_first(ssh_path, "/"), after_first(ssh_path, "/")))
        .when(is_url, F.concat_ws("_", F.get(url_parts, 0), F.get(url_parts, 1)))
        .otherwise(F.concat_ws("_", plain_owner, plain_repo))
    )
    return F.struct(F.when(error.isNull(), name).alias("name"), error.alias("error"))


def url_domain(s: Column) -> Column:
    """Scheme, host and a non-default port; null for text that is no URL."""
    return bound(_with_scheme(s), _domain)


def _with_scheme(s: Column) -> Column:
    return F.when(s.startswith("http"), s).otherwise(F.concat(F.lit("https://"), s))


def _domain(u: Column) -> Column:
    pattern = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:@\s]+)(?::(\d+))?(?:[/?#]|\z)"
    scheme = F.lower(F.regexp_extract(u, pattern, 1))
    host = F.lower(F.regexp_extract(u, pattern, 2))
    port = F.regexp_extract(u, pattern, 3)
    default = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    tail = F.when((port == "") | default, "").otherwise(F.concat(F.lit(":"), port))
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, tail))


def url_path(s: Column) -> Column:
    """Path without one leading and one trailing slash; null for text that is no URL."""
    path = F.regexp_extract(_with_scheme(s), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(url_domain(s).isNotNull(), F.regexp_replace(path, r"^/|/\z", ""))


def repository_input(text: Column) -> Column:
    """Struct(owner, repo, type, full_path, local_path) for a typed-in path or URL; null when unusable."""
    def parse(s: Column) -> Column:
        site = F.struct(url_domain(s).alias("domain"), _drop_git_suffix(url_path(s)).alias("path"))
        return bound(site, lambda u: _repository_input(s, u["domain"], u["path"], F.split(u["path"], "/")))

    return bound(strip(text), parse)


def _repository_input(s: Column, domain: Column, full: Column, parts: Column) -> Column:
    windows = s.rlike(r"^[a-zA-Z]:\\(?:[^\\/:*?\"<>|\r\n]+\\)*[^\\/:*?\"<>|\r\n]*\z")
    unix = s.startswith("/")
    web = s.rlike(r"^(?:https?://)?([^/]+)/(.+?)/([^/]+)(?:\.git)?/?\z")
    local = windows | unix
    web_repo = strip(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")))
    web_owner = strip(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")))
    web_type = (
        F.when(domain.contains("github.com"), "github")
        .when(domain.contains("gitlab.com") | domain.contains("gitlab."), "gitlab")
        .when(domain.contains("bitbucket.org") | domain.contains("bitbucket."), "bitbucket")
        .otherwise("web")
    )
    local_name = F.when(windows, F.regexp_extract(s, r"([^\\]*)\z", 1)).otherwise(F.regexp_extract(s, r"([^/]+)/*\z", 1))
    repo = F.when(local, F.coalesce(F.nullif(local_name, F.lit("")), F.lit("local-repo"))).otherwise(web_repo)
    usable = local | (web & (F.size(parts) >= 2) & (web_repo != "") & (web_owner != ""))
    return F.when(
        usable,
        F.struct(
            F.when(local, "local").otherwise(web_owner).alias("owner"),
            _drop_git_suffix(repo).alias("repo"),
            F.when(local, "local").otherwise(web_type).alias("type"),
            F.when(~local, full).alias("full_path"),
            F.when(local, s).alias("local_path"),
        ),
    )


def repo_type(url: Column, given: Column | None = None) -> Column:
    """Host type from the URL text; otherwise the given type or ``github``."""
    other = F.lit("github") if given is None else F.coalesce(F.nullif(given, F.lit("")), F.lit("github"))
    return (
        F.when(url.contains("bitbucket.org"), "bitbucket")
        .when(url.contains("gitlab.com"), "gitlab")
        .when(url.contains("github.com"), "github")
        .otherwise(other)
    )


def display_url(kind: Column, local_path: Column, url: Column, owner: Column, repo: Column) -> Column:
    """Local path, stored URL, or a placeholder address built from owner and repo."""
    def filled(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) != ""

    return (
        F.when((kind == "local") & filled(local_path), local_path)
        .when(filled(url), url)
        .when(filled(owner) & filled(repo), F.concat(F.lit("http://example/"), owner, F.lit("/"), repo))
        .otherwise("")
    )


def file_url(kind: Column, url: Column, branch: Column, path: Column) -> Column:
    """Web address of a file on the host that serves ``url``; the bare path when unknown."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@\s]+)", 1))
    return (
        F.when((kind == "local") | url.isNull() | (url == ""), path)
        .when(host.contains("github"), F.concat(url, F.lit("/blob/"), branch, F.lit("/"), path))
        .when(host.contains("gitlab"), F.concat(url, F.lit("/-/blob/"), branch, F.lit("/"), path))
        .when(host.contains("bitbucket"), F.concat(url, F.lit("/src/"), branch, F.lit("/"), path))
        .otherwise(path)
    )


def percent_encode(c: Column) -> Column:
    """Percent-encode everything but letters, digits and ``_.-~``."""
    e = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def percent_decode(c: Column) -> Column:
    """Percent-decode; ``+`` stays and broken escapes leave the text as it is."""
    kept = F.replace(c, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(kept), c)


def content_api_url(kind: Column, url: Column, path: Column, branch: Column) -> Column:
    """Address of a file's content on the host's API; null when the URL lacks owner and repository."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)
    trimmed = F.btrim(F.regexp_extract(url, r"^[^:]*://[^/?#]*([^?#]*)", 1), F.lit("/"))
    parts = F.split(trimmed, "/")
    owner = F.try_element_at(parts, F.lit(-2))
    repo = _drop_git(F.try_element_at(parts, F.lit(-1)))
    root = F.concat(scheme, F.lit("://"), host)
    github = F.concat(
        F.when(host == "github.com", "https://api.github.com").otherwise(F.concat(root, F.lit("/api/v3"))),
        F.lit("/repos/"), owner, F.lit("/"), repo, F.lit("/contents/"), path,
    )
    gitlab = F.concat(
        root, F.lit("/api/v4/projects/"), percent_encode(_drop_git(trimmed)),
        F.lit("/repository/files/"), percent_encode(path), F.lit("/raw?ref="), branch,
    )
    raw = F.split(F.rtrim(url, F.lit("/")), "/")
    bitbucket = F.concat(
        F.lit("https://api.bitbucket.org/2.0/repositories/"),
        F.try_element_at(raw, F.lit(-2)), F.lit("/"), _drop_git(F.try_element_at(raw, F.lit(-1))),
        F.lit("/src/"), branch, F.lit("/"), path,
    )
    hosted = (host != "") & (F.size(parts) >= 2)
    return (
        F.when((kind == "github") & hosted, github)
        .when((kind == "gitlab") & hosted, gitlab)
        .when((kind == "bitbucket") & (F.size(raw) >= 5), bitbucket)
    )


def filter_list(c: Column) -> Column:
    """Newline-separated, percent-encoded list -> array without blank entries."""
    kept = F.filter(F.split(c, "\n"), lambda x: strip(x) != "")
    return F.when(F.coalesce(c, F.lit("")) != "", F.transform(kept, percent_decode))


def store_name(kind: Column, owner: Column, repo: Column, language: Column, prefix: str = "wiki_cache_") -> Column:
    """File name of a stored wiki."""
    return F.concat(F.lit(prefix), kind, F.lit("_"), owner, F.lit("_"), repo, F.lit("_"), language, F.lit(".json"))


def parse_store_name(name: Column, prefix: str = "wiki_cache_") -> Column:
    """Struct(repo_type, owner, repo, language) of a stored wiki's file name; null for other names.

    The repository keeps its underscores; an owner with one is split at it.
    """
    body = F.replace(F.replace(name, F.lit(prefix), F.lit("")), F.lit(".json"), F.lit(""))
    parts = F.split(body, "_")
    ok = name.startswith(prefix) & name.endswith(".json") & (F.size(parts) >= 4)
    return F.when(
        ok,
        F.struct(
            F.get(parts, 0).alias("repo_type"),
            F.get(parts, 1).alias("owner"),
            # The length is clamped because branches of a conditional may be evaluated eagerly.
            F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 3, F.lit(0))), "_").alias("repo"),
            F.try_element_at(parts, F.lit(-1)).alias("language"),
        ),
    )


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Extension with its dot; empty for names without one or with leading dots only."""
    return F.regexp_extract(file_name(path), r"^\.*[^.].*?(\.[^.]*)\z", 1)


def relative_path(path: Column, root: Column) -> Column:
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, base), F.substr(path, F.length(base) + 1)).otherwise(path)


def language_of(path: Column) -> Column:
    """Parser language by case-folded extension, ``unknown`` otherwise."""
    languages = literal_map(fixed.LANGUAGE_BY_EXTENSION)
    return F.coalesce(F.try_element_at(languages, F.lower(extension(path))), F.lit("unknown"))


def branch_candidates(named: Column) -> Column:
    """Branches to try in order: the named one, then the usual ones; a null name is left out."""
    return F.array_distinct(F.array_compact(F.array(named, F.lit("main"), F.lit("master"))))
