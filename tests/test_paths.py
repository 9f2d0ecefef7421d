from pyspark.sql import functions as F

from repoloom.functions import paths

# url, type, expected name
REPO_NAMES = [
    ("https://github.com/owner/repo", "github", "owner_repo"),
    ("https://github.com/owner/repo.git", "github", "owner_repo"),
    ("https://github.com/owner/repo/", "github", "owner_repo"),
    ("https://gitlab.com/owner/repo", "gitlab", "owner_repo"),
    ("https://gitlab.com/group/subgroup/repo", "gitlab", "subgroup_repo"),
    ("https://bitbucket.org/owner/repo", "bitbucket", "owner_repo"),
    ("/home/user/projects/my-repo", "local", "my-repo"),
    ("/var/repos/project.git", "local", "project"),
    ("https://github.com/repo", "github", "repo"),
    ("my-repo", "local", "my-repo"),
]


def test_repo_name(spark):
    df = spark.createDataFrame(REPO_NAMES, "url string, kind string, expected string")
    got = df.select("url", "expected", paths.repo_name(F.col("url"), F.col("kind")).alias("name")).collect()
    assert [(r.url, r.name) for r in got] == [(r.url, r.expected) for r in got]


def test_owner_repo_default_and_compat(spark):
    rows = [
        ("git@github.com:owner/repo.git", "owner_repo", "owner_repo"),
        ("git@github.com:owner/digit.git", "owner_digit", "owner_d"),
        ("https://gitlab.com/owner/repo.git", "owner_repo", "owner_repo"),
        ("owner/repo", "owner_repo", "owner_repo"),
        ("https://example.com/a/b", None, None),
        ("plainname", None, None),
    ]
    df = spark.createDataFrame(rows, "url string, name string, compat string")
    u = F.col("url")
    got = df.select(
        "*", paths.owner_repo(u)["name"].alias("a"), paths.owner_repo(u, compat=True)["name"].alias("b"),
        paths.owner_repo(u)["error"].alias("e"),
    ).collect()
    for r in got:
        assert (r.a, r.b) == (r.name, r.compat), r.url
        assert (r.e is None) == (r.name is not None)
    assert got[4].e == "unsupported host"


def test_store_names(spark):
    names = [
        ("wiki_cache_github_Some_tool-open_en.json", ("github", "Some", "tool-open", "en")),
        ("wiki_cache_github_o_my_repo_en.json", ("github", "o", "my_repo", "en")),
        ("wiki_cache_x_en.json", None),
        ("other.json", None),
    ]
    df = spark.createDataFrame([(n,) for n, _ in names], "name string")
    got = df.select(paths.parse_store_name(F.col("name")).alias("k")).collect()
    assert [tuple(r.k) if r.k else None for r in got] == [e for _, e in names]


def test_filter_list_keeps_plus(spark):
    df = spark.createDataFrame([("a%2Fb\n\n  \nc+d\n%zz",), ("",), (None,)], "s string")
    got = [r.x for r in df.select(paths.filter_list(F.col("s")).alias("x")).collect()]
    assert got == [["a/b", "c+d", "%zz"], None, None]


def test_extension_rules(spark):
    cases = {"a/b.py": ".py", "a.b/c": "", ".bashrc": "", "x/.env.local": ".local", "t.tar.gz": ".gz", "..a": "", "no": ""}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: r.e for r in df.select("p", paths.extension(F.col("p")).alias("e")).collect()}
    assert got == cases
