from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from depweft.functions.projects import is_local, project_id, settings_problem, slug
from depweft.operators import extract, monitor, provenance


def test_project_names(spark):
    rows = [(" My Project! ",), ("__",), ("x" * 60,), (None,)]
    out = [r[0] for r in spark.createDataFrame(rows, "t string").select(slug(F.col("t"))).collect()]
    assert out == ["my-project", "project", "x" * 48, "project"]
    ids = spark.createDataFrame([("p", "/A/b", None), ("p", "/a/B", None), ("p", "/a/b", "x.py")], "l string, r string, e string").select(project_id(F.col("l"), F.col("r"), F.col("e"))).collect()
    assert ids[0][0] == ids[1][0] != ids[2][0] and ids[0][0].startswith("p-") and len(ids[0][0]) == 14


def test_note_settings(spark):
    good = ("ollama", "es", "m", "http://127.0.0.1:11434/api", 12000, 120.0, False)
    cases = {good: None, ("x", *good[1:]): "unknown provider", (*good[:3], "http://far.example/x", *good[4:]): "remote endpoint not allowed", (*good[:3], "http://far.example/x", 12000, 120.0, True): "remote endpoint without https", (*good[:3], "https://far.example", 12000, 120.0, True): None,
             (*good[:3], "https://u:p@localhost", *good[4:]): "endpoint holds credentials or a fragment", (*good[:4], 10, 120.0, False): "max_chars out of bounds", (*good[:3], "ftp://x", *good[4:]): "endpoint is no web address"}
    df = spark.createDataFrame(list(cases), "p string, l string, m string, e string, c int, t double, r boolean")
    got = df.select(settings_problem(*(F.col(c) for c in "plmectr")).alias("x")).collect()
    assert [r["x"] for r in got] == list(cases.values())
    assert [r[0] for r in spark.createDataFrame([("http://[::1]:80/",), ("https://LOCALHOST",), ("https://x.example/localhost",)], "u string").select(is_local(F.col("u"))).collect()] == [True, True, False]


def test_comparison_answers(spark):
    sha = "a" * 40
    body = {"total_commits": 50, "ahead_by": 1, "status": "ahead", "commits": [{"sha": sha, "commit": {"message": "m" * 400, "author": {"name": "Ana", "date": "d"}}, "author": None}, {"sha": "bad"}] + [{"sha": sha}] * 40, "files": [{"filename": f"f{i}", "patch": "p" * 13_000} for i in range(45)]}
    df = spark.createDataFrame([("o/r", json.dumps(body)), ("o/s", "no json"), ("o/t", None)], "repository string, body string")
    commits, files = provenance.compared_commits(df).collect(), provenance.compared_files(df).collect()
    assert len(commits) == 29 and len(commits[0]["message"]) == 350 and len(files) == 40 and len(files[0]["patch"]) == 12_000
    totals = {r["repository"]: (r["total_commits"], r["truncated"]) for r in provenance.comparison_totals(df).collect()}
    assert totals == {"o/r": (50, True), "o/s": (0, False), "o/t": (0, False)}


def test_blame_answers(spark):
    ranges = [{"startingLine": a, "endingLine": b, "commit": {"oid": s * 40, "messageHeadline": "h", "author": {"name": "n"}}} for a, b, s in ((1, 12, "a"), (13, 60, "b"), (61, 70, "c"))]
    df = spark.createDataFrame([("o/r", "f", json.dumps({"data": {"repository": {"object": {"isBinary": False, "blame": {"ranges": ranges}}}}}))], "repository string, path string, body string")
    assert [(r["start"], r["end"]) for r in provenance.blamed_ranges(df, 10, 25).collect()] == [(10, 12), (13, 25)]
    with pytest.raises(ValueError):
        provenance.blamed_ranges(df, 5, 500)


def test_registration(spark):
    now = spark.createDataFrame([("a", "sha256", True, "x", {"k": "t"}), ("b", "sha256", True, "y", {"k": "t"}), ("c", "md5", False, "z", None)], "target string, algorithm string, record_diffs boolean, last_sha string, last_texts map<string,string>")
    want = spark.createDataFrame([("a", "md5", True), ("b", "sha256", False), ("n", "sha512", False)], "target string, algorithm string, record_diffs boolean")
    rows, events = monitor.registered(now, want)
    assert {r["target"]: (r["algorithm"], r["record_diffs"], r["last_sha"], r["last_texts"]) for r in rows.collect()} == {"a": ("md5", True, None, None), "b": ("sha256", False, "y", None), "c": ("md5", False, "z", None), "n": ("sha512", False, None, None)}
    assert [tuple(r) for r in events.collect()] == [("a", "algorithm", "sha256", "md5")]


def test_generated_posts(spark):
    script = "const base = path.join(root, 'src', 'content', 'blog');\nfunction createPost(n) { writeFileSync(path.join(base, n, 'post.json'), d) }\npath.join('public', 'images', 'posts')"
    files = spark.createDataFrame([("tools/make.mjs", script), ("tools/read.mjs", script.replace("writeFileSync", "readFileSync")), ("x.py", None)], "path string, text string")
    paths = ["src/content/blog/one/post.json", "src/content/blog/one/index-es.mdx", "src/content/blog/one/other.txt", "src/locales/es/posts/one.json", "src/locales/es/posts/none.json", "public/images/posts/one/a.png", "public/images/posts/none/b.png"]
    got = {(r["source"], r["target"]) for r in extract.generated_posts(files, spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {("file:tools/make.mjs", f"file:{p}") for p in ("src/content/blog/one/post.json", "src/content/blog/one/index-es.mdx", "src/locales/es/posts/one.json", "public/images/posts/one/a.png")}
