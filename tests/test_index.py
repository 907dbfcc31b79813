from __future__ import annotations

import json

from pyspark.sql import functions as F

from depweft.operators import classify as cls
from depweft.operators import export, notes
from depweft.operators.index import index_files, refreshed
from depweft.sources.tree import read_tree

from .samples import iso

DAG = {"a.py": "import b\nimport c\n", "b.py": "import e\nimport f\n", "c.py": "import h\nimport i\n", "f.py": "import h\n", "e.py": "", "h.py": "", "i.py": ""}
NODES = "key string, kind string, status string, depth int, digest string, error string"


def tree(root, files):
    for name, body in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body) if isinstance(body, bytes) else p.write_text(body)
    return str(root)


def index(spark, root, seed=None):
    files = read_tree(spark, root)
    nodes, edges = index_files(files, spark.createDataFrame([(seed,)], "path string") if seed else None)
    return {r["key"]: r for r in nodes.collect()}, {(r["source"], r["target"], r["relation"]): r["evidence"] for r in edges.collect()}


def test_dag_cycle_and_external(spark, tmp_path):
    nodes, edges = index(spark, tree(tmp_path / "p", DAG), "a.py")
    assert {k: r["depth"] for k, r in nodes.items()} == {"file:a.py": 0, "file:b.py": 1, "file:c.py": 1, "file:e.py": 2, "file:f.py": 2, "file:h.py": 2, "file:i.py": 2}
    assert len(edges) == 7 and ("file:c.py", "file:h.py", "python-import") in edges and ("file:f.py", "file:h.py", "python-import") in edges
    tree(tmp_path / "p", {"h.py": "import a\n", "e.py": "import missing_package_xyz\n", "i.py": "def (:\n", "s.txt": b"Salted__xx"})
    nodes, edges = index(spark, str(tmp_path / "p"))
    assert ("file:h.py", "file:a.py", "python-import") in edges and nodes["external:python:missing_package_xyz"]["status"] == "external"
    assert nodes["file:i.py"]["status"] == "failed" and nodes["file:i.py"]["error"] and nodes["file:s.txt"]["status"] == "encrypted" and not any(e[0] == "file:i.py" for e in edges)


def test_web_site(spark, tmp_path):
    files = {
        "src/pages/index.astro": "---\nimport Card from '../components/Card.tsx';\nimport '@/styles/base.css';\nimport post from \"../content/post.mdx\";\n---\n<img src=\"/img/hero.webp\">\n", "src/components/Card.tsx": "import React from 'react';\nimport badge from '../assets/badge.svg';\n",
        "src/styles/base.css": "@import './more.css';\n.a { background: url('/img/hero.webp'); }\n", "src/styles/more.css": "", "src/assets/badge.svg": "<svg/>", "public/img/hero.webp": b"RIFF", "src/content/post.mdx": "![x](../assets/badge.svg)\n", "src/unused.png": b"x",
        "package.json": json.dumps({"dependencies": {"astro": "^5.0.0"}}), "tsconfig.json": '{"compilerOptions": {"paths": {"@lib/*": ["./src/lib/*"]}}}', "src/lib/t.ts": "", "src/use.ts": "import t from '@lib/t';\n", "disc.iso": iso({"M.PY": b"import os\n"}),
    }
    nodes, edges = index(spark, tree(tmp_path / "w", files))
    page = "file:src/pages/index.astro"
    for target, relation in (("src/components/Card.tsx", "source-import"), ("src/styles/base.css", "source-import"), ("src/content/post.mdx", "source-import"), ("public/img/hero.webp", "asset-reference")):
        assert edges[page, f"file:{target}", relation] == "declared"
    assert ("file:src/components/Card.tsx", "file:src/assets/badge.svg", "source-import") in edges and ("file:src/components/Card.tsx", "external:package:react", "source-import") in edges
    assert ("file:src/styles/base.css", "file:src/styles/more.css", "style-import") in edges and ("file:src/content/post.mdx", "file:src/assets/badge.svg", "markdown-image") in edges
    assert edges["file:package.json", "external:npm:astro@^5.0.0", "package-manifest"] == "declared"
    assert ("file:src/use.ts", "file:src/lib/t.ts", "source-import") in edges
    assert not any(t == "file:src/unused.png" for _, t, _ in edges)
    assert ("file:disc.iso", "iso:disc.iso!/", "iso-root") in edges and nodes["iso:disc.iso!/M.PY"]["status"] == "done"


def test_refresh_replaces_and_failures_keep(spark):
    old_n = spark.createDataFrame([("file:a", "file", "done", 0, "1", None), ("file:b", "file", "done", 1, "2", None)], NODES)
    old_e = spark.createDataFrame([("file:a", "file:b", "r", "declared"), ("file:b", "file:c", "r", "declared")], "source string, target string, relation string, evidence string")
    new_n = spark.createDataFrame([("file:a", "file", "done", 0, "9", None), ("file:b", "file", "failed", 1, None, "bad")], NODES)
    nodes, edges = refreshed(old_n, old_e, new_n, old_e.limit(0))
    assert {r["key"]: (r["status"], r["digest"], r["error"]) for r in nodes.collect()} == {"file:a": ("done", "9", None), "file:b": ("failed", "2", "bad")}
    assert {(r["source"], r["target"]) for r in edges.collect()} == {("file:b", "file:c")}


def test_classification(spark):
    files = [("a/x.py", None), ("x.d.ts", None), ("Dockerfile", None), ("run", b"#!/usr/bin/env python3\nx"), ("blob", b"a\0b"), ("what", b"text"), ("y.py", b"MZ\x90"), ("Z.PY", None), ("d.custom", None), (None, None)]
    extra = spark.createDataFrame([(".custom", "Custom", "data", "inventory", 0), (".py", "Other", "programming", "inventory", 1), (".py", "Python", "data", "inventory", 2)], cls.CATALOGUE)
    got = {r["path"]: (r["language"], r["evidence"], r["ambiguous"]) for r in cls.classify(spark.createDataFrame(files, "path string, header binary"), cls.merged_catalogue(cls.built_in(spark), extra)).collect()}
    assert got == {
        "a/x.py": ("Python", "extension:.py", True), "x.d.ts": ("TypeScript", "extension:.d.ts", False), "Dockerfile": ("Dockerfile", "filename", False), "run": ("Python", "shebang", False), "blob": ("Unknown binary", "content", False), "what": ("Unknown", "unrecognized", False),
        "y.py": ("PE executable", "magic", False), "Z.PY": ("Python", "extension:.py", True), "d.custom": ("Custom", "extension:.custom", False),
    }
    yaml = "---\nFoo:\n  type: programming\n  extensions:\n  - \".foo\"\n  - \".fo2\"\n  tm_scope: x\nBar:\n  type: other\n  extensions:\n  - '.bar'\n"
    assert cls.linguist_rows(yaml, least=1) == [(".foo", "Foo", "programming", "inventory"), (".fo2", "Foo", "programming", "inventory")]


def test_notes(spark):
    answers = ['```json\n{"summary": " does x ", "responsibilities": ["a", " ", "b"], "notes": "n"}\n```', 'Sure: {"summary": "s"} done', "no json", '{"summary": ""}', "", None]
    out = [r["n"] for r in spark.createDataFrame([(a,) for a in answers], "a string").select(notes.decode_answer(F.col("a")).alias("n")).collect()]
    assert out[0]["summary"] == "does x" and list(out[0]["responsibilities"]) == ["a", "b"] and out[1]["summary"] == "s" and out[2:] == [None] * 4
    files = spark.createDataFrame([("a.py", "x" * 50), (".env", "y"), ("k.py", "password = 'abcdefgh12345678'"), ("n.py", None)], "path string, text string")
    edges = spark.createDataFrame([("file:a.py", f"t{i}", "r", "declared") for i in range(150)], "source string, target string, relation string, evidence string")
    rows = notes.prepared(files, edges, max_chars=20).collect()
    assert [(r["path"], len(r["code"]), r["truncated"], len(r["references"])) for r in rows] == [("a.py", 20, True, 100)]
    nodes = spark.createDataFrame([(1, "a", 1, "v1"), (2, "b", 3, "v1"), (3, "c", 3, "v1"), (4, "d", 0, "v2")], "id bigint, key string, depth int, version string")
    made = spark.createDataFrame([("a", "v1", "S", "done"), ("b", "v1", "S", "failed"), ("c", "v1", "T", "done"), ("d", "v1", "S", "done")], "key string, version string, settings_hash string, state string")
    assert [r["key"] for r in notes.plan_run(nodes, made, "S").collect()] == ["c", "d"] and [r["key"] for r in notes.plan_run(nodes, made, "S", retry_failed=True, max_files=2).collect()] == ["b", "c"]
    todo = spark.createDataFrame([(k, "v", "code", False, ["r"]) for k in "abc"], "key string, version string, code string, truncated boolean, references array<string>")

    def answer(data):
        if data["file"] == "b":
            raise PermissionError("secret")
        return {"summary": "ok"} if data["file"] == "a" else {}

    assert {r["key"]: r["state"] for r in notes.annotate(todo, answer).collect()} == {"a": "done", "b": "skipped", "c": "failed"}


def test_exports(spark, tmp_path):
    nodes = spark.createDataFrame([("file:a<b", "file", "done", 0, "d", None, None), ("file:b", "file", "failed", 1, None, "e", None)], NODES + ", updated timestamp_ntz")
    edges = spark.createDataFrame([("file:a<b", "file:b", "r", None), ("dir:.", "file:b", "contains", "filesystem")], "source string, target string, relation string, evidence string")
    export.write_json(nodes, edges, str(tmp_path / "j"))
    back = {r["id"]: r for r in spark.read.json(str(tmp_path / "j/nodes")).collect()}
    assert back["file:b"]["usage"]["status"] == "referenced" and back["file:b"]["error"] == "e"
    export.write_page(nodes, edges, str(tmp_path / "p"))
    page = [r["value"] for r in spark.read.text(str(tmp_path / "p/nodes")).collect()]
    assert not any("<" in v or "&" in v for v in page) and {json.loads(v)["id"] for v in page} == {"file:a<b", "file:b"}
    export.write_notes(nodes, edges, str(tmp_path / "n"))
    lines = [r["line"] for r in spark.read.parquet(str(tmp_path / "n")).where("section = 2").collect()]
    assert len(lines) == 1 and lines[0].startswith("- [[file-b-") and lines[0].endswith("]] (r; unknown)")
    assert export.file_manifest(spark.createDataFrame([("x", b"abc")], "path string, content binary")).first()["sha256"].startswith("ba7816bf")
    texts = spark.createDataFrame([("ok", "fine"), ("bad", "C:\\Users\\ana\\x")], "name string, text string")
    assert [r["name"] for r in export.leaks(texts).collect()] == ["bad"]
