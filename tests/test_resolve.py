from __future__ import annotations

import posixpath
import random

from depweft.functions import fixed
from depweft.operators import extract
from depweft.operators.resolve import expanded, resolved


def first_file(path: str, spec: str, paths: set[str]) -> str | None:
    """Brute force of the rule for plain paths: both bases, each with every ending, in order."""
    here = posixpath.dirname(path)
    for base in (here, ""):
        for e in fixed.SOURCE_EXTENSIONS:
            for v in fixed.SOURCE_VARIANTS:
                c = posixpath.normpath(posixpath.join(base, spec + e + v))
                if not c.startswith("..") and c in paths:
                    return c
    return None


def test_ranked_resolution_equals_brute_force(spark):
    r = random.Random(3)
    names = ["a", "b", "lib", "util"]
    paths = {"/".join(r.choice(names) for _ in range(r.randint(1, 3))) + r.choice(["", ".py", ".js", ".ts", ".h", "/index.js", "/__init__.py"]) for _ in range(60)}
    refs = {(p, "/".join([r.choice([".", "..", "a", "lib"]), *(r.choice(names) for _ in range(r.randint(0, 2)))])) for p in sorted(paths)[:40] for _ in range(4)}
    refs = {(p, s) for p, s in refs if not s.endswith((".", ".."))}
    df = spark.createDataFrame([(p, s, "c-include", "declared", "path") for p, s in refs], extract.REFS)
    got = {(r["source"], r["target"]) for r in resolved(df, spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    want = set()
    for p, s in refs:
        hit = first_file(p, s, paths)
        want.add((f"file:{p}", f"file:{hit}" if hit else f"external:path:{s}"))
    assert got == want


def test_modes(spark):
    paths = ["pkg/__init__.py", "pkg/mod.py", "pkg/sub/x.py", "top.py", "src/lib/k.ts", "public/img/a.png", "src/pages/i.astro", "rb/tool.rb", "rb/main.rb", "src/posts/one/index-es.mdx", "src/posts/two/index-es.mdx"]
    refs = [
        ("pkg/sub/x.py", "..mod", "python-import", "declared", "python"), ("pkg/sub/x.py", "top", "python-import", "declared", "python"), ("pkg/sub/x.py", "numpy", "python-import", "declared", "python"), ("pkg/mod.py", "pkg", "python-import", "declared", "python"),
        ("src/pages/i.astro", "@/lib/k", "source-import", "declared", "package"), ("src/pages/i.astro", "react", "source-import", "declared", "package"), ("src/pages/i.astro", "/img/a.png?v=2", "asset-reference", "declared", "resource"), ("src/pages/i.astro", "/img/none.png", "asset-reference", "declared", "resource"),
        ("rb/main.rb", "tool", "static-import", "declared", "ruby-relative"), ("rb/main.rb", "json", "static-import", "declared", "ruby"), ("rb/main.rb", "gone", "static-import", "declared", "ruby-relative"), ("pkg/mod.py", "https://x.example/a", "file-open", "declared", "path"), ("A.java", "a.b.C", "java-import", "heuristic", "java"),
    ]
    inventory = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {(r["source"][5:], r["target"], r["evidence"]) for r in resolved(spark.createDataFrame(refs, extract.REFS), inventory).collect()}
    assert got == {
        ("pkg/sub/x.py", "file:pkg/mod.py", "declared"), ("pkg/sub/x.py", "file:top.py", "declared"), ("pkg/sub/x.py", "external:python:numpy", "declared"), ("pkg/mod.py", "file:pkg/__init__.py", "declared"),
        ("src/pages/i.astro", "file:src/lib/k.ts", "declared"), ("src/pages/i.astro", "external:package:react", "declared"), ("src/pages/i.astro", "file:public/img/a.png", "declared"), ("rb/main.rb", "file:rb/tool.rb", "declared"), ("rb/main.rb", "external:module:json", "declared"),
        ("pkg/mod.py", "external:url:https://x.example/a", "declared"), ("A.java", "external:java:a.b.C", "probable"),
    }
    globs = spark.createDataFrame([("src/pages/i.astro", "../posts/${slug}/index-*.mdx", "dynamic-import-pattern", "inferred", "glob")], extract.REFS)
    assert {r["target"] for r in expanded(globs, inventory).collect()} == {"file:src/posts/one/index-es.mdx", "file:src/posts/two/index-es.mdx"}


def test_extractors(spark):
    files = spark.createDataFrame(
        [
            ("a.c", '#include "x.h"\n  # include <stdio.h>\n'), ("b.go", 'import (\n\t"fmt"\n\talias "net/http"\n)\n'), ("c.ts", "import { a } from './a';\nimport 'side';\nconst b = require(\"b\");\nnew Worker('w.js')\n"), ("d.css", "@import 'base.css';\n.x { background: url('../i.svg') }\n"),
            ("e.html", '<img src="a.png"><a href="/page">x</a>\n'), ("f.rb", "require_relative 'g'\nrequire 'json'\n"), ("package.json", '{"dependencies": {"astro": "^5.0.0"}, "devDependencies": {"vite": "1"}}'), ("requirements.txt", "# c\nflask; python_version > '3'\n-r x\n\nnumpy\n"),
            ("Cargo.toml", "[package]\nname = 'x'\n[dependencies]\nserde = '1'\n[features]\nf = []\n"), ("go.mod", "module m\nrequire (\n\tgithub.com/a/b v1.2\n)\n"), ("g.md", "![t](img/a.png) ![u](<b c.png>)\n---\ncover: k.jpg\n"), ("h.py", "import os.path\nfrom . import x\nfrom .m import y\nopen('data.txt')\n__import__('z')\n"),
            ("bad.py", "def (:\n"), ("i.js", "const base = path.join(root, 'public', 'img');\npath.join(base, name, 'a.png')\nimport(`./p/${x}.js`)\nwriteFileSync('./out.json', d)\n"), ("n.json", '{"hero_image": "./a.png", "title": "b.png", "gallery": ["c.svg"]}'), (None, "x"), ("none.py", None), ("empty.py", ""),
        ],
        "path string, text string",
    )
    static = {(r["path"], r["spec"], r["mode"]) for r in extract.static_references(files).collect()}
    assert static == {("a.c", "x.h", "path"), ("a.c", "stdio.h", "system-header"), ("b.go", "fmt", "go"), ("b.go", "net/http", "go"), ("f.rb", "g", "ruby-relative"), ("f.rb", "json", "ruby")}
    web = {(r["path"], r["spec"], r["relation"]) for r in extract.web_references(files).collect()}
    assert {("c.ts", "./a", "source-import"), ("c.ts", "side", "source-import"), ("c.ts", "b", "source-import"), ("c.ts", "w.js", "worker-reference"), ("d.css", "base.css", "style-import"), ("d.css", "../i.svg", "style-resource"), ("e.html", "a.png", "asset-reference")} <= web
    assert ("e.html", "/page", "asset-reference") not in web
    assert {r["spec"] for r in extract.package_json(files).collect()} == {"astro@^5.0.0", "vite@1"}
    assert {(r["spec"], r["mode"]) for r in extract.manifest_lines(files).collect()} == {("flask", "pip"), ("numpy", "pip"), ("serde", "cargo"), ("github.com/a/b", "go")}
    assert {(r["spec"], r["relation"]) for r in extract.semantic_references(files).collect()} >= {("img/a.png", "markdown-image"), ("b c.png", "markdown-image"), ("k.jpg", "frontmatter-resource")}
    refs, errors = extract.parsed_references(files)
    parsed = {(r["path"], r["spec"], r["relation"], r["evidence"]) for r in refs.collect()}
    assert {("h.py", "os.path", "python-import", "declared"), (("h.py"), ".x", "python-member", "heuristic"), ("h.py", ".m", "python-import", "declared"), ("h.py", ".m.y", "python-member", "heuristic"), ("h.py", "data.txt", "file-open", "declared"), ("h.py", "z", "dynamic-import", "declared")} <= parsed
    assert ("n.json", "./a.png", "metadata-resource", "declared") in parsed and ("n.json", "c.svg", "metadata-resource", "declared") in parsed and not any(p[1] == "b.png" for p in parsed)
    assert ("i.js", "public/img/*/a.png", "computed-file-path", "inferred") in parsed
    assert [r["path"] for r in errors.collect()] == ["bad.py"]
    assert [r["spec"] for r in extract.template_imports(files).collect()] == ["./p/${x}.js"]
    assert [r["spec"] for r in extract.literal_writes(files).collect()] == ["./out.json"]


def test_paired_content(spark):
    paths = ["src/content/blog/one/post.json", "src/content/blog/one/index-es.mdx", "src/content/projects/p/project.json", "src/locales/es/posts/one.json", "x/post.json"]
    got = {(r["source"], r["target"], r["relation"]) for r in extract.paired_content(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    a = "file:src/content/blog/one/post.json"
    assert got == {(a, "file:src/content/blog/one/index-es.mdx", "localized-content"), (a, "file:src/locales/es/posts/one.json", "localized-metadata")}
