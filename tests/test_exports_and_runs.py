from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from depweft.operators import classify as cls
from depweft.operators import export, extract, monitor
from depweft.operators.incremental import VersionedTarget
from depweft.operators.index import DONE, references_in_portions
from depweft.sources.tree import read_tree

NODES = "key string, kind string, status string, depth int, digest string, error string, updated timestamp_ntz"
EDGES = "source string, target string, relation string, evidence string"


def texts(folder) -> dict[str, list[str]]:
    return {p.name: [line for f in sorted(p.glob("part-*")) for line in f.read_text().splitlines()] for p in Path(folder).iterdir() if p.is_dir()}


def test_markdown_notes_and_indexes(spark, tmp_path):
    nodes = spark.createDataFrame([("file:a", "file", "done", 0, "d", None, None), ("file:b|c", "file", "failed", 1, None, "bad\nthing", None), ("dir:.", "folder", "done", 0, None, None, None)], NODES)
    edges = spark.createDataFrame([("file:a", "file:b|c", "imports", "declared"), ("dir:.", "file:a", "contains", "filesystem")], EDGES)
    notes = spark.createDataFrame([("file:a", json.dumps({"summary": "reads <b>", "responsibilities": ["x"], "notes": "n"}), "m"), ("file:b|c", "no json", "m")], "key string, note_json string, model string")
    export.write_markdown(nodes, edges, str(tmp_path / "o"), notes)
    got = texts(tmp_path / "o/notes")
    (a,) = [v for k, v in got.items() if k.startswith("note=file-a") or "a-" in k and v[0] == "# file:a"]
    assert a[0] == "# file:a" and "## depends on" in a and any("(imports; declared)" in x for x in a) and a.index("## lies in") < a.index("## explanation") and "reads &lt;b&gt;" in a and "- x" in a
    (b,) = [v for v in got.values() if v[0].startswith("# file:b")]
    assert "- error: bad thing" in b and "## explanation" not in b
    index = [x for f in sorted((tmp_path / "o/index").glob("part-*")) for x in f.read_text().splitlines()]
    assert len(index) == 3 and index[0].endswith("|dir:.]]") and index[2].endswith("|file:b-c]]")
    told = [x for f in sorted((tmp_path / "o/explanations").glob("part-*")) for x in f.read_text().splitlines()]
    assert len(told) == 1 and told[0].endswith(": reads <b>")


def test_audit_and_order_of_exports(spark, tmp_path):
    nodes = spark.createDataFrame([(f"file:n{i}", "file", "done", 0, None, None, None) for i in (3, 1, 2)], NODES)
    edges = spark.createDataFrame([("file:n3", "file:n1", "r", "declared"), ("file:n1", "file:n2", "r", None)], EDGES)
    export.write_audit(nodes, edges, str(tmp_path / "a"))
    counts = {r["class"]: r["n"] for r in spark.read.json(str(tmp_path / "a/counts")).collect()}
    assert counts == {"referenced_by_other_files": 2, "requires_review": 1} and spark.read.json(str(tmp_path / "a/classes")).count() == 3
    export.write_json(nodes, edges, str(tmp_path / "j"))
    lines = [json.loads(x) for f in sorted((tmp_path / "j/nodes").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x["id"] for x in lines] == ["file:n1", "file:n2", "file:n3"]


def test_runs_are_resumed_and_cancelled(spark, tmp_path):
    for name, body in {"a.py": "import os\n", "b.py": "import json\n", "c.py": "", "d.py": "def (:\n", "e.js": "import 'x';\n"}.items():
        (tmp_path / "p").mkdir(exist_ok=True)
        (tmp_path / "p" / name).write_text(body)
    done = VersionedTarget(spark, f"file://{tmp_path}/done", DONE)
    asked = []

    def after_one():
        asked.append(1)
        return len(asked) > 1

    assert not references_in_portions(read_tree(spark, str(tmp_path / "p")), done, 2, after_one)
    first = {r["path"] for r in done.read().collect()}
    assert references_in_portions(read_tree(spark, str(tmp_path / "p")), done, 1)
    rows = done.read().collect()
    assert {r["path"] for r in rows} == {"a.py", "b.py", "c.py", "d.py", "e.js"} and 0 < len(first) < 5
    assert len(rows) == len(set(rows)) == 5 and {r["path"] for r in rows if r["error"]} == {"d.py"} and {r["spec"] for r in rows} == {"os", "json", None, "x"}
    (tmp_path / "p/a.py").write_text("import sys\n")
    assert references_in_portions(read_tree(spark, str(tmp_path / "p")), done, 1)
    assert {r["spec"] for r in done.read().where("path = 'a.py'").collect()} == {"os", "sys"} and done.read().count() == 6


def test_names_order_and_patterns(spark):
    changes = spark.createDataFrame([(2, 1, f"f{i:04}", "added") for i in range(500)] + [(2, 1, "", "algorithm"), (2, 1, "z", "removed")], "snap_no int, target_id bigint, file_path string, change_kind string")
    got = {r["change_kind"]: (r["n"], list(r["names"])) for r in monitor.change_names(changes).collect()}
    assert got == {"added": (500, [f"f{i:04}" for i in range(30)]), "removed": (1, ["z"])}
    order = spark.createDataFrame([(["c", "a"], ["b", "c"], ["a", "d"]), (None, None, ["x"])], "c array<string>, a array<string>, e array<string>").select(monitor.text_order(F.col("c"), F.col("a"), F.col("e"))).collect()
    assert [list(r[0]) for r in order] == [["c", "a", "b", "d"], ["x"]]
    seen = monitor.first_seen(spark.createDataFrame([(3, "b"), (1, "a"), (2, "b"), (0, "c")], "n int, v string"), "n", "v").collect()
    assert [(r["v"], r["n"]) for r in seen] == [("c", 0), ("a", 1), ("b", 2)]
    files = spark.createDataFrame([("x.zig", '@import("std")\n'), ("y.rb", "require 'json'\n")], "path string, text string")
    more = [([".zig"], "static-import", "declared", "module", r'@import\("([^"]+)"\)')]
    assert {r["spec"] for r in extract.static_references(files, more).collect()} == {"std", "json"} and {r["spec"] for r in extract.static_references(files).collect()} == {"json"}


@pytest.mark.parametrize(("name", "language", "analyzer"), [("a.m", "Objective-C", "c-include"), ("b.pyx", "Cython", "inventory"), ("c.clj", "Clojure", "inventory"), ("d.hbs", "HTML", "web-static"), ("e.gemspec", "Ruby", "file-require"), ("f.tar.gz", "TAR archive", "inventory"), ("Justfile", "Just", "inventory"), ("g.module.css", "CSS", "web-static")])
def test_built_in_catalogue(spark, name, language, analyzer):
    row = cls.classify(spark.createDataFrame([(name, None)], "path string, header binary"), cls.built_in(spark)).first()
    assert (row["language"], row["analyzer"]) == (language, analyzer)


def test_rows_shown_to_others(spark):
    df = spark.createDataFrame([(1, "s", {"a": "b"})], "id int, last_sample string, last_manifest map<string,string>")
    assert monitor.shown(df).columns == ["id"]
