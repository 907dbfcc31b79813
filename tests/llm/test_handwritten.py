from __future__ import annotations

import datetime as dt

import pytest

from depweft.llm.handwritten import copied, judge, library_blocks, not_handwritten, origin, shingles
from depweft.llm.lexing import layout

AT = dt.datetime(2026, 1, 1)
HAND = "import os\n\n\ndef walk(root, limit):\n    # Links are not followed.\n    for name in sorted(os.listdir(root)):\n        if limit and len(name) > limit:\n            continue\n        yield root / name\n"
STUB = "class OrderStub {\n" + "".join(f"    public int getField{i}() {{ return this.values[{i}]; }}\n    public void setField{i}(int v) {{ this.values[{i}] = v; }}\n" for i in range(8)) + "}\n"
SHRUNK = "".join(f"function f{i}(a,b){{var c=a+b;if(c>{i}){{return c*2;}}return c;}}" for i in range(30)) + "\n"
TABLE = "TABLE = [\n" + "".join("  " + ", ".join(f"0x{(i * 37 + j * 11) % 256:02x}" for j in range(12)) + ",\n" for i in range(30)) + "]\n"


def test_layout_measures():
    assert layout("a.js", SHRUNK).expansion > 8 > layout("a.py", HAND).expansion
    assert layout("A.java", STUB).uniformity > 0.8 and layout("A.java", STUB).numbered > 0.8
    assert layout("t.py", TABLE).literal_share > 0.9 > 0.5 > layout("a.py", HAND).literal_share
    assert layout("x.py", "").code_lines == 0


@pytest.mark.parametrize(
    ("comment", "said"),
    [
        ("// Code generated by protogen. DO NOT EDIT.", "tool"),
        ("# Archivo generado automáticamente por protogen. No editar.", "tool"),
        ("/* Diese Datei wird von protogen erzeugt - nicht bearbeiten! */", "tool"),
        ("# Ce fichier est produit par protogen ; ne pas le modifier.", "tool"),
        ("// @generated by protogen v1", "tool"),
        ("# Output of protogen. Change a.tmpl instead of this file.", "tool"),
        ("# This file was generated once by protogen; it is maintained by hand since then.", "hand"),
        ("# Not generated: protogen only reads this file, edit it freely.", "hand"),
        ("# El generador protogen lee este archivo; se edita a mano.", "hand"),
        ("# The report is generated by the nightly job.", ""),
        ("// Do not edit the cache while a run is on.", ""),
    ],
)
def test_origin(comment, said):
    assert origin([comment]) == said


def test_marker_in_a_string_is_no_statement():
    text = "HEADER = '# Code generated by protogen. DO NOT EDIT.'\n" + HAND
    assert judge("file:p/make.py", text, {}, {}) == (False, False, False, False, False)


def test_copies_of_library_files(spark):
    lib = "\n".join(f"export function step{i}(value) {{ return value + offset{i} * scale; }}" for i in range(20))
    (index, sizes), *_ = library_blocks(spark.createDataFrame([(lib,), (None,), ("",)], "text string"))
    assert copied(lib.replace("    ", "\t").replace("scale; }", "scale;  }") + "\n// local fix\n", index, sizes)
    assert copied("\n".join(lib.split("\n")[:10]), index, sizes)
    assert not copied(HAND, index, sizes) and not copied("", index, sizes)
    assert len(shingles("a b c d")) == 0 and len(shingles("a b c d e f")) == 2


def test_whole(spark):
    texts = {
        "file:p/src/hand.py": HAND, "file:p/src/stub.java": STUB, "file:p/src/small.js": SHRUNK, "file:p/src/table.py": TABLE, "file:p/src/kept_pb2.py": "# generated once by x, maintained by hand since then\n" + HAND,
        "file:p/src/note.py": "# Machine written by x; do not modify by hand\n" + HAND, "file:p/src/long.py": HAND * 3000, "file:p/src/blank.py": "  \n",
    }
    paths = [*texts, "file:p/vendor/lib/a.py", "file:p/vendors/a.py", "file:p/x/a_pb2.py", "file:p/x/generate_pb2_a.py", "file:p/x/a.min.js", "file:p/deposits/a.js", "file:p/x/data.json", "file:p/only_type.py", "external:python:vendor"]
    nodes = spark.createDataFrame([(k, "x") for k in paths if "only_type" not in k] * 2 + [(None, "x")], "key string, category string")
    types = spark.createDataFrame([(k, "data" if k.endswith("json") else " Programming ") for k in paths] + [(None, "programming"), ("file:p/none.py", None)], "key string, category string")
    docs = spark.createDataFrame([(i, t, k, AT, "extra") for i, (k, t) in enumerate(texts.items())] + [(90, None, "file:p/src/hand.py", AT, "e"), (91, HAND, None, AT, "e"), (92, STUB, "file:p/src/hand.py", dt.datetime(2025, 1, 1), "e")], "doc_id bigint, text string, node_key string, added_at timestamp_ntz, data string")
    library = spark.createDataFrame([("nothing like it at all here",)], "text string")
    got = {r["node_key"]: r["reason"] for r in not_handwritten(nodes, types, docs, library).collect()}
    assert got == {
        "file:p/src/stub.java": "generated", "file:p/src/note.py": "generated", "file:p/src/small.js": "minified", "file:p/src/table.py": "data", "file:p/vendor/lib/a.py": "third-party", "file:p/x/a_pb2.py": "generated", "file:p/x/a.min.js": "minified",
    }
    assert not_handwritten(nodes.limit(0), types, docs, library).count() == 0
    assert not_handwritten(nodes, types, docs.limit(0), library.limit(0)).count() == 4
