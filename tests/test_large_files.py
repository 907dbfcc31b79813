"""Files above the size that rows hold: the same edges and states as small ones."""

from __future__ import annotations

import os

import pytest

from depweft.operators.index import index_files
from depweft.sources.blobs import line_pieces
from depweft.sources.containers import zip_edges, zip_members
from depweft.sources.tree import MAX_CONTENT, read_tree

from .samples import archive, elf, iso, pe, zipcrypto

PAD = 6 * 1024 * 1024
SMALL = {
    "bin/a.so": elf(["libz.so.1"]), "bin/b.exe": pe(["KERNEL32.dll"]), "bin/c.dll": b"needs USER32.dll", "d.iso": iso({"M.PY": b"import os\n", "N.TXT": b"hello"}), "locked.pdf": b"%PDF-1.7\n", "locked.zip": zipcrypto(b"import os\n", "m.py", b"p"),
    "salted.txt": b"Salted__abc", "big.py": b"import os\nfrom json import x\n", "big.js": b"import a from './lib';\n", "lib.js": b"", "office.doc": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1EncryptedPackage",
}
TAILS = {"locked.pdf": b"\n/Encrypt 5 0 R\n", "big.py": b"\nimport late.module\n", "big.js": b"\nimport b from 'react';\n"}


def write(root, large):
    for name, body in SMALL.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        if name.endswith((".py", ".js")):
            fill = b"# filler line\n" if name.endswith(".py") else b"// filler line\n"
        else:
            fill = b"\0" * 16
        if name == "locked.zip":
            pad = b"\0" * PAD if large else b""  # in front, as self-extracting archives have it; the end must stay the end
            body = b"PK\x03\x04" + pad + body if large else body
        else:
            pad = fill * (PAD // len(fill)) if large and name != "lib.js" else b""
            body = body + pad + TAILS.get(name, b"")
        p.write_bytes(body)
    return str(root)


def graph_of(spark, root):
    nodes, edges = index_files(read_tree(spark, root))
    return {r["key"]: (r["status"], r["error"]) for r in nodes.collect()}, {tuple(r)[:3] for r in edges.collect()}


def test_large_files_give_what_small_ones_give(spark, tmp_path):
    small_nodes, small_edges = graph_of(spark, write(tmp_path / "s", False))
    large_nodes, large_edges = graph_of(spark, write(tmp_path / "l", True))
    assert all((tmp_path / "l" / n).stat().st_size > MAX_CONTENT for n in SMALL if n != "lib.js")
    # Members of modules need the parser, which large sources do not go through.
    assert large_nodes == {k: v for k, v in small_nodes.items() if k != "external:python:json.x"} and large_edges - small_edges == set()
    assert {e for e in small_edges - large_edges if e[2] != "python-member"} == set()
    for edge in (("file:bin/a.so", "external:binary:libz.so.1", "binary-import"), ("file:bin/b.exe", "external:binary:KERNEL32.dll", "binary-import"), ("file:big.py", "external:python:late.module", "python-import"), ("file:big.js", "file:lib.js", "source-import"), ("file:big.js", "external:package:react", "source-import"), ("iso:d.iso!/M.PY", "external:iso-module:os", "iso-import")):
        assert edge in large_edges, edge
    assert {k for k, (s, _) in large_nodes.items() if s == "encrypted"} == {"file:locked.pdf", "file:locked.zip", "file:salted.txt", "file:office.doc"}


def test_large_archives(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/x.zip").write_bytes(archive({"a.py": "import b\n", "b.py": "x = 1\n" * (PAD // 6)}))
    files = read_tree(spark, str(tmp_path / "p"))
    assert files.first()["content"] is None
    assert ("zip:x.zip!/a.py", "zip:x.zip!/b.py", "python-import", "declared") in {tuple(r) for r in zip_edges(zip_members(files)).collect()}


@pytest.mark.skipif(os.geteuid() == 0, reason="root may read everything")
def test_unreadable_files_are_failed(spark, tmp_path):
    p = tmp_path / "u/x.py"
    p.parent.mkdir()
    p.write_text("import os\n")
    p.chmod(0)
    assert graph_of(spark, str(tmp_path / "u"))[0]["file:x.py"][0] == "failed"


def test_files_that_vanish_are_failed(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v/x.py").write_text("import os\n")
    files = read_tree(spark, str(tmp_path / "v"))
    files = files.withColumn("content", files["content"].substr(0, 0)).selectExpr("path", "seeded", "null digest", "cast(null as binary) content", "cast(null as string) location", "cast(null as binary) header", "'gone' error")
    assert graph_of_files(files)["file:x.py"] == ("failed", "gone")


def graph_of_files(files):
    return {r["key"]: (r["status"], r["error"]) for r in index_files(files)[0].collect()}


@pytest.mark.parametrize("size", [32, 64, 4096])
def test_pieces_hold_every_line(size):
    data = b"".join(b"line %d of the text\n" % i for i in range(50)) + b"x" * 500 + b"\nlast"
    at = iter(range(0, len(data), size))
    out = list(line_pieces(lambda n: data[(p := next(at, len(data))) : p + size], size, 3))
    joined = "".join(out)
    assert all(f"line {i} of the text\n" in joined for i in range(50)) and "last" in out[-1]
    assert sum(p.startswith("\0") for p in out) == sum(not p.endswith("\n") for p in out[:-1])
