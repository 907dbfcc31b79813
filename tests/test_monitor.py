from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from depweft.operators import monitor
from depweft.streaming.monitor import next_state, run_available

CHECKS = "target bigint, seq bigint, kind string, algorithm string, sha string, semantic string, failed boolean, not_modified boolean"


def states(spark, rows):
    return [r["state"] for r in monitor.check_states(spark.createDataFrame(rows, CHECKS)).orderBy("target", "seq").collect()]


def test_states_of_pages_and_folders(spark):
    web = [(1, 1, "web", "sha256", "a", "hello", False, False), (1, 2, "web", "sha256", "b", "hello", False, False), (1, 3, "web", "sha256", "c", "bye", False, False), (1, 4, "web", "sha256", None, None, False, True), (1, 5, "web", "sha256", None, None, True, False), (1, 6, "web", "sha256", "C", "bye", False, False)]
    assert states(spark, web) == ["baseline", "technical", "content", "unchanged", "error", "unchanged"]
    local = [(2, 1, "local", "sha256", "a", None, False, False), (2, 2, "local", "sha256", "a", None, False, False), (2, 3, "local", "sha256", "b", None, None, None)]
    assert states(spark, local) == ["baseline", "unchanged", "files"]
    switch = [(3, 1, "local", "sha256", "a", None, False, False), (3, 2, "local", "md5", "x", None, False, False), (3, 3, "local", "sha256", None, None, True, False), (3, 4, "local", "sha256", "a", None, False, False), (3, 5, "local", "sha256", None, None, False, False)]
    assert states(spark, switch) == ["baseline", "baseline", "error", "baseline", "error"]
    assert states(spark, [(4, 1, "web", "md5", None, None, False, True)]) == ["error"]
    assert states(spark, []) == []


def random_checks():
    r = random.Random(8)
    return [(t, s, "web" if t % 2 else "local", r.choice(["sha256"] * 6 + ["md5"]), r.choice(["a", "b", None]), r.choice(["x", "y", None]), r.random() < 0.15, r.random() < 0.1) for t in range(12) for s in range(1, 30)]


def test_batch_equals_state_machine(spark):
    rows = random_checks()
    want, base, algo = [], {}, {}
    for t, s, kind, a, sha, sem, failed, same in rows:
        if t in algo and algo[t] != a:
            base[t] = None
        algo[t] = a
        now = next_state(kind, base.get(t), sha, sem, failed, same)
        if now != "error" and not same:
            base[t] = (sha, sem)
        want.append(now)
    assert states(spark, rows) == want


def test_stream_equals_batch(spark, tmp_path):
    rows = random_checks()
    df = spark.createDataFrame(rows, CHECKS)
    for part, keep in (("1", df.where("seq <= 12")), ("2", df.where("seq > 12"))):
        keep.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(CHECKS).parquet(str(tmp_path / "in"))
        q = run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None, part
    got = {(r["target"], r["seq"], r["state"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = monitor.logged_events(monitor.check_states(df))
    assert got == {(r["target"], r["seq"], r["state"]) for r in batch.collect()}


def test_digests(spark):
    one = spark.createDataFrame([(b"abc",)], "b binary")
    got = one.select(*(monitor.digest(F.col("b"), a).alias(a) for a in ("md5", "sha256", "sha512"))).first()
    assert got["md5"] == "900150983cd24fb0d6963f7d28e17f72" and got["sha256"].startswith("ba7816bf") and len(got["sha512"]) == 128
    with pytest.raises(ValueError):
        monitor.digest(F.col("b"), "crc")
    rows = [("ab" * 32, " " + "AB" * 32, "sha256"), ("ab" * 32, "cd" * 32, "sha256"), ("ab" * 32, "cd" * 31, "sha256"), ("ab" * 32, None, "md5"), ("ab" * 16, "ab" * 16, "md5")]
    out = spark.createDataFrame(rows, "a string, e string, algo string").select(monitor.verdict(F.col("a"), F.col("e"), F.col("algo"))).collect()
    assert [r[0] for r in out] == ["matches", "differs", "malformed", "malformed", "matches"]
    assert {r["id"] for r in monitor.algorithms(spark).collect()} == {"sha256", "sha512", "blake3", "md5"}


def test_manifest_json_equals_python(spark):
    m = {'q"uote': "sha256:1", "back\\slash": "2", "tab\tnew\nline": "3", "ñ/é": "4", "\x01": "5", "a": "6"}
    text = spark.createDataFrame([(m,), ({},)], "m map<string,string>").select(monitor.manifest_json(F.col("m"))).collect()
    assert text[0][0] == json.dumps(m, ensure_ascii=False, sort_keys=True, separators=(",", ":")) and text[1][0] == "{}"
    mark = spark.createDataFrame([(10, 5, "ff"), (40 << 20, 5, "ff")], "s bigint, t bigint, h string").select(monitor.marker(F.col("s"), F.col("t"), F.col("h"))).collect()
    assert [r[0] for r in mark] == ["sha256:ff", f"metadata-only:{40 << 20}:5"]


def test_visible_text(spark):
    a = "<html><head><style>.a{}</style></head><body>Hello &amp; <b>you</b><script>x</script></body></html>"
    b = a.replace(".a{}", ".b { }").replace("<body>", "<body>\n\n ")
    assert monitor.visible(a, "text/html") == monitor.visible(b, "") == "Hello & you"
    assert monitor.visible('{"b": 1,  "a": 2}', "application/json") == '{"a": 2, "b": 1}' and monitor.visible("{x", "application/json") == "{x"
    assert hashlib.sha256(a.encode()).digest() != hashlib.sha256(b.encode()).digest()
    out = monitor.visible_text(spark.createDataFrame([(1, a, None), (2, None, "x")], "id int, body string, type string")).collect()
    assert {r["id"]: r["visible"] for r in out} == {1: "Hello & you", 2: None}


def test_addresses(spark):
    good = {"https://Site.Example/a?b#c": "https://site.example/a?b", "http://x.example": "http://x.example/", "https://x.example:443/": "https://x.example:443/"}
    bad = ["http://localhost/", "http://127.0.0.1/", "http://169.254.169.254/x", "ftp://x.example/", "https://u:p@x.example/", "https://x.example:8443/", "https://x.example:80/", "https://a.local/", "C:\\x", "", None, "https://[::1]/"]
    out = {r["t"]: r["a"] for r in spark.createDataFrame([(t,) for t in [*good, *bad]], "t string").select("t", monitor.target_address(F.col("t")).alias("a")).collect()}
    assert out == good | dict.fromkeys(bad)


def test_diffs(spark):
    text = monitor.unified_diff("alpha\nbeta\n", "alpha\ngamma\n")
    assert "-beta" in text and "+gamma" in text and monitor.unified_diff("a", "a") == ""
    long = monitor.unified_diff("\n".join(map(str, range(5000))), "\n".join(map(str, range(5000, 10000))))
    assert len(long) <= 20_000 and long.endswith("... diff cut ...\n")
    out = monitor.diffs(spark.createDataFrame([(1, "a b", "a c", True), (2, None, "x", False)], "id int, before string, after string, web boolean")).collect()
    assert "-a b" in out[0]["diff"] and "+x" in out[1]["diff"]
    words = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(words,), ("",)], "t string").select(monitor.wrapped_words(F.col("t"))).collect()
    assert [len(r[0]) for r in rows] == [3, 0] and rows[0][0][0].split() == words.split()[:12]


def test_texts_that_are_kept(spark):
    files = [("t", i, f"f{i}.py", 5000) for i in range(40)] + [("t", 40, "small.py", 10), ("t", 41, ".env", 1), ("t", 42, "a/id_rsa", 1), ("t", 43, "x.pem", 1), ("t", 44, "big.py", 9000), ("u", 1, "n.py", None)]
    got = {r["path"] for r in monitor.snapshot_choice(spark.createDataFrame(files, "target string, ordinal int, path string, size bigint")).collect()}
    assert got == {f"f{i}.py" for i in range(32)}
    assert monitor.snapshot_choice(spark.createDataFrame([("t", 1, "a.py", 159_000), ("t", 2, "b.py", 5000), ("t", 3, "c.py", 900)], "target string, ordinal int, path string, size bigint"), most_bytes=200_000).count() == 2


def test_due(spark):
    df = spark.createDataFrame([(1, 30), (2, 10), (3, 99), (4, None)], "id bigint, next_us bigint")
    assert [r["id"] for r in monitor.due(df, F.lit(50)).collect()] == [2, 1]
