from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from depweft.llm.handwritten import copied, copies, library_blocks, library_postings, origin, passing, shingle_filter, shingle_hashes, shingles
from depweft.llm.lexing import layout

WORDS = [f"w{i}" for i in range(400)]
LICENCE = " ".join(f"lic{i}" for i in range(60))


def changed(r, text, part):
    words = text.split()
    for _ in range(int(part * len(words))):
        words[r.randrange(len(words))] = r.choice(WORDS)
    return " ".join(words)


def test_copies_equal_the_comparison_of_all_pairs(spark):
    r = random.Random(2)
    libs = [LICENCE + " " + " ".join(r.choice(WORDS) for _ in range(r.randint(20, 200))) for _ in range(25)] + ["one two three four five six", None, "", "short"]
    texts = [changed(r, r.choice(libs[:25]), p) for p in (0, 0.01, 0.02, 0.03, 0.05, 0.1) for _ in range(12)]
    texts += [" ".join(x.split()[: r.randint(10, 120)]) for x in r.sample(libs[:25], 15)] + [LICENCE, LICENCE + " " + " ".join(WORDS[:200]), "one two three four five six", "one two three four five seven", "", "a b", " ".join(WORDS[:300])]
    library = spark.createDataFrame([(x,) for x in libs], "text string")
    (index, sizes), *_ = library_blocks(library)
    want = {i for i, t in enumerate(texts) if copied(t, index, sizes)}
    postings = library_postings(library)
    sets = spark.createDataFrame([(i, shingle_hashes(t).tolist()) for i, t in enumerate(texts)], "set_id bigint, own array<bigint>").where(F.size("own") > 0)
    assert {x["set_id"] for x in copies(sets, postings).collect()} == want and 20 < len(want) < len(texts) - 10
    words, bits = shingle_filter(postings)
    for i in want:
        own = shingle_hashes(texts[i])
        assert passing(own, words, bits).sum() >= 0.8 * len(own)
    far = shingle_hashes(" ".join(f"far{i}" for i in range(3000)))
    assert passing(far, words, bits).mean() < 0.2
    assert copies(sets, postings.limit(0)).count() == 0 and copies(sets.limit(0), postings).count() == 0


def test_hashes_stand_for_shingles():
    text = "a b c d e f a b c d e g " * 5
    assert len(shingle_hashes(text)) == len(shingles(text)) and len(shingle_hashes("a b c d")) == 0
    assert np.isin(shingle_hashes("x a b c d e y"), shingle_hashes("q a b c d e")).sum() == 1


@pytest.mark.parametrize(
    ("comment", "said"),
    [
        ("# Generated by Django 4.2 on 2023-05-01 10:00", "tool"), ("/* A Bison parser, made by GNU Bison 3.8.2.  */", "tool"), ("/* A lexical scanner generated by flex */", "tool"), ("# This is a generated file! Please edit source .ksy file and use kaitai-struct-compiler to rebuild", "tool"),
        ("# Form implementation generated from reading ui file 'main.ui'", "tool"), ("// Autogenerated by Thrift Compiler (0.19.0)\n// DO NOT EDIT UNLESS YOU ARE SURE", "tool"), ("// <auto-generated>", "tool"), ("/* This file was automatically generated by SWIG */", "tool"), ("// Code generated by MockGen. DO NOT EDIT.", "tool"),
        ("# Este archivo fue generado por el compilador.", "tool"), ("/* Diese Datei wurde von xsltc generiert. */", "tool"),
        ("# Hand-written parser, kept small on purpose.", "hand"), ("// Manually maintained; the generator is gone.", "hand"), ("# no longer generated, see history", "hand"),
        ("# Events are generated by the scheduler and read here.", ""), ("// Numbers created by callers are checked below", ""), ("# Compiled patterns of the rules", ""), ("// The table is produced from the registry at run time.", ""), ("# Reads the file written by export.py", ""),
    ],
)
def test_statements_of_origin(comment, said):
    assert origin([comment]) == said


def test_layout_takes_time_in_proportion_and_comments_by_their_place():
    text = "x = '# no comment'\n" + "y = 1  # the same remark\n" * 20_000
    m = layout("a.py", text)
    assert len(m.comments) == 20_000 and m.code_lines == 20_001
    only = layout("a.py", "s = '# a'\n# a\n")
    assert only.comments == ["# a"] and only.code_lines == 1
