from __future__ import annotations

import pytest

from depweft.llm.handwritten import EXPANSION, judge
from depweft.llm.lexing import _TOKENS, canonical, family, layout

WORDS = "amber birch cedar delta ember frost grove hazel ivory jade kelp lotus maple north olive pearl".split()


def lines(path, text):
    return canonical(family(path), _TOKENS[family(path)].findall(text))


@pytest.mark.parametrize(
    ("path", "text", "expected"),
    [
        ("a.py", "import os; x = {1: 2}; y = z[1:2]  # c; d\n", ["import os ;", "x = { 1 : 2 } ;", "y = z [ 1 : 2 ]"]),
        ("a.py", "def f(a: int) -> int: return a\nif x: y = 1\nelse: z = lambda q: q\nn: int = 3\n", ["def f ( a : int ) - > int :", "return a", "if x :", "y = 1", "else :", "z = lambda q : q", "n : int = 3"]),
        ("a.py", "if (lambda: 1)(): y\nx = f(1,\n  2)\ny = 1 + \\\n  2\n", ["if ( lambda : 1 ) ( ) :", "y", "x = f ( 1 , 2 )", "y = 1 + 2"]),
        ("a.rb", "def f(a);b=a;c(b);end\n", ["def f ( a ) ;", "b = a ;", "c ( b ) ;", "end"]),
        ("a.yml", "a: b\nc: {d: e}\n", ["a : b", "c : { d : e }"]),
        ("a.js", "(function(){var a=1;for(;;){b();}})();", ["( function ( ) {", "var a = 1 ;", "for ( ; ; ) {", "b ( ) ;", "}", "}", ") ( ) ;"]),
        ("a.go", "x := a +\n  b\ny := 'q;r'\n", ["x : = a + b", "y : = 'q;r'"]),
        ("a.html", "<ul><li>a b</li></ul>", ["< ul >", "< li >", "a b < / li >", "< / ul >"]),
        ("a.py", "", []),
    ],
)
def test_one_statement_a_line(path, text, expected):
    assert lines(path, text) == expected


def verdict(path, text):
    return judge(path, text, {}, {})[:2]


@pytest.mark.parametrize("path", ["file:p/src/a.py", "file:p/src/a.rb"])
def test_shrunk_files_with_hash_comments(path):
    one = "; ".join(f"{w} = {v} + {i}" for i, (w, v) in enumerate(zip(WORDS, WORDS[::-1]))) + "\n"
    assert layout(path, one).expansion == 16 >= EXPANSION and verdict(path, one) == (False, True)
    assert not verdict(path, one.replace("; ", "\n"))[1]


STUB = "    public {0} get{0}() {{ return this.{0}; }}\n    public void set{0}({0} v) {{ this.{0} = v; }}\n"


def test_uniform_output_without_counters_or_comment():
    assert verdict("file:p/src/A.java", "class A {\n" + "".join(STUB.format(w) for w in WORDS) + "}\n") == (True, False)
    unwrapped = "".join(f"def {w}(self, value):\n    self.items['{w}'] = value\n    return self.items\n" for w in WORDS)
    assert verdict("file:p/src/a.py", unwrapped) == (True, False)


def test_the_layout_of_the_output_plays_no_part():
    text = "class A {\n" + "".join(STUB.format(w).replace("{ ", "{\n" if i % 3 else "{ ").replace("; }", ";\n}" if i % 2 else "; }") for i, w in enumerate(WORDS)) + "}\n"
    assert verdict("file:p/src/A.java", text) == (True, False)


def test_lists_of_imports_and_few_repetitions_are_no_tools_output():
    assert verdict("file:p/src/index.js", "".join(f"export {{ {w} }} from './{w}';\n" for w in WORDS)) == (False, False)
    assert verdict("file:p/src/A.java", "class A {\n" + "".join(STUB.format(w) for w in WORDS[:3]) + "}\n") == (False, False)


def test_numbers_of_five_digits_run_on():
    text = "class A {\n" + "".join(STUB.format(f"F{i}") for i in range(9_998, 10_003)) + "}\n"
    assert layout("a.java", text).numbered > 0.8 and verdict("file:p/src/A.java", text) == (True, False)
