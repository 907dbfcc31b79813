"""A lexer for the languages of the source tables, and layout measures of a file.

A file is cut into tokens, re-emitted in a canonical layout (one statement per line), and the original layout is held against
it. All measures are ratios, so they mean the same for files of any length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

_STRINGS = r'"(?:[^"\\\n]|\\.)*"?|\'(?:[^\'\\\n]|\\.)*\'?'
_WORDS = r"0[xX][0-9a-fA-F]+|\d[\w.]*|[^\W\d]\w*"
_REST = r"[^\w\s]"
_FAMILIES = {
    "hash": r'"""(?:[^\\]|\\.)*?(?:"""|\Z)|\'\'\'(?:[^\\]|\\.)*?(?:\'\'\'|\Z)|#[^\n]*|' + f"{_STRINGS}|{_WORDS}|{_REST}",
    "slash": r"//[^\n]*|/\*.*?(?:\*/|\Z)|`(?:[^`\\]|\\.)*`?|" + f"{_STRINGS}|{_WORDS}|{_REST}",
    "css": r"/\*.*?(?:\*/|\Z)|" + f"{_STRINGS}|{_WORDS}|{_REST}",
    "html": r"<!--.*?(?:-->|\Z)|" + f'"[^"]*"?|{_WORDS}|{_REST}',
}
_TOKENS = {name: re.compile(p + r"|\n", re.S) for name, p in _FAMILIES.items()}
#: The same with the blanks between tokens, so that the tokens make up the whole text.
_ALL_TOKENS = {name: re.compile(p + r"|\n|[^\S\n]+", re.S) for name, p in _FAMILIES.items()}
#: File name endings of the languages whose comments start with # or <!--, and of style sheets.
HASH_ENDINGS = ("py", "pyi", "rb", "sh", "bash", "pl", "r", "jl", "ex", "exs", "tf", "yaml", "yml", "toml")
HTML_ENDINGS = ("html", "htm", "xml", "svg", "vue", "astro", "md", "mdx")
CSS_ENDINGS = ("css", "scss", "less")

_WORD = re.compile(r"\w+")
_COUNTED = re.compile(r"[^\W\d_]\w*?(?<!\d)(\d{1,1000})(?![^\W_])")
#: Words of Python whose statement goes on behind a colon, and signs after which a line of the other languages goes on.
_BLOCK_WORDS = frozenset("if elif else for while with def class try except finally async match case".split())
_OPEN_ENDS = frozenset(",.+-*/%=&|<>?:!^~\\")
#: Lines between two lines that are compared: a statement that a tool repeats takes several lines in the canonical layout.
LAGS = range(1, 17)
#: How often at least a pattern of lines must fit into a file, and how many tokens it must hold, to count without running numbers:
#: lists of imports or constants repeat a shape as well.
REPEATS, PATTERN_TOKENS = 8, 12


def family(path: str) -> str:
    end = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    return "hash" if end in HASH_ENDINGS else "html" if end in HTML_ENDINGS else "css" if end in CSS_ENDINGS else "slash"


@dataclass
class Layout:
    """Measures of a file; see layout()."""

    comments: list[str] = field(default_factory=list)
    canonical_lines: int = 0
    expansion: float = 0.0
    literal_share: float = 0.0
    literal_chars: int = 0
    uniformity: float = 0.0
    repeated: float = 0.0
    numbered: float = 0.0
    code_lines: int = 0


def _is_comment(kind: str, t: str) -> bool:
    if kind == "slash":
        return t[:2] in ("//", "/*")
    if kind == "hash":
        return t[0] == "#"
    if kind == "css":
        return t[:2] == "/*"
    return t[:4] == "<!--"


def canonical(kind: str, tokens: list[str]) -> list[str]:
    """The tokens but for comments, one statement per line, with one blank between two tokens.

    A statement ends at a semicolon outside round and square brackets (those around a block aside) and where the line ends outside any bracket, unless a sign
    there shows that it goes on. Braces end a line where they hold blocks, a tag does in html; behind the colon of a block Python
    goes on with a new line.
    """
    out: list[str] = []
    line: list[str] = []
    hash_kind, braces = kind == "hash", kind in ("slash", "css")
    depth = curly = lambdas = 0
    around: list[int] = []

    def end() -> None:
        nonlocal lambdas
        if line and line != [";"]:
            out.append(" ".join(line).replace("\n", " "))
        line.clear()
        lambdas = 0

    for t in tokens:
        if t == "\n":
            if not line or depth or (hash_kind and curly):
                continue
            if hash_kind and line[-1] == "\\":
                line.pop()
            elif hash_kind or kind == "html" or line[-1] not in _OPEN_ENDS:
                end()
            continue
        if t[0] in "/#<" and _is_comment(kind, t):
            continue
        line.append(t)
        if len(t) > 1:
            lambdas += t == "lambda" and not depth and not curly
        elif t in "([":
            depth += 1
        elif t in ")]":
            depth -= depth > 0
        elif t == ";":
            if not depth:
                end()
        elif t in "{}":
            if braces:
                end()
                if t == "{":
                    around.append(depth)
                    depth = 0
                elif around:
                    depth = around.pop()
            else:
                curly = max(0, curly + (1 if t == "{" else -1))
        elif t == ":" and hash_kind and not depth and not curly:
            if lambdas:
                lambdas -= 1
            elif line[0] in _BLOCK_WORDS:
                end()
        elif t == ">" and kind == "html":
            end()
    end()
    return out


def uniformity(lines: list[str], n_tokens: int) -> tuple[float, float]:
    """Greatest share, over the distances of LAGS, of lines of the canonical layout that have the same shape as the line that many
    before; and the same over the distances at which REPEATS and PATTERN_TOKENS are met, more lines are repeated than at any shorter
    one, and half of the repetitions at least differ in their words. The shape of a line is its text with each word replaced."""
    n, best, repeated = len(lines), 0.0, 0.0
    ids: dict[str, int] = {}
    shapes = np.array([ids.setdefault(_WORD.sub("w", x), len(ids)) for x in lines])
    for lag in LAGS:
        if n > 2 * lag:
            share = float((shapes[lag:] == shapes[:-lag]).mean())
            if share > repeated and share > best + 0.02 and n >= REPEATS * lag and n_tokens * lag >= PATTERN_TOKENS * n:
                blocks = ["\n".join(lines[i : i + lag]) for i in range(0, n - lag + 1, lag)]
                repeated = share if 2 * len(set(blocks)) >= len(blocks) else repeated
            best = max(best, share)
    return best, repeated


def numbered(code: str) -> float:
    """Part of the lines that hold a name with a number at its end, where the numbers run on without a gap from the first
    line to the last; 0 if they don't."""
    lines = [x for x in code.split("\n") if x and not x.isspace()]
    seen: list[int] = []
    holding = 0
    for x in lines:
        m = _COUNTED.search(x)
        if m:
            holding += 1
            seen.append(int(m.group(1)))
    if len(set(seen)) < 3:
        return 0.0
    steps = sum(0 <= b - a <= 1 for a, b in zip(seen, seen[1:]))
    return holding / len(lines) if steps >= 0.9 * (len(seen) - 1) else 0.0


def layout(path: str, text: str) -> Layout:
    """Lexes text and measures it.

    expansion: lines of the canonical layout per original line that is not blank. uniformity, repeated: of the canonical layout. literal_share: characters in numbers and in
    strings without the look of prose, as a part of the characters in literals and names (comments, signs and spaces aside).
    numbered: see there; comments play no part in either.
    """
    kind = family(path)
    out = Layout()
    literal = names = 0
    tokens: list[str] = []
    code: list[str] = []
    for t in _ALL_TOKENS[kind].findall(text):
        c = t[0]
        n = len(t)
        code.append(t)
        if c.isspace():
            if c == "\n":
                tokens.append(t)
            continue
        tokens.append(t)
        if n == 1:
            if c.isdigit():
                literal += 1
            elif c.isalpha():
                names += 1
            continue
        if c in "/#<" and _is_comment(kind, t):
            out.comments.append(t)
            code[-1] = " "
        elif c.isdigit():
            literal += n
        elif c in "\"'`":
            if t[:3] not in ('"""', "'''") and t.count(" ") <= n / 30:
                literal += n
            else:
                names += n
        else:
            names += n
    bare = "".join(code)
    out.code_lines = sum(1 for x in bare.split("\n") if x and not x.isspace())
    lines = canonical(kind, tokens)
    out.canonical_lines = len(lines)
    out.expansion = out.canonical_lines / max(1, out.code_lines)
    out.literal_chars = literal
    out.literal_share = literal / max(1, literal + names)
    out.uniformity, out.repeated = uniformity(lines, sum(t != "\n" for t in tokens) - len(out.comments))
    out.numbered = numbered(bare)
    return out
