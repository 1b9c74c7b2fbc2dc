"""A lexer of SQL text: what is code, what is comment or literal, where lists part. Keeps positions."""

from __future__ import annotations

import re

QUOTED = re.compile(r"\$([A-Za-z_\u0080-￿][\w\u0080-￿]*)?\$")


def masked(text: str, identifiers: bool = True, literal: str = " ") -> tuple[str, list[tuple[int, int]], list[str]]:
    """(text with comments and literals blanked, spans of dollar-quoted bodies, issues). Line feeds stay; comments nest;
    E-strings know backslashes; identifiers says whether quoted names are blanked too; literal fills strings."""
    out, bodies, issues, i, n = list(text), [], [], 0, len(text)

    def blank(a: int, b: int, fill: str = " ") -> None:
        for k in range(a, b):
            if out[k] != "\n":
                out[k] = fill

    while i < n:
        two = text[i : i + 2]
        if two == "--":
            end = text.find("\n", i)
            end = n if end < 0 else end
        elif two == "/*":
            depth, end = 1, i + 2
            while depth and end < n:
                mark = text[end : end + 2]
                depth += (mark == "/*") - (mark == "*/")
                end += 2 if mark in ("/*", "*/") else 1
            if depth:
                issues.append("unterminated comment")
                end = n
        elif text[i] == "'":
            escapes = i > 0 and text[i - 1] in "eE" and (i < 2 or not (text[i - 2].isalnum() or text[i - 2] == "_"))
            end = _closing(text, i, "'", escapes)
            if end < 0:
                issues.append("unterminated string")
                end = n
        elif text[i] == '"':
            end = _closing(text, i, '"', False)
            if end < 0:
                issues.append("unterminated identifier")
                end = n
            if not identifiers:
                i = end
                continue
        elif text[i] == "$" and (m := QUOTED.match(text, i)) and not (i and (text[i - 1].isalnum() or text[i - 1] in "_$")):
            close = text.find(m[0], m.end())
            if close < 0:
                issues.append("unterminated dollar quote")
            end = n if close < 0 else close + len(m[0])
            bodies.append((m.end(), n if close < 0 else close))
        else:
            i += 1
            continue
        blank(i, end, literal if text[i] == "'" else " ")
        i = end
    return "".join(out), bodies, issues


def _closing(text: str, start: int, mark: str, escapes: bool) -> int:
    i = start + 1
    while i < len(text):
        if escapes and text[i] == "\\":
            i += 2
        elif text[i] != mark:
            i += 1
        elif text[i + 1 : i + 2] == mark:
            i += 2
        else:
            return i + 1
    return -1


def parts(text: str, mark: str = ",") -> list[str]:
    """The parts of a list at the top level, outside quotes and brackets; ['' ] for an empty text; ValueError where brackets
    do not match."""
    code, _, _ = masked(text)
    out, depth, last = [], [], 0
    pairs = {")": "(", "]": "["}
    for i, c in enumerate(code):
        if c in "([":
            depth.append(c)
        elif c in pairs:
            if not depth or depth.pop() != pairs[c]:
                raise ValueError("brackets do not match")
        elif c == mark and not depth:
            out.append(text[last:i].strip())
            last = i + 1
    if depth:
        raise ValueError("brackets do not match")
    return [*out, text[last:].strip()]


TOKEN = re.compile(r"""\s+|--[^\n]*|/\*.*?\*/|(?P<text>[eE]?'(?:[^']|'')*')|(?P<name>"(?:[^"]|"")*")|(?P<word>[^\W\d]\w*)|(?P<number>\d+(?:\.\d+)?)|(?P<sign>::|<=|>=|<>|!=|\|\||.)""", re.S)


def expression_key(text: str) -> tuple[str, ...]:
    """Tokens by which two spellings of an expression are the same: words in lower case, literals and quoted names as they are."""
    out = []
    for m in TOKEN.finditer(text):
        if m.lastgroup:
            out.append(m[0].lower() if m.lastgroup == "word" else m[0])
    return tuple(out)


def statements(text: str) -> list[tuple[int, str]]:
    """(first line, statement) of each statement that ends in a semicolon or the text's end."""
    code, _, _ = masked(text, identifiers=False, literal="0")
    out, last, line, counted = [], 0, 1, 0
    for i in [*(k for k, c in enumerate(code) if c == ";"), len(text)]:
        rest = code[last:i].lstrip()  # comments before a statement are no part of it
        if rest:
            start = i - len(rest)
            line, counted = line + text.count("\n", counted, start), start
            out.append((line, text[start:i].strip()))
        last = i + 1
    return out
