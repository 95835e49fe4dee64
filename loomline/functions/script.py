"""Tokens of TypeScript and JavaScript texts, and the declarations and imports among them.

The lexer keeps a stack of modes: code, template literals with code inside them, and elements of JSX with code inside those. A slash
starts a regular expression where an operand may stand, else it divides. What isn't closed ends with the text.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # word, string, number, regex, template, element or the sign itself
    text: str
    at: int
    line: int
    fresh: bool  # first of its line


_SKIP = re.compile(r"\s+|//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_CODE = re.compile(
    r"(?P<word>#?[^\W\d][\w$]*|#?\$[\w$]*)|(?P<number>\.?\d[\w.]*)|(?P<string>'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?)|(?P<sign>=>|\.\.\.|\?\.(?!\d)|[^\s])", re.S
)
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
_ELEMENT = re.compile(r"<(?:[A-Za-z_$][\w$.:-]*(?!\s*,|\s+extends\b)|(?=>))")
_TAG = re.compile(r"\s+|//[^\n]*|/\*.*?\*/|'[^']*'|\"[^\"]*\"|[\w$.:-]+|=|/>|[>{<]|.", re.S)
#: Words after which an operand stands, and words that carry an expression on over a line's end.
_OPERAND = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "await", "yield", "default", "extends"}
_SHOWN = {"return", "case", "default", "yield", "await", "else"}  # and words after which markup may stand
_ON = {"in", "instanceof", "as", "satisfies", "of", "extends", "implements"}
_UNFINISHED = (_ON | _OPERAND | {"export", "async", "const", "let", "var"}) - {"void"}  # which may be a type
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}"}, {")", "]", "}"}


def tokens(text: str, jsx: bool) -> list[Token]:
    out, modes, at, line, counted = [], [["code", 0]], 0, 1, 0

    def add(kind: str, value: str, place: int) -> None:
        nonlocal line, counted
        n = text.count("\n", counted, place)
        fresh = not out or n > 0 or "\n" in text[out[-1].at : place]
        line, counted = line + n, place
        out.append(Token(kind, value, place, line, fresh))

    while at < len(text):
        mode = modes[-1]
        if mode[0] == "template":
            at = _TEMPLATE.match(text, at).end()
            if text.startswith("${", at):
                add("${", "${", at)
                modes.append(["code", 0])
                at += 2
            else:
                add("template", "`", min(at, len(text) - 1))
                modes.pop()
                at += 1
            continue
        if mode[0] == "tag":  # between < and >
            m = _TAG.match(text, at)
            at = m.end()
            if m[0] == "{":
                add("{", "{", m.start())
                modes.append(["code", 0])
            elif m[0] == "/>" or m[0] == ">":
                add("element", m[0], m.start())
                modes.pop()
                if m[0] == ">" and not mode[1]:
                    modes.append(["children"])
            continue
        if mode[0] == "children":
            end = min((x for x in (text.find("<", at), text.find("{", at)) if x >= 0), default=len(text))
            at = end + 1
            if end == len(text):
                break
            if text[end] == "{":
                add("{", "{", end)
                modes.append(["code", 0])
            else:
                closing = text.startswith("</", end)
                add("element", "<", end)
                if closing:
                    modes.pop()
                modes.append(["tag", closing])
                at += closing
            continue
        if m := _SKIP.match(text, at):
            at = m.end()
            continue
        before = out[-1] if out else None
        operand = before is None or (before.text in _OPERAND if before.kind == "word" else before.kind not in ("number", "string", "regex", "template", "element", ")", "]"))
        if text[at] == "/" and operand and (m := _REGEX.match(text, at)):
            add("regex", m[0], at)
            at = m.end()
            continue
        if jsx and text[at] == "<" and operand and (before is None or before.kind != "word" or before.text in _SHOWN) and (m := _ELEMENT.match(text, at)):
            add("element", "<", at)
            modes.append(["tag", False])
            at = m.end()
            continue
        m = _CODE.match(text, at)
        kind = m.lastgroup if m.lastgroup != "sign" else m[0]
        if kind == "`":
            add("template", "`", at)
            modes.append(["template"])
        elif kind == "}" and not mode[1] and len(modes) > 1:
            add("}", "}", at)
            modes.pop()
        else:
            mode[1] += (kind == "{") - (kind == "}" and mode[1] > 0)
            add(kind, m[0], at)
        at = m.end()
    return out


def matches(code: list[Token]) -> list[int]:
    """For each opening bracket the place of its closing one, or of the end."""
    ends, stack = [len(code)] * len(code), []
    for i, t in enumerate(code):
        if t.kind in _OPEN:
            stack.append(i)
        elif t.kind in _CLOSE:
            while stack and _OPEN[code[stack[-1]].kind] != t.kind:
                stack.pop()
            if stack:
                ends[stack.pop()] = i
    return ends


class Script:
    """The statements of a text."""

    def __init__(self, text: str, jsx: bool) -> None:
        self.code = tokens(text, jsx)
        self.ends = matches(self.code)
        self.text = text

    def word(self, i: int) -> str:
        return self.code[i].text if i < len(self.code) and self.code[i].kind == "word" else ""

    def sign(self, i: int) -> str:
        return self.code[i].kind if i < len(self.code) else ""

    def angles(self, i: int) -> int:
        """Where type arguments that begin at i end, or i where it's a comparison."""
        depth, j = 0, i
        while j < len(self.code):
            kind = self.code[j].kind
            if kind in ("<", ">"):
                depth += 1 if kind == "<" else -1
                if not depth:
                    return j + 1
            elif kind in _OPEN:
                j = self.ends[j]
            elif kind in _CLOSE or kind in (";", "+", "-", "*", "/", "%", "!", "^"):
                return i
            j += 1
        return i

    def ends_here(self, i: int) -> bool:
        """Whether a statement ends before a token that begins a line."""
        if not self.code[i].fresh:
            return False
        last, now = self.code[i - 1], self.code[i]
        done = last.text not in _UNFINISHED if last.kind == "word" else last.kind in ("string", "number", "regex", "template", "element", ")", "]", "}", ">")
        return done and (now.text not in _ON if now.kind == "word" else now.kind in ("string", "number", "@", "}", "{", "#", "*"))

    def after(self, i: int, stop: set[str], types: bool = False) -> int:
        """The first token from i on, outside brackets, that is one of stop, or where the statement ends."""
        first = i
        while i < len(self.code):
            kind = self.code[i].kind
            if kind in stop or i > first and self.ends_here(i):
                return i
            if kind == "<":
                end = self.angles(i)
                if end > i and (types or self.sign(end) in ("(", "template")):
                    i = end
                    continue
            i = self.ends[i] + 1 if kind in _OPEN else i + 1
        return i

    def decorated(self, i: int) -> int:
        while self.sign(i) == "@":
            i += 2
            while self.sign(i) == ".":
                i += 2
            i = self.ends[i] + 1 if self.sign(i) == "(" else i
        return i

    def declarations(self, tsx: bool) -> list[tuple]:
        """(name, kind, line, exported, async, priority) of top-level declarations and of the methods of classes."""
        found, i = [], 0

        def add(name: str, kind: str, line: int, out: bool, later: bool = False) -> None:
            found.append((name, kind, line, out, later, 7 if out else 5 if kind in ("class", "interface") else 3))

        shaped = lambda name, kind: "component" if tsx and "A" <= name[0] <= "Z" else kind
        while i < len(self.code):
            begin, words = i, set()
            i = self.decorated(i)
            while self.word(i) in ("export", "default", "declare", "abstract", "async") and not (self.sign(i + 1) in ("=", ".", "(", ":", "=>") or i + 1 < len(self.code) and self.code[i + 1].fresh and self.word(i) != "export"):
                words.add(self.word(i))
                i = self.decorated(i + 1)
            if i >= len(self.code):
                break
            line, out, head = self.code[begin].line, "export" in words, self.word(i)
            if head == "const" and self.word(i + 1) == "enum":
                i, head = i + 1, "enum"
            if head in ("const", "let", "var"):
                i += 1
                while i < len(self.code):
                    if name := self.word(i):
                        add(name, shaped(name, "variable"), self.code[i].line, out)
                    i = self.after(i, {":", "=", ",", ";"})
                    if self.sign(i) == ":":
                        i = self.after(i + 1, {"=", ",", ";"}, types=True)
                    if self.sign(i) == "=":
                        i = self.after(i + 1, {",", ";"})
                    if self.sign(i) != ",":
                        break
                    i += 1
            elif head == "function":
                i += 1 + (self.sign(i + 1) == "*")
                if name := self.word(i):
                    add(name, shaped(name, "function"), line, out, "async" in words)
                i = self.body(i)
            elif head == "class":
                name = self.word(i + 1)
                start = self.after(i + 1, {"{", ";"}, types=True)
                if self.sign(start) == "{":
                    if name and name not in ("extends", "implements"):
                        add(name, "class", line, out)
                        self.methods(start + 1, self.ends[start], lambda n, at, later, name=name, out=out: add(f"{name}.{n}", "method", at, out, later))
                    start = self.ends[start]
                i = start + 1
            elif head in ("interface", "enum", "type") and self.word(i + 1) and not self.code[i + 1].fresh:
                add(self.word(i + 1), head, line, out)
                i = self.after(i + 2, {";"}, types=True) if head == "type" else self.body(i + 2)
            elif self.sign(i) == "{":
                i = self.ends[i] + 1
            else:
                i = max(self.after(i, {";"}), begin + 1)
            while self.sign(i) == ";":
                i += 1
        return found

    def body(self, i: int) -> int:
        """Behind the braces that a declaration's head leads to; heads without any end with their line."""
        while i < len(self.code) and self.sign(i) not in ("{", ";") and not (self.ends_here(i) and self.sign(i) != "{"):
            if self.sign(i) == ":" and self.sign(i - 1) == ")":  # a type, which may have braces of its own
                i += 1
                while self.sign(i) in ("{", "[", "(") or self.sign(i) == "<":
                    i = self.angles(i) if self.sign(i) == "<" and self.angles(i) > i else self.ends[i] + 1
            elif self.sign(i) == "<":
                i = max(i + 1, self.angles(i))
            else:
                i = self.ends[i] + 1 if self.sign(i) in _OPEN else i + 1
        return self.ends[i] + 1 if self.sign(i) == "{" else i

    def methods(self, i: int, end: int, add: object) -> None:
        words = {"public", "private", "protected", "static", "async", "override", "abstract", "readonly", "declare", "accessor", "get", "set"}
        while i < end:
            begin, met = i, set()
            i = self.decorated(i)
            while self.word(i) in words and self.sign(i + 1) not in ("(", "=", ";", ":", "?", "!", "}", "<") and not (self.code[i + 1].fresh and (self.sign(i + 1) != "word" or self.word(i) == "async")):
                met.add(self.word(i))
                i += 1
            if self.sign(i) == "{" and met == {"static"}:
                i = self.ends[i] + 1
                continue
            i += self.sign(i) == "*"
            if i >= end:
                break
            name = self.code[i]
            after = self.ends[i] + 1 if name.kind == "[" else i + 1
            shown = self.text[name.at : self.code[after - 1].at + 1] if name.kind == "[" else name.text
            after += self.sign(after) in ("?", "!")
            after = self.angles(after) if self.sign(after) == "<" else after
            if self.sign(after) == "(" and name.kind in ("word", "string", "number", "["):
                if shown != "constructor" and not met & {"get", "set"}:
                    add(shown, self.code[begin].line, "async" in met)
                i = self.body(after)
            elif after < end and self.code[after].fresh and self.sign(after) in ("word", "string", "number", "[", "@", "*"):
                i = after  # a name alone
            else:
                i = max(self.after(i, {";"}), begin + 1)
            while i < end and self.sign(i) in (";", ","):
                i += 1

    def imports(self) -> list[tuple[str, str]]:
        """(source, kind) of imports, re-exports, dynamic imports and calls of require, in their order."""
        found = []
        for i, t in enumerate(self.code):
            if t.kind != "word" or t.text not in ("import", "export", "require") or self.sign(i - 1) in (".", "?.") and i:
                continue
            if self.sign(i + 1) == "(":
                if self.sign(i + 2) == "string" and t.text != "export" and self.sign(i + 3) in (")", ",") and not (i and self.word(i - 1) in ("new", "function")) and not (t.text == "require" and i > 2 and self.sign(i - 1) == "=" and self.word(i - 3) in ("import", "type")):
                    found.append((unquoted(self.code[i + 2].text), "dynamic-import" if t.text == "import" else "require"))
            elif t.text != "require" and (not i or t.fresh or self.sign(i - 1) in (";", "{", "}")):
                if t.text == "import" and self.sign(i + 1) == "string":
                    found.append((unquoted(self.code[i + 1].text), "import"))
                    continue
                j, named = i + 1, self.sign(i + 1) in ("{", "*") or self.word(i + 1) == "type" and self.sign(i + 2) in ("{", "*")
                while j < len(self.code) and (self.sign(j) in ("word", "{", ",", "*")) and not (self.word(j) == "from" and self.sign(j + 1) == "string"):
                    j = self.ends[j] + 1 if self.sign(j) == "{" else j + 1
                if self.word(j) == "from" and self.sign(j + 1) == "string" and (t.text == "import" or named):
                    found.append((unquoted(self.code[j + 1].text), "import" if t.text == "import" else "export-from"))
        return found


def unquoted(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text[1:-1] if len(text) > 1 and text[-1] == text[0] else text[1:], flags=re.S)
