"""Declarations of scripts and PHP, and statements of SQL, from tokens: a lexer that knows texts, templates, comments,
regular expressions and heredocs, and a stack of open brackets. No grammar is run; tasks read a file at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Token(NamedTuple):
    kind: str  # word, text or sign
    value: str
    line: int
    start: int
    end: int


TEXTS = r""" "(?:\\.|[^"\\])*" | '(?:\\.|[^'\\])*' """
LEXERS = {
    "script": r"(?P<skip>\s+ | //[^\n]* | /\*.*?(?:\*/|\Z)) | (?P<text>" + TEXTS + r") | (?P<word>[^\W\d][\w$]*|[$][\w$]*|\#\w+|\d[\w.]*) | (?P<sign>=>|\?\.|\.\.\.|.)",
    "php": r"(?P<skip>\s+ | (?://|\#(?!\[)) (?:(?!\?>)[^\n])* | /\*.*?(?:\*/|\Z) | \?>.*?(?:<\?php\b|<\?=|\Z)) | (?P<text>" + TEXTS + r"|<<<[ \t]*(?P<q>['\"]?)(?P<tag>\w+)(?P=q)\n.*?\n?[ \t]*(?P=tag)\b) | (?P<word>\$?[\w\\]+) | (?P<sign>=>|->|::|.)",
    "sql": r"(?P<skip>\s+ | --[^\n]* | /\*.*?(?:\*/|\Z)) | (?P<text>'(?:''|[^'])*'?) | (?P<name>\"(?:\"\"|[^\"])*\"|`[^`]*`|\[[^\]\n]*\]) | (?P<word>[\w$@]+) | (?P<sign>.)",
}
LEXERS = {k: re.compile(p, re.S | re.X) for k, p in LEXERS.items()}
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: Words after which a slash begins a regular expression.
BEFORE_REGEX = frozenset("return typeof case in of new delete void throw do else instanceof yield await".split())
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")


def template_end(text: str, at: int) -> int:
    """The place after the template that begins at a backtick; expressions within hold code of their own."""
    at += 1
    while at < len(text) and text[at] != "`":
        if text[at] == "\\":
            at += 2
        elif text.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(text) and depth:
                if text[at] == "`":
                    at = template_end(text, at)
                    continue
                if text[at] in "'\"":
                    end = re.compile(TEXTS, re.X | re.S).match(text, at)
                    at = end.end() if end else at + 1
                    continue
                depth += {"{": 1, "}": -1}.get(text[at], 0)
                at += 1
        else:
            at += 1
    return min(at + 1, len(text))


def tokens(text: str, language: str) -> list[Token]:
    pattern, out, at, line = LEXERS[language], [], 0, 1
    if language == "php":
        begin = re.search(r"<\?php\b|<\?=", text)
        at = begin.end() if begin else len(text)
        line += text.count("\n", 0, at)
    while at < len(text):
        kind = end = None
        if language == "script" and text[at] == "`":
            kind, end = "text", template_end(text, at)
        elif language == "script" and text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*"):
            last = out[-1] if out else None
            value_before = last and (last.kind == "text" or last.value in (")", "]", "}") or last.kind == "word" and last.value not in BEFORE_REGEX)
            if not value_before and (found := REGEX.match(text, at)):
                kind, end = "text", found.end()
        if kind is None:
            found = pattern.match(text, at)
            kind, end = next(k for k in ("skip", "text", "name", "word", "sign") if found.groupdict().get(k) is not None), found.end()
        if kind != "skip":
            value = text[at:end]
            if kind == "name":  # a quoted name of SQL
                kind, value = "word", value[1:-1].replace('""', '"')
            out.append(Token(kind, value, line, at, end))
        line += text.count("\n", at, end)
        at = end
    return out


def past(found: list[Token], at: int) -> int:
    """The place after the bracket that closes the one at ``at``; brackets within count by depth alone."""
    depth = 0
    for i in range(at, len(found)):
        if found[i].kind == "sign":
            depth += (found[i].value in OPEN) - (found[i].value in CLOSE)
            if not depth:
                return i + 1
    return len(found)


def parted(found: list[Token]) -> list[list[Token]]:
    """Tokens between commas outside all brackets, angle brackets included."""
    out, depth = [[]], 0
    for t in found:
        if t.kind == "sign":
            depth += (t.value in "([{<") - (t.value in ")]}>")
        if t.kind == "sign" and t.value == "," and depth <= 0:
            out.append([])
        else:
            out[-1].append(t)
    return [p for p in out if p]


def spaced(found: list[Token], text: str) -> str:
    return re.sub(r"\s+", " ", text[found[0].start : found[-1].end]) if found else ""


MODIFIERS = frozenset("public private protected static async abstract override get set readonly final declare".split())
CONTROL = frozenset("if for while switch catch return function with elseif foreach match new typeof await yield throw echo print isset unset empty list array exit die include require include_once require_once super constructor use fn isset declare".split())
HOLDERS = frozenset(("class", "interface", "trait", "enum"))


class Declaration(NamedTuple):
    kind: str
    name: str
    holder: str | None
    start_line: int
    end_line: int
    parameters: list[tuple[str, str]]
    returns: str
    exported: bool
    is_async: bool
    calls: list[str]


class Reader:
    """One pass over the tokens of a file: declarations, with what is open as a stack of braces."""

    def __init__(self, text: str, language: str) -> None:
        self.text, self.language, self.t = text, language, tokens(text, language)
        self.found: list[dict] = []
        self.stack: list[dict | None] = []  # a declaration for each brace that opens one's body
        self.bodies: dict[int, dict] = {}  # by the place of the brace
        self.names: set[int] = set()  # places of names that are declared, not called
        self.declarators: dict[int, bool] = {}  # places where a further name of a const, let or var stands: exported?

    def at(self, i: int) -> str:
        return self.t[i].value if 0 <= i < len(self.t) and self.t[i].kind != "text" else ""

    def word(self, i: int) -> str | None:
        return self.t[i].value if 0 <= i < len(self.t) and self.t[i].kind == "word" and not self.t[i].value[0].isdigit() else None

    def holder(self) -> dict | None:
        return next((d for d in reversed(self.stack) if d and d["kind"] in HOLDERS), None)

    def add(self, kind: str, name: str, i: int, last: int | None = None, **rest) -> dict:
        own = self.holder()
        first = self.first_of(i)
        made = {"kind": kind, "name": name, "holder": own["name"] if own else None, "start_line": self.t[first].line, "end_line": self.t[min(last if last is not None else i, len(self.t) - 1)].line, "parameters": [], "returns": "", "calls": []}
        before = {self.at(k) for k in range(first, i)}
        made |= {"exported": "export" in before, "is_async": "async" in before, **rest}
        self.found.append(made)
        return made

    def first_of(self, i: int) -> int:
        """Where the modifiers of a declaration begin."""
        while i and (self.at(i - 1) in MODIFIERS or self.at(i - 1) in ("export", "default", "const") and self.at(i - 1) != self.at(i)):
            i -= 1
        return i

    def body(self, made: dict, i: int, least: int = 0) -> int:
        """The place of a declaration's body from ``i`` on, which it gets; a head without one ends there."""
        depth = 0
        while i < len(self.t):
            v = self.at(i)
            if v == "{" and not depth:
                self.bodies[i] = made
                return i
            if v in (";", "}") and not depth:
                break
            depth += (v in ("(", "[")) - (v in (")", "]"))
            i += 1
        made["end_line"] = self.t[min(max(i, least), len(self.t) - 1)].line if self.at(i) == ";" else self.t[max(i - 1, 0)].line
        return i

    def signature(self, made: dict, i: int) -> int:
        """Parameters and return type from the bracket at ``i``; the place after them."""
        end = past(self.t, i)
        for part in parted(self.t[i + 1 : end - 1]):
            part = [p for p in part if p.value not in MODIFIERS and p.value not in ("...", "&")]
            if self.language == "php":
                name = next((p for p in part if p.value.startswith("$")), None)
                if name:
                    made["parameters"].append((name.value, spaced(part[: part.index(name)], self.text)))
                continue
            head = past(part, 0) if part and part[0].value in ("{", "[") else 1  # a pattern is its own name
            cut = next((k for k in range(head, len(part)) if part[k].kind == "sign" and part[k].value in (":", "=")), len(part))
            if cut < len(part) and part[cut].value == "=":
                part = part[:cut]
            stop = next((k for k in range(cut, len(part)) if part[k].kind == "sign" and part[k].value == "="), len(part))
            if part:
                made["parameters"].append((spaced(part[:cut], self.text).rstrip("?").strip(), spaced(part[cut + 1 : stop], self.text)))
        if self.at(end) == ":":
            stop, depth = end + 1, 0
            while stop < len(self.t) and (depth or self.at(stop) not in ("{", ";", "=>", "}") or self.at(stop) == "{" and self.at(stop - 1) in (":", "|", "&", "<")):
                depth += (self.at(stop) in ("(", "[", "{", "<")) - (self.at(stop) in (")", "]", "}", ">"))
                stop += 1
            made["returns"] = spaced(self.t[end + 1 : stop], self.text)
            return stop
        return end

    def angle(self, i: int) -> int:
        """The place after type parameters."""
        if self.at(i) != "<":
            return i
        depth = 0
        while i < len(self.t):
            depth += (self.at(i) == "<") - (self.at(i) == ">")
            i += 1
            if not depth or self.at(i) in (";", "{") and depth < 0:
                break
        return i

    def value_end(self, i: int) -> int:
        """Where the value of a declarator ends: at a comma or semicolon outside brackets, or on a new line that begins anew."""
        depth = 0
        while i < len(self.t):
            v = self.at(i)
            if not depth and (v in (",", ";") or v in CLOSE):
                return i
            depth += (v in OPEN) - (v in CLOSE)
            if not depth and i + 1 < len(self.t) and self.t[i + 1].line > self.t[i].line and (self.t[i].kind != "sign" or v in CLOSE) and self.t[i + 1].kind != "sign" and self.at(i + 1) not in ("instanceof", "in", "as"):
                return i + 1
            i += 1
        return i

    def declarator(self, i: int, exported: bool) -> int:
        """A name of a const, let or var: a function if its value is one."""
        name = self.word(i)
        k = i + 1
        if name is None:  # a pattern has no name of its own
            return past(self.t, i) if self.at(i) in OPEN else i
        if self.at(k) == ":":
            depth = 0
            while k < len(self.t) and (depth or self.at(k) not in ("=", ",", ";")) and not (not depth and self.t[k].line > self.t[i].line and self.t[k].kind == "word"):
                depth += (self.at(k) in ("(", "[", "{", "<")) - (self.at(k) in (")", "]", "}", ">"))
                k += 1
        end = self.value_end(k + 1) if self.at(k) == "=" else k
        if self.at(end) == ",":
            self.declarators[end + 1] = exported
        if self.at(k) != "=":
            self.add("variable", name, i, i, exported=exported)
            return k
        is_async = self.at(k + 1) == "async"
        v = k + 1 + is_async
        if self.at(v) == "function":
            made = self.add("function", name, i, end - 1, exported=exported, is_async=is_async)
            p = next((j for j in range(v, min(v + 4, len(self.t))) if self.at(j) == "("), None)
            return self.body(made, self.signature(made, p)) if p is not None else v + 1
        p = self.angle(v)
        arrow = past(self.t, p) if self.at(p) == "(" else p + 1
        if self.at(arrow) == ":":
            while arrow < end and self.at(arrow) != "=>":
                arrow += 1
        if self.at(arrow) == "=>" and (self.at(p) == "(" or self.word(p)):
            made = self.add("function", name, i, end - 1, exported=exported, is_async=is_async)
            if self.at(p) == "(":
                self.signature(made, p)
            else:
                made["parameters"].append((self.at(p), ""))
            if self.at(arrow + 1) == "{":
                self.bodies[arrow + 1] = made
            return arrow + 1
        self.add("variable", name, i, max(i, end - 1), exported=exported)
        return k + 1

    def imported(self, i: int) -> None:
        """The module of an import or a re-export that begins at ``i``."""
        k = i + 1
        if self.at(k) == "(":
            k += 1
        while k < len(self.t) and self.t[k].kind != "text":
            if self.at(k) in (";", "=", "(", "function", "class") or self.t[k].line > self.t[i].line and self.at(k) in ("import", "export", "const"):
                return
            k = past(self.t, k) if self.at(k) == "{" else k + 1
        if k < len(self.t) and (self.at(i) == "import" or self.at(k - 1) == "from"):
            self.add("import", self.t[k].value[1:-1], i, k)

    def read(self) -> list[Declaration]:
        i, after = 0, 0  # after: tokens before it are parts of a head that was read
        while i < len(self.t):
            token, v = self.t[i], self.at(i)
            before = self.at(i - 1)
            if v == "{":
                self.stack.append(self.bodies.get(i))
            elif v == "}":
                if self.stack and (done := self.stack.pop()):
                    done["end_line"] = token.line
            elif i in self.declarators:
                after = max(after, self.declarator(i, self.declarators[i]))
            elif token.kind == "word" and i >= after and before not in (".", "?.", "->", "::"):
                after = max(after, self.head(i, v, before))
            if token.kind == "word" and self.at(i + 1) in ("(", "?.") and (self.at(i + 1) == "(" or self.at(i + 2) == "("):
                self.call(i)
            i += 1
        for open_ in self.stack:
            if open_:
                open_["end_line"] = self.text.count("\n") + 1
        return [Declaration(**d) for d in self.found]

    def head(self, i: int, v: str, before: str) -> int:
        """A declaration that begins with the word at ``i``, if one does; the place after its head."""
        script = self.language == "script"
        inside = self.stack[-1] if self.stack else None
        holds = inside is not None and inside["kind"] in HOLDERS and inside["kind"] != "enum" or inside is not None and inside["kind"] == "enum" and not script
        if v in HOLDERS and not holds and self.at(i + 1) not in ("(", ":", "=", ",", ".", ";", ")") and (script or before != "new") and (v != "trait" or not script):
            name = self.word(i + 1) if self.at(i + 1) not in ("extends", "implements") else None
            if v == "enum" and name is None or v == "interface" and name is None:
                return i
            made = self.add(v, name or "default", i, i)
            return self.body(made, i + 1)
        if script and v == "type" and self.word(i + 1) and self.at(self.angle(i + 2)) == "=":
            self.add("type_alias", self.at(i + 1), i, max(i, self.value_end(self.angle(i + 2) + 1) - 1))
            return i + 2
        if v == "function" and not holds:
            k = i + 1 + (self.at(i + 1) in ("*", "&"))
            name = self.word(k)
            p = self.angle(k + (name is not None))
            if self.at(p) != "(" or name is None and not (script and before == "default"):
                return i
            self.names.add(k)
            made = self.add("function", name or "default", i)
            return self.body(made, self.signature(made, p))
        if script and v in ("const", "let", "var") and self.at(i + 1) != "enum":
            return self.declarator(i + 1, before == "export")
        if script and v in ("import", "export") and before != ".":
            self.imported(i)
            return i
        if not script and v == "namespace" and self.word(i + 1):
            self.add("namespace", self.at(i + 1), i, i + 1)
            return i + 2
        if not script and v == "use" and not self.stack and self.at(i + 1) != "(":
            k = i + 1 + (self.at(i + 1) in ("function", "const"))
            if self.word(k):
                self.add("import", self.at(k).lstrip("\\"), i, k)
            return k + 1
        if not script and v in ("require", "require_once", "include", "include_once"):
            k = i + 1 + (self.at(i + 1) == "(")
            if k < len(self.t) and self.t[k].kind == "text":
                self.add("import", self.t[k].value[1:-1], i, k)
            return i
        if holds:
            return self.member(i, v, before)
        return i

    def member(self, i: int, v: str, before: str) -> int:
        if self.language == "php":
            k = i + 1 + (self.at(i + 1) == "&")
            if v == "function" and self.word(k) and self.at(k + 1) == "(":
                self.names.add(k)
                made = self.add("method", self.at(k), i)
                return self.body(made, self.signature(made, k + 1))
            return i
        if v in MODIFIERS and self.at(i + 1) not in ("(", "=", ":", "?", ";") or before not in ("{", "}", ";", "*", ")") and before not in MODIFIERS and self.t[i - 1].line == self.t[i].line:
            return i
        p = self.angle(i + 1 + (self.at(i + 1) == "?"))
        if self.at(p) == "(" and v not in CONTROL - {"constructor"}:
            self.names.add(i)
            made = self.add("method", v, i)
            return self.body(made, self.signature(made, p))
        return i

    def call(self, i: int) -> None:
        own = next((d for d in reversed(self.stack) if d and d["kind"] in ("function", "method")), None)
        if own is None or i in self.names or self.at(i) in CONTROL or self.at(i - 1) in ("function", "class"):
            return
        first = i
        while self.at(first - 1) in (".", "?.", "->", "::") and self.word(first - 2):
            first -= 2
        name = "".join(self.at(k).replace("?.", ".") for k in range(first, i + 1))
        own["calls"].append(("new " if self.at(first - 1) == "new" else "") + name)


SHAPE = "kind string, name string, holder string, start_line int, end_line int, parameters array<struct<name:string,type:string>>, returns string, exported boolean, is_async boolean, calls array<string>"


def lexed_declarations(files: DataFrame, key: str, text: str, language: str = "script") -> DataFrame:
    """(key, kind, name, holder, lines, parameters, returns, exported, is_async, calls) of each file's declarations; null texts have none.

    Functions of classes, interfaces and traits are methods; calls are those of a
    function's own body. What has no name is ``default``. Fields are not listed.
    """
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *d[:5], [{"name": n, "type": t} for n, t in d.parameters], *d[6:]) for k, t in zip(batch["k"], batch["t"], strict=True) if t for d in Reader(t, language).read()]
            yield pd.DataFrame(rows, columns=["k", *Declaration._fields])

    return files.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, {SHAPE}").withColumnRenamed("k", key)


# Words that begin a constraint, not a column, and those that end a column's type.
CONSTRAINTS = ("primary", "foreign", "unique", "check", "constraint", "key", "index")
AFTER_TYPE = frozenset("primary not null unique default references check collate generated constraint autoincrement auto_increment as comment on".split())
OBJECTS = ("table", "view", "index", "trigger")


class Statement:
    """Kind, name, columns, tables read and foreign keys of one SQL statement."""

    def __init__(self, found: list[Token], text: str) -> None:
        self.t, self.text, self.line = found, text, found[0].line
        self.columns: list[tuple[int, str, str]] = []
        self.references: list[tuple[str, str, str]] = []
        self.kind, self.name = self.low(0), ""
        getattr(self, f"_{self.kind}", lambda: None)()
        self.tables = self._tables()

    def low(self, i: int) -> str:
        return self.t[i].value.lower() if 0 <= i < len(self.t) and self.t[i].kind != "text" else ""

    def named(self, i: int) -> tuple[str, int]:
        """A name with its qualifiers, and the place after it."""
        while self.low(i) in ("if", "not", "exists"):
            i += 1
        if i >= len(self.t) or self.t[i].kind != "word":
            return "", i
        parts = [self.t[i].value]
        i += 1
        while self.low(i) == "." and i + 1 < len(self.t):
            parts.append(self.t[i + 1].value)
            i += 2
        return ".".join(parts), i

    def inside(self, i: int) -> list[list[Token]]:
        """The parts between the bracket at ``i`` and the one that closes it."""
        out, depth = [[]], 0
        for t in self.t[i + 1 : past(self.t, i) - 1]:
            depth += t.kind == "sign" and (t.value == "(") - (t.value == ")")
            if t.kind == "sign" and t.value == "," and not depth:
                out.append([])
            else:
                out[-1].append(t)
        return out

    def _create(self) -> None:
        at = next((k for k in range(1, min(8, len(self.t))) if self.low(k) in OBJECTS), None)
        if at is None:
            return
        self.kind = f"create_{self.low(at)}"
        self.name, i = self.named(at + 1)
        if self.kind == "create_index" and self.low(i) == "on":
            _, i = self.named(i + 1)
            if self.low(i) == "(":
                self.columns = [(pos, p[0].value, "") for pos, p in enumerate(self.inside(i)) if p]
        elif self.kind == "create_table" and self.low(i) == "(":
            for pos, part in enumerate(self.inside(i)):
                if part:
                    self._column(pos, part)
        elif self.kind == "create_view" and self.low(i) == "(":
            self.columns = [(pos, p[0].value, "") for pos, p in enumerate(self.inside(i)) if p]

    def _column(self, pos: int, part: list[Token]) -> None:
        words = [t.value.lower() if t.kind == "word" else "" for t in part]
        quoted = self.text[part[0].start] in "\"`["
        if words[0] in CONSTRAINTS and not quoted:
            near, far = (words.index(w) if w in words else len(words) for w in ("foreign", "references"))
            own = [t.value for t in part[near + 2 : far] if t.kind == "word"]
        else:
            stop = next((k for k in range(1, len(part)) if words[k] in AFTER_TYPE), len(part))
            self.columns.append((pos, part[0].value, spaced(part[1:stop], self.text)))
            own = [part[0].value]
        if "references" in words:
            inner = Statement.__new__(Statement)
            inner.t, inner.text = part, self.text
            target, i = inner.named(words.index("references") + 1)
            there = [p[0].value for p in inner.inside(i) if p] if inner.low(i) == "(" else []
            self.references += [(c, target, there[k] if k < len(there) else "") for k, c in enumerate(own)]

    def _insert(self) -> None:
        at = next((k for k in range(1, min(6, len(self.t))) if self.low(k) == "into"), 0)
        self.name, i = self.named(at + 1)
        if self.low(i) == "(":
            self.columns = [(pos, p[0].value, "") for pos, p in enumerate(self.inside(i)) if p]

    _replace = _insert

    def _update(self) -> None:
        self.name, i = self.named(3 if self.low(1) == "or" else 1)
        depth, fresh = 0, False
        for k in range(i, len(self.t)):
            v = self.low(k)
            depth += (v == "(") - (v == ")")
            if not depth and v in ("where", "from", "returning"):
                break
            if not depth and v in ("set", ","):
                fresh = True
            elif fresh and self.t[k].kind == "word":
                self.columns.append((len(self.columns), self.t[k].value, ""))
                fresh = False

    def _delete(self) -> None:
        self.name, _ = self.named(2 if self.low(1) == "from" else 1)

    def _drop(self) -> None:
        self.kind = f"drop_{self.low(1)}"
        self.name, _ = self.named(2)

    def _alter(self) -> None:
        self.kind = f"alter_{self.low(1)}"
        self.name, i = self.named(2)
        if self.low(i) == "add":
            part = self.t[i + 1 + (self.low(i + 1) == "column") :]
            if part:
                self._column(0, part)

    def _tables(self) -> list[str]:
        """Tables that are read, once each in order; names of WITH parts are none."""
        own = {self.low(k - 1) for k in range(1, len(self.t)) if self.low(k) == "as" and self.low(k + 1) == "(" and self.low(0) in ("with", "create", "insert")}
        out: dict[str, None] = {}
        for k in range(len(self.t)):
            if self.low(k) not in ("from", "join") or k == 1 and self.kind == "delete":
                continue
            i = k + 1
            while True:
                name, i = self.named(i)
                if name and name.lower() not in own and name.lower() not in ("select", "lateral", "values"):
                    out.setdefault(name)
                if self.low(i) == "as":
                    i += 1
                if i < len(self.t) and self.t[i].kind == "word" and self.low(i) not in ("where", "join", "inner", "left", "right", "full", "cross", "natural", "on", "using", "group", "order", "having", "limit", "union", "set"):
                    i += 1
                if self.low(k) != "from" or self.low(i) != ",":
                    break
                i += 1
        return list(out)


def statements(text: str) -> list[Statement]:
    """The statements of a script; a trigger's body ends with its END."""
    out, held, depth = [], [], 0
    for t in tokens(text, "sql"):
        low = t.value.lower() if t.kind == "word" else ""
        if low == "begin" and held and held[0].value.lower() == "create" or low == "case":
            depth += 1
        elif low == "end" and depth:
            depth -= 1
        if t.kind == "sign" and t.value == ";" and not depth:
            if held:
                out.append(Statement(held, text))
            held = []
        else:
            held.append(t)
    return [*out, Statement(held, text)] if held else out


SQL_SHAPE = "pos int, kind string, name string, line int, columns array<struct<pos:int,name:string,type:string>>, tables array<string>, refs array<struct<column:string,table:string,target:string>>"


def sql_statements(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, kind, name, line, columns, tables, refs) of the statements of each script; null texts have none.

    Columns are those that a table, view or index names, an insert fills, an update sets
    or an alteration adds; tables are those read by FROM and JOIN; refs are foreign keys.
    """
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["k"], batch["t"], strict=True):
                for pos, s in enumerate(statements(t) if t else []):
                    columns = [{"pos": p, "name": n, "type": y} for p, n, y in s.columns]
                    rows.append((k, pos, s.kind, s.name, s.line, columns, s.tables, [{"column": c, "table": b, "target": g} for c, b, g in s.references]))
            yield pd.DataFrame(rows, columns=["k", "pos", "kind", "name", "line", "columns", "tables", "refs"])

    return files.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, {SQL_SHAPE}").withColumnRenamed("k", key)
