"""Broken JSON mended in one pass: string state, a stack of open brackets, and what may come next."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FENCE = re.compile(r"```(?:json)?\s*")
CONTROL = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])")
WORD = re.compile(r"[^\s{}\[\],:\"'`]+")
WORDS = {"true": "true", "false": "false", "null": "null", "True": "true", "False": "false", "None": "null", "undefined": "null", "NaN": "null"}
CLOSING = {"{": "}", "[": "]"}
PLAIN = re.compile(r"""[^\\"'\n\r\t]+""")
RAW = {"\n": "\\n", "\r": "\\r", "\t": "\\t", '"': '\\"'}


def text_value(text: str, at: int, quote: str, key: bool) -> tuple[str, int]:
    """The string that begins after a quote, as JSON, and the place after it.

    A quote closes the string if what follows may follow a string; else it is part of it.
    """
    out = ['"']
    while at < len(text):
        if plain := PLAIN.match(text, at):
            out.append(plain[0])
            at = plain.end()
            continue
        c = text[at]
        if c == "\\":
            follows = text[at + 1 : at + 2]
            if follows == "'":
                out.append("'")
            elif follows and follows in '"\\/bfnrt' or re.match(r"u[0-9a-fA-F]{4}", text[at + 1 : at + 6]):
                out.append(c + follows)
            else:
                out.append("\\\\")
                at -= 1  # a backslash of its own: what follows is read as it is
            at += 2
            continue
        if c == quote:
            rest = text[at + 1 :].lstrip() if len(text) - at < 64 else text[at + 1 : at + 65].lstrip()
            if not rest or rest[0] in (":" if key else ",}]") or key and rest[0] in ",}]" or rest.startswith(("//", "/*")):
                return "".join([*out, '"']), at + 1
        out.append(RAW.get(c, c))
        at += 1
    return "".join([*out, '"']), at


def mended(text: str) -> str:
    """Valid JSON from JSON in fences or HTML escapes, with comments, bare or single-quoted keys and texts, raw line breaks,
    stray quotes and backslashes, missing, double or trailing commas, and brackets that are missing or too many.
    What can't be read so stays broken."""
    if fence := FENCE.search(text):
        text = text[fence.end() :].partition("```")[0].rstrip()
    if "&quot;" in text:
        for entity, char in ENTITIES:
            text = text.replace(entity, char)
    text = CONTROL.sub("", text).strip()
    out: list[str] = []
    stack: list[str] = []
    at, last = 0, ""  # last: the kind of the last token, one of { [ , : and v for a value or key

    def value(token: str) -> None:
        nonlocal last
        if last == "v":
            out.append(",")
        out.append(token)
        last = "v"

    def close() -> None:
        nonlocal last
        if last == ",":
            out.pop()
        elif last == ":":
            out.append("null")
        out.append(CLOSING[stack.pop()])
        last = "v"

    while at < len(text):
        c = text[at]
        if c.isspace():
            at += 1
        elif comment := COMMENT.match(text, at):
            at = comment.end()
        elif c in "{[":
            value(c)
            stack.append(c)
            last = c
            at += 1
        elif c in "}]":
            if any(CLOSING[b] == c for b in stack):
                while CLOSING[stack[-1]] != c:
                    close()
                close()
            at += 1
        elif c in ",:":
            if last == "v":
                out.append(c)
                last = c
            at += 1
        elif c in "\"'":
            key = bool(stack) and stack[-1] == "{" and last in ("{", ",", "v")
            token, at = text_value(text, at + 1, c, key)
            value(token)
        elif number := NUMBER.match(text, at):
            at = number.end()
            is_key = bool(stack) and stack[-1] == "{" and last in ("{", ",")
            value(f'"{number[0]}"' if is_key else number[0])
        else:
            word = WORD.match(text, at)
            if not word:
                at += 1
                continue
            at = word.end()
            is_key = bool(stack) and stack[-1] == "{" and last in ("{", ",", "v")
            if not is_key and word[0] not in WORDS:  # a bare text goes on to the next sign
                end = re.compile(r"[,}\]\n]|\Z").search(text, at)
                token = text[word.start() : end.start()].strip()
                at = end.start()
            else:
                token = word[0]
            value(WORDS[token] if not is_key and token in WORDS else text_value(token, 0, "", False)[0])
    while stack:
        close()
    return "".join(out)


@F.udf(T.StringType(), useArrow=False)  # Spark sends a hundred texts at a time so, an Arrow batch holds ten thousand
def _mended(text: str | None) -> str | None:
    return None if text is None else mended(text)


def is_json(raw: Column) -> Column:
    """Whether a text is one JSON value. Spark's parser stops after a value, so the text must also stand as an element and as a field."""
    wrapped = lambda a, b: F.try_parse_json(F.concat(F.lit(a), raw, F.lit(b))).isNotNull()
    return F.try_parse_json(raw).isNotNull() & wrapped("[", "]") & wrapped('{"v":', "}")


def repair_json(raw: Column) -> Column:
    """``mended`` for texts that are no JSON; valid JSON stays as it is and is never sent to Python workers as more than null."""
    valid = is_json(raw)
    return F.when(valid, raw).otherwise(_mended(F.when(~valid, raw)))
