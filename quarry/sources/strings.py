"""Text of expressions and queries, read by their tokens: parts, constants, shapes; and places in a text. One text at a time."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import accumulate, takewhile

from quarry.sources.lexer import lex

IDENTIFIER = r"[A-Za-z_]\w*"
DOTTED = rf"{IDENTIFIER}(?:\.{IDENTIFIER})*"

# Words of a query, without white space, and what they say of it; the first that is there counts.
SECURITY = {"withuser_mode": "user", "withusermode": "user", "withsystem_mode": "system", "withsystemmode": "system", "withsecurity_enforced": "security-enforced"}
SHARING = {"withsharing": "with-sharing", "withoutsharing": "without-sharing", "inheritedsharing": "inherited-sharing"}
AGGREGATES = ("count(", "sum(", "avg(", "min(", "max(", "groupby")
LOCK = "forupdate"
#: Words that end a condition: those that do so alone, and those that do with the next word.
CLAUSES = frozenset(("having", "limit", "offset", "with"))
PAIRED = {"group": ("by",), "order": ("by",), "for": ("update", "view", "reference")}
#: Arguments of a data operation that say in whose name it runs.
MODES = {"user_mode": "user", "system_mode": "system"}

_OPENS = {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}


def name(value: str) -> str:
    """Names are equal without white space and case."""
    return re.sub(r"\s+", "", value).lower()


def simple_type(value: str) -> str:
    return re.sub(r"<.*>", "", value, flags=re.S).replace("[]", "").split(".")[-1]


def collation(text: str):
    """Sorts as Unicode collation does for plain letters: case counts last, lower case first."""
    return (text.lower(), text.swapcase())


def parts(text: str, separator: str) -> list[str]:
    """Split at the separator's tokens that are in no bracket."""
    tokens = lex(text)[0]
    depth = accumulate(_OPENS.get(t.text, 0) for t in tokens)
    at = [t.start for t, d in zip(tokens, depth, strict=True) if t.text == separator and not d]
    return [text[a:z] for a, z in zip([0, *(i + len(separator) for i in at)], [*at, len(text)], strict=True)]


# Constants

_ITEM = re.compile(rf"(?P<literal>'(?:\\.|[^'])*')|(?P<name>{DOTTED})|(?P<mark>\S)", re.S)


def literal(text: str) -> str | None:
    """What a string literal stands for; None if the text isn't one."""
    m = _ITEM.fullmatch(text)
    return text[1:-1].replace("\\'", "'").replace("\\\\", "\\") if m and m["literal"] else None


def folded(expression: str, resolve: Callable[[str], str | None] = lambda _: None) -> str | None:
    """The constant of literals and known names with + between them; each, and the whole, may be in brackets. Else None.

    Items go on a stack, values as one-element lists; a value in brackets becomes the value.
    """
    stack: list = []
    for m in _ITEM.finditer(expression):
        value = None if m["mark"] else literal(m[0]) if m["literal"] else resolve(m[0])
        if value is None and not m["mark"]:
            return None
        stack.append(m[0] if m["mark"] else [value])
        while len(stack) > 2 and stack[-1] == ")" and stack[-3] == "(" and isinstance(stack[-2], list):
            stack[-3:] = [stack[-2]]
    while len(stack) > 2 and (stack[0], stack[-1]) == ("(", ")"):
        stack = stack[1:-1]
    values, signs = stack[::2], stack[1::2]
    if len(stack) % 2 and all(isinstance(v, list) for v in values) and set(signs) <= {"+"}:
        return "".join(v for (v,) in values)
    return None


# Queries


def query_shape(text: str) -> str:
    """Literals and numbers as ?, binds as :bind, no white space, lower case."""
    out, tokens, bind = [], lex(text)[0], False
    for k, t in enumerate(tokens):
        touches = k > 0 and tokens[k - 1].stop + 1 == t.start
        joined = k + 1 < len(tokens) and t.stop + 1 == tokens[k + 1].start and tokens[k + 1].kind in ("identifier", "keyword")
        word = t.kind in ("identifier", "keyword")
        if bind and touches and (word or (t.text == "." and joined)):
            continue
        bind = t.text == ":" and joined
        plain = re.fullmatch(r"\d+(\.\d+)?", t.text) and not joined
        out.append("?" if t.kind == "string" or plain else ":bind" if bind else t.text.lower())
    return "".join(out)


def query_semantics(query: str, modifiers: list[str]) -> dict:
    flat, own = name(query), "".join(modifiers).lower()
    said = lambda words, text: next((meaning for w, meaning in words.items() if w in text), "unspecified")
    return {"securityMode": said(SECURITY, flat), "sharingContext": said(SHARING, own), "aggregate": any(w in flat for w in AGGREGATES), "locking": LOCK in flat}


def dynamic_query(query: str) -> dict | None:
    """Object, fields and shapes of a constant SELECT, whose object is what the first FROM names. Words stand apart."""
    tokens = lex(query)[0]
    words = [t.text.lower() if (i == 0 or tokens[i - 1].stop + 1 < t.start) else "" for i, t in enumerate(tokens)]  # those with white space before them
    at = next((i for i in range(2, len(words) - 1) if words[i] == "from" and words[i + 1] and re.fullmatch(IDENTIFIER, tokens[i + 1].text)), None)
    if at is None or words[0] != "select" or not words[1]:
        return None
    fields = (f.strip() for f in parts(query[tokens[0].stop + 1 : tokens[at].start], ","))
    tail = tokens[at + 2 :]
    low = [t.text.lower() for t in tail] + [""]
    begin = low.index("where") + 1 if "where" in low else len(tail)
    ends = lambda k: low[k] in CLAUSES or low[k + 1] in PAIRED.get(low[k], ())
    body = list(takewhile(lambda k: not ends(k), range(begin, len(tail))))
    where = query[tail[body[0]].start : tail[body[-1]].stop + 1] if body else ""
    return {"object": tokens[at + 1].text, "fields": sorted(filter(None, fields), key=collation), "filterShape": query_shape(where), "normalizedQuery": query_shape(query)}


def dml_options(operation: str, values: list[str]) -> tuple[str, str]:
    """allOrNone and access mode of a Database call's arguments. A flag is written out, or else computed; the second record
    of a merge and the key field of an upsert are neither."""
    said = [[m for word, m in MODES.items() if word in v.lower()] for v in values]
    access = next((m for m in MODES.values() if any(m in s for s in said)), "default")
    flags = [v.lower() for v in values[1:] if v.lower() in ("true", "false")]
    open_ = [v for v, modes in zip(values[1:], said[1:], strict=True) if not modes]
    extra = operation == "merge" or (operation == "upsert" and bool(open_) and re.search(rf"{IDENTIFIER}\.{IDENTIFIER}", open_[0]) is not None)
    return (flags[0] if flags else "default" if len(open_) <= extra else "dynamic"), access


# Places


def masked(source: str, strings: bool = False) -> str:
    """Comments (and strings) as blanks of the same length, line ends kept."""
    blank = lambda m: re.sub(r"[^\r\n]", " ", m[0])
    source = re.sub(r"//[^\r\n]*", blank, re.sub(r"/\*[\s\S]*?\*/", blank, source))
    return re.sub(r"'(?:\\.|[^'])*'|\"(?:\\.|[^\"])*\"", blank, source, flags=re.S) if strings else source


def location(source: str, path: str, index: int) -> dict:
    """Line and column, both from 1, of an offset."""
    begin = source.rfind("\n", 0, index) + 1
    return {"path": path, "line": source.count("\n", 0, index) + 1, "column": index - begin + 1}


def utf16(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2
