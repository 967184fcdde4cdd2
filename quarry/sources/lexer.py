"""Apex tokens, with offsets. Comments and white space are left out; a character that starts no token is reported."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    text: str
    kind: str  # identifier, keyword, string, integer, number, operator
    start: int
    stop: int  # inclusive
    line: int
    column: int  # from 0


# The words of the language that are no identifiers.
KEYWORDS = frozenset(
    """abstract after before break catch class continue delete do else enum extends final finally for get global if implements inherited insert instanceof interface merge new null on override private
    protected public return set sharing static super switch testmethod this throw transient trigger try undelete update upsert virtual void webservice when while with without true false""".split()
)
#: Keywords that may also name things.
SOFT = frozenset("after before get inherited on set sharing switch transient trigger when with without".split())
_TOKEN = re.compile(
    r"(?P<space>\s+|//[^\r\n]*|/\*[\s\S]*?\*/)|(?P<identifier>[A-Za-z_$][A-Za-z0-9_$]*)|(?P<number>\d+\.\d*[dD]?|\d+[dD]|\.\d+[dD]?)|(?P<integer>\d+[lL]?)"
    r"|(?P<string>'(?:\\.|[^'\\\r\n])*')|(?P<operator>>>>=|<<=|>>=|===|!==|\?\.|\?\?|=>|==|!=|<>|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|&=|\|=|\^=|%=|[{}()\[\];,.=<>!~?:+\-*/&|^%@])"
)


def lex(source: str) -> tuple[list[Token], list[tuple[int, int, str]]]:
    """Tokens, and (line, column, message) for each stretch that is none."""
    tokens, bad, at, line, begin = [], [], 0, 1, 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if m is None:
            bad.append((line, at - begin, f"token recognition error at: '{source[at]}'"))
            at += 1
            continue
        text, kind = m[0], m.lastgroup
        if kind != "space":
            if kind == "identifier" and text.lower() in KEYWORDS:
                kind = "keyword"
            tokens.append(Token(text, kind, at, m.end() - 1, line, at - begin))
        if "\n" in text:
            line += text.count("\n")
            begin = at + text.rindex("\n") + 1
        at = m.end()
    return tokens, bad


def normalized(token: Token) -> str:
    """A token as clones see it: identifiers and literals by class."""
    if token.kind == "identifier":
        return "<identifier>"
    if token.kind in ("string", "integer", "number"):
        return f"<{token.kind}literal>"
    if token.text.lower() in ("true", "false"):
        return "<booleanliteral>"
    return token.text.lower()


def parameterized(tokens: list[Token]) -> list[str]:
    """Identifiers renamed by first use, members and values apart; names of types stay."""
    names: dict[tuple[bool, str], str] = {}
    plain = [normalized(t) for t in tokens]
    out = []
    for i, t in enumerate(tokens):
        if plain[i] != "<identifier>":
            out.append(plain[i])
            continue
        before = tokens[i - 1].text.lower() if i else ""
        declares = i + 1 < len(tokens) and plain[i + 1] == "<identifier>" and before != "."
        if declares or before in ("new", "extends", "implements", "instanceof"):
            out.append(f"<type:{t.text.lower()}>")
        else:
            out.append(names.setdefault((before == ".", t.text.lower()), f"<id:{len(names)}>"))
    return out
