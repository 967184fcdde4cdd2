"""Apex source to facts: symbols, raw references, entry points, exposures, blockers, behaviours, diagnostics.

A recursive-descent reading of declarations and statements. Expressions are read as chains of primaries and postfixes,
for what refers to something: calls, constructions, types, members, queries. Their text is their tokens without white
space. After an error the reader reports it and goes on behind the next statement or member.
"""

from __future__ import annotations

import re

from quarry.sources import strings as st
from quarry.sources.lexer import SOFT, Token, lex

# What the platform calls by itself, and types that are not the project's.
PLATFORM_ANNOTATIONS = frozenset("auraenabled invocablemethod namespaceaccessible remoteaction future httpget httppost httpput httppatch httpdelete".split())
PLATFORM_CALLBACKS = {
    "queueable": ("execute",), "schedulable": ("execute",), "batchable": ("start", "execute", "finish"), "callable": ("call",),
    "inboundemailhandler": ("handleinboundemail",), "installhandler": ("oninstall",), "uninstallhandler": ("onuninstall",),
}
BUILTIN_TYPES = frozenset("blob boolean date datetime decimal double id integer long object string time void list map set system database schema test type".split())

MODIFIERS = frozenset("public private protected global static final abstract virtual override transient testmethod webservice".split())
DML = ("insert", "update", "delete", "undelete", "upsert", "merge")
ASSIGN = frozenset("= += -= *= /= &= |= ^= %= <<= >>= >>>=".split())


class Trouble(Exception):
    pass


class Scope:
    def __init__(self, symbol: dict):
        self.symbol, self.variables, self.strings, self.records = symbol, {}, {}, {}


class Reader:
    def __init__(self, source: str, path: str):
        self.source, self.path = source, path
        self.tokens, bad = lex(source)
        self.at = 0
        self.facts: dict[str, list] = {k: [] for k in ("symbols", "references", "entries", "exposures", "blockers", "behaviors", "diagnostics")}
        for line, column, message in bad:
            self.complain(line, column, message)
        self.types: list[Scope] = []
        self.runs: list[Scope] = []
        self.behaviors: list[dict] = []
        self.depth = 0

    # Tokens

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead].text.lower() if self.at + ahead < len(self.tokens) else ""

    def is_name(self, ahead: int = 0) -> bool:
        if self.at + ahead >= len(self.tokens):
            return False
        t = self.tokens[self.at + ahead]
        return t.kind == "identifier" or t.text.lower() in SOFT

    def take(self, *wanted: str) -> Token:
        if self.at >= len(self.tokens) or (wanted and self.peek() not in wanted):
            raise Trouble(f"expected {' or '.join(wanted) or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def take_name(self) -> Token:
        if not self.is_name():
            raise Trouble("expected a name")
        return self.take()

    def skip(self, *wanted: str) -> bool:
        if self.peek() in wanted and self.at < len(self.tokens):
            self.at += 1
            return True
        return False

    def text(self, start: int, end: int | None = None) -> str:
        return "".join(t.text for t in self.tokens[start : self.at if end is None else end])

    def complain(self, line: int, column: int, message: str) -> None:
        self.facts["diagnostics"].append({"path": self.path, "line": line, "column": column + 1, "message": message})

    def trouble(self, why: Trouble) -> None:
        t = self.tokens[min(self.at, len(self.tokens) - 1)] if self.tokens else Token("", "", 0, 0, 1, 0)
        self.complain(t.line, t.column, f"{why} at '{t.text}'")

    def closing(self, start: int) -> int:
        """The index behind the bracket that closes the one at start."""
        pairs, depth = {"(": ")", "{": "}", "[": "]"}, []
        for i in range(start, len(self.tokens)):
            x = self.tokens[i].text
            if x in pairs:
                depth.append(pairs[x])
            elif depth and x == depth[-1]:
                depth.pop()
                if not depth:
                    return i + 1
        return len(self.tokens)

    # Facts

    def place(self, first: int, last: int | None = None) -> dict:
        a, b = self.tokens[first], self.tokens[max(first, (self.at if last is None else last) - 1)]
        return {"path": self.path, "line": a.line, "column": a.column + 1, "endLine": b.line, "endColumn": b.column + len(b.text) + 1}

    def span(self, first: int, last: int) -> str:
        return self.source[self.tokens[first].start : self.tokens[max(first, last - 1)].stop + 1]

    def source_id(self) -> str | None:
        scope = self.runs[-1] if self.runs else self.types[-1] if self.types else None
        return scope.symbol["id"] if scope else None

    def refer(self, kind: str, first: int, detail: str, **more) -> None:
        scope = self.runs[-1] if self.runs else self.types[-1] if self.types else None
        row = {"sourceId": self.source_id(), "kind": kind, "memberName": None, "arity": None, "arguments": None, "receiver": None, "receiverType": None, "targetType": None}
        self.facts["references"].append(row | more | {"testContext": bool(scope and scope.symbol["testCode"]), "location": self.place(first), "detail": detail})

    def expose(self, symbol: dict, kind: str, reason: str) -> None:
        self.facts["exposures"].append({"kind": kind, "symbolId": symbol["id"], "reason": reason, "location": symbol["location"]})

    def expose_visibility(self, symbol: dict) -> None:
        seen = next((m for m in symbol["modifiers"] if m in ("public", "global", "protected")), None)
        if seen:
            self.expose(symbol, "visibility", f"{symbol['qualifiedName']} has {seen} visibility")

    def enter(self, symbol: dict, source: str, reason: str, test_only: bool) -> None:
        self.facts["entries"].append({"symbolId": symbol["id"], "source": source, "reason": reason, "testOnly": test_only, "location": symbol["location"]})

    def symbol(self, kind: str, own_name: str, first: int, last: int, modifiers: list[str], annotations: list[str], **more) -> dict:
        """first and last: the declaration's own tokens, modifiers not included."""
        owner = self.types[-1].symbol if self.types else None
        types = more.get("parameterTypes")
        member = types is not None
        qualified = f"{owner['qualifiedName']}.{own_name}" if owner else own_name
        shown, logical = (f"{qualified}({', '.join(types)})", f"{qualified}({','.join(map(st.name, types))})") if member else (qualified, qualified)
        where, span = self.place(first, last), self.span(first, last)
        test = bool(owner and owner["testCode"]) or "istest" in annotations or (member and "testmethod" in modifiers)
        return {
            "id": f"{kind if member else 'type'}:{st.name(logical)}@{self.path}:{where['line']}:{where['column']}", "kind": kind, "name": own_name, "qualifiedName": shown, "ownerId": owner and owner["id"],
            "arity": len(types) if member else None, "parameterTypes": types, "parameterNames": more.get("parameterNames"), "modifiers": modifiers, "annotations": annotations,
            "interfaces": more.get("interfaces", []), "superclass": more.get("superclass"), "testCode": test and kind != "trigger", "location": where,
            "sourceCharacters": st.utf16(span), "sourceBytes": len(span.encode("utf-8", "surrogatepass")),
        }

    def begin_run(self, symbol: dict, scope: Scope | None = None) -> None:
        self.runs.append(scope or Scope(symbol))
        keys = ("statements", "branches", "loops", "tryBlocks", "throws", "assignments")
        lists = ("assignmentTargets", "valueBindings", "returnExpressions", "enhancedForLoops", "advancedCollectionTypes", "callDetails", "queries", "dynamicQueryGaps", "dml")
        self.behaviors.append({"symbolId": symbol["id"]} | dict.fromkeys(keys, 0) | {k: [] for k in lists})

    def end_run(self) -> None:
        self.runs.pop()
        own = self.behaviors.pop()
        own["callDetails"] = list(dict.fromkeys(own["callDetails"]))
        self.facts["behaviors"].append(own)

    def note(self, key: str, value) -> None:
        if self.behaviors:
            self.behaviors[-1][key].append(value)

    def count(self, key: str) -> None:
        if self.behaviors:
            self.behaviors[-1][key] += 1

    def lookup(self, which: str, dotted: str) -> str | None:
        own = st.name(re.sub(r"^(this|super)\.", "", dotted, flags=re.I))
        for scope in (*self.runs[-1:], *self.types[-1:]):
            for key in (own, own.split(".")[-1]) if which == "strings" else (own.split(".")[-1],):
                if key in getattr(scope, which):
                    return getattr(scope, which)[key]
        return None

    # Declarations

    def unit(self) -> dict[str, list]:
        while self.at < len(self.tokens):
            before = self.at
            try:
                modifiers, annotations = self.modifiers()
                if self.peek() == "trigger" and not self.types:
                    self.trigger()
                elif self.peek() in ("class", "interface", "enum"):
                    self.type_declaration(modifiers, annotations)
                else:
                    raise Trouble("expected a type")
            except Trouble as why:
                self.trouble(why)
                self.recover(before)
        return self.facts

    def recover(self, before: int) -> None:
        """Go on behind the next ; or block, or before a } that closes what is around."""
        self.at = max(self.at, before)
        while self.at < len(self.tokens) and self.peek() != "}":
            if self.peek() == ";":
                self.at += 1
                return
            if self.peek() == "{":
                self.at = self.closing(self.at)
                return
            self.at += 1
        if self.at == before:
            self.at += 1

    def modifiers(self) -> tuple[list[str], list[str]]:
        modifiers, annotations = [], []
        while self.at < len(self.tokens):
            if self.peek() == "@":
                self.at += 1
                annotations.append(self.take().text.lower())
                if self.peek() == "(":
                    self.at = self.closing(self.at)
            elif self.peek() in MODIFIERS:
                modifiers.append(self.take().text.lower())
            elif self.peek() in ("with", "without", "inherited") and self.peek(1) == "sharing":
                modifiers.append(self.peek() + "sharing")
                self.at += 2
            else:
                return modifiers, annotations
        return modifiers, annotations

    def trigger(self) -> None:
        first = self.at
        self.take("trigger")
        own = self.take_name().text
        self.take("on")
        self.take_name()
        self.take("(")
        self.at = self.closing(self.at - 1)
        end = self.closing(self.at) if self.peek() == "{" else self.at
        symbol = self.symbol("trigger", own, first, end, [], [])
        self.facts["symbols"].append(symbol)
        scope = Scope(symbol)
        self.types.append(scope)
        self.begin_run(symbol, scope)
        self.enter(symbol, "platform", "Apex trigger event", False)
        try:
            self.block()
        finally:
            self.end_run()
            self.types.pop()

    def type_declaration(self, modifiers: list[str], annotations: list[str]) -> None:
        first, kind = self.at, self.take().text.lower()
        own, superclass, interfaces, mentions = self.take_name().text, None, [], []
        if kind == "class" and self.skip("extends"):
            superclass = self.type_text(mentions)
        if kind != "enum" and self.skip("implements", "extends"):
            interfaces.append(self.type_text(mentions))
            while self.skip(","):
                interfaces.append(self.type_text(mentions))
        if self.peek() != "{":
            raise Trouble("expected {")
        end = self.closing(self.at)
        symbol = self.symbol(kind, own, first, end, modifiers, annotations, superclass=superclass, interfaces=interfaces)
        self.facts["symbols"].append(symbol)
        self.types.append(Scope(symbol))
        runs, self.runs = self.runs, []
        if "restresource" in annotations and kind == "class":
            self.expose(symbol, "annotation", "@RestResource class can be called outside the repository")
        self.expose_visibility(symbol)
        for where, text in mentions:
            self.mention(where, text, "inheritance")
        self.take("{")
        if kind == "enum":
            self.at = end
        else:
            while self.at < len(self.tokens) and self.peek() != "}":
                before = self.at
                try:
                    self.member(symbol)
                except Trouble as why:
                    self.trouble(why)
                    self.recover(before)
            if not self.skip("}"):
                self.types.pop()
                self.runs = runs
                raise Trouble("expected }")
        self.types.pop()
        self.runs = runs

    def type_text(self, mentions: list | None = None) -> str:
        """A type: dotted names with arguments, and array brackets."""
        first = self.at
        self.type_end()
        inner = [i for i in range(first, self.at) if (i == first or self.tokens[i - 1].text in "<,") and self.tokens[i].kind != "operator"]
        if mentions is not None:
            for i in inner:  # the type itself, then its arguments
                end = next(k for k in range(i, self.at + 1) if k == self.at or self._ends_type(i, k))
                mentions.append((i, self.text(i, end)))
        return self.text(first)

    def _ends_type(self, start: int, k: int) -> bool:
        depth = sum((t.text == "<") - t.text.count(">") for t in self.tokens[start:k] if t.text in ("<", ">"))
        return depth == 0 and self.tokens[k].text in (",", ">")

    def type_end(self) -> None:
        while True:
            if self.peek() == "void":
                self.take()
            else:
                self.take_name()
            if self.skip("<"):
                self.type_end()
                while self.skip(","):
                    self.type_end()
                self.take(">")
            if not (self.peek() == "." and self.is_name(1)):
                break
            self.at += 1
        while self.peek() == "[" and self.peek(1) == "]":
            self.at += 2

    def mention(self, first: int, text: str, kind: str = "type") -> None:
        if st.name(st.simple_type(text)) not in BUILTIN_TYPES:
            self.refer(kind, first, text, targetType=text)

    def parameters(self) -> tuple[list[str], list[str], list]:
        types, names, mentions = [], [], []
        self.take("(")
        while not self.skip(")"):
            self.modifiers()
            types.append(self.type_text(mentions))
            names.append(self.take_name().text)
            if self.peek() != ")":
                self.take(",")
        return types, names, mentions

    def member(self, owner: dict) -> None:
        if self.skip(";"):
            return
        modifiers, annotations = self.modifiers()
        if self.peek() in ("class", "interface", "enum") and self.is_name(1):
            return self.type_declaration(modifiers, annotations)
        if self.peek() == "{":
            return self.block()
        first = self.at
        mentions: list = []
        if self.is_name() and self.peek(1) == "(":
            kind, own = "constructor", owner["name"]
            if self.peek() != owner["name"].lower():
                raise Trouble("expected a member")
            self.at += 1
        else:
            declared = self.type_text(mentions)
            kind, own = "method", self.take_name().text
        if self.peek() != "(":
            return self.field(declared, own, modifiers, first, mentions)
        types, names, more = self.parameters()
        body = self.peek() == "{"
        end = self.closing(self.at) if body else self.at + 1
        if not body and self.peek() != ";":
            raise Trouble("expected { or ;")
        symbol = self.symbol(kind, own, first, end, modifiers, annotations, parameterTypes=types, parameterNames=names)
        self.facts["symbols"].append(symbol)
        if owner["kind"] == "interface":
            self.expose_visibility(symbol)
            for where, text in mentions + more:
                self.mention(where, text)
            self.take(";")
            return None
        self.begin_run(symbol)
        if kind == "method":
            self.classify(symbol, owner)
        self.expose_visibility(symbol)
        for where, text in mentions + more:
            self.mention(where, text)
        for declared, own in zip(types, names, strict=True):
            self.runs[-1].variables[st.name(own)] = declared
            self.collection(declared)
        try:
            if body:
                self.block()
            else:
                self.take(";")
        finally:
            self.end_run()
        return None

    def classify(self, symbol: dict, owner: dict) -> None:
        if symbol["testCode"]:
            return self.enter(symbol, "test", "Apex test method", True)
        annotation = next((a for a in symbol["annotations"] if a in PLATFORM_ANNOTATIONS), None)
        if annotation:
            self.expose(symbol, "annotation", f"@{annotation} method can be invoked by supported platform or metadata callers")
        if "webservice" in symbol["modifiers"]:
            self.expose(symbol, "webservice", "webservice method can be called outside the repository")
        if "global" in symbol["modifiers"]:
            self.expose(symbol, "visibility", "global method can be called outside the repository")
        for i in owner["interfaces"]:
            if st.name(symbol["name"]) in PLATFORM_CALLBACKS.get(st.name(st.simple_type(i)), ()):
                self.expose(symbol, "platform-callback", f"{st.simple_type(i)} callback requires a concrete repository caller or metadata binding")
        return None

    def field(self, declared: str, own: str, modifiers: list[str], first: int, mentions: list) -> None:
        for where, text in mentions:
            self.mention(where, text)
        if self.peek() == "{":  # accessors: their code belongs to the type
            self.types[-1].variables[st.name(own)] = declared
            self.take("{")
            while not self.skip("}"):
                self.modifiers()
                self.take("get", "set")
                if self.peek() == "{":
                    self.block()
                else:
                    self.take(";")
            return
        while True:
            at = self.at - 1
            self.types[-1].variables[st.name(own)] = declared
            if self.skip("="):
                value = self.expression_text()
                self.note("valueBindings", {"name": st.name(own), "type": declared, "expression": value, "conditional": self.depth > 0, "location": self.place(at)})
                if st.name(declared) == "string" and "final" in modifiers and (constant := st.folded(value, lambda x: self.lookup("strings", x))) is not None:
                    self.types[-1].strings[st.name(own)] = constant
            if not self.skip(","):
                break
            own = self.take_name().text
        self.take(";")

    # Statements

    def collection(self, declared: str) -> None:
        if re.match(r"(?:Map|Set)<", declared, re.I):
            self.note("advancedCollectionTypes", declared)

    def block(self) -> None:
        self.take("{")
        while self.at < len(self.tokens) and self.peek() != "}":
            before = self.at
            try:
                self.statement()
            except Trouble as why:
                self.trouble(why)
                self.recover(before)
        self.take("}")

    def nested(self, body) -> None:
        self.depth += 1
        try:
            body()
        finally:
            self.depth -= 1

    def condition(self) -> None:
        self.take("(")
        self.expression()
        self.take(")")

    def statement(self) -> None:
        word, first = self.peek(), self.at
        self.count("statements")
        if word == "{":
            self.block()
        elif word == "if":
            self.count("branches")
            self.nested(self.if_rest)
        elif word == "switch" and self.peek(1) == "on":
            self.count("branches")
            self.nested(self.switch_rest)
        elif word in ("for", "while", "do"):
            self.count("loops")
            self.nested({"for": self.for_rest, "while": self.while_rest, "do": self.do_rest}[word])
        elif word == "try":
            self.count("tryBlocks")
            self.nested(self.try_rest)
        elif word in ("return", "throw"):
            self.take()
            self.count("throws") if word == "throw" else None
            if self.peek() != ";":
                value = self.expression_text()
                if word == "return":
                    self.note("returnExpressions", {"expression": value, "location": self.place(first)})
            self.take(";")
        elif word in ("break", "continue"):
            self.take()
            self.take(";")
        elif word in DML and self.peek(1) not in ("(", ".", "=") or word in DML and self.peek(1) == "(":
            self.dml_rest()
        elif word == "system" and self.peek(1) == "." and self.peek(2) == "runas":
            self.expression()
            if self.peek() == "{":
                self.block()
            else:
                self.take(";")
        elif self.declares():
            self.local()
            self.take(";")
        else:
            self.expression_statement()

    def if_rest(self) -> None:
        self.take("if")
        self.condition()
        self.statement()
        if self.skip("else"):
            self.statement()

    def while_rest(self) -> None:
        self.take("while")
        self.condition()
        if not self.skip(";"):
            self.statement()

    def do_rest(self) -> None:
        self.take("do")
        self.statement()
        self.take("while")
        self.condition()
        self.take(";")

    def try_rest(self) -> None:
        self.take("try")
        self.block()
        while self.skip("catch"):
            self.take("(")
            self.modifiers()
            mentions: list = []
            declared = self.type_text(mentions)
            for where, text in mentions:
                self.mention(where, text)
            own = self.take_name().text
            if self.runs:
                self.runs[-1].variables[st.name(own)] = declared
            self.take(")")
            self.block()
        if self.skip("finally"):
            self.block()

    def switch_rest(self) -> None:
        self.take("switch")
        self.take("on")
        self.expression()
        self.take("{")
        while self.skip("when"):
            if not self.skip("else"):
                while self.peek() != "{":
                    self.take()
            self.block()
        self.take("}")

    def for_rest(self) -> None:
        self.take("for")
        self.take("(")
        end = self.closing(self.at - 1)
        mark = self.at
        if self.declares():
            mentions: list = []
            self.modifiers()
            declared = self.type_text(mentions)
            own = self.take_name().text
            if self.skip(":"):
                for where, text in mentions:
                    self.mention(where, text)
                if self.runs:
                    self.runs[-1].variables[st.name(own)] = declared
                loop = {"variable": own, "collection": ""}
                self.note("enhancedForLoops", loop)
                loop["collection"] = self.expression_text()
                self.take(")")
                return self.body_after(end)
            self.at = mark
            self.local()
        elif self.peek() != ";":
            self.expressions()
        self.take(";")
        if self.peek() != ";":
            self.expression()
        self.take(";")
        if self.peek() != ")":
            self.expressions()
        self.take(")")
        return self.body_after(end)

    def body_after(self, end: int) -> None:
        self.at = max(self.at, end)
        if not self.skip(";"):
            self.statement()

    def dml_rest(self) -> None:
        first = self.at
        operation = self.take().text.lower()
        mode = "default"
        if self.peek() == "as" and self.peek(1) in ("user", "system"):
            mode = self.peek(1)
            self.at += 2
        start = self.at
        self.expression()
        target = self.text(start)
        if operation == "merge":
            start = self.at
            self.expression()
            target += "," + self.text(start)
        elif operation == "upsert" and self.peek() != ";":
            self.type_text()
        self.dml(operation, target, first, "default", mode)
        self.take(";")

    def dml(self, operation: str, target: str, first: int, all_or_none: str, access: str) -> None:
        if not self.behaviors:
            return
        made = re.match(rf"new({st.DOTTED})", target)
        base = re.match(st.IDENTIFIER, target)
        declared = made[1] if made else self.lookup("variables", base[0]) if base else None
        if declared:
            inner = re.fullmatch(r"(?:List|Set)<(.+)>", declared, re.I)
            declared = st.simple_type(inner[1] if inner else declared)
        self.note("dml", {"symbolId": self.source_id(), "operation": operation, "targetExpression": target, "targetType": declared, "allOrNone": all_or_none, "accessMode": access, "location": self.place(first)})

    def declares(self) -> bool:
        """Whether a local declaration starts here: a type, then a name, then = , ; or :"""
        mark = self.at
        try:
            self.modifiers()
            self.type_end()
            return self.is_name() and self.peek(1) in ("=", ",", ";", ":")
        except Trouble:
            return False
        finally:
            self.at = mark

    def local(self) -> None:
        mentions: list = []
        self.modifiers()
        declared = self.type_text(mentions)
        self.collection(declared)
        for where, text in mentions:
            self.mention(where, text)
        scope = self.runs[-1] if self.runs else None
        while True:
            first = self.at
            own = st.name(self.take_name().text)
            if scope:
                scope.variables[own] = declared
            if self.skip("="):
                value = self.expression_text()
                if scope:
                    if st.name(declared) == "string" and (constant := st.folded(value, lambda x: self.lookup("strings", x))) is not None:
                        scope.strings[own] = constant
                    self.note("valueBindings", {"name": own, "type": declared, "expression": value, "conditional": self.depth > 0, "location": self.place(first)})
                    if record := record_type(declared, value):
                        scope.records[own] = record
            if not self.skip(","):
                return

    def expression_statement(self) -> None:
        first = self.at
        text = self.expression_text()
        self.take(";")
        if not self.behaviors:
            return
        m = re.match(r"(.+?)(?:\+=|-=|\*=|/=|=(?!=))", text)
        if m:
            self.count("assignments")
            self.note("assignmentTargets", m[1])
            own = st.name(re.sub(r"^(?:this|super)\.", "", m[1], flags=re.I))
            for scope in (*self.runs[-1:], *self.types[-1:]):
                for key in (own, own.split(".")[-1]):
                    scope.strings.pop(key, None)
        m = re.fullmatch(rf"({st.IDENTIFIER})=(?!=)([\s\S]+)", text)
        if m and (declared := self.lookup("variables", m[1])):
            own = st.name(m[1])
            self.note("valueBindings", {"name": own, "type": declared, "expression": m[2], "conditional": self.depth > 0, "location": self.place(first, self.at - 1)})
            record = record_type(declared, m[2])
            if record:
                self.runs[-1].records[own] = record
            else:
                self.runs[-1].records.pop(own, None)

    # Expressions

    def expression_text(self) -> str:
        first = self.at
        self.expression()
        return self.text(first)

    def expressions(self) -> list[str]:
        out = [self.expression_text()]
        while self.skip(","):
            out.append(self.expression_text())
        return out

    def expression(self) -> None:
        """Operands with operators between them; which binds closer makes no difference to what is referred to."""
        while True:
            while self.peek() in ("!", "~", "-", "+", "++", "--"):
                self.take()
            self.operand()
            if self.skip("?"):
                self.expression()
                self.take(":")
            elif self.peek() == "instanceof":
                self.take()
                mentions: list = []
                self.type_text(mentions)
                for where, text in mentions:
                    self.mention(where, text)
                if not self.operator():
                    return
            elif not self.operator():
                return

    def operator(self) -> bool:
        word = self.peek()
        if word in ASSIGN or word in ("&&", "||", "==", "!=", "===", "!==", "<>", "<", "<=", ">=", "+", "-", "*", "/", "%", "&", "|", "^", "??", "=>"):
            self.take()
            return True
        if word == ">":
            self.take()
            while self.peek() in (">", ">=") and self.tokens[self.at].start == self.tokens[self.at - 1].stop + 1:
                self.take()
            return True
        return False

    def operand(self) -> None:
        first, word = self.at, self.peek()
        if word == "(":
            if self.cast():
                return self.operand()
            self.take("(")
            self.expression()
            self.take(")")
        elif word == "[":
            self.query()
        elif word == "new":
            self.creator()
        elif word in ("this", "super") or self.is_name():
            self.primary()
        elif self.at < len(self.tokens) and (self.tokens[self.at].kind in ("string", "integer", "number") or word in ("null", "true", "false", "void") or word in DML):
            self.take()
            if word in DML and self.peek() == "(":
                self.at = first
                self.primary()
        else:
            raise Trouble("expected an expression")
        return self.postfix(first)

    def cast(self) -> bool:
        """Reads (Type) if an operand follows it."""
        mark, mentions = self.at, []
        try:
            self.take("(")
            self.type_text(mentions)
            self.take(")")
            t = self.tokens[self.at] if self.at < len(self.tokens) else None
            if t and (t.kind in ("identifier", "string", "integer", "number") or self.peek() in ("(", "new", "this", "super", "null", "true", "false", "[", "!", "~") or self.peek() in SOFT):
                for where, text in mentions:
                    self.mention(where, text)
                return True
        except Trouble:
            pass
        self.at = mark
        return False

    def primary(self) -> None:
        first = self.at
        if self.is_name() and self.peek(1) == "<":  # a type with arguments, as in List<X>.class
            try:
                mentions: list = []
                self.type_text(mentions)
                if self.peek() == "." and self.peek(1) == "class":
                    for where, text in mentions:
                        self.mention(where, text)
                    return
            except Trouble:
                pass
            self.at = first
        self.take()
        if self.peek() == "(":
            end = self.closing(self.at)
            detail = self.text(first, end)
            self.note("callDetails", detail)
            at = len(self.facts["references"])
            arguments = self.arguments()
            self.refer("call", first, detail, memberName=self.tokens[first].text, arity=len(arguments), arguments=arguments, passed=arguments, receiverType=self.types[-1].symbol["qualifiedName"] if self.types else None)
            self.facts["references"].insert(at, self.facts["references"].pop())

    def arguments(self) -> list[str]:
        self.take("(")
        if self.skip(")"):
            return []
        out = self.expressions()
        self.take(")")
        return out

    def postfix(self, first: int) -> None:
        members: list[tuple[int, dict]] = []
        while True:
            word = self.peek()
            if word in (".", "?."):
                dot = self.at
                self.take()
                member = self.take()
                if self.peek() == "(":
                    self.dot_call(first, dot, member.text)
                else:
                    receiver = self.text(first, dot)
                    if member.text.lower() != "class" and re.fullmatch(st.DOTTED, receiver):
                        self.refer("type", first, f"member access {self.text(first)}", targetType=self.lookup("variables", receiver) or receiver)
            elif word == "[":
                self.take("[")
                self.expression()
                self.take("]")
            elif word in ("++", "--"):
                self.take()
            else:
                return

    def dot_call(self, first: int, dot: int, own: str) -> None:
        receiver, start = self.text(first, dot), self.at
        made = re.match(rf"new({st.DOTTED})\(", receiver, re.I)
        here = self.types[-1].symbol if self.types else {"qualifiedName": None, "superclass": None}
        if receiver.lower() in ("this", "super"):
            declared = here["qualifiedName" if receiver.lower() == "this" else "superclass"] or receiver
        else:
            declared = made[1] if made else self.lookup("variables", receiver) or receiver
        end = self.closing(start)
        detail = self.text(first, end)
        self.note("callDetails", detail)
        at = len(self.facts["references"])
        arguments = self.arguments()
        inner = self.facts["references"][at:]
        del self.facts["references"][at:]
        self.refer("call", dot + 1, detail, memberName=own, arity=len(arguments), arguments=arguments, passed=None if "(" in receiver else arguments, receiver=receiver, receiverType=declared)
        kind, method = st.name(st.simple_type(declared)), own.lower()
        if kind == "database":
            if method in ("query", "querywithbinds"):
                self.dynamic(arguments[0] if arguments else "", dot + 1)
            if method in DML and arguments:
                self.dml(method, arguments[0], dot + 1, *st.dml_options(method, arguments))
        if kind == "type" and method == "forname":
            self.for_name(",".join(arguments), dot + 1)
        self.facts["references"] += inner

    def dynamic(self, expression: str, first: int) -> None:
        if not self.behaviors:
            return
        constant = st.folded(expression, lambda x: self.lookup("strings", x))
        parsed = st.dynamic_query(constant) if constant else None
        own = {"symbolId": self.source_id(), "location": self.place(first)}
        if parsed is None:
            reason = "The constant string is not a supported SELECT query." if constant else "The query string contains a value that cannot be constant-folded from repository source."
            self.note("dynamicQueryGaps", own | {"expression": expression, "reason": reason})
        else:
            self.note("queries", own | parsed | {"dynamic": True} | st.query_semantics(constant, self.types[-1].symbol["modifiers"] if self.types else []))

    def for_name(self, argument: str, first: int) -> None:
        constant = st.folded(argument, lambda x: self.lookup("strings", x))
        if constant and re.fullmatch(r"[A-Za-z_][\w.]*", constant):
            return self.refer("type", first, f"Type.forName literal: {constant}", targetType=constant)
        base, field = re.match(st.IDENTIFIER, argument), re.search(rf"\.({st.IDENTIFIER}__c)$", argument)
        record = self.runs[-1].records.get(st.name(base[0])) if base and field and self.runs else None
        message = f"Type.forName({argument}) depends on a runtime value and can reference a class that has no lexical caller."
        self.facts["blockers"].append(
            {"code": "dynamic-type", "scope": "reference", "message": message, "blocksClosedWorldConclusion": True, "symbolId": self.source_id(), "repositoryMetadataField": st.name(f"{record}.{field[1]}") if record else None,
             "dynamicExpression": argument, "location": self.place(first)}
        )
        return None

    def creator(self) -> None:
        self.take("new")
        first = self.at
        mentions: list = []
        try:
            self.type_text(mentions)
        except Trouble:
            mentions = []
            raise
        made = self.text(first)
        if self.peek() == "(":
            end = self.closing(self.at)
            detail = f"new {self.text(first, end)}"
            at = len(self.facts["references"])
            arguments = self.arguments()
            self.refer("construct", first, detail, targetType=made, memberName=st.simple_type(made), arity=len(arguments), passed=arguments)
            self.facts["references"].insert(at, self.facts["references"].pop())
        elif self.peek() == "[":
            self.take("[")
            self.expression()
            self.take("]")
        elif self.peek() == "{":
            self.take("{")
            if not self.skip("}"):
                self.expressions()
                self.take("}")
        for where, text in mentions[1:]:
            self.mention(where, text)

    def query(self) -> None:
        first, end = self.at, self.closing(self.at)
        inner = self.tokens[first + 1 : end - 1]
        if not inner or inner[0].text.lower() not in ("select", "find"):
            raise Trouble("expected a query")
        self.at = end
        if inner[0].text.lower() == "find" or not self.behaviors:
            return
        depth, marks = 0, {}
        for k, t in enumerate(inner):
            depth += (t.text == "(") - (t.text == ")")
            word = t.text.lower()
            if not depth and word in ("from", "where", "group", "order", "limit", "offset", "having", "with", "for", "using", "all"):
                marks.setdefault(word, k)
        if "from" not in marks:
            raise Trouble("expected from")
        flat = lambda a, b: "".join(t.text for t in inner[a:b])
        after = [k for w, k in marks.items() if w != "from" and k > marks.get("where", 0) and w != "where"]
        where = flat(marks["where"], min(after, default=len(inner))) if "where" in marks else ""
        whole = flat(0, len(inner))
        fields = sorted(st.parts(flat(1, marks["from"]), ","), key=st.collation)
        found = {"symbolId": self.source_id(), "object": inner[marks["from"] + 1].text if marks["from"] + 1 < len(inner) else "unknown", "fields": fields, "filterShape": st.query_shape(where), "normalizedQuery": st.query_shape(whole), "dynamic": False}
        self.note("queries", found | st.query_semantics(whole, self.types[-1].symbol["modifiers"] if self.types else []) | {"location": self.place(first + 1, end - 1)})


def record_type(declared: str, value: str) -> str | None:
    """The custom metadata type that a value's text proves a variable to hold."""
    inner = re.fullmatch(r"(?:List|Set)<(.+)>", declared, re.I) or re.fullmatch(r"Map<[^,]+,(.+)>", declared, re.I)
    own = st.simple_type(inner[1] if inner else declared)
    flat, low = st.name(value), st.name(own)
    if low.endswith("__mdt") and ((flat.startswith("[select") and f"from{low}" in flat) or f"{low}.getall()" in flat or f"{low}.getinstance(" in flat):
        return own
    return None


def extract(source: str, path: str) -> dict[str, list]:
    """The facts of one file."""
    return Reader(source, path).unit()
