"""References to Apex from metadata text, by format, and record automation."""

from __future__ import annotations

import re

from quarry.sources import strings as st

_ONE = rf"{st.IDENTIFIER}(?:\.{st.IDENTIFIER})?"
#: Where a format writes exact values: patterns by suffix.
EXACT = (
    (re.compile(r"\.(xml|cmp|app|page|component|flow)$"), (rf"=\s*[\"']\s*({_ONE})\s*[\"']", rf">\s*({_ONE})\s*<"), 0),
    (re.compile(r"\.json$"), (rf":\s*[\"']\s*({_ONE})\s*[\"']",), 0),
    (re.compile(r"\.ya?ml$"), (rf":\s*[\"']?\s*({_ONE})\s*[\"']?\s*$",), re.M),
    (re.compile(r"\.txt$"), (rf"^\s*({_ONE})\s*$",), re.M),
)
_CONTROLLER = re.compile(rf"\bcontroller\s*=\s*[\"']({st.DOTTED})[\"']", re.I)


def _row(text: str, path: str, at: int, detail: str, target: str, member: str | None = None, known: bool = False) -> dict:
    """known: the target counts only if it is a type of the project."""
    return {"targetType": target, "memberName": member, "location": st.location(text, path, at), "detail": detail, "known": known}


def mentions(text: str, path: str) -> list[dict]:
    """Exact identifier values of a configuration format."""
    for suffix, patterns, flags in EXACT:
        if suffix.search(path.lower()):
            found = ((m.start(), *m[1].split(".")) for p in patterns for m in re.finditer(p, text, flags))
            return [_row(text, path, at, "Repository configuration value", own, more[0] if more else None, True) for at, own, *more in found]
    return []


def bindings(text: str, path: str) -> list[dict]:
    """What formats that name Apex code name."""
    low, rows = path.lower(), []
    if low.endswith(".js"):
        for m in re.finditer(rf"@salesforce/apex/({st.DOTTED})\.({st.IDENTIFIER})", text):
            rows.append(_row(text, path, m.start(), f"LWC Apex import {m[1]}.{m[2]}", m[1], m[2]))
    elif low.endswith((".cmp", ".app")):
        rows += [_row(text, path, m.start(), f"Aura Apex controller {m[1]}", m[1]) for m in _CONTROLLER.finditer(text)]
    elif low.endswith((".page", ".component")):
        controllers = []
        for m in _CONTROLLER.finditer(text):
            controllers.append(m[1])
            rows.append(_row(text, path, m.start(), f"Visualforce controller {m[1]}", m[1]))
        for m in re.finditer(r"\bextensions\s*=\s*[\"']([^\"']+)[\"']", text, re.I):
            for own in filter(None, map(str.strip, m[1].split(","))):
                controllers.append(own)
                rows.append(_row(text, path, m.start(), f"Visualforce controller extension {own}", own))
        for m in re.finditer(rf"\baction\s*=\s*[\"']\{{!\s*({st.IDENTIFIER})", text, re.I):
            rows += [_row(text, path, m.start(), f"Visualforce action {c}.{m[1]}", c, m[1]) for c in controllers]
    elif low.endswith((".flow", ".flow-meta.xml")):
        for m in re.finditer(rf"<(?:apexClass|actionName)>\s*({st.DOTTED})\s*</(?:apexClass|actionName)>", text, re.I):
            own, *more = m[1].split(".")
            rows.append(_row(text, path, m.start(), f"Flow Apex action {m[1]}", own, more[0] if more else None))
    elif low.endswith(".md-meta.xml"):
        for m in re.finditer(rf"<value\b[^>]*xsi:type\s*=\s*[\"']xsd:string[\"'][^>]*>\s*({st.DOTTED})\s*</value>", text, re.I):
            rows.append(_row(text, path, m.start(), f"Custom Metadata Apex type {m[1]}", m[1]))
    return rows


def bundle_parts(text: str, path: str) -> dict:
    """Of a file in an Aura bundle: the bundle, its controllers, and calls of controller methods with their places."""
    m = re.match(r"(.*/aura/[^/]+)/", path, re.I)
    if not m:
        return {"bundle": None, "controllers": [], "calls": []}
    markup, script = path.lower().endswith((".cmp", ".app")), path.lower().endswith(".js")
    calls = [{"member": c[1], "location": st.location(text, path, c.start())} for c in re.finditer(rf"\.get\(\s*[\"']c\.({st.IDENTIFIER})[\"']\s*\)", text)] if script else []
    return {"bundle": m[1], "controllers": [c[1] for c in _CONTROLLER.finditer(text)] if markup else [], "calls": calls}


def configured_fields(text: str, path: str) -> list[str]:
    """type.field of a custom metadata record's fields that have a value."""
    m = re.search(r"/customMetadata/([^/.]+)\.[^/]+\.md-meta\.xml$", path, re.I)
    if not m:
        return []
    own = m[1] if m[1].lower().endswith("__mdt") else f"{m[1]}__mdt"
    found = []
    for v in re.finditer(r"<values>([\s\S]*?)</values>", text, re.I):
        field = re.search(rf"<field>\s*({st.IDENTIFIER}__c)\s*</field>", v[1], re.I)
        if field and re.search(r"<value\b[^>]*>[\s\S]*?</value>", v[1], re.I):
            found.append(st.name(f"{own}.{field[1]}"))
    return found


def automation(text: str, path: str) -> dict | None:
    """An active record-triggered flow or a workflow file with an active rule."""
    tag = lambda t: (m[1].strip() if (m := re.search(rf"<{t}>([^<]+)</{t}>", text, re.I)) else None)
    low, file = path.lower(), path.rsplit("/", 1)[-1]
    if low.endswith(".flow-meta.xml"):
        own, timing = tag("object"), tag("triggerType") or tag("recordTriggerType")
        if own and tag("recordTriggerType") and (tag("status") or "").lower() == "active":
            return {"kind": "flow", "object": own, "timing": timing, "path": path}
    elif low.endswith(".workflow-meta.xml") and re.search(r"<active>\s*true\s*</active>", text, re.I):
        return {"kind": "workflow", "object": file.split(".")[0], "timing": "workflow rule", "path": path}
    return None


def facts(text: str, path: str) -> dict:
    """Everything a metadata file says."""
    return {"references": mentions(text, path) + bindings(text, path), "bundle": bundle_parts(text, path), "fields": configured_fields(text, path), "automation": automation(text, path)}
