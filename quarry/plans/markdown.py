"""The report as Markdown: the largest findings of each kind; the JSON report has all."""

from __future__ import annotations

from collections.abc import Callable, Iterable

LIMIT, PLACES = 25, 5
#: What a reference by name is called, by its kind or the beginning of its detail.
LABELS = (
    ("LWC Apex import", "LWC import"), ("Aura", "Aura"), ("Visualforce", "Visualforce"), ("Flow Apex action", "Flow"), ("Custom Metadata", "Custom metadata"), ("Repository configuration", "Other configuration"),
)
OTHER = "Other metadata"
KINDS = {"apex-static-member": "Apex static member", "apex-constructor": "Apex constructor", "apex-type-literal": "Type.forName literal"}


def label(kind: str, detail: str) -> str:
    return KINDS.get(kind) or next((shown for begin, shown in LABELS if detail.startswith(begin)), OTHER)


def number(n: float) -> str:
    return f"{n:,}"


def share(p: float) -> str:
    return f"{p:.2f}%"


def cell(text) -> str:
    return str(text).replace("|", "\\|").replace("\n", " ")


def total(items: list) -> int:
    """How many there are, of which these may be the first."""
    return getattr(items, "total", len(items))


def table(head: list[str], items: list, row: Callable[[dict], Iterable], none: str, limit: int | None = LIMIT) -> list[str]:
    """A table of the first items, and how many more there are."""
    if not items:
        return [none]
    shown = items if limit is None else items[:limit]
    lines = [f"| {' | '.join(head)} |", f"|{' --- |' * len(head)}", *(f"| {' | '.join(map(cell, row(x)))} |" for x in shown)]
    return lines + (["", f"{number(total(items) - len(shown))} additional item(s) are in the JSON report."] if total(items) > len(shown) else [])


def blocker_summary(blockers: list[dict]) -> list[str]:
    groups: dict[str, list[dict]] = {}
    for b in blockers:
        groups.setdefault(b["code"], []).append(b)
    lines = []
    for code, own in groups.items():
        places = [f"`{b['location']['path']}:{b['location']['line']}`" for b in own if b.get("location")]
        more = f" and {number(len(places) - PLACES)} more" if len(places) > PLACES else ""
        lines += [f"- **{code}**: {number(len(own))} location(s): {', '.join(places[:PLACES])}{more}"]
    return [*lines, "", *(f"  - {b['message']}" for b in blockers[:LIMIT])]


def source_counts(audit: dict) -> list[tuple[str, int, int]]:
    """(label, classes, occurrences) of references to production classes, the most first."""
    found: dict[str, list] = {}
    for e in audit["entries"]:
        for r in e["references"] if not e["testCode"] else ():
            own = found.setdefault(label(r["kind"], r["detail"]), [set(), 0])
            own[0].add(e["path"])
            own[1] += 1
    return sorted(((k, len(c), n) for k, (c, n) in found.items()), key=lambda x: (-x[1], -x[2], x[0]))


def render(report: dict) -> str:
    """Of Project.report(), or of Project.overview(), which has only what is shown."""
    a, d, m, x, inv = report["topLevelClassNameAudit"], report["duplicates"], report["flowMigration"], report["executive"], report["inventory"]
    blockers, findings, rev = report["analysis"]["blockers"], report["analysis"]["findings"], report["revision"]
    shown = f"{rev.get('branch')} @ {rev.get('commit', '')[:12]}{' (dirty working tree)' if rev.get('dirty') else ''}" if rev["available"] else "not available"
    exact = sum(q["kind"] == "exact-query" for q in d["queryFamilies"])
    gaps = d["queryCoverage"]["unresolvedDynamicQueries"]
    if "entries" in a:
        sources, unused = source_counts(a), sorted((e for e in a["entries"] if not e["testCode"] and not e["referencedByName"]), key=lambda e: (-e["bytes"], e["name"]))
        types = [c for c in report["candidates"] if c["kind"] in ("class", "interface", "enum")]
        members = [c for c in report["candidates"] if c["kind"] not in ("class", "interface", "enum")]
    else:
        sources, unused, types, members = a["sources"], a["unused"], report["candidates"]["types"], report["candidates"]["members"]
    candidates = lambda items: table(["Candidate", "Kind", "Characters", "Location", "Exposure"], items, lambda c: (c["qualifiedName"], c["kind"], number(c["sourceCharacters"]), f"`{c['location']['path']}:{c['location']['line']}`", "; ".join(c["exposures"]) or "none"), "None.")
    complete = report["analysis"]["status"] == "complete"
    parts = [
        "# Code capacity report", "", f"Made by {report['tool']['name']} {report['tool']['version']} at {report['generatedAt']}. Revision: **{shown}**.", "",
        "> Closed world: all code and calling metadata are taken to be in the analyzed package directories.", "", "## Overview", "",
        f"- Classes that no production file names: **{share(a['unreferencedProductionPercent'])}** of production code ({number(a['unreferencedProductionCharacters'])} characters).",
        f"- Call graph: **{'complete' if complete else 'open'}**; **{share(x['deprecationCandidatePercent'])}** of production code is unreachable." + ("" if complete else f" {number(len(blockers))} place(s) to settle."),
        f"- Clones: **{share(x['redundancy']['coveredPercent'])}** is in a clone family, **{share(x['redundancy']['duplicatedPercent'])}** repeats another place.",
        f"- Queries: {number(exact)} exact and {number(len(d['queryFamilies']) - exact)} selector families; {number(total(gaps))} dynamic site(s) are excluded. Write families: {number(len(d['dmlFamilies']))}.",
        f"- Triggers: {number(m['eligibleTriggers'])} eligible, {number(m['ineligibleTriggers'])} ineligible, {number(m['blockedTriggers'])} blocked; {share(m['reclaimablePercent'])} could go.", "",
        "These percentages must not be added up: their places overlap.", "",
        *(["## Places to settle", "", *blocker_summary(blockers), ""] if blockers else []),
        *(["## Integrity findings", "", *table(["Finding", "Message", "Locations"], findings, lambda f: (f["code"], f["message"], ", ".join(f"`{p['path']}:{p['line']}`" for p in f["locations"][:PLACES])), ""), ""] if findings else []),
        "## Inventory", "", f"- {number(inv['apexFiles'])} code files, {number(inv['metadataFiles'])} metadata files; {number(inv['productionApexCharacters'])} production and {number(inv['testApexCharacters'])} test characters.",
        f"- {number(report['summary']['productionReachable'])} production-reachable, {number(report['summary']['testOnlyReachable'])} test-only, {number(report['summary']['unreachable'])} unreachable symbols.", "",
        "## Classes by name", "", *table(["Reference", "Classes", "Occurrences"], sources, lambda r: r, "No references."), "",
        *table(["Unnamed class", "Bytes", "Path"], unused, lambda e: (e["name"], number(e["bytes"]), f"`{e['path']}`"), "Every production class is named somewhere."), "",
        "## Clone families", "", *table(["Family", "Kind", "Similarity", "Repeated characters", "Places"], d["cloneGroups"], lambda c: (c["id"], c["profile"], c["similarity"], number(c["duplicatedCharacters"]), ", ".join(f"`{o['path']}:{o['line']}`" for o in c["occurrences"][:PLACES])), "None."), "",
        "## Query families", "", *table(["Family", "Object", "Occurrences", "Common fields"], d["queryFamilies"], lambda q: (q["kind"], q["object"], q["occurrences"], ", ".join(q["commonFields"]) or "none"), "None."), "",
        *([f"Excluded dynamic sites: {', '.join(f'`{g['location']['path']}:{g['location']['line']}`' for g in gaps[:LIMIT])}.", ""] if gaps else []),
        "## Write families", "", *table(["Operation", "Target", "allOrNone", "Access", "Occurrences"], d["dmlFamilies"], lambda w: (w["operation"], w["target"], w["allOrNone"], w["accessMode"], w["occurrences"]), "None."), "",
        "## Triggers", "", *table(["Trigger", "Object", "Status", "Kind", "Characters", "Reasons"], m["assessments"], lambda t: (t["triggerName"], t["object"], t["status"], t["kind"], number(t["reclaimableCharacters"]), "; ".join(t["blockers"] or t["reasons"])), "None.", None), "",
        "## Unreachable types", "", *candidates(types), "", "## Unreachable members", "", *candidates(members), "",
    ]
    return "\n".join(parts)
