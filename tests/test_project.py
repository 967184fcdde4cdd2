"""The analyzer over small projects of our own."""

import json

import pytest

from quarry.__main__ import main
from quarry.plans import flow, tree_queries
from quarry.plans.markdown import render
from quarry.plans.project import Project, analyze_project, to_json

HANDLER = """public class OrderHandler {
    public static void run(List<Order> rows) { dispatch(rows.size()); Worker w = new FastWorker(); w.work(); System.enqueueJob(new Job()); }
    static void dispatch(Integer n) { if (n > 0) { helper(n); } }
    static void helper(Integer n) { Integer m = n; }
    static void orphan() { helper(1); }
}"""
BODY = """{ Decimal total = 0; Decimal limitValue = 100; for (Invoice row : rows) { if (row.Amount != null && row.Amount > 10) { total += row.Amount; row.Level__c = 'High'; } else { row.Level__c = 'Low'; } }
    if (total > limitValue) { total = limitValue; } Integer steps = 0; while (steps < 5) { steps = steps + 1; total = total + steps; } return total; }"""
FILES = {
    "sfdx-project.json": '{"packageDirectories": [{"path": "app"}]}',
    "app/classes/OrderHandler.cls": HANDLER,
    "app/classes/Worker.cls": "public interface Worker { void work(); }",
    "app/classes/FastWorker.cls": "public class FastWorker implements Worker { public void work() { } }",
    "app/classes/Job.cls": "public class Job implements Queueable { public void execute(QueueableContext c) { } public void never() { } }",
    "app/classes/OldCode.cls": "public class OldCode { public static void used() { } }",
    "app/classes/OldCodeTest.cls": "@isTest private class OldCodeTest { @isTest static void calls() { OldCode.used(); } }",
    "app/classes/Panel.cls": "public class Panel { @AuraEnabled public static String load() { return 'x'; } @AuraEnabled public static String other() { return 'y'; } }",
    "app/classes/Bundle.cls": "public class Bundle { @AuraEnabled public static void invoked() { } public static void idle() { } }",
    "app/classes/Configured.cls": "public class Configured { public void go() { } }",
    "app/classes/Prose.cls": "public class Prose { public void nothing() { } }",
    "app/classes/SumOne.cls": "public class SumOne { public Decimal add(List<Invoice> rows) " + BODY + " }",
    "app/classes/SumTwo.cls": "public class SumTwo { public Decimal plus(List<Invoice> items) " + BODY.replace("rows", "items").replace("total", "whole").replace("'High'", "'Top'") + " }",
    "app/classes/SumThree.cls": "public class SumThree { public Decimal calc(List<Invoice> rows) " + BODY.replace("return total;", "Decimal extra = total; return extra;") + " }",
    "app/triggers/OrderTrigger.trigger": "trigger OrderTrigger on Order (after insert) { OrderHandler.run(Trigger.new); }",
    "app/triggers/LeadTrigger.trigger": "trigger LeadTrigger on Lead (before insert, before update) { LeadHandler.mark(Trigger.new); }",
    "app/classes/LeadHandler.cls": "public class LeadHandler { public static void mark(List<Lead> leads) { for (Lead l : leads) { l.Status = 'Open'; } } }",
    "app/lwc/panel/panel.js": "import load from '@salesforce/apex/Panel.load';",
    "app/lwc/panel/__tests__/panel.test.js": "import other from '@salesforce/apex/Panel.other';",
    "app/aura/box/box.cmp": '<aura:component controller="Bundle"/>',
    "app/aura/box/boxController.js": '({ go: function(c) { c.get("c.invoked"); } })',
    "app/customMetadata/Service.One.md-meta.xml": '<CustomMetadata><values><field>Class__c</field><value xsi:type="xsd:string">Configured</value></values></CustomMetadata>',
    "app/labels/Labels.labels-meta.xml": "<labels><value>The Prose class does nothing.</value></labels>",
    "app/pages/Old.page": '<apex:page controller="Prose2" extensions="A, B" action="{!start}"/>',
}


def written(path, files):
    for name, text in files.items():
        out = path / name
        out.parent.mkdir(parents=True, exist_ok=True)
        out.write_text(text, encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def report(spark, tmp_path_factory):
    return analyze_project(spark, written(tmp_path_factory.mktemp("mixed"), FILES))


def short(report, key="reachability"):
    return {k.split("@")[0].split(":")[1]: v for k, v in report[key].items()}


def test_reachability(report):
    got = short(report)
    live = ("ordertrigger", "orderhandler.run(list<order>)", "orderhandler.dispatch(integer)", "orderhandler.helper(integer)", "worker.work()", "fastworker.work()", "job.execute(queueablecontext)", "panel.load()", "bundle.invoked()", "configured", "leadhandler.mark(list<lead>)")
    assert {k: got[k] for k in live} == dict.fromkeys(live, "production")
    assert got["oldcode.used()"] == got["oldcodetest.calls()"] == "test-only"
    dead = ("orderhandler.orphan()", "job.never()", "panel.other()", "bundle.idle()", "configured.go()", "prose", "prose.nothing()")
    assert {k: got[k] for k in dead} == dict.fromkeys(dead, "unreachable")
    paths = short(report, "evidencePaths")
    assert len(paths["panel.load()"]) == 1 and [p.split("@")[0] for p in paths["orderhandler.helper(integer)"]] == ["type:ordertrigger", "method:orderhandler.run(list<order>)", "method:orderhandler.dispatch(integer)", "method:orderhandler.helper(integer)"]
    assert report["analysis"]["status"] == "complete" and not report["diagnostics"]


def test_candidates_and_summary(report):
    names = {c["qualifiedName"] for c in report["candidates"]}
    assert {"Prose", "OrderHandler.orphan()", "SumOne"} <= names and not {"OldCode", "Panel", "OrderHandler"} & names
    x = report["executive"]
    assert abs(x["retainedPercent"] + x["deprecationCandidatePercent"] - 100) < 0.02 and x["deprecationCandidateCharacters"] > 0


def test_name_audit(report):
    used = {e["name"]: e["referencedByName"] for e in report["topLevelClassNameAudit"]["entries"]}
    assert used["OrderHandler"] and used["Job"] and used["Panel"] and used["Configured"] and used["OldCodeTest"]
    assert not used["Prose"] and not used["OldCode"] and not used["SumOne"]


def test_clones(report):
    kinds = {g["kind"]: {o["symbolId"].split(".")[0].split(":")[1] for o in g["occurrences"]} for g in report["duplicates"]["cloneGroups"]}
    assert kinds == {"parameterized": {"sumone", "sumtwo"}, "near-miss": {"sumone", "sumtwo", "sumthree"}}
    d = report["duplicates"]
    assert 0 < d["duplicatedCharacters"] < d["cloneCoverageCharacters"] and 0 < d["duplicatedTokens"] < d["cloneCoverageTokens"] < d["productionTokens"]


def test_flow(report):
    got = {a["triggerName"]: a for a in report["flowMigration"]["assessments"]}
    assert (got["LeadTrigger"]["status"], got["LeadTrigger"]["kind"]) == ("eligible", "before-save-field-update")
    assert [a["action"] for a in got["LeadTrigger"]["reclaimableArtifacts"]] == ["delete-file", "delete-file"]
    assert got["OrderTrigger"]["status"] == "ineligible" and any("asynchronous" in b for b in got["OrderTrigger"]["blockers"])


def test_report_is_text(report):
    assert json.loads(to_json(report))["schemaVersion"] == "4.1.0"
    text = render(report)
    assert "## Triggers" in text and "LeadTrigger" in text


def test_markdown_and_totals_gather_no_long_lists(spark, tmp_path, monkeypatch):
    more = {f"app/classes/Lone{n}.cls": f"public class Lone{n} {{ public void go{n}() {{ }} }}" for n in range(30)} | {f"app/classes/Lone{n}Twice.cls": f"public class Lone{n} {{ }}" for n in range(27)}
    p = Project(spark, written(tmp_path / "many", FILES | more))
    whole = p.report()
    for gathered in ("report", "evidence", "clone_groups", "clone_totals"):
        monkeypatch.delattr(Project, gathered)
    monkeypatch.setattr(tree_queries, "project", lambda *_: p)
    shown = render(p.overview() | {"generatedAt": ""})
    assert shown == render(whole | {"generatedAt": ""}) and shown.count("additional item(s)") >= 3
    totals = p.totals()
    assert totals["inventory"] == whole["inventory"] and totals["summary"] == whole["summary"] and totals["findings"] == len(whole["analysis"]["findings"]) > 25
    assert all(whole[part][k] == v for part in ("flowMigration", "topLevelClassNameAudit") for k, v in totals[part].items())
    got = {r["name"]: r["value"] for r in tree_queries.tree_report(spark, "").collect()}
    assert got["symbols"] == len(whole["symbols"]) and got["findings"] == len(whole["analysis"]["findings"])
    cut = {r["section"]: (r["lines"], r["more"]) for r in tree_queries.tree_markdown(spark, "").collect()}
    assert cut["Integrity findings"] == (25, len(whole["analysis"]["findings"]) - 25)


def test_names_of_records_are_searched_before_the_save_only(spark, tmp_path, monkeypatch):
    asked, search = set(), flow.record_names
    monkeypatch.setattr(flow, "record_names", lambda paths, *rest: asked.update(r["label"] for r in paths.collect()) or search(paths, *rest))
    found = Project(spark, written(tmp_path / "mixed", FILES)).assessments.collect()
    before = {r["triggerSymbolId"] for r in found if all(e.startswith("before ") for e in r["events"])}
    assert asked == before and 0 < len(before) < len(found)


RESOLVER = """public class Resolver {
    public static void direct() { List<Setting__mdt> found = [SELECT Class__c FROM Setting__mdt]; make(found[0].Class__c); }
    public static void viaGetter() { Setting__mdt one = Setting__mdt.getInstance('Main'); make(one.Class__c); }
    public static void viaHelper() { make(load().get(0).Class__c); }
    static List<Setting__mdt> load() { return [SELECT Class__c FROM Setting__mdt]; }
    static void make(String className) { Type t = Type.forName(className); }
}"""


def test_computed_class_names(spark, tmp_path):
    files = {"sfdx-project.json": '{"packageDirectories": [{"path": "app"}]}', "app/classes/Resolver.cls": RESOLVER, "app/classes/Target.cls": "public class Target { }",
             "app/triggers/T.trigger": "trigger T on Account (after insert) { Resolver.direct(); Resolver.viaGetter(); Resolver.viaHelper(); }",
             "app/customMetadata/Setting.Main.md-meta.xml": '<x><values><field>Class__c</field><value xsi:type="xsd:string">Target</value></values></x>'}
    assert Project(spark, written(tmp_path / "ok", files)).graph["blockers"] == []
    files["app/classes/Resolver.cls"] = RESOLVER.replace("make(found[0].Class__c);", "String n = found[0].Class__c; if (n == null) { n = String.valueOf(1); } make(n);")
    left = Project(spark, written(tmp_path / "open", files)).graph["blockers"]
    assert [b["code"] for b in left] == ["dynamic-type"] and "Resolver.direct()" in left[0]["message"]


def test_broken_and_doubled_files(spark, tmp_path):
    broken = "class Broken { void a() { Case } }"
    p = Project(spark, written(tmp_path / "test", {"classes/BrokenTest.cls": "@isTest " + broken.replace("Broken", "BrokenTest"), "a/classes/Twice.cls": "class Twice { void a() { } }", "b/classes/Twice.cls": "class Twice { void a() { } }"}))
    assert [f["code"] for f in p.findings()] == ["duplicate-symbol", "test-parse-error"] and p.blockers_found == []
    p = Project(spark, written(tmp_path / "live", {"classes/Broken.cls": broken}))
    assert [b["code"] for b in p.blockers_found] == ["parse-error"] and p.findings() == []


def test_errors(spark, tmp_path, capsys):
    with pytest.raises(FileNotFoundError):
        Project(spark, str(tmp_path / "missing"))
    assert main([str(tmp_path / "missing")]) == 1
    (tmp_path / "sfdx-project.json").write_text("{")
    with pytest.raises(ValueError, match="Unable to read"):
        Project(spark, str(tmp_path))


def test_class_names_are_the_same_by_parts(spark, monkeypatch):
    """Gathered facts, and parts of them that the executors follow: the same blockers and edges."""
    from quarry.plans import project as plan

    text = """public class Maker {
    public static Type a(String n) { String x = n; return Type.forName(x); }
    public static Type b() { return Type.forName(rows().get(0).Class__c); }
    static List<Setting__mdt> rows() { return more(1); }
    static List<Setting__mdt> more(Integer k) { return [SELECT Class__c FROM Setting__mdt]; }
    public static Type c(String n) { return Type.forName(n); }
    public static Type d() { return Type.forName(Other.kept().Class__c); }
    void e() { a('Made'); a('Ma' + 'ker'); c(String.valueOf(2)); c('Made'); }
}"""
    other = "public class Other { public static Setting__mdt kept() { return Setting__mdt.getInstance('x'); } }"
    starts = "trigger Starts on Account (after insert) { Maker.b(); Maker.d(); new Maker().e(); Far.go(); }"
    far = "public class Far { public static void go() { to('Made'); } static void to(String n) { Type t = Type.forName(n); } }"
    record = '<CustomMetadata><values><field>Class__c</field><value xsi:type="xsd:string">Made</value></values></CustomMetadata>'
    files = [("app/classes/Maker.cls", text), ("app/classes/Other.cls", other), ("app/classes/Far.cls", far), ("app/classes/Made.cls", "public class Made { }"), ("app/triggers/Starts.trigger", starts), ("app/customMetadata/Setting.One.md-meta.xml", record)]
    found = []
    for few in (plan.FEW, 0):
        monkeypatch.setattr(plan, "FEW", few)
        if not few:
            monkeypatch.setattr(plan.provenance, "resolve", None)  # what gathers the facts
        p = plan.Project(spark, files=spark.createDataFrame(files, "path string, text string"))
        edges = p.graph["edges"].select("sourceId", "targetId", "kind", "resolution", "detail").collect()
        found.append((p.graph["blockers"], sorted(map(str, edges))))
    assert found[0] == found[1]
    assert {b["dynamicExpression"] for b in found[0][0] if b["code"] == "dynamic-type"} and any("Resolved Type.forName value: Made" in e for e in found[0][1])


def test_totals_follow_no_long_paths(spark, tmp_path, monkeypatch):
    """Verdicts in numbers equal those of the lists; of triggers only those with short paths are searched for."""
    from quarry.operators import graph
    from quarry.plans import flow

    calls = {f"classes/C{k}.cls": f"public class C{k} {{ public static void go() {{ C{k + 1}.go(); }} }}" for k in range(8)} | {"classes/C8.cls": "public class C8 { public static void go() { Type t = Type.forName(System.now().format()); } }"}
    own = calls | {f"classes/D{k}.cls": f"public class D{k} {{ public static void go() {{ D{k + 1}.go(); }} }}" for k in range(6)} | {"classes/D6.cls": "public class D6 { public static void go() { insert new Note__c(); } }"}
    own |= {f"triggers/T{k}.trigger": f"trigger T{k} on Thing{k}__c (after insert) {{ {c}.go(); }}" for k, c in enumerate(("C0", "C8", "D0", "D3", "D4", "D5", "D6"))}
    own |= {"triggers/U.trigger": "trigger U on Thing6__c (after insert) { D6.go(); }", "triggers/V.trigger": "trigger V on Other__c (after insert) { D6.go(); D5.go(); }"}
    p = Project(spark, written(tmp_path / "long", own))
    want = flow.totals(p.assessments)
    searched, search = [], graph.reach

    def watched(edges, seeds, **more):
        found = search(edges, seeds, **more)
        searched.extend(found.select("label", "node").collect() if "label" in seeds.columns and more.get("places") else [])
        return found

    monkeypatch.setattr(flow, "reach", watched)
    got = Project(spark, written(tmp_path / "again", own)).totals()["flowMigration"]
    assert got == want and want["eligibleTriggers"] >= 2 and want["blockedTriggers"] == 2
    assert 0 < len(searched) <= 4 * 6 and not any(":t0" in r.label or ":v" in r.label for r in searched)
