"""Plain-Python kernels against naive versions."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.functions import kernels
from quarry.sources import strings
from quarry.sources.apex import extract
from quarry.sources.lexer import lex, parameterized

TOKENS = st.lists(st.sampled_from(["a", "bb", "é😀", "c"]), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(TOKENS, max_size=4))
def test_winnow(sequences):
    """Several sequences at once; hashes in 32 bits by a loop."""
    flat, counts = [t for s in sequences for t in s], np.array(list(map(len, sequences)), np.int64)
    docs, found, places = kernels.winnowed(flat, counts)
    got = [[] for _ in sequences]
    for d, h, i in zip(docs.tolist(), found.tolist(), places.tolist(), strict=True):
        got[d].append((h, i))
    all_hashes = []
    for tokens, own in zip(sequences, got, strict=True):
        hashes = [kernels.fnv1a32(kernels.SEPARATOR.join(tokens[i : i + 12])) for i in range(max(0, len(tokens) - 11))]
        want, last = [], None
        for begin in range(max(1, len(hashes) - 5) if hashes else 0):
            best = min(range(begin, min(begin + 6, len(hashes))), key=lambda i: (hashes[i], -i))
            if best != last:
                want.append((hashes[best], best))
                last = best
        assert own == want == kernels.winnow(tokens)
        all_hashes += hashes
    assert kernels.kgram_hashes(flat, counts)[1].tolist() == all_hashes


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14))
def test_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = list(row)
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    assert kernels.lcs_length(list(a), list(b)) == row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 9)), max_size=20))
def test_merged(spans):
    spans = [(a, a + n) for a, n in spans]
    covered = {x for a, z in spans for x in range(a, z + 1)}
    out = kernels.merged(spans)
    assert {x for a, z in out for x in range(a, z + 1)} == covered
    assert all(b[0] > a[1] + 1 for a, b in zip(out, out[1:]))


def test_maximal_matches():
    left = list("xx") + [str(i) for i in range(50)] + list("yy")
    right = list("z") + [str(i) for i in range(50)] + list("w")
    assert kernels.maximal_matches(left, right, [(10, 9), (3, 2)]) == [(2, 51, 1, 50)]
    assert kernels.maximal_matches(left, right, [(10, 8)]) == []


def test_known_hash():
    assert kernels.stable_hash("") == "811c9dc5" and kernels.stable_hash("a") == "e40c292c"


def test_folding():
    known = {"PREFIX": "select Id "}.get
    assert strings.folded("PREFIX+('from Case')", known) == "select Id from Case"
    assert strings.folded("'it\\'s'") == "it's"
    assert strings.folded("'a'+other") is None and strings.folded("('a')+('b')") == strings.folded("(('a'+'b'))") == "ab"
    assert strings.folded("'a'+('b'+'c')") is strings.folded("'a'+") is strings.folded("") is strings.folded("f('a')") is None
    found = strings.dynamic_query("SELECT Name, Id FROM Case WHERE Status = 'x' AND a = 1 ORDER BY Id LIMIT 5")
    assert found == {"object": "Case", "fields": ["Id", "Name"], "filterShape": "status=?anda=?", "normalizedQuery": "selectname,idfromcasewherestatus=?anda=?orderbyidlimit?"}
    assert strings.dynamic_query("UPDATE x") is None and strings.dynamic_query("select count() from Lead for update")["object"] == "Lead"
    assert strings.parts("a,f(b,c),[SELECT x,y],'q,r'", ",") == ["a", "f(b,c)", "[SELECT x,y]", "'q,r'"]
    assert strings.query_shape("select Id from A where x=:ids and n=12 and s='q'") == "selectidfromawherex=:bindandn=?ands=?"
    assert strings.dml_options("insert", ["rows", "false"]) == ("false", "default")
    assert strings.dml_options("upsert", ["rows", "Account.Key__c"]) == ("default", "default")
    assert strings.dml_options("update", ["rows", "flag", "AccessLevel.USER_MODE"]) == ("dynamic", "user")
    assert strings.masked("a/*x\ny*/b//c\n'q'", True) == "a   \n   b   \n   "


def test_parameterized_names():
    one, two = (parameterized(lex(t)[0]) for t in ("Integer n = 1; for (Account a : rows) { n += a.Size; }", "Integer total = 7; for (Account item : list1) { total += item.Amount; }"))
    assert one == two and "<type:account>" in one


def test_reader():
    source = """public with sharing class Box implements Queueable, Util.Named {
        static final String BASE = 'SELECT Id, Name FROM Account ' ; Map<Id, Account> held { get; private set; }
        @AuraEnabled public static void run(List<Account> rows, Integer n) {
            if (n > 1 && rows.size() < 3) { for (Account a : rows) { a.Name = 'x' + n; } } else { throw new BoxException('no'); }
            List<Contact> found = [SELECT Id, Name FROM Contact WHERE AccountId IN :rows AND Name = 'q' LIMIT 5];
            insert found; Database.update(rows, false);
            Database.query(BASE + 'LIMIT 1'); new Helper(n).go(rows[0].Id); Type t = Type.forName(n == 1 ? 'A' : 'B');
        }
        public void execute(QueueableContext c) { try { super.toString(); } catch (Exception e) { return; } }
        class Inner { Inner() { this(1); } Inner(Integer i) { } }
    }"""
    facts = extract(source, "classes/Box.cls")
    assert not facts["diagnostics"]
    assert [(s["kind"], s["qualifiedName"]) for s in facts["symbols"]] == [
        ("class", "Box"), ("method", "Box.run(List<Account>, Integer)"), ("method", "Box.execute(QueueableContext)"), ("class", "Box.Inner"), ("constructor", "Box.Inner.Inner()"), ("constructor", "Box.Inner.Inner(Integer)"),
    ]
    box = facts["symbols"][0]
    assert box["interfaces"] == ["Queueable", "Util.Named"] and box["modifiers"] == ["public", "withsharing"] and box["sourceCharacters"] == len(source) - len("public with sharing ")
    run = next(b for b in facts["behaviors"] if ".run(" in b["symbolId"])
    assert (run["branches"], run["loops"], run["throws"], run["assignments"], run["assignmentTargets"]) == (1, 1, 1, 1, ["a.Name"])
    assert [(q["object"], q["fields"], q["dynamic"]) for q in run["queries"]] == [("Contact", ["Id", "Name"], False), ("Account", ["Id", "Name"], True)]
    assert run["queries"][0]["filterShape"] == "whereaccountidin:bind" or run["queries"][0]["filterShape"].startswith("where")
    assert [(d["operation"], d["targetType"], d["allOrNone"]) for d in run["dml"]] == [("insert", "Contact", "default"), ("update", "Account", "false")]
    assert [b["code"] for b in facts["blockers"]] == ["dynamic-type"]
    calls = {(r["memberName"], r["receiverType"], r["arity"]) for r in facts["references"] if r["kind"] == "call"}
    assert {("go", "Helper", 1), ("size", "List<Account>", 0), ("query", "Database", 1)} <= calls
    assert {e["kind"] for e in facts["exposures"]} == {"annotation", "visibility", "platform-callback"}


def test_reader_goes_on_after_an_error():
    facts = extract("public class A { void a() { Case } void b() { c(); } }", "A.cls")
    assert len(facts["diagnostics"]) == 1
    assert [s["name"] for s in facts["symbols"]] == ["A", "a", "b"]
