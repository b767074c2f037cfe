"""Text functions against hand-worked cases."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracegraph.functions import markdown as md
from tracegraph.functions import reviews as rv


def front(block: str) -> md.Frontmatter:
    return md.frontmatter(f"---\n{block}\n---\nbody\n")


@pytest.mark.parametrize("block,key,want", [
    ('title: "A: b # c"', "title", "A: b # c"), ("tags: []", "tags", []), ("tags: []  # none yet", "tags", []), ("tags: [a, 'b', \"c\"]", "tags", ["a", "b", "c"]),
    ("tags:\n  - a\n  - 'b'", "tags", ["a", "b"]), ("map:\n  inner: 1\nafter: yes", "after", "yes"), ("# only\nk: v", "k", "v"), ("k: 'it''s'", "k", "it''s"), (r'k: "a \" # b" # note', "k", r"a \" # b"),
    ("deps: [S-1.01,\n  S-1.02,\n  S-1.03, S-1.04]\nnext: x", "deps", ["S-1.01", "S-1.02", "S-1.03", "S-1.04"]), ("note: prose with [ open\nnext: x", "next", "x"), ("k: v # gone", "k", "v"),
])
def test_frontmatter(block, key, want):
    assert front(block).values[key] == want


def test_frontmatter_edges():
    f = md.frontmatter("no block\n# T")
    assert not f.values and f.body == "no block\n# T"
    f = front("d: []\na: null\nc: \"\"\nb: none\ne: [x]\nf: [x, y]")
    assert [f.one(k) for k in "abcdef"] == ["", "", "", "", "x", ""]
    assert [f.many(k) for k in "abcdefz"] == [[], [], [], [], ["x"], ["x", "y"], []]
    assert front("k: value # lost").notes == [("k", "comment-stripped-from-unquoted", 7)]
    assert front("k: 'open").notes[0][1] == "unterminated-quote"


@pytest.mark.parametrize("body", ["", "text", "## A\nx\n## A\ny", "```\n## no\n```\n## B\n", "~~~\n## no\n~~~\n", "## first line", "a\r\n## C\r\nb", "\n\n", "# top\n### deep\n", "## A\n```\n## open fence"])
def test_sections_partition(body):
    parts = md.sections(body)
    assert "".join(p[3] for p in parts) == body and [p[0] for p in parts] == list(range(len(parts)))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="#` ~\nab|\r", max_size=60))
def test_sections_lossless(body):
    assert "".join(p[3] for p in md.sections(body)) == body


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="[Prior: ab](v1.2)2024-01-02", max_size=60))
def test_ledger_round_trip(v):
    assert md.join_ledger(md.split_ledger(v)) == v


def test_tables():
    body = "## One\n| A | B |\n|---|:-:|\n| 1 | x \\| y |\n\n```\n| no | no |\n```\n## Two\n| C |\n|-|\n| --- |\n"
    t = md.tables(body)
    assert [(x["heading"], x["header"], [c for c, _ in x["rows"]]) for x in t] == [("One", ["A", "B"], [["1", "x | y"]]), ("Two", ["C"], [["---"]])]
    assert md.column_index(t[0], "**B**") == 1 and md.column_index(t[0], "Z") == -1 and md.cell(["a"], 3) == ""
    assert md.split_cells("| a || b |") == ["a", "", "b"] and md.split_cells("|a|b|") == ["a", "b"]


def test_cells():
    assert md.normal_cell(" [T](u)  **b** ~~c~~ `d` (kept)") == "T b c d (kept)" and md.struck("~~x~~")
    assert md.without_id("BC-1.02.003: Weigh") == "Weigh" and md.without_id("Story S-1.01 — Go") == "Go"
    assert md.annotation("draft (since May)") == ("draft", "(since May)")
    assert [md.leading_int(s) for s in ("117", "1,959", "**26**", "0", "TBD", "", "[a, b]")] == [117, 1959, 26, 0, None, None, None]
    assert all(map(md.placeholder, ["none", "CAP-TBD", "TBD", "--", "", "—", "n/a"])) and not any(map(md.placeholder, ["CAP-001", "draft", "0"]))
    assert md.bracket_list("[S-4.01, S-4.02] (two)") == (["S-4.01", "S-4.02"], "(two)")
    assert md.plain_id_list("VP-001, VP-002 (x)") == ["VP-001", "VP-002"] and md.plain_id_list("VP-001 and more") is None


@pytest.mark.parametrize("kind,a,d,want", [
    ("text", "x", "x", "agree"), ("text", "X", "x", "agree-casefold"), ("text", "a", "b", "disagree"), ("text", "TBD", "", "agree"), ("text", "TBD", "v", "index-placeholder"), ("text", "v", "", "store-empty"),
    ("title", "BC-1.01.001: Weigh", "Weigh", "agree"), ("title", "Weigh", "Weigh a parcel", "title-abbreviates"), ("title", "Weigh a parcel now", "Weigh", "title-elaborates"), ("title", "Go", "Weigh", "disagree"),
    ("enum", "draft (since May)", "draft", "agree"), ("enum", "Draft", "draft", "agree-casefold"), ("enum", "active", "draft", "disagree"),
    ("set", "VP-002, VP-001", "VP-001, VP-002", "agree-set"), ("set", "VP-001", "VP-001, VP-002", "disagree"), ("set", "VP-001 and friends", "VP-001", "prose-in-set"), ("set", "—", "VP-001", "index-placeholder"),
    ("count", "0", "", "agree"), ("count", "0", "S-1.01", "disagree"), ("count", "2", "S-1.01, S-1.02", "agree"), ("count-or-set", "[S-1.02, S-1.01]", "S-1.01, S-1.02", "agree-set"),
    ("count-or-set", "[S-1.01 maybe]", "S-1.01", "prose-in-set"), ("count-or-set", "S-1.01", "S-1.01", "agree-set"), ("count-or-set", "many", "S-1.01", "disagree"),
])
def test_compare_cell(kind, a, d, want):
    assert md.compare_cell(kind, a, d) == want


def test_ledger():
    assert md.split_ledger("2024-01-02 (v1.1) x [Prior: 2023-12-01 (v1.0) y]")[0][2:] == ("v1.1", "2024-01-02")
    assert md.ledger_like("delta", "2024-01-02 (a) 2024-01-03 (b)") and not md.ledger_like("delta", "2024-01-02 (a) long prose") and not md.ledger_like("other", "2024-01-02 (a) 2024-01-03 (b)")
    assert md.ledger_imbalance("a [Prior: b [Prior: c]") == (2, 1)


def test_small():
    assert md.mask_code("a `BC-1` b") == "a        b" and len(md.mask_code("`é` `")) == 5
    assert md.version_less("2.9", "2.10") and md.version_less("2.99", "3.0") and not md.version_less("3.0", "2.99")
    assert md.cut_last("a|b|c", "|") == ("a|b", "c", True) and md.cut_last("a", "|") == ("a", "", False) and md.commas("1,234") == 1234


@pytest.mark.parametrize("line,finding,level,form", [
    ("### F-001: A gap\n- Severity: HIGH", "F-001", "HIGH", "heading"), ("#### **CRIT-01** — Bad", "CRIT-01", "CRIT", "heading"), ("### ADV-C1-P02-MED-003: Odd", "ADV-C1-P02-MED-003", "MED", "heading"),
    ("| SEC-4 | LOW | Leak |", "SEC-4", "LOW", "table-row"), ("**HIGH-7** (new): Slow path", "HIGH-7", "HIGH", "inline"), ("### P3-12 [LOW] Small", "P3-12", "LOW", "heading"),
])
def test_finding_forms(line, finding, level, form):
    rows, repeats, empty = rv.review_findings(line)
    assert [(r["finding_id"], r["severity"], r["form"]) for r in rows] == [(finding, level, form)] and repeats == empty == 0


def test_finding_rules():
    rows, repeats, _ = rv.review_findings("| F-1 | MED | Short |\n\n### F-1: Long statement\n")
    assert len(rows) == 1 and repeats == 1 and rows[0]["form"] == "heading" and rows[0]["severity"] == "MED"
    rows, *_ = rv.review_findings("# Part A: fix verification\n### F-1: a\n# Part B\n### F-2: b\n")
    assert [r["owned"] for r in rows] == [False, True]
    rows, *_ = rv.review_findings("### F-1: a\ntext\n### F-2: b\n**Severity:** HIGH\n- Severity: LOW\n")
    assert [r["severity"] for r in rows] == ["", "HIGH"]  # neither attribute nor bold line leaks from the next finding
    assert rv.review_findings("### F-9:\n")[2] == 1
    assert rv.distribution("1H/3M/2L") == ({"LOW": 2, "HIGH": 1, "MED": 3}, []) and rv.distribution("2 CRIT, 1 Weird") == ({"CRIT": 2}, ["Weird"])
    assert rv.show_distribution({"LOW": 2, "CRIT": 1, "OBS": 0}) == "1CRIT/2LOW"


def test_sub_artifacts():
    body = "## AC-1: holds by BC-1.01.001 postcondition 1\n| PC2 | see VP-003 |\n### PC-2: again\n```\n### AC-9: no\n```\n| EC-1 | proposed BC-2.02.002 |\n### T-4: `BC-3.03.003` and BC-4.04.004-name\n"
    rows, refs, repeats = rv.sub_artifacts(body)
    assert [(r["kind"], r["sub_id"], r["form"]) for r in rows] == [("ac", "AC-1", "heading"), ("pc", "PC-2", "heading"), ("ec", "EC-1", "table-row"), ("t_task", "T-4", "heading")] and repeats == 1
    assert [(r["target_id"], r["clause"]) for r in refs] == [("BC-1.01.001", "postcondition 1"), ("VP-003", "")]


@pytest.mark.parametrize("cited,kind,want", [("1.25", "story", "lagging-floating"), ("1.25", "adversarial-review", "lagging-pinned-ok"), ("2.65", "story", "current"), ("9.99", "review", "ahead-never-existed")])
def test_cites(cited, kind, want):
    _, cites = rv.prose_references(kind, f"see BC-INDEX v{cited} and `BC-INDEX v0.1`\n```\nBC-INDEX v0.2\n```", {"BC-INDEX": "2.65"}, {}, {})
    assert [c["verdict"] for c in cites] == [want]
    assert rv.prose_references(kind, "NO-SUCH v1.0", {}, {}, {})[1][0]["verdict"] == "target-unknown"


def test_section_references():
    own = {"scope": 1, "error handling": 2, "phases": 3}
    others = {"BC-1.01.001": {"limits": 4, "twice": rv.AMBIGUOUS}}
    status = lambda s: rv.prose_references("story", s, {}, own, others)[0][0]
    assert (status("§Scope")["status"], status("§2 of it")["section"], status("§Error handling applies")["section"], status("§Phase 3")["section"]) == ("resolved", 2, 2, 3)
    assert status("BC-1.01.001 §Limits")["section"] == 4 and status("BC-1.01.001 §Nothing here")["status"] == "dangling"
    assert status("BC-1.01.001 §twice")["status"] == "unresolvable" and status("§Nowhere at all")["status"] == "unresolvable" and status("VP-009 §Limits")["status"] == "unresolvable"
    assert rv.resolve_section("error", own)[2] is False and rv.resolve_section("99", own)[2] is False  # one vague word, an ordinal out of range
    names = rv.item_sections({}, "## A\n- FR-001 x\n**Bold label:** y\n## B\nFR-001\nFR-002\n")
    assert names["fr-001"] == rv.AMBIGUOUS and names["fr-002"] == 1 and names["bold label"] == 0
