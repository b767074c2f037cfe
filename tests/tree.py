"""A small tree of documents with planted faults."""

from __future__ import annotations

from pathlib import Path

CONTRACTS = "specs/behavioral-contracts"
FILES = {
    "specs/architecture/ARCH-INDEX.md": "# Architecture\n\n| SS-ID | Name | Prefix | Section |\n|---|---|---|---|\n| SS-01 | Intake desk | BC-1 | 3.1 |\n| SS-02 | Ledger room | BC-2 | 3.2 |\n\n**Total BCs: 3**\n\n### ADR-004: One writer at a time\n",
    "specs/domain-spec/capabilities.md": "# Capabilities\n\n**CAP-001 — Take parcels in**\n",
    "specs/domain-spec/invariants.md": "# Invariants\n\n**DI-001 — A parcel has one owner** _(always)_\n",
    "specs/prd.md": "# Product\n\n### FR-001: Parcels can be weighed\n\n| Id | What |\n|---|---|\n| NFR-PERF-002 | under a second |\n",
    "phase-0-ingestion/pass-4-nfr-catalog.md": "# Catalog\n\n### NFR-SEC-001: Doors are locked\n",
    "specs/behavioral-contracts/BC-INDEX.md": "---\ndocument_type: bc-index\nnote: a value with an open [ bracket in prose\ntotal_bcs: 5\nversion: 2.65\n---\n# Index\n\n| Subsystem | Prefix | Count |\n|---|---|---|\n| SS-02 Ledger room | BC-2 | 3 |\n| **Total** | | **4** |\n\n| BC | Title |\n|---|---|\n| BC-1.01.001 | Weigh |\n| BC-1.01.002 | Label |\n| [BC-2.01.001](x) | Book |\n| BC-9.09.009 | Ghost |\n",
    f"{CONTRACTS}/ss-01/BC-1.01.001.md": "---\ndocument_type: contract\nsubsystem: SS-01\ncapability: CAP-001\nversion: v1.2\nlifecycle_status: active\nlast_amended: \"2024-03-01 (v1.2) Weights in grams [Prior: 2024-01-02 (v1.1) First]\"\n---\n# BC-1.01.001: Weigh a parcel\n\n## Preconditions\n\nA scale. See BC-INDEX v1.25 and `BC-INDEX v9.99`.\n\n### EC-001: no parcel\n",
    f"{CONTRACTS}/ss-01/BC-1.01.002.md": "---\nsubsystem: SS-02\ncapability: CAP-777\nreplacement: merged into the weigher\n---\n# Label a parcel\n",
    "specs/behavioral-contracts/ss-02/BC-2.01.001.md": "---\nsubsystem: SS-02\n---\n# Book a parcel\n",
    "specs/verification-properties/VP-001.md": "---\nscope: SS-01, SS-02\nbcs:\n  - BC-1.01.001\n  - BC-7.07.007 (to be written)\ndomain_invariants: [DI-001]\nnfrs: [NFR-SEC-001]\nproof_method: test\ntype: safety\n---\n# Weights are positive\n",
    "stories/epics/E-01-parcel-desk.md": "# Epic\n",
    "stories/S-1.01-weigh.md": "---\nstory_id: S-1.01\nepic_id: E-01\nstatus: ready\nwave: 1\nbehavioral_contracts: [BC-1.01.001]\nverification_properties: [VP-001]\nfunctional_requirements: [FR-001]\nsubsystems: [SS-01 desk]\ndepends_on: []\nblocks: [S-1.02, S-8.08]\n---\n# Weigh\n\n### AC-001: traces to BC-1.01.001 postcondition 1\n### AC-002: traces to BC-1.01.002\n",
    "stories/S-1.02-label.md": "---\nstory_id: S-1.02\nepic_id: E-01\ndepends_on: [S-1.01]\n---\n# Label\n",
    "stories/legacy/S-0.9.md": "A story from before, without any frontmatter.\n",
    "cycles/c1/adversarial-review-1.md": "---\ndocument_type: adversarial-review\npass: 1\ntarget: BC-1.01.001\nfinding_count: 3\nseverity_distribution: 1H/1M/2X\n---\n# Part A: fix verification\n\n### F-001: old one\n\n# Part B: new findings\n\n### HIGH-002: Scale may be off\n- Location: ss-01\n- Category: spec-gap\n\n| F-003 | MED | Label may peel |\n",
}


def write(root: Path) -> str:
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)
