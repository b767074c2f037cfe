"""Findings written in reviews, sub-artifacts of owners, and prose references, as rows."""

from __future__ import annotations

import re

from . import markdown as md

LEVELS = {"CRIT": ("crit", "critical", "c"), "HIGH": ("high", "h"), "MED": ("med", "medium", "m"), "LOW": ("low", "l"), "NIT": ("nit", "nitpick", "n"), "OBS": ("obs", "o", "observation")}
LEVEL_OF = {w: k for k, own in LEVELS.items() for w in own}
WORDS = "(?:CRIT(?:ICAL)?|HIGH|MED(?:IUM)?|LOW|NIT(?:PICK)?|OBS)"
FINDING_ID = rf"(?:ADV-\w+-P\d+\w*-{WORDS}-\d+|(?:F|CV|SEC|PG|{WORDS})[\dA-Z]*[-–][\w.\-]+|P\d+[a-zA-Z]?-\d+)"
HEADING = re.compile(rf"#{{3,6}}\s+(?:\*\*|\*)?({FINDING_ID})\*{{0,2}}\s*[—–:|-]?\s*(.*)$", re.A)
ROW = re.compile(rf"\|\s*\**({FINDING_ID})\*{{0,2}}\s*(\|.+)$", re.A)
INLINE = re.compile(rf"\*{{0,2}}((?:F|{WORDS})-\d+)\**[ \t]*(?:[(][^)]*[)])?[ \t]*:[ \t]*(.+?)\**$")
BULLET = re.compile(r"[ \t]*[*-][ \t]*([A-Z][a-zA-Z /]+):(.*)$")
MENTION = re.compile(r"resolution status|(?:re-?|fix[- ])verification|(?:carried[- ]forward|closure audit)|(?:previous|prior)[- ]pass|pass-\d+ closure", re.I)
OWNED = re.compile(r"part b|findings [(]this pass[)]|(?:fresh[- ]context|new findings)", re.I)
CATEGORIES = frozenset("spec-gap consistency completeness edge-case security performance".split())
FORMS = {"table-row": 2, "inline": 1, "heading": 0}
AHEAD = 8


def level(s: str) -> str:
    """Canonical severity, empty if there is none of the name."""
    return LEVEL_OF.get(s.strip().lower(), "")


def declared_category(s: str) -> bool:
    return s.strip().lower() in CATEGORIES


def owned_under(top: str) -> bool:
    """A section that only looks back at earlier findings doesn't own what it names."""
    return not MENTION.search(top) or bool(OWNED.search(top))


def attribute(lines: list[str], i: int, key: str) -> str:
    """Value of key in the next lines, up to the next finding's heading."""
    bold = re.compile(rf"\s*\*\*{re.escape(key)}:?\*{{2}}:?\s*(.+)$", re.I)
    for j, line in enumerate(lines[i : i + AHEAD]):
        if j and HEADING.match(line):
            break
        if m := bold.match(line):
            return m[1].strip("*").strip()
        if (m := BULLET.match(line)) and m[1].lower() == key.lower():
            return m[2].strip()
    return ""


def severity(finding: str, statement: str, lines: list[str], i: int, section: str) -> tuple[str, str]:
    """(severity, source) by the first of six sources that has one. A bold line counts only before the next finding's heading."""
    if c := level(re.match(r"[A-Za-z]*", attribute(lines, i, "Severity"))[0]):
        return c, "attr-bullet"
    if m := re.match(rf"\s*\[?\*{{0,2}}({WORDS})\*{{0,2}}\]?", statement):
        return level(m[1]), "bracket-in-statement"
    for j, line in enumerate(lines[i : i + AHEAD]):
        if j and HEADING.match(line):
            break
        if m := re.search(rf"\*{{2}}Severity:?\*{{2}}:?[ \t]*\**\s*({WORDS})", line):
            return level(m[1]), "bold-line"
    if (m := re.fullmatch(r"ADV-\w+-P\d+\w*-([a-zA-Z]+)-\d+", finding)) and level(m[1]):
        return level(m[1]), "id-embedded-ADV"
    if (m := re.match(r"[A-Za-z]+", finding)) and level(m[0]):
        return level(m[0]), "id-prefix"
    return (level(section), "section-heading") if level(section) else ("", "")


def review_findings(body: str) -> tuple[list[dict], int, int]:
    """(findings, mentions of one already found, headings or rows without a statement); of several forms the best is kept."""
    lines = [x.rstrip("\r") for x in body.split("\n")]
    held: dict[str, dict] = {}
    repeats = empty = 0
    top = section = ""
    for i, line in enumerate(lines):
        if re.match(r"#{1,2}\s", line):
            top = line
        if m := re.match(rf"#{{2,4}}\s+\*{{0,2}}({WORDS})\b", line):
            section = m[1]
        found = None
        if m := HEADING.match(line):
            found = {"form": "heading", "finding_id": m[1], "statement": m[2].strip(), "location": attribute(lines, i, "Location"), "category": attribute(lines, i, "Category")}
        elif m := ROW.match(line):
            cells = [md.normal_cell(c) for c in md.split_cells(m[2])]
            found = {"form": "table-row", "finding_id": m[1], "statement": next((c for c in cells if c and not level(c)), ""), "location": "", "category": ""}
            own = next((level(c) for c in cells if level(c)), "")
            if own:
                found |= {"severity": own, "source": "table-column"}
        elif m := INLINE.match(line):
            found = {"form": "inline", "finding_id": m[1], "statement": m[2].strip(), "location": attribute(lines, i, "Location"), "category": ""}
        if not found:
            continue
        if not found["statement"]:
            empty += 1
            continue
        if "severity" not in found:
            found["severity"], found["source"] = severity(found["finding_id"], found["statement"], lines, i, section)
        found |= {"owned": owned_under(top), "line": i + 1}
        was = held.get(found["finding_id"])
        if was is None:
            held[found["finding_id"]] = found
            continue
        repeats += 1
        better, other = (found, was) if FORMS[found["form"]] < FORMS[was["form"]] else (was, found)
        if not better["severity"]:
            better["severity"], better["source"] = other["severity"], other["source"]
        if better is found and not better["location"]:
            better["location"] = other["location"]
        held[found["finding_id"]] = better
    return list(held.values()), repeats, empty


def distribution(s: str) -> tuple[dict[str, int], list[str]]:
    """Counts by severity of texts like 1H/3M/2L, and the words that are no severity."""
    out: dict[str, int] = {}
    unknown = []
    for n, word in re.findall(r"(\d+)[ \t]*([a-zA-Z]+)", s):
        if c := level(word):
            out[c] = out.get(c, 0) + int(n)
        else:
            unknown.append(word)
    return out, unknown


def show_distribution(counts: dict[str, int]) -> str:
    return "/".join(f"{counts[k]}{k}" for k in LEVELS if counts.get(k, 0) > 0)


SUB_ID = r"((?:EC|T)-\d+|PC-?\d+|AC-\d+[a-z]?)"
SUB_HEADING = re.compile(rf"#{{2,6}}\s+\*{{0,2}}{SUB_ID}\*{{0,2}}\s*[:—–-]?\s*(.*)$")
SUB_ROW = re.compile(rf"\|\s*\**{SUB_ID}\*{{0,2}}\s*(\|.+)$")
TARGETS = {"bc": re.compile(rf"{md.ID}(?!\d|-[A-Za-z])"), "vp": re.compile(r"VP-\d+"), "adr": re.compile(r"ADR-\d+"), "fr": re.compile(r"FR-[\w.\-]+", re.A)}
CLAUSE = re.compile(r"\b(inv(?:ariant)?|(?:post|pre)condition|[ep]c)[\s-]*(\d+)", re.I)
GAP = re.compile(r"\[process-gap\]|\b(?:candidate|uncontracted|proposed|would need|does not exist|no existing)\b", re.I)


def sub_kind(name: str) -> tuple[str, str]:
    """(kind, normal id); PC2 is PC-2."""
    for head, kind in (("AC-", "ac"), ("EC-", "ec"), ("T-", "t_task")):
        if name.startswith(head):
            return kind, name
    return ("pc", "PC-" + name[2:].lstrip("-")) if name.startswith("PC") else ("", name)


def sub_artifacts(body: str) -> tuple[list[dict], list[dict], int]:
    """(parts, references to other artifacts, repeats). Fences, code spans and cells marked as gaps hold no references."""
    parts: dict[tuple[str, str], dict] = {}
    refs: list[dict] = []
    repeats, inside = 0, False
    for n, raw in enumerate(body.split("\n"), 1):
        line = raw.rstrip("\r")
        if md.FENCE.match(line):
            inside = not inside
            continue
        m = None if inside else SUB_HEADING.match(line)
        form = "heading" if m else "table-row"
        m = m or (None if inside else SUB_ROW.match(line))
        if not m:
            continue
        kind, name = sub_kind(m[1])
        cells = [m[2]] if form == "heading" else md.split_cells(m[2])
        statement = next((c for c in map(md.normal_cell, cells) if c), "")[:2000]
        was = parts.get((kind, name))
        repeats += was is not None
        if was is None:
            parts[kind, name] = {"kind": kind, "sub_id": name, "statement": statement, "form": form, "line": n}
        elif form == "heading" and was["form"] != "heading":
            was |= {"statement": statement, "form": form, "line": n}
        for c in map(md.mask_code, cells):
            if GAP.search(c):
                continue
            clause = CLAUSE.search(c)
            for target, pattern in TARGETS.items():
                refs += [{"kind": kind, "sub_id": name, "target_kind": target, "target_id": t, "clause": f"{clause[1].lower()} {clause[2]}" if clause else ""} for t in pattern.findall(c)]
    return list(parts.values()), refs, repeats


AMBIGUOUS = -2
CITE = re.compile(r"\b([A-Z](?:[A-Z\d]|-){2,}(?:\.md)?)[ \t]+v(\d+\.\d+)")
SECTION = re.compile(r"§\s*((?:\.\d|[^,;).]){2,60})")
OWNER = re.compile(rf"{md.ID}|S-\d+\.\d+|(?:VP|E|ADR|SS)-\d+|[A-Z](?:[A-Z\d]|-){{2,}}-INDEX")
NUMBER = re.compile(r"(\d{1,3})\b")
LABEL = re.compile(r"[A-Z]+-\d+(?:\.\d+)*")
IN_SECTION = re.compile(r"([^\W\d_][A-Za-z-]{3,20})[ \t]+\d\d?\d?\b")
WORD = re.compile(r"[A-Za-z][\w.-]*", re.A)
INDENT = re.compile(r"^[\s>|*_+-]*")
MARKS = re.compile(r"^[\s>|+-]*|`")
BOLD = re.compile(r"\*{2}([^*]{2,80})\*{2}")
ITEM = re.compile(r"((?:S|E|TD|ADR|VP|BC|DI|CAP|N?FR|[EAP]C)-\d+(?:\.\d+){0,2})\b")
PINNED_KINDS = ("adversar", "review", "burst", "lesson", "checkpoint", "decision-log")


def cite_target(s: str) -> str:
    return s.strip().removesuffix(".md").upper()


def pin_policy(kind: str) -> str:
    """Documents that look back are pinned to what they saw; others float."""
    return "pinned" if any(k in kind for k in PINNED_KINDS) else "floating"


def cite_verdict(cited: str, actual: str | None, pin: str) -> str:
    if actual is None:
        return "target-unknown"
    if actual == cited:
        return "current"
    if md.version_less(actual, cited):
        return "ahead-never-existed"
    return "lagging-pinned-ok" if pin == "pinned" else "lagging-floating"


def item_sections(names: dict[str, int], body: str) -> dict[str, int]:
    """names (heading in lower case to section) with items and bold labels of sections added; a label of two sections is AMBIGUOUS."""
    seen: dict[str, set[int]] = {}
    for k, _, heading, text in md.sections(body):
        labels = [m[1] for m in [ITEM.match(heading)] if m]
        inside = False
        for line in text.split("\n"):
            if md.fence(line):
                inside = not inside
            elif not inside:
                if "-" in line and (m := ITEM.match(INDENT.sub("", line))):
                    labels.append(m[1])
                if "**" in line.replace("`", "") and (m := BOLD.match(MARKS.sub("", line))):
                    label = m[1].strip().rstrip(":")
                    labels += [label] * (len(label) >= 2)
        for x in labels:
            if x.lower() not in names:
                seen.setdefault(x.lower(), set()).add(k)
    return names | {x: own.pop() if len(own) == 1 else AMBIGUOUS for x, own in seen.items()}


def section_names(body: str) -> dict[str, int]:
    """Headings in lower case to their section; the last of equal ones."""
    return {h.lower(): k for k, _, h, _ in md.sections(body) if h}


def resolve_section(captured: str, names: dict[str, int] | None) -> tuple[str, int, bool]:
    """(name, section, found). By number, by the longest run of words that is a name, by a prefix of one, by item in section."""
    if names is None:
        return "", -1, False
    if m := NUMBER.match(captured):
        n = int(m[1])
        return (f"§{m[1]}", n, True) if n <= max([0, *names.values()]) else ("", -1, False)
    words = [w.rstrip(":;,").strip("\"'`") for w in captured.split()]
    for n in range(len(words), 0, -1):
        k = names.get(" ".join(words[:n]).lower())
        if k == AMBIGUOUS:
            return "", AMBIGUOUS, False
        if k is not None:
            return " ".join(words[:n]), k, True
    least = 1 if words and LABEL.fullmatch(words[0]) else 2
    for n in range(len(words), least - 1, -1):
        start = " ".join(words[:n]).lower()
        longer = sorted((h for h, k in names.items() if k != AMBIGUOUS and h.startswith(start)), key=lambda h: (len(h), h))
        if longer:
            return longer[0], names[longer[0]], True
    if m := IN_SECTION.match(captured):
        for name in (m[1].lower() + "s", m[1].lower()):
            if name in names:
                return name, names[name], True
    return "", -1, False


def owner_before(line: str, at: int, known: set[str] | dict) -> str:
    """The document named right before a section mark; a word that belongs to an earlier mark is none."""
    last = None
    for last in WORD.finditer(line[:at]):
        pass
    if not last or line[: last.start()].rstrip(" \t").endswith("§"):
        return ""
    return last[0] if OWNER.search(last[0]) or cite_target(last[0]) in known else ""


def prose_references(kind: str, body: str, versions: dict[str, str], own: dict[str, int], others: dict[str, dict[str, int]]) -> tuple[list[dict], list[dict]]:
    """(section references, version cites) outside fences and code spans. A reference without a known owner is unresolvable, never dangling."""
    refs, cites = [], []
    pin, inside = pin_policy(kind), False
    for n, raw in enumerate(body.split("\n"), 1):
        if md.fence(raw):
            inside = not inside
            continue
        if inside or ("§" not in raw and "v" not in raw):
            continue
        line = md.mask_code(raw.rstrip("\r"))
        for m in CITE.finditer(line):
            cites.append({"target": m[1], "cited": m[2], "pin": pin, "verdict": cite_verdict(m[2], versions.get(cite_target(m[1])), pin), "line": n})
        for m in SECTION.finditer(line):
            name = m[1].strip()
            if not name:
                continue
            found, k, ok = resolve_section(name, own)
            row = {"raw": f"§{found if ok else name}"[:200], "target": (found if ok else name)[:200], "section": k if ok else -1, "status": "resolved" if ok else "unresolvable", "line": n}
            owner = "" if ok else owner_before(line, m.start(), others)
            if owner:
                row["target"] = f"{owner} §{name}"[:200]
                names = others.get(cite_target(owner))
                if names is not None:
                    found, k, ok = resolve_section(name, names)
                    if ok:
                        row |= {"status": "resolved", "section": k, "target": f"{owner} §{found}"[:200], "raw": f"§{found}"[:200]}
                    elif k != AMBIGUOUS:
                        row["status"] = "dangling"
            refs.append(row)
    return refs, cites
