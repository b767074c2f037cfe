"""Stateful readers of semi-structured documents: frontmatter, sections, tables, cells, ledgers.

Plain functions of a string, so they can be tested alone; columns.py makes Arrow-batched functions of them. None of
them loses text silently: what is dropped comes back as a note.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

NULLS = {"[]", "None", "none", "null", ""}
FENCE = re.compile(r"\s*(?:`{3}|~{3})")
BLOCK = re.compile(r"-{3}[^\S\n]*\n(?P<block>.*?)\n-{3}[^\S\n]*\n", re.S)
LINE = re.compile(r"[^\n]*\n|[^\n]+$")
HEADING = re.compile(r"(#{2,6})[ \t]+(.*)$")
ID = r"BC-\d+(?:\.\d+){2}"  #: contract ids


def fence(line: str) -> bool:
    """Does a line open or close a fence?"""
    return ("```" in line or "~~~" in line) and FENCE.match(line) is not None


@dataclass
class Frontmatter:
    """Keys to a string or a list; notes are (key, kind, lost characters)."""

    values: dict[str, str | list[str]] = field(default_factory=dict)
    body: str = ""
    notes: list[tuple[str, str, int]] = field(default_factory=list)

    def many(self, key: str) -> list[str]:
        """The value as a list; null spellings are empty."""
        v = self.values.get(key)
        if isinstance(v, list):
            return [x for x in v if x.strip()]
        return [] if v is None or v.strip() in NULLS else [v.strip()]

    def one(self, key: str) -> str:
        """The value as a scalar; a list counts only if it has one item."""
        v = self.values.get(key)
        if isinstance(v, list):
            return v[0].strip() if len(v) == 1 else ""
        return "" if v is None or v.strip() in NULLS else v.strip()


def _end_of_quote(v: str) -> int:
    """Where a value's opening quote closes, or 0."""
    q, i = v[0], 1
    while i < len(v):
        if q == '"' and v[i] == "\\":
            i += 1
        elif v[i] == q:
            if q == "'" and v[i + 1 : i + 2] == "'":
                i += 1
            else:
                return i
        i += 1
    return 0


def scalar_and_comment(v: str) -> tuple[str, str, int]:
    """(value, note, characters lost) with a trailing comment taken off; a # inside quotes is text."""
    if v[:1] in ('"', "'") and v:
        end = _end_of_quote(v)
        return (v[1:end], "", 0) if end else (v.lstrip(v[0]), "unterminated-quote", 0)
    bare = re.split(r"\s+#", v, maxsplit=1)[0].strip()
    return (bare, "comment-stripped-from-unquoted", len(v) - len(bare)) if bare != v else (v, "", 0)


def _open_brackets(s: str) -> bool:
    return s.count("[") > s.count("]")


def frontmatter(text: str) -> Frontmatter:
    """Reads the block between --- lines: scalars, inline lists that may wrap, block lists. Nested maps are skipped."""
    m = BLOCK.match(text)
    if not m:
        return Frontmatter(body=text)
    found = Frontmatter(body=text[m.end() :])
    lines: list[str] = []
    wrapping = False
    for raw in (x.rstrip("\r") for x in m["block"].split("\n")):
        if wrapping:
            lines[-1] += " " + raw.strip()
        else:
            lines.append(raw)
        starts = wrapping or re.match(r"[^\s#:][^:\n]*:[ \t]*\[", raw)
        wrapping = bool(starts) and _open_brackets(lines[-1])
    key = ""
    for raw in lines:
        s = raw.strip()
        if not s or s[0] == "#":
            continue
        if re.match(r"\s+-\s", raw):
            if key:
                held = found.values.setdefault(key, [])
                if isinstance(held, list):
                    held.append(s[1:].strip().strip("\"'"))
            continue
        if raw[0] in " \t" or ":" not in raw:
            continue
        name, _, v = raw.partition(":")
        key, v = name.strip(), v.strip()
        if v[:1] == "[":
            v = re.split(r"\s+#", v, maxsplit=1)[0].strip()
            if v[-1] == "]":
                found.values[key] = [x for x in (p.strip().strip("\"'") for p in v[1:-1].split(",")) if x]
                continue
        else:
            v, note, lost = scalar_and_comment(v)
            if note:
                found.notes.append((key, note, lost))
        found.values[key] = v.strip("\"'") if v else []
    return found


def first_heading(body: str) -> str:
    """Text of the first top heading."""
    m = re.search(r"^# (.*)$", body, re.M)
    return m[1].strip() if m else ""


def sections(body: str) -> list[tuple[int, int, str, str]]:
    """(ord, depth, heading, body): a partition of the text at headings of depth 2 to 6 outside fences; joined bodies are the text."""
    out: list[tuple[int, str, list[str]]] = []
    inside = False
    for line in LINE.findall(body):
        if fence(line):
            inside = not inside
        elif not inside and line.startswith("##") and (m := HEADING.match(line.rstrip("\r\n"))):
            out.append((len(m[1]), m[2].strip(), []))
        if not out:
            out.append((0, "", []))
        out[-1][2].append(line)
    return [(k, depth, heading, "".join(own)) for k, (depth, heading, own) in enumerate(out)]


def split_cells(row: str) -> list[str]:
    """Cells of a table row; a backslash takes the next character as it is."""
    s = row.strip().removeprefix("|").removesuffix("|")
    cells = [""]
    for m in re.finditer(r"\\(.)|(\|)|(.)", s, re.S):
        if m[2]:
            cells.append("")
        else:
            cells[-1] += m[1] or m[3]
    return [c.strip() for c in cells]


def _rule_row(cells: list[str]) -> bool:
    some = [c for c in cells if c]
    return bool(some) and all(re.fullmatch(r":?-+:?", c) for c in some)


def tables(body: str) -> list[dict]:
    """Tables outside fences: heading, header, line and rows (cells, line). The row after a header is the rule row if it looks like one."""
    out: list[dict] = []
    heading, inside, current, ruled = "", False, None, False
    for n, raw in enumerate(body.split("\n"), 1):
        if FENCE.match(raw):
            inside, current = not inside, None
            continue
        if inside:
            continue
        if m := re.match(r"#{1,6}\s+(.*)$", raw.rstrip("\r")):
            heading, current = m[1].strip(), None
            continue
        s = raw.strip()
        if len(s) < 2 or s[0] != "|" or s[-1] != "|":
            current = None
            continue
        cells = split_cells(s)
        if current is None:
            current, ruled = {"heading": heading, "header": cells, "line": n, "rows": []}, False
            out.append(current)
        elif not ruled and _rule_row(cells):
            ruled = True
        else:
            ruled = True
            current["rows"].append((cells, n))
    return out


def column_index(table: dict, name: str) -> int:
    """Place of a column by normalised name, -1 without it."""
    names = [normal_cell(h) for h in table["header"]]
    return names.index(normal_cell(name)) if normal_cell(name) in names else -1


def cell(row: list[str], k: int) -> str:
    return row[k] if 0 <= k < len(row) else ""


def normal_cell(s: str) -> str:
    """Without links, emphasis, strikes and code marks; white space collapsed."""
    s = re.sub(r"\[([^\[\]]*)\]\([^()]*\)", r"\1", s)
    return " ".join(re.sub(r"\*\*|~~|`", "", s).split())


def struck(s: str) -> bool:
    return "~~" in s


def without_id(title: str) -> str:
    """A title without the id in front of it."""
    kinds = r"(?:Behavioral Contract|Verification Property|Story)\s+"
    ids = rf"(?:{ID}|(?:VP|E)-\d+|S-\d+\.\d+[a-zA-Z0-9.-]*)"
    return re.sub(rf"^\s*(?:{kinds})?{ids}\s*[:—-]\s*", "", title, flags=re.A).strip()


def annotation(s: str) -> tuple[str, str]:
    """(value, what follows it in brackets)."""
    m = re.match(r"([^(\[]+?)[ \t]*[(\[].*[)\]][ \t]*$", s)
    return (m[1].strip(), s[m.end(1) :].strip()) if m else (s, "")


def leading_int(s: str) -> int | None:
    """The number a cell starts with, thousands separated or not; None is not 0."""
    m = re.match(r"[\d,]*\d[\d,]*", normal_cell(s))
    return int(m[0].replace(",", "")) if m else None


PLACEHOLDERS = frozenset(["", "-", "--", "---", "—", "–", "tbd", "n/a", "na", "none", "null", "cap-tbd"])


def placeholder(s: str) -> bool:
    return s.strip().lower() in PLACEHOLDERS


def split_list(s: str) -> list[str]:
    """Members of a list in a cell, placeholders left out."""
    return [p for p in (x.strip() for x in re.split(r"[,;\n]", normal_cell(s))) if not placeholder(p)]


def bracket_list(s: str) -> tuple[list[str], str] | None:
    """(members, what follows) of a list in brackets."""
    m = re.match(r"\[([^\[\]]*)\]\s*(.*)$", normal_cell(s))
    return (split_list(m[1]), m[2].strip()) if m else None


REFERENCE = re.compile(rf"{ID}|(?:VP|SS|DI|E|CAP)-\d+|S-\d+\.\d+[a-zA-Z0-9.-]*")


def ids_in(members: list[str]) -> list[str]:
    return [m for m in members if REFERENCE.fullmatch(m)]


def not_ids_in(members: list[str]) -> list[str]:
    return [m for m in members if not REFERENCE.fullmatch(m)]


def plain_id_list(s: str) -> list[str] | None:
    """Members of a list without brackets, if all of them are ids; a last parenthesis is left out."""
    members = split_list(re.sub(r"\s*[(][^()]*[)]\s*$", "", normal_cell(s)))
    return members if members and not not_ids_in(members) else None


def _compare_count(authored: str, derived: str) -> str | None:
    held = sorted(split_list(derived))
    listed = bracket_list(authored)
    if listed:
        if not_ids_in(listed[0]):
            return "prose-in-set"
        return "agree-set" if sorted(listed[0]) == held else "disagree"
    members = plain_id_list(authored)
    if members is not None:
        return "agree-set" if sorted(members) == held else "disagree"
    n = leading_int(authored)
    return None if n is None else "agree" if n == len(held) else "disagree"


def compare_cell(kind: str, authored: str, derived: str) -> str:
    """Outcome of an index cell against the record; kind is title, enum, id, set, count, count-or-set or text.

    Counts come before emptiness, so that a stated 0 agrees with an empty set.
    """
    a, d = normal_cell(authored), normal_cell(derived)
    if kind == "title":
        a, d = without_id(a), without_id(d)
    elif kind == "enum":
        a = annotation(a)[0]
    elif kind in ("count", "count-or-set") and (found := _compare_count(a, d)):
        return found
    if a == d:
        return "agree"
    if a.casefold() == d.casefold():
        return "agree-casefold"
    if placeholder(a) or placeholder(d):
        return "agree" if placeholder(a) and placeholder(d) else "index-placeholder" if placeholder(a) else "store-empty"
    if kind == "set":
        members = split_list(a)
        if not_ids_in(members):
            return "prose-in-set"
        return "agree-set" if sorted(members) == sorted(split_list(d)) else "disagree"
    if kind == "title":
        if d.lower().startswith(a.lower()):
            return "title-abbreviates"
        if a.lower().startswith(d.lower()):
            return "title-elaborates"
    return "disagree"


def mask_code(s: str) -> str:
    """Code spans and their marks as spaces; the length stays."""
    parts = s.split("`")
    return " ".join(" " * len(x) if k % 2 else x for k, x in enumerate(parts)) if len(parts) > 1 else s


PRIOR = "[Prior:"
LEDGERS = {"last_amended", "delta", "modified"}


def ledger_like(name: str, v: str) -> bool:
    """Does a field hold entries in a row? By the separator, or, for the fields known for it, by two dates."""
    return PRIOR in v or (name in LEDGERS and len(re.findall(r"\d{4}-\d\d-\d\d\s*\(", v)) > 1)


def split_ledger(v: str) -> list[tuple[int, str, str, str]]:
    """(ord, entry, version, date); entries joined by the separator are the value again."""
    out = []
    for k, entry in enumerate(v.split(PRIOR)):
        m = re.match(r"\s*(\d{4}-\d\d-\d\d)?\s*(?:[(]\s*(v[.\d]+[^\s)]*)\s*[)])?", entry)
        out.append((k, entry, m[2] or "", m[1] or ""))
    return out


def join_ledger(entries: list[tuple[int, str, str, str]]) -> str:
    return PRIOR.join(e[1] for e in entries)


def ledger_imbalance(v: str) -> tuple[int, int]:
    """Separators opened and brackets closed."""
    return v.count(PRIOR), v.count("]")


def version_less(a: str, b: str) -> bool:
    """Numeric order of major.minor."""
    p, q = (re.fullmatch(r"(\d+)\.(\d+)", x) for x in (a, b))
    return bool(p and q) and (int(p[1]), int(p[2])) < (int(q[1]), int(q[2]))


def cut_last(s: str, sep: str) -> tuple[str, str, bool]:
    """What is before and after the last separator."""
    head, found, tail = s.rpartition(sep)
    return (head, tail, True) if found else (s, "", False)


def commas(s: str) -> int:
    """A whole number with thousands separators, 0 where it isn't one."""
    digits = s.replace(",", "").strip()
    return int(digits) if re.fullmatch(r"[+-]?\d+", digits) else 0
