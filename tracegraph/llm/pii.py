"""Operator 3, personal data and secrets by a skip-chain conditional random field.

Variables are a document's tokens, labels OTHER, EMAIL, IP, PHONE, CARD, ID and SECRET. Node potentials come from
a token's shape and the words before it, chain potentials join neighbouring tokens, and skip potentials join a token
to the next one in the document, however far, that repeats it or has the same digits. Loopy belief
propagation (sum-product, ROUNDS parallel rounds) passes messages over both kinds of edge, so a number named once as an account
or card is labelled the same where it stands alone. A token without a digit or @ is OTHER by the model (its
potential for other labels is zero), but for the value that a password, key or the like is set to; such tokens pass constant messages, so leaving them out of
the graph is exact. Names and addresses of people in words are thus not looked for.

The weights are fitted here, by pseudo-likelihood, on generated labelled token sequences; nothing is taken from the corpus.
Found spans are replaced by their label in brackets.

Defined results: null text stays null with 0 entities; empty text stays empty; null doc_ids stay; rows that repeat are treated
alike; where labels tie the first in LABELS is taken, a half of OTHER counts as OTHER; very long texts are read whole, in time that grows with
their length; other columns are kept by the filter and not read; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, importable

LABELS = ["OTHER", "EMAIL", "IP", "PHONE", "CARD", "ID", "SECRET"]
OTHER, EMAIL, IP, PHONE, CARD, ID, SECRET = range(7)
ROUNDS = 10
MARK = re.compile(r"[0-9@]")
SPACE = re.compile(r"\s|\Z")
#: a value that is set and needs no digit: anything after =, or in quotes, or after the colon of a password
NAMES = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key")
NAMED = re.compile(r"""\b(?:password|passwd|passphrase|secret|token|api[_-]?key)["']?\s?(?:=\s?["']?|:\s?["'])([^\s"',;]{6,})|\b(?:password|passwd|passphrase)["']?\s?:\s?([^\s"',;]{6,})""", re.I)
#: shapes of several tokens that follow each other
RUNS = {
    "card": re.compile(r"(?<![\d-])\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?![\d-])"),
    "iban": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "phone": re.compile(r"(?:\+|\b00)\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,6}|(?<!\d )\b0\d(?:[ .]\d\d){4}\b(?! \d)"),
}
CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.DOTALL)
SHAPES = {
    "email": re.compile(r"[^\s@]+@[\w-]+(?:\.[\w-]+)+", re.I),
    "ip": re.compile(r"(?:\d{1,3}\.){3}\d{1,3}"),
    "ip6": re.compile(r"(?:[0-9a-f]{0,4}:){3,7}[0-9a-f]{1,4}", re.I),
    "hex": re.compile(r"(?=.*\d)[0-9a-f]{20,}", re.I),
    "key": re.compile(r"(?=.*\d)(?=.*[A-Za-z])[A-Za-z0-9_/+-]{20,}"),
    "country": re.compile(r"\+\d{1,3}"),
    "area": re.compile(r"\(\d{2,4}\)"),
    "local": re.compile(r"\d{3}-\d{4}"),
    "phone": re.compile(r"\+?\d{1,3}?[-.]?\(?\d{3}\)?[-.]\d{3}[-.]\d{4}"),
    "iban": re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}"),
    "prefixed": re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_\w{30,}|sk[-_](?:(?:live|test|proj)[-_])?\w{16,}|xox[abprs]-[\w-]{10,}|eyJ[\w-]{10,}\.[\w.-]+"),
    "ssn": re.compile(r"\d{3}-\d{2}-\d{4}"),
    "card": re.compile(r"(?:\d{4}[- ]?){3}\d{4}"),
    "four": re.compile(r"\d{4}"),
    "digits": re.compile(r"\d+"),
    "decimal": re.compile(r"\d+[.,]\d+"),
    "version": re.compile(r"v?\d+(?:\.\d+){1,2}", re.I),
    "date": re.compile(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"),
    "time": re.compile(r"\d{1,2}:\d{2}(?::\d{2})?"),
}
CONTEXT = {
    "secret": {"token", "secret", "password", "passwd", "key", "apikey", "api_key", "auth", "bearer"},
    "phone": {"phone", "tel", "call", "telephone", "mobile", "fax"},
    "card": {"card", "visa", "credit", "mastercard"},
    "id": {"ssn", "passport", "account", "id", "iban", "no", "number"},
    "ip": {"ip", "host", "address", "server"},
    "amount": {"$", "€", "usd", "eur", "page", "year", "version", "section", "chapter", "license", "total", "about"},
}


@lru_cache(1)
def feature_names() -> dict[str, int]:
    names = [f"shape:{s}" for s in SHAPES] + [f"near:{c}" for c in CONTEXT] + [f"digits:{k}" for k in range(18)] + [f"joined:{s}:{c}" for s in ("digits", "key") for c in CONTEXT]
    return {n: k for k, n in enumerate([*names, "bias", "at", "equals", "mixed", "before:country", "before:area", "letters", *(f"run:{r}" for r in RUNS)])}


def _marked(text: str) -> list[tuple[int, int]]:
    """(start, end) of what lies between white space and has a digit or @; each character is looked at a few times at most."""
    found, end = [], 0
    for m in MARK.finditer(text):
        start = m.start()
        if start < end:
            continue
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = SPACE.search(text, m.end()).start()
        found.append((start, end))
    return found


def tokens(text: str) -> list[tuple[int, int, str]]:
    """(start, end, core) of the tokens with a digit or @ and of named values; what surrounds a core is left out of the span."""
    found = []
    for start, end in _marked(text):
        t = text[start:end]
        c = CORE.search(t)
        if not c:
            continue
        a, b = c.span()
        if a and t[a - 1] in "+(":
            a -= 1
        if t[a] == "(" and t[b : b + 1] == ")":
            b += 1
        # a value stuck to its name or to marks of layout: key="value"
        cut = re.split(r"[\"'=|*#&$%<>]+", t[a:b])
        at = a
        for part in cut:
            at = t.index(part, at) if part else at
            if MARK.search(part):
                found.append((start + at, start + at + len(part), part))
            at += len(part)
    lower = text.lower()
    if any(n in lower for n in NAMES):
        taken = {k for a, b, _ in found for k in (a, b)}
        for m in NAMED.finditer(text):
            a, b = m.span(1 if m[1] else 2)
            if not MARK.search(text, a, b) and a not in taken and b not in taken:
                found.append((a, b, text[a:b]))
        found.sort()
    return found


def features(text: str, found: list[tuple[int, int, str]]) -> list[list[int]]:
    """Active features of each token."""
    names = feature_names()
    out, last = [], None
    spans = _runs(text, found)
    for start, end, core in found:
        own = [names["bias"], names[f"digits:{min(17, sum(c.isdigit() for c in core))}"]]
        shapes = [s for s, r in SHAPES.items() if r.fullmatch(core)]
        own += [names[f"shape:{s}"] for s in shapes]
        before = text[max(0, start - 40) : start]
        words = {w.strip(":.,;#\"'()[]").lower() for w in before.replace("=", " = ").split()[-3:]}
        near = [c for c, own_words in CONTEXT.items() if own_words & words]
        own += [names[f"near:{c}"] for c in near]
        own += [names[f"joined:{s}:{c}"] for s in ("digits", "key") if s in shapes for c in near]
        own += [names["at"]] * ("@" in core) + [names["equals"]] * ("=" in words) + [names["mixed"]] * (any(c.isalpha() for c in core))
        own += [names["letters"]] * (not MARK.search(core)) + [names[f"run:{r}"] for r in spans.get(start, ())]
        if last and start - last[1] <= 2:
            own += [names[f"before:{s}"] for s in ("country", "area") if SHAPES[s].fullmatch(last[2])]
        out.append(own)
        last = (start, end, core)
    return out


def _runs(text: str, found: list[tuple[int, int, str]]) -> dict[int, list[str]]:
    """Start of a token to the RUNS that it is part of, where several tokens follow each other."""
    out: dict[int, list[str]] = {}
    k = 0
    while k < len(found):
        m = k
        while m + 1 < len(found) and found[m + 1][0] - found[m][1] <= 2:
            m += 1
        if m > k or RUNS["phone"].match(found[k][2]):
            a = found[k][0]
            run, starts = text[a : found[m][1]], [f[0] - a for f in found[k : m + 1]]
            for name, shape in RUNS.items():
                for x in shape.finditer(run):
                    for start, end, _ in found[k + bisect_left(starts, x.start()) : k + bisect_left(starts, x.end())]:
                        if end - a <= x.end():
                            out.setdefault(start, []).append(name)
        k = m + 1
    return out


def edges(found: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges of tokens next to each other; skip edges to the next repeated or similar token."""
    chain = [(i, i + 1) for i in range(len(found) - 1) if found[i + 1][0] - found[i][1] <= 2]
    skip, same, alike = [], {}, {}
    for i, (_, _, core) in enumerate(found):
        key, digits = core.lower(), "".join(c for c in core if c.isdigit())
        if key in same:
            skip.append((same[key], i))
        elif len(digits) >= 6 and digits in alike:
            skip.append((alike[digits], i))
        same[key] = i
        if len(digits) >= 6:
            alike[digits] = i
    return chain, skip


def generated(n: int = 2500, seed: int = 11) -> list[tuple[str, dict[int, int]]]:
    """Texts with the label of each token by its start."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeioulnrstm") for _ in range(r.randint(2, 9)))
    ip = lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))
    hexes = lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 40, 64])))
    key = lambda: "".join(r.choice("abcdefghijkABCDEFGHIJK0123456789") for _ in range(r.randint(20, 40)))
    out = []
    for _ in range(n):
        text, regions, kept = "", [], []

        def put(token: str, label: int) -> None:
            nonlocal text
            start = len(text)
            text += token + " "
            regions.append((start, len(text), label))

        for _ in range(r.randint(2, 9)):
            for _ in range(r.randint(1, 5)):
                text += word() + " "
            k = r.randint(0, 19)
            if k == 0 or k == 1:
                put(r.choice([f"{word()}.{d(2)}@mail{d(1)}.example.com", f"{word()}@{word()}.org", f"{word()}_{d(1)}@{word()}.co"]), EMAIL)
            elif k == 2 or k == 3:
                put(ip(), IP)
            elif k == 4 or k == 5:
                text += r.choice(["", "", "call ", "phone: "])
                for part in r.choice([["+49", d(r.randint(2, 4)), d(r.randint(5, 8))], [f"+{d(2)}", d(1), d(2), d(2), d(2), d(2)], [f"00{d(2)}", d(2), d(3), d(4)], ["0" + d(1), d(2), d(2), d(2), d(2)], ["+1", f"({d(3)})", f"{d(3)}-{d(4)}"], [f"+{d(2)}", d(3), f"{d(3)}-{d(4)}"], [f"{d(3)}-{d(3)}-{d(4)}"], [f"({d(3)})", f"{d(3)}-{d(4)}"]]):
                    put(part, PHONE)
            elif k == 6 or k == 7:
                text += r.choice(["", "", "card ", "visa "])
                c = r.choice([d(16), d(16), "-".join(d(4) for _ in range(4)), None])
                if c:
                    kept.append((c, CARD))
                    put(c, CARD)
                else:
                    for _ in range(4):
                        put(d(4), CARD)
            elif k == 8 or k == 9:
                text += r.choice(["", "ssn ", "passport ", "account "])
                c = r.choice([d(9), d(9), f"{d(3)}-{d(2)}-{d(4)}", f"{word()[:2].upper()}{d(20)}", None])
                if c:
                    kept.append((c, ID))
                    put(c, ID)
                else:
                    for part in [f"{word()[:2].upper()}{d(2)}", *(d(4) for _ in range(4)), d(2)]:
                        put(part, ID)
            elif k == 10 or k == 11:
                text += r.choice(["token = ", "secret = ", "key: ", "password = ", ""])
                put(r.choice([f'"{hexes()}"', hexes(), f'"{key()}"', "AKIA" + "".join(r.choice("ABCDEFGH234567") for _ in range(16)), "ghp_" + key() + key()]), SECRET)
            elif k == 14:
                text += r.choice(["password = ", "password: ", "secret = ", "token = "])
                put(r.choice([word() + word(), (word() + word()).title() + "!", f'"{word()}{word()}{d(2)}"', word() + d(4)]).rjust(6, "x"), SECRET)
            elif k == 12 and kept:
                put(*r.choice(kept))
            elif k == 13:
                text += "account "
                c = d(r.randint(6, 12))
                kept.append((c, ID))
                put(c, ID)
            elif k == 15:  # years, rows of numbers
                for _ in range(r.choice([2, 3, 5, 6])):
                    put(r.choice(["19", "20"]) + d(2) if r.random() < 0.5 else d(r.randint(1, 4)), OTHER)
                text += word() + " "
            else:
                put(r.choice([d(1), d(2), d(3), d(4), d(5), d(6), "20" + d(2), f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.", f"${d(2)}.{d(2)}", f"{d(2)}%", f"v{d(1)}.{d(1)}.{d(1)}", f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)}", f"1{d(1)}:{r.randint(10, 59)}", f"{word()}{d(2)}", f"{d(2)}th", f"{d(1)},{d(3)}", f"@{word()}", f"{d(3)}.{d(2)}", d(8)]), OTHER)
        out.append((text, {a: next((label for lo, hi, label in regions if lo <= a < hi), OTHER) for a, _, _ in tokens(text)}))
    return out


class Crf:
    """Weights of nodes, chain and skip edges."""

    def __init__(self, node: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        self.node, self.chain, self.skip = node, chain, skip

    def marginals(self, active: list[list[int]], chain: list[tuple[int, int]], skip: list[tuple[int, int]]) -> np.ndarray:
        """Beliefs of all tokens after ROUNDS rounds of messages over both kinds of edge."""
        n = len(active)
        phi = self.scores(active)
        pairs = np.array(chain + skip, dtype=np.int64).reshape(-1, 2)
        if len(pairs):
            source, target = np.r_[pairs[:, 0], pairs[:, 1]], np.r_[pairs[:, 1], pairs[:, 0]]
            back = np.r_[np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))]
            psi = np.concatenate([np.repeat(w[None], k, 0) for w, k in ((self.chain, len(chain)), (self.skip, len(skip)), (self.chain.T, len(chain)), (self.skip.T, len(skip)))])
            message = np.zeros((len(source), len(LABELS)))
            for _ in range(ROUNDS):
                belief = phi.copy()
                np.add.at(belief, target, message)
                x = (belief[source] - message[back])[:, :, None] + psi
                top = x.max(axis=1)
                message = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
                message -= message.max(axis=1, keepdims=True)
            np.add.at(phi, target, message)
        phi -= phi.max(axis=1, keepdims=True)
        p = np.exp(phi)
        return p / p.sum(axis=1, keepdims=True) if n else p

    def scores(self, active: list[list[int]]) -> np.ndarray:
        flat = np.fromiter((f for own in active for f in own), dtype=np.int64)
        at = np.repeat(np.arange(len(active)), [len(own) for own in active])
        phi = np.zeros((len(active), len(LABELS)))
        np.add.at(phi, at, self.node[flat])
        return phi


@lru_cache(1)
def model() -> Crf:
    """Fitted on generated sequences by pseudo-likelihood (each token given its neighbours' labels), AdaGrad, L2."""
    k = len(LABELS)
    active, truth, chain, skip = [], [], [], []
    for text, labels in generated():
        found = tokens(text)
        c, s = edges(found)
        chain += [(a + len(truth), b + len(truth)) for a, b in c]
        skip += [(a + len(truth), b + len(truth)) for a, b in s]
        active += features(text, found)
        truth += [labels[a] for a, _, _ in found]
    y = np.array(truth)
    chain, skip = np.array(chain), np.array(skip)
    flat = np.array([f for own in active for f in own])
    at = np.repeat(np.arange(len(y)), [len(own) for own in active])
    one = np.eye(k)[y]
    params = [np.zeros((len(feature_names()), k)), np.zeros((k, k)), np.zeros((k, k))]
    seen = [np.full_like(p, 1e-6) for p in params]
    for _ in range(250):
        node, c, s = params
        z = np.zeros((len(y), k))
        np.add.at(z, at, node[flat])
        for e, w in ((chain, c), (skip, s)):
            np.add.at(z, e[:, 0], w[:, y[e[:, 1]]].T)
            np.add.at(z, e[:, 1], w[y[e[:, 0]]])
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        g = one - p
        grads = [np.zeros_like(node), np.zeros_like(c), np.zeros_like(s)]
        np.add.at(grads[0], flat, g[at])
        for e, to in ((chain, grads[1]), (skip, grads[2])):
            np.add.at(to.T, y[e[:, 1]], g[e[:, 0]])
            np.add.at(to, y[e[:, 0]], g[e[:, 1]])
        for q, grad, n in zip(params, grads, seen):
            grad = grad / len(y) - 1e-4 * q
            n += grad * grad
            q += 0.3 * grad / np.sqrt(n)
    return Crf(*params)


def find(texts: list[str], crf: Crf) -> list[list[tuple[int, int, str]]]:
    """(start, end, label) of each text; neighbouring parts of one phone number are one span."""
    every, active, chain, skip = [], [], [], []
    for text in texts:
        found = tokens(text)
        c, s = edges(found)
        n = len(active)
        chain += [(a + n, b + n) for a, b in c]
        skip += [(a + n, b + n) for a, b in s]
        active += features(text, found)
        every.append(found)
    p = crf.marginals(active, chain, skip)
    label = np.where(p[:, OTHER] < 0.5, p[:, 1:].argmax(axis=1) + 1, OTHER).tolist() if len(active) else []
    out, n = [], 0
    for found in every:
        spans: list[tuple[int, int, str]] = []
        for (a, b, _), k in zip(found, label[n : n + len(found)]):
            if k == OTHER:
                continue
            if spans and spans[-1][2] == LABELS[k] == "PHONE" and a - spans[-1][1] <= 2:
                spans[-1] = (spans[-1][0], b, LABELS[k])
            else:
                spans.append((a, b, LABELS[k]))
        n += len(found)
        out.append(spans)
    return out


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its label."""
    parts, at = [], 0
    for a, b, label in spans:
        parts += [text[at:a], f"[{label}]"]
        at = b
    return "".join([*parts, text[at:]])


def _redactor(crf: Crf):
    @F.pandas_udf("text string, n_entities int, entities string")
    def run(texts: pd.Series) -> pd.DataFrame:
        some = [k for k, t in enumerate(texts) if t is not None]
        out: list[tuple] = [(None, 0, None)] * len(texts)
        for at in range(0, len(some), 200):
            part = some[at : at + 200]
            for k, spans in zip(part, find([texts.iloc[i] for i in part], crf)):
                out[k] = (masked(texts.iloc[k], spans), len(spans), ",".join(f"{a}-{b}:{label}" for a, b, label in spans))
        return pd.DataFrame(out, columns=["text", "n_entities", "entities"])

    return run


def _redacted(docs: DataFrame, name: str) -> DataFrame:
    """docs with a struct; only texts with a digit, an @ or the name of a secret go to Python, for others it is null."""
    importable(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.withColumn(name, _redactor(model())(F.when(text.rlike("[0-9@]") | F.lower(text).rlike("passw|passphrase|secret|token|api[_-]?key"), text)))


def redact(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_entities, entities): masked text, and where and what was found."""
    own = _redacted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "found")
    return own.select("doc_id", F.coalesce("found.text", F.col("text").cast("string")).alias("text"), F.coalesce("found.n_entities", F.lit(0)).alias("n_entities"), F.coalesce("found.entities", F.lit("")).alias("entities"))


def mask_documents(docs: DataFrame) -> DataFrame:
    """docs with masked text; n_chars, where there is one, is that of the new text. All other columns stay."""
    name = fresh(docs, "found_entities")
    out = _redacted(docs, name)
    text = F.coalesce(F.col(name)["text"], F.col("text"))
    changed = F.coalesce(F.col(name)["n_entities"], F.lit(0)) > 0
    columns = [text.alias(c) if c == "text" else F.when(changed, F.length(text)).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns)
