"""Operator 8, SentencePiece encoding and decoding for merge-type vocabularies.

Every unit of a text starts as its characters. An agenda holds the adjacent pairs that are pieces, best score
first and the leftmost of equal ones; the pair taken is merged, the pairs with its new neighbours join
the agenda, and entries whose symbols have changed since are passed over. Characters that are no piece
become their bytes. Each document of an Arrow batch is encoded whole by the sentencepiece library too and marked
as agreeing when the ids are the same; its ids are decoded again and compared with the text (a literal mark comes back as a space, so such a text is no round trip).

Defined results: null text gives null ids and counts; an empty text no ids; of pairs with equal scores the leftmost is merged first; very long texts are encoded whole;
rows that repeat are encoded alike; rows without a doc_id are kept with a null id; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable
from .pieces import MARK, MODEL, MOST, UNIT, library, load, normal

NOTHING = -(1 << 40)  #: past the end of a unit
SCHEMA = "doc_id long, n_tokens int, ids array<int>, library_agrees boolean, round_trip boolean"


def plain(data: bytes) -> str:
    """A text of joined pieces."""
    whole = data.decode("utf-8", "replace").replace(MARK, " ")
    return whole[1:] if whole[:1] == " " else whole


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str = MODEL) -> None:
        proto = load(path)
        self.path = path
        self.score = {p.piece: (p.score, i) for i, p in enumerate(proto.pieces) if p.type == p.NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == p.BYTE}
        self.bytes_of = {i: p.piece.encode() for i, p in enumerate(proto.pieces) if p.type == p.NORMAL} | {i: bytes([b]) for b, i in self.byte.items()}
        self.bytes_by_id = pa.array([self.bytes_of.get(i, b"") for i in range(len(proto.pieces))], pa.large_binary())
        self.known: dict[str, bytes] = {}
        self.width = len(proto.pieces)
        self.char_ids = -2 - np.arange(0x110000, dtype=np.int64)  # a character that is no piece
        for p, (_, i) in self.score.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        merges = {}
        for p, (s, i) in self.score.items():
            for k in range(1, len(p)):
                if p[:k] in self.score and p[k:] in self.score:
                    merges[self.score[p[:k]][1] * self.width + self.score[p[k:]][1]] = (s, i)
        self.merge_keys = np.array(sorted(merges) + [2**62], dtype=np.int64)
        self.merge_scores = np.array([merges[k][0] for k in sorted(merges)] + [0.0])
        self.merge_ids = np.array([merges[k][1] for k in sorted(merges)] + [0], dtype=np.int64)

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of one unit, by the agenda."""
        score = self.score
        symbols: list[str | None] = list(unit)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = unit[i : i + 2]
            if pair in score:
                agenda.append((-score[pair][0], i, pair, i + 1))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair, j = heapq.heappop(agenda)
            if symbols[i] is None or symbols[j] is None or right[i] != j or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                both = pair + symbols[k]
                if both in score:
                    heapq.heappush(agenda, (-score[both][0], i, both, k))
            h = left[i]
            if h >= 0:
                both = symbols[h] + pair
                if both in score:
                    heapq.heappush(agenda, (-score[both][0], h, both, i))
        ids = []
        for s in symbols:
            if s is not None:
                if s in score:
                    ids.append(score[s][1])
                else:
                    ids.extend(self.byte[b] for b in s.encode("utf-8", "surrogatepass"))
        return ids

    def decode(self, ids) -> str:
        """The text of ids: pieces and bytes joined, marks as spaces, without the leading one."""
        return plain(b"".join(map(self.bytes_of.__getitem__, ids)))

    def decode_all(self, ids: np.ndarray, ends: list[int]) -> Iterator[str]:
        """The texts of ids that lie one after the other."""
        found = self.bytes_by_id.take(pa.array(ids))
        at = np.frombuffer(found.buffers()[1], dtype=np.int64, count=len(ids) + 1, offset=found.offset * 8)[ends].tolist()
        data = memoryview(found.buffers()[2] or b"")
        for a, b in zip(at, at[1:]):
            yield plain(bytes(data[a:b]))

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of many units at once, as bytes of int32: a row of the matrix is a unit's agenda, and each step takes the best entry of every row."""
        found = [b""] * len(units)
        size = np.array([len(u) for u in units])
        for lo, hi in ((1, 4), (5, 7), (8, 10), (11, 13), (14, 18), (19, 30), (31, 64)):
            rows = np.flatnonzero((size >= lo) & (size <= hi))
            if len(rows):
                for r, ids in zip(rows.tolist(), self._step_all([units[r] for r in rows.tolist()], size[rows])):
                    found[r] = ids
        for r in np.flatnonzero(size > 64).tolist():
            found[r] = np.array(self.encode_unit(units[r]), dtype=np.int32).tobytes()
        return found

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of merges; -inf where two symbols are no piece together."""
        key = a * self.width + b
        at = np.searchsorted(self.merge_keys, key)
        hit = (self.merge_keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.merge_scores[at], -np.inf), self.merge_ids[at]

    def _step_all(self, units: list[str], size: np.ndarray) -> list[bytes]:
        wide = int(size.max())
        chars = np.zeros((len(units), wide), dtype=np.uint32)
        chars[np.arange(wide) < size[:, None]] = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.char_ids[chars]
        symbols[np.arange(wide) >= size[:, None]] = NOTHING
        out = symbols.copy()
        live = np.arange(len(units))
        agenda, into = self._pairs(symbols[:, :-1], symbols[:, 1:]) if wide > 1 else (np.full((len(units), 1), -np.inf), np.zeros((len(units), 1), np.int64))
        column = np.arange(wide)
        while True:
            at = agenda.argmax(axis=1)
            going = np.isfinite(agenda[np.arange(len(live)), at])
            if not going.all():
                out[live[~going]] = symbols[~going]
                live, symbols, agenda, into, at = live[going], symbols[going], agenda[going], into[going], at[going]
            if not len(live):
                break
            r = np.arange(len(live))
            symbols[r, at] = into[r, at]
            source = np.minimum(column + (column > at[:, None]), wide - 1)
            symbols = np.take_along_axis(symbols, source, axis=1)
            symbols[:, -1] = NOTHING
            source = np.minimum(column[: wide - 1] + (column[: wide - 1] > at[:, None]), wide - 2)
            agenda, into = np.take_along_axis(agenda, source, axis=1), np.take_along_axis(into, source, axis=1)
            agenda[:, -1] = -np.inf
            for k in (at - 1, at):
                ok = (k >= 0) & (k < wide - 1)
                score, piece = self._pairs(symbols[r[ok], k[ok]], symbols[r[ok], k[ok] + 1])
                agenda[r[ok], k[ok]], into[r[ok], k[ok]] = score, piece
        inside = out != NOTHING
        data, ends = out[inside].astype(np.int32).tobytes(), np.cumsum(inside.sum(axis=1)) * 4
        found = [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
        for r in np.flatnonzero((inside & (out < 0)).any(axis=1)).tolist():  # characters that are no piece
            flat: list[int] = []
            for i in out[r][inside[r]].tolist():
                flat.extend([i] if i >= 0 else [self.byte[b] for b in chr(-2 - i).encode("utf-8", "surrogatepass")])
            found[r] = np.array(flat, dtype=np.int32).tobytes()
        return found

    def learn(self, units: set[str]) -> None:
        """Works out new units."""
        new = list(units.difference(self.known))
        if len(self.known) + len(new) > MOST:
            self.known = {}
            new = list(units)
        self.known.update(zip(new, self.encode_units(new)))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return [i for unit in UNIT.findall(normal(text)) for i in self.encode_unit(unit)] if text else []


@lru_cache(2)
def codec(path: str) -> Codec:
    """One for each worker and file."""
    return Codec(path)


def _arrow(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sp = codec(path), library(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = batch.column("text").to_pylist()
                cut = [None if t is None else UNIT.findall(normal(t)) if t else [] for t in texts]
                units: set[str] = set()
                for own in cut:
                    units.update(own or ())
                c.learn(units)
                known = c.known.__getitem__
                theirs = sp.encode([t or "" for t in texts], num_threads=1, out_type="numpy")
                flat = [b"".join(map(known, own or ())) for own in cut]
                ends = [0, *np.cumsum([len(data) // 4 for data in flat]).tolist()]
                ids = np.frombuffer(b"".join(flat), dtype=np.int32)
                agrees = [None if text is None else data == other.tobytes() for text, data, other in zip(texts, flat, theirs)]
                back = [None if text is None else decoded == text for text, decoded in zip(texts, c.decode_all(ids, ends))]
                values = pa.array(ids)
                none = pa.array([x is None for x in cut])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=none) if len(cut) else pa.array([], pa.list_(pa.int32()))
                counts = pa.array([None if x is None else n for x, n in zip(cut, np.diff(ends).tolist())], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, lists, pa.array(agrees, pa.bool_()), pa.array(back, pa.bool_())], names=["doc_id", "n_tokens", "ids", "library_agrees", "round_trip"])

    return run


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids, library_agrees, round_trip) for every row of docs."""
    importable(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_arrow(model), SCHEMA)


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text."""
    importable(encoded.sparkSession)

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        c = codec(model)
        return pd.Series([None if x is None else c.decode(x) for x in ids])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), run("ids").alias("text"))
