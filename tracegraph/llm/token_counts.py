"""Operator 10, token counts under a unigram vocabulary, without the tokens.

The vocabulary is that of the piece file, each piece with its score, read as a unigram language model (none of the public
files is of that kind; the pieces that the file never merges to get the lowest score). An Aho-Corasick automaton
finds every piece in a unit; going through the ends of matches in order, the best score of each prefix and the number
of pieces on its path are carried, nothing else. Ties follow the tokenizer's rule: of paths of equal score to the same
place the one whose last piece is longest stays, as a later one must be strictly better. A character that is no
piece costs the lowest score less 10 and counts as its bytes.

Scores are whole numbers, so sums are exact. The library adds in 32-bit floats over a whole text, which is exact up to 2**24;
this operator is exact in each unit whatever the length of the text.

Defined results: null text counts null, an empty one 0; rows that repeat count alike; rows without a
doc_id keep a null id; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import importable
from .pieces import MODEL, MOST, UNIT, load, normal

UNKNOWN = 10.0


def unigram_scores(path: str) -> dict[str, float]:
    """Piece to score."""
    normals = [(p.piece, p.score) for p in load(path).pieces if p.type == p.NORMAL]
    least = min(s for _, s in normals if s > -1e8)
    return {p: s if s > -1e8 else least - 1 for p, s in normals}


def unigram_library(path: str = MODEL) -> sentencepiece.SentencePieceProcessor:
    """The sentencepiece library's own unigram tokenizer over the same pieces and scores."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.CopyFrom(load(path))
    scores = unigram_scores(path)
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    for p in proto.pieces:
        if p.type == p.NORMAL:
            p.score = scores[p.piece]
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


class Counter:
    """Counts of one vocabulary file."""

    def __init__(self, path: str = MODEL) -> None:
        scores = unigram_scores(path)
        self.unknown = min(scores.values()) - UNKNOWN
        self.pieces = scores
        self.automaton = ahocorasick.Automaton()
        for p, s in scores.items():
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.known: dict[str, int] = {}

    def count_unit(self, unit: str) -> int:
        """Pieces on the best path through a unit."""
        n = len(unit)
        best, count = [None] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        done = 0  # prefixes up to here are final but for the unknown character that ends at the next one
        for last, (length, score) in self.automaton.iter(unit):
            end = last + 1
            while done + 1 < end:
                done += 1
                self._unknown(unit, best, count, done)
            start = end - length
            if start > done:
                done = start
                self._unknown(unit, best, count, done)
            s = best[start] + score
            if best[end] is None or s > best[end]:
                best[end], count[end] = s, count[start] + 1
        while done < n:
            done += 1
            self._unknown(unit, best, count, done)
        return count[n]

    def _unknown(self, unit: str, best: list, count: list, end: int) -> None:
        """The path over the single character before end, where that is no piece."""
        c = unit[end - 1]
        if c not in self.pieces:
            s = best[end - 1] + self.unknown
            if best[end] is None or s > best[end]:
                best[end], count[end] = s, count[end - 1] + len(c.encode("utf-8", "surrogatepass"))

    def learn(self, units: set[str]) -> None:
        """Counts new units."""
        new = units.difference(self.known)
        if len(self.known) + len(new) > MOST:
            self.known, new = {}, units
        for u in new:
            self.known[u] = self.count_unit(u)

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        return sum(map(self.count_unit, UNIT.findall(normal(text)))) if text else 0


@lru_cache(2)
def counter(path: str) -> Counter:
    """One for each worker and file."""
    return Counter(path)


def _arrow(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                cut = [None if t is None else UNIT.findall(normal(t)) if t else [] for t in batch.column("text").to_pylist()]
                units: set[str] = set()
                for own in cut:
                    units.update(own or ())
                c.learn(units)
                known = c.known.__getitem__
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if x is None else sum(map(known, x)) for x in cut], pa.int64())], names=["doc_id", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens) for every row of docs."""
    importable(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_arrow(model), "doc_id long, n_tokens long")
