"""What operators 8 and 10 share: the vocabulary file and the units that no piece crosses.

The vocabulary's white-space mark only begins a piece, so no merge and no best path joins what lies on
both sides of a boundary before a mark; nor does any piece hold a line feed. A text is thus cut into units
(a run of marks and the word after it, or a line feed), each unit is worked out once and kept in a table of the worker
that is emptied when it holds MOST units. The table only saves time; it never changes a result.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import sentencepiece
from sentencepiece import sentencepiece_model_pb2

MODEL = os.environ.get("TRACEGRAPH_TOKENIZERS", "/opt/tokenizers") + "/piece_bpe_32k.model"  #: the default path; a parameter everywhere
MARK = "▁"
MOST = 700_000  #: units that a worker keeps
UNIT = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


def normal(text: str) -> str:
    """Spaces as marks, with one in front (the file's normaliser is the identity)."""
    return MARK + text.replace(" ", MARK)


@lru_cache(4)
def load(path: str) -> sentencepiece_model_pb2.ModelProto:
    """The vocabulary file; refused where its pieces or rules don't fit the cut into units."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces and proto.trainer_spec.byte_fallback):
        raise ValueError(f"{path}: only identity normalisation with a leading mark and byte fallback is covered")
    if any(p.type == p.NORMAL and (MARK in p.piece.lstrip(MARK) or "\n" in p.piece) for p in proto.pieces):
        raise ValueError(f"{path}: a piece crosses units")
    return proto


@lru_cache(4)
def library(path: str) -> sentencepiece.SentencePieceProcessor:
    """The library over the file as it is."""
    return sentencepiece.SentencePieceProcessor(model_file=path)


def by_library(sp: sentencepiece.SentencePieceProcessor, units: list[str]) -> list[list[int]]:
    """The library's ids of each unit; what it puts in front is taken off again."""
    plain = [u[1:].replace(MARK, " ") if u[0] == MARK else "\n" + u.replace(MARK, " ") for u in units]
    return [ids if u[0] == MARK else ids[2:] for u, ids in zip(units, sp.encode(plain, num_threads=1))]
