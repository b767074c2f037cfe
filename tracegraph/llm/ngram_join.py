"""Operator 4, n-gram Jaccard join, and the removal of all but one document of each group.

Documents are rows and word n-grams columns of a sparse 0/1 matrix A; the Jaccard similarity of two
documents follows from the entry of A·Aᵀ (the overlap) and the two row sizes. The product is taken
in blocks of columns:

1. One pass finds each document's set of n-gram hashes, its size and a signature of the whole set,
   and counts n-grams in buckets, as many as the text asks for up to 2**MOST_BITS. Documents of one signature and
   size are one row of A from here on, so copies, however many, cost no more than one in each partition.
2. Columns are ordered by bucket count, rare ones first (any order that is the same for all rows is
   right; this one leaves passages that many documents share to the end). A row of n columns keeps
   its first n - ceil(t·n) + 1: two rows of similarity t or more have one of them in common.
   These entries go, packed, to the block of their column, where the product's counts accumulate; they leave it as
   partial counts whenever PAIRS_AT_ONCE are held. A column of more than HOT rows is cut into tiles of rows, and each pair of tiles is a column of its own.
3. A pair of these sizes needs an overlap of o = ceil(t/(1+t)·(n_a+n_b)). Of each row only the first n - o + k columns count for it, k being
   o - max(ceil(t·n_a), ceil(t·n_b)) + 1 (then they are among those kept) but FEW at most. Beyond them o - k entries can be in common,
   so with counts summed over blocks a pair of less than k is dropped. Without this, rows that meet by chance, most of all those of
   about twice the size, would be checked in numbers that grow by the square of the table.
4. The pairs left are counted over all columns. Rows that belong together are put in blocks
   of about BLOCK_GRAMS entries, and each pair of blocks that holds a pair to check gets its texts once.

A large group of near copies has links by the square of its rows, each over hundreds of columns. Rows that share min-hash keys with LARGE others are
therefore placed together first. Pairs within a place are left out of steps 2 to 4 and all compared, tile by tile, in products of dense matrices; every other pair
takes the steps, so where rows are placed changes only the time.

A pair of blocks gives each row's links and a forest of what it connects, not its pairs, so the result has a row for each document whatever the
groups' sizes; similar_sets gives the pairs of different sets. No partner, candidate or column is capped. Hashes have 64 bits; until step 4, 32 bits of a column and of a signature are
compared, and rows of one tile meet once for each of its pairs: all can only count too much, which step 4 puts right.

Defined results: rows without a doc_id are left out; texts that are null or have no word are a class of their own with no links; a
text of fewer than n words has one n-gram, all its words; of rows that repeat a doc_id the one with the
smallest text counts; a pair exactly at the threshold counts; very long texts count whole; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import codes, connected, documents_by_id, forest, fresh, give_back, importable, letters_or_digits, mix, settle, trimmed

N = 3  #: words of an n-gram
THRESHOLD = 0.5  #: least similarity of a pair; a changed word costs three trigrams, so an edited copy of a short text is well under 0.7
LEAST_BITS, MOST_BITS = 20, 24  #: of the number of counters for the order of columns; 2**24 of them are broadcast in 64 MB
BYTES_PER_COUNTER = 512  #: of text
PIECES = 64  #: rows that carry the counters of a partition
ENTRIES_PER_BLOCK = 2_000_000  #: kept entries of A in a block of columns, about; in more blocks a pair is counted in more parts
ENTRIES_AT_ONCE = 400_000  #: that a task holds before it packs them
HOT = 10_000  #: rows of a column in a tile
BLOCK_GRAMS = 100_000  #: entries of A in a block of rows while pairs are checked, about
LARGE = 100  #: rows that share a key, from which they are placed together
BANDS, BAND = 8, 3  #: keys of a row, and min-hashes in each
MOST_PLACED = 2_000_000  #: rows whose places are broadcast (40 MB), those of the largest groups; the others take the general way
TILE_ROWS, TILE_GRAMS = 2_000, 1_000_000  #: of a place, in a tile
FEW = 8  #: columns that a pair must at most have in common to be checked; more let fewer pairs through, but of more that meet
DENSE = 64  #: a column is multiplied densely where at least one in so many pairs of a tile's rows meets in it
PAIRS_AT_ONCE = 1_000_000  #: of one block of columns held before they are added up or passed on


@lru_cache(1)
def _weights() -> np.ndarray:
    return mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))


_POWERS: list[np.ndarray] = []
_BASE = 0x5851F42D4C957F2D


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            made = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                made.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def ngram_hashes(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; words are runs of letters and digits in lower case."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    a = codes(text.lower())
    inside = np.zeros(len(a) + 2, dtype=np.int8)
    inside[1:-1] = letters_or_digits()[a]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        p, inverse = _powers(len(a))
        sums = np.zeros(len(a) + 1, dtype=np.uint64)
        np.cumsum(_weights()[a] * p[: len(a)], out=sums[1:])
        words = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        width = min(n, len(words))
        grams = np.zeros(len(words) - width + 1, dtype=np.uint64)
        for k in range(width):
            grams += words[k : len(words) - width + 1 + k] * np.uint64((2 * k + 3) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 | 1)
        return np.unique(mix(grams + np.uint64(width)))


def _signature(grams: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        s = mix(np.array([grams.sum(dtype=np.uint64) + np.uint64(len(grams)) ^ (mix(grams).sum(dtype=np.uint64) << np.uint64(1))]))
    return int(s.view(np.int64)[0])


def _keys(grams: np.ndarray) -> np.ndarray:
    """Keys of a set, each of BAND min-hashes: of the first hashes from evenly spaced points on, in a circle."""
    points = (np.arange(BANDS * BAND, dtype=np.uint64) * np.uint64((1 << 64) // (BANDS * BAND))).reshape(BANDS, BAND)
    mins = grams[np.searchsorted(grams, points) % len(grams)]
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND):
        keys = mix(keys ^ mins[:, k])
    return keys.view(np.int64)


def _prefix(n: int, t: float) -> int:
    return n - math.ceil(t * n - 1e-9) + 1


def one_text_each(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with ids that repeat cut to their smallest text; costs a shuffle only if some do."""
    own = documents_by_id(docs)
    repeated = own.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return own
    again = own.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return own.join(repeated, "doc_id", "left_anti").unionByName(again)


def _encoded(counts: np.ndarray) -> bytes:
    """A byte for each count, then (place, rest) of those over 255."""
    over = np.flatnonzero(counts > 255)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + np.c_[over, counts[over] - 255].astype(np.int64).tobytes()


def _survey(n: int, bits: int):
    """Batches of (doc_id, text) to packed (doc_id, signature, size, keys) and, at the end, the counters over the partition's different sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << bits, dtype=np.int64)
        seen: set[tuple[int, int]] = set()
        for pdf in batches:
            rows, buckets = [], []
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                g = ngram_hashes(text, n)
                key = (_signature(g) if len(g) else 0, len(g))
                rows.append((i, *key, *(_keys(g) if len(g) else [0] * BANDS)))
                if len(g) and key not in seen:
                    seen.add(key)
                    buckets.append(g >> np.uint64(64 - bits))
            if buckets:
                counts += np.bincount(np.concatenate(buckets).astype(np.int64), minlength=1 << bits)
            if rows:
                yield pd.DataFrame({"piece": [-1], "data": [np.array(rows, dtype=np.int64).T.tobytes()]})
        if seen:
            yield pd.DataFrame({"piece": range(PIECES), "data": [_encoded(x) for x in counts.reshape(PIECES, -1)]})

    return run


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for data in pdf["data"]:
            a = np.frombuffer(data, dtype=np.int64).reshape(3 + BANDS, -1)
            yield pd.DataFrame({"doc_id": a[0], "signature": a[1], "n": a[2].astype(np.int32), "keys": list(a[3:].T.copy())})


def _added(bits: int, last: bool):
    """Counters of one piece, added up as they come; the last step leaves 32 bits of each."""
    width = (1 << bits) // PIECES

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width, dtype=np.int64)
        for pdf in batches:
            for data in pdf["data"]:
                total += np.frombuffer(data, dtype=np.uint8, count=width)
                more = np.frombuffer(data, dtype=np.int64, offset=width).reshape(-1, 2)
                total[more[:, 0]] += more[:, 1]
        yield pd.DataFrame({"piece": [key[0]], "data": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes() if last else _encoded(total)]})

    return run


def _entries(n: int, t: float, bits: int, blocks: int, order, hot: int):
    """Batches of (doc_id, text) to one packed row for each block of columns; sets that the partition has had are passed over. turns: where
    in its row's order an entry stands, in 256ths of the entries kept."""

    def packed(signatures: list[int], sizes: list[int], grams: list[np.ndarray], heat: list[np.ndarray]) -> pd.DataFrame:
        rows = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        column, tiles = np.concatenate(grams), -(-np.concatenate(heat).astype(np.int64) // hot)
        length = np.array([len(g) for g in grams])
        turn = ((np.arange(len(rows)) - (np.cumsum(length) - length)[rows]) * 256 // length[rows]).astype(np.uint8)
        own = np.array(signatures, dtype=np.int64)
        at = np.flatnonzero(tiles > 1)
        if len(at):
            k = np.repeat(at, tiles[at])
            other = np.arange(len(k)) - np.repeat(np.cumsum(tiles[at]) - tiles[at], tiles[at])
            mine = (mix(own.view(np.uint64))[rows[k]] % tiles[k].astype(np.uint64)).astype(np.int64)
            tile = np.minimum(mine, other) * tiles[k] + np.maximum(mine, other) + 1
            with np.errstate(over="ignore"):
                tiled = mix(column[k] + mix(tile.astype(np.uint64)))
            cold = tiles <= 1
            rows, column, turn = np.r_[rows[cold], rows[k]], np.r_[column[cold], tiled], np.r_[turn[cold], turn[k]]
        block = (column % np.uint64(blocks)).astype(np.int64)
        at = np.argsort(block, kind="stable")
        found, cuts = np.unique(block[at], return_index=True)
        out = []
        for b, part in zip(found.tolist(), np.split(at, cuts[1:])):
            used, local = np.unique(rows[part], return_inverse=True)
            out.append((b, own[used].tobytes(), np.array(sizes, dtype=np.int32)[used].tobytes(), (column[part] >> np.uint64(20)).astype(np.uint32).tobytes(), local.astype(np.uint16 if len(used) < 65536 else np.uint32).tobytes(), turn[part].tobytes()))
        return pd.DataFrame(out, columns=["block", "signatures", "sizes", "columns", "rows", "turns"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.frombuffer(order.value, dtype=np.uint32)
        seen: set[tuple[int, int]] = set()
        held: tuple[list, list, list, list] = ([], [], [], [])
        waiting = 0
        for pdf in batches:
            for text in pdf["text"]:
                g = ngram_hashes(text, n)
                key = (_signature(g) if len(g) else 0, len(g))
                if not len(g) or key in seen:
                    continue
                seen.add(key)
                c = counts[(g >> np.uint64(64 - bits)).astype(np.int64)]
                at = np.argsort(c, kind="stable")[: _prefix(len(g), t)]
                for own, x in zip(held, (*key, g[at], c[at])):
                    own.append(x)
                waiting += len(at)
                if waiting > ENTRIES_AT_ONCE:
                    yield packed(*held)
                    held, waiting = ([], [], [], []), 0
        if waiting:
            yield packed(*held)

    return run


def _early(n_a: np.ndarray, n_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, t: float) -> np.ndarray:
    """Whether a column that is at_a-th of a row's n_a and at_b-th of another's n_b, at least as many, counts for this pair (step 3)."""
    needed = np.ceil(t / (1 + t) * (n_a + n_b) - 1e-6)
    least = np.clip(needed - np.ceil(t * n_b - 1e-9) + 1, 1, FEW)
    return (at_a < n_a - needed + least) & (at_b < n_b - needed + least)


def _met(r: np.ndarray, first: np.ndarray, length: np.ndarray, size: np.ndarray, place: np.ndarray, t: float, at: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pair, number of columns) of the rows r[first : first + length] that meet in a column that counts for them, whose sizes fit and whose places (-1: none)
    differ; rows are numbered by size. at: where in the row's order the column stands, or somewhat before."""
    at = np.zeros(len(r), dtype=np.int64) if at is None else at
    for m in np.unique(length):
        lists = first[length == m][:, None] + np.arange(m)
        if m <= 64:
            i, j = np.triu_indices(m, 1)
            step = max(1, PAIRS_AT_ONCE // 4 // len(i))
            for low in range(0, len(lists), step):
                part = lists[low : low + step]
                x, y = part[:, i].ravel(), part[:, j].ravel()
                a, b = r[x], r[y]
                fits = (size[a] >= t * size[b] - 1e-9) & ((place[a] < 0) | (place[a] != place[b]))
                x, y, a, b = x[fits], y[fits], a[fits], b[fits]
                fits = _early(size[a], size[b], at[x], at[y], t)
                yield a[fits] * len(size) + b[fits], np.ones(fits.sum(), dtype=np.int64)
        else:
            for part in lists:
                rows, turn = r[part], at[part]
                own, n = place[rows], size[rows]
                reach = np.searchsorted(n, n / t + 1e-9, side="right")
                placed, many = np.unique(own[own >= 0], return_counts=True)
                main = placed[many.argmax()] if len(placed) else -2
                back = np.flatnonzero(own == main)  # these meet the others only
                for k in np.flatnonzero(own != main).tolist():
                    later = np.arange(k + 1, reach[k])
                    later = later[(own[later] < 0) | (own[later] != own[k])]
                    later = later[_early(n[k], n[later], turn[k], turn[later], t)]
                    if len(later):
                        yield rows[k] * len(size) + rows[later], np.ones(len(later), dtype=np.int64)
                    a = back[: np.searchsorted(back, k)]
                    a = a[reach[a] > k]
                    a = a[_early(n[a], n[k], turn[a], turn[k], t)]
                    if len(a):
                        yield rows[a] * len(size) + rows[k], np.ones(len(a), dtype=np.int64)


def _product(t: float, places):
    """One block of columns to the pairs of rows of different places with entries in common, with counts, which may come in several parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signatures, sizes, rows, columns, turns, shift = [], [], [], [], [], 0
        for pdf in batches:
            for s, z, r, c, k in zip(pdf["signatures"], pdf["sizes"], pdf["rows"], pdf["columns"], pdf["turns"]):
                signatures.append(np.frombuffer(s, np.int64))
                sizes.append(np.frombuffer(z, np.int32))
                rows.append(np.frombuffer(r, np.uint16 if len(r) * 2 == len(c) else np.uint32).astype(np.int64) + shift)
                columns.append(np.frombuffer(c, np.uint32))
                turns.append(np.frombuffer(k, np.uint8))
                shift += len(s) // 8
        signature, size = np.concatenate(signatures), np.concatenate(sizes).astype(np.int64)
        # copies are one row; rows are numbered by size, so partners of fitting size follow each other
        order = np.lexsort((signature, size))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (signature[order][1:] != signature[order][:-1]) | (size[order][1:] != size[order][:-1])
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        signature, size = signature[order][new], size[order][new]
        # (column, row, turn) in 64 bits: beyond 16 million rows the turn is cut, which makes it earlier; of a row's entries in one column the first stays
        bits = min(8, 32 - (len(signature) - 1).bit_length())
        keys = (np.concatenate(columns).astype(np.uint64) << np.uint64(32)) | (number[np.concatenate(rows)] << bits).astype(np.uint64)
        keys |= (np.concatenate(turns) >> (8 - bits)).astype(np.uint64)
        keys.sort()
        own = keys >> np.uint64(bits)
        keys = keys[np.r_[True, own[1:] != own[:-1]]]
        del signatures, sizes, rows, columns, turns, own
        c, r = keys >> np.uint64(32), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        turn, r = (r & ((1 << bits) - 1)) << (8 - bits), r >> bits
        stands = -(-turn * (size - np.ceil(t * size - 1e-9).astype(np.int64) + 1)[r] // 256)
        del turn
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        length = np.diff(np.r_[first, len(c)])
        del keys, c

        known = np.frombuffer(places.value, dtype=PLACED)
        place = np.full(len(signature), -1, dtype=np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known["signature"], signature), len(known) - 1)
            same = (known["signature"][at] == signature) & (known["n"][at] == size)
            place[same] = known["place"][at[same]]
        half = (signature >> 32).astype(np.int32)  # with the size, enough to tell sets apart before the exact check

        def frames(k: np.ndarray, w: np.ndarray) -> Iterator[pd.DataFrame]:
            for at in range(0, len(k), 200_000):
                a, b = k[at : at + 200_000] // len(size), k[at : at + 200_000] % len(size)
                swap = (half[a] > half[b]) | ((half[a] == half[b]) & (size[a] > size[b]))
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                yield pd.DataFrame({"sig_a": half[a], "sig_b": half[b], "n_a": size[a].astype(np.int32), "n_b": size[b].astype(np.int32), "common": w[at : at + 200_000]})

        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for k, w in _met(r, first[length > 1], length[length > 1], size, place, t, stands):
            held.append((k, w))
            waiting += len(k)
            if waiting > PAIRS_AT_ONCE:
                held = [_summed(held)]
                waiting = len(held[0][0])
                if waiting > PAIRS_AT_ONCE // 2:
                    yield from frames(*held[0])
                    held, waiting = [], 0
        if held:
            yield from frames(*_summed(held))

    return run


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return pairs, np.bincount(back, weights=np.concatenate([w for _, w in held]), minlength=len(pairs)).astype(np.int64)


PLACED = np.dtype([("signature", np.int64), ("n", np.int32), ("place", np.int32)])
PAIRS = "rep_a long, rep_b long, n_a int, n_b int, overlap int"
LINKS = "u long, v long, links long"


def _checked(n: int, t: float, as_pairs: bool):
    """A pair of row blocks: exact overlaps of the pairs in it, as PAIRS or as LINKS (v null: links of u; else u and v are of one group)."""

    def run(pairs: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        texts = texts.sort_values("doc_id")
        docs, copies, place = texts["doc_id"].to_numpy(), texts["copies"].to_numpy(), texts["place"].to_numpy()
        grams = [ngram_hashes(x, n) for x in texts["text"]]
        length = np.array([len(g) for g in grams])
        _, ids = np.unique(np.concatenate(grams), return_inverse=True)
        starts = np.r_[0, np.cumsum(length)]
        flag = np.zeros(int(ids.max()) + 1, dtype=np.int32)
        pairs = pairs.sort_values("doc_a")
        a, b = np.searchsorted(docs, pairs["doc_a"]), np.searchsorted(docs, pairs["doc_b"])
        apart = place[a] != place[b]  # halves of signatures may bring back a pair that _tile counts
        a, b = a[apart], b[apart]
        if not len(a):
            return pd.DataFrame(columns=[x.split()[0] for x in (PAIRS if as_pairs else LINKS).split(", ")])
        cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        overlap = np.empty(len(a), dtype=np.int64)
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(a)]):
            mine = ids[starts[a[lo]] : starts[a[lo] + 1]]
            flag[mine] = 1
            theirs = np.concatenate([ids[starts[k] : starts[k + 1]] for k in b[lo:hi]])
            overlap[lo:hi] = np.add.reduceat(flag[theirs], np.r_[0, np.cumsum(length[b[lo:hi]])[:-1]])
            flag[mine] = 0
        alike = overlap >= t * (length[a] + length[b] - overlap) - 1e-9
        del grams, ids, flag
        give_back()
        a, b, overlap = a[alike], b[alike], overlap[alike]
        if as_pairs:
            return pd.DataFrame({"rep_a": docs[a], "rep_b": docs[b], "n_a": length[a].astype(np.int32), "n_b": length[b].astype(np.int32), "overlap": overlap.astype(np.int32)})
        links = np.zeros(len(docs), dtype=np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        own, (moved, root) = np.flatnonzero(links), forest(len(docs), a, b)
        return pd.DataFrame({"u": np.r_[docs[own], docs[moved]], "v": pd.array([None] * len(own) + docs[root].tolist(), dtype="Int64"), "links": np.r_[links[own], np.zeros(len(moved), np.int64)]})

    return run


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the sets a has in common with each of b: frequent ones by products of dense matrices, the others by pairs."""
    shape = (len(a), len(b))
    ids = np.unique(np.concatenate(a + b), return_inverse=True)[1]
    cut = sum(map(len, a))
    rows = [np.repeat(np.arange(len(x)), [len(g) for g in x]) for x in (a, b)]
    columns = [ids[:cut], ids[cut:]]
    width = int(ids.max()) + 1
    often = [np.bincount(c, minlength=width) for c in columns]
    met = often[0] * often[1]
    found = np.zeros(shape, dtype=np.float32)
    dense = np.flatnonzero(met * DENSE >= shape[0] * shape[1])
    for at in range(0, len(dense), 2048):
        number = np.full(width, -1)
        number[dense[at : at + 2048]] = np.arange(len(dense[at : at + 2048]))
        sides = []
        for r, c, n in zip(rows, columns, shape):
            side = np.zeros((n, len(dense[at : at + 2048])), dtype=np.float32)
            k = number[c] >= 0
            side[r[k], number[c[k]]] = 1
            sides.append(side)
        found += sides[0] @ sides[1].T
    met[dense] = 0
    order = np.argsort(columns[1], kind="stable")
    theirs, first = rows[1][order], np.cumsum(often[1]) - often[1]
    k = np.flatnonzero(met[columns[0]] > 0)
    mine, column = rows[0][k], columns[0][k]
    many = often[1][column]
    parts = np.flatnonzero(np.diff(np.cumsum(many) // PAIRS_AT_ONCE, prepend=0)) if len(k) else []
    for part in np.split(np.arange(len(k)), parts):
        m = many[part]
        place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[column[part]], m)
        found += np.bincount(np.repeat(mine[part], m) * shape[1] + theirs[place], minlength=found.size).reshape(shape)
    return found


def _tile(n: int, t: float, as_pairs: bool):
    """Two tiles of a place, or one with itself: all its pairs of rows, as PAIRS or LINKS."""

    def run(key: tuple, texts: pd.DataFrame) -> pd.DataFrame:
        _, low, high = key
        texts = texts.sort_values("doc_id")
        grams = [ngram_hashes(x, n) for x in texts["text"]]
        tile = texts["tile"].to_numpy()
        left, right = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
        columns = [x.split()[0] for x in (PAIRS if as_pairs else LINKS).split(", ")]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=columns)
        docs, copies, length = texts["doc_id"].to_numpy(), texts["copies"].to_numpy(), np.array([len(g) for g in grams])
        overlap = _overlaps([grams[k] for k in left], [grams[k] for k in right])
        alike = overlap >= t * (length[left][:, None] + length[right] - overlap.astype(np.float64)) - 1e-9
        if low == high:
            np.fill_diagonal(alike, False)
        if as_pairs:
            a, b = np.nonzero(np.triu(alike) if low == high else alike)
            swap = left[a] > right[b]
            x, y = np.where(swap, right[b], left[a]), np.where(swap, left[a], right[b])
            return pd.DataFrame({"rep_a": docs[x], "rep_b": docs[y], "n_a": length[x].astype(np.int32), "n_b": length[y].astype(np.int32), "overlap": overlap[a, b].astype(np.int32)})
        links = np.zeros(len(docs), dtype=np.int64)
        links[left] = alike @ copies[right]
        if low != high:
            links[right] = copies[left] @ alike
        u, v = [], []
        new = [np.ones(len(left), dtype=bool), np.ones(len(right), dtype=bool)]
        for root in range(len(left)):
            if not new[0][root] or not alike[root].any():
                continue
            reached = np.array([root])
            new[0][root] = False
            while len(reached):
                there = np.flatnonzero(alike[reached].any(axis=0) & new[1])
                new[1][there] = False
                reached = np.flatnonzero(alike[:, there].any(axis=1) & new[0]) if len(there) else there
                new[0][reached] = False
                for x in (right[there], left[reached]):
                    x = x[x != left[root]]
                    u.extend(docs[x].tolist())
                    v.extend([docs[left[root]]] * len(x))
        own = np.flatnonzero(links)
        del grams, overlap, alike
        give_back()
        return pd.DataFrame({"u": np.r_[docs[own], np.array(u, dtype=np.int64)], "v": pd.array([None] * len(own) + v, dtype="Int64"), "links": np.r_[links[own], np.zeros(len(u), np.int64)]})

    return run


def _placed(reps: DataFrame) -> DataFrame | None:
    """(rep, signature, n, copies, place) of the rows in large groups, place the smallest rep of the group; None where there are none. Rows of one
    signature and different sizes stay out."""
    twice = reps.groupBy("signature").count().where("count > 1").select("signature")
    reps = reps.join(twice, "signature", "left_anti")
    keys = reps.select("rep", F.explode("keys").alias("key"))
    large = keys.groupBy("key").agg(F.min("rep").alias("v"), F.count("*").alias("rows")).where(F.col("rows") >= LARGE).select("key", "v")
    edges = settle(keys.join(large, "key").select(F.col("rep").alias("u"), "v").distinct())
    if edges.isEmpty():
        return None
    label = connected(edges).select(F.col("node").alias("rep"), F.col("label").alias("place"))
    placed = settle(reps.drop("keys").join(label, "rep"))
    sizes = np.sort(placed.groupBy("place").count().toPandas()["count"].to_numpy())[::-1]
    within = np.cumsum(sizes) <= MOST_PLACED
    if within.all():
        return placed
    if not within[0]:
        return None
    least = int(sizes[len(sizes[within])]) + 1
    return settle(placed.join(placed.groupBy("place").count().where(F.col("count") >= least).select("place"), "place", "left_semi"))


def _compared(docs: DataFrame, n: int, t: float, as_pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(meta, reps, found): meta is (doc_id, signature, n) of every document, n being 0 without words; reps is (signature, n, rep, copies) of the different sets,
    rep the smallest doc_id that has it; found is PAIRS or LINKS over reps."""
    spark = docs.sparkSession
    importable(spark)
    own = one_text_each(docs)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, size / BYTES_PER_COUNTER)))))
    surveyed = settle(own.mapInPandas(trimmed(_survey(n, bits)), "piece int, data binary"))
    meta = surveyed.where("piece < 0").mapInPandas(_unpack, "doc_id long, signature long, n int, keys array<long>")
    sets = settle(meta.where("n > 0").groupBy("signature", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("keys").alias("keys")))
    reps, meta = sets.drop("keys"), meta.drop("keys")
    placed = _placed(sets)
    counters = surveyed.where("piece >= 0").withColumn("turn", F.spark_partition_id() % 64)
    counters = counters.groupBy("piece", "turn").applyInPandas(_iterated(_added(bits, False)), "piece int, data binary")
    counters = counters.groupBy("piece").applyInPandas(_iterated(_added(bits, True)), "piece int, data binary").collect()
    order = spark.sparkContext.broadcast(b"".join(bytes(x["data"]) for x in sorted(counters, key=lambda x: x["piece"])))
    total = reps.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, math.ceil(total * (1 - t) / ENTRIES_PER_BLOCK))
    entries = own.mapInPandas(trimmed(_entries(n, t, bits, blocks, order, HOT)), "block long, signatures binary, sizes binary, columns binary, rows binary, turns binary")
    if placed is None:
        places = np.empty(0, dtype=PLACED)
    else:
        known = placed.select("signature", "n", "place").toPandas().sort_values("signature")
        places = np.empty(len(known), dtype=PLACED)
        places["signature"], places["n"], places["place"] = known["signature"], known["n"], pd.factorize(known["place"])[0]
    product = trimmed(_product(t, spark.sparkContext.broadcast(places.tobytes())))

    def block_product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return product(batches)

    common = entries.groupBy("block").applyInPandas(block_product, "sig_a int, sig_b int, n_a int, n_b int, common long")
    needed = F.ceil(F.lit(t / (1 + t)) * (F.col("n_a") + F.col("n_b")) - 1e-6)
    rest = F.greatest(F.ceil(t * F.col("n_a") - 1e-9), F.ceil(t * F.col("n_b") - 1e-9)) - 1
    kept = common.groupBy("sig_a", "n_a", "sig_b", "n_b").agg(F.sum("common").alias("common")).where(F.col("common") >= F.least(F.lit(FEW), needed - rest))
    half = F.shiftright("signature", 32).cast("int")
    left = reps.select(half.alias("sig_a"), F.col("n").alias("n_a"), F.col("rep").alias("x"))
    right = reps.select(half.alias("sig_b"), F.col("n").alias("n_b"), F.col("rep").alias("y"))
    candidates = settle(kept.join(left, ["sig_a", "n_a"]).join(right, ["sig_b", "n_b"]).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), F.when(F.col("x") < F.col("y"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.when(F.col("x") < F.col("y"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b")).where("doc_a < doc_b").distinct())

    # where rows lie: near the smallest row within two steps, a large group in several runs and small ones together in one
    edges = candidates.select(F.col("doc_a").alias("u"), F.col("doc_b").alias("v"), "n_a")
    edges = edges.union(candidates.select("doc_b", "doc_a", "n_b"))
    near = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("near"))
    place = settle(edges.join(near.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("near").alias("near"), F.max("n_a").alias("n")))
    weight = settle(place.groupBy("near").agg(F.sum("n").alias("weight")))
    small = max(1, math.ceil((weight.where(F.col("weight") < BLOCK_GRAMS).agg(F.sum("weight")).first()[0] or 0) / BLOCK_GRAMS))
    run = F.pmod(F.xxhash64("u"), F.ceil(F.col("weight") / BLOCK_GRAMS))
    place = place.join(weight, "near").select("u", F.when(F.col("weight") < BLOCK_GRAMS, F.pmod(F.xxhash64("near"), F.lit(small))).otherwise(F.xxhash64("near", run)).alias("place"))
    place = settle(place)
    tasks = candidates.join(place.select(F.col("u").alias("doc_a"), F.col("place").alias("pa")), "doc_a").join(place.select(F.col("u").alias("doc_b"), F.col("place").alias("pb")), "doc_b")
    tasks = settle(tasks.select(F.xxhash64(F.least("pa", "pb"), F.greatest("pa", "pb")).alias("task"), "doc_a", "doc_b"))
    members = tasks.select("task", F.col("doc_a").alias("doc_id")).union(tasks.select("task", F.col("doc_b").alias("doc_id"))).distinct()
    where = reps.withColumn("place", F.col("rep"))
    if placed is not None:
        where = reps.join(placed.select("rep", "place"), "rep", "left").withColumn("place", F.coalesce("place", "rep"))
    members = members.join(where.select(F.col("rep").alias("doc_id"), "copies", "place"), "doc_id")
    texts = members.join(own, "doc_id").select("task", "doc_id", "copies", "place", "text")
    found = tasks.select(F.col("task").alias("own"), "doc_a", "doc_b").groupBy("own").cogroup(texts.groupBy("task")).applyInPandas(_checked(n, t, as_pairs), PAIRS if as_pairs else LINKS)
    if placed is not None:
        found = found.unionByName(_within(own, placed, n, t, as_pairs))
    return meta, reps, found


def _within(own: DataFrame, placed: DataFrame, n: int, t: float, as_pairs: bool) -> DataFrame:
    """PAIRS or LINKS of the pairs within places; each pair of tiles gets its texts once."""
    tiles = placed.groupBy("place").agg(F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum("n") / TILE_GRAMS)).alias("tiles"))
    rows = placed.join(tiles, "place").withColumn("tile", F.pmod(F.xxhash64("rep"), "tiles"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select(F.col("rep").alias("doc_id"), "copies", "place", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    texts = rows.join(own, "doc_id")
    return texts.groupBy("place", "low", "high").applyInPandas(_tile(n, t, as_pairs), PAIRS if as_pairs else LINKS)


def _iterated(run):
    """run with the hints that make Spark hand it a group's batches one after the other."""

    def grouped(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return run(key, batches)

    return grouped


def similar_sets(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(sets, pairs): sets is (doc_id, rep), rep the smallest doc_id with the same n-grams, for documents that have n-grams;
    pairs is (rep_a, rep_b, n_a, n_b, overlap) of different sets that are similar enough."""
    meta, reps, pairs = _compared(docs, n, threshold, True)
    return meta.join(reps, ["signature", "n"]).select("doc_id", "rep"), pairs


def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links) of every document: class_id is the smallest doc_id of the group that pairs with a similarity of threshold or more
    connect, n_links the number of other documents, copies among them, that it makes such a pair with."""
    meta, reps, found = _compared(docs, n, threshold, False)
    found = settle(found)
    label = connected(found.where("v IS NOT NULL").select("u", "v")).withColumnRenamed("node", "rep")
    links = found.where("v IS NULL").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    classes = reps.join(label, "rep", "left").join(links, "rep", "left").select("signature", "n", F.coalesce("label", "rep").alias("class_id"), (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"))
    alone = meta.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return meta.where("n > 0").join(classes, ["signature", "n"]).select("doc_id", "class_id", "n_links").unionByName(alone)


def drop_near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document, that of the smallest doc_id, of each group that similar pairs connect.

    All columns stay. Rows without a doc_id or without words stay; rows that repeat a kept doc_id become one
    (that of the smallest text, then of the smallest hash of its columns).
    """
    importable(docs.sparkSession)
    gone, repeats, rank = fresh(docs, "gone_id"), fresh(docs, "again_id"), fresh(docs, "rank_of_row")
    dropped = settle(ngram_jaccard_join(docs, n, threshold).where("class_id <> doc_id").select(F.col("doc_id").alias(gone)))
    own = F.col("doc_id").cast("long")
    kept = docs.join(dropped, own == F.col(gone), "left_anti")
    repeated = docs.select(own.alias(repeats)).where(F.col(repeats).isNotNull()).groupBy(repeats).count().where("count > 1").select(repeats)
    if repeated.isEmpty():
        return kept
    order = F.struct(F.col("text").isNull(), F.col("text"), F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = kept.join(repeated, own == F.col(repeats), "left_semi").groupBy(own.alias(repeats)).agg(F.min_by(whole, order).alias(rank)).select(f"{rank}.*")
    return kept.join(repeated, own == F.col(repeats), "left_anti").unionByName(again)


ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(min(text)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws
  FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < {N} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {N} + 2), lambda i: array_to_string(ws[i:i + {N} - 1], ' ')) END) AS gram
  FROM w WHERE len(ws) > 0
), s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS overlap
  FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
), p AS (
  SELECT doc_a, doc_b FROM o JOIN s x ON x.doc_id = doc_a JOIN s y ON y.doc_id = doc_b
  WHERE overlap >= {THRESHOLD} * (x.n + y.n - overlap) - 1e-9
), e AS (SELECT doc_a AS u, doc_b AS v FROM p UNION ALL SELECT doc_b, doc_a FROM p),
c AS (SELECT DISTINCT u AS root, u AS node FROM e UNION SELECT root, v FROM c JOIN e ON u = node)
SELECT w.doc_id, coalesce(first, w.doc_id) AS class_id, coalesce(links, 0) AS n_links FROM w
LEFT JOIN (SELECT root, min(node) AS first FROM c GROUP BY root) ON root = w.doc_id
LEFT JOIN (SELECT u, count(*) AS links FROM e GROUP BY u) ON u = w.doc_id
"""
