"""Operator 9, near-duplicate embeddings by an epsilon grid order join.

Vectors are scaled to length one, so a cosine of THRESHOLD or more is a distance of epsilon or less. Equal vectors are one from here on, with
the number of their copies. They are projected on leading principal directions (from sums over all vectors; as many as hold SHARE of the
variance, MOST_LEADING at most), cut into cells of side epsilon and sorted by cell in lexicographic
order. The sorted sequence is cut into blocks. Blocks, then halves of blocks, recursively, are skipped when their bounding boxes on
the principal directions lie over epsilon apart, which no pair across them can make good; what is left at LEAF vectors is compared in full, and what is
near the threshold again with the vectors as they were given, in doubles. The result is exact; nothing is capped.

Pairs of blocks are found by their boxes and numbers alone. Blocks that follow each other are a section of SECTION blocks; a pair of sections with
something to compare gets each of its blocks once, so SECTION and BLOCK bound a task's memory. It gives each vector's links and
a forest of what it connects, not its pairs, so the result has a row for each vector whatever the groups' sizes.

Defined results: null ids are left out; null or empty vectors, vectors with a null, NaN or infinite element, of length zero or of another
dimension than most are a class of their own with no links; of rows that repeat an id the one of the smallest vector counts (a null before all); a cosine exactly at the
threshold counts; of dimensions that are as frequent the larger counts as most; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, forest, importable, settle

THRESHOLD = 0.95
MOST_LEADING = 8
SHARE = 0.5  #: of the variance
BLOCK = 4096
SECTION = 4
LEAF = 256
SLACK = 1e-5  #: on the safe side of rounding in 32-bit floats
LINKS = "u long, v long, links long"
PAIRS = "vec_a long, vec_b long, cosine double"


def one_vector_each(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding): rows with an id, those that repeat one cut to the smallest vector; costs a shuffle only if some do."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where("vec_id IS NOT NULL")
    repeated = own.groupBy("vec_id").count().where("count > 1").select("vec_id")
    if repeated.isEmpty():
        return own
    again = own.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min_by("embedding", F.struct("embedding")).alias("embedding"))
    return own.join(repeated, "vec_id", "left_anti").unionByName(again)


def usable(own: DataFrame) -> DataFrame:
    """The rows whose vectors take part."""
    own = own.where("size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = CAST('Infinity' AS FLOAT)) AND exists(embedding, x -> x <> 0)")
    most = own.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return own.where(F.size("embedding") == (most["d"] if most else 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for pdf in batches:
        if len(pdf):
            x = _unit(np.stack(pdf["embedding"].to_numpy()))
            x = np.c_[x, np.ones(len(x))]
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pd.DataFrame({"i": range(len(total)), "s": list(total)})


def _added(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield pd.DataFrame({"i": [key[0]], "s": [sum(row for pdf in batches for row in pdf["s"])]})


def directions(vectors: DataFrame, most: int = MOST_LEADING) -> np.ndarray | None:
    """Principal directions as columns, largest variance first. One row for each dimension is collected."""
    sums = vectors.mapInPandas(_moments, "i int, s array<double>").groupBy("i").applyInPandas(_added, "i int, s array<double>").collect()
    if not sums:
        return None
    m = np.array([r["s"] for r in sorted(sums, key=lambda r: r["i"])])
    n, mean = m[-1, -1], m[-1, :-1] / m[-1, -1]
    w, v = np.linalg.eigh(m[:-1, :-1] / n - np.outer(mean, mean))
    w, v = np.maximum(w[::-1], 0), v[:, ::-1]
    v = v[:, : min(most, 1 + int((np.cumsum(w) < SHARE * w.sum()).sum()))]
    return v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1)


def _cells(v: np.ndarray, eps: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                given = np.stack(pdf["embedding"].to_numpy()).astype(np.float32)
                c = np.floor(_unit(given) @ v / eps).astype(np.int32)
                out = pd.DataFrame(c, columns=[f"c{k}" for k in range(v.shape[1])])
                yield out.assign(vec_id=pdf["vec_id"].to_numpy(), copies=pdf["copies"].to_numpy(), data=[r.tobytes() for r in given])

    return run


def _blocks(v: np.ndarray, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first, count = TaskContext.get().partitionId() << 32, 0
        ids: list[np.ndarray] = []
        copies: list[np.ndarray] = []
        data: list[bytes] = []

        def block() -> pd.DataFrame:
            nonlocal count
            x = _unit(np.frombuffer(b"".join(data), np.float32).reshape(len(data), -1)) @ v
            out = pd.DataFrame({"section": [first + count // SECTION], "block": [first + count], "lo": [x.min(axis=0).tolist()], "hi": [x.max(axis=0).tolist()], "ids": [np.concatenate(ids).tobytes()], "copies": [np.concatenate(copies).tobytes()], "data": [b"".join(data)]})
            count += 1
            ids.clear(), copies.clear(), data.clear()
            return out

        for pdf in batches:
            at = 0
            while at < len(pdf):
                part = pdf.iloc[at : at + size - len(data)]
                at += len(part)
                ids.append(part["vec_id"].to_numpy())
                copies.append(part["copies"].to_numpy())
                data.extend(part["data"])
                if len(data) >= size:
                    yield block()
        if data:
            yield block()

    return run


def join_sequences(a: np.ndarray, b: np.ndarray, pa: np.ndarray, pb: np.ndarray, threshold: float, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with a cosine of the threshold or, for rounding, little less; a and b of length one, in grid order, pa and pb their projections. same: b is a, pairs i < j."""
    eps = math.sqrt(2 - 2 * threshold) + SLACK
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if same and k >= j - 1 and i >= m:
            continue
        if not same or i != k:
            gap = np.maximum(0, np.maximum(pb[k:m].min(axis=0) - pa[i:j].max(axis=0), pa[i:j].min(axis=0) - pb[k:m].max(axis=0)))
            if float(gap @ gap) > eps * eps:
                continue
        if j - i <= LEAF and m - k <= LEAF:
            x, y = np.nonzero(a[i:j] @ b[k:m].T >= threshold - SLACK)
            x, y = x + i, y + k
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y
        elif same and i == k:
            h = (i + j) // 2
            todo += [(i, h, i, h), (i, h, h, j), (h, j, h, j)]
        elif j - i >= m - k:
            h = (i + j) // 2
            todo += [(i, h, k, m), (h, j, k, m)]
        else:
            h = (k + m) // 2
            todo += [(i, j, k, h), (i, j, h, m)]


def _compared(v: np.ndarray, threshold: float, as_pairs: bool):
    """A pair of sections: its pairs of blocks compared, as PAIRS or as LINKS (v null: links of u; else u and v are of one group)."""

    def run(pairs: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        held = {}
        for r in blocks.itertuples():
            given = np.frombuffer(r.data, np.float32).reshape(len(r.ids) // 8, -1)
            unit = _unit(given)
            held[r.block] = (np.frombuffer(r.ids, np.int64), np.frombuffer(r.copies, np.int64), given, unit.astype(np.float32), (unit @ v).astype(np.float32))
        out = []
        every = np.unique(np.concatenate([x[0] for x in held.values()]))
        copies = np.zeros(len(every), np.int64)
        for ids, n, *_ in held.values():
            copies[np.searchsorted(every, ids)] = n
        links = np.zeros(len(every), np.int64)
        moved = root = np.empty(0, np.int64)
        for p, q in zip(pairs["block_a"], pairs["block_b"]):
            (ia, _, ga, a, pa), (ib, _, gb, b, pb) = held[p], held[q]
            near, waiting = [(moved, root)], 0
            for x, y in join_sequences(a, b, pa, pb, threshold, p == q):
                c = (_unit(ga[x]) * _unit(gb[y])).sum(axis=1)
                ok = c >= threshold
                m, n = ia[x[ok]], ib[y[ok]]
                if as_pairs:
                    out.append(pd.DataFrame({"vec_a": np.minimum(m, n), "vec_b": np.maximum(m, n), "cosine": c[ok]}))
                elif len(m):
                    m, n = np.searchsorted(every, m), np.searchsorted(every, n)
                    np.add.at(links, m, copies[n])
                    np.add.at(links, n, copies[m])
                    near.append((m, n))
                    waiting += len(m)
                    if waiting > 500_000:
                        near, waiting = [forest(len(every), *map(np.concatenate, zip(*near)))], 0
            moved, root = forest(len(every), *map(np.concatenate, zip(*near)))
        if as_pairs:
            return pd.concat(out) if out else pd.DataFrame({"vec_a": np.empty(0, np.int64), "vec_b": np.empty(0, np.int64), "cosine": np.empty(0)})
        own = np.flatnonzero(links)
        return pd.DataFrame({"u": np.r_[every[own], every[moved]], "v": pd.array([None] * len(own) + every[root].tolist(), dtype="Int64"), "links": np.r_[links[own], np.zeros(len(moved), np.int64)]})

    return run


def _found(own: DataFrame, threshold: float, block: int, as_pairs: bool) -> tuple[DataFrame, DataFrame] | None:
    """(sets, found): sets is (embedding, rep, copies) of the different vectors; None where no vector takes part."""
    v = directions(own)
    if v is None:
        return None
    sets = settle(own.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    eps = math.sqrt(2 - 2 * threshold) + SLACK
    names = [f"c{k}" for k in range(v.shape[1])]
    celled = sets.select(F.col("rep").alias("vec_id"), "copies", "embedding").mapInPandas(_cells(v, eps), ", ".join(f"{n} int" for n in names) + ", vec_id long, copies long, data binary")
    ordered = celled.repartitionByRange(*names, "vec_id").sortWithinPartitions(*names, "vec_id")  # the id cuts a cell that holds much
    blocks = settle(ordered.mapInPandas(_blocks(v, block), "section long, block long, lo array<double>, hi array<double>, ids binary, copies binary, data binary"))
    boxes = blocks.select("section", "block", "lo", "hi", F.floor(F.col("lo")[0] / eps).cast("long").alias("from"), F.floor(F.col("hi")[0] / eps).cast("long").alias("to"))
    side = lambda x, cells: boxes.select(F.col("section").alias(f"section_{x}"), F.col("block").alias(f"block_{x}"), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}"), F.explode(cells).alias("cell"))
    left, right = side("a", F.sequence("from", "to")), side("b", F.sequence(F.col("from") - 1, F.col("to") + 1))
    gap = F.expr("aggregate(transform(sequence(0, size(lo_a) - 1), k -> greatest(0D, lo_b[k] - hi_a[k], lo_a[k] - hi_b[k])), 0D, (s, g) -> s + g * g)")
    pairs = left.join(right, "cell").where((F.col("block_a") <= F.col("block_b")) & (gap <= eps * eps)).select("section_a", "section_b", "block_a", "block_b").distinct()
    pairs = settle(pairs.select(F.xxhash64("section_a", "section_b").alias("task"), "block_a", "block_b"))
    members = pairs.select("task", F.col("block_a").alias("block")).union(pairs.select("task", F.col("block_b").alias("block"))).distinct()
    sent = members.join(blocks.select("block", "ids", "copies", "data"), "block")
    return sets, pairs.select(F.col("task").alias("own"), "block_a", "block_b").groupBy("own").cogroup(sent.groupBy("task")).applyInPandas(_compared(v, threshold, as_pairs), PAIRS if as_pairs else LINKS)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, class_id, n_links) of every vector: class_id is the smallest vec_id of the group that pairs with a cosine of threshold or more
    connect, n_links the number of other vectors, copies among them, that it makes such a pair with."""
    importable(vectors.sparkSession)
    every = one_vector_each(vectors)
    own = usable(every)
    both = _found(own, threshold, block, False)
    if both is None:
        return every.select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    sets, found = both[0], settle(both[1])
    label = connected(found.where("v IS NOT NULL").select("u", "v")).withColumnRenamed("node", "rep")
    links = found.where("v IS NULL").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    classes = sets.join(label, "rep", "left").join(links, "rep", "left").select("embedding", F.coalesce("label", "rep").alias("own_class"), (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("own_links"))
    # a vector that takes no part finds no equal one among those that do
    return every.join(classes, "embedding", "left").select("vec_id", F.coalesce("own_class", "vec_id").alias("class_id"), F.coalesce("own_links", F.lit(0).cast("long")).alias("n_links"))


def similar_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(sets, pairs): sets is (vec_id, rep), rep the smallest vec_id of an equal vector; pairs is (vec_a, vec_b, cosine) of different vectors, vec_a < vec_b."""
    importable(vectors.sparkSession)
    own = usable(one_vector_each(vectors))
    both = _found(own, threshold, block, True)
    if both is None:
        return own.select("vec_id", F.col("vec_id").alias("rep")), vectors.sparkSession.createDataFrame([], PAIRS)
    return own.join(both[0], "embedding").select("vec_id", "rep"), both[1]


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(min(embedding) AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL GROUP BY vec_id),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
e AS (SELECT x AS s, y AS t FROM p UNION ALL SELECT y, x FROM p),
c AS (SELECT DISTINCT s AS root, s AS node FROM e UNION SELECT root, t FROM c JOIN e ON s = node)
SELECT v.vec_id, coalesce(first, v.vec_id) AS class_id, coalesce(links, 0) AS n_links FROM v
LEFT JOIN (SELECT root, min(node) AS first FROM c GROUP BY root) ON root = v.vec_id
LEFT JOIN (SELECT s, count(*) AS links FROM e GROUP BY s) ON s = v.vec_id
"""
