"""Most similar vectors for every vector, as a block matrix join.

Unit vectors are quantised to int8 codes with a scale and the exact norm of what the codes miss.
The vectors are cut into blocks; every pair of blocks is one tile.  The products of the codes are whole
numbers (held in float32, whose products the processor is fast at and which is exact up to 2**24, that is
1,040 dimensions); times the two scales they bound each cosine from above and below.  Pairs that can still be among a vector's k best (and reach the
wanted cosine) are recomputed in float and kept in a heap of k entries per vector, whose worst
entry raises the bar for what follows in the tile.  The heaps of all tiles are merged by Spark.

Identical vectors form one class, which is compared once and expanded at the end, so that a group of
copies costs no more than one vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

BLOCK_ROWS = 16_384
SIDE = 1_024
PACK = 2_048
#: Rounding of the scales and their products in float32, and half of the last of six decimals.
SLACK = 4e-6


def usable(vectors: DataFrame, id_col: str, embedding: str, dim: int) -> DataFrame:
    """id, e: the rows with an id and a vector of ``dim`` finite numbers that aren't all zero; repeated ids count once."""
    e = F.col("e")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(vectors[id_col].cast("bigint").alias("id"), vectors[embedding].cast("array<float>").alias("e"))
    rows = rows.where(F.col("id").isNotNull() & (F.size(e) == dim) & ~bad & F.exists(e, lambda x: x != 0))
    return rows.withColumn("e", F.transform(e, lambda x: x + F.lit(0.0).cast("float")))  # -0.0 is 0.0


def quantise(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors (float64), int8 codes, their scales, and the norms of the errors."""
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return unit, codes, scale, error


class _Side:
    """One side of a tile: quantised vectors and a heap of k entries for each."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, k: int, low: float):
        self.ids = ids
        self.unit, codes, scale, self.error = quantise(raw.astype(np.float64))
        self.codes, self.scale = codes.astype(np.float32), scale.astype(np.float32)
        self.k = k
        self.sim = np.full((len(ids), k), -np.inf)
        self.other = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.bar = np.full(len(ids), low)

    def push(self, rows: np.ndarray, others: np.ndarray, sims: np.ndarray, low: float) -> None:
        """Merge new entries into the heaps of their rows."""
        ok = sims >= np.maximum(low, self.sim[rows, -1])
        rows, others, sims = rows[ok], others[ok], sims[ok]
        if not rows.size:
            return
        touched = np.unique(rows)
        r = np.concatenate([np.repeat(touched, self.k), rows])
        o = np.concatenate([self.other[touched].ravel(), others])
        s = np.concatenate([self.sim[touched].ravel(), sims])
        order = np.lexsort((o, -s, r))
        r, o, s = r[order], o[order], s[order]
        first = np.searchsorted(r, touched)
        at = first[:, None] + np.arange(self.k)
        self.sim[touched], self.other[touched] = s[at], o[at]
        self.bar[touched] = np.maximum(low, self.sim[touched, -1])

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, col = np.nonzero(self.sim > -np.inf)
        return self.ids[row], self.other[row, col], self.sim[row, col]


def tile(a: _Side, b: _Side, same: bool, both: bool, low: float) -> None:
    """Fill the heaps of ``a`` (and of ``b`` if ``both``) with the pairs of the two sides."""
    bound = low > -1
    for i in range(0, len(a.ids), SIDE):
        ai = slice(i, min(i + SIDE, len(a.ids)))
        for j in range(i if same else 0, len(b.ids), SIDE):
            bj = slice(j, min(j + SIDE, len(b.ids)))
            s = a.codes[ai] @ b.codes[bj].T
            s *= a.scale[ai, None]
            s *= b.scale[bj]
            ea, eb = a.error[ai], b.error[bj]
            near = ea + float(eb.max()) * (1 + float(ea.max())) + SLACK
            bar = a.bar[ai] - near
            if not bound and s.shape[1] > a.k:  # lower bounds of the k + 1 best here (one may be the vector itself)
                kth = np.partition(s, s.shape[1] - a.k - 1, axis=1)[:, s.shape[1] - a.k - 1]
                bar = np.maximum(bar, kth - 2 * near)
            hit = s >= bar[:, None].astype(np.float32)
            if both:
                hit |= s >= (b.bar[bj] - eb - float(ea.max()) * (1 + float(eb.max())) - SLACK)[None, :].astype(np.float32)
            if not hit.any():
                continue
            x, y = np.nonzero(hit)
            x, y = x + i, y + j
            keep = a.ids[x] != b.ids[y]
            if same:
                keep &= x < y if both else True
            x, y = x[keep], y[keep]
            for p in range(0, len(x), 200_000):
                xs, ys = x[p : p + 200_000], y[p : p + 200_000]
                exact = np.round(np.einsum("ij,ij->i", a.unit[xs], b.unit[ys]), 6)
                a.push(xs, b.ids[ys], exact, low)
                if both:
                    b.push(ys, a.ids[xs], exact, low)


def _packed(classes: DataFrame, dim: int) -> DataFrame:
    """block, ids, raw: up to PACK vectors of a block in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def row(block: int) -> pa.RecordBatch:
            ids, raw = zip(*held.pop(block))
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(raw).tobytes()], pa.binary())], ["block", "ids", "raw"])

        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0).to_numpy()
            ids = batch.column(1).to_numpy()
            raw = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            for b in np.unique(block).tolist():
                mine = block == b
                held.setdefault(b, []).append((ids[mine], raw[mine]))
                if sum(len(x) for x, _ in held[b]) >= PACK:
                    yield row(b)
        for b in list(held):
            yield row(b)

    return classes.select("block", "id", "e").repartition(F.col("block")).mapInArrow(run, "block int, ids binary, raw binary")


def _class_neighbours(scratch: Scratch, classes: DataFrame, asked: DataFrame | None, k: int, dim: int, low: float, block_rows: int) -> DataFrame:
    """id, other, sim: up to k best other classes of each class (of each asked one)."""

    def blocked(df: DataFrame) -> tuple[DataFrame, int]:
        rows = df.count()
        # many vectors go in larger blocks: what is shuffled grows with the number of blocks, and a tile stays within some 200 MB
        n = max(1, math.ceil(rows / (block_rows if rows <= 32 * block_rows else 3 * block_rows)))
        return _packed(df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), dim), n

    packs, n = blocked(classes)
    packs = scratch.save(packs)
    if asked is None:
        left = packs.select(F.explode(F.sequence(F.col("block"), F.lit(n - 1))).alias("y"), F.col("block").alias("x"), F.lit(0).alias("side"), "ids", "raw")
        right = packs.where("block > 0").select(F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("x"), F.col("block").alias("y"), F.lit(1).alias("side"), "ids", "raw")
    else:
        few, m = blocked(asked)
        left = few.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("y"), F.col("block").alias("x"), F.lit(0).alias("side"), "ids", "raw")
        right = packs.select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("x"), F.col("block").alias("y"), F.lit(1).alias("side"), "ids", "raw")
    both = asked is None

    def join(table: pa.Table) -> pa.Table:
        sides = []
        for side in (0, 1):
            part = table.filter(pa.compute.equal(table["side"], side))
            if part.num_rows:
                ids = np.concatenate([np.frombuffer(x.as_py(), dtype=np.int64) for x in part["ids"]])
                raw = np.concatenate([np.frombuffer(x.as_py(), dtype=np.float32).reshape(-1, dim) for x in part["raw"]])
                order = np.argsort(ids)
                sides.append(_Side(ids[order], raw[order], k, low))
            else:
                sides.append(None)
        a, b = sides
        same = both and table["x"][0].as_py() == table["y"][0].as_py()
        if a is not None and (same or b is not None):
            tile(a, a if same else b, same, both, low)
        out = [x.entries() for x in ([a, b] if both else [a]) if x is not None]
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3)]
        return pa.table({"id": pa.array(cols[0], pa.int64()), "other": pa.array(cols[1], pa.int64()), "sim": pa.array(cols[2], pa.float64())})

    import pyarrow.compute  # noqa: F401

    tiles = left.select("x", "y", "side", "ids", "raw").unionByName(right.select("x", "y", "side", "ids", "raw"))
    found = tiles.groupBy("x", "y").applyInArrow(join, "id bigint, other bigint, sim double")
    best = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")


def neighbours(
    vectors: DataFrame, k: int = 5, id_col: str = "vec_id", embedding: str = "embedding", dim: int = 64, min_cosine: float | None = None, queries: Column | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """id, other, similarity, rank: the ``k`` most similar other vectors of each (of those for which ``queries`` holds, a condition on ``id``).

    Similarity is the raw cosine rounded to 6 decimals; ties go to the smaller id.  With ``min_cosine``
    only pairs of at least that are listed, which lets most pairs end at the int8 product.  Vectors that
    are null, zero, of another length or hold a null, NaN or infinity take no part, nor do null ids;
    repeated rows count once; an empty table gives no rows.  The result is exact: the error bounds
    are of the quantisation itself.
    """
    scratch = Scratch(vectors.sparkSession, "neighbours")
    low = -2.0 if min_cosine is None else min_cosine
    rows = scratch.save(usable(vectors, id_col, embedding, dim))
    classes = scratch.save(rows.groupBy("e").agg(F.min("id").alias("rep"), F.min("id").alias("id"), F.count_distinct("id").alias("n")))
    copies = scratch.save(rows.join(classes.where("n > 1").select("e", "rep"), "e").select("rep", "id").distinct())
    singles = classes.where("n = 1").select("rep", "id")
    members = singles.unionByName(copies)
    asked = None
    if queries is not None:
        members = members.where(queries)
        asked = classes.join(members.select("rep").distinct(), "rep", "left_semi").select("id", "e")
    best = _class_neighbours(scratch, classes.select("id", "e"), asked, k, dim, low, block_rows)
    # the k + 1 smallest ids of each class stand for it: no more of them can be among anyone's k best
    small = Window.partitionBy("rep").orderBy("id")
    firsts = singles.unionByName(copies.withColumn("at", F.row_number().over(small)).where(F.col("at") <= k + 1).select("rep", "id"))
    own = firsts.join(classes.where("n > 1").select("rep"), "rep", "left_semi").select("rep", F.col("id").alias("other"), F.lit(1.0).alias("sim"))
    other = best.withColumnRenamed("id", "of").join(firsts.withColumnRenamed("id", "member"), F.col("other") == F.col("rep")).select(F.col("of").alias("rep"), F.col("member").alias("other"), "sim")
    order = Window.partitionBy("rep").orderBy(F.desc("sim"), "other")
    lists = own.unionByName(other).withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    lists = lists.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("at", "other", "sim"))).alias("best"))
    told = members.join(lists, "rep").select("id", F.posexplode(F.slice(F.filter("best", lambda x: x["other"] != F.col("id")), 1, k)).alias("at", "b"))
    return told.select("id", F.col("b.other").alias("other"), F.col("b.sim").alias("similarity"), (F.col("at") + 1).alias("rank"))
