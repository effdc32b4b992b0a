"""Exact top-k by inner product: no-random-access aggregation over sorted lists.

Vectors are quantised to integers and grouped into candidate blocks.  Each
block keeps one list per dimension, sorted by component value.  The queries of
a block read all lists in step, each from the end that is favourable to its own
component's sign.  For every candidate a lower and an upper bound of the score
follow from the components read so far and the values at which the unread
lists stand (upper) or end (lower); the bounds of all queries come from one
matrix product per depth.  A query stops once at most ``settle``
candidates have an upper bound that reaches the k-th best lower bound; their
final scores are then resolved exactly.  Bounds are inclusive, so ties are kept.

Queries come in blocks too, and each task meets one query block with a few
candidate blocks; a candidate block is sent once per query block.  Partial
top-k lists are merged per query block and salt, then per query.

Cases: null vectors and vectors with a null or non-finite component take no
part; a query meets the candidates of its own length; rows that repeat a
vec_id are candidates of each other; a null vec_id is no query and ranks last
among ties; fewer than k candidates give fewer rows; an empty table gives none.
Scores must fit a long: components whose scores could not raise an error.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shopstar.llm.common import cut, small

BLOCK_ROWS = 4096  # candidates in a block: 64 components are 1 MB
QUERY_ROWS = 512  # queries in a block
MERGE_SALTS = 16  # partial lists of a query are merged in so many groups first
DEPTHS = (1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 3 / 4, 1)  # shares of the lists at which the bounds are compared
EXACT_32, EXACT_64 = 2.0 ** 24, 2.0 ** 53  # sums below these are exact in floats of 32 and 64 bits
RESULT = "qrow long, query_id long, crow long, vec_id long, score long, salt int"


def quantise(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(row, id, v array<long>, dim): floor(scale * x) of the vectors that take part; each row has its own number."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(math.inf)))
    whole = vectors.select(F.col(id_col).alias("id"), x.alias("x")).where(
        F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size("x") > 0))
    return whole.select(F.monotonically_increasing_id().alias("row"), "id",
                        F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v"),
                        F.size("x").alias("dim"))


class SortedLists:
    """A candidate block: its matrix and, per dimension, the component values in ascending order (the lists)."""

    def __init__(self, matrix: np.ndarray):
        self.x = matrix
        self.sorted = np.sort(matrix, axis=0)
        self.kinds: dict = {}

    def bounds(self, depth: int, kind) -> tuple[np.ndarray, np.ndarray]:
        """(upper, lower) factors after ``depth`` entries of every list, read from the top and from the bottom.

        A read component is known; an unread one lies between where its list stands and where the list ends.  Columns:
        lists read from the top, then from the bottom, so they serve all queries whatever the signs of theirs.
        """
        if (depth, kind) not in self.kinds:
            x, s, n = self.x, self.sorted, len(self.x)
            top, bottom = s[n - depth], s[depth - 1]
            upper = np.hstack([np.maximum(x, top), np.minimum(x, bottom)])
            lower = np.hstack([np.where(x >= top, x, s[0]), np.where(x <= bottom, x, s[-1])])
            self.kinds[depth, kind] = upper.astype(kind), lower.astype(kind)
        return self.kinds[depth, kind]

    def contenders(self, qs: np.ndarray, k: int, settle: int, own: np.ndarray) -> list[np.ndarray]:
        """For each query, the rows that may be among its k best; row ``own`` (-1: none) takes no part."""
        n, dim = self.x.shape
        out: list = [None] * len(qs)
        left = np.arange(len(qs))
        if n > settle + 1:
            top = float(np.abs(qs).max()) * float(np.abs(self.sorted[[0, -1]]).max()) * dim
            if top >= 2.0 ** 62:
                raise OverflowError("scores of these components may not fit a long")
            kind = np.float32 if top < EXACT_32 else np.float64 if top < EXACT_64 else np.int64
            none = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
            signed = np.hstack([np.maximum(qs, 0), np.minimum(qs, 0)]).astype(kind).T  # read from the top, from the bottom
            for share in DEPTHS:
                upper, lower = (b @ signed[:, left] for b in self.bounds(max(1, int(n * share)), kind))
                mine = np.flatnonzero(own[left] >= 0)
                upper[own[left][mine], mine] = none
                lower[own[left][mine], mine] = none
                bar = np.partition(lower, n - k, axis=0)[n - k]  # the k-th best lower bound
                hope = upper >= bar
                hope[own[left][mine], mine] = False
                settled = (hope.sum(axis=0) <= settle) | (share == 1)
                for at in np.flatnonzero(settled):
                    out[left[at]] = np.flatnonzero(hope[:, at])
                left = left[~settled]
                if not len(left):
                    break
        for i in left:
            out[i] = np.delete(np.arange(n), own[i]) if own[i] >= 0 else np.arange(n)
        return out


def _best(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores; ties to the smaller id, then the smaller row."""
    return np.lexsort((rows, ids, -scores))[:k]


NO_ID = np.iinfo(np.int64).max  # stands for a null id inside a block: last among ties


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    m = np.array(pdf["v"].tolist(), dtype=np.int64)
    ids = np.array([NO_ID if x is None or x != x else int(x) for x in pdf["id"].astype(object)], dtype=np.int64)
    return pd.DataFrame({"dim": [m.shape[1]], "rows": [pdf["row"].to_numpy(np.int64).tobytes()], "ids": [ids.tobytes()],
                         "m": [m.tobytes()]})


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Pack the vectors of a length into blocks of about ``rows``: (dim, block, rows, ids, m as bytes)."""
    sizes = {r["dim"]: r["count"] for r in vectors.groupBy("dim").count().collect()}  # one row a vector length
    pieces = F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, -(-n // rows))])
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.element_at(pieces, F.col("dim"))).cast("int"))
    packed = dealt.groupBy("dim", "block").applyInPandas(
        lambda key, pdf: _pack(pdf).assign(block=np.int32(key[1])), "dim int, rows binary, ids binary, m binary, block int")
    return packed


def _search(k: int, settle: int):
    def search(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x = np.frombuffer(r.m, np.int64).reshape(-1, r.dim)
                crows, cids = np.frombuffer(r.rows, np.int64), np.frombuffer(r.ids, np.int64)
                lists = SortedLists(x)
                where = {row: i for i, row in enumerate(crows.tolist())}
                qs = np.frombuffer(r.qm, np.int64).reshape(-1, r.dim)
                qrows, qids = np.frombuffer(r.qrows, np.int64), np.frombuffer(r.qids, np.int64)
                own = np.array([where.get(row, -1) for row in qrows.tolist()])
                out = []
                for q, qrow, qid, may in zip(qs, qrows.tolist(), qids.tolist(), lists.contenders(qs, k, settle, own)):
                    scores = x[may] @ q
                    top = _best(cids[may], crows[may], scores, k)
                    out.append((np.full(len(top), qrow), np.full(len(top), qid), crows[may][top], cids[may][top], scores[top]))
                frame = {name: np.concatenate([o[i] for o in out]) for i, name in
                         enumerate(("qrow", "query_id", "crow", "vec_id", "score"))}
                yield pd.DataFrame(frame).assign(salt=np.int32(r.block % MERGE_SALTS))
    return search


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query row, ties to smaller ids.

    ``is_query`` is a condition on the column ``id``.
    """
    v = cut(quantise(vectors, id_col, vec_col, scale))
    queries = cut(_blocks(v.where(is_query), QUERY_ROWS))
    if queries.isEmpty():
        return v.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    per_dim = queries.groupBy("dim").agg(F.max("block").alias("__last"))  # one row a vector length
    blocks = _blocks(v, BLOCK_ROWS).join(small(per_dim, per_dim.count()), "dim")
    pairs = blocks.withColumn("qblock", F.explode(F.sequence(F.lit(0), "__last"))).drop("__last")
    q = queries.select("dim", F.col("block").alias("qblock"), F.col("rows").alias("qrows"), F.col("ids").alias("qids"),
                       F.col("m").alias("qm"))
    # spread the pairs of blocks over the tasks, whatever block they share
    spread = (pairs.join(q, ["dim", "qblock"])
              .repartition(int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")), "dim", "qblock", "block"))
    found = spread.mapInPandas(_search(k, max(4 * k, 32)), RESULT)
    by = [F.desc("score"), F.asc("vec_id"), F.asc("crow")]
    part = W.partitionBy("qrow", "salt").orderBy(*by)
    final = W.partitionBy("qrow").orderBy(*by)
    merged = found.withColumn("n", F.row_number().over(part)).where(F.col("n") <= k)
    ranked = merged.withColumn("rank", F.row_number().over(final).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.nullif(F.col("vec_id"), F.lit(int(NO_ID))).alias("vec_id"), "score")
