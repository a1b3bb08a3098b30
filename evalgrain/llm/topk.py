"""Exact top-k inner products: norm buckets, per-bucket length or coordinate pruning, exact products of what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalgrain.llm.base import materialize

#: Slack on real-valued bounds, so that rounding never prunes an exact tie.
_SLACK = 1e-9


def usable(vec) -> F.Column:
    """True for vectors that are not null and have finite components only."""
    x = F.col(vec) if isinstance(vec, str) else vec
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))


def _products(matrix: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer products; in floating point where no sum can pass 2**53."""
    if matrix.size and float(np.abs(matrix).max()) * float(np.abs(query).max(initial=0)) * max(1, len(query)) < 2.0**52:
        return (matrix.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    return matrix @ query


def survivors(norms: np.ndarray, unit: np.ndarray, query: np.ndarray, length: float, floor: float, focus: int, steep: float) -> np.ndarray:
    """Rows of a bucket (norms descending) that can still reach `floor`, by length or by coordinates.

    The bucket's cosine threshold is floor / (|q| * longest). A low one prunes little by angle: then only rows long
    enough are kept. A high one bounds each of the query's largest coordinates: a row within that angle of the query
    has cos(a + t) <= v_f <= cos(a - t), where a and t are the angles of the query's coordinate and of the threshold.
    """
    if not np.isfinite(floor) or length == 0 or floor <= 0:
        return np.arange(len(norms))
    cosine = floor / (length * norms[0]) if norms[0] > 0 else np.inf
    if cosine > 1 + _SLACK:
        return np.empty(0, np.int64)
    enough = int(np.searchsorted(-norms, -(floor / length) * (1 - _SLACK), side="right"))
    if cosine < steep:
        return np.arange(enough)
    angle = np.arccos(min(1.0, cosine))
    own = query / length
    kept = np.ones(enough, bool)
    for f in np.argsort(-np.abs(own))[:focus]:
        a = np.arccos(np.clip(own[f], -1.0, 1.0))
        high = 1.0 if a <= angle else np.cos(a - angle)
        low = -1.0 if a + angle >= np.pi else np.cos(a + angle)
        kept &= (unit[:enough, f] <= high + _SLACK) & (unit[:enough, f] >= low - _SLACK)
    return np.flatnonzero(kept)


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket chunk as one row: ids and the integer matrix, longest vectors first."""
    pdf = pdf.sort_values(["norm", "vec_id"], ascending=[False, True])
    matrix = np.array(pdf["vec"].tolist(), dtype=np.int64).reshape(len(pdf), -1)
    return pd.DataFrame({
        "bucket": [int(pdf["bucket"].iat[0])], "dim": [matrix.shape[1]], "n": [len(pdf)],
        "ids": [pdf["vec_id"].to_numpy(dtype=np.int64).tobytes()], "matrix": [matrix.tobytes()], "norms": [pdf["norm"].to_numpy(dtype=np.float64).tobytes()],
    })


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest of each query among (query, id, score) rows; ties to the smaller id."""
    query, at, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((at, -score, query))
    query, at, score = query[order], at[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.empty(0, np.int64)
    kept = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) < k
    return query[kept], at[kept], score[kept]


def chunk_products(ids: np.ndarray, matrix: np.ndarray, norms: np.ndarray, asked: tuple, k: int, focus: int, steep: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, id, score) rows of a chunk (longest first) that hold each query's k best there, if they reach its floor.

    Queries whose floor even the longest vector can't reach are left out at once. Those with a high cosine threshold prune
    by coordinates, each for itself; all others by length: they share one product with the rows that are long enough for any.
    """
    query, vectors, lengths, floors = asked
    top = lengths * norms[0]
    open_, low = ~(floors > 0) | ~np.isfinite(floors), np.where(np.isfinite(floors), floors, 0.0)
    able = open_ | (low <= top * (1 + _SLACK))
    cosine = np.where(open_ | (top == 0), 0.0, low / np.where(top > 0, top, 1.0))
    alone = np.flatnonzero(able & (cosine >= steep))
    unit = matrix / np.where(norms > 0, norms, 1.0)[:, None] if len(alone) else matrix
    for q in alone:
        at = survivors(norms, unit, vectors[q], lengths[q], floors[q], focus, steep)
        at = at[ids[at] != query[q]]
        score = _products(matrix[at], vectors[q])
        best = score >= low[q]
        yield np.full(int(best.sum()), query[q]), ids[at][best], score[best]
    flat = np.flatnonzero(able & (cosine < steep))
    needs = np.where(open_ | (lengths == 0), 0.0, low / np.where(lengths > 0, lengths, 1.0))
    flat = flat[np.argsort(-needs[flat], kind="stable")]  # a lot is pruned by the least need in it
    for first in range(0, len(flat), step := max(1, (1 << 21) // len(ids))):
        some = flat[first : first + step]
        need = needs[some].min()
        enough = int(np.searchsorted(-norms, -need * (1 - _SLACK), side="right"))
        score = _products(matrix[:enough], vectors[some].T)
        kept = ids[:enough, None] != query[some][None, :]
        if enough > k:
            others = np.where(kept, score, np.iinfo(np.int64).min)
            kept &= score >= np.partition(others, enough - k, axis=0)[enough - k]
        kept &= open_[some][None, :] | (score >= low[some][None, :])
        r, c = np.nonzero(kept)
        yield query[some][c], ids[r], score[r, c]


def _search(queries, k: int, focus: int, steep: float):
    """queries: a broadcast of {dim: (ids, matrix, lengths, floors)}. A task merges its results once a chunk, k rows a query."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [tuple(np.empty(0, np.int64) for _ in range(3))]
        for batch in batches:
            for row in batch.itertuples():
                if row.dim not in queries.value:
                    continue
                ids = np.frombuffer(row.ids, np.int64)
                matrix = np.frombuffer(row.matrix, np.int64).reshape(row.n, row.dim)
                norms = np.frombuffer(row.norms, np.float64)
                found = chunk_products(ids, matrix, norms, queries.value[row.dim], k, focus, steep)
                held = [_best([*held, *(_best([some], k) for some in found)], k)]
        query, at, score = held[0]
        yield pd.DataFrame({"query_id": query, "vec_id": at, "score": score})

    return search


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "vec",
    bucket_rows: int = 4096,
    max_buckets: int = 256,
    query_block: int = 16384,
    focus: int = 4,
    steep: float = 0.4,
) -> DataFrame:
    """Each query's k highest inner products with integer vectors (array<long>): query_id, rank from 1, vec_id, score.

    Ties go to the smaller id; all candidates if there are fewer than k; rows with the query's id are its own and take
    no part. Rows with null id or unusable vector take no part; a vector meets those of its own dimension only. Of
    rows that repeat a query's id one is the query; repeated candidates count each. Sums must stay below 2**63.

    The vectors are grouped by length into at most max_buckets buckets, each in chunks of about bucket_rows rows (rows
    of one length are split too), packed and written once. Queries go to the executors in blocks of query_block, one on the
    driver at a time. For each block the longest bucket gives a floor under the k-th score; then every chunk is pruned by it
    and the rest multiplied out. Each task returns k rows a query at most; those are ranked by query.
    """
    spark = vectors.sparkSession
    prepare = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<long>").alias("vec")).where(F.col("vec_id").isNotNull() & usable("vec"))
    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = materialize(prepare(vectors).select("vec_id", "vec", F.sqrt(squares).alias("norm"), F.xxhash64(F.monotonically_increasing_id()).alias("deal")), "topk-rows")
    n = rows.count()
    result = "query_id long, vec_id long, score long"
    cuts = sorted(set(rows.approxQuantile("norm", [i / b for i in range(1, b)], 0.001))) if (b := min(max_buckets, n // bucket_rows + 1)) > 1 else []
    bucket = sum((F.when(F.col("norm") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    rows = rows.withColumn("bucket", bucket).withColumn("dim", F.size("vec"))
    sizes = {(r.bucket, r.dim): r["count"] for r in rows.groupBy("bucket", "dim").count().collect()}
    most = max(sizes.values(), default=0)
    chunks = rows.withColumn("chunk", F.pmod("deal", F.lit(max(1, -(-most // bucket_rows)))))
    packed = materialize(chunks.groupBy("bucket", "dim", "chunk").applyInPandas(_pack, "bucket int, dim int, n int, ids binary, matrix binary, norms binary"), "topk-packed")
    longest: dict[int, int] = {}
    for found, dim in sizes:
        longest[dim] = max(found, longest.get(dim, 0))
    own = materialize(prepare(queries).groupBy("vec_id").agg(F.min("vec").alias("vec")), "topk-queries")
    n_blocks = -(-own.count() // query_block)
    asked = own.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n_blocks))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    parts = []
    for block in range(n_blocks):
        by_dim: dict[int, list] = {}
        for r in asked.where(F.col("block") == block).collect():
            by_dim.setdefault(len(r.vec), []).append((r.vec_id, r.vec))
        held = {d: (np.array([x[0] for x in q]), m := np.array([x[1] for x in q], dtype=np.int64).reshape(len(q), d), np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))) for d, q in by_dim.items()}
        open_floor = {d: (*x, np.full(len(x[0]), -np.inf)) for d, x in held.items()}
        top = packed.where(F.concat_ws(":", "dim", "bucket").isin([f"{d}:{longest[d]}" for d in held if d in longest]))
        asking = spark.sparkContext.broadcast(open_floor)
        ranked = top.mapInPandas(_search(asking, k, focus, steep), result).withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
        floors = {r.query_id: r.score for r in ranked.collect()}
        asking.destroy()
        asking = spark.sparkContext.broadcast({d: (*x, np.array([floors.get(int(q), -np.inf) for q in x[0]])) for d, x in held.items()})
        parts.append(materialize(packed.mapInPandas(_search(asking, k, focus, steep), result), "topk-found"))
        asking.destroy()
    if not parts:
        parts = [spark.createDataFrame([], result)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
