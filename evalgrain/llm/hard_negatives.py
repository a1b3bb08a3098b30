"""Hard-negative mining: bounds on inner products from segments' means and deviations, refined level by level before exact scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalgrain.llm.base import materialize
from evalgrain.llm.topk import _best, _products, usable

#: Segments of a vector at each level.
LEVELS = (1, 4, 16)
#: Rounding of a bound, as a share of the product of lengths.
_SLACK = 1e-9
#: Anchors met by a chunk at once; pairs scored at once; the share of pairs from which a whole tile is multiplied out.
_TILE, _PAIRS, _DENSE = 256, 1 << 15, 1 / 16
_BUCKETS = 64


def summaries(matrix: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the means and deviations of the vectors' segments, both times the root of the segment's length.

    Of two vectors the products of a segment's coordinates sum to (mean times mean) plus what the differences from the means
    give, which is between minus and plus (deviation times deviation): so do the sums over all segments.
    """
    x, dim = matrix.astype(np.float64), matrix.shape[1]
    out = []
    for level in LEVELS:
        start = np.unique(np.linspace(0, dim, min(level, dim), endpoint=False).astype(int)) if dim else np.empty(0, int)
        n = np.diff(np.append(start, dim)).astype(np.float64)
        mean = np.add.reduceat(x, start, axis=1) / n if dim else x
        apart = (x - np.repeat(mean, n.astype(int), axis=1)) ** 2 if dim else x
        out.append((mean * np.sqrt(n), np.sqrt(np.add.reduceat(apart, start, axis=1)) if dim else x))
    return out


def pairs_in_reach(rows: list, anchors: list, needed: Callable, seen: Callable | None = None) -> tuple[np.ndarray, np.ndarray] | np.ndarray:
    """Pairs (row, anchor) that needed(lower, upper, anchor) keeps at every level; as a mask of the tile where too many stay.

    rows, anchors: summaries(). Each level's bounds are inside those of the level before; pairs that a coarse level rules out aren't
    refined. seen, if given, gets the number of pairs that each level looks at.
    """
    r = c = mask = None
    for (mean, deviation), (of_mean, of_deviation) in zip(rows, anchors, strict=True):
        if r is None:
            middle, width = mean @ of_mean.T, deviation @ of_deviation.T
            slack = _SLACK * (np.abs(middle) + width) + 1e-6
            kept = needed(middle - width - slack, middle + width + slack, slice(None))
            mask = kept if mask is None else mask & kept
            if seen:
                seen(mask.size)
            if mask.sum() <= _DENSE * mask.size:
                r, c = np.nonzero(mask)
        else:
            if seen:
                seen(len(r))
            middle, width = _paired(mean, of_mean, r, c), _paired(deviation, of_deviation, r, c)
            slack = _SLACK * (np.abs(middle) + width) + 1e-6
            kept = needed(middle - width - slack, middle + width + slack, c)
            r, c = r[kept], c[kept]
    return mask if r is None else (r, c)


def _paired(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The inner products of a[r] and b[c], pair by pair."""
    out = np.empty(len(r), np.result_type(a, b))
    for k in range(0, len(r), _PAIRS):
        out[k : k + _PAIRS] = np.einsum("ij,ij->i", a[r[k : k + _PAIRS]], b[c[k : k + _PAIRS]])
    return out


class _Search:
    """The k best rows of each band of each anchor: `bands` (low, high, one column a band) are inclusive limits of scores."""

    def __init__(self, asked: dict, k: int, same: bool) -> None:
        self.asked, self.k, self.same = asked, k, same
        self.held: dict[tuple, tuple] = {}
        self.low = {d: a["low"].astype(np.float64) for d, a in asked.items()}

    def chunk(self, dim: int, bucket: int, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, rows: list) -> None:
        a = self.asked[dim]
        if self.same:  # labels are in order, in the rows as in the anchors
            for label in np.unique(labels[np.isin(labels, a["label"][a["bucket"] == bucket])]):
                some = slice(*np.searchsorted(labels, [label, label + 1]))
                first, last = np.searchsorted(a["label"], [label, label + 1])
                for at in range(first, last, _TILE):
                    self._tile(dim, slice(at, min(last, at + _TILE)), ids[some], None, matrix[some], [(m[some], d[some]) for m, d in rows])
        else:
            for at in range(0, len(a["id"]), _TILE):
                self._tile(dim, slice(at, at + _TILE), ids, labels, matrix, rows)

    def _tile(self, dim: int, some: slice, ids: np.ndarray, labels: np.ndarray | None, matrix: np.ndarray, rows: list) -> None:
        a = self.asked[dim]
        low, high, own, label = self.low[dim][some], a["high"][some], a["id"][some], a["label"][some]
        bands = low.shape[1]

        def needed(least: np.ndarray, most: np.ndarray, c) -> np.ndarray:
            kept = (most >= low[c, 0]) & (least <= high[c, 0])
            for j in range(1, bands):
                kept |= (most >= low[c, j]) & (least <= high[c, j])
            return kept

        left = pairs_in_reach(rows, [(m[some], d[some]) for m, d in a["summaries"]], needed)
        if isinstance(left, tuple):
            r, c = left
            score = _paired(matrix, a["matrix"][some], r, c)
        else:
            score = _products(matrix, a["matrix"][some].T)
            fit = left & (needed(score, score, slice(None)))
            r, c = np.nonzero(fit)
            score = score[r, c]
        fit = ids[r] != own[c]
        if labels is not None:
            fit &= labels[r] != label[c]
        r, c, score = r[fit], c[fit], score[fit]
        found = []
        for j in range(bands):
            at = np.flatnonzero((score >= low[c, j]) & (score <= high[c, j]))
            found.append(((c[at] + some.start) * bands + j, ids[r[at]], score[at]))
        if sum(len(x[0]) for x in found):
            key = (dim, some.start)
            best = _best([*found, *([self.held[key]] if key in self.held else [])], self.k)
            self.held[key] = best
            band, n = np.unique(best[0], return_counts=True)
            full = n == self.k
            last = best[2][np.cumsum(n) - 1]
            self.low[dim].reshape(-1)[band[full]] = np.maximum(self.low[dim].reshape(-1)[band[full]], last[full])

    def results(self) -> Iterator[pd.DataFrame]:
        for (dim, _), (band, at, score) in self.held.items():
            a = self.asked[dim]
            bands = a["low"].shape[1]
            yield pd.DataFrame({"anchor_id": a["id"][band // bands], "band": (band % bands).astype(np.int32), "vec_id": at, "score": score})


_FOUND = "anchor_id long, band int, vec_id long, score long"


def _search(shared, k: int, same: bool):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = _Search(shared.value, k, same)
        for batch in batches:
            for row in batch.itertuples():
                if row.dim in shared.value:
                    ids, labels = np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64)
                    matrix = np.frombuffer(row.matrix, np.int64).reshape(row.n, row.dim)
                    flat = np.frombuffer(row.summaries, np.float64).reshape(2 * row.n, -1)
                    edges = np.cumsum([min(level, row.dim) for level in LEVELS])[:-1]
                    parts = zip(np.split(flat[: row.n], edges, axis=1), np.split(flat[row.n :], edges, axis=1), strict=True)
                    whole.chunk(row.dim, row.bucket, ids, labels, matrix, list(parts))
        yield from whole.results()

    return search


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """A chunk as one row, by label: ids, labels, vectors and their summaries."""
    pdf = pdf.sort_values(["label", "vec_id"])
    matrix = np.array(pdf["vec"].tolist(), dtype=np.int64).reshape(len(pdf), -1)
    means, deviations = zip(*summaries(matrix), strict=True)
    both = np.concatenate([np.concatenate(means, axis=1), np.concatenate(deviations, axis=1)])
    return pd.DataFrame({
        "bucket": [int(pdf["bucket"].iat[0])], "dim": [matrix.shape[1]], "n": [len(pdf)], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
        "labels": [pdf["label"].to_numpy(np.int64).tobytes()], "matrix": [matrix.tobytes()], "summaries": [both.tobytes()],
    })


def _asked(rows: list) -> dict:
    """A block of anchors by dimension, in order of label."""
    by_dim: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.label, r.vec_id)):
        by_dim.setdefault(len(r.vec), []).append(r)
    out = {}
    for dim, some in by_dim.items():
        matrix = np.array([r.vec for r in some], np.int64).reshape(len(some), dim)
        out[dim] = {"id": np.array([r.vec_id for r in some]), "label": np.array([r.label for r in some]), "bucket": np.array([r.bucket for r in some]), "matrix": matrix, "summaries": summaries(matrix)}
    return out


def mine(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    id_col: str = "vec_id",
    label_col: str = "label",
    vec_col: str = "vec",
    chunk_rows: int = 4096,
    anchor_block: int = 16384,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its positives the hardest negatives.

    vectors and anchors hold integer ids and labels and integer vectors (array<long>); scores are inner products, which must stay below
    2**53. An anchor's positives are its `positives` best other rows of its label. A positive's negatives are the best
    rows of other labels with low_percent * positive <= 100 * negative <= high_percent * positive. Ties go to the smaller id;
    all, if there are fewer. Rows with the anchor's id are the anchor's own and take no part; of rows that repeat an anchor's id one is the
    anchor (least label, then vector), repeated candidates count each. Rows with null id, null label or unusable vector take no part; vectors meet
    those of their own dimension only. A positive without a negative gives no row; empty tables give none.

    The vectors are packed once into chunks of about chunk_rows rows of one bucket of labels (a hot label is split), with the means and
    deviations of their segments. Anchors go to the executors in blocks of anchor_block, one on the driver at a time. A chunk meets a tile of
    anchors: bounds from one segment a vector rule out pairs, finer segments more, and exact products are made of what is left; the
    k-th best scores that a task holds narrow what it still needs. A task returns `positives` rows an anchor, then `negatives` rows a positive, at most.
    """
    spark = vectors.sparkSession

    def prepare(df: DataFrame) -> DataFrame:
        own = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vec_col}`").cast("array<long>").alias("vec"))
        return own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("vec")).withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(_BUCKETS)).cast("int"))

    rows = materialize(prepare(vectors).withColumn("deal", F.xxhash64(F.monotonically_increasing_id())).withColumn("dim", F.size("vec")), "negatives-rows")
    sizes = rows.groupBy("bucket", "dim").agg(F.ceil(F.count("*") / chunk_rows).alias("chunks"))
    dealt = rows.join(sizes, ["bucket", "dim"]).withColumn("chunk", F.pmod("deal", "chunks"))
    packed = materialize(dealt.groupBy("bucket", "dim", "chunk").applyInPandas(_pack, "bucket int, dim int, n int, ids binary, labels binary, matrix binary, summaries binary"), "negatives-packed")
    own = prepare(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "vec", "bucket")).alias("r")).select("vec_id", "r.*")
    own = materialize(own, "negatives-anchors")
    n_blocks = -(-own.count() // anchor_block)
    own = own.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n_blocks))))
    by_score = Window.partitionBy("anchor_id", "band").orderBy(F.desc("score"), "vec_id")
    out = None
    for block in range(n_blocks):
        asked = _asked(own.where(F.col("block") == block).collect())
        for a in asked.values():
            a["low"], a["high"] = np.full((len(a["id"]), 1), -np.inf), np.full((len(a["id"]), 1), np.inf)
        shared = spark.sparkContext.broadcast(asked)
        found = packed.mapInPandas(_search(shared, positives, same=True), _FOUND).withColumn("at", F.row_number().over(by_score)).where(F.col("at") <= positives)
        chosen = materialize(found.select("anchor_id", (F.col("at") - 1).alias("band"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
        scores = {(r.anchor_id, r.band): r.positive_score for r in chosen.select("anchor_id", "band", "positive_score").collect()}
        shared.destroy()
        for a in asked.values():
            score = [[scores.get((i, j)) for j in range(positives)] for i in a["id"].tolist()]
            a["low"] = np.array([[np.inf if s is None else -(-low_percent * s // 100) for s in row] for row in score], np.float64)
            a["high"] = np.array([[-np.inf if s is None else high_percent * s // 100 for s in row] for row in score], np.float64)
        shared = spark.sparkContext.broadcast(asked)
        found = packed.mapInPandas(_search(shared, negatives, same=False), _FOUND).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= negatives)
        part = materialize(found.join(chosen, ["anchor_id", "band"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives-found")
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
