"""Word n-gram Jaccard join: count vectors in R-trees bound the overlap, group signatures say which trees a text goes to."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalgrain.llm.base import drop, materialize, partitions, recorded
from evalgrain.llm.blocks import beside_blocks, write_blocks
from evalgrain.llm.components import connected_components
from evalgrain.llm.packing import pack_ids, unpack_ids
from evalgrain.llm.words import grouped, many_word_hashes, mix, word_hashes

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Least and most bits of a count vector's coordinates; points in a leaf; ratio of the sizes that share a level.
LEAST_BITS, MOST_BITS, LEAF, RATIO = 6, 20, 32, 1.5
#: Coordinates that a task holds at once: a tile of longer vectors is searched at a lower resolution, whose bound is looser.
POINTS = 1 << 22


def shingles(w: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of word hashes; fewer words are one shingle."""
    size = min(n, len(w))
    if not size:
        return w
    x = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        x = mix((x ^ w[k : len(w) - size + 1 + k]) * _A)
    return np.unique(x)


@dataclass(frozen=True)
class Threshold:
    """Two sets are linked when den * intersection >= num * union."""

    num: int
    den: int

    def needed(self, sizes):
        """(num + den) * intersection must reach this, where sizes is the sum of both sizes."""
        return self.num * sizes

    def linked(self, both: int, sizes: int) -> bool:
        return (self.num + self.den) * both >= self.num * sizes

    def level(self, size: int) -> int:
        level = max(0, int(np.log(size) / np.log(RATIO)) - 1)
        while self.start(level + 1) <= size:
            level += 1
        return level

    def start(self, level: int) -> int:
        return int(np.ceil(RATIO**level))

    def difference(self, level: int) -> int:
        """Most elements in which linked sets can differ, if the smaller is of this level."""
        small = self.start(level + 1) - 1
        return (small + small * self.den // self.num) * (self.den - self.num) // (self.den + self.num)


def signatures(x: np.ndarray, t: Threshold) -> np.ndarray:
    """Keys of which linked but different sets share at least one.

    Each level splits the space of shingles into more groups than linked sets of that level can differ in; so one of a
    set's groups is equal in both, and its contents are hashed to a key. A set whose groups are so few that all of them
    may differ also gets the level's own key.
    """
    n = len(x)
    keys = []
    y = mix(x * _A)
    halves = (y & np.uint64(0xFFFFFFFF)).astype(np.float64), (y >> np.uint64(32)).astype(np.float64)
    for level in range(t.level(max(1, -(-n * t.num // t.den))), t.level(n) + 1):
        d = t.difference(level)
        if d == 0:
            continue
        groups = d + 2 + (3 * d + 9) // 10
        g = ((x >> np.uint64(40)) * np.uint64(groups) >> np.uint64(24)).astype(np.int64)
        first = np.flatnonzero(np.bincount(g, minlength=groups))
        # Halves of 32 bits sum exactly in floating point.
        low, high = (np.bincount(g, half, groups)[first].astype(np.uint64) for half in halves)
        keys.append(mix(mix(low * _A + mix(high)) + first.astype(np.uint64) * _B + np.array([level + 1], np.uint64) * _A))
        if len(first) <= d:
            keys.append(mix(np.array([level + 1], np.uint64) * _A))
    return np.unique(np.concatenate(keys)).view(np.int64) if keys else np.empty(0, np.int64)


def groups_of(size: int) -> int:
    """Coordinates of the count vector of a set: the power of two from its size on, so that a group holds about one element."""
    return 1 << max(LEAST_BITS, min(MOST_BITS, (size - 1).bit_length()))


def counts(x: np.ndarray) -> np.ndarray:
    """Elements in each group. Neighbouring groups are one at the next lower number of groups, see fold()."""
    groups = groups_of(len(x))
    return np.bincount((x >> np.uint64(64 - (groups.bit_length() - 1))).astype(np.int64), minlength=groups).astype(np.uint32)


def fold(v: np.ndarray, groups: int) -> np.ndarray:
    return v if len(v) == groups else v.reshape(groups, -1).sum(axis=1, dtype=v.dtype)


def shared_at_most(a: np.ndarray, b: np.ndarray) -> int:
    """The summed minima of two count vectors, at the resolution of the coarser."""
    groups = min(len(a), len(b))
    return int(np.minimum(fold(a, groups), fold(b, groups)).sum(dtype=np.int64))


class Pieces:
    """Which points are in one piece so far; pairs taken for links join pieces."""

    def __init__(self, component: np.ndarray) -> None:
        names, self.of = np.unique(component, return_inverse=True)
        self.left = len(names)

    def one(self, *points: np.ndarray) -> bool:
        return all((self.of[p] == self.of[points[0][0]]).all() for p in points)

    def join(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        """Takes pairs that join pieces, in order, till none of the pairs does."""
        out = []
        while len(open_pairs := np.flatnonzero(self.of[i] != self.of[j])):
            i, j = i[open_pairs], j[open_pairs]
            self.of[self.of == self.of[i[0]]] = self.of[j[0]]
            self.left -= 1
            out.append((int(i[0]), int(j[0])))
        return out


def forest(points: np.ndarray, sizes: np.ndarray, component: np.ndarray, t: Threshold, apart: np.ndarray | None, every: bool) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of points of different components that the bound lets pass, and whether there can be more.

    Without `every` a pair is listed only if it joins two pieces that the pairs so far (taken for links) leave apart, so at
    most as many pairs are listed as there are pieces. apart: numbers of tiles; pairs within one don't count.
    """
    pieces, out = Pieces(component), []
    for i, j in tree_pairs(points, sizes, component, t, None if every else pieces):
        if apart is not None:
            crossing = apart[i] != apart[j]
            i, j = i[crossing], j[crossing]
        out += zip(i.tolist(), j.tolist(), strict=True) if every else pieces.join(i, j)
    return out, bool(out) and not every


def tree_pairs(points: np.ndarray, sizes: np.ndarray, component: np.ndarray, t: Threshold, pieces: Pieces | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points of different components whose summed coordinate minima allow a link.

    The tree is bulk-loaded by halving at the median of the widest coordinate; a node keeps the maxima of its
    coordinates and its least and largest size. Two nodes are left out if no sizes in them fit or if the summed minima of
    their maxima are too small, or if both hold one and the same component (with pieces: piece) only.
    """

    def build(at: np.ndarray):
        high, least, most = points[at].max(axis=0), int(sizes[at].min()), int(sizes[at].max())
        if len(at) <= LEAF:
            return at, high, least, most, None
        spread = high - points[at].min(axis=0)
        by = int(np.argmax(spread))
        value = sizes[at] if most - least > spread[by] else points[at, by]
        at = at[np.argsort(value, kind="stable")]
        return at, high, least, most, (build(at[: len(at) // 2]), build(at[len(at) // 2 :]))

    known = pieces or Pieces(component)

    def possible(a, b) -> bool:
        if min(a[3], b[3]) * t.den < max(a[2], b[2]) * t.num or known.one(a[0], b[0]):
            return False
        return (t.num + t.den) * int(np.minimum(a[1], b[1]).sum(dtype=np.int64)) >= t.needed(a[2] + b[2])

    root = build(np.arange(len(points)))
    stack = [(root, root)]
    while stack:
        a, b = stack.pop()
        if not possible(a, b):
            continue
        if a[4] is None and b[4] is None:
            i, j = a[0], b[0]
            held = (known.of[i][:, None] != known.of[j][None, :]) & (t.den * np.minimum(sizes[i][:, None], sizes[j][None, :]) >= t.num * np.maximum(sizes[i][:, None], sizes[j][None, :]))
            if a is b:
                held &= np.tri(len(i), k=-1, dtype=bool)
            p, q = np.nonzero(held)
            # A few rows at a time: a long vector times all pairs of two leaves would be large.
            for k in range(0, len(p), step := max(1, (1 << 19) // points.shape[1])):
                x, y = i[p[k : k + step]], j[q[k : k + step]]
                fits = (t.num + t.den) * np.minimum(points[x], points[y]).sum(axis=1, dtype=np.int64) >= t.needed(sizes[x] + sizes[y])
                if fits.any():
                    yield x[fits], y[fits]
        elif a is b:
            stack += [(a[4][0], a[4][1]), (a[4][0], a[4][0]), (a[4][1], a[4][1])]
        elif b[4] is None or (a[4] is not None and len(a[0]) >= len(b[0])):
            stack += [(c, b) for c in a[4]]
        else:
            stack += [(a, c) for c in b[4]]


def _keys(n: int, t: Threshold):
    """Signatures of a block's nodes, those of the same nodes in one row: frequent ones leave a block once each."""

    def keys(rows: pa.Table, firsts: pa.Table) -> pa.Table:
        rows = _of(rows, firsts)
        nodes = rows.column("node").to_numpy()
        found = [signatures(shingles(w, n), t) for w in many_word_hashes(rows.column("text").to_pylist())]
        every = np.concatenate([np.empty(0, np.int64), *found])
        owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
        order = np.lexsort((owner, every))
        every, owner = every[order], owner[order]
        start = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, np.int64)
        size = np.diff(np.append(start, len(every)))
        single = start[size == 1]
        by_nodes: dict[bytes, list[int]] = {}
        own = single[np.argsort(owner[single], kind="stable")]
        for part in np.split(own, np.flatnonzero(np.diff(owner[own])) + 1) if len(own) else ():
            by_nodes[nodes[owner[part[:1]]].tobytes()] = every[part].tolist()
        for at, k in zip(start[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            by_nodes.setdefault(np.sort(nodes[owner[at : at + k]]).tobytes(), []).append(int(every[at]))
        members = [np.frombuffer(x, np.int64).tolist() for x in by_nodes]
        kind = pa.list_(pa.int64())
        return pa.table({"nodes": pa.array(members, kind), "keys": pa.array(list(by_nodes.values()), kind)})

    return keys


def _of(rows: pa.Table, wanted: pa.Table) -> pa.Table:
    return rows.filter(pc.is_in(rows.column("node"), value_set=wanted.column("node").combine_chunks()))


def _texts_of(rows: pa.Table, wanted: pa.Table) -> pa.Table:
    return _of(rows, wanted).select(["node", "text"])


def _verify(n: int, t: Threshold):
    """Rows sorted by (b, salt, kind): the text of b (kind 0), then those of the nodes a it is held against."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = np.empty(0, np.uint64)
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for k, (a, text) in enumerate(zip(batch.column("a"), batch.column("text"), strict=True)):
                x = shingles(word_hashes(text.as_py()), n)
                if not a.is_valid:
                    other = x
                else:
                    both = len(np.intersect1d(x, other, assume_unique=True))
                    ok[k] = t.linked(both, len(x) + len(other))
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return verify


def _trees(t: Threshold, every: bool):
    """Rows sorted by tile to candidate pairs: a row for each, with whether its tile can have more."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members, first, second, rows in grouped(batches, ("members", "first", "second")):
            n = rows.column("n").to_numpy().astype(np.int64)
            groups = min(groups_of(int(n.min())), 1 << max(LEAST_BITS, (POINTS // len(n)).bit_length() - 1))
            points = np.empty((len(n), groups), np.uint32)
            for k, packed in enumerate(rows.column("counts")):
                points[k] = fold(unpack_ids(packed.as_py()), groups)
            node, tile = rows.column("node").to_numpy(), rows.column("tile").to_numpy()
            found, more = forest(points, n, rows.column("component").to_numpy(), t, tile if first != second else None, every)
            if found:
                i, j = np.array(found, np.int64).T
                a, b = np.maximum(node[i], node[j]), np.minimum(node[i], node[j])
                same = [pa.array(np.full(len(a), x), kind) for x, kind in ((members, pa.int64()), (first, pa.int32()), (second, pa.int32()))]
                yield pa.record_batch([pa.array(a), pa.array(b), *same, pa.array(np.full(len(a), more))], ["a", "b", "members", "first", "second", "more"])

    return search


@dataclass
class Joined:
    """rows: the documents, written, with block, row, n, h1, h2; labels: each set's component."""

    rows: DataFrame
    labels: DataFrame
    columns: list[str]


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", tile_rows: int = 4096) -> Joined:
    """Components of the documents whose sets of n-word shingles have a Jaccard similarity of num/den or more.

    1. Texts are shingled and written with the set's size, hash and count vector (as many groups as the set has elements,
       up to a power of two); equal sets become one node.
    2. A node goes to one block per signature, so linked nodes meet in a block (see signatures()); blocks with the
       same members are one. A frequent signature leaves each 2,048 rows once, with the nodes that have it.
    3. In each block every node is held against the first: the count vectors bound the overlap, then the shingles are
       compared. The links' components usually make a block one piece, however many copies it holds.
    4. Blocks that are still in pieces are searched by an R-tree over count vectors for pairs across pieces; large ones
       in tiles. First a tile lists only pairs that would join its pieces (see forest()); those confirmed join them, and only
       tiles that hold more pairs between pieces that are still apart are searched again, the second time for all of them.

    So no link between different pieces is lost, and no copies are paired with each other. Null and empty texts have
    the empty set and are linked with nothing; ids may repeat or be null; an empty table gives empty results; all
    columns of docs are kept, whatever their names. Tables written on the way are dropped as soon as they are used.
    """
    t, spark = Threshold(num, den), docs.sparkSession
    rows = _written(docs, id_col, text_col, n)
    with recorded() as made:
        sets = rows.where("n > 0").select("h1", "h2", "n", "doc_id", "node")
        classes = materialize(sets.groupBy("h1", "h2", "n").agg(F.min("node").alias("node"), F.min("doc_id").alias("least_id")), "sets")
        texts = rows.select("block", "node", "text")
        meta = rows.select("node", "n", "counts").join(classes.select("node"), "node", "left_semi")
        blocks = materialize(_blocks(texts, classes, n, t), "blocks")

        stars = blocks.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
        links = _checked(_bounded(stars, meta, t), texts, n, t)
        found = connected_components(links)
        tiles = _tiles(blocks, found, meta, tile_rows)
        for every in (False, True):
            dealt = tiles.repartition(4 * partitions(spark), "members", "first", "second").sortWithinPartitions("members", "first", "second", "node")
            pairs = materialize(dealt.mapInArrow(_trees(t, every), "a long, b long, members long, first int, second int, more boolean"), "tree-pairs")
            more = _checked(pairs.select("a", "b").distinct(), texts, n, t)
            if not more.isEmpty():
                links = links.unionByName(more)
                found = connected_components(links)
            again = pairs.where("more").select("members", "first", "second").distinct()
            if every or again.isEmpty():
                break
            tiles = _tiles(blocks.join(again.select("members").distinct(), "members", "left_semi"), found, meta, tile_rows).join(again, ["members", "first", "second"], "left_semi")

        named = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
        labels = named.join(least, "component").select("h1", "h2", "n", "component", "component_id")
    labels = materialize(labels, "labels")
    drop(spark, made)
    return Joined(rows, labels, docs.columns)


def _blocks(texts: DataFrame, classes: DataFrame, n: int, t: Threshold) -> DataFrame:
    """members (a number of the block), node, center: the nodes that share a signature, a row each."""
    dealt = beside_blocks(texts, classes.select("node"), _keys(n, t), "nodes array<long>, keys array<long>")
    mark = F.aggregate("nodes", F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(F.xxhash64(x)))
    dealt = dealt.select(F.element_at("nodes", 1).alias("first"), F.when(F.size("nodes") > 1, F.col("nodes")).alias("nodes"), mark.alias("mark"), F.explode("keys").alias("key"))
    whole = Window.partitionBy("key")
    seen = dealt.select("first", "nodes", F.min("first").over(whole).alias("center"), F.max("first").over(whole).alias("top"), F.bit_xor("mark").over(whole).alias("members"))
    shared = seen.where("center < top OR nodes IS NOT NULL").select("members", "center", F.coalesce("nodes", F.array("first")).alias("nodes")).distinct()
    return shared.select("members", F.explode("nodes").alias("node"), "center").distinct()


def _tiles(blocks: DataFrame, found: DataFrame, meta: DataFrame, tile_rows: int) -> DataFrame:
    """The nodes of blocks that are in pieces, once for each pair (first, second) of the block's tiles that theirs is in."""
    placed = blocks.join(found, "node", "left").select("members", "node", F.coalesce("component", "node").alias("component"))
    split = placed.groupBy("members").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high")
    rows = placed.join(split.select("members", "size"), "members").join(meta, "node")
    tiles = F.ceil(F.col("size") / F.lit(tile_rows)).cast("int")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("node"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    return rows.select("members", "node", "component", "n", "counts", "tile", F.least("tile", "other").alias("first"), F.greatest("tile", "other").alias("second"))


def _written(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """The documents in blocks, with the profile of their shingles."""

    @F.pandas_udf("n int, h1 long, h2 long, counts binary")
    def profile(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for w in many_word_hashes(texts):
                x = shingles(w, n)
                h1 = mix(x * _B).sum(dtype=np.uint64).astype(np.int64)
                h2 = np.bitwise_xor.reduce(mix(x * _A), initial=np.uint64(0)).astype(np.int64)
                out.append((len(x), int(h1), int(h2), pack_ids(counts(x), 1)))
            yield pd.DataFrame(out, columns=["n", "h1", "h2", "counts"])

    names = [f"c{k}" for k in range(len(docs.columns))]
    shaped = docs.toDF(*names)
    own, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    shaped = shaped.select(*names, own.alias("doc_id"), text.cast("string").alias("text")).withColumn("p", profile("text"))
    return write_blocks(shaped.select(*names, "doc_id", "text", "p.n", "p.h1", "p.h2", "p.counts"), "ngram", names)


def _bounded(pairs: DataFrame, meta: DataFrame, t: Threshold) -> DataFrame:
    """The pairs (a, b) that their count vectors allow to be linked."""

    @F.pandas_udf("boolean")
    def fits(n_a: pd.Series, counts_a: pd.Series, n_b: pd.Series, counts_b: pd.Series) -> pd.Series:
        ok, last, y = np.zeros(len(n_a), bool), None, None
        for k, (p, c, q, d) in enumerate(zip(n_a.tolist(), counts_a, n_b.tolist(), counts_b, strict=True)):
            if min(p, q) * t.den >= max(p, q) * t.num:
                last, y = (last, y) if d == last else (d, unpack_ids(d))
                ok[k] = (t.num + t.den) * shared_at_most(unpack_ids(c), y) >= t.needed(p + q)
        return pd.Series(ok)

    side = lambda c: meta.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("counts").alias(f"counts_{c}"))
    held = pairs.join(side("a"), "a").join(side("b"), "b")
    return held.where(fits("n_a", "counts_a", "n_b", "counts_b")).select("a", "b")


def _checked(pairs: DataFrame, rows: DataFrame, n: int, t: Threshold, most: int = 1024) -> DataFrame:
    """The pairs (a, b) that are linked, by their shingles, written.

    The texts are fetched by block. That of a node b goes once, not once a pair, to each lot of about `most` of its pairs, so
    a node with many pairs is dealt over tasks, and a task streams through its lots.
    """
    spark = rows.sparkSession
    with recorded() as made:
        pairs = materialize(pairs, "pairs")
        needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = beside_blocks(rows, needed, _texts_of, "node long, text string")
        lots = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("lots"))
        salted = pairs.join(lots, "b").select("a", "b", F.pmod(F.xxhash64("a"), "lots").cast("int").alias("salt"))
        ours = salted.join(texts.withColumnRenamed("node", "a"), "a").select("b", "salt", F.lit(1).alias("kind"), "a", "text")
        theirs = lots.select("b", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("salt")).join(texts.withColumnRenamed("node", "b"), "b")
        both = ours.unionByName(theirs.select("b", "salt", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("a"), "text"))
        dealt = both.repartition(partitions(spark), "b", "salt").sortWithinPartitions("b", "salt", "kind")
        checked = dealt.select("a", "b", "text").mapInArrow(_verify(n, t), "a long, b long")
    checked = materialize(checked, "links")
    drop(spark, made)
    return checked


def components(joined: Joined) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links, its own included) of every document."""
    rows = joined.rows.select("doc_id", "n", "h1", "h2")
    labels = joined.labels.select("n", "h1", "h2", "component_id")
    out = rows.where("n > 0").join(labels, ["n", "h1", "h2"]).select("doc_id", "n", "component_id")
    out = out.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(joined: Joined) -> DataFrame:
    """The documents, all columns, without those whose component has another with a smaller id (of equal ids any one)."""
    rows = joined.rows.where("n > 0").select("n", "h1", "h2", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node").alias("rank"))
    by_set = rows.groupBy("n", "h1", "h2").agg(F.min("rank").alias("rank"))
    kept = by_set.join(joined.labels, ["n", "h1", "h2"]).groupBy("component").agg(F.min("rank").alias("rank")).select("rank.node")
    kept = kept.unionByName(joined.rows.where("n = 0").select("node"))
    names = [f"c{k}" for k in range(len(joined.columns))]
    schema = joined.rows.select(*names).schema
    docs = beside_blocks(joined.rows.select("block", "node", *names), kept, lambda a, b: _of(a, b).select(names), schema)
    return docs.toDF(*joined.columns)
