"""Line dedup: equal lines, and lines a few words apart by a deletion-neighbourhood join; the earliest line stays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, islice, product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrain.llm.base import drop, materialize, materialize_by_block, partitions, recorded, without
from evalgrain.llm.blocks import BLOCK_BITS, beside_blocks, block_of, write_blocks
from evalgrain.llm.packing import pack_ids, unpack_ids
from evalgrain.llm.words import grouped, lots, mix, powers, prefix_sums, sum_hashes, words_of

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: What is cut off a line's ends before it is compared, and what parts words.
BLANK = " \t\r\x0b\x0c"
_BLANK = BLANK.encode()
_ORDER = "struct<none:boolean,doc_id:{id},line:int,node:long>"
#: Lines of a key that are held against each other (those of a key with more emit variants of single words), characters
#: profiled at once, and near lines that a line lists for a key.
MOST, LOT, LISTED = 1024, 1 << 22, 4


@dataclass(frozen=True)
class Bound:
    """Two lines are near if they are at most edits(words of the shorter one) words apart: replaced, left out or put in."""

    max_edits: int
    words_per_edit: int

    def edits(self, words):
        return np.minimum(self.max_edits, words // self.words_per_edit)


def split_lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def _hash_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number and both 64-bit halves of the hash of each line that isn't blank."""
    for batch in batches:
        first = 0
        for lot in lots(batch["text"]):
            own, line, digests = [], [], []
            for k, data in enumerate(lot):
                for n, part in enumerate(data.split(b"\n")):
                    if part := part.strip(_BLANK):
                        own.append(first + k)
                        line.append(n)
                        digests.append(xxhash.xxh3_128_digest(part))
            first += len(lot)
            h = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
            rows = batch.iloc[own]
            yield pd.DataFrame({"node": rows["node"].to_numpy(), "doc_id": rows["doc_id"].reset_index(drop=True), "line": np.array(line, np.int32), "h1": h[:, 0], "h2": h[:, 1]})


def line_words(line: str) -> list[bytes]:
    return line.encode("utf-8", "surrogatepass").split()


def hashed_words(line: str) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x) for x in line_words(line)], np.uint64)


def segment_variants(data: bytes, bound: Bound) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variants of the lines of some text with runs of words deleted: key, number of the line, and whether it is an own one.

    The shorter of two near lines, with n words and e = bound.edits(n), is cut into e + 1 segments. At most e of them are
    touched by edits, so deleting these leaves one segment that lies unchanged in the other line, near its place. So a line
    emits what is left when all its segments but one are deleted (its own variants), and the same segments of each shorter
    length that a near line can have, at each place to which the edits around it can move one; n and the number of the
    segment are in the key. An own variant of one near line is a variant of the other. All lines are worked out at once.
    """
    sizes = np.cumsum([len(p) + 1 for p in data.split(b"\n")])
    places, words = words_of(data)
    sums = prefix_sums(words)
    first = np.searchsorted(places, np.concatenate([[0], sizes[:-1]]))
    n = np.searchsorted(places, sizes) - first
    keys, lines, own = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
    for more in range(bound.max_edits + 1):
        edits = bound.edits(n - more)
        for e in range(max(1, more), bound.max_edits + 1):
            at = np.flatnonzero((edits == e) & (n - more > e))
            base, begin, size = n[at] - more, first[at], n[at]
            for i in range(e + 1 if len(at) else 0):
                start = base * i // (e + 1)
                length = base * (i + 1) // (e + 1) - start
                salt = mix((base * (e + 1) + i).astype(np.uint64) + _A)
                for move in range(max(-i, more - (e - i)), min(i, more + (e - i)) + 1):
                    x = start + move
                    ok = np.flatnonzero((x >= 0) & (x + length <= size))
                    a = begin[ok] + x[ok]
                    keys.append(mix(sum_hashes(sums, a, a + length[ok]) + salt[ok]))
                    lines.append(at[ok])
                    own.append(np.full(len(ok), more == 0 and move == 0))
    return np.concatenate(keys), np.concatenate(lines), np.concatenate(own)


def edit_variants(words: np.ndarray, edits: int, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray]]:
    """(marked, left out, keys) of some hashed words with up to `edits` of them marked in place or left out.

    Two lines are at most `edits` words apart just if they share a key with one number marked, and this and what both leave
    out are at most `edits` together: a replaced word is marked in both lines, one put in or left out is missing in one.
    At most about `most` keys come at once.
    """
    n = len(words)
    up, down = powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:n])])
    for number in range(min(edits, n) + 1):
        places = combinations(range(n), number)
        while len(lot := list(islice(places, max(1, most // (1 << number))))):
            at = np.array(lot, np.int64).reshape(len(lot), number)
            for kinds in product((0, 1), repeat=number):
                gone, last = 0, np.zeros(len(lot), np.int64)
                total = np.zeros(len(lot), np.uint64)
                for column, out in enumerate(kinds):
                    p = at[:, column]
                    total += (sums[p] - sums[last]) * down[gone]
                    if out:
                        gone += 1
                    else:
                        total += _B * up[p] * down[gone]
                    last = p + 1
                total += (sums[n] - sums[last]) * down[gone]
                marked = number - gone
                yield marked, gone, mix(total + mix(np.full(1, ((n - gone) << 8) + marked, np.uint64))).view(np.int64)


def within(a: list, b: list, edits: int) -> bool:
    """Whether the word edit distance is at most `edits`: only the diagonals that so many edits can reach are filled."""
    n, m = len(a), len(b)
    if abs(n - m) > edits:
        return False
    # reach[d]: how far into a the diagonal d can be followed with the edits so far.
    reach: dict[int, int] = {}
    for used in range(edits + 1):
        made = {}
        for d in range(-used, used + 1):
            x = min(max(reach.get(d, -1) + 1, reach.get(d - 1, 0), reach.get(d + 1, -1) + 1), n, m - d)
            if x < 0:
                continue
            while x < n and x + d < m and a[x] == b[x + d]:
                x += 1
            made[d] = x
        reach = made
        if reach.get(m - n, -1) >= n:
            return True
    return False


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 2, words_per_edit: int = 5) -> DataFrame:
    """docs without lines that an earlier line repeats, plus n_lines and n_dropped (longs); all rows are kept.

    Lines are parted by '\\n' and compared without blanks at their ends. A line goes if an earlier line that stays is equal
    or near: at most max_edits words apart (replaced, left out or put in), and at most one for each words_per_edit words of
    the shorter line (so at most a fifth of it; of lines of fewer words only equal ones are near). Earlier: smaller id (null
    last), then smaller line number, then any fixed order. Blank lines stay. Texts without a dropped line stay as they are;
    null texts stay null with no lines; repeated rows repeat each other's lines; columns named n_lines and n_dropped are
    replaced, whatever their case; an empty table gives an empty result.

    Plan: the rows are written once in blocks. Distinct lines are found by 128-bit hashes with partial sums. Each distinct
    line emits segment_variants(), packed by block and exchanged by hash; lines that share one are fetched and compared
    word by word with the earlier lines of the key. Keys of more than MOST lines aren't searched so: their lines emit all
    variants of single words (edit_variants()), of which a key's lines are all near. Each line lists the first LISTED near
    lines before it, and others only when all of these go; so no group is paired with itself. From these lists it follows round by
    round which lines stay (_settled()), and the lines to drop go back to the blocks.
    """
    if max_edits < 0 or words_per_edit < 1:
        raise ValueError("max_edits is 0 or more, words_per_edit 1 or more")
    bound, spark = Bound(max_edits, words_per_edit), docs.sparkSession
    keep = without(docs.columns, "n_lines", "n_dropped")
    rows = write_blocks(docs.select(*[F.col(f"`{c}`") for c in keep]), "lines", keep)
    text, doc = f"c{keep.index(text_col)}", f"c{keep.index(id_col)}"
    id_type = docs.schema[id_col].dataType.simpleString()
    with recorded() as made:
        texts = rows.select("node", F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"))
        lines = materialize(texts.mapInPandas(_hash_rows, f"node long, doc_id {id_type}, line int, h1 long, h2 long"), "line-hashes")
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line", "node").cast(_ORDER.format(id=id_type))
        distinct = materialize(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("uses")), "distinct-lines")
        known = distinct.select("first", F.col("first.node").alias("node"), F.col("first.line").alias("line"))
        near = _near(rows, known, text, bound) if max_edits else known.select("node", "line").limit(0)
        near = near.select(F.col("node").alias("at_node"), F.col("line").alias("at_line"), F.lit(True).alias("near"))
        at = [F.col("first.node") == F.col("at_node"), F.col("first.line") == F.col("at_line")]
        acted = distinct.join(near, at, "left").where("uses > 1 OR near").select("h1", "h2", "first", "near")
        again = lines.select("h1", "h2", "node", "line").join(acted, ["h1", "h2"])
        is_first = (F.col("node") == F.col("first.node")) & (F.col("line") == F.col("first.line"))
        drops = again.where(F.coalesce("near", ~is_first)).select("node", "line")
    drops = materialize(drops, "dropped-lines")
    drop(spark, made)

    fields = [T.StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(keep)]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    out = beside_blocks(rows, drops, _rebuild(text, [f.name for f in schema]), schema)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], "n_lines", "n_dropped")


def _rebuild(text: str, names: list[str]):
    def rebuild(rows: pa.Table, drops: pa.Table) -> pa.Table:
        gone: dict[int, set[int]] = {}
        for node, line in zip(drops.column("node").to_pylist(), drops.column("line").to_pylist(), strict=True):
            gone.setdefault(node, set()).add(line)
        texts, n_lines = [], []
        for node, value in zip(rows.column("node").to_pylist(), rows.column(text).to_pylist(), strict=True):
            parts = split_lines(value)
            n_lines.append(0 if value is None else len(parts))
            out = gone.get(node)
            texts.append("\n".join(p for k, p in enumerate(parts) if k not in out) if out else value)
        made = rows.set_column(rows.column_names.index(text), text, pa.array(texts, pa.string()))
        made = made.append_column("n_lines", pa.array(n_lines, pa.int64()))
        n_dropped = [len(gone.get(node, ())) for node in rows.column("node").to_pylist()]
        return made.append_column("n_dropped", pa.array(n_dropped, pa.int64())).select(names)

    return rebuild


def _lines_of(rows: pa.Table, text: str, node: list[int], line: list[int]) -> list[str]:
    """The lines wanted of a block, without blanks at their ends; wanted is sorted by node."""
    want: dict[int, list[int]] = {}
    for k, at in enumerate(node):
        want.setdefault(at, []).append(k)
    found = [""] * len(node)
    if want:
        rows = rows.filter(pc.is_in(rows.column("node"), value_set=pa.array(list(want), pa.int64())))
        for at, value in zip(rows.column("node").to_pylist(), rows.column(text).to_pylist(), strict=True):
            parts = split_lines(value)
            for k in want[at]:
                found[k] = parts[line[k]].strip(BLANK)
    return found


def _fetch_lines(text: str, keep: tuple[str, ...]):
    """The texts of the wanted lines of a block."""

    def fetch(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        found = _lines_of(rows, text, wanted.column("node").to_pylist(), wanted.column("line").to_pylist())
        return wanted.select(list(keep)).append_column("text", pa.array(found, pa.string()))

    return fetch


_PACKED = "bucket int, crowded boolean, block long, keys binary, places binary, lines binary, own binary"


def _packed_variants(text: str, bound: Bound, buckets: int, most: int):
    """The segment variants of a block's wanted lines, a row for each bucket of keys: sorted keys, and line and row of each.

    Of a key that more than `most` of the block's lines have, so many and one go to its bucket, which shows there that
    the key is crowded; the others go anywhere, marked so. So a key's bucket gets a bounded number from each block.
    """

    def pack(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        wanted = wanted.sort_by([("node", "ascending"), ("line", "ascending")])
        node, line = (wanted.column(c).to_numpy() for c in ("node", "line"))
        found = _lines_of(rows, text, node.tolist(), line.tolist())
        keys, at, own, first = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, bool)], 0
        ends = np.cumsum([len(x) + 1 for x in found])
        while first < len(found):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + LOT)))
            k, x, o = segment_variants("\n".join(found[first:last]).encode("utf-8", "surrogatepass"), bound)
            keys.append(k)
            at.append(x + first)
            own.append(o)
            first = last
        keys, at, own = np.concatenate(keys), np.concatenate(at), np.concatenate(own)
        order = np.argsort(keys, kind="stable")
        keys, at, own = keys[order], at[order], own[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        rank = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))
        # An own variant among those that go to the bucket shows that the key counts.
        own = np.maximum.reduceat(own, starts)[np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))] & (rank == 0) | own if len(keys) else own
        block = int(node[0]) >> BLOCK_BITS if len(node) else 0
        bucket = (keys >> np.uint64(40)).astype(np.int64) % buckets
        out = []
        for crowded in (False, True):
            chosen = np.flatnonzero((rank > most) == crowded)
            b = np.full(len(chosen), block % buckets) if crowded else bucket[chosen]
            chosen, b = chosen[order := np.argsort(b, kind="stable")], b[order]
            for part in np.split(chosen, np.flatnonzero(np.diff(b)) + 1) if len(chosen) else ():
                places, numbers = node[at[part]] & ((1 << BLOCK_BITS) - 1), line[at[part]]
                to = block % buckets if crowded else int(bucket[part[0]])
                out.append((to, crowded, block, keys[part].tobytes(), pack_ids(places, 1, 2), pack_ids(numbers, 1), np.packbits(own[part]).tobytes()))
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = [pa.int32(), pa.bool_(), pa.int64(), *[pa.binary()] * 4]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _PACKED.split(", ")])

    return pack


def _shared_variants(most: int):
    """Sorted by bucket: the variants of keys that several lines have and that are one of them's own; crowded if more than `most` have it."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, ("bucket",)):
            packed = [rows.column(c).to_pylist() for c in ("block", "crowded", "keys", "places", "lines", "own")]
            keys, node, line, own, crowded = [], [], [], [], []
            for block, many, k, places, lines, o in zip(*packed, strict=True):
                k = np.frombuffer(k, np.uint64)
                keys.append(k)
                node.append((np.int64(block) << BLOCK_BITS) + unpack_ids(places, 2).astype(np.int64))
                line.append(unpack_ids(lines).astype(np.int32))
                own.append(np.unpackbits(np.frombuffer(o, np.uint8), count=len(k)).astype(bool))
                crowded.append(np.full(len(k), many))
            keys, node, line, own, crowded = map(np.concatenate, (keys, node, line, own, crowded))
            order = np.lexsort((keys, crowded))
            keys, node, line, own, crowded = keys[order], node[order], line[order], own[order], crowded[order]
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (crowded[1:] != crowded[:-1])]))
            size = np.diff(np.append(starts, len(keys)))
            live = (size > 1) & np.logical_or.reduceat(own, starts) | crowded[starts]
            live, many = np.repeat(live, size), np.repeat(size > most, size) | crowded
            yield pa.record_batch([pa.array(keys[live].view(np.int64)), pa.array(node[live]), pa.array(line[live]), pa.array(own[live]), pa.array(many[live])], ["key", "node", "line", "own", "crowded"])

    return shared


def _near(rows: DataFrame, known: DataFrame, text: str, bound: Bound) -> DataFrame:
    """node, line of the distinct lines that an earlier line that stays is near to."""
    n = partitions(rows.sparkSession)
    first = known.schema["first"].dataType
    packed = beside_blocks(rows, known.select("node", "line"), _packed_variants(text, bound, n, MOST), _PACKED)
    dealt = packed.repartition(n, "bucket").sortWithinPartitions("bucket")
    shared = materialize(dealt.mapInArrow(_shared_variants(MOST), "key long, node long, line int, own boolean, crowded boolean"), "shared-variants")
    wanted = shared.groupBy("node", "line").agg(F.bool_or("crowded").alias("crowded")).join(known, ["node", "line"])
    fetched = T.StructType([known.schema["first"], T.StructField("crowded", T.BooleanType()), T.StructField("text", T.StringType())])
    texts = beside_blocks(rows, wanted, _fetch_lines(text, ("first", "crowded")), fetched)
    texts = materialize_by_block(texts.withColumn("block", block_of(F.col("first.node"))), "shared-texts", n)

    crowded = texts.where("crowded").select("first", "text").repartition(n)
    variant = T.StructType([T.StructField("key", T.LongType()), T.StructField("marked", T.ByteType()), T.StructField("gone", T.ByteType()), T.StructField("words", T.IntegerType()), T.StructField("first", first)])
    emitted = crowded.mapInArrow(_edit_rows(bound), variant)
    if not crowded.isEmpty():
        emitted = materialize(emitted, "word-variants")

    few = shared.where("NOT crowded").select("key", "own", "node", "line")
    many = emitted.select("key", "marked", "gone", "words", "first", F.col("first.node").alias("node"), F.col("first.line").alias("line"))
    told = T.StructType([*few.schema, T.StructField("asks", T.BooleanType()), known.schema["first"], T.StructField("text", T.StringType())])
    listed = "node long, line int, other_node long, other_line int, more boolean"

    def near_lines(state: DataFrame | None) -> DataFrame:
        """The first LISTED near lines before each line, for each key; more: there may be others.

        Given states, only for the lines that want others, and among the lines that don't go.
        """
        sides = [(beside_blocks(texts, _asking(few, state), _beside_lines([f.name for f in told]), told), _compared), (_asking(many, state), _met)]
        found = [side.repartition(n, "key").sortWithinPartitions("key", "first").drop("first").mapInArrow(function(bound, LISTED), listed) for side, function in sides]
        return found[0].unionByName(found[1]).groupBy("node", "line", "other_node", "other_line").agg(F.bool_or("more").alias("more"))

    return _settled(near_lines)


def _asking(side: DataFrame, state: DataFrame | None) -> DataFrame:
    """The rows (key, node, line and others) of the keys that a line which wants others has, without lines that go; asks: whether a row is such a line's."""
    if state is None:
        return side.withColumn("asks", F.lit(True))
    here = ["node", "line"]
    keys = side.join(state.where("state = 'longer'").select(*here), here, "left_semi").select("key").distinct()
    known = side.join(keys, "key", "left_semi").join(state, here, "left").where("state IS NULL OR state <> 'goes'")
    return known.withColumn("asks", F.coalesce(F.col("state") == "longer", F.lit(False))).select(*side.columns, "asks")


def _beside_lines(names: list[str]):
    """The variants of a block with the places and texts of their lines."""

    def beside(lines: pa.Table, variants: pa.Table) -> pa.Table:
        at: dict[tuple[int, int], int] = {}
        if variants.num_rows:
            at = {(x["node"], x["line"]): k for k, x in enumerate(lines.column("first").to_pylist())}
        own = zip(variants.column("node").to_pylist(), variants.column("line").to_pylist(), strict=True)
        found = lines.take(pa.array([at[x] for x in own], pa.int64()))
        return variants.append_column("first", found.column("first")).append_column("text", found.column("text")).select(names)

    return beside


def _settled(near_lines) -> DataFrame:
    """node, line of the lines that go: near to an earlier line that stays.

    A line without a near line before it stays. Round by round, a line goes if one listed before it stays; it stays if all
    of these go and there are no others; if there may be, it lists others, of those that don't go. The number of rounds is
    the longest chain of lines each of which depends on the one before. Only counts reach the driver.
    """
    here = ["node", "line"]
    edges = materialize(near_lines(None), "near-lines")
    state = materialize(edges.select(*here).distinct().withColumn("state", F.lit("open")), "line-states")
    while state.where("state = 'open'").limit(1).count():
        left = edges.join(state.where("state = 'open'").select(*here), here)
        other = state.select(F.col("node").alias("other_node"), F.col("line").alias("other_line"), F.col("state").alias("other"))
        seen = left.join(other, ["other_node", "other_line"], "left").groupBy(*here).agg(
            F.bool_or(F.col("other").isNull() | (F.col("other") == "stays")).alias("goes"), F.bool_or(F.coalesce(F.col("other") == "open", F.lit(False))).alias("waits"), F.bool_or("more").alias("more")
        )
        now = F.when(F.col("goes"), "goes").when(F.col("waits"), "open").when(F.col("more"), "longer").otherwise("stays")
        state = materialize(state.where("state <> 'open'").unionByName(seen.select(*here, now.alias("state"))), "line-states")
        if state.where("state = 'longer'").limit(1).count():
            edges = materialize(near_lines(state), "near-lines").unionByName(edges.join(state.where("state = 'open'").select(*here), here, "left_semi"))
            listing = edges.select(*here).distinct().withColumn("lists", F.lit(True))
            again = state.join(listing, here, "left")
            # A line that finds no others stays.
            state = materialize(again.select(*here, F.when(F.col("state") != "longer", F.col("state")).when(F.col("lists"), "open").otherwise("stays").alias("state")), "line-states")
    return state.where("state = 'goes'").select(*here)


def _listing(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [()] * 5
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["node", "line", "other_node", "other_line", "more"])


def _compared(bound: Bound, most: int):
    """Rows sorted by key, the earliest line first: the near lines before each line that asks among those of a key, word by word.

    In a larger group words are hashed into a count vector for each line; a pair whose counts differ by more than twice the
    edits is left out.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, rows in grouped(batches, ("key",)):
            node, line, own, asks = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("node", "line", "own", "asks"))
            words = [line_words(x) for x in rows.column("text").to_pylist()]
            n = np.array([len(w) for w in words])
            counts = np.array([np.bincount([hash(x) & 63 for x in w], minlength=64) for w in words], np.int16) if len(words) > 4 else None
            for k in np.flatnonzero(asks[1:]) + 1:
                edits = bound.edits(np.minimum(n[:k], n[k]))
                fits = (own[:k] | own[k]) & (np.abs(n[:k] - n[k]) <= edits) & ((node[:k] != node[k]) | (line[:k] != line[k]))
                if counts is not None:
                    fits &= np.abs(counts[:k] - counts[k]).sum(axis=1) <= 2 * edits
                found = []
                for j in np.flatnonzero(fits).tolist():
                    if within(words[j], words[k], int(edits[j])):
                        found.append(j)
                        if len(found) > most:
                            break
                out += [(node[k], line[k], node[j], line[j], len(found) > most) for j in found[:most]]
            if len(out) > 10_000:
                yield _listing(out)
                out = []
        yield _listing(out)

    return compare


def _met(bound: Bound, most: int):
    """Rows sorted by key, the earliest line first: the near lines before each line that asks among those of a variant. Only the first lines are held."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for k, marked, gone, words, node, line, asks in zip(*[batch.column(c).to_pylist() for c in ("key", "marked", "gone", "words", "node", "line", "asks")], strict=True):
                if k != key:
                    key, held = k, []
                able = [(b, c) for m, g, w, b, c in held if asks and m == marked and m + g + gone <= bound.edits(min(w, words)) and (b, c) != (node, line)]
                out += [(node, line, b, c, len(able) > most) for b, c in able[:most]]
                # Lines of a variant with one number of words left out are alike: so many of each kind are enough.
                if sum(m == marked and g == gone and w == words for m, g, w, _, _ in held) <= most:
                    held.append((marked, gone, words, node, line))
            yield _listing(out)
            out = []

    return meet


def _edit_rows(bound: Bound):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, line in enumerate(batch.column("text").to_pylist()):
                place, words = batch.select(["first"]).slice(k, 1), hashed_words(line)
                for marked, gone, keys in edit_variants(words, int(bound.edits(len(words)))):
                    same = place.take(pa.array(np.zeros(len(keys), np.int32))).column(0)
                    yield pa.record_batch([pa.array(keys), *[pa.array(np.full(len(keys), x, t)) for x, t in ((marked, np.int8), (gone, np.int8), (len(words), np.int32))], same], ["key", "marked", "gone", "words", "first"])

    return rows
