"""Byte-level BPE over a corpus: each distinct word is encoded once, ids are joined back and put in order by position.

A word is a run of white space with what follows it up to the next (or the start of a text). No match of the pattern
crosses the start of such a run, so a text's matches are those of its words one after another; each is merged separately.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrain.llm.base import materialize_by_block, partitions
from evalgrain.llm.packing import WHITE_SPACE, WORD, gather, pack_ids, squeeze, unpack_ids


class Numbers(dict):
    """Numbers of words in order of first use."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _pack_words(words: list[bytes]) -> bytes:
    return squeeze(np.array([len(words), *map(len, words)], "<u4").tobytes() + b"".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = 4 * (n + 1) + np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)
    starts = [4 * (n + 1), *ends.tolist()]
    return [raw[a:b] for a, b in zip(starts, starts[1:])]


_BLOCKS = "block string, kind int, tier int, bucket int, doc_id {id}, data binary"
#: So many of a block's most frequent words get the numbers below 256, which pack well.
FREQUENT = 255


def _cut(block_chars: int, buckets: int):
    """Rows of documents to blocks: a row per document with the numbers of its words in order (kind 0), and the block's
    distinct words, a row for each tier and bucket of their hash (kind 1). A word's number is its place in the order of
    tier (frequent words first), bucket and bytes."""

    def close(block: str, docs: list, words: dict[str, int]) -> Iterator[pd.DataFrame]:
        raw = [t.encode("utf-8", "surrogatepass") for t in words]
        bucket = (pd.util.hash_array(np.array(list(words), dtype=object), categorize=False) % np.uint64(buckets)).astype(np.int64)
        words.clear()
        used = np.zeros(len(raw), np.int64)
        for _, seen in docs:
            used += np.bincount(seen, minlength=len(raw))
        tier = np.ones(len(raw), np.int64)
        tier[np.argsort(-used, kind="stable")[:FREQUENT]] = 0
        order = np.array(sorted(range(len(raw)), key=raw.__getitem__), np.int64)
        lot = (tier * buckets + bucket)[order]
        order = order[np.argsort(lot, kind="stable")]
        number = np.empty(len(raw), np.int32)
        number[order] = np.arange(len(raw), dtype=np.int32)
        rows = [(block, 0, None, None, doc, pack_ids(number[seen])) for doc, seen in docs]
        docs.clear()
        lot = np.sort(lot)
        for part in np.split(order, np.flatnonzero(np.diff(lot)) + 1) if len(raw) else ():
            rows.append((block, 1, int(tier[part[0]]), int(bucket[part[0]]), None, _pack_words([raw[i] for i in part.tolist()])))
        yield pd.DataFrame(rows, columns=["block", "kind", "tier", "bucket", "doc_id", "data"]).astype({"tier": "Int32", "bucket": "Int32", "doc_id": object})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n, size, docs, words = TaskContext.get().partitionId(), 0, 0, [], Numbers()
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                found = WORD.findall(text or "")
                docs.append((doc, np.fromiter(map(words.__getitem__, found), np.int32, len(found))))
                size += len(text or "")
                if size >= block_chars:
                    yield from close(f"{task}-{n}", docs, words)
                    n, size = n + 1, 0
        if docs:
            yield from close(f"{task}-{n}", docs, words)

    return cut


def check_pattern(pattern: str) -> None:
    """Raises if a match of the pattern goes on past the start of white space in any of the probes: all kinds of characters, in
    runs of one to three, before and after runs of all kinds of white space. Texts could then not be cut there."""
    kinds = ["a", "Z", "é", "漢", "7", "٣", "'", "'s", ".", "_", "😀", "\u0301", "", "\n", " ", "\t", "\xa0", "\u2028"]
    crosses = regex.compile(f"[^{WHITE_SPACE}][{WHITE_SPACE}]")
    compiled = regex.compile(pattern)
    for a, space, b in product((k * n for k in kinds for n in (1, 2, 3)), [" ", "  ", "\n", " \n", "\n ", "\t", "\xa0", "   "], kinds):
        if any(crosses.search(m.group()) for m in compiled.finditer(a + space + b)):
            raise ValueError("a match of this pattern can go on past the start of white space")


@lru_cache(maxsize=1)
def _library(pattern: str, tokens: tuple[bytes, ...]):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: r for r, t in enumerate(tokens)}, special_tokens={})


def _encode_words(shared):
    """Words of a bucket to ids. Every copy of a word is in one bucket, so a word is encoded once."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = _library(*shared.value).encode_ordinary
        known: dict[bytes, list[int]] = {}
        bucket = None
        for batch in batches:
            data = []
            for b, packed in zip(batch["bucket"], batch["data"], strict=True):
                if b != bucket:
                    bucket, known = b, {}
                ids = []
                for w in _unpack_words(packed):
                    if (got := known.get(w)) is None:
                        got = known[w] = of(w.decode("utf-8", "surrogatepass"))
                    ids.append(got)
                flat = np.array([i for x in ids for i in x], np.uint32)
                lengths = np.array([len(ids), *map(len, ids)], np.uint32)
                data.append(pack_ids(np.concatenate([lengths, flat])))
            yield pd.DataFrame({"block": batch["block"], "tier": batch["tier"], "bucket": batch["bucket"], "data": data})

    return encode


def _assemble(token_bytes=None):
    """The ids of a block's documents from those of its words, and, given a broadcast token-byte table, the ids' bytes."""

    def assemble(docs: pa.Table, words: pa.Table) -> pa.Table:
        words = words.sort_by([("tier", "ascending"), ("bucket", "ascending")])
        lengths, flats = [np.empty(0, np.uint32)], [np.empty(0, np.uint32)]
        for numbers in map(unpack_ids, words.column("data").to_pylist()):
            n = int(numbers[0])
            lengths.append(numbers[1 : n + 1])
            flats.append(numbers[n + 1 :])
        length, flat = np.concatenate(lengths).astype(np.int64), np.concatenate(flats).astype(np.int32)
        start = np.cumsum(length) - length
        ids = [gather(flat, start[x], length[x]) for x in map(unpack_ids, docs.column("data").to_pylist())]
        offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        out = {"doc_id": docs.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))}
        if token_bytes is not None:
            out["decoded"] = pa.array([_text(*token_bytes.value, x) for x in ids], pa.binary())
        return pa.table(out)

    return assemble


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 20_000_000, decoded: bool = False) -> DataFrame:
    """doc_id and ids (array<int>) of every row, as merging each match of `pattern` by `ranks` gives them.

    1. Blocks of about block_chars characters (a longer text is a block of its own) are tokenised once and written: per
       document the numbers of its words by position, and the block's distinct words in lots by hash.
    2. The lots are exchanged by hash bucket; every distinct word of the corpus is then in one task and encoded once.
       A frequent word comes once per block, not once per use.
    3. The ids go back to their blocks and are put in order by position. The blocks lie in buckets already, so the
       documents' part is not exchanged. With `decoded`, the ids are decoded there too (as decode() does, from the ids and
       the token-byte table alone), which saves passing them to Python twice.

    Null text counts as empty (no ids); repeated rows each give a row; null ids are kept; an empty table gives an empty
    result; other columns of docs are not used; a pattern whose matches cross white space is refused (check_pattern()). `ranks` (from 0 on, without a gap) is broadcast: its size is the vocabulary's.
    """
    check_pattern(pattern)
    spark = docs.sparkSession
    n = partitions(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = materialize_by_block(rows.mapInPandas(_cut(block_chars, n), _BLOCKS.format(id=kind)), "bpe", n)
    lots = blocks.where("kind = 1").select("block", "tier", "bucket", "data")
    shared = spark.sparkContext.broadcast((pattern, tuple(sorted(ranks, key=ranks.get))))
    words = lots.repartition(n, "bucket").sortWithinPartitions("bucket").mapInPandas(_encode_words(shared), "block string, tier int, bucket int, data binary")
    texts = blocks.where("kind = 0").select("block", "doc_id", "data")
    both = texts.groupBy("block").cogroup(words.groupBy("block"))
    if decoded:
        return both.applyInArrow(_assemble(spark.sparkContext.broadcast(token_table(ranks))), f"doc_id {kind}, ids array<int>, decoded binary")
    return both.applyInArrow(_assemble(), f"doc_id {kind}, ids array<int>")


def token_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens by rank, one after another, with the start and size of each."""
    tokens = [np.frombuffer(t, np.uint8) for t in sorted(ranks, key=ranks.get)]
    sizes = np.array([len(t) for t in tokens], np.int64)
    return np.concatenate(tokens), np.cumsum(sizes) - sizes, sizes


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded plus a binary column: the bytes of its ids, looked up in the broadcast token-byte table.

    Null ids give null, an empty list no bytes; an id outside the table is an error; other columns pass through. The
    table is as large as the vocabulary, so each task joins it on the map side and positions keep their order.
    """
    table = encoded.sparkSession.sparkContext.broadcast(token_table(ranks))

    @F.pandas_udf("binary")
    def bytes_of(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _text(*table.value, np.asarray(x, np.int64)) for x in ids], dtype=object)

    return encoded.withColumn(out, bytes_of(F.col(ids_col)))


def _text(flat: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray, step: int = 1 << 20) -> bytes:
    parts = (ids[k : k + step] for k in range(0, len(ids), step))
    return b"".join(gather(flat, start[x], size[x]).tobytes() for x in parts)
