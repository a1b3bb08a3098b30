"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items, texts scanned once."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalgrain.llm.base import materialize, without

#: Bytes are mapped before a text is split: A-Z to a-z, digits and letters and bytes from 0x80 up stay, the rest are spaces.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

FIELDS = ("n_words long", "n_hit long", "n_items long", "items_sha256 string", "contaminated boolean", "items array<string>", "spans array<struct<start:int,end:int>>")
RESULT = ", ".join(FIELDS)


def fold_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows(words: list[bytes], size: int) -> set[bytes]:
    """Distinct windows as ' w1 w2 ... '; an item shorter than `size` is one window, one without words none."""
    if not words:
        return set()
    return {b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))}


#: What stands between words, as a Java pattern, and the number of windows in a piece of an item.
_APART, PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", 4096


def item_pieces(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct (item, text) of items with words: an item's words joined by blanks, in pieces of PIECE windows.

    A piece begins with the words that its predecessor ends with, so every window is whole in one piece.
    """
    words = F.filter(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), _APART), lambda w: w != "")
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), words.alias("words")).where("item IS NOT NULL AND size(words) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(PIECE))
    text = F.transform(starts, lambda s: F.array_join(F.slice("words", s + 1, F.lit(PIECE + window - 1)), " "))
    return items.select("item", F.explode(text).alias("text")).distinct()


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, max_bytes: int, window: int = 13) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in blocks to send to every executor; one is on the driver at a time. At least one, if an empty one.

    A block has at most max_bytes of text and one piece (item_pieces()) more, whatever the items: pieces are dealt to bins by hash,
    and a bin is cut where its running sum of bytes passes max_bytes, so neither a long item nor an id with many rows makes a large block.
    """
    pieces = item_pieces(benchmark, id_col, text_col, window)
    total = pieces.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    if total <= max_bytes:
        yield [(r.item, r.text) for r in pieces.collect()]
        return
    bins = 2 * int(total // max_bytes) + 1
    before = F.sum(F.octet_length("text") + 1).over(Window.partitionBy("bin").orderBy("item", "text").rowsBetween(Window.unboundedPreceding, -1))
    dealt = pieces.withColumn("bin", F.pmod(F.xxhash64("item", "text"), F.lit(bins))).withColumn("cut", F.floor(F.coalesce(before, F.lit(0)) / max_bytes))
    dealt = materialize(dealt, "benchmark")
    for bin_, cut in sorted(map(tuple, dealt.select("bin", "cut").distinct().collect())):
        yield [(r.item, r.text) for r in dealt.where((F.col("bin") == bin_) & (F.col("cut") == cut)).collect()]


#: The automaton that this worker used last, by a name that each block of items gets.
_held: dict[str, object] = {}


def automaton(name: str, items: list[tuple[str, str]], window: int):
    """The automaton over the windows of some items, or None without windows; kept for the worker's next task."""
    import ahocorasick

    if name not in _held:
        by_window: dict[bytes, set[str]] = {}
        for item, text in items:
            for w in windows(fold_words(text), window):
                by_window.setdefault(w, set()).add(item)
        found = ahocorasick.Automaton()
        for w, ids in by_window.items():
            found.add_word(w.decode("latin-1"), (len(w), w.count(b" ") - 1, tuple(sorted(ids))))
        if by_window:
            found.make_automaton()
        _held.clear()
        _held[name] = found if by_window else None
    return _held[name]


def _scan(shared, window: int, share: int):
    """A function on batches of (text, hits and items so far) that adds the hits of one broadcast block of items and judges the text."""

    def scan(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        machine = automaton(*shared.value, window)
        for batch in batches:
            rows = []
            for text, before, known in zip(*batch, strict=True):
                words = fold_words(text)
                hits = [(int(r["start"]), int(r["end"])) for r in before]
                found: set[str] = set(known)
                if machine is not None and words:
                    ends = None
                    for end, (length, count, ids) in machine.iter((b" " + b" ".join(words) + b" ").decode("latin-1")):
                        if ends is None:
                            ends = np.cumsum([len(w) + 1 for w in words])
                        first = int(np.searchsorted(ends, end - length + 1, side="right"))
                        hits.append((first, first + count))
                        found.update(ids)
                rows.append(_verdict(text, len(words), merged(hits), sorted(found), share))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans", "hits"])

    return scan


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open ranges as disjoint ranges in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _verdict(text: str, n: int, hits: list[tuple[int, int]], ids: list[str], share: int) -> tuple:
    hit, spans = sum(e - s for s, e in hits), []
    if hits:
        at = [m.span() for m in _WORD.finditer(text)]
        spans = [{"start": at[s][0], "end": at[e - 1][1]} for s, e in hits]
    ranges = [{"start": s, "end": e} for s, e in hits]
    return n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0 and share * hit >= n, ids, spans, ranges


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    share: int = 20,
    max_block_bytes: int = 16 << 20,
    out: str = "decontamination",
) -> DataFrame:
    """docs plus one struct column `out`: n_words, n_hit, n_items, items_sha256, contaminated, items, spans.

    A document word is hit if it lies in an occurrence of a window of `window` consecutive words of an item (the whole
    item if shorter); contaminated means n_hit > 0 and share * n_hit >= n_words. spans are code-point offsets of the hit
    ranges in the original text.

    Plan: no shuffle of documents. The items go to the executors in blocks of max_block_bytes of text and one piece of an
    item more at most, one after another; each block is one automaton, which a worker builds once, and a document is scanned once per block. Past one block
    the hits so far are written between blocks, and the block's broadcast is released.

    Null and empty texts have no words and no hit; items with null id are ignored, items without words match nothing;
    repeated documents are judged each for itself; repeated items count once by id; an empty table gives an empty
    result. Other columns of docs pass through; one named like `out`, whatever its case, is replaced.
    """
    spark, keep = docs.sparkSession, without(docs.columns, out)
    ranges = "array<struct<start:int,end:int>>"
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.array().cast(ranges).alias("hits"), F.array().cast("array<string>").alias("items"))
    text, waiting = F.col("doc").getField(text_col).cast("string"), None
    for items in item_blocks(benchmark, item_id_col, item_text_col, max_block_bytes, window):
        if waiting is not None:
            df = materialize(df.select("doc", "verdict.hits", "verdict.items"), "decontaminate")
            waiting.destroy()
        waiting = spark.sparkContext.broadcast((uuid.uuid4().hex, items))
        scan = F.pandas_udf(_scan_typed(_scan(waiting, window, share)), f"{RESULT}, hits {ranges}")
        df = df.withColumn("verdict", scan(text, "hits", "items"))
    kept = F.struct(*[F.col("verdict").getField(c.split()[0]).alias(c.split()[0]) for c in FIELDS])
    return df.select(*[F.col("doc").getField(c).alias(c) for c in keep], kept.alias(out))


def _scan_typed(scan):
    """Spark reads the kind of a pandas function from its annotations."""

    def typed(batches):
        yield from scan(batches)

    typed.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return typed
