"""Token ids in Arrow stream files: batches of fixed-size lists, so equal-length sequences and their masks are found by arithmetic."""

from __future__ import annotations

import json
import os
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrain.llm import sharding
from evalgrain.llm.base import materialize, new_path, partitions
from evalgrain.llm.packing import ODD, WORD, gather, pack_ids, unpack_ids

_MEMO, _CHARS, _JOINED = 700_000, 2_000_000, 64


class _Words(dict):
    """Numbers of words, and the ids of each: flat[start[n] : start[n] + length[n]].

    A word's key is what follows its blank; a word that is not one blank and what follows has a blank and itself as key.
    """

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.flat, self.start, self.length = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n

    def learn(self, library, sizes: np.ndarray) -> None:
        """The library encodes the new words, those that begin with a blank many at once, one after another in a text.

        No match crosses the start of such a word, so its ids are those between its first and its last byte; sizes has the
        bytes of each token.
        """
        joins = np.array([bool(k) and not k[0].isspace() and not k[-1].isspace() for k in self.new], bool)
        joined = [k for k, j in zip(self.new, joins.tolist(), strict=True) if j]
        alone = [k[1:] if k[:1] == " " else " " + k for k, j in zip(self.new, joins.tolist(), strict=True) if not j]
        flat, length = array("I"), array("q")
        for e in library.encode_batch_fast([" " + " ".join(joined[k : k + _JOINED]) for k in range(0, len(joined), _JOINED)], add_special_tokens=False):
            flat.extend(e.ids)
        ends = np.cumsum(sizes[np.frombuffer(flat, np.uint32)])
        wanted = np.cumsum([len(k.encode("utf-8", "surrogatepass")) + 1 for k in joined])
        last = np.searchsorted(ends, wanted) + 1
        if len(joined) and not np.array_equal(ends[last - 1], wanted):
            raise ValueError("a token crosses the start of a word")
        for e in library.encode_batch_fast(alone, add_special_tokens=False):
            ids = e.ids
            flat.extend(ids)
            length.append(len(ids))
        own = np.empty(len(joins), np.int64)
        own[joins], own[~joins] = np.diff(last, prepend=0), np.frombuffer(length, np.int64)
        start = np.empty(len(joins), np.int64)
        start[joins], start[~joins] = last - own[joins], len(ends) + np.cumsum(own[~joins]) - own[~joins]
        self.new.clear()
        self.start = np.concatenate([self.start, start + len(self.flat)])
        self.flat = np.concatenate([self.flat, np.frombuffer(flat, np.uint32)])
        self.length = np.concatenate([self.length, own])


def check_tokenizer(tokenizer_json: str) -> None:
    """Raises unless a tokenizer's texts can be encoded word by word: byte-level, its own pattern, nothing before it."""
    read = json.loads(tokenizer_json)
    first = read.get("pre_tokenizer") or {}
    if read.get("normalizer") or first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex", True) or read["model"].get("dropout"):
        raise ValueError("only byte-level tokenizers with the built-in pattern, no normalizer, prefix space or dropout")


@lru_cache(maxsize=1)
def _library(tokenizer_json: str):
    """The library's tokenizer, the bytes of its tokens, its added tokens, and a holder of the words encoded so far, kept from task to task of a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(tokenizer_json)
    vocabulary = library.get_vocab()
    sizes = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)
    for token, n in vocabulary.items():  # a character for each byte
        sizes[n] = len(token)
    return library, sizes, [t.content for t in library.get_added_tokens_decoder().values()], [_Words()]


def _ids_of(texts: pa.Array, tokenizer_json: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts with the end id after each, one after another, and where each text's ids end.

    The library gets each word once (the memory is emptied at _MEMO words): a text without odd white space is cut before
    its blanks, another at its runs of white space; no match of the pattern crosses these places. Texts that hold an
    added token's string go to the library whole.
    """
    library, sizes, added, held = _library(tokenizer_json)
    if len(held[0]) > _MEMO:
        held[0] = _Words()
    words = held[0]
    pieces = pc.split_pattern(texts, " ")
    first = pieces.offsets.to_numpy()
    coded = pieces.flatten().dictionary_encode()
    apart: dict[int, np.ndarray | str] = {}
    for k, text in enumerate(texts.to_pylist()):
        if any(t in text for t in added):
            apart[k] = text
        elif any(o in text for o in ODD):
            found = WORD.findall(text)
            apart[k] = np.array([words[" " + w] for w in found], np.int64)
    number = np.array([words[w] for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
    heads = pieces.flatten().take(pa.array(first[:-1]))
    number[first[:-1]] = [words[" " + w] for w in heads.to_pylist()]
    if words.new:
        words.learn(library, sizes)
    ids = gather(words.flat, words.start[number], words.length[number])
    counts = np.concatenate([[0], np.cumsum(words.length[number])])
    parts, at = [], 0
    for k, x in apart.items():
        parts.append(ids[counts[first[at]] : counts[first[k]]])
        whole = isinstance(x, str)
        parts.append(np.array(library.encode(x, add_special_tokens=False).ids, np.uint32) if whole else gather(words.flat, words.start[x], words.length[x]))
        at = k + 1
    parts.append(ids[counts[first[at]] :])
    length = np.diff(counts[first])
    for k, x in zip(apart, parts[1::2], strict=True):
        length[k] = len(x)
    ends = np.cumsum(length)
    return np.insert(np.concatenate(parts), ends, end).astype(np.uint32), ends + np.arange(1, len(ends) + 1)


def _encoder(tokenizer_json: str, end_id: int, part_of, planes: int):
    """Rows (doc_id, key, tie, text) to (doc_id, tie, part, ids, n_tokens), about _CHARS characters of text at a time."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            ends = np.cumsum(pc.utf8_length(text).to_numpy())
            first = 0
            while first < batch.num_rows:
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + _CHARS, side="right")))
                rows = batch.slice(first, last - first)
                ids, stop = _ids_of(text.slice(first, last - first), tokenizer_json, end_id)
                start = np.concatenate([[0], stop[:-1]])
                packed = [pack_ids(ids[a:b], 1, planes) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                part = part_of(rows.column("key").to_numpy(), rows.column("tie").to_numpy())
                out = [rows.column("doc_id"), rows.column("tie"), pa.array(part, pa.int32()), pa.array(packed, pa.binary()), pa.array(stop - start, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "tie", "part", "ids", "n_tokens"])
                first = last

    return encode


def _writer(folder: str, width: int, batch: int, narrow: bool):
    """Writes a partition, in its order, to one file of sequences and one index of documents."""
    kind, planes = (pa.uint16(), 2) if narrow else (pa.uint32(), 4)
    schema = pa.schema([("input_ids", pa.list_(kind, width)), ("mask", pa.list_(pa.bool_(), width))])
    index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])

    def sequences(flat: np.ndarray, n: int) -> pa.RecordBatch:
        """n ids padded to whole sequences; the mask is true for ids, false for padding."""
        rows = -(-n // width)
        ids, mask = np.zeros(rows * width, kind.to_pandas_dtype()), np.zeros(rows * width, bool)
        ids[:n], mask[:n] = flat[:n], True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), width) for x in (ids, mask)]
        return pa.RecordBatch.from_arrays(lists, schema=schema)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        path = index_path = first = None
        out = index = None
        held, waiting, n_docs, n_tokens, full = [], 0, 0, 0, width * batch
        for pdf in batches:
            if not len(pdf):
                continue
            if out is None:
                name = uuid.uuid4().hex
                path, index_path = f"{folder}/{name}.arrow", f"{folder}/{name}.index.arrow"
                store.create_dir(root, recursive=True)
                files = store.open_output_stream(f"{root}/{name}.arrow"), store.open_output_stream(f"{root}/{name}.index.arrow")
                out, index = pa.ipc.new_stream(files[0], schema), pa.ipc.new_stream(files[1], index_schema)
                first = int(pdf["part"].iloc[0])
            lengths = pdf["n_tokens"].to_numpy(np.int64)
            ends = n_tokens + np.cumsum(lengths)
            ids = pa.array(pdf["doc_id"], pa.int64(), from_pandas=True)
            index.write_batch(pa.RecordBatch.from_arrays([ids, pa.array(ends - lengths), pa.array(lengths)], schema=index_schema))
            n_docs, n_tokens = n_docs + len(pdf), int(ends[-1])
            for data in pdf["ids"]:
                held.append(unpack_ids(data, planes))
                waiting += len(held[-1])
                while waiting >= full:
                    flat = np.concatenate(held)
                    out.write_batch(sequences(flat, full))
                    held, waiting = [flat[full:]], waiting - full
        if out is not None:
            if waiting:
                out.write_batch(sequences(np.concatenate(held), waiting))
            for x in (out, index, *files):
                x.close()
            yield pd.DataFrame({"path": [path], "index_path": [index_path], "place": [first], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    return write


def write_token_files(
    docs: DataFrame,
    tokenizer_json: str,
    end_id: int,
    vocabulary: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 1024,
    batch: int = 128,
    folder: str | None = None,
) -> DataFrame:
    """Write every text's ids and the end id, in ascending order of the id column, and return the manifest of the files.

    Manifest: part (from 0, in order), path, index_path, n_docs, n_tokens, start (ids in the parts before). A file is an
    Arrow stream of batches of `batch` sequences of `width` ids (16 bits where the vocabulary allows) and their masks;
    only the last batch is shorter, and only the last sequence of a file is padded, with mask false. The index beside
    it has doc_id, start within the file, n_tokens. Files lie in `folder`, a URI that executors can write to (the
    shared folder if not given); only files of the manifest count, so a repeated task does no harm.

    The places at which the order is cut come from exact counts of bytes below candidate ids (see sharding), so files are
    about equal and a task's part is bounded; rows with one id and text are dealt over the parts they span. Then texts are
    encoded once, on the way into the one exchange. Null text counts as empty (the end id only); null ids come first; rows
    with one id come in any order; an empty table writes nothing and gives an empty manifest; other columns are not used.
    A tokenizer that can't be used word by word is refused (see check_tokenizer()).
    """
    check_tokenizer(tokenizer_json)
    spark, narrow = docs.sparkSession, vocabulary <= 1 << 16
    folder = folder or new_path(spark, "token-files")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(sharding.LEAST)).alias("key"), F.xxhash64(text).alias("tie"), text.alias("text"))
    parts = partitions(spark)
    sizes = rows.select("key", "tie", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"))
    part_of = sharding.dealt_parts(materialize(sizes, "token-keys"), parts)
    encoded = rows.mapInArrow(_encoder(tokenizer_json, end_id, part_of, 2 if narrow else 4), "doc_id long, tie long, part int, ids binary, n_tokens long")
    ordered = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "tie")
    files = "path string, index_path string, place int, n_docs long, n_tokens long"
    written = materialize(ordered.mapInPandas(_writer(folder, width, batch, narrow), files), "token-manifest")
    parts, start = [], 0
    for k, r in enumerate(sorted(written.collect(), key=lambda r: r.place)):
        parts.append((k, r.path, r.index_path, r.n_docs, r.n_tokens, start))
        start += r.n_tokens
    return spark.createDataFrame(parts, "part int, path string, index_path string, n_docs long, n_tokens long, start long")


def open_stream(uri: str) -> pa.RecordBatchStreamReader:
    """A stream file; one on a local disk is mapped, and its arrays are views of the map."""
    store, path = fs.FileSystem.from_uri(uri)
    return pa.ipc.open_stream(pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path))


class Sequences:
    """Random access to the sequences of a stream file: ids and mask of sequence i, found by arithmetic.

    All batches but the last hold the same number of sequences, so their messages are of one size: batch k begins at the
    first batch's place plus k sizes. On a local disk the file is mapped, and what comes back are views of the map.
    """

    def __init__(self, uri: str) -> None:
        store, path = fs.FileSystem.from_uri(uri)
        self._file = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self._schema = pa.ipc.read_schema(pa.ipc.read_message(self._file))
        self._first = self._file.tell()
        head = pa.ipc.read_record_batch(pa.ipc.read_message(self._file), self._schema)
        self._size, self.batch = self._file.tell() - self._first, head.num_rows
        self.width = self._schema.field("input_ids").type.list_size

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        self._file.seek(self._first + i // self.batch * self._size)
        rows = pa.ipc.read_record_batch(pa.ipc.read_message(self._file), self._schema)
        at = i % self.batch * self.width
        if i < 0 or i % self.batch >= rows.num_rows:
            raise IndexError(i)
        ids, mask = (rows.column(c).values.slice(at, self.width) for c in ("input_ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask


def read_documents(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian 32 bits).

    A task reads one file at a time, batch by batch.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for parts in batches:
            for part in parts.itertuples():
                flat, stream = np.empty(0, np.uint32), iter(open_stream(part.path))
                for docs in open_stream(part.index_path):
                    ids = []
                    for n in docs.column("n_tokens").to_numpy():
                        more = []
                        have = len(flat)
                        while have < n:
                            batch = next(stream)
                            values = batch.column("input_ids").flatten().to_numpy()
                            more.append(values[batch.column("mask").flatten().to_numpy(zero_copy_only=False)].astype(np.uint32))
                            have += len(more[-1])
                        flat = np.concatenate([flat, *more]) if more else flat
                        ids.append(flat[:n].astype("<u4").tobytes())
                        flat = flat[n:]
                    out = docs.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
                    out["start"] += part.start
                    yield out.assign(ids=ids)

    n = max(1, min(manifest.count(), 100_000))
    return manifest.repartition(n, "part").mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")
