"""Language-model scores of documents: exact word counts of the whole corpus, and a recurrent model trained in parallel on its texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrain.llm.base import free_name, materialize, without
from evalgrain.llm.blocks import write_blocks
from evalgrain.llm.recurrent import Adam, Recurrent
from evalgrain.llm.words import many_word_hashes

#: The end of a text, as a word's hash.
END = np.uint64(0)
#: Tokens that a task holds at once.
LOT = 1 << 21
#: Lanes of a window in which a task learns: in wider ones numpy's cost of a step falls on more tokens.
LANES = 512
FIELDS = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The texts' tokens (hashes of words, then END) in lists of about LOT tokens. The first column holds the texts."""
    held, n = [], 0
    for batch in batches:
        for words in many_word_hashes(batch.column(0).to_pylist()):
            held.append(np.append(words, END))
            n += len(held[-1])
            if n >= LOT:
                yield held
                held, n = [], 0
    if held:
        yield held


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (hash), n: how often each token occurs in all texts (null: empty; each text has one end more), written to the shared folder.

    Words are told apart by 64-bit hashes. A task counts its texts in lots, so a common word comes once a lot to the exchange.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches):
            word, n = np.unique(np.concatenate(lot), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    texts = docs.select(F.col(f"`{text_col}`").cast("string"))
    return materialize(texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")


@dataclass(frozen=True)
class LanguageModel:
    """vocabulary: hashes in order, with the model's token of each; `other` stands for all other words."""

    vocabulary: np.ndarray
    token: np.ndarray
    other: int
    end: int
    n: int
    distinct: int
    other_n: int
    other_distinct: int
    recurrent: Recurrent

    def tokens(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, self.token[at], self.other)


def _start(counts: DataFrame, classes: int, width: int, hidden: int, seed: int) -> LanguageModel:
    """The model before training: the most frequent words, and each token's share of all."""
    n, distinct = (x or 0 for x in counts.agg(F.sum("n"), F.count("*")).first())
    room = classes * width - 2
    top = counts.where(F.col("word") != int(END)).orderBy(F.desc("n"), "word").limit(room).collect()
    ends = counts.where(F.col("word") == int(END)).agg(F.sum("n")).first()[0] or 0
    words = np.array([int(END)] + [r.word for r in top], np.int64).view(np.uint64)
    share = np.zeros(classes * width, np.int64)
    share[: len(words)] = [ends] + [r.n for r in top]
    other_n = n - int(share.sum())
    share[len(words)] = other_n  # the last place in use: all other words
    rank = np.empty(len(share), np.int64)
    order = np.argsort(-share, kind="stable")
    rank[order] = np.arange(len(share))
    by_hash = np.argsort(words)
    model = Recurrent.fresh(share[order].astype(np.float64), classes, hidden, seed)
    return LanguageModel(words[by_hash], rank[: len(words)][by_hash], int(rank[len(words)]), int(rank[0]), n, distinct, other_n, distinct - len(top) - (ends > 0), model)


_PIECE = 4096
_MEAN = "piece int, weight long, data binary"


def _weighted(pdf: pd.DataFrame) -> pd.DataFrame:
    """The mean of some models' weights (a piece of them), each by the tokens that it learned from."""
    weight = pdf["weight"].sum()
    total = sum(np.frombuffer(x, np.float64) * w for x, w in zip(pdf["data"], pdf["weight"], strict=True))
    return pd.DataFrame({"piece": [int(pdf["piece"].iat[0])], "weight": [int(weight)], "data": [(total / weight).tobytes()]})


def train(
    docs: DataFrame,
    counts: DataFrame,
    text_col: str = "text",
    classes: int = 32,
    width: int = 32,
    hidden: int = 16,
    rounds: tuple[int, ...] = (4, 12, 48),
    of: int = 64,
    rate: float = 0.02,
    seed: int = 0,
) -> LanguageModel:
    """A model of docs, whose tokens `counts` counts: classes * width - 2 words, one token for all others, and the end of a text.

    All counts go into the vocabulary, the shares that the model starts from and the other words' probabilities. Its recurrent weights
    learn from every text once: by a hash of the text each belongs to one of the rounds, which have rounds[k] of `of` texts each and all of them together. In a
    round every task starts from the same model and passes once over the whole of its texts; their weights' means, by tokens, are the next round's model. Of a
    model the driver gets its weights only, tens of thousands of numbers.
    """
    if sum(rounds) != of:
        raise ValueError("the rounds have all texts together: their sum is `of`")
    spark = docs.sparkSession
    model = _start(counts, classes, width, hidden, seed)
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumn("at", F.pmod(F.xxhash64("text"), F.lit(of)))
    first = 0
    for share in rounds:
        shared = spark.sparkContext.broadcast(model)
        some = texts.where((F.col("at") >= first) & (F.col("at") < first + share)).select("text")
        first += share
        learned = some.mapInArrow(_learn(shared, rate), f"task int, {_MEAN}")
        half = learned.groupBy("piece", F.floor(F.col("task") / 64)).applyInPandas(_weighted, _MEAN)
        pieces = half.groupBy("piece").applyInPandas(_weighted, _MEAN).orderBy("piece").collect()
        shared.destroy()
        if pieces:
            flat = np.concatenate([np.frombuffer(r.data, np.float64) for r in pieces])
            model = LanguageModel(**{**vars(model), "recurrent": model.recurrent.with_flat(flat)})
    return model


def _learn(shared, rate: float):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        own, optimizer, n = model.recurrent.with_flat(model.recurrent.flat()), Adam(rate), 0
        for lot in _lots(batches):
            own.learn([model.tokens(words) for words in lot], model.end, optimizer, LANES)
            n += sum(map(len, lot))
        if n:
            flat = own.flat().astype(np.float64)
            parts = [flat[k : k + _PIECE].tobytes() for k in range(0, len(flat), _PIECE)]
            task = pa.array([TaskContext.get().partitionId()] * len(parts), pa.int32())
            yield pa.RecordBatch.from_arrays([task, pa.array(range(len(parts)), pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["task", "piece", "weight", "data"])

    return learn


def _distinct(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    lots = [np.unique(np.concatenate(lot)) for lot in _lots(table.select(["c0"]).to_batches())]
    word = np.unique(np.concatenate(lots)).view(np.int64)
    return pa.table({"block": pa.array([key[0].as_py()] * len(word), pa.int64()), "word": word})


def _judge(shared, kept: list[str], schema: pa.Schema):
    def judge(rows: pa.Table, counts: pa.Table) -> pa.Table:
        model = shared.value
        known, n = counts.column("word").to_numpy().view(np.uint64), counts.column("n").to_numpy()
        order = np.argsort(known)
        known, n = np.append(known[order], np.uint64(2**64 - 1)), np.append(n[order], 0)
        found = []
        for lot in _lots(rows.select(["c0"]).to_batches()):
            sizes = np.array([len(words) for words in lot])
            flat, start = np.concatenate(lot), np.cumsum(sizes) - sizes
            at = np.searchsorted(known, flat)
            count = np.where(known[at] == flat, n[at], 0)
            tokens = model.tokens(flat)
            base = np.log10((count + 1) / (model.n + model.distinct + 1))
            other = np.where(tokens == model.other, np.log10((count + 1) / (model.other_n + model.other_distinct + 1)), 0.0)
            told = model.recurrent.log_probabilities(np.split(tokens, start[1:]), model.end) / np.log(10)
            sums = [np.add.reduceat(x, start) for x in (base, other, (count > 0).astype(np.int64))]
            found.append((sizes, sums[2], sums[0], told + sums[1]))
        n_tokens, n_known, base, score = (np.concatenate(x) for x in zip(*found, strict=True))
        fields = [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(np.full(len(rows), model.n), pa.int64()), pa.array(base), pa.array(score)]
        struct = pa.StructArray.from_arrays(fields, [f.split()[0] for f in FIELDS.split(", ")])
        return pa.Table.from_arrays([*[rows.column(c).combine_chunks() for c in kept], struct], schema=schema)

    return judge


def score(docs: DataFrame, model: LanguageModel, counts: DataFrame, text_col: str = "text", out: str = "lm") -> DataFrame:
    """docs plus a struct column `out`: n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the whole text (runs without ASCII white space, A-Z lower-cased) and one end; known ones are in counts. base_score sums
    log10((c + 1) / (N + V + 1)): c the token's count, N all counted tokens, V the distinct ones. score is the model's log10 probability of
    the text: its tokens' given all before them, state carried through to the end; of a word outside the vocabulary, that of
    any such word times (c + 1) / (n + v + 1), n and v of all such words (the 1 is left for words never seen).

    Null and empty texts are one end; repeated rows are judged each; null ids and other columns pass through, and one named like `out`, whatever
    its case, is replaced; an empty table gives an empty result. With nothing counted, all tokens of the model are alike.

    Texts are written in blocks of rows. A block's distinct words go out by hash to the counts and come back to the block; a common word goes
    once a block. Texts stay where they are. Only the model, of a fixed size, is broadcast.
    """
    spark: SparkSession = docs.sparkSession
    keep = without(docs.columns, out)
    order = [text_col, *[c for c in keep if c != text_col]]
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias(free_name("whole", keep)), *[F.col(f"`{c}`") for c in order])
    table = write_blocks(texts, "lm", texts.columns)
    words = table.select("block", "c0").groupBy("block").applyInArrow(_distinct, "block long, word long")
    known = words.join(counts, "word").select("block", "word", "n")
    own = [f"c{k}" for k in range(1, len(order) + 1)]
    schema = T.StructType([*[table.schema[c] for c in own], T.StructField("judged", T.StructType.fromDDL(FIELDS))])
    from pyspark.sql.pandas.types import to_arrow_schema

    judge = _judge(spark.sparkContext.broadcast(model), own, to_arrow_schema(schema))
    judged = table.select("block", "c0", *own).groupBy("block").cogroup(known.groupBy("block")).applyInArrow(judge, schema)
    named = dict(zip(order, own, strict=True))
    return judged.select(*[F.col(named[c]).alias(c) for c in keep], F.col("judged").alias(out))
