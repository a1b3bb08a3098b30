"""Language ID: multinomial naive Bayes over hashed character n-grams, scored in numpy against a broadcast matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrain.llm.base import free_name, without

UNDETERMINED = "und"


def gram_buckets(text: str, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Buckets of all character n-grams of the lower-cased text, runs of white space as one space."""
    chars = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    out = []
    for n in sizes:
        if len(chars) >= n:
            h = np.full(len(chars) - n + 1, n, dtype=np.uint64)
            for i in range(n):
                h = (h ^ chars[i : len(chars) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out.append((h >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


@dataclass(frozen=True)
class LanguageModel:
    """langs, sorted; logp[lang, bucket] and log priors."""

    langs: tuple[str, ...]
    logp: np.ndarray
    prior: np.ndarray
    sizes: tuple[int, ...]
    bits: int

    def part(self, first: int, last: int) -> LanguageModel:
        return LanguageModel(self.langs[first:last], self.logp[first:last], self.prior[first:last], self.sizes, self.bits)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Joint log-probability of each text (row) and language: a sparse matrix of n-gram counts times that of log-probabilities.

        A lot of texts is counted at once: the rows' buckets and counts follow one another, and what each adds is summed by row.
        """
        width, out, lot, cells = 1 << self.bits, [], [], 0
        for k, text in enumerate(texts):
            lot.append(gram_buckets(text, self.sizes, self.bits))
            cells += width + len(lot[-1])
            if cells >= 1 << 21 or k == len(texts) - 1:
                row = np.repeat(np.arange(len(lot)) * width, [len(g) for g in lot])
                counts = np.bincount(row + np.concatenate(lot), minlength=len(lot) * width)
                at = np.flatnonzero(counts)
                start = np.searchsorted(at, np.arange(len(lot)) * width)  # no row is empty: a text has the gram of its edges
                out.append(np.add.reduceat(self.logp.T[at % width] * counts[at, None], start, axis=0) + self.prior)
                lot, cells = [], 0
        return np.concatenate(out) if out else np.empty((0, len(self.langs)))

    def best(self, texts: list[str | None]) -> list[tuple[str | None, float | None, float | None]]:
        """Of each text the language that fits best, its log-probability, and that of all languages together; nulls for texts that tell none."""
        out: list[tuple] = [(None, None, None)] * len(texts)
        told = [k for k, t in enumerate(texts) if self.langs and has_letter(t)]
        for k, total in zip(told, self.scores([texts[k] for k in told]), strict=True):
            first = int(np.argmax(total))
            out[k] = (self.langs[first], float(total[first]), float(total[first] + np.log(np.exp(total - total[first]).sum())))
        return out


def train(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    sizes: tuple[int, ...] = (1, 2, 3),
    bits: int = 15,
    smoothing: float = 0.5,
) -> LanguageModel:
    """Counts every labelled text (rows with null text or lang are left out) and returns the model.

    The counts are summed by batch, then by (lang, bucket); what reaches the driver is languages x 2**bits at most, so the
    size of the model grows with the number of languages, not with the corpus. Repeated rows count each.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                sums.setdefault(lang, np.zeros(1 << bits, np.int64))
                sums[lang] += np.bincount(gram_buckets(text, sizes, bits), minlength=1 << bits)
                if len(sums) > 64:
                    yield from _sparse(sums)
                    sums = {}
            docs = batch.groupby("lang").size()
            yield pd.DataFrame({"lang": docs.index, "bucket": -1, "n": docs.to_numpy()})
        yield from _sparse(sums)

    counts = rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    langs = tuple(sorted(found["lang"].unique()))
    code = {x: i for i, x in enumerate(langs)}
    table = np.full((len(langs), 1 << bits), smoothing)
    docs = np.zeros(len(langs))
    row = found["lang"].map(code).to_numpy(dtype=np.int64)
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    np.add.at(table, (row[bucket >= 0], bucket[bucket >= 0]), n[bucket >= 0])
    np.add.at(docs, row[bucket < 0], n[bucket < 0])
    logp = np.log(table / table.sum(axis=1, keepdims=True)) if langs else table
    prior = np.log(docs / docs.sum()) if langs else docs
    return LanguageModel(langs, logp, prior, sizes, bits)


def _sparse(sums: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    for lang, all_counts in sums.items():
        at = np.flatnonzero(all_counts)
        yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": all_counts[at]})


def _judge(shared):
    @F.pandas_udf("lang string, top double, total double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.best(texts.tolist()), columns=["lang", "top", "total"])

    # So that a filter on the result doesn't make Spark judge every text twice.
    return judge.asNondeterministic()


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language", langs_at_once: int = 256) -> DataFrame:
    """docs plus a struct column `out` with lang_pred and score.

    lang_pred is a learned language, or 'und' with score 0 if the text is null, has no letter, or nothing was learned;
    score is the posterior probability. Ties go to the language first in order. Every row is judged for itself, over
    its whole text; other columns pass through, and one named like `out`, whatever its case, is replaced. No shuffle: the
    matrix is broadcast, in parts of langs_at_once languages (2**bits numbers each), whose results are put together.
    """
    context, keep = docs.sparkSession.sparkContext, without(docs.columns, out)
    parts = [model.part(k, k + langs_at_once) for k in range(0, max(1, len(model.langs)), langs_at_once)]
    judged = []
    for part in parts:
        judged.append(_judge(context.broadcast(part))(F.col(f"`{text_col}`").cast("string")))
    found = docs.select(*[F.col(f"`{c}`") for c in keep], F.array(*judged).alias(made := free_name("judged", keep)))
    higher = lambda a, b: F.when(b["top"] > a["top"], b).otherwise(a)
    first = F.element_at(made, 1)
    best = F.aggregate(F.slice(made, 2, max(1, len(parts) - 1)), first, higher) if len(parts) > 1 else first
    share = F.lit(1.0) / F.aggregate(made, F.lit(0.0), lambda s, x: s + F.exp(x["total"] - best["top"]))
    verdict = F.struct(F.coalesce(best["lang"], F.lit(UNDETERMINED)).alias("lang_pred"), F.coalesce(share, F.lit(0.0)).alias("score"))
    return found.select(*[F.col(f"`{c}`") for c in keep], verdict.alias(out))


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 3; null if the id is null."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3
