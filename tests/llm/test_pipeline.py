"""The pipeline's stages one after another against plain versions of them."""

import re

import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from test_operators import LOWER, plain_components, plain_dedup

import corpus_pipeline
from evalgrain.llm import bpe


def test_stages_are_named_and_ordered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "benchmark_decontamination", "byte_bpe"]


def test_run(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    rows = [(int(i), t, None) for i, t in zip(docs["doc_id"], docs["text"], strict=True) if t is not None and any(c.isalpha() for c in t)]
    kept = []
    for (i, old, _), new in zip(rows, plain_dedup(rows), strict=True):
        if new == old or new.strip(" \t\r\x0b\x0c\n"):
            kept.append((i, new, None))
    _, labels, _ = plain_components(kept, 5, 80, 100)
    kept = [r for r, (i, _, least) in zip(kept, labels, strict=True) if i == least]
    win = set()
    for t in pd.read_parquet(f"{sf_dir}/benchmark.parquet")["text"]:
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        win |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    clean = []
    for i, t, _ in kept:
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        hit = {j for size in {len(x) for x in win} for k in range(len(w) - size + 1) if tuple(w[k : k + size]) in win for j in range(k, k + size)}
        if not hit or 20 * len(hit) < len(w):
            clean.append((i, t))
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {r.doc_id: (r.n_tokens, list(r.ids)) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert out == {i: (len(ids := library.encode_ordinary(t)), ids) for i, t in clean}
    assert 0 < len(out) < len(docs)


def test_stages_pass_odd_rows_and_columns(spark, sf_dir):
    rows = [(1, "some words of a text " * 4, "en", 3), (None, None, None, None), (2, "", "en", 0), (3, "word\nword", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").withColumns({c: F.lit(1) for c in ("language", "contamination", "node", "n_lines")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        names = docs.columns
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == names
    got = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert got[3] == ("word", 4) and set(got) == {1, 3}
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs.limit(0), sf_dir)
        assert docs.count() == 0
