"""Language-model scores: counts by a plain version, gradients by differences, probabilities that sum to one, held-out gain."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from evalgrain.llm import lm_scoring, queries, words
from evalgrain.llm.recurrent import Adam, Lanes, Recurrent

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def plain_base(rows):
    """(n_tokens, n_known, N, base score) by row of (doc_id, text)."""
    c = collections.Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(len(w := tokens(t)), sum(x in c for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for _, t in rows]


def small(seed=1, n=12, classes=3, hidden=4):
    return Recurrent.fresh(np.arange(n, 0, -1.0), classes, hidden, seed)


def test_gradients_by_differences():
    rng, model = np.random.default_rng(2), small()
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    texts = [rng.integers(0, 12, n) for n in (5, 1, 9, 3)]

    class Seen(Adam):
        def step(self, weights, grads, count):
            self.grads = {k: g.copy() for k, g in grads.items()}

    seen = Seen()
    model.learn(texts, 0, seen, lanes=1)  # one lane and one window: the gradient is whole
    for name, grad in seen.grads.items():
        flat = model.weights[name].reshape(-1)
        for k in rng.choice(flat.size, min(6, flat.size), replace=False):
            old, told = flat[k], []
            for step in (1e-3, -1e-3):
                flat[k] = old + step
                told.append(model.log_probabilities(texts, 0).sum())
            flat[k] = old
            assert abs((told[0] - told[1]) / 2e-3 - grad.reshape(-1)[k]) < 2e-3 * max(1, abs(grad.reshape(-1)[k]))


def test_probabilities_sum_to_one_and_state_is_carried():
    model = small(3)
    model.weights = {k: v * 3 for k, v in model.weights.items()}
    rng = np.random.default_rng(4)
    long = rng.integers(0, 12, 150)  # several windows
    given = model.log_probabilities([long], 0)[0]
    after = np.array([model.log_probabilities([np.append(long, k)], 0)[0] for k in range(12)])
    assert abs(np.exp(after - given).sum() - 1) < 1e-3
    other = long.copy()
    other[0] = (other[0] + 1) % 12
    ends = [model.log_probabilities([x], 0)[0] - model.log_probabilities([x[:40]], 0)[0] for x in (long, other)]
    assert ends[0] != ends[1]  # what came before a window still counts in it
    texts = [rng.integers(0, 12, n) for n in (1, 70, 3, 40, 33, 2, 2, 90)]
    together = model.log_probabilities(texts, 0, lanes=3)
    assert np.allclose(together, [model.log_probabilities([t], 0)[0] for t in texts], rtol=1e-4)


def test_lanes_hold_every_token_once():
    rng = random.Random(3)
    texts = [np.full(rng.randrange(1, 60), k) for k in range(30)]
    for laid in (Lanes.of(texts, 4), Lanes.even(texts, 4)):
        seen = collections.Counter()
        for at, token, _, _ in laid.windows(99):
            seen.update(token[at >= 0].tolist())
        assert seen == collections.Counter({k: len(t) for k, t in enumerate(texts)})


def test_learns_what_counts_cannot_tell():
    rng = np.random.default_rng(5)
    texts = [np.append((np.arange(60) * 5 + rng.integers(0, 12)) % 12, 0) for _ in range(300)]
    model = Recurrent.fresh(np.bincount(np.concatenate(texts), minlength=12).astype(float), 3, 8)
    before, optimizer = model.log_probabilities(texts[:20], 0).sum(), Adam(0.02)
    for _ in range(6):
        model.learn(texts[20:], 0, optimizer, lanes=32)
    assert model.log_probabilities(texts[:20], 0).sum() > 0.5 * before


def test_counts_and_base_by_plain_version(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "The", "of", "été", "x1", "ÀB", "rare%d" % rng.randrange(50)]) for _ in range(rng.randrange(1, 80))) for _ in range(120)]
    rows = list(enumerate(texts)) + [(300, None), (301, ""), (302, " \t\n"), (303, "word " * 30_000), (304, texts[0]), (304, texts[0]), (None, "of no id"), (305, "\x0bthe\x0cof\u00a0x")]
    frame = spark.createDataFrame([(*r, "b", 1, "w", "j", "o") for r in rows], "doc_id long, text string, block string, node int, word string, c0 string, LM string").repartition(3)
    held = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 2, F.lit(False))
    counts = lm_scoring.count_words(frame.where(~held))
    model = lm_scoring.train(frame.where(~held), counts, classes=4, width=4, hidden=4, rounds=(2, 6), of=8)
    out = lm_scoring.score(frame, model, counts)
    assert out.columns == ["doc_id", "text", "block", "node", "word", "c0", "lm"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    got = sorted(((r.doc_id, r.text, (r.lm.n_tokens, r.lm.n_known, r.lm.train_tokens), r.lm.base_score, r.lm.score) for r in out.collect()), key=key)
    want = sorted(((*r, x[:3], x[3]) for r, x in zip(rows, plain_base(rows), strict=True)), key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-6 * abs(w[3]) for g, w in zip(got, want, strict=True))
    # A word after "the ", over all counted words and one never seen, takes the whole probability.
    seen = collections.Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
    probe = spark.createDataFrame([(f"the {w}",) for w in seen if w] + [("the",)], "text string")
    end = model.recurrent.log_probabilities
    hashes = list(words.many_word_hashes([f"the {w}" for w in seen if w]))
    inside = [np.exp(end([model.tokens(h)], model.end)[0]) for h in hashes if model.tokens(h)[1] != model.other]
    outside = np.exp(end([np.append(model.tokens(hashes[0][:1]), model.other)], model.end)[0])
    closed = np.exp(end([np.append(model.tokens(hashes[0][:1]), model.end)], model.end)[0])
    assert abs(sum(inside) + outside + closed - np.exp(end([model.tokens(hashes[0][:1])], model.end)[0])) < 1e-4 and probe.count() > 20
    assert sum(n + 1 for w, n in seen.items() if w and model.tokens(words.word_hashes(w))[0] == model.other) == model.other_n + model.other_distinct


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    counts = lm_scoring.count_words(none)
    model = lm_scoring.train(none, counts, classes=2, width=4)
    assert lm_scoring.score(none, model, counts).count() == 0
    one = lm_scoring.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model, counts).first().lm
    assert (one.n_tokens, one.n_known, one.train_tokens, one.base_score) == (3, 0, 0, 0.0) and one.score < 0


def test_query(spark, sf_dir):
    out = queries.op13_lm_scoring(spark, sf_dir).toPandas().sort_values("doc_id")
    table = pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id")
    want = plain_base([(int(i), t) for i, t in zip(table["doc_id"], table["text"], strict=True)])
    assert list(out[["n_tokens", "n_known", "train_tokens"]].itertuples(index=False, name=None)) == [w[:3] for w in want]
    assert np.allclose(out["base_score"], [w[3] for w in want])
    held = out["held_out"]
    assert held.tolist() == [zlib.crc32(str(i).encode()) % 7 == 2 for i in table["doc_id"]]
    assert out["score"][held].sum() > out["base_score"][held].sum()


def test_learns_from_every_text_once(spark, monkeypatch):
    """Weights come from all texts, null ones (one end) too, not from a share of them."""
    seen, learn = spark.sparkContext.accumulator(0), lm_scoring._learn

    def counted(shared, rate):
        inner = learn(shared, rate)

        def run(batches):
            def told():
                for batch in batches:
                    seen.add(batch.num_rows)
                    yield batch

            return inner(told())

        return run

    monkeypatch.setattr(lm_scoring, "_learn", counted)
    docs = spark.createDataFrame([(k, f"text number {k} of many") for k in range(300)] + [(300, None)], "doc_id long, text string")
    lm_scoring.train(docs, lm_scoring.count_words(docs), classes=4, width=4, hidden=4)
    assert seen.value == 301
