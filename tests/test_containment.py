"""Texts that hold patterns: the same pairs as a loop, with candidates that follow the hits."""

import random

import pytest

from evalgrain.operators import containment


def frames(spark, texts, patterns):
    t = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string").repartition(4)
    return t, spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, pattern string")


def loop(texts, patterns):
    return {(i, j) for i, x in enumerate(texts) for j, y in enumerate(patterns) if x and y and y in x}


def pairs(df):
    out = [tuple(r) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("most", [0, 2, 64])
def test_equals_the_loop_for_words_cut_anywhere(spark, most):
    rng = random.Random(3)
    common, rare = ["the", "of", "a", "in", "thereof"], [f"w{k}" for k in range(80)]
    texts = [" ".join(rng.choice(common if rng.random() < 0.7 else rare) + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(40))) for _ in range(120)]
    texts += [None, "", "the", "théâtre of war", "...", "x" * 30_000 + " of the"]
    patterns = [t[i : i + n] for t in texts[:40] for i, n in ((rng.randrange(30), n) for n in (1, 2, 3, 6, 11, 25, 60))]
    patterns += [None, "", " ", ".", "the of in a", "of the", "e o", "thé", "ât", "w1", "not there at all", " the ", "THE", "zzz the", "of w", ", the"]
    t, p = frames(spark, texts, patterns)
    assert pairs(containment.contained(t, p, most=most, per_text=0)) == loop(texts, patterns)


def test_common_words_do_not_make_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [" ".join(rng.choice(["the", "of", "and", word()]) for _ in range(60)) for _ in range(1500)]
    patterns = [f"{word()} the {word()} of {word()}" for _ in range(150)]  # hits are chance
    patterns += [" ".join(texts[k].split()[5:9]) for k in range(100)] + [" ".join(["the", "of", "and", "the", "the", "of", "of", "and"][k % 8 :] + ["the", "of", "and"] * 3) for k in range(50)]
    t, p = frames(spark, texts, patterns)
    hits = loop(texts, patterns)
    some = containment.word_candidates(t, p, most=20, per_text=0)
    assert pairs(containment.contained(t, p, most=20, per_text=0)) == hits
    assert hits <= pairs(some) and some.count() <= 3 * (len(hits) + len(patterns)) < len(texts) * len(patterns) / 10


def test_short_numbers_and_missing_pieces(spark):
    rng = random.Random(5)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(30)) for _ in range(400)]
    patterns = [str(rng.randrange(1000, 10**5)) for _ in range(200)]
    t, p = frames(spark, texts, patterns)
    hits = loop(texts, patterns)
    assert pairs(containment.contained(t, p)) == pairs(containment.contained(t, p, by_words=False)) == hits
    assert containment.word_candidates(t, p).count() == len(hits)  # a word inside a word is a hit
    symbols = ["".join(rng.choice("†‡§¶•") for _ in range(40)) for _ in range(200)]
    marks = [s[3:15] for s in symbols[:20]] + ["†" * 12] * 3
    t, p = frames(spark, symbols, marks)
    assert pairs(containment.contained(t, p)) == loop(symbols, marks)


def test_empty_tables(spark):
    t, p = frames(spark, ["of the"], ["the"])
    for texts, patterns in ((t.limit(0), p), (t, p.limit(0)), (t.limit(0), p.limit(0))):
        assert containment.contained(texts, patterns).count() == containment.contained(texts, patterns, by_words=False).count() == 0
