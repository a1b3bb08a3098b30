"""The small helpers against plain definitions."""

import os
import random
import re
from itertools import product

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from evalgrain.llm import bpe, decontaminate, language, line_dedup, ngram_join, packing, secret_scan, token_files, topk, words
from evalgrain.llm.base import recorded


def noise(rng: random.Random, n: int) -> str:
    letters = "ab cd\n\t'é ß漢字١٢3  \u0085\x1c\x1f​!?.,-_<|>😀 tion the 's 'll  "
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_encoding_words_gives_what_encoding_texts_gives(ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    for text in [noise(rng, n) for n in range(0, 600, 2)] + ["a" * 3000, "ab" * 500 + "!" * 200, " " * 300 + "x"]:
        words = packing.WORD.findall(text)
        assert "".join(words) == text
        assert [i for w in words for i in library.encode_ordinary(w)] == library.encode_ordinary(text)


def test_token_files_encode_words_as_the_library_encodes_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        made = f.read()
    library, rng = Tokenizer.from_file(path), random.Random(6)
    letters = ["a", "b", "ab", "tion", "é", "漢", "1", "23", "'", "s", "'ll", ".", ",", "_", " ", " ", " ", "\n", "😀"]
    texts = [noise(rng, n) for n in range(0, 200, 3)] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(600)]
    texts += ["", " ", "x ", " x", "a\nb c", "<|endoftext|> x", "a  b", "\n", "x\n", "\nx y"] + ["same words here and here again"] * 3
    for _ in range(2):
        ids, ends = token_files._ids_of(pa.array(texts), made, 2)
        found = [x.tolist() for x in np.split(ids, ends[:-1])]
        assert found == [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_patterns_that_cross_white_space_are_refused():
    bpe.check_pattern(public_tokenizers.PATTERN)
    for pattern in (r"\w+\s?|\W", r".+", r"[a-z]+ [a-z]+|."):
        with pytest.raises(ValueError):
            bpe.check_pattern(pattern)


def test_packed_words_and_numbers_come_back():
    words = [b"", b"a", b"\x00\n", "é".encode() * 300]
    assert bpe._unpack_words(bpe._pack_words(words)) == words
    numbers = np.array([0, 1, 255, 256, 70000, 2**32 - 1])
    assert packing.unpack_ids(packing.pack_ids(numbers)).tolist() == numbers.tolist()
    assert packing.unpack_ids(packing.pack_ids(np.empty(0, np.int64))).tolist() == []


def test_folded_words_are_those_of_the_pattern():
    rng = random.Random(7)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _ in range(100):
        text = noise(rng, 80) + "AZ[{`@/09:\x7f\x80"
        wanted = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(lower))
        assert [w.decode() for w in decontaminate.fold_words(text)] == wanted
        assert [m.group().translate(lower) for m in decontaminate._WORD.finditer(text)] == wanted


def test_windows():
    assert decontaminate.windows([], 3) == set()
    assert decontaminate.windows([b"a", b"b"], 3) == {b" a b "}
    assert decontaminate.windows([b"a", b"b", b"c", b"d"], 3) == {b" a b c ", b" b c d "}
    assert decontaminate.merged([(5, 7), (0, 2), (1, 3), (7, 8)]) == [(0, 3), (5, 8)]


def test_grams_of_short_texts():
    assert len(language.gram_buckets("", (1, 2, 3), 10)) == 2 + 1
    assert not language.has_letter("123 !") and language.has_letter("1é") and not language.has_letter(None)


def jaccard_sets(rng, n):
    base = [rng.randrange(1 << 60) for _ in range(n)]
    other = list(base)
    for _ in range(rng.randrange(0, n // 6 + 2)):
        if rng.random() < 0.5 and other:
            other.pop(rng.randrange(len(other)))
        else:
            other.append(rng.randrange(1 << 60))
    return (np.unique(np.array(x, np.uint64)) for x in (base, other))


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100)])
def test_linked_sets_share_a_signature_and_pass_the_bound(num, den):
    rng, t, linked = random.Random(8), ngram_join.Threshold(num, den), 0
    for _ in range(1500):
        a, b = jaccard_sets(rng, rng.choice([1, 2, 5, 9, 10, 11, 19, 20, 40, 100, 300]))
        if not len(a) or not len(b) or np.array_equal(a, b):
            continue
        both = len(np.intersect1d(a, b))
        assert t.linked(both, len(a) + len(b)) == (den * both >= num * (len(a) + len(b) - both))
        bound = ngram_join.shared_at_most(ngram_join.counts(a), ngram_join.counts(b))
        assert bound >= both
        if t.linked(both, len(a) + len(b)):
            linked += 1
            assert set(ngram_join.signatures(a, t)) & set(ngram_join.signatures(b, t))
    assert linked > 200


def test_tree_finds_every_pair_that_the_bound_allows():
    rng, t = np.random.default_rng(9), ngram_join.Threshold(90, 100)
    base = rng.integers(0, 12, (20, 64))
    points = np.concatenate([base + (rng.random(base.shape) < 0.03) for _ in range(12)])
    sizes = points.sum(axis=1)
    component = rng.integers(0, 3, len(points))
    found = {tuple(sorted(p)) for i, j in ngram_join.tree_pairs(points, sizes, component, t) for p in zip(i.tolist(), j.tolist(), strict=True)}
    wanted = {
        (i, j) for i, j in product(range(len(points)), repeat=2)
        if i < j and component[i] != component[j] and 190 * np.minimum(points[i], points[j]).sum() >= 90 * (sizes[i] + sizes[j])
    }
    assert found == wanted and wanted
    every, more = ngram_join.forest(points, sizes, component, t, None, True)
    assert {tuple(sorted(p)) for p in every} == wanted and not more
    few, more = ngram_join.forest(points, sizes, component, t, None, False)
    assert {tuple(sorted(p)) for p in few} < wanted and more and len(few) <= 2


def test_sorted_streams_are_cut_at_their_keys():
    rng = random.Random(3)
    rows = sorted((rng.randrange(6), rng.randrange(3), k) for k in range(200))
    table = pa.table(dict(zip("abv", zip(*rows, strict=True), strict=True)))
    for step in (1, 7, 500):
        found = [(a, b, t.column("v").to_pylist()) for a, b, t in words.grouped(iter(table.to_batches(step)), ("a", "b"))]
        assert [(a, b, v) for a, b, vs in found for v in vs] == rows and len(found) == len({r[:2] for r in rows})


def test_pruning_keeps_every_row_that_reaches_the_floor():
    rng = np.random.default_rng(11)
    for _ in range(60):
        matrix = rng.integers(-200, 200, (300, 8))
        query = rng.integers(-200, 200, 8)
        norms = np.sqrt((matrix.astype(float) ** 2).sum(axis=1))
        order = np.argsort(-norms)
        matrix, norms = matrix[order], norms[order]
        scores = matrix @ query
        floor = float(np.sort(scores)[-5])
        kept = topk.survivors(norms, matrix / norms[:, None], query, float(np.sqrt((query**2).sum())), floor, 3, 0.3)
        assert set(np.flatnonzero(scores >= floor)) <= set(kept)


def test_word_hashes_tell_words_apart_and_cut_as_the_pattern():
    rng = random.Random(12)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [noise(rng, rng.randrange(300)) for _ in range(40)] + [None, "", " "]
    assert [x.tolist() for x in words.many_word_hashes(texts)] == [words.word_hashes(t).tolist() for t in texts]
    segment, words.SEGMENT = words.SEGMENT, 40
    try:
        known: dict[str, int] = {}
        for _ in range(200):
            text = noise(rng, 150)
            wanted = re.findall("[^\x20\x09-\x0D]+", text.translate(lower))
            found = words.word_hashes(text).tolist()
            assert len(found) == len(wanted)
            for w, h in zip(wanted, found, strict=True):
                assert known.setdefault(w, h) == h
        assert len(set(known.values())) == len(known)
    finally:
        words.SEGMENT = segment


def edited(rng, words, times, letters):
    out = list(words)
    for _ in range(times):
        kind, at = rng.random(), rng.randrange(len(out))
        if kind < 0.4:
            out[at] = rng.choice(letters)
        elif kind < 0.7:
            out.insert(at, rng.choice(letters))
        elif len(out) > 5:
            out.pop(at)
    return out


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_lines_share_a_variant_that_is_an_own_one_and_word_variants_are_exact(edits):
    rng, bound = random.Random(14), line_dedup.Bound(edits, 4)
    met = 0
    for _ in range(500):
        a = [rng.choice("abcd") for _ in range(rng.randrange(3, 17))]
        b = edited(rng, a, rng.randrange(1, edits + 3), "abcd")
        table = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, j in product(range(1, len(a) + 1), range(1, len(b) + 1)):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        most = min(edits, min(len(a), len(b)) // 4)
        assert bound.edits(min(len(a), len(b))) == most
        near = table[-1][-1] <= most
        found = [{(int(k), m, g) for m, g, keys in line_dedup.edit_variants(line_dedup.hashed_words(" ".join(x)), most, most=64) for k in keys} for x in (a, b)]
        share = any((k, m, h) in found[1] for k, m, g in found[0] for h in range(most + 1 - m - g))
        assert line_dedup.within(a, b, most) == near == share
        if near and a != b:
            keys, line, own = line_dedup.segment_variants(f"x\n{'  '.join(a)}\t\n\n{' '.join(b)}".encode(), bound)
            x, y = ({k: o for k, n, o in sorted(zip(keys.tolist(), line.tolist(), own.tolist(), strict=True)) if n == m} for m in (1, 3))
            assert any(k in y and (x[k] or y[k]) for k in x)
            met += 1
    assert met > 60


def test_lines_that_want_others_are_held_against_lines_of_their_keys_only(spark):
    """Later listings of near lines take no key that no line asks for, and no line that goes."""
    side = spark.createDataFrame([(k, n, n % 2, f"t{n}") for k, n in ((1, 1), (1, 2), (1, 3), (2, 3), (2, 4), (3, 5), (3, 6))], "key long, node long, line int, other string")
    state = spark.createDataFrame([(2, 0, "goes"), (3, 1, "longer"), (4, 0, "open"), (5, 1, "open"), (6, 0, "stays")], "node long, line int, state string")
    got = sorted((r.key, r.node, r.asks) for r in line_dedup._asking(side, state).collect())
    assert got == [(1, 1, False), (1, 3, True), (2, 3, True), (2, 4, False)]
    assert line_dedup._asking(side, None).where("asks").count() == 7


def test_secret_threshold_is_measured_on_every_piece(spark, monkeypatch):
    """All pieces of all texts count for the threshold, more than 20,000 too, and the share over it is exact."""
    texts = ["".join(random.Random(k).choice("ghijkmnp") for _ in range(24 * 25)) for k in range(900)]
    docs, seen, real = spark.createDataFrame([(t,) for t in texts], "text string"), [], secret_scan.threshold
    monkeypatch.setattr(secret_scan, "threshold", lambda ratios, rate: seen.append(ratios.count()) or real(ratios, rate))
    secret_scan.fit(docs, strings=100)
    assert seen == [900 * 25]
    ratios = spark.range(30_000).select((F.col("id") / 1000).alias("ratio"))
    assert real(ratios, 0.001) == 29.969 and real(ratios.limit(0), 0.001) == 0.0


def test_secret_pieces_are_judged_by_other_folds_in_plain_expressions(spark, monkeypatch):
    """Each piece has the mean ratio that ratio() gives it by the counts of the other folds; no lambda runs over its letters, and identifiers are made once."""
    rng, seen, real = random.Random(5), [], secret_scan.threshold
    texts = [None, "", "a" * 23, "b" * 24, "c" * 25, "é" * 30, "+/_=-" * 20, *("".join(rng.choice(secret_scan.ALPHABET + " é") for _ in range(rng.randrange(400))) for _ in range(40))]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")

    def spy(ratios, rate):
        seen.append((ratios._jdf.queryExecution().optimizedPlan().toString(), sorted(r.ratio for r in ratios.collect())))
        return real(ratios, rate)

    monkeypatch.setattr(secret_scan, "threshold", spy)
    with recorded() as made:
        secret_scan.fit(docs, strings=300)
    assert len(made) == 1 and not os.path.exists(made[0].removeprefix("file://"))
    ordinary = [(r.text, r.fold) for r in secret_scan.ordinary_identifiers(docs).collect()]
    rows = [(t, f, True) for t, f in ((r.text, r.fold) for r in secret_scan.random_strings(spark, 300).collect())] + [(t, f, False) for t, f in ordinary]
    expected = []
    for k in range(secret_scan.FOLDS):
        model = secret_scan.train(spark.createDataFrame([(t, is_random) for t, fold, is_random in rows if fold != k], "text string, is_random boolean"))
        pieces = [p for t, fold in ordinary if fold == k for p in re.findall(f"[A-Za-z0-9+/_=-]{{{secret_scan.PIECE}}}", t)]
        assert pieces
        expected += [r.ratio for r in spark.createDataFrame([(p,) for p in pieces], "piece string").select(secret_scan.ratio(F.col("piece"), model).alias("ratio")).collect()]
    assert seen[0][1] == sorted(expected)
    assert "lambda" not in seen[0][0] and "regexp_replace" not in seen[0][0]
