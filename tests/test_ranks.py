"""Digests and ranges of rank lists against plain versions."""

import hashlib
import random

from evalgrain.operators import ledger, planning


def _sha(parts):
    return hashlib.sha256(",".join(map(str, parts)).encode()).hexdigest()


def _tree(ranks, chunk):
    low = min((r for r, _ in ranks), default=0)
    rows = [(r - low, i) for r, i in sorted(ranks)]
    while True:
        by = {}
        for at, said in rows:
            by.setdefault(at // chunk, []).append(said)
        rows = [(k, _sha(v)) for k, v in sorted(by.items())]
        if not rows or rows[-1][0] == 0:
            return rows[0][1] if rows else _sha([])


def test_digests_of_lists_of_any_length(spark):
    rng = random.Random(2)
    schema = "subset_rank int, source_index int"
    for n, chunk in ((0, 4), (1, 4), (4, 4), (5, 4), (70, 4), (70, 100)):
        ranks = [(k + 3, rng.randrange(1000)) for k in range(n)]
        rng.shuffle(ranks)
        df = spark.createDataFrame(ranks, schema).repartition(3)
        assert planning.list_digest(df, chunk).first().digest == _tree(ranks, chunk)
    # One chunk: the plain digest. A gap of whole ranges and a rank with two entries.
    assert planning.list_digest(df, 100).first().digest == _sha([i for _, i in sorted(ranks)])
    odd = [(0, 5), (0, 3), (90, 1), (91, 2)]
    assert planning.list_digest(spark.createDataFrame(odd, schema), 4).first().digest == _tree(odd, 4)
    checks = {r.check: r.ok for r in planning.subset_checks(df, 70, 1000, _sha([i for _, i in sorted(ranks)])).collect()}
    assert checks["size"] and checks["range"] and checks["digest"]


def test_flat_digests_join_all_ranges(spark):
    rng = random.Random(5)
    for n in (0, 3, 4, 5, 70):
        ranks = [(k + 3, rng.randrange(1000)) for k in range(n)]
        by = [_sha([i for _, i in ranks[k : k + 4]]) for k in range(0, n, 4)]
        df = spark.createDataFrame(rng.sample(ranks, n), "subset_rank int, source_index int").repartition(3)
        assert planning.list_digest(df, 4, flat=True).first().digest == (by[0] if len(by) == 1 else _sha(by))


def test_ranges_across_blocks(spark):
    rng = random.Random(4)
    ranks = {("a", k) for k in range(-5, 40)} | {("b", rng.randrange(200)) for _ in range(120)} | {("c", k) for k in (7, 8, 15, 16, 24)}
    df = spark.createDataFrame(sorted(ranks) + [("c", 7), ("d", None)], "policy string, subset_rank int")
    wanted = set()
    for p, k in ranks:
        if (p, k - 1) not in ranks:
            end = k
            while (p, end + 1) in ranks:
                end += 1
            wanted.add((p, k, end))
    assert sorted(map(tuple, ledger.rank_ranges(df, 8).collect())) == sorted(wanted)
    assert "subset_ranks" not in ledger.ledger_summary(df.selectExpr("*", "true AS correct"), 5, listed=False).columns
