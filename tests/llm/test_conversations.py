"""Conversation repair against plain recursion and against every edit there is."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalgrain.llm import blocks, conversations, queries

GOOD = re.compile("(s?(ua)+)?")


def faults(rows):
    """(initial, fault) of (role, text) rows."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip("\x20\t\n\v\f\r")
        fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def plain_audit(marks):
    """Least (cost, audit), by recursion over suffixes with strings."""

    @functools.lru_cache(None)
    def best(i, sofar, inserts):
        ways = [(0, "")] if i == len(marks) and sofar in ("", "a") else []

        def way(cost, letter, rest):
            if rest is not None:
                ways.append((cost + rest[0], letter + rest[1]))

        role = "a" if sofar == "u" else "u"
        if inserts < 2:
            way(3, "I", best(i, role, inserts + 1))
        if i < len(marks):
            initial, fault = marks[i]
            way(4, "D", best(i + 1, sofar, 0))
            if fault not in (1, 2):
                extra = 3 if fault == 3 else 0
                way(3 + extra, "R", best(i + 1, role, 0))
                if initial == role or (initial == "s" and sofar == ""):
                    way(extra, "K", best(i + 1, initial, 0))
        return min(ways, default=None)

    return best(0, "", 0)


def every_audit(marks):
    """Least (cost, audit) of all edits with at most two inserted rows between two others."""
    found = []
    for plan in itertools.product(["", "I", "II"], ["D", "K", "R"], repeat=len(marks)):
        for tail in ("", "I", "II"):
            audit, cost, roles, wrong = "", 0, [""], False
            for k, (initial, fault) in enumerate(marks):
                audit += plan[2 * k] + plan[2 * k + 1]
            audit += tail
            at = 0
            roles = [""]
            for letter in audit:
                if letter == "I":
                    cost += 3
                    roles = [r + x for r in roles for x in "ua"]
                    continue
                initial, fault = marks[at]
                at += 1
                if letter == "D":
                    cost += 4
                    continue
                wrong |= fault in (1, 2)
                cost += (3 if fault == 3 else 0) + (3 if letter == "R" else 0)
                roles = [r + x for r in roles for x in ("ua" if letter == "R" else initial)] if letter == "R" or initial else roles
            if not wrong and any(GOOD.fullmatch(r) for r in roles):
                found.append((cost, audit))
    return min(found)


def test_integer_minima_against_every_edit():
    rng = random.Random(5)
    for n in (0, 1, 2, 3):
        for _ in range(12):
            marks = [(rng.choice("suat"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
            assert conversations.whole_audit(marks) == every_audit(marks) == plain_audit(tuple(marks))


def test_integer_minima_and_pieces_against_recursion():
    rng = random.Random(6)
    for _ in range(150):
        marks = tuple((rng.choice("suuaat"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(1, 40)))
        assert conversations.whole_audit(list(marks)) == plain_audit(marks)
        cuts = sorted(rng.sample(range(len(marks) + 1), min(3, len(marks))))
        pieces = [conversations._Piece.of(list(marks[i:j])) for i, j in zip([0, *cuts], [*cuts, len(marks)], strict=True)]
        pieces = [conversations._Piece.unpacked(p.digits, p.packed()) for p in pieces]
        left = functools.reduce(lambda a, b: a.then(b), pieces)
        right = functools.reduce(lambda a, b: b.then(a), reversed(pieces))
        assert left.told() == right.told() == plain_audit(marks)


def repaired(marks_rows, audit):
    stays = sum(x != "D" for x in audit)
    out, at, emitted = [], 0, 0
    for letter in audit:
        if letter != "I":
            role, text = marks_rows[at]
            at += 1
        if letter == "D":
            continue
        made = "user" if (emitted - stays % 2) % 2 == 0 else "assistant"
        out.append(f"{made if letter in 'IR' else role}:{'' if letter == 'I' else text}")
        emitted += 1
    return out


def plain_report(rows):
    """conv -> the columns of the query, from rows (conv_id, turn, role, text) as given."""
    damaged, convs = [], {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        damaged += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, turn, role, text in damaged:
        convs[conv].append((turn is not None, turn or 0, role, text))
    out = {}
    for conv, some in convs.items():
        some.sort()
        turns = {t for known, t, _, _ in some if known}
        marks = tuple(faults([x[2:] for x in some]))
        cost, audit = plain_audit(marks)
        lines = repaired([x[2:] for x in some], audit)
        count = [sum(f == k for _, f in marks) for k in (1, 2, 3)]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marks))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def by_conv(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(7)
    words = ["Hello there.", "Why?", "no end", " ", "", None, "Yes!\n", "tab\tend. ", "été", "ñ."]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(words)) for c in range(40) for t in range(rng.randrange(1, 7))]
    rows += [(None, t, r, "Of no conversation.") for t, r in [(0, "user"), (1, "assistant"), (None, "user"), (5, "user")]]
    rows += [(77, None, "user", "No turn."), (77, None, "user", None), (78, 1, "user", "x" * 70_000 + "."), (78, 4, "assistant", "y" * 70_000)]
    rows += [(90, t, ("user", "assistant")[t % 2], f"Row {t}." if t % 7 else f"cut {t}") for t in range(120)]
    rows += [(91, 3, "user", "The same.") for _ in range(50)]
    rows += [(92, t, "user", "All of one side.") for t in range(30)]
    return rows


def small_blocks(monkeypatch, bits):
    monkeypatch.setattr(blocks, "BLOCK_BITS", bits)


@pytest.mark.parametrize("bits", [11, 2])
def test_query_against_recursion(spark, odd_rows, tmp_path, monkeypatch, bits):
    small_blocks(monkeypatch, bits)
    frame = spark.createDataFrame(odd_rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("b")).withColumn("node", F.lit(1))
    frame.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    assert by_conv(queries.op12_conversation_repair(spark, str(tmp_path))) == plain_report(odd_rows)


def test_query_on_the_table(spark, sf_dir):
    table = pd.read_parquet(f"{sf_dir}/conversations.parquet")
    rows = list(table[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None))
    assert by_conv(queries.op12_conversation_repair(spark, sf_dir)) == plain_report(rows)


def test_edits_and_empty_table(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", " "), (1, 3, "tool", "Done.")]
    frame = spark.createDataFrame([(*r, "more") for r in rows], "id int, at long, who string, said string, conv string")
    out = conversations.repair(frame, "id", "at", "who", "said")
    assert [tuple(r) for r in out.edits.orderBy("step").collect()] == [
        (1, 0, "K", 0, "system", "Be kind."), (1, 1, "K", 1, "user", "Hi."), (1, 2, "D", 2, "user", " "), (1, 3, "R", 3, "assistant", "Done."),
    ]
    assert out.messages().count() == 3 and out.report.first().cost == 7
    none = conversations.repair(frame.limit(0), "id", "at", "who", "said")
    assert none.report.count() == none.edits.count() == conversations.digests(none.messages()).count() == 0
