import hashlib
import random
import zlib
from itertools import product

import numpy as np
import pytest

import tamhis.llm.conversation_repair as C
from tamhis.llm.queries import QUERIES, damaged

SPACE = set(" \t\n\x0b\x0c\r")


def plain(rows):
    """(counts, cost, audit, messages) of rows in order, by keeping the best (cost, audit, messages) of each state."""
    seen, illegal, truncated_, blank, duplicate = set(), 0, 0, 0, 0
    best = {0: (0, "", ())}
    nexts = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    full = {"u": "user", "a": "assistant"}

    def inserted(states):
        todo = dict(states)
        for _ in range(3):
            for p, (c, a, m) in list(todo.items()):
                for letter, q in nexts[p].items():
                    if letter != "s":
                        new = (c + 5, a + "I", (*m, full[letter] + ":"))
                        if q not in todo or new[:2] < todo[q][:2]:
                            todo[q] = new
        return todo

    for i, (role, text) in enumerate(rows):
        if i and (rows[i - 1][0][:1] + role[:1]) not in ("su", "ua", "au"):
            illegal += 1
        ink = [c for c in text if c not in SPACE]
        gone = cut = False
        if not ink:
            blank, gone = blank + 1, True
        elif (role, text) in seen:
            duplicate, gone = duplicate + 1, True
        elif ink[-1] not in ".!?":
            truncated_, cut = truncated_ + 1, True
        seen.add((role, text))
        after = {}
        for p, (c, a, m) in inserted(best).items():
            able = [(c + 2, a + "D", m, p)]
            if not gone:
                for letter, q in nexts[p].items():
                    if letter == role[:1]:
                        able.append((c + 5 * cut, a + "K", (*m, f"{role}:{text}"), q))
                    if letter != "s":
                        able.append((c + 1 + 5 * cut, a + "R", (*m, f"{full[letter]}:{text}"), q))
            for *new, q in able:
                if q not in after or tuple(new[:2]) < after[q][:2]:
                    after[q] = tuple(new)
        best = after
    end = inserted(best)
    cost, audit, messages = min((end[p] for p in (0, 3) if p in end), key=lambda x: x[:2])
    return (blank, duplicate, truncated_, illegal), cost, audit, messages


ROLES, TEXTS = ("system", "user", "assistant", "tool", "", "usher"), ("a.", "b", " ", "", "c!", "d?\n", "e .x", "a.", "\x0b")


def cases(rng, n, longest):
    return [[(rng.choice(ROLES[:rng.randint(2, 6)]), rng.choice(TEXTS) if rng.random() < 0.5 else f"t{rng.random()}" + rng.choice((".", "")))
             for _ in range(rng.randint(1, longest))] for _ in range(n)]


def check(spark, convs):
    rows = [(i, k, r, t) for i, c in enumerate(convs) for k, (r, t) in enumerate(c)]
    random.Random(1).shuffle(rows)
    fixed = C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in fixed.conversations.collect()}
    hashes = {r.conv_id: r.sha256 for r in C.transcripts(fixed.messages).collect()}
    messages = {}
    for r in fixed.messages.orderBy("conv_id", "seq", "part").collect():
        messages.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert len(got) == len(convs)
    for i, c in enumerate(convs):
        counts, cost, audit, want = plain(c)
        r = got[i]
        assert ((r.blank, r.duplicate, r.truncated, r.illegal), r.cost, r.audit, r.gaps) == (counts, cost, audit, 0), c
        assert messages.get(i, []) == list(want)
        assert hashes.get(i, hashlib.sha256().hexdigest()) == hashlib.sha256("\n".join(want).encode()).hexdigest()
    fixed.release()


def test_equals_all_sequences_of_edits(spark):
    check(spark, cases(random.Random(3), 400, 14))


def test_segments_of_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT_BITS", 3)
    check(spark, cases(random.Random(4), 12, 300) + cases(random.Random(5), 60, 20))


def test_block_tables():
    """Every block of two: the transition of its vector equals two single steps, for every vector."""
    table = C.Tables(2)
    for block, (a, b) in enumerate(product(range(C.SYMBOLS), repeat=2)):
        for v, vector in enumerate(table.vectors):
            raw = C.before(a, C.before(b, vector))
            assert table.vectors[table.to[block, v]] == tuple(c - min(raw) for c in raw) and table.add[block, v] == min(raw)
    assert table.blocks(np.array([1, 2, 8])).tolist() == [12, 89]


def test_edges(spark):
    rows = [
        (None, None, None, None, 1), (None, 3, "user", "x.", 2), (None, 5, "assistant", "y.", 3), (1, None, None, "only null turns.", 4), (2, 1, "user", "same.", 5),
        (2, 1, "user", "same.", 5), (2, 9, "assistant", "long " * 50000 + ".", 6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int").selectExpr("*", "'x' AS conv", "1 AS digest", "2 AS code")
    fixed = C.repair(df)
    got = {r.conv_id: tuple(r)[1:] for r in fixed.conversations.collect()}
    assert got == {None: (1, 1, 0, 0, 1, 2, "DKK"), 1: (0, 0, 0, 0, 0, 2, "D"), 2: (7, 0, 1, 0, 1, 2, "KDK")}
    assert sorted((str(r.conv_id), r.turn, r.role, r.edit) for r in fixed.messages.collect()) == [
        ("2", 1, "user", "keep"), ("2", 9, "assistant", "keep"), ("None", 3, "user", "keep"), ("None", 5, "assistant", "keep")]
    none = C.repair(df.limit(0))
    assert none.conversations.count() == none.messages.count() == C.transcripts(none.messages).count() == 0


def test_query(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    odd = spark.createDataFrame([(None, None, None, None), (None, 2, "user", None), (9000001, 0, "user", "hm")], source.schema)
    odd = odd.union(spark.createDataFrame([(9000002 + i, 0, "user", "hm.") for i in range(40)], source.schema))
    rows = source.union(odd)
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()}
    convs = {}
    for conv, turn, role, text in map(tuple, rows.collect()):
        mine = convs.setdefault(conv, [])
        show = [" " if x is None else str(x) for x in (conv, turn)]
        fault = zlib.crc32(":".join(show).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if fault:
            text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
            mine += [(turn is not None, turn or 0, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    assert set(got) == set(convs) and any(not c for c in convs.values())
    for conv, mine in convs.items():
        mine.sort(key=lambda x: x[:2])
        counts, cost, audit, want = plain([x[2:] for x in mine])
        turns = [x[1] for x in mine if x[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        r = got[conv]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (gaps, *counts, cost, audit)
        assert r.repaired_sha256 == hashlib.sha256("\n".join(want).encode()).hexdigest()
    assert damaged(source).count() > 0
