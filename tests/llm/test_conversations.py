"""Conversation repair beside a search over all edits, and its digest beside a plain one."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from lexgrove.llm import conversations

COLUMNS = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        spaced = lambda x: " " if x is None else str(x)
        draw = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if draw == 0:
            continue
        text = "" if draw == 1 else "".join(c for c in text if c not in ".!?") if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def repaired(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired turns of one conversation's rows."""
    rows = sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), r[2].encode(), r[3].encode()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        cut = text.rstrip(WHITE)
        faults.append("blank" if not cut else "duplicate" if (role, text) in seen else "truncated" if cut[-1] not in ".!?" else "")
        seen.add((role, text))

    accepts = lambda initials: initials == "" or (s := initials.removeprefix("s")) != "" and s == "ua" * (len(s) // 2)

    @lru_cache(None)
    def best(i, sequence):
        """Cheapest (cost, letters, turns) of the rows from i on, after turns of those initials (their last two say it all)."""
        found = []
        if i == len(rows) and accepts(sequence):
            found.append((0, "", ()))
        if len(sequence) <= 2 * len(rows) + 4 and (not sequence or accepts(sequence) or accepts(sequence + "a") or accepts(sequence + "ua")):
            more = lambda cost, letter, rest, turn: found.append((cost + rest[0], letter + rest[1], (turn, *rest[2]) if turn else rest[2]))
            if len(sequence) - 2 <= 2 * i + 3:
                for name in ("user", "assistant"):
                    if fits(sequence + name[0]) and (rest := best(i, sequence + name[0])):
                        more(2, "I", rest, (name, ""))
            if i < len(rows):
                role, text, late = rows[i][2], rows[i][3], faults[i] == "truncated"
                if rest := best(i + 1, sequence):
                    more(3, "D", rest, None)
                if faults[i] in ("", "truncated"):
                    for name in ("user", "assistant"):
                        if fits(sequence + name[0]) and (rest := best(i + 1, sequence + name[0])):
                            more(2 + late, "R", rest, (name, text))
                    if fits(sequence + (role[:1] or "?")) and (rest := best(i + 1, sequence + role[:1])):
                        more(late, "K", rest, (role, text))
        return min(found, key=lambda x: (x[0], x[1])) if found else None

    def fits(initials):
        body = initials.removeprefix("s")
        return all(c == "ua"[k % 2] for k, c in enumerate(body))

    cost, audit, turns = best(0, "")
    known = [r[1] for r in rows if r[1] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())


def plain(rows):
    out = {conv: [] for conv, *_ in rows}
    for r in rows:
        out[r[0]].append((r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
    return {conv: repaired(own) for conv, own in out.items()}


def run(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", 1, b"z") for r in rows], COLUMNS + ", fault string, block int, codes binary").repartition(3)
    found = conversations.digest(conversations.repair(frame, **options)).collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}
    assert len(got) == len(found)
    return got


def draw(rng, convs, n):
    texts = ["Well.", "Why?", "no end", "No!", "ok. ", "", " \t", None, "é.", "a\nb!", "x" * 90 + ".", "x" * 90 + "!"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "u", "sys"]
    return [(conv, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for conv in convs for _ in range(rng.randrange(1, n))]


@pytest.mark.parametrize("block_rows", [1, 3, 4096])
def test_equals_a_search_over_all_edits(spark, block_rows):
    rng = random.Random(block_rows)
    rows = draw(rng, [None, -1, *range(40)], 7) + draw(rng, [100, 101], 15)
    rows += rows[::9] + [(200, 1, "user", "Same."), (201, None, None, None)] * 3
    assert run(spark, rows, block_rows=block_rows) == plain(rows)


def test_long_conversations_in_blocks(spark):
    """Blocks chained backwards and forwards give what one walk over the whole conversation gives."""
    rng = random.Random(8)
    rows = [(c, i, rng.choice(["user", "assistant", "assistant", "system", "tool"]), rng.choice(["Yes.", "no", ""]) + f" {i}" * rng.randrange(2) + rng.choice([".", "", "!"])) for c in (1, 2) for i in range(900) if i % 7]
    rows += [(3, 5, "user", "Copy.")] * 2000
    got = run(spark, rows, block_rows=16)
    assert got == run(spark, rows)
    assert got[3] == (0, 0, 1999, 0, 1999, 5999, "K" + "D" * 1999 + "I", hashlib.sha256(b"user:Copy.\nassistant:").hexdigest())
    for conv in (1, 2):
        assert len(got[conv][6].replace("I", "")) == len({r for r in rows if r[0] == conv}) and got[conv][0] == 0 + len({i for i in range(1, 899) if not i % 7})


def test_walk_of_codes():
    codes = lambda s: bytes("suax".index(c) for c in s)
    audit = lambda s: "".join(conversations.walk(codes(s), np.ones(len(s), np.int64), 0, None)[0])
    assert audit("") == "" and audit("suaua") == "KKKKK" and audit("u") == "KI" and audit("a") == "IK" and audit("s") == "D"
    assert audit("uu") == "KR" and audit("uau") == "KKKI" and audit("ss") == "KIR" and audit("x") == "D" and audit("uaa") == "KKIK"


def test_damage_and_odd_tables(spark):
    rows = draw(random.Random(3), [None, *range(60)], 6)
    got = conversations.damage(spark.createDataFrame([(*r, 1) for r in rows], COLUMNS + ", draw int")).collect()
    key = lambda r: tuple((x is not None, x or 0) if i < 2 else x for i, x in enumerate(r))
    assert sorted(map(tuple, got), key=key) == sorted(damaged(rows), key=key)
    assert run(spark, [(1, 1, "user", "x.")])[1][5:7] == (2, "KI")
    empty = spark.createDataFrame([], COLUMNS)
    assert conversations.digest(conversations.repair(empty)).count() == 0 and conversations.damage(empty).count() == 0
