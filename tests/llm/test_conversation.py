import hashlib
import itertools
import random
import re

import pytest

from tarn.llm import conversation
from tarn.llm.queries import damaged

NOTHING = hashlib.sha256().hexdigest()


def faults(rows):
    """rows: turn, role, text in order; each one's first fault."""
    seen, out = set(), []
    for _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def edits(rows, found):
    """Every cheapest way, by trying all strings of edits; (cost, audit, lines)."""
    best = None
    choices = []
    for (_, _, _), fault in zip(rows, found, strict=True):
        choices.append("D" if fault in ("blank", "duplicate") else "DKR")
    for ways in itertools.product(*choices):
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * n + e for n, e in zip(inserts, [*ways, ""], strict=True))
            left = [(e, i) for i, e in enumerate(ways) if e != "D"]
            m = len(left) + sum(inserts)
            slots, at, i = [], 0, 0
            for e in audit:
                if e == "D":
                    i += 1
                    continue
                at += 1
                want = "s" if m % 2 and at == 1 else "u" if (at + m) % 2 else "a"
                own = rows[i][1][:1] if e == "K" else want if want != "s" else None
                slots.append((e, rows[i] if e != "I" else None, want) if own == want else None)
                i += e != "I"
            if None in slots or m == 1:
                continue
            cost = 2 * ways.count("D") + ways.count("R") + 5 * sum(inserts) + 5 * sum(found[i] == "truncated" for _, i in left)
            if best is None or (cost, audit) < best[:2]:
                role = {"u": "user", "a": "assistant"}
                best = (cost, audit, "\n".join(f"{r[1] if e == 'K' else role[w]}:{r[2] if r else ''}" for e, r, w in slots))
    return best


def brute(rows):
    by: dict = {}
    for conv, *r in rows:
        by.setdefault(conv, []).append(r)
    out = []
    for conv, own in by.items():
        own = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in own), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        found = faults(own)
        cost, audit, lines = edits(own, found)
        turns = {t for t, _, _ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(out, key=str)


def some(rnd, conversations, most):
    rows = []
    for conv in range(conversations):
        for turn in range(rnd.randrange(1, most + 1)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "US", "supervisor"])
            text = rnd.choice(["Yes.", "No!", "Why?", "cut off", "Yes.", "", " \t\n", None, "Ends. \r\n", "漢字", "...x"])
            rows.append((conv if conv else None, rnd.choice([turn, turn, turn, turn + 2, None]), role, text))
    return rows


@pytest.mark.parametrize("rows_of_chunk", [1, 2, 256])
def test_against_all_edits(spark, rows_of_chunk):
    rows = some(random.Random(rows_of_chunk), 40, 4)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, conv string").repartition(3)
    got = conversation.repair(df, rows_of_chunk=rows_of_chunk, partitions=9)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_chunks_and_tree_change_nothing(spark, monkeypatch):
    """One conversation of 700 rows over 40 partitions, chunks of three rows, groups of four."""
    rnd = random.Random(7)
    rows = [(1, i, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice([f"a{i}.", f"b{i}?", f"cut {i}", "same."])) for i in range(700)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(conversation, "FAN", 4)
    split = sorted(tuple(r) for r in conversation.repair(df, rows_of_chunk=3, partitions=40).collect())
    own = [r[1:] for r in rows[:700]]
    found = faults(own)
    cost, audit = conversation.closed(conversation.shortest([(r[1][:1], conversation._kind(f or None)) for r, f in zip(own, found, strict=True)], 0))
    left = conversation.applied(audit, [r[1] for r in own], [r[2] for r in own])
    assert split[0][6:] == (cost, audit, hashlib.sha256(conversation._lines(left).encode()).hexdigest())
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r, _ in left)) and split[0][2:6] == (0, found.count("duplicate"), found.count("truncated"), sum(a[1][0] + b[1][0] not in ("su", "ua", "au") for a, b in itertools.pairwise(own)))
    assert split[1] == (2, 0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:Hi.\nassistant:Ho.").hexdigest())


def test_hot_conversation_of_equal_rows(spark):
    df = spark.range(3000).selectExpr("5L AS conv_id", "CAST(NULL AS long) AS turn", "'user' AS role", "'Hello.' AS text")
    (row,) = conversation.repair(df, partitions=7).collect()
    assert tuple(row)[:7] == (5, 0, 0, 2999, 0, 2999, 6000) and row["audit"] == "D" * 3000 and row["repaired_sha256"] == NOTHING


def test_reported_and_damaged(spark):
    rows = [(1, 0, "user", "Hi."), (None, None, None, None), (7, 3, "user", "x"), *[(9, t, "user", "a.b!c?") for t in range(300)]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    import zlib

    want = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = "user" if k == 4 else r or " ", "" if k == 1 else re.sub("[.!?]", "", x or " ") if k == 2 else x or " "
        want += [(c, t, r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    assert sorted((tuple(r) for r in damaged(turns).collect()), key=str) == sorted(want, key=str)
    out = conversation.reported(conversation.repair(damaged(turns).where("conv_id = 9")), turns)
    got = {r["conv_id"]: tuple(r)[1:] for r in out.collect()}
    assert set(got) == {1, None, 7, 9} and got[7] == got[None] == (0, 0, 0, 0, 0, 0, "", NOTHING)
    assert conversation.repair(turns.limit(0)).count() == 0
