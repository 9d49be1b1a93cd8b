"""Conversation repair against a search over edit strings, whole and in chunks."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

import __spark_entry__
from sessionlog.llm import turn_repair

SF = "/root/testdata/sf0.001"


def plain_damage(rows):
    """(conv, turn, role, text) after damage, in order, by conversation."""
    out = {}
    one = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        code = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if code == 0:
            continue
        text = "" if code == 1 else re.sub(r"[.!?]", "", text) if code == 2 else text
        own += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for k, v in out.items()}


def plain_repair(rows):
    """The contract's numbers by a search over (cost, edit string)."""
    faults, seen = [], set()
    for _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    allowed = lambda roles: re.match(r"^(s?(ua)*u?)?$", roles)  # noqa: E731 - what can still grow into (s?(ua)+)?

    # The state is the shortest string of initials that goes on in the same ways.
    def grown(state, initial):
        new = state + initial
        if not allowed(new) or not initial:
            return None
        return {"": "", "s": "s", "u": "u", "su": "u", "ua": "ua", "sua": "ua", "uau": "u"}[new]

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        options = []
        if i == len(rows) and state in ("", "ua"):
            options.append((0, ""))
        if inserted < 3:
            for r in "ua":
                if (s := grown(state, r)) is not None:
                    c, a = best(i, s, inserted + 1)
                    options.append((c + 5, "I" + a))
        if i < len(rows):
            c, a = best(i + 1, state, 0)
            options.append((c + 2, "D" + a))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                if (s := grown(state, rows[i][1][:1])) is not None:
                    c, a = best(i + 1, s, 0)
                    options.append((c + more, "K" + a))
                for r in "ua":
                    if (s := grown(state, r)) is not None:
                        c, a = best(i + 1, s, 0)
                        options.append((c + 1 + more, "R" + a))
        return min(options, default=(10**9, ""))

    for i in reversed(range(len(rows) + 1)):  # keeps the recursion flat
        for inserted in (3, 2, 1, 0):
            for state in ("", "s", "u", "ua"):
                best(i, state, inserted)
    cost, audit = best(0, "", 0)
    out, i = [], 0
    for edit in audit:
        if edit != "D":
            first_s = bool(out) and out[0].startswith("s") and (len(out) % 2 == 1)
            asked = "user" if (len(out) % 2 == 0) != (bool(out) and out[0][0] == "s") or first_s else "assistant"
            role, text = (asked, "") if edit == "I" else (rows[i][1] if edit == "K" else asked, rows[i][2])
            out.append(f"{role}:{text}")
        i += edit != "I"
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(df):
    return {r.conv_id: tuple(r[c] for c in NAMES) for r in df.collect()}


def odd_conversations():
    rnd = random.Random(11)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "unknown", "User"]
    texts = ["Hello.", "What?", "no end", "", " \t", None, "A. B! C?", "same words.", "same words.", "é…", "x" * 3000 + "!", "end. \n"]
    rows = [(conv, rnd.choice([None, *range(-3, 12)]), rnd.choice(roles), rnd.choice(texts)) for conv in [None, *range(-2, 250)] for _ in range(rnd.randint(1, 9))]
    # one conversation with a third of all rows, half of them equal
    for i in range(len(rows) // 2):
        rows.append((777, i if i % 2 else 5, rnd.choice(["user", "assistant", "system", "tool"]) if i % 2 else "user", rnd.choice(["Yes.", "so", f"Turn {i}."]) if i % 2 else "Yes."))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, audit string, kind int, cost long, pos string"


@pytest.mark.parametrize("chunk_rows", [4096, 7, 1], ids=["whole", "chunks", "rows"])
def test_repair(spark, chunk_rows):
    rows = odd_conversations()
    frame = spark.createDataFrame([(*r, "clash", 1, 2, "clash") for r in rows], SCHEMA)
    want = {k: plain_repair(v) for k, v in plain_damage(rows).items()}
    assert got(turn_repair.repair(turn_repair.damaged(frame), chunk_rows=chunk_rows)) == want
    assert max(len(w[6]) for w in want.values()) > 300 and all(any(e in w[6] for w in want.values()) for e in "DKR")  # deleting is always cheaper than inserting


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repair(turn_repair.damaged(none)).count() == 0
    # every row dropped by the damage: zeros, an empty audit, the hash of an empty string
    dropped = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    found = got(turn_repair.repair(turn_repair.damaged(spark.createDataFrame([(1, dropped, "user", "Hi.", "", 0, 0, "")], SCHEMA))))
    assert found == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_extreme_turns(spark):
    rows = [(1, -(2**63), "user", "A."), (1, 2**63 - 1, "assistant", "B."), (1, None, "user", "C.")]
    frame = spark.createDataFrame([(*r, "", 0, 0, "") for r in rows], SCHEMA)
    for chunk_rows in (4096, 1):
        assert turn_repair.repair(turn_repair.damaged(frame), chunk_rows=chunk_rows).first().gaps in (0, 2**63 - 1)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = __spark_entry__.queries()["op11_turn_repair"](spark, SF)
    assert got(found) == {k: plain_repair(v) for k, v in plain_damage(rows).items()}
    assert [f.dataType.simpleString() for f in found.schema.fields[1:7]] == ["bigint"] * 6
