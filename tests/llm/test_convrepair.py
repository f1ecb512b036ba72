"""Conversation repair against a search over the grammar's states."""
import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from oriel.llm import convrepair as cr

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows: str) -> tuple[int, str]:
    """Cheapest (cost, audit) by trying every edit in every grammar state."""
    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        found = [(0, "")] if i == len(rows) and state in "0a" else []
        if i < len(rows):
            c, a = best(i + 1, state, 0)
            found.append((c + 2, "D" + a))
            for place in ("a" if state == "u" else "us" if state == "0" else "u"):
                r = rows[i]
                if r == "d" or place == "s" and r.lower() != "s":
                    continue
                keep = r.lower() == place
                c, a = best(i + 1, place, 0)
                found.append((c + (0 if keep else 1) + (5 if r.isupper() else 0), ("K" if keep else "R") + a))
        if inserted < 3:
            c, a = best(i, "a" if state == "u" else "u", inserted + 1)
            found.append((c + 5, "I" + a))
        return min(found, default=(10 ** 6, ""))

    return best(0, "0", 0)


def plain(rows):
    """{conv_id: result} of the contract, from (conv_id, turn, role, text) rows."""
    after = {}
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        out = after.setdefault(conv, [])
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    got = {}
    for conv, turns in after.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in turns:
            shown = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        codes = "".join(cr.code(r[1], f) for r, f in zip(turns, faults, strict=True))
        cost, audit = brute(codes)
        left, lines, state = iter(turns), [], "0"
        for e in audit:
            if e == "D":
                next(left)
                continue
            state = "a" if state == "u" else "u"
            _, role, text = ("", "", "") if e == "I" else next(left)
            if e == "K":
                state = role[0]
            lines.append((role if e == "K" else {"u": "user", "a": "assistant"}[state]) + ":" + text)
        nums = {t for t, *_ in turns if t is not None}
        got[conv] = (max(nums) - min(nums) + 1 - len(nums) if nums else 0, faults.count("blank"), faults.count("duplicate"),
                     faults.count("truncated"), sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False)),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return got


def got(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in [*cr.INTS, "cost", "audit", "repaired_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_alignment_equals_the_search():
    rng = random.Random(5)
    for _ in range(1500):
        rows = "".join(rng.choice("uuaasxdUAS") for _ in range(rng.randint(0, 9)))
        assert cr.repair_rows(rows) == brute(rows), rows


def test_chained_segments_equal_the_whole():
    rng = random.Random(6)
    for _ in range(300):
        rows = "".join(rng.choice("uuaasxdUA") for _ in range(rng.randint(1, 14)))
        parts = ["".join(p) for _, p in groupby(rows, key=lambda _, c=iter(range(99)): next(c) // 3)]
        best = {"0": (0, "")}
        for p in parts:
            ways = cr.segment_paths(p)
            best = {q: min(f) for q in cr.STATES if (f := [(c + ways[s + q][0], a + ways[s + q][1]) for s, (c, a) in best.items() if s + q in ways])}
        assert min((c + 5 * len(cr.TAIL[s]), a + cr.TAIL[s]) for s, (c, a) in best.items()) == brute(rows), rows


def random_rows(rng, convs, most):
    out = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            out.append((c, rng.choice([t, t, t, None, t + 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "Uwe"]),
                        rng.choice(["Yes.", "No!", "Well", " \t", None, "", f"Turn {t}.", f"open {t} \n", "ä?"])))
    return out


@pytest.mark.parametrize("limits", [{}, {"max_rows": 3}, {"max_rows": 50, "max_bytes": 12}])
def test_damage_and_repair(spark, limits):
    rows = random_rows(random.Random(7), 60, 12) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yo.")]
    df = cr.damaged(spark.createDataFrame(rows, SCHEMA))
    assert got(cr.audit_table(df, **limits)) == plain(rows)


def test_query_equals_the_search_on_the_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(cr.op11_conversations(spark, sf)) == plain(rows)


def test_hot_conversation_and_identical_rows(spark):
    """A conversation beyond the limit with many copies of one row."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(60)] + [(1, 5, "assistant", "Turn 5.")] * 40 + [(2, 0, "user", "Hi.")]
    r = cr.repair(spark.createDataFrame(rows, SCHEMA), max_rows=16)
    long = r.long.collect()
    assert [(x["conv_id"], x["duplicate"], x["cost"], x["audit"]) for x in long] == [(1, 40, 80, "K" * 6 + "D" * 40 + "K" * 54)]
    pieces = r.pieces.orderBy("pid", "seq").collect()
    assert [t["text"] for p in pieces for t in p["turns"]] == [f"Turn {i}." for i in range(60)] and len(pieces) >= 6
    assert [x["conv_id"] for x in r.whole.collect()] == [2]


def test_defined_cases(spark, table_dir):
    rows = [(1, None, None, None), (2, 3, "user", "x" * 200_000 + "."), (2, 4, "assistant", "Yes.\n"), (3, 1, "user", "A")]
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("conv"), F.lit("f").alias("fault"), F.lit("h").alias("here"))
    out = got(cr.audit_table(df.withColumn("here", F.lit(True))))
    assert out[1][:7] == (0, 1, 0, 0, 0, 2, "D") and out[2][5:7] == (0, "KK") and out[3][5:7] == (2, "D")
    gone = got(cr.audit_table(df.withColumn("here", F.lit(False))))
    assert gone == {k: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in (1, 2, 3)}
    empty = spark.createDataFrame([], SCHEMA)
    assert got(cr.op11_conversations(spark, table_dir(conversations=empty))) == {}
