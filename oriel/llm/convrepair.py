"""Conversation structure repair: Wagner-Fischer alignment with target lengths.

The turns of a conversation are aligned to every feasible length of the
alternating grammar ``(s?(ua)+)?`` (role initials).  Edits: Keep 0, Rerole to
user or assistant 1, Delete 2, Insert an empty turn 5; blank and duplicate
turns can only be deleted, a truncated turn that stays costs 5 more.  Lengths
are tried in the order of their lower bounds; the cost found so far limits the
band of the next table (Ukkonen) and ends the search.  Of equally cheap
repairs the least audit (the edits' initials in order, ASCII) is kept: a table
of suffix costs gives a target's least audit by walking forward.

Conversations of up to ``max_rows`` turns and ``max_bytes`` of text are aligned
as a whole, streamed in the order of one shuffle.  Longer ones are range
partitioned and cut into segments of that size; a segment is aligned from every
state of the grammar to every other, and the segments' costs are chained.
Equal costs are decided exactly there too: a segment's audits hold one edit
for each of its turns and end with one, so none is the beginning of another
and the first segment that differs decides.  No task holds more than a segment's turns, or
a few numbers for each segment of one conversation; the digest of a long
conversation is one pass in constant memory, as a digest has to be.

Defined cases: a null role or text counts as one space, null turns come first
and count in no gap, a null conversation id is a conversation of its own;
turns of equal number are ordered by role, then the text's md5; repeated rows
are duplicates of the first; a very long text is taken whole (segments end
early at ``max_bytes``); a conversation without turns has zeros, an empty audit and no turns;
an empty table gives an empty table; only the named columns are read, so other
columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oriel.llm.common import materialize, read_table

MAX_ROWS, MAX_BYTES = 128, 8 << 20
DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 2, 5, 1, 5
#: Grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn.
STATES = "0sua"
LEGAL = {"su", "ua", "au"}
ROLE = {"u": "user", "a": "assistant"}
#: Edits that end a conversation in each state.
TAIL = {"0": "", "s": INSERT * 2, "u": INSERT, "a": ""}
SPACE = r"\x20\x09-\x0D"


def shift_cost(k: int) -> int:
    """Least cost of k more turns than target places (k < 0: fewer)."""
    return DELETE_COST * k if k > 0 else -INSERT_COST * k


def match(row: str, place: str) -> tuple[int, str] | None:
    """Cost and edit that let a turn stand at a place of the target.  Rows:
    ``d`` must go; else the role's initial, in upper case if truncated."""
    if row == "d":
        return None
    extra = TRUNCATED_COST if row.isupper() else 0
    if row.lower() == place:
        return extra, KEEP
    return (extra + REROLE_COST, REROLE) if place != "s" else None


def align(rows: str, target: str, limit: int, tail: bool) -> tuple[int, str] | None:
    """Cheapest alignment of at most ``limit``, with its least audit.  Only
    diagonals that a path of that cost can touch are computed.  ``tail``: turns
    may be inserted after the last one."""
    n, m = len(rows), len(target)
    lo = hi = 0
    while shift_cost(lo - 1) + shift_cost(n - m - lo + 1) <= limit:
        lo -= 1
    while shift_cost(hi + 1) + shift_cost(n - m - hi - 1) <= limit:
        hi += 1
    if shift_cost(n - m) > limit:
        return None
    lo, hi = min(lo, n - m), max(hi, n - m)
    inf = limit + 1
    width = hi - lo + 1
    cost = [[inf] * width for _ in range(n + 2)]     # cost[i][i - j - lo]: of turns i.. and places j..
    for i in range(n, -1, -1):
        here, below = cost[i], cost[i + 1]
        for k in range(max(0, i - m - lo), min(width - 1, i - lo) + 1):
            j = i - k - lo
            best = 0 if i == n and j == m else inf
            if i < n:
                if k + 1 < width:
                    best = min(best, DELETE_COST + below[k + 1])
                if j < m and (stay := match(rows[i], target[j])):
                    best = min(best, stay[0] + below[k])
            if j < m and k > 0 and (tail or i < n):
                best = min(best, INSERT_COST + here[k - 1])
            here[k] = min(best, inf)
    total = cost[0][-lo]
    if total > limit:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        k, left = i - j - lo, cost[i][i - j - lo]
        if i < n and k + 1 < width and DELETE_COST + cost[i + 1][k + 1] == left:
            audit.append(DELETE)
            i += 1
        elif j < m and k > 0 and (tail or i < n) and INSERT_COST + cost[i][k - 1] == left:
            audit.append(INSERT)
            j += 1
        else:
            audit.append(match(rows[i], target[j])[1])
            i, j = i + 1, j + 1
    return total, "".join(audit)


def cheapest(rows: str, targets: Iterator[str], best: tuple[int, str] | None, tail: bool) -> tuple[int, str] | None:
    """Best alignment over targets of growing length, shortest bound first.
    Without an incumbent the limit is doubled until one is found."""
    must = rows.count("d")
    stay = len(rows) - must

    def bound(length: int) -> int:
        return DELETE_COST * must + shift_cost(stay - length)

    ceiling = DELETE_COST * len(rows) + INSERT_COST * 4   # longer targets than this allows are never cheaper
    longest = stay + ceiling // INSERT_COST + 2
    todo = sorted((bound(len(t)), t) for t in targets(longest))
    for low, target in todo:
        if best is not None and low > best[0]:
            break
        limit = best[0] if best else max(low, 4)
        found = align(rows, target, limit, tail)
        while best is None and found is None and limit <= (TRUNCATED_COST + INSERT_COST) * (len(rows) + len(target) + 1):
            limit *= 2
            found = align(rows, target, limit, tail)
        if found and (best is None or found < best):
            best = found
    return best


def alternating(first: str, length: int) -> str:
    return ("ua" * (length // 2 + 1))[0 if first == "u" else 1:][:length]


@lru_cache(maxsize=1 << 16)
def repair_rows(rows: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    def targets(longest):
        for m in range(2, longest + 2, 2):
            yield alternating("u", m)
            if "s" in rows.lower():
                yield "s" + alternating("u", m)

    return cheapest(rows, targets, (DELETE_COST * len(rows), DELETE * len(rows)), True)


@lru_cache(maxsize=1 << 12)
def segment_paths(rows: str) -> dict[str, tuple[int, str]]:
    """(cost, audit) of a segment from each state to each other one."""
    def ending(make, last):   # targets of one family that end in a given place
        return lambda longest: (t for n in range(1, longest + 1) if (t := make(n))[-1] == last)

    families = {"u": lambda n: alternating("u", n), "a": lambda n: alternating("a", n), "s": lambda n: "s" + alternating("u", n - 1)}
    found = {(f, q): cheapest(rows, ending(make, q), None, False) for f, make in families.items() for q in "sua"
             if (f == "s" or q != "s") and (f != "s" or "s" in rows.lower())}
    out = {}
    for p in STATES:
        for q in STATES:
            ways = [found.get(("a" if p == "u" else "u", q)), found.get(("s", q)) if p == "0" else None,
                    (DELETE_COST * len(rows), DELETE * len(rows)) if p == q else None]
            if best := min((w for w in ways if w), default=None):
                out[p + q] = best
    return out


def apply_audit(rows: list[tuple[str, str]], audit: str, state: str = "0") -> list[dict]:
    """The repaired turns (role, text, edit) of an audit that starts in ``state``."""
    out, left = [], iter(rows)
    for edit in audit:
        if edit == DELETE:
            next(left)
            continue
        place = "a" if state == "u" else "u"
        role, text = ("", "") if edit == INSERT else next(left)
        if edit == KEEP:
            place = role[0]
        else:
            role = ROLE[place]
        out.append({"role": role, "text": text, "edit": edit})
        state = place
    return out


def code(role: str, fault: str) -> str:
    if fault in ("blank", "duplicate"):
        return "d"
    first = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return first.upper() if fault == "truncated" else first


TURNS = "array<struct<role string, text string, edit string>>"
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"
WHOLE = f"conv string, {COUNTS}, cost long, audit string, turns {TURNS}"
SEGMENT = (f"conv string, pid int, seq int, rows array<struct<role string, text string>>, turn_min long, turn_max long, turn_n long, "
           "blank long, duplicate long, truncated long, illegal long, first string, last string, "
           "ways array<struct<way string, cost long, place int, audit string>>")
TURN_STRUCT = pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
INTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
WHOLE_ARROW = pa.schema([("conv", pa.string()), *[(c, pa.int64()) for c in [*INTS, "cost"]], ("audit", pa.string()),
                         ("turns", pa.list_(TURN_STRUCT))])
SEGMENT_ARROW = pa.schema([
    ("conv", pa.string()), ("pid", pa.int32()), ("seq", pa.int32()),
    ("rows", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
    *[(c, pa.int64()) for c in ("turn_min", "turn_max", "turn_n", "blank", "duplicate", "truncated", "illegal")],
    ("first", pa.string()), ("last", pa.string()),
    ("ways", pa.list_(pa.struct([("way", pa.string()), ("cost", pa.int64()), ("place", pa.int32()), ("audit", pa.string())])))])


def runs(batches, max_rows: int | None = None, max_bytes: int | None = None):
    """(conv, rows) for each stretch of rows of one conversation, cut at the
    limits where given.  Rows: (turn, role, text, fault)."""
    conv, rows, size = None, [], 0
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(5)]
        for c, *row in zip(*cols, strict=True):
            if conv is not None and (c != conv or max_rows and (len(rows) >= max_rows or size >= max_bytes)):
                yield conv, rows
                rows, size = [], 0
            conv = c
            if row[3] is not None:      # a null fault: the row only names its conversation
                rows.append(row)
                size += len(row[2] or "")
    if conv is not None:
        yield conv, rows


def batched(records, schema: pa.Schema, rows: int = 512, size: int = 16 << 20):
    out, held = [], 0
    for r in records:
        out.append(r)
        held += sum(len(t["text"] or "") for t in r.get("turns") or r.get("rows") or ())
        if len(out) >= rows or held >= size:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def illegal_pairs(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:], strict=False))


def counted(rows: list) -> dict:
    faults = [r[3] for r in rows]
    return {k: faults.count(k) for k in ("blank", "duplicate", "truncated")} | {"illegal": illegal_pairs([r[1] for r in rows])}


def whole(batches):
    """Conversations that fit into memory, one at a time."""
    def records():
        for conv, rows in runs(batches):
            seen = set()
            for r in rows:
                if r[3] != "blank":
                    if (r[1], r[2]) in seen:
                        r[3] = "duplicate"
                    seen.add((r[1], r[2]))
            turns = {r[0] for r in rows if r[0] is not None}
            cost, audit = repair_rows("".join(code(r[1], r[3]) for r in rows))
            yield {"conv": conv, "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "cost": cost, "audit": audit,
                   "turns": apply_audit([(r[1], r[2]) for r in rows], audit)} | counted(rows)

    return batched(records(), WHOLE_ARROW)


def segments(max_rows: int, max_bytes: int):
    def run(batches):
        def records():
            pid = TaskContext.get().partitionId()
            for seq, (conv, rows) in enumerate(runs(batches, max_rows, max_bytes)):
                ways = segment_paths("".join(code(r[1], r[3]) for r in rows))
                place = {a: k for k, a in enumerate(sorted({a for _, a in ways.values()}))}
                turns = sorted({r[0] for r in rows if r[0] is not None})
                yield {"conv": conv, "pid": pid, "seq": seq, "rows": [{"role": r[1], "text": r[2]} for r in rows],
                       "turn_min": turns[0] if turns else None, "turn_max": turns[-1] if turns else None, "turn_n": len(turns),
                       "first": rows[0][1][:1], "last": rows[-1][1][:1],
                       "ways": [{"way": w, "cost": c, "place": place[a], "audit": a} for w, (c, a) in ways.items()]} | counted(rows)

        return batched(records(), SEGMENT_ARROW)

    return run


CHOICE = f"conv string, pid int, seq int, way string, tail string, {COUNTS}, cost long"
CHOICE_ARROW = pa.schema([("conv", pa.string()), ("pid", pa.int32()), ("seq", pa.int32()), ("way", pa.string()), ("tail", pa.string()),
                          *[(c, pa.int64()) for c in [*INTS, "cost"]]])


def chain(table: pa.Table) -> pa.Table:
    """Picks each segment's way; the conversation's totals stand in its last segment."""
    segs = sorted(table.to_pylist(), key=lambda s: (s["pid"], s["seq"]))
    ways = [{w["way"]: (w["cost"], w["place"]) for w in s["ways"]} for s in segs]
    rest = [{q: INSERT_COST * len(TAIL[q]) for q in STATES}]
    for w in reversed(ways):
        after = rest[-1]
        rest.append({p: min(w[p + q][0] + after[q] for q in STATES if p + q in w) for p in STATES})
    rest.reverse()
    out, state = [], "0"
    for s, w, here, after in zip(segs, ways, rest[:-1], rest[1:], strict=True):
        fit = [(w[state + q][1], q) for q in STATES if state + q in w and w[state + q][0] + after[q] == here[state]]
        q = min(fit)[1]
        out.append({"conv": s["conv"], "pid": s["pid"], "seq": s["seq"], "way": state + q, "tail": ""})
        state = q
    seen = [s for s in segs if s["turn_min"] is not None]
    # turns are in order: a number can be shared with the segment before only as its largest
    distinct = sum(s["turn_n"] for s in seen) - sum(a["turn_max"] == b["turn_min"] for a, b in zip(seen, seen[1:], strict=False))
    out[-1] |= {"tail": TAIL[state], "cost": rest[0]["0"], "gaps": seen[-1]["turn_max"] - seen[0]["turn_min"] + 1 - distinct if seen else 0,
                **{k: sum(s[k] for s in segs) for k in ("blank", "duplicate", "truncated")},
                "illegal": sum(s["illegal"] for s in segs) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(segs, segs[1:], strict=False))}
    return pa.Table.from_pylist(out, CHOICE_ARROW)


def repaired_piece(batches):
    schema = pa.schema([("conv", pa.string()), ("pid", pa.int32()), ("seq", pa.int32()), ("turns", pa.list_(TURN_STRUCT))])

    def records():
        for b in batches:
            for r in b.to_pylist():
                yield {"conv": r["conv"], "pid": r["pid"], "seq": r["seq"],
                       "turns": apply_audit([(x["role"], x["text"]) for x in r["rows"]], r["audit"], r["way"][0])}

    return batched(records(), schema)


@dataclass
class Repaired:
    """``whole``: a row per conversation of up to the limits, with its repaired
    ``turns``.  ``long`` and ``pieces``: the rows of longer ones, and their
    turns in pieces ordered by (pid, seq); None where there are none."""
    whole: DataFrame
    long: DataFrame | None
    pieces: DataFrame | None


def prepared(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column | None) -> DataFrame:
    conv = F.col(f"`{conv_col}`")
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit(" ")) for c in (role_col, text_col))
    d = df.select(F.when(conv.isNull(), "n").otherwise(F.concat(F.lit("v"), conv.cast("string"))).alias("conv"),
                  F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                  (F.lit(True) if present is None else present).alias("here"))
    fault = (F.when(~F.col("here"), F.lit(None)).when(~F.col("text").rlike(f"[^{SPACE}]"), "blank")
             .when(F.col("text").rlike(rf"[^{SPACE}.!?][{SPACE}]*\z"), "truncated").otherwise(""))
    return d.select("conv", "turn", "role", "text", fault.alias("fault"))


def long_rows(rows: DataFrame) -> DataFrame:
    """Rows with their faults settled, in any order: identical rows are counted
    first, and all but one of them need no text any more."""
    c = rows.where("fault IS NOT NULL").groupBy("conv", "turn", "role", "text", "fault").agg(F.count("*").alias("n"))
    c = materialize(c.withColumn("h", F.md5("text")).withColumn("t", F.coalesce(F.concat(F.lit("v"), F.col("turn").cast("string")), F.lit("n"))),
                    "convrepair-long")
    firsts = c.groupBy("conv", "role", "h").agg(F.min(F.struct("turn", "t")).alias("f")).select(
        "conv", "role", "h", F.col("f.t").alias("t"), F.lit(True).alias("first"))
    r = c.join(firsts, ["conv", "role", "h", "t"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    duplicate = (F.col("fault") != "blank") & (F.col("first").isNull() | (F.col("copy") > 1))
    return r.select("conv", "turn", "role", F.when(~duplicate & (F.col("fault") != "blank"), F.col("text")).alias("text"),
                    F.when(duplicate, "duplicate").otherwise(F.col("fault")).alias("fault"), "h", "copy")


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           present: Column | None = None, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Repaired:
    """Audits and repaired turns.  Rows where ``present`` is false only name
    their conversation.  ``df`` is read more than once; give a table or a
    materialised frame."""
    kind = df.schema[conv_col].dataType
    rows = prepared(df, conv_col, turn_col, role_col, text_col, present)
    sizes = rows.where("fault IS NOT NULL").groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = materialize(sizes.where((F.col("n") > max_rows) | (F.col("bytes") > max_bytes)).select("conv"), "convrepair-ids")
    some = not long.isEmpty()

    def named(d: DataFrame) -> DataFrame:
        value = F.when(F.col("conv") != "n", F.substring("conv", 2, 1 << 30).cast(kind))
        return d.select(value.alias(conv_col), *[c for c in d.columns if c != "conv"])

    short = rows.join(long, "conv", "left_anti") if some else rows
    order = ["conv", "turn", "role", F.md5("text")]
    done = short.repartition("conv").sortWithinPartitions(*order).mapInArrow(whole, WHOLE)
    if not some:
        return Repaired(named(done), None, None)
    keys = ["conv", "turn", "role", "h", "copy"]
    settled = long_rows(rows.join(long, "conv", "left_semi"))
    cut = settled.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "turn", "role", "text", "fault")
    segs = materialize(cut.mapInArrow(segments(max_rows, max_bytes), SEGMENT), "convrepair-segments")
    small = F.transform("ways", lambda w: F.struct(w["way"].alias("way"), w["cost"].alias("cost"), w["place"].alias("place")))
    slim = segs.select(*[c for c in segs.columns if c not in ("rows", "ways")], small.alias("ways"))
    chosen = materialize(slim.groupBy("conv").applyInArrow(chain, CHOICE), "convrepair-chain")
    picked = segs.join(chosen.select("conv", "pid", "seq", "way", "tail"), ["conv", "pid", "seq"])
    audit = F.concat(F.filter("ways", lambda w: w["way"] == F.col("way"))[0]["audit"], F.col("tail"))
    picked = picked.select("conv", "pid", "seq", "way", audit.alias("audit"), "rows")
    text = picked.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pid", "seq", "audit"))).alias("a")).select(
        "conv", F.array_join(F.transform("a", lambda x: x["audit"]), "").alias("audit"))
    totals = chosen.where("cost IS NOT NULL").select("conv", *INTS, "cost").join(text, "conv")
    pieces = picked.select("conv", "pid", "seq", "way", "audit", "rows").mapInArrow(
        repaired_piece, f"conv string, pid int, seq int, turns {TURNS}")
    return Repaired(named(done), named(totals), named(pieces))


def digests(pieces: DataFrame, conv_col: str) -> DataFrame:
    """sha256 over the lines of long conversations, streamed in order."""
    kind = pieces.schema[conv_col].dataType
    lines = F.concat_ws("\n", F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])))
    src = pieces.where(F.size("turns") > 0).select(F.col(conv_col).alias("conv"), "pid", "seq", lines.alias("lines"))
    schema = T.StructType([T.StructField("conv", kind), T.StructField("sha", T.StringType())])

    def run(batches):
        conv, state = None, None
        for b in batches:
            for c, text in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if state is not None and c.as_py() == conv.as_py():
                    state.update(b"\n")
                else:
                    if state is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([conv.as_py()], c.type), pa.array([state.hexdigest()])], names=["conv", "sha"])
                    conv, state = c, hashlib.sha256()
                state.update(text.encode())
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv.as_py()], conv.type), pa.array([state.hexdigest()])], names=["conv", "sha"])

    return src.repartition("conv").sortWithinPartitions("conv", "pid", "seq").select("conv", "lines").mapInArrow(run, schema)


def damaged(df: DataFrame) -> DataFrame:
    """The contract's damage, by crc32("conv_id:turn") % 20: columns conv_id,
    turn, role, text, here (false: dropped)."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    d = df.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")],
                  (F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20).alias("k"))
    k = F.col("k")
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    d = d.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (k != 0).alias("here"),
                 F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return d.drop("copy")


def audit_table(df: DataFrame, **limits) -> DataFrame:
    """conv_id, counts, cost, audit and the digest of the repaired turns."""
    r = repair(df, present=F.col("here"), **limits)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    cols = ["conv_id", *INTS, "cost", "audit"]
    out = r.whole.select(*cols, F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("repaired_sha256"))
    if r.long is None:
        return out
    found = digests(r.pieces, "conv_id").withColumnRenamed("conv", "c")
    long = r.long.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return out.unionByName(long.select(*cols, F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_table(damaged(read_table(spark, sf_dir, "conversations")))
