"""Conversation structure repair as lightest derivations.

A conversation's rows, in order, become a role sequence ``(s?(ua)+)?`` (initials of system, user, assistant) by the
cheapest edits: keep a row, give it the role user or assistant, delete it, or insert an empty turn of user or assistant.

Deduction system.  An item [i, q] says: the rows from the i-th on are repaired, and what they became begins as
state q tells (END: nothing; ASSISTANT, USER, SYSTEM: that role).  Deductions take an item to one further left by an
edit; each is a superior function on (cost, audit): cost grows or stays, the edit's initial is put before the audit.
Knuth's agenda pops the least (cost, rows done, audit) until a goal item [0, END], [0, USER] or [0, SYSTEM]
is popped, which is final.  Of one item's derivations all have the same rows done, so it is (cost, audit) that
chooses; among equal costs no audit begins another (they spell the same rows, and further inserts cost more), so
putting edits before them keeps their order.

On Spark:

1. Rows are dealt by ranges of their order (copies of one row by chance), sorted, checkpointed and numbered
   without gaps.  A conversation of any length then is a run of numbers.
2. The first row of each (conversation, role, text) comes from a grouped minimum of the numbers; others are duplicates.
3. Rows without their texts are solved in segments of ``SEGMENT`` numbers.  A conversation inside a segment is
   solved to its goal.  The first and last of a segment may go on in others: they give pieces, the lightest derivations from each state
   at their right end to each at their left.
4. Pieces of one conversation are joined, ``FAN_IN`` neighbouring segments at a time, until each conversation is one.
5. An audit tells every row its edit and place; rows that stay fetch their texts by number.

Order: rows of a conversation go by turn (nulls first), ties by role, then the first ``RANGE_CHARS`` characters of the text, then
its MD5.  Null roles and texts are one
space; null conversation ids are one conversation.  Rows are blank (nothing but white space), else duplicate (role
and text seen earlier in the conversation), else truncated (the last character that is not white space is none of .!?).  Blank
and duplicate rows must go.  Equal rows are rows of their own.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import release_memory, shuffle_partitions, small_batches

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
END, ASSISTANT, USER, SYSTEM = range(4)
GOALS = (END, USER, SYSTEM)
ROLES = {ASSISTANT: "assistant", USER: "user"}
# For each state: what a row or an insert further left may become.
_LEFT = {END: {"a": ASSISTANT}, ASSISTANT: {"u": USER}, USER: {"a": ASSISTANT, "s": SYSTEM}, SYSTEM: {}}
# Classes of rows.
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
# Rows of a segment, segments joined at once, and solved role sequences that a task remembers.
SEGMENT, FAN_IN, REMEMBERED = 1024, 64, 1 << 14
# Characters of a text that its order goes by, as bounds of ranges hold them.
RANGE_CHARS = 64
SPACE = " \t\n\x0b\x0c\r"

Weight = tuple[int, str]


def _agenda(row: str, initials: str, start: int, goals: tuple[int, ...]) -> dict[int, Weight]:
    """Lightest (cost, audit) of the items [0, q], from the axiom [n, ``start``]; with ``goals`` only of the first of them popped.

    ``row`` has a digit for each row's class, ``initials`` a character for its role.
    """
    n = len(row)
    done: set[tuple[int, int]] = set()
    found: dict[int, Weight] = {}
    agenda = [(0, 0, "", start)]
    while agenda:
        cost, passed, audit, state = heapq.heappop(agenda)
        if (passed, state) in done:
            continue
        done.add((passed, state))
        if passed == n:
            if state in goals:
                return {state: (cost, audit)}
            found[state] = (cost, audit)
        may = _LEFT[state]
        for role in may:
            if role != "s" and (passed, may[role]) not in done:
                heapq.heappush(agenda, (cost + INSERT_COST, passed, INSERT + audit, may[role]))
        if passed < n:
            i = n - passed - 1
            heapq.heappush(agenda, (cost + DELETE_COST, passed + 1, DELETE + audit, state))
            kind = int(row[i])
            if kind in (FINE, TRUNCATED):
                extra = TRUNCATED_COST if kind == TRUNCATED else 0
                for role, then in may.items():
                    if role == initials[i]:
                        heapq.heappush(agenda, (cost + extra, passed + 1, KEEP + audit, then))
                    elif role != "s":
                        heapq.heappush(agenda, (cost + REROLE_COST + extra, passed + 1, REROLE + audit, then))
    return found


@lru_cache(maxsize=REMEMBERED)
def lightest(row: str, initials: str) -> Weight:
    """(cost, audit) of the cheapest repair of a whole conversation."""
    return next(iter(_agenda(row, initials, END, GOALS).values()))


def derivations(row: str, initials: str) -> dict[tuple[int, int], Weight]:
    """Lightest derivations of a piece: (state at its right, state at its left) to (cost, audit)."""
    return {(right, left): w for right in range(4) for left, w in _agenda(row, initials, right, ()).items()}


def joined(a: dict[tuple[int, int], Weight], b: dict[tuple[int, int], Weight]) -> dict[tuple[int, int], Weight]:
    """The derivations of two neighbouring pieces, ``a`` left of ``b``."""
    out: dict[tuple[int, int], Weight] = {}
    for (right, mid), (cost_b, audit_b) in b.items():
        for (begin, left), (cost_a, audit_a) in a.items():
            if begin == mid:
                w = (cost_a + cost_b, audit_a + audit_b)
                if (right, left) not in out or w < out[right, left]:
                    out[right, left] = w
    return out


def legal(pair: str) -> bool:
    return pair in ("su", "ua", "au")


# What is known of a conversation's run of rows.  ``paths``: derivations of a piece; ``audit``: of a whole one.
_RUN = ("conv_id long, segment long, first long, n long, blank long, duplicate long, truncated long, illegal long, "
        "first_initial string, last_initial string, first_turn long, last_turn long, turns long, whole boolean, cost long, "
        "audit string, paths array<struct<right:int,left:int,cost:long,audit:string>>")
_RUN_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("segment", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("blank", pa.int64()),
    ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first_initial", pa.string()),
    ("last_initial", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()),
    ("whole", pa.bool_()), ("cost", pa.int64()), ("audit", pa.string()),
    ("paths", pa.list_(pa.struct([("right", pa.int32()), ("left", pa.int32()), ("cost", pa.int64()),
                                  ("audit", pa.string())])))])


def _paths(found: dict[tuple[int, int], Weight]) -> list[dict]:
    return [{"right": r, "left": q, "cost": c, "audit": a} for (r, q), (c, a) in sorted(found.items())]


def solve_segment(rows: pa.Table) -> pa.Table:
    """The runs of one segment's rows (at, segment, conv_id, turn, initial, kind)."""
    rows = rows.sort_by("at")
    conv, turn, initial, kind, at = (rows.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "kind", "at"))
    cuts = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        row, initials = "".join(map(str, kind[a:b])), initial[a:b]
        known = [t for t in turn[a:b] if t is not None]
        # A role without a first character has no initial: any mark that no role begins with serves the agenda.
        marks = "".join(x or "\0" for x in initials)
        run = {"conv_id": conv[a], "segment": rows.column("segment")[0].as_py(), "first": at[a], "n": b - a,
               "blank": row.count(str(BLANK)), "duplicate": row.count(str(DUPLICATE)),
               "truncated": row.count(str(TRUNCATED)),
               "illegal": sum(not legal(x + y) for x, y in zip(initials, initials[1:])),
               "first_initial": initials[0], "last_initial": initials[-1],
               "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None,
               "turns": len(set(known)), "whole": 0 < a and b < len(conv), "cost": None, "audit": None, "paths": None}
        if run["whole"]:
            run["cost"], run["audit"] = lightest(row, marks)
        else:
            run["paths"] = _paths(derivations(row, marks))
        out.append(run)
    return pa.Table.from_pylist(out, _RUN_SCHEMA)


def join_runs(rows: pa.Table) -> pa.Table:
    """One run of the neighbouring runs of a conversation."""
    runs = sorted(rows.to_pylist(), key=lambda r: r["first"])
    out = runs[0]
    if len(runs) > 1:
        parts = [{(p["right"], p["left"]): (p["cost"], p["audit"]) for p in r["paths"]} for r in runs]
        while len(parts) > 1:  # in pairs, so that long audits are not copied once for every part
            parts = [joined(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        out["paths"] = _paths(parts[0])
        for r in runs[1:]:
            for c in ("n", "blank", "duplicate", "truncated"):
                out[c] += r[c]
            out["illegal"] += r["illegal"] + (not legal(out["last_initial"] + r["first_initial"]))
            out["last_initial"] = r["last_initial"]
            out["turns"] += r["turns"] - (r["turns"] > 0 and out["last_turn"] == r["first_turn"])
            if r["turns"]:
                out["first_turn"] = r["first_turn"] if out["first_turn"] is None else out["first_turn"]
                out["last_turn"] = r["last_turn"]
    return pa.Table.from_pylist([out], _RUN_SCHEMA)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole runs from runs that are all of their conversation."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if not r["whole"]:
                best = min((p["cost"], p["audit"]) for p in r["paths"] if p["right"] == END and p["left"] in GOALS)
                r |= {"whole": True, "cost": best[0], "audit": best[1], "paths": None}
            out.append(r)
        yield pa.RecordBatch.from_pylist(out, _RUN_SCHEMA)


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with the stated faults put in, by a checksum of conversation and turn."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(name) % 20).alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) with gapless numbers ``at`` in their order; checkpointed."""
    spark = rows.sparkSession
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumns({"start": F.substring("text", 1, RANGE_CHARS), "name": F.md5("text"), "any": F.rand(7)})
    by = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "start", "name")]
    # Copies of one row have nothing to be told apart by: a random number spreads them over ranges.
    dealt = (rows.repartitionByRange(shuffle_partitions(spark), *by, F.col("any")).sortWithinPartitions(*by)
             .select("conv_id", "turn", "role", "text"))
    kept = cut_lineage(dealt.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = kept.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row for each partition
    offsets, total = [], 0
    for r in sizes:
        offsets.append((r["part"], total - (r["part"] << 33)))
        total += r["count"]
    known = spark.createDataFrame(offsets, "part long, offset long")
    return (kept.join(F.broadcast(known), part == F.col("part"))
            .select("conv_id", "turn", "role", "text", (F.col("at") + F.col("offset")).alias("at")))


def classified(ordered: DataFrame) -> DataFrame:
    """(at, segment, conv_id, turn, initial, kind): the rows without their texts."""
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    rows = ordered.select(
        "at", F.floor(F.col("at") / SEGMENT).alias("segment"), "conv_id", "turn", F.substring("role", 1, 1).alias("initial"),
        F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(TRUNCATED).alias("kind"),
        F.when(last != "", F.unhex(F.md5(F.concat_ws("\0", F.coalesce(F.col("conv_id").cast("string"), F.lit("")),
                                                     F.octet_length("role").cast("string"), "role", "text")))).alias("name"))
    named = rows.where("name is not null")
    seen = (named.groupBy("name").agg(F.min("at").alias("least"), F.count("*").alias("times"))
            .where("times > 1").select("name", "least"))
    kind = F.when(F.col("at") > F.col("least"), DUPLICATE).otherwise(F.col("kind")).alias("kind")
    out = ["at", "segment", "conv_id", "turn", "initial"]
    return named.join(seen, "name", "left").select(*out, kind).unionAll(rows.where("name is null").select(*out, "kind"))


def solve(ordered: DataFrame) -> DataFrame:
    """One whole run for each conversation of numbered rows; checkpointed."""
    runs = cut_lineage(classified(ordered).groupBy("segment").applyInArrow(solve_segment, _RUN))
    whole, open_runs = runs.where("whole"), runs.where("not whole")
    segments = (runs.agg(F.max("segment")).first()[0] or 0) + 1
    while segments > 1:
        segments = -(-segments // FAN_IN)
        open_runs = (open_runs.withColumn("segment", F.floor(F.col("segment") / FAN_IN))
                     .groupBy("conv_id", "segment").applyInArrow(join_runs, _RUN))
    return cut_lineage(whole.unionAll(open_runs.mapInArrow(_finish, _RUN)))


def audit_rows(conv_id: int | None, first: int, audit: str) -> Iterator[tuple]:
    """(conv_id, place, edit, role, at) of what an audit leaves of a conversation; ``role`` is null for kept rows, whose
    places follow each other, and ``at`` for inserted ones."""
    system = (len(audit) - audit.count(DELETE)) % 2  # an odd number of turns begins with the system's
    place, at = 0, first
    for edit in audit:
        if edit != DELETE:
            role = None if edit == KEEP else ROLES[USER if (place - system) % 2 == 0 else ASSISTANT]
            yield conv_id, place, edit, role, None if edit == INSERT else at
            place += 1
        at += edit != INSERT


_EDITS = "conv_id long, place long, edit string, new_role string, at long"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("new_role", pa.string()),
                        ("at", pa.int64())])
    held: list[tuple] = []
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "first", "audit"))):
            for row in audit_rows(*r):
                held.append(row)
                if len(held) == 1 << 14:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                    held = []
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) of rows (conv_id, turn, role, text).

    conversations: conv_id, n, gaps, blank, duplicate, truncated, illegal, cost, audit, for each that has rows.
    turns: conv_id, place (from 0), edit, role, text of what the repair leaves or inserts.
    """
    small_batches(rows.sparkSession)
    ordered = in_order(rows)
    runs = solve(ordered)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).cast("long")
    found = runs.select("conv_id", "n", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    edits = runs.select("conv_id", "first", "audit").mapInArrow(_edits, _EDITS)
    kept = edits.where("at is not null").join(ordered.select("at", "role", "text"), "at").select(
        "conv_id", "place", "edit", F.coalesce("new_role", "role").alias("role"), "text")
    added = edits.where("at is null").select("conv_id", "place", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return found, kept.unionAll(added)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, digest) of turns that come by conversation and place; one turn at a time is held."""
    now: tuple[int | None] | None = None
    state = hashlib.sha256()
    ids, digests = [], []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if now != (conv,):
                if now is not None:
                    ids.append(now[0])
                    digests.append(state.hexdigest())
                now, state = (conv,), hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        if ids:
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(digests)], names=["conv_id", "digest"])
            ids, digests = [], []
    if now is not None:
        yield pa.record_batch([pa.array([now[0]], pa.int64()), pa.array([state.hexdigest()])], names=["conv_id", "digest"])
    release_memory()


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, digest): sha256 of each conversation's ``role:text`` lines.  A digest is one chain, so a conversation's turns
    stream through one task in their order; they are sorted outside memory and never held together."""
    dealt = turns.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.select("conv_id", "role", "text").mapInArrow(_digests, "conv_id long, digest string")


def repaired(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Every conv_id of ``conversations`` with what was found and done in ``rows``, and the digest of its repaired turns."""
    found, turns = repair(rows)
    every = conversations.select(F.col("conv_id").cast("long")).distinct()
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    out = (every.join(found.withColumnRenamed("conv_id", "c"), same("conv_id", "c"), "left").drop("c")
           .join(digests(turns).withColumnRenamed("conv_id", "d"), same("conv_id", "d"), "left"))

    def count(c: str) -> Column:
        return F.coalesce(c, F.lit(0)).cast("long").alias(c)

    return out.select("conv_id", *map(count, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
