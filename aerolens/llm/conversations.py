"""Operator 12: conversation structure repair by an auction shortest-path algorithm.

A conversation is sound if the first letters of its roles read ``(s?(ua)+)?``:
nothing, or an optional system turn and then user and assistant by turns. A row may
be kept (K, cost 0), get the role user or assistant (R, 1) or be deleted (D, 2, the
only choice for blank rows and duplicates); a turn without text may be inserted
anywhere (I, 5); a truncated row that stays costs 5 more. Wanted are the cheapest
edits, of equally cheap ones the first in ASCII order.

The edits are paths through a lattice of (rows read, last role) with whole costs.
The auction algorithm holds a price for each node, no higher than any way on costs,
and a path from the origin: the path is extended along an arc whose cost the prices
tell exactly, or, if there is none, the price of its end goes up to the cheapest way
on and the path is contracted by that node. Prices begin at what the rest of the
rows must cost by themselves. Once the path meets the end, every cheapest way
consists of tight arcs (price = cost + next price), which are traced label by label
in ASCII order, turning back where they do not lead to the end.

How it runs: rows are dealt by range of (conversation, turn, role, text) and sorted, so
a conversation of any length is spread over many tasks. Each task solves those that
lie wholly inside its range and are not larger than ``HOLD_ROWS`` and ``HOLD_BYTES``. The
others are left as segments of at most ``SEGMENT`` rows: a segment's cost from each
entering role to each leaving role is again found by auction, one pass per conversation
adds these 16 numbers up from the end, and with the rest's cost known each segment is
traced by itself for every entering role. Inserts belong to the row after them, so
that segments can be compared one by one. A last pass reads the segments in order
through a hash of the repaired text; it holds only the audit. Duplicates are found by
digests, counted before they are shuffled.

Defined results: a null conversation is one conversation; a null role or text is one
space, so such a text is blank and such a role must change; null turns come first; rows
of one turn are taken by role, the text's first 64 characters and its digest, and
duplicates among them are adjacent; a role that is none of user, assistant, system counts
by its first letter; a conversation of which no row is ``present`` gives zeros, an empty
audit and the hash of nothing; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from aerolens.session import materialise

from .common import bound_batches

#: What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: Rows of a segment of a long conversation, and what a task holds of one conversation before it cuts it into segments.
SEGMENT = 64
HOLD_ROWS, HOLD_BYTES = 2048, 8 << 20
#: Solved row patterns that a task remembers.
MEMO = 1 << 15

#: Last role so far: none, system, user, assistant. What each must cost at the end, by inserting what is missing.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
AT_END = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "II", "I", "")
AFTER = (USER, USER, ASSISTANT, USER)
NEW_ROLE = {USER: "user", ASSISTANT: "assistant"}
BLANKS = " \t\n\x0b\x0c\r"


def _ways() -> dict[str, tuple]:
    """For each kind of row and each last role the arcs (cost, step in node numbers, label), in the order of their labels.

    Kinds: s, u, a, x (another role); capitals if truncated; D if the row must go. A node's number is four times the
    rows read plus the last role."""
    ways = {}
    for kind in "DsuaxSUAX":
        extra = TRUNCATED if kind.isupper() else 0
        per = []
        for last in range(4):
            nxt = AFTER[last]
            arcs = [(DELETE, 4, "D"), (INSERT, nxt - last, "I")]
            if kind != "D":
                own = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(kind.lower())
                if own == nxt or (own == SYSTEM and last == NOTHING):
                    arcs.append((extra, 4 + own - last, "K"))
                arcs.append((REROLE + extra, 4 + nxt - last, "R"))
            per.append(tuple(arcs))
        ways[kind] = tuple(per)
    return ways


WAYS = _ways()


class Auction:
    """Prices over the lattice of a row pattern, with the cost of leaving it in each role (None: not allowed)."""

    def __init__(self, kinds: str, leave: tuple):
        self.kinds, self.leave, self.end = kinds, leave, 4 * len(kinds)
        # Roles beyond the last one that may be left in lead nowhere.
        self.most = ASSISTANT if leave[USER] is not None or leave[ASSISTANT] is not None else SYSTEM if leave[SYSTEM] is not None else NOTHING
        rest, price = 0, [0] * 4
        for kind in reversed(kinds):
            rest += DELETE if kind.isupper() else 0
            price += [rest] * 4
        self.price = [*price[::-1], 0]  # the last one is the end's

    def arcs(self, v: int):
        """(cost, next node, label) of all arcs from a node."""
        if v >= self.end:
            cost = self.leave[v & 3]
            return () if cost is None else ((cost, self.end + 4, ""),)
        return [(c, v + d, a) for c, d, a in WAYS[self.kinds[v >> 2]][v & 3] if (v + d) & 3 <= self.most]

    def run(self, origin: int) -> int:
        """The least cost from ``origin``, by path extensions and contractions."""
        price, kinds, end, most, goal = self.price, self.kinds, self.end, self.most, self.end + 4
        path, v = [], origin
        while v != goal:
            best, to = None, -1
            if v >= end:
                if (best := self.leave[v & 3]) is not None:
                    to = goal
            else:
                for cost, step, _ in WAYS[kinds[v >> 2]][v & 3]:
                    if (v + step & 3) <= most and (best is None or cost + price[v + step] < best):
                        best, to = cost + price[v + step], v + step
            if best is None:
                best = 1 << 60
            if price[v] < best:
                price[v] = best  # contraction
                if path:
                    v = path.pop()
            else:
                path.append(v)  # extension
                v = to
        return price[origin]

    def trace(self, origin: int) -> tuple[str, int]:
        """The first labels, in ASCII order, of the tight ways from ``origin`` (after ``run``), and the role they leave in."""
        price, goal = self.price, self.end + 4
        dead, labels, way = set(), [], [(origin, iter(self.arcs(origin)))]
        while True:
            v, arcs = way[-1]
            for cost, to, label in arcs:
                if price[v] == cost + price[to] and to not in dead:
                    if to == goal:
                        return "".join(labels), v & 3
                    labels.append(label)
                    way.append((to, iter(self.arcs(to))))
                    break
            else:
                dead.add(v)
                way.pop()
                labels.pop()


def reachable(kinds: str, enter: int, leave: int) -> bool:
    if leave in (USER, ASSISTANT) or enter == leave:
        return True
    return leave == SYSTEM and enter == NOTHING and ("s" in kinds or "S" in kinds)


def segment_costs(kinds: str) -> list[int | None]:
    """The least cost from each entering role to each leaving role (16 numbers; None: no way)."""
    out: list = [None] * 16
    for leave in range(4):
        auction = Auction(kinds, tuple(0 if r == leave else None for r in range(4)))
        for enter in range(4):
            if reachable(kinds, enter, leave):
                out[4 * enter + leave] = auction.run(enter)
    return out


def segment_traces(kinds: str, leave: tuple) -> list[tuple[str, int]]:
    """For each entering role the cheapest labels and the leaving role, if leaving costs what ``leave`` says."""
    auction = Auction(kinds, leave)
    for enter in range(4):
        auction.run(enter)
    return [auction.trace(enter) for enter in range(4)]


def whole(kinds: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation, by one auction or, if it is long, by one for each segment."""
    if len(kinds) <= SEGMENT:
        auction = Auction(kinds, AT_END)
        cost = auction.run(NOTHING)
        audit, last = auction.trace(NOTHING)
        return cost, audit + TAIL[last]
    parts = [kinds[i:i + SEGMENT] for i in range(0, len(kinds), SEGMENT)]
    leave, rest = AT_END, []
    for part in reversed(parts):
        rest.append(leave)
        leave = entering(segment_costs(part), leave)
    audit, last = [], NOTHING
    for part, out in zip(parts, reversed(rest)):
        labels, last = segment_traces(part, out)[last]
        audit.append(labels)
    return leave[NOTHING], "".join(audit) + TAIL[last]


def entering(costs: list, leave: tuple) -> tuple:
    """What the rest costs when a segment is entered, from what it costs when the segment is left."""
    return tuple(min(costs[4 * e + r] + leave[r] for r in range(4) if costs[4 * e + r] is not None) for e in range(4))


def edited(audit: str, last: int, roles: list[str], texts: list[str]):
    """The (role, text) that edits make of rows, entered after the role ``last``."""
    rows = zip(roles, texts)
    for label in audit:
        if label == "I":
            last = AFTER[last]
            yield NEW_ROLE[last], ""
        elif label == "D":
            next(rows)
        else:
            role, text = next(rows)
            if label == "R":
                last = AFTER[last]
                yield NEW_ROLE[last], text
            else:
                last = SYSTEM if role[:1] == "s" else AFTER[last]
                yield role, text


# ---------------------------------------------------------------- rows to conversations

_STATS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_REPAIRED = "repaired array<struct<role:string,text:string>>"
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


class Part:
    """Consecutive rows of one conversation, as they are read."""

    def __init__(self, conv, before: Part | None = None):
        self.conv = conv
        self.kinds, self.initials, self.roles, self.texts = [], [], [], []
        self.count = dict.fromkeys(_COUNTS, 0)
        self.low = self.high = None
        self.size = 0
        # What the next row is compared with: the last row of this part or of the one before.
        self.last = before.last if before else None

    def add(self, turn, role: str, text: str, seen: bool) -> None:
        seen = seen or self.last == (turn, role, text)
        self.last = (turn, role, text)
        bare = text.rstrip(BLANKS)
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if self.initials and self.initials[-1] + initial not in ("su", "ua", "au"):
            self.count["illegal"] += 1
        fault = "blank" if not bare else "duplicate" if seen else "truncated" if bare[-1] not in ".!?" else None
        if fault:
            self.count[fault] += 1
        self.kinds.append("D" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
        self.initials.append(initial)
        self.roles.append(role)
        self.texts.append(text)
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.count["turns"] += turn != self.high
            self.high = turn
        self.size += len(role) + len(text)


def _gaps(low, high, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def _joined(rows) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in rows).encode("utf-8", "replace")


def _read_conversations(texts: bool, conv_type, schema):
    """The task over sorted rows: conversations wholly inside give their result, others their segments."""
    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        pid, seq = TaskContext.get().partitionId(), 0
        solve = lru_cache(MEMO)(whole)
        out: list[dict] = []

        def segment(p: Part):
            nonlocal seq
            kinds = "".join(p.kinds)
            out.append({"conv": p.conv, "pid": pid, "seq": seq, "done": False, "kinds": kinds, "costs": segment_costs(kinds) if kinds else None,
                        "roles": p.roles, "texts": p.texts, "low": p.low, "high": p.high, "first": (p.initials or [""])[0],
                        "last": (p.initials or [""])[-1], **p.count})
            seq += 1

        def close(p: Part, open_: bool):
            if open_:
                segment(p)
                return
            cost, audit = solve("".join(p.kinds))
            rows = list(edited(audit, NOTHING, p.roles, p.texts))
            row = {"conv": p.conv, "pid": pid, "seq": -1, "done": True, **p.count, "gaps": _gaps(p.low, p.high, p.count["turns"]), "cost": cost,
                   "audit": audit, "repaired_sha256": hashlib.sha256(_joined(rows)).hexdigest()}
            if texts:
                row["repaired"] = [{"role": r, "text": t} for r, t in rows]
            out.append(row)

        def flush():
            rows = pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
            return rows

        part, is_open, waiting = None, True, 0  # the first conversation may have begun in the range before
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns[1:5]]
            for conv, turn, role, text, seen, here in zip(batch.column(0).to_pylist(), *cols, batch.column(5).to_pylist()):
                if part is None or part.conv != conv:
                    if part is not None:
                        close(part, is_open)
                        is_open = False
                    part = Part(conv)
                if not here:
                    continue
                part.add(turn, role, text, seen)
                waiting += len(text)
                if is_open and len(part.kinds) >= SEGMENT or part.size >= HOLD_BYTES or len(part.kinds) >= HOLD_ROWS:
                    # cut what is held into segments and go on with an empty one
                    if len(part.kinds) <= SEGMENT:
                        segment(part)
                    else:
                        for p in _cut(part):
                            segment(p)
                    part, is_open = Part(conv, part), True
            if out and (waiting > HOLD_BYTES or len(out) > 1000):
                waiting = 0
                yield flush()
        if part is not None:
            close(part, True)  # it may go on in the next range
        if out:
            yield flush()
    return work


def _cut(part: Part):
    """``part`` as parts of at most ``SEGMENT`` rows, counted anew; what rows are compared with before it does not matter, for
    their faults are known."""
    for i in range(0, len(part.kinds), SEGMENT):
        p, j = Part(part.conv), i + SEGMENT
        p.kinds, p.initials, p.roles, p.texts = part.kinds[i:j], part.initials[i:j], part.roles[i:j], part.texts[i:j]
        if i == 0:  # all counts go with the first piece, but those between pieces, which are counted where pieces meet
            p.count = dict(part.count)
            cuts = range(SEGMENT, len(part.kinds), SEGMENT)
            p.count["illegal"] -= sum(part.initials[k - 1] + part.initials[k] not in ("su", "ua", "au") for k in cuts)
            p.low, p.high = part.low, part.high
        yield p


def _rest_costs(batches):
    """Over segments of each conversation from the last to the first: what leaving each costs, and entering it with nothing."""
    import pyarrow as pa

    conv, leave, fresh = None, AT_END, True
    for batch in batches:
        out = []
        for c, pid, seq, costs in zip(*[x.to_pylist() for x in batch.columns]):
            if fresh or c != conv:
                conv, leave, fresh = c, AT_END, False
            after = leave
            if costs is not None:
                leave = entering(costs, leave)
            out.append((pid, seq, list(after), leave[NOTHING]))
        a, b, d, e = zip(*out) if out else ([],) * 4
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(d, pa.list_(pa.int64())), pa.array(e, pa.int64())],
                                         names=["pid", "seq", "leave", "total"])


def _trace_segments(batches):
    """For each segment and each entering role the labels and the leaving role."""
    import pyarrow as pa

    for batch in batches:
        labels, lasts = [], []
        for kinds, leave in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            found = segment_traces(kinds, tuple(leave))
            labels.append([a for a, _ in found])
            lasts.append([r for _, r in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(labels, pa.list_(pa.string())),
                                          pa.array(lasts, pa.list_(pa.int32()))], names=["pid", "seq", "total", "labels", "lasts"])


def _read_segments(texts: bool, schema):
    """Over segments in order: one row a conversation, hashed as it is read."""
    def work(batches):
        import pyarrow as pa

        state = None

        def done(s):
            row = {"conv": s["conv"], **{k: s[k] for k in _COUNTS[:4]}, "gaps": _gaps(s["low"], s["high"], s["turns"]), "cost": s["cost"] or 0,
                   "audit": "".join(s["audit"]), "repaired_sha256": None}
            for _ in TAIL[s["role"]]:
                s["role"] = AFTER[s["role"]]
                put(s, NEW_ROLE[s["role"]], "")
                row["audit"] += "I"
            row["repaired_sha256"] = s["hash"].hexdigest()
            if texts:
                row["repaired"] = s["rows"]
            return row

        def put(s, role, text):
            s["hash"].update(("\n" * s["any"] + f"{role}:{text}").encode("utf-8", "replace"))
            s["any"] = True
            if texts:
                s["rows"].append({"role": role, "text": text})

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if state is None or state["conv"] != r["conv"]:
                    if state is not None:
                        out.append(done(state))
                    state = {"conv": r["conv"], **dict.fromkeys(_COUNTS, 0), "low": None, "high": None, "last": "", "cost": None, "audit": [],
                             "role": NOTHING, "hash": hashlib.sha256(), "any": False, "rows": []}
                s = state
                for k in _COUNTS:
                    s[k] += r[k]
                if r["low"] is not None:
                    s["turns"] -= s["high"] == r["low"]
                    s["low"], s["high"] = r["low"] if s["low"] is None else s["low"], r["high"]
                if not r["kinds"]:
                    continue
                if s["cost"] is None:
                    s["cost"] = r["total"]
                elif s["last"] + r["first"] not in ("su", "ua", "au"):
                    s["illegal"] += 1
                s["last"] = r["last"]
                labels = r["labels"][s["role"]]
                for role, text in edited(labels, s["role"], r["roles"], r["texts"]):
                    put(s, role, text)
                s["audit"].append(labels)
                s["role"] = r["lasts"][s["role"]]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([done(state)], schema=schema)
    return work


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           present: Column | None = None, texts: bool = False) -> DataFrame:
    """One row for each conversation: its id, gaps (turn numbers missing between the first and the last), blank, duplicate, truncated
    (rows by their first fault), illegal (neighbouring roles that may not follow each other), cost, audit and the SHA-256 of the repaired
    ``role:text`` lines. With ``texts`` also ``repaired``, the turns themselves (a conversation's must then fit in one value). Rows that
    are not ``present`` only name their conversation."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = rows.sparkSession
    bound_batches(spark)
    conv_type = dict(rows.dtypes)[conv_col]
    quoted = F.col(f"`{conv_col}`")
    d = rows.select(quoted.alias("conv"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"), F.coalesce(f"`{role_col}`", F.lit(" ")).alias("role"),
                    F.coalesce(f"`{text_col}`", F.lit(" ")).alias("text"), (F.lit(True) if present is None else present).alias("present"))
    named = F.coalesce(F.concat(F.lit("c"), F.length(F.col("conv").cast("string")).cast("string"), F.lit(":"), F.col("conv").cast("string")), F.lit("n"))
    d = d.withColumn("key", F.md5(F.concat(named, F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    repeated = d.where("present").groupBy("key").agg(F.count("*").alias("copies"), F.min(F.struct("turn")).alias("first")) \
        .where("copies > 1").select("key", "first")
    d = d.join(repeated, "key", "left").withColumn("seen", F.coalesce(F.struct("turn") > F.col("first"), F.lit(False)))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.col("key")]
    sorted_ = d.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "seen", "present")

    counts = ", ".join(f"{c} bigint" for c in _COUNTS)
    kept = f", {_REPAIRED}" if texts else ""
    first = StructType.fromDDL(f"conv {conv_type}, pid int, seq int, done boolean, kinds string, costs array<bigint>, roles array<string>, texts array<string>, "
                               f"low bigint, high bigint, first string, last string, {counts}, gaps bigint, cost bigint, audit string, repaired_sha256 string{kept}")
    last = StructType.fromDDL(f"conv {conv_type}, {_STATS}{kept}")
    read = materialise(sorted_.mapInArrow(_read_conversations(texts, conv_type, to_arrow_schema(first)), first), "conversations")
    columns = [f.name for f in last.fields]
    open_ = read.where("NOT done")
    rest = open_.select("conv", "pid", "seq", "costs").repartition("conv") \
        .sortWithinPartitions("conv", F.col("pid").desc(), F.col("seq").desc()) \
        .mapInArrow(_rest_costs, "pid int, seq int, leave array<bigint>, total bigint")
    traced = open_.select("pid", "seq", "kinds").join(rest, ["pid", "seq"]).select("pid", "seq", "kinds", "leave", "total") \
        .mapInArrow(_trace_segments, "pid int, seq int, total bigint, labels array<string>, lasts array<int>")
    parts = open_.select("conv", "pid", "seq", "kinds", "roles", "texts", "low", "high", "first", "last", *_COUNTS).join(traced, ["pid", "seq"]) \
        .repartition("conv").sortWithinPartitions("conv", "pid", "seq").mapInArrow(_read_segments(texts, to_arrow_schema(last)), last)
    return read.where("done").select(*columns).unionByName(parts).withColumnRenamed("conv", conv_col)


def damage(rows: DataFrame) -> tuple[DataFrame, Column]:
    """``rows`` (conv_id, turn, role, text; nulls as one space) damaged by ``crc32("<conv_id>:<turn>") % 20``, and the condition for
    rows that are still there: 0 drops a row, 1 empties its text, 2 removes its sentence marks, 3 repeats it, 4 makes its role user."""
    space = F.lit(" ")
    by = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary"))
    text = F.coalesce("text", space)
    d = rows.select("conv_id", "turn", (by % 20).alias("fault"), F.coalesce("role", space).alias("role"), text.alias("text"))
    d = d.withColumn("text", F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    d = d.withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")))
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))).drop("copy")
    return d, F.col("fault") != 0
