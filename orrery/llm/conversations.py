"""Conversation structure repair by a dynamic programme over retained turns.

A conversation's roles should read ``(s?(ua)+)?``. Turns are kept or reroled, deleted, or put in, at least cost: keep 0, rerole to user or
assistant 3, delete 4 (blank turns and repeats must go), insert an empty user or assistant turn 3; a truncated turn that stays costs 3 more.
A repair is a subsequence of retained turns. What lies between two of them is priced by prefix sums of deletions, what is put in
between by the pair of their roles, so the cost from turn i on is -D(i) plus the least over roles r of (inserts before r) + M(r), where M(r), the
running minimum of D(j) + retaining turn j as r + what follows, is kept per role as i falls (``price``). A walk forward then takes, of the edits
that still reach the least cost, the ASCII-least (D, I, K, R): from any state each letter leads to one state, so that choice gives the
ASCII-least string of edits (``walk``).

Scale: rows that are equal in conversation, turn, role and text are counted before they are shuffled, and the rest is range-sorted by these, so a
conversation of any length spreads over ranges. One that lies within a range is done there. Of those at the ends of ranges (two a range at most) only the
pieces are set aside: each gives a 4 x 4 table of least costs between states; the driver combines these (as many as ranges, none depends on the
number of rows) into each piece's cost beyond its end and the state at its start, and the pieces are walked in parallel. The digest of a repaired
conversation reads its pieces in order, as a stream.

Results in the odd cases: a null role or text is one space (so is a null id or turn in the hash of ``damage``); a null conversation is one
of its own; turns are ordered nulls first, equal ones by role, then text; repeated rows count as repeats; a role's initial is its first
character, and a role without one is passed over by the pattern; very long texts are only compared and copied; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from orrery.storage import discard, stored

SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEVER = 1 << 50
NONE, SYSTEM, USER, ASSISTANT = range(4)  # state: the initial retained last
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: What is put in before a retained turn of a role (column) after a state (row); None where nothing helps.
BETWEEN = {
    NONE: {SYSTEM: (), USER: (), ASSISTANT: (USER,)},
    SYSTEM: {SYSTEM: None, USER: (), ASSISTANT: (USER,)},
    USER: {SYSTEM: None, USER: (ASSISTANT,), ASSISTANT: ()},
    ASSISTANT: {SYSTEM: None, USER: (), ASSISTANT: (USER,)},
}
AT_END = {NONE: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
GAP = [[NEVER if BETWEEN[q].get(r) is None else INSERT * len(BETWEEN[q][r]) for r in range(4)] for q in range(4)]
CLOSE = [INSERT * len(AT_END[q]) for q in range(4)]
STATS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults by crc32(conv_id:turn) mod 20: dropped, emptied, without full stops, repeated, or made the user's. Dropped rows stay as a
    row of nulls with ``n`` 0, so that no conversation is forgotten; a repeat is ``n`` 2."""
    space = F.lit(" ")
    h = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role, text, gone = F.coalesce("role", space), F.coalesce("text", space), h == 0
    kept = lambda c: F.when(~gone, c)
    return rows.select(
        "conv_id", kept(F.col("turn")).alias("turn"), kept(F.when(h == 4, "user").otherwise(role)).alias("role"),
        kept(F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)).alias("text"), F.when(gone, 0).when(h == 3, 2).otherwise(1).cast("long").alias("n"),
    )


class Turn:
    """A distinct row: what retaining it costs by state, or that it must go; ``more`` repeats of it follow that must go."""

    __slots__ = ("role", "text", "options", "through", "goes", "more")

    def __init__(self, role: str, text: str, goes: bool, cut: bool, more: int):
        self.role, self.text, self.goes, self.more = role, text, goes, more
        own, extra = INITIALS.get(role[:1]), TRUNCATED if cut else 0
        self.through = extra if not role and not goes else None  # a role without initial leaves the state as it is
        self.options = [] if goes else [(r, REROLE + extra, "R") for r in NAMES if r != own] + ([(own, extra, "K")] if own else [])


def faults(rows: list[tuple]) -> tuple[list[Turn], dict]:
    """Turns of (turn, role, text, n, before) rows in order, and counts. ``before``: an earlier piece has such a row."""
    seen: set = set()
    out: list[Turn] = []
    s = dict.fromkeys(STATS, 0) | {"turns": 0, "low": None, "high": None, "first": None, "last": None}
    for turn, role, text, n, before in rows:
        if turn is not None:
            s["turns"] += turn != s["high"]
            s["low"], s["high"] = turn if s["low"] is None else s["low"], turn
        now = role[:1]
        if s["last"] is not None:
            s["illegal"] += s["last"] + now not in ("su", "ua", "au")
        s["illegal"] += n - 1
        s["first"], s["last"] = now if s["first"] is None else s["first"], now
        body = text.rstrip(SPACES)
        cut = False
        if not body:
            s["blank"] += n
            out.append(Turn(role, "", True, False, n - 1))
            continue
        key = (role, hashlib.md5(text.encode("utf-8", "surrogatepass")).digest())
        known = before or key in seen
        seen.add(key)
        s["duplicate"] += n - 1 + known
        if not known:
            cut = body[-1] not in ENDS
            s["truncated"] += cut
        out.append(Turn(role, text, known, cut, n - 1))
    return out, s


def price(turns: list[Turn], end: list[int]) -> list[list[int]]:
    """Least cost from each turn on, by state before it; ``end``: what each state costs after the last."""
    deleted = [0]
    for t in turns:
        deleted.append(deleted[-1] + DELETE * (1 + t.more))
    least, through = [NEVER] * 4, [deleted[-1] + c for c in end]
    out = [list(end)]
    for i in range(len(turns) - 1, -1, -1):
        t, d, after = turns[i], deleted[i], out[-1]
        rest = DELETE * t.more
        for r, cost, _ in t.options:
            least[r] = min(least[r], d + cost + rest + after[r])
        if t.through is not None:
            through = [min(a, d + t.through + rest + b) for a, b in zip(through, after)]
        out.append([min(through[q], *(g + m for g, m in zip(GAP[q], least))) - d for q in range(4)])
    return out[::-1]


def walk(turns: list[Turn], costs: list[list[int]], state: int) -> tuple[str, list[tuple], int]:
    """Edits, retained and inserted (edit, role, text) rows, and the state at the end: the ASCII-least of the cheapest repairs."""
    edits, lines = [], []
    for i, t in enumerate(turns):
        now, after, rest = costs[i][state], costs[i + 1], DELETE * t.more
        if DELETE + rest + after[state] == now:
            edits.append("D")
        else:
            ways = [("I" * len(BETWEEN[state][r]) + op, r) for r, cost, op in t.options if GAP[state][r] + cost + rest + after[r] == now]
            if t.through is not None and t.through + rest + after[state] == now:
                ways.append(("K", None))
            letters, r = min(ways, key=lambda w: w[0])
            edits.append(letters)
            lines += [("I", NAMES[x], "") for x in (BETWEEN[state][r] if r is not None else ())]
            lines.append((letters[-1], NAMES[r] if letters[-1] == "R" else t.role, t.text))
            state = state if r is None else r
        edits.append("D" * t.more)
    return "".join(edits), lines, state


def closing(state: int) -> tuple[str, list[tuple]]:
    return "I" * len(AT_END[state]), [("I", NAMES[x], "") for x in AT_END[state]]


def joined_stats(parts: list[dict]) -> dict:
    """Counts of a whole conversation from those of its pieces in order."""
    out = {k: sum(p[k] for p in parts) for k in STATS}
    turns, high, last = 0, None, None
    low = min((p["low"] for p in parts if p["low"] is not None), default=None)
    for p in parts:
        if p["high"] is not None:
            turns += p["turns"] - (p["low"] == high)
            high = p["high"]
        if p["first"] is not None:
            out["illegal"] += last is not None and last + p["first"] not in ("su", "ua", "au")
            last = p["last"]
    out["gaps"] = min(high - low + 1 - turns, (1 << 63) - 1) if high is not None else 0
    return out


def repair_whole(rows: list[tuple]) -> tuple[dict, int, str, list[tuple]]:
    """Counts, cost, edits and repaired (edit, role, text) rows of one conversation."""
    turns, s = faults(rows)
    costs = price(turns, CLOSE)
    edits, lines, state = walk(turns, costs, NONE)
    more, inserted = closing(state)
    return joined_stats([s]), costs[0][NONE], edits + more, lines + inserted


def digest(lines: list[tuple]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in lines).encode("utf-8", "surrogatepass")).hexdigest()


KEY = "ck"  # the conversation as text, null apart
_ROW = "ck string, part int, turn long, role string, text string, n long"
_DONE = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LINE = "pos long, edit string"


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _table(rows: list[dict], schema: str) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in schema.split(", ")]))


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[b.column(b.schema.get_field_index(n)).to_pylist() for n in names])


def _first_pass(want_lines: bool):
    """Sorted rows of a range: conversations within it repaired, rows of those at its ends as they are."""
    schema = f"kind string, {_ROW}, {_DONE}, {_LINE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, size = TaskContext.get().partitionId(), [], 0
        raw = lambda ck, r: {"kind": "row", "ck": ck, "part": part, "turn": r[0], "role": r[1], "text": r[2], "n": r[3]}
        held: tuple | None = None  # the conversation before, unless it is the range's first
        for at, (ck, mine) in enumerate(groupby(_rows(batches, "ck", "turn", "role", "text", "n"), key=lambda x: x[0])):
            if held:
                s, cost, edits, lines = repair_whole(held[1])
                out.append({"kind": "done", "ck": held[0], **s, "cost": cost, "audit": edits, "repaired_sha256": digest(lines)})
                if want_lines:
                    out += [{"kind": "line", "ck": held[0], "part": part, "pos": i, "edit": e, "role": r, "text": t} for i, (e, r, t) in enumerate(lines)]
                size += sum(len(r[2]) for r in held[1])
                held = None
            if at == 0:
                for _, *r in mine:
                    out.append(raw(ck, r))
                    size += len(r[2] or "")
                    if len(out) >= 2000 or size > 8_000_000:
                        yield from _table(out, schema).to_batches()
                        out, size = [], 0
            else:
                held = (ck, [(*r, False) for _, *r in mine if r[3]])
            if len(out) >= 2000 or size > 8_000_000:
                yield from _table(out, schema).to_batches()
                out, size = [], 0
        if held:
            out += [raw(held[0], r) for r in held[1]] or [raw(held[0], (None, None, None, 0))]
        if out:
            yield from _table(out, schema).to_batches()

    return run, schema


def _piece(rows: pa.Table) -> tuple[list[Turn], dict]:
    mine = [r for r in _rows(rows.to_batches(), "turn", "role", "text", "n", "before") if r[3]]
    return faults(sorted(mine, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])))


def _pieces(rows: DataFrame) -> tuple[DataFrame, dict, dict]:
    """Rows set aside with ``before``; by (ck, part) the costs after a piece and the state before it; by ck what the conversation counts and costs."""
    mark = F.md5(F.concat_ws("#", F.length("role"), "role", "text").cast("binary"))
    costs, states = "ck string, part int, costs array<long>, stats string", "ck string, part int, to array<int>"
    rows = stored(rows.withColumn("mark", mark), "pieces")
    firsts = stored(rows.filter("n > 0").groupBy("ck", "mark").agg(F.min("part").alias("at")), "firsts")
    marked = stored(rows.join(firsts, ["ck", "mark"], "left").withColumn("before", F.coalesce(F.col("part") > F.col("at"), F.lit(False))).drop("mark", "at"), "marked")
    discard(rows, firsts)

    def table(key: tuple, rows: pa.Table) -> pa.Table:
        turns, s = _piece(rows)
        unit = [price(turns, [0 if q == r else NEVER for q in range(4)])[0] for r in range(4)]
        return _table([{"ck": key[0].as_py(), "part": key[1].as_py(), "costs": [min(unit[r][q], NEVER) for q in range(4) for r in range(4)], "stats": json.dumps(s)}], costs)

    found: dict[str, list] = {}
    for r in marked.groupBy("ck", "part").applyInArrow(table, costs).collect():  # two a range at most
        found.setdefault(r.ck, []).append((r.part, r.costs, json.loads(r.stats)))
    after, whole = {}, {}
    for ck, parts in found.items():
        parts.sort(key=lambda p: p[0])
        end = list(CLOSE)
        for part, c, _ in reversed(parts):
            after[ck, part] = end
            end = [min(c[q * 4 + r] + end[r] for r in range(4)) for q in range(4)]
        whole[ck] = joined_stats([s for _, _, s in parts]) | {"cost": end[NONE]}

    def leads(key: tuple, rows: pa.Table) -> pa.Table:
        turns, _ = _piece(rows)
        ck, part = key[0].as_py(), key[1].as_py()
        c = price(turns, after[ck, part])
        return _table([{"ck": ck, "part": part, "to": [walk(turns, c, q)[2] if c[0][q] < NEVER // 2 else -1 for q in range(4)]}], states)

    to = {(r.ck, r.part): r.to for r in marked.groupBy("ck", "part").applyInArrow(leads, states).collect()}
    start: dict = {}
    for ck, parts in found.items():
        state = NONE
        for part, _, _ in parts:
            start[ck, part] = (state, after[ck, part], part == parts[-1][0])
            state = to[ck, part][state]
    return marked, start, whole


def _walked(marked: DataFrame, start: dict) -> DataFrame:
    """Edits and repaired rows of the pieces: a row without text for the edits, then the lines."""

    schema = "ck string, part int, pos long, edit string, role string, text string"

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ck, part = key[0].as_py(), key[1].as_py()
        state, after, last = start[ck, part]
        turns, _ = _piece(rows)
        edits, lines, state = walk(turns, price(turns, after), state)
        if last:
            more, inserted = closing(state)
            edits, lines = edits + more, lines + inserted
        out = [{"pos": -1, "edit": edits, "role": None, "text": None}] + [{"pos": i, "edit": e, "role": r, "text": t} for i, (e, r, t) in enumerate(lines)]
        return _table([{"ck": ck, "part": part, **r} for r in out], schema)

    return marked.groupBy("ck", "part").applyInArrow(run, schema)


def _digests(walked: DataFrame, whole: dict) -> DataFrame:
    """One row a conversation; its lines go through the digest as a stream, in order."""
    schema = f"ck string, {_DONE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ck, mine in groupby(_rows(batches, "ck", "pos", "edit", "role", "text"), key=lambda x: x[0]):
            h, edits, some = hashlib.sha256(), [], False
            for _, pos, edit, role, text in mine:
                if pos < 0:
                    edits.append(edit)
                else:
                    h.update((("\n" if some else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    some = True
            yield from _table([{"ck": ck, **whole[ck], "audit": "".join(edits), "repaired_sha256": h.hexdigest()}], schema).to_batches()

    return walked.repartition("ck").sortWithinPartitions("ck", "part", "pos").mapInArrow(run, schema)


def _run(rows: DataFrame, want_lines: bool) -> tuple[DataFrame, DataFrame, dict]:
    ck = F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("conv_id").cast("string")))
    counted = rows.select(ck.alias("ck"), F.col("turn").cast("long").alias("turn"), "role", "text", F.col("n").cast("long").alias("n")).groupBy("ck", "turn", "role", "text").agg(F.sum("n").alias("n"))
    ranges = counted.repartitionByRange("ck", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("ck", "turn", "role", "text")
    run, schema = _first_pass(want_lines)
    first = stored(ranges.mapInArrow(run, schema), "conversations")
    marked, start, whole = _pieces(first.filter("kind = 'row'").select(*[c.split()[0] for c in _ROW.split(", ")]))
    walked = stored(_walked(marked, start), "walked")
    discard(marked)
    return first, walked, whole


def _named(df: DataFrame, rows: DataFrame) -> DataFrame:
    kind = rows.schema["conv_id"].dataType
    return df.withColumn("conv_id", F.when(F.col("ck") != "-", F.expr("substring(ck, 2)")).cast(kind)).drop("ck")


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conversation of ``conv_id, turn, role, text, n`` (``n``: how often the row stands there; 0 only names its conversation):
    counts of gaps and faults, least cost, edits and the digest of the repaired conversation."""
    first, walked, whole = _run(rows, False)
    cols = ["ck", *[c.split()[0] for c in _DONE.split(", ")]]
    return _named(first.filter("kind = 'done'").select(*cols).unionByName(_digests(walked, whole)), rows)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, part, pos`` (order), ``edit`` (I, K or R), ``role, text``."""
    first, walked, _ = _run(rows, True)
    cols = ["ck", "part", "pos", "edit", "role", "text"]
    return _named(first.filter("kind = 'line'").select(*cols).unionByName(walked.filter("pos >= 0").select(*cols)), rows)
