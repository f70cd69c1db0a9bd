import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from orrery.llm import conversations as c
from orrery.llm.q_conversations import query

SF = "/root/testdata/sf0.001"
OK = re.compile("(s?(ua)+)?")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damaged(rows):
    """(turn, role, text) rows of each conversation after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        mine += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    for mine in out.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def marks(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Least (cost, edits, lines) by going through every state; whole strings are compared."""
    step = lambda q, role: {"0s": "1", "0u": "2", "1u": "2", "2a": "3", "3u": "2"}.get(q + role[:1]) if role[:1] else q

    best = {q: (0, "", ()) if q in "03" else None for q in "0123"}

    def inserted(best):
        for _ in range(3):
            for q in "0123":
                for name in ("user", "assistant"):
                    to = step(q, name)
                    if to and best[to]:
                        cost, edits, lines = best[to]
                        new = (cost + 3, "I" + edits, (f"{name}:", *lines))
                        if best[q] is None or new[:2] < best[q][:2]:
                            best[q] = new
        return best

    best = inserted(best)
    for (_, role, text), fault in list(zip(rows, faults))[::-1]:
        now = {}
        for q in "0123":
            ways = [(best[q][0] + 4, "D" + best[q][1], best[q][2])] if best[q] else []
            if fault not in ("blank", "duplicate"):
                for name, cost, op in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    to = step(q, name)
                    if to and best[to]:
                        ways.append((best[to][0] + cost + 3 * (fault == "truncated"), op + best[to][1], (f"{name}:{text}", *best[to][2])))
            now[q] = min(ways, key=lambda w: w[:2]) if ways else None
        best = inserted(now)
    return best["0"]


def plain(rows):
    out = {}
    for conv, mine in damaged(rows).items():
        f = marks(mine)
        turns = [t for t, _, _ in mine if t is not None]
        initials = [r[:1] for _, r, _ in mine]
        cost, edits, lines = cheapest(mine, f)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    rows = df.select("conv_id", *c.STATS, "cost", "audit", "repaired_sha256").collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_equals_plain_version(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(query(spark, sf)) == plain(rows)


def many(rng, ids, most):
    texts = ["Yes.", "No", "  ", "", "Why?", "a b", "ok!", None, "long " * 3000 + "."]
    roles = ["user", "assistant", "system", "tool", None, "", "a", "sys"]
    return [(i, rng.choice([None, t, t, t, t + 3]), rng.choice(roles), rng.choice(texts + [f"text {rng.random()}."] * 8)) for i in ids for t in range(rng.randrange(1, most))]


def test_odd_rows_spread_over_ranges(spark):
    rng = random.Random(5)
    rows = many(rng, [None, *range(40)], 9) + [(77, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", f"No. {t}.", "cut", ""])) for t in range(700)]
    rows += [(78, None, "user", "Hot.")] * 300 + rows[:9]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "'x' AS ck", "2 AS n", "0 AS h").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        first, walked, _ = c._run(c.damage(df), False)
        assert walked.filter("ck = '+77'").select("part").distinct().count() > 3
        assert found(c.repair(c.damage(df))) == plain(rows)
        lines = {}
        for r in sorted(c.repaired_turns(c.damage(df)).collect(), key=lambda r: (r.part, r.pos)):
            lines.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = plain(rows)
    assert {k: c.digest(lines.get(k, [])) for k in want} == {k: v[-1] for k, v in want.items()}
    assert all(OK.fullmatch("".join(r[:1] for _, r, _ in v)) for v in lines.values())


def test_every_repair_of_short_conversations():
    rng = random.Random(1)
    puts = [p for n in range(3) for p in itertools.product(("user", "assistant"), repeat=n)]
    for _ in range(25):
        rows = [(i, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["A.", "B", "", "C!"])) for i in range(rng.randrange(0, 4))]
        f, best = marks(rows), None
        for ops in itertools.product("DKUA", repeat=len(rows)):
            if any(o != "D" and m in ("blank", "duplicate") for o, m in zip(ops, f)):
                continue
            base = sum({"D": 4, "K": 0}.get(o, 3) + 3 * (o != "D" and m == "truncated") for o, m in zip(ops, f))
            if best and base > best[0]:
                continue
            for ins in itertools.product(puts, repeat=len(rows) + 1):
                cost = base + 3 * sum(map(len, ins))
                if best and cost > best[0]:
                    continue
                edits, roles = "I" * len(ins[0]), [p[0] for p in ins[0]]
                for (_, role, _), o, p in zip(rows, ops, ins[1:]):
                    edits += {"U": "R", "A": "R"}.get(o, o) + "I" * len(p)
                    roles += ([] if o == "D" else [{"K": role[:1], "U": "u", "A": "a"}[o]]) + [x[0] for x in p]
                if OK.fullmatch("".join(roles)) and (best is None or (cost, edits) < best):
                    best = (cost, edits)
        _, cost, edits, _ = c.repair_whole([(t, r, x, 1, False) for t, r, x in rows])
        assert (cost, edits) == best


def test_empty_and_all_dropped(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.repair(c.damage(none)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = found(c.repair(c.damage(spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string"))))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
