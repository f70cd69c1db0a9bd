import hashlib
import random

import numpy as np

from orrery.llm import induced_sorting as ind, suffix_dedup as sd


def plain(rows):
    """rows of (id, text) to (id, n_bytes, n_removed, n_spans, sha)."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - 49):
                w = b[k : k + 50]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        if i is not None:
            for k in range(len(b) - 49):
                if first[b[k : k + 50]] < i:
                    gone[k : k + 50] = True
        gone = gone[: len(b)]
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def in_order(x, size, depth, **options):
    """Positions in ascending order and their prefix values with the one before."""
    got = list(ind.suffixes(x, size, depth, **options))
    pos, val = (np.concatenate([g[i] for g in got])[::-1] for i in (0, 1))
    return pos.tolist(), np.append(0, val[:-1]).tolist()


def strings(n):
    rng = np.random.default_rng(0)
    for trial in range(n):
        t = bytes(rng.integers(1, 2 + rng.integers(0, 5), rng.integers(1, 120)).astype(np.uint8))
        yield t * int(rng.integers(1, 5)) if trial % 2 else t
    yield b"a" * 200
    yield b"ab" * 150
    yield b"\0".join([b"one passage of text"] * 12) + b"\0"


def check(t, depth, **options):
    pos, val = in_order(np.frombuffer(t, np.uint8).copy(), 256, depth, **options)
    assert sorted(pos) == list(range(len(t)))
    for i in range(1, len(t)):
        a, b = t[pos[i - 1] :], t[pos[i] :]
        same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert a[:depth] <= b[:depth] and val[i] == min(same, depth)


def test_suffixes_and_prefix_values_equal_brute_force():
    for k, t in enumerate(strings(120)):
        check(t, (3, 10, 50, 200)[k % 4])


def test_bands_of_many_symbols_and_spilled_queues(tmp_path, monkeypatch):
    monkeypatch.setattr(ind, "PLAIN", 1)
    monkeypatch.setattr(ind, "CHUNK", 16)
    monkeypatch.setattr(ind, "BAND", 20)
    stats = {}
    for k, t in enumerate(strings(40)):
        check(t, (3, 50, 200)[k % 3], memory=100, spill=str(tmp_path), stats=stats)
    assert stats["spilled"] > 40 and stats["levels"] > 60
    assert not list(tmp_path.iterdir())


def test_equal_windows_have_equal_seeds(monkeypatch):
    rnd = random.Random(4)
    data = bytes(rnd.choice(b"ab") for _ in range(700)) + b"a" * 300
    n = len(data) - sd.LENGTH + 1
    wide = lambda h, at, first: tuple(np.repeat(x, np.diff(np.append(first, n))) for x in (h, at))
    h, at = wide(*sd.seed_runs(data))
    monkeypatch.setattr(sd, "PIECE", 97)
    h2, at2 = wide(*sd.seed_runs(data))
    assert (h == h2).all() and (at == at2).all()
    assert ((at >= np.arange(len(at))) & (at <= np.arange(len(at)) + sd.LENGTH - sd.GRAM)).all()
    seen = {}
    for k in range(len(h)):
        assert seen.setdefault(data[k : k + 50], (h[k], at[k] - k)) == (h[k], at[k] - k)


def test_hashes_of_seeds_cover_their_range():
    """Least hashes must not all fall in one part of the exchange."""
    rnd = random.Random(8)
    text = bytes(rnd.randrange(97, 123) for _ in range(40_000))

    class One:
        ids, known, sizes, starts = np.array([1]), np.array([True]), np.array([len(text)]), np.array([0])

    One.text = text
    h = sd.block_seeds(One)[0]
    share = np.bincount((h >> np.uint64(44)).astype(int), minlength=16) / len(h)
    assert share.min() > 0.04 and share.max() < 0.09


def rows_():
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    a, b = text(300), text(90)
    rows = [(1, a), (2, text(40) + a[30:130] + text(40) + a[200:249]), (3, a), (4, a[100:] + b), (5, b + b), (6, b[:49]), (7, None), (8, ""), (None, a), (9, "z" * 400), (10, "z" * 120), (10, "z" * 120), (10, text(50) + a[:70]), (-5, text(20) + b[10:75]), (11, text(3000))]
    return rows + [(20 + i, a[i : i + 80] + text(5) + b[: 60 + i]) for i in range(20)]


def test_equals_brute_force_and_odd_rows(spark, monkeypatch):
    rows = rows_()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, id int")
    got = sd.dedup(df, with_text=True).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == plain(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert sd.dedup(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    from orrery.llm.q_suffix_dedup import query

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = query(spark, sf).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == plain(rows)


def test_query_sorts_through_spilled_queues(spark, tmp_path):
    """With the registered parameters, queues of a shard go to disk and names are sorted by recursion."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(5000)]
    base = [" ".join(rnd.choice(words) for _ in range(1200)) for _ in range(400)]
    parts = [t.encode() for t in base]
    stats: dict = {}
    got = sd.least_ids(parts + parts[:3], np.arange(403), spill=f"file://{tmp_path}/queues", stats=stats)
    assert stats["spilled"] > 0 and stats["levels"] > 2
    assert all((got[400 + i] == i).all() for i in range(3)) and all((got[i] == i).all() for i in range(400))


def test_substrings_are_named_without_sweeps(monkeypatch):
    """A level is swept twice, up and down; its names are those of its substrings, in order, with what neighbours have in common."""
    made, real = [], ind.Sweep
    monkeypatch.setattr(ind, "Sweep", lambda *a: made.append(a) or real(*a))
    for k, t in enumerate(strings(60)):
        depth, stats = (3, 50, 200)[k % 3], {}
        x = np.frombuffer(t, np.uint8)
        made.clear()
        in_order(x.copy(), 256, depth, stats=stats)
        assert len(made) == 2 * stats["levels"]
        v = ind.Level(x, 256, np.ones(256, np.uint8), np.zeros(256, np.uint8), depth, ind.MEMORY, None)
        if not len(v.stars):
            continue
        p = v.stars.tolist()
        run = lambda q: next((i for i in range(q, len(t)) if t[i] != t[q]), len(t)) - q
        sub = {a: t[a : b + run(b) + 1] if b else t[a:] for a, b in zip(p, [*p[1:], 0])}
        pos, val, name, _, length, step = ind._names(v)
        got = [sub[a][:depth] for a in pos.tolist()]
        assert got == sorted(got) and sorted(pos.tolist()) == p
        for i in range(1, len(got)):
            same = next((j for j, (y, z) in enumerate(zip(got[i - 1], got[i])) if y != z), min(len(got[i - 1]), len(got[i])))
            assert (name[i] == name[i - 1]) == (got[i] == got[i - 1]) and (val[i] >= depth or got[i] != got[i - 1] and val[i] == same)
        assert len(length) == len(step) == name[-1] + 1
