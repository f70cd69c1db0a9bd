import random
import tracemalloc

import numpy as np
import psutil
import pyarrow as pa

from orrery.llm import chaining as ch, holders
from orrery.llm.blocks import lean


def best_chain(pos, apos, k, gap):
    """Quadratic version of the recurrence."""
    n, score = len(pos), []
    for j in range(n):
        best = k
        for i in range(j):
            if pos[i] < pos[j] and apos[i] < apos[j]:
                new = min(k, pos[j] - pos[i], apos[j] - apos[i])
                best = max(best, score[i] + gap * (pos[i] + apos[i]) - gap * (pos[j] + apos[j]) + new)
        score.append(best)
    return max(score)


def test_seeds_are_shared_by_runs():
    rng = np.random.default_rng(3)
    run = rng.integers(0, 1 << 32, ch.K + ch.SPREAD - 1, np.uint64)
    for _ in range(30):
        a, b = (np.concatenate([rng.integers(0, 1 << 32, rng.integers(0, 40), np.uint64), run, rng.integers(0, 1 << 32, rng.integers(0, 40), np.uint64)]) for _ in range(2))
        assert set(ch.seeds_of(a)[0].tolist()) & set(ch.seeds_of(b)[0].tolist())


def test_chains_rise_and_do_not_share_matches():
    rnd = random.Random(2)
    for _ in range(50):
        m = sorted({(rnd.randrange(200), rnd.randrange(200)) for _ in range(rnd.randrange(1, 60))})
        pos, apos = np.array([x for x, _ in m]), np.array([y for _, y in m])
        cs = ch.chains(pos, apos)
        used = [i for c in cs for i in c]
        assert len(used) == len(set(used))
        for c in cs:
            assert all(pos[i] < pos[j] and apos[i] < apos[j] for i, j in zip(c, c[1:]))


def test_best_score_on_one_diagonal():
    pos = np.arange(0, 100, 5)
    assert ch.chains(pos, pos + 7) == [list(range(20))]
    assert best_chain(list(pos), list(pos + 7), ch.K, ch.GAP_COST) > ch.K


def test_alignment_counts_equal_words():
    a = np.arange(100, dtype=np.uint32)
    b = np.delete(a, 50)
    b[20] = 999
    pos = np.array([5, 60])
    s, e, t, f, same = ch.align(a, b, pos, np.array([5, 59]))
    assert (s, e, t, f) == (0, 100, 0, 99) and same == 98 / 100


def test_planted_passages_and_odd_rows(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    p = text(80)
    fuzzy = list(p)
    fuzzy[40] = "changed"
    del fuzzy[60]
    rows = [
        (1, " ".join(text(50) + p + text(50)), "a"), (2, " ".join(text(20) + p), "a"), (3, " ".join(text(30) + fuzzy + text(9)), "a"), (4, " ".join(text(400)), "a"),
        (5, None, "n"), (6, "", "n"), (None, " ".join(p), "n"), (7, "short text", "s"), (8, " ".join(text(3000)), "l"),
    ]
    rows += [(9, rows[-1][1].upper(), "copy")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, pos string")
    got = {r.doc_id: r for r in ch.passages(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8, 9}
    assert {d: r.n_repeated for d, r in got.items()} == {1: 0, 2: 80, 3: 79, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 3000}
    assert (got[3].passages[0].start, got[3].passages[0].other_id) == (30, 1) and got[3].passages[0].identity > 0.9
    assert ch.passages(df.limit(0)).count() == 0
    pairs = {(r.doc_id, r.other_id) for r in ch.pairs(df).collect()}
    assert pairs == {(2, 1), (3, 1), (9, 8)} and ch.pairs(df.limit(0)).count() == 0


def test_query_finds_every_long_exact_run(spark):
    """Every document with 50 words in a row of an earlier one is in a pair, and reported passages are in both texts."""
    from orrery.llm.q_chaining import query

    sf = "/root/testdata/sf0.001"
    words = {r.doc_id: ch.word_hashes(r.text).tolist() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    first, want = {}, set()
    for d in sorted(words):
        runs = [tuple(words[d][i : i + 50]) for i in range(len(words[d]) - 49)]
        if any(first.get(x, d) < d for x in runs):
            want.add(d)
        for x in runs:
            first.setdefault(x, d)
    rows = query(spark, sf).collect()
    assert want <= {r.doc_id for r in rows} and all(r.other_id < r.doc_id and r.identity >= ch.IDENTITY for r in rows)
    for r in rows:
        a, b = words[r.doc_id][r.start : r.end], words[r.other_id]
        assert len(set(a) & set(b[r.other_start : r.other_start + 2 * len(a)])) >= 0.5 * len(set(a))


def test_two_passages_of_one_pair_stay(spark):
    """Two exact passages with other words between them, fewer than their chain bridges."""
    rnd = random.Random(11)
    text = lambda n: ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    p, q = text(60), text(60)
    df = spark.createDataFrame([(i, " ".join(text(30) + p + text(100) + q + text(30))) for i in (1, 2)], "doc_id long, text string")
    assert sorted((r.start, r.end, r.other_start, r.identity) for r in ch.pairs(df).collect()) == [(30, 90, 30, 1.0), (190, 250, 190, 1.0)]


def test_equal_words_at_any_length():
    rng = np.random.default_rng(5)
    for _ in range(100):
        a, b = (rng.integers(0, 6, rng.integers(0, 70)).astype(np.uint32) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *_lcs_row(row, x, b)]
        assert ch.equal_words(a, b) == row[-1]
    long = np.arange(400, dtype=np.uint32)
    assert ch.equal_words(np.insert(long, 100, 999), long) == 400


def _lcs_row(row, x, b):
    out = [0]
    for j, y in enumerate(b, 1):
        out.append(row[j - 1] + 1 if x == y else max(row[j], out[-1]))
    return out[1:]


def test_long_stretch_without_seeds_is_aligned():
    """400 copied words with one more at 100; seeds of the copy's middle 250 words are with another document."""
    a = np.arange(400, dtype=np.uint32)
    b = np.insert(a, 100, 999)
    apos = np.array([5, 25, 45, 330, 350, 370])
    assert ch.align(b, a, np.where(apos > 100, apos + 1, apos), apos)[4] == 400 / 401


def test_copies_meet_whatever_came_first(spark):
    """Two documents share 60 words, exactly or with edits; every seed of them is in an earlier document that shares little else."""
    rnd = random.Random(13)
    text = lambda n: ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    p, q = text(60), text(60)
    edited = [*q[:20], "changed", *q[21:40], "changed", *q[41:]]
    rows = [text(9) + x[a : a + 20] + text(9) for x in (p, q) for a in range(0, 50, 10)] + [text(30) + p, text(9) + p + text(9), text(30) + q, text(9) + edited + text(9)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {(r.doc_id, r.other_id) for r in ch.pairs(df).collect() if r.end - r.start >= ch.MIN_WORDS}
    assert got == {(11, 10), (13, 12)}
    assert [r.n_repeated for r in ch.passages(df).filter("doc_id in (11, 13)").collect()] == [60, 60]


def test_matches_do_not_depend_on_blocks():
    rng = np.random.default_rng(8)
    rows = np.array(sorted({tuple(map(int, x)) for x in rng.integers(0, (6, 8, 9), (150, 3))}))
    steps = range(0, ch.LONG - ch.K + 1, ch.K)
    want: tuple[set, set] = (set(), set())
    for h, i, p in rows.tolist():
        before = [(x, y) for g, x, y in rows.tolist() if g == h and x < i]
        for x, y in {before[0], min(b for b in before if b[0] == before[-1][0])} if before else ():
            want[bool(h & 1) or x != before[0][0]].update((i, x, p + d, y + d) for d in (steps if h & 1 else [0]))
    for borders in ([8], [0, 8], [3, 8], [2, 3, 5, 8], list(range(9))):
        held = []
        for low, high in zip([0, *borders], borders):
            part = rows[(rows[:, 1] >= low) & (rows[:, 1] < high)]
            held.append((part[:, 0].astype(np.uint64), part[:, 1], part[:, 2]))
        sent = [holders.entries(*x) for x in held]
        assert all((a == b).all() for e in sent for a, b in zip(e, holders.unpacked(holders.pack(e), len(e[0]))))
        owner, _, found = holders.answers(sent)
        got: tuple[set, set] = (set(), set())
        for k, x in enumerate(held):
            for out, m in zip(got, ch.matches_of(*x, tuple(c[owner == k] for c in found))):
                out.update(map(tuple, m.tolist()))
        assert got == want


def test_ends_grow_as_far_as_words_agree(spark):
    """A long passage with every 3rd word changed but for a stretch in its middle or at its start; and one of which only its first words have seeds."""
    rnd = random.Random(31)
    text = lambda n: ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    p, tail = text(520), text(900)
    # every 4th word changed leaves no seed of 4 words; the 300 exact words before keep the identity over 0.8
    fuzzy = p[:300] + [f"{w}x" if i % 4 == 3 else w for i, w in enumerate(p[300:])]
    rows = [(1, text(20) + p + tail), (2, text(7) + fuzzy + text(60))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    (r,) = ch.pairs(df).collect()
    assert (r.start, r.other_start) == (7, 20) and 520 - 4 <= r.end - r.start <= 520 and r.identity >= ch.IDENTITY


def test_words_of_bytes():
    import re

    texts = ["Alpha beta  gamma\t", "", " ", "delta", "ALPHA \u00c9clair \u0000 x", "z" * 200 + " " + "z" * 201 + " a", "beta"]
    want = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) for t in texts]
    codes: dict = {}
    for t, w in zip(texts, want):
        got = ch.word_hashes(t).tolist()
        assert len(got) == len(w) and all(codes.setdefault(x, h) == h for x, h in zip(w, got))
    assert len(set(codes.values())) == len(codes) and ch.word_hashes(None).tolist() == []
    data = b"".join(t.encode() for t in texts)
    sizes = np.array([len(t.encode()) for t in texts])
    starts = np.cumsum(sizes) - sizes
    h, begin = ch.hashed(data, starts)
    cut = np.searchsorted(begin, [*starts, len(data)])
    assert [h[a:b].tolist() for a, b in zip(cut, cut[1:])] == [ch.word_hashes(t).tolist() for t in texts]


def test_rising_matches_need_no_tree(monkeypatch):
    rng = np.random.default_rng(4)
    for _ in range(40):
        pos, apos = (np.cumsum(rng.integers(1, 9, 30)) for _ in range(2))
        want = ch.chains(pos, apos)
        extra = ch.chains(np.append(pos, pos[-1] + 500), np.append(apos, -1))  # one match out of order: the tree is used
        assert [c for c in extra if 30 not in c] == want


def test_covered_places():
    spans = [{"start": 5, "end": 20}, {"start": 7, "end": 12}, {"start": 30, "end": 40}]
    want = [any(s["start"] <= p and p + ch.K <= s["end"] for s in spans) for p in range(50)]
    assert ch.covered(np.arange(50), spans).tolist() == want


def test_fuzzy_passages_down_to_the_identity(spark):
    """Copied words with every 5th, 7th or 10th changed (identity 0.8 to 0.9)."""
    rnd = random.Random(17)
    text = lambda n: ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    rows, want = [], {}
    for n, every in ((60, 5), (60, 7), (60, 10), (44, 5)):
        p = text(n)
        fuzzy = [w if (i + 1) % every or i == n - 1 else f"{w}x" for i, w in enumerate(p)]
        want[len(rows) + 1] = (len(rows), sum(x == y for x, y in zip(p, fuzzy)) / n)
        rows += [text(50) + p + text(50), text(30) + fuzzy + text(30)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {}
    for r in ch.pairs(df).collect():
        got.setdefault((r.doc_id, r.other_id), []).append(r)
    assert set(got) == {(d, o) for d, (o, _) in want.items()}
    assert all(abs(max(r.identity for r in got[d, o]) - share) < 0.05 for d, (o, share) in want.items())


def test_texts_that_share_an_id_all_count(spark):
    rnd = random.Random(23)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b = text(60), text(60)
    df = spark.createDataFrame([(1, a), (1, b), (1, a), (1, None), (2, a), (3, b), (None, a)], "doc_id long, text string")
    assert {(r.doc_id, r.other_id, r.end - r.start) for r in ch.pairs(df).collect()} == {(2, 1, 60), (3, 1, 60)}


def test_holders_between_the_first_and_the_last_are_met(spark):
    """A passage whose seeds others hold before, between and after: only its two middle holders share more than a piece of it."""
    rnd = random.Random(29)
    text = lambda n: ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    p = text(72)
    edited = [f"{w}x" if i % 12 == 6 else w for i, w in enumerate(p)]
    pieces = [p[a : a + 16] for a in range(0, 60, 8)]
    rows = [text(9) + x + text(9) for x in pieces] + [text(10) + p + text(10)] + [text(9) + x + text(9) for x in pieces] + [text(10) + edited + text(10)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = [(r.doc_id, r.other_id, r.start, r.end, r.other_start) for r in ch.pairs(df).collect()]
    assert (17, 8, 10, 82, 10) in got and {g[:2] for g in got if g[3] - g[2] >= ch.MIN_WORDS} == {(17, 8)}


def test_passages_that_grow_from_a_crowded_seed(spark):
    """A line that 150 documents hold; two of them go on alike with every fourth word changed, so they share no other seed; two more share 60 words with it."""
    rnd = random.Random(37)
    text = lambda n: ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    line, right, left, whole = text(20), text(24), text(24), text(40)
    change = lambda x, at: [f"{w}x" if i % 4 == at else w for i, w in enumerate(x)]
    tails = {40: right, 60: change(right, 0), 110: whole, 130: whole}
    heads = {50: left, 70: change(left, 3)}
    rows = [(i, " ".join(text(9) + heads.get(i, []) + line + tails.get(i, []) + text(9))) for i in range(150)]
    pairs = ch.pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.other_id): (r.start, r.end) for r in pairs if r.end - r.start >= ch.MIN_WORDS}
    assert set(got) == {(60, 40), (70, 50), (130, 110)}
    assert got[60, 40] == (9, 53) and got[70, 50] == (9, 53) and got[130, 110] == (9, 69)


def test_crowded_seeds_apart_make_a_passage(spark):
    """Two pieces with six differing words between them: each piece is held by more than 64 documents, or one by a few; in one pair a text lacks the words between."""
    rnd = random.Random(43)
    text = lambda n: ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    a, b, few = text(17), text(19), text(19)
    whole = {100: a + text(6) + b, 120: a + text(6) + b, 200: b + text(6) + a, 220: b + a, 140: a + text(6) + few, 160: a + text(6) + few, 180: text(3) + few, 30: few + text(2), 40: few + text(1)}
    rows = [(i, " ".join(text(9) + (whole.get(i) or (a, b)[i % 2]) + text(9))) for i in range(300)]
    rows.append((300, " ".join(text(9) + few + text(9))))
    pairs = ch.pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r.doc_id, r.other_id, r.start, r.end, r.other_start) for r in pairs if r.end - r.start >= ch.MIN_WORDS or r.doc_id == 220)
    assert got[:2] == [(120, 100, 9, 51, 9), (160, 140, 9, 51, 9)] and {g[:2] for g in got} <= {(120, 100), (160, 140), (220, 200)}


def test_seeds_shared_by_stretches():
    rng = np.random.default_rng(8)
    for n in (0, 3, 4, 50, 200):
        x, y = rng.integers(0, 3, n).astype("<u4"), rng.integers(0, 3, 120).astype("<u4")
        pos, apos = np.array([3, 20]), np.array([5, 31])
        want = [(i, j) for i in range(n - 3) for j in range(117) if (x[i : i + 4] == y[j : j + 4]).all() and 2 - ch.MARGIN <= j - i <= 11 + ch.MARGIN]
        assert [tuple(r) for r in ch.shared(x, y, pos, apos, 1).tolist()] == want


def test_matches_of_all_holders_are_those_between_classes():
    from orrery.llm import all_holders

    rng = np.random.default_rng(12)
    for star, signed in ((0, 0), (0, all_holders.SIGNED), (all_holders.STAR, 0)):
        rows = sorted({tuple(map(int, r)) for r in rng.integers(0, (5, 12, 30), (80, 3))})  # key, id, place
        key, ids, pos = (np.array(c) for c in zip(*rows))
        of, sign = rng.integers(0, 4, len(rows)).astype(np.uint64), rng.integers(0, 2, len(rows)).astype(np.uint64)
        label = [(int(c), 0) if c else (0, int(i)) for c, i in zip(of, ids)]
        want = []  # two keys may give one match
        for b in range(len(rows)):
            for a in range(b):
                first = a == 0 or rows[a - 1][:2] != rows[a][:2]
                if star:
                    first = a == 0 or rows[a - 1][0] != rows[a][0]
                if key[a] == key[b] and ids[a] < ids[b] and first and label[a] != label[b] and (not signed or sign[a] != sign[b]):
                    want.append((int(ids[b]), int(ids[a]), int(pos[b]), int(pos[a])))
        mixed = rng.permutation(len(rows))
        got = [tuple(r[:4]) for x in all_holders.matches(key[mixed].astype(np.uint64), ids[mixed], pos[mixed], of[mixed], sign[mixed], np.full(len(rows), star | signed)) for r in x.tolist()]
        assert want and sorted(got) == sorted(want)


def test_seeds_of_two_holders_meet_without_keys():
    """Matches with the only other holder of a seed are passed on as they are, but for those within a passage of their pair; seeds of more send a key for each way of growth."""
    from orrery.llm import all_holders
    from orrery.llm.blocks import Block

    x = np.array([[7, 10, 2], [7, 50, 42], [9, 11, 300]])
    data = all_holders.pack_matches(x)
    spans = [{"other_id": 7, "start": 8, "end": 48}]
    assert all_holders.open_matches(data, 3, None, ch.K).tolist() == x.tolist()
    assert all_holders.open_matches(data, 3, spans, ch.K).tolist() == x[1:].tolist()
    block = Block.__new__(Block)
    block.text = " ".join(f"w{i}" for i in range(60)).encode()
    block.ids, block.starts, block.sizes = np.array([5]), np.array([0]), np.array([len(block.text)])
    h, ids, pos = ch.occurrences(block)
    short = (h & np.uint64(1)) == 0
    assert list(ch._keys(block, h, ids, pos, np.full(len(h), 2))) == []
    ((i, n, _),) = ch._keys(block, h, ids, pos, np.full(len(h), 3))
    assert (i, n) == (5, short.sum())
    at = np.where(short & (pos == 20), all_holders.CROWD + 1, 1)
    ((i, n, _),) = ch._keys(block, h, ids, pos, at)
    assert (i, n) == (5, 2 * all_holders.SKIP + 1)


def test_links_without_skipped_words_are_counted_at_once():
    rng = np.random.default_rng(6)
    for _ in range(50):
        a, b = (rng.integers(0, 5, 300).astype(np.uint32) for _ in range(2))
        pos, apos = (np.cumsum(rng.integers(1, 12, 20)) for _ in range(2))
        equal, gain = ch._links(a, b, pos, apos, ch.K)
        for i in range(19):
            p, q, dp, dq = pos[i], apos[i], pos[i + 1] - pos[i], apos[i + 1] - apos[i]
            over = min(ch.K, dp, dq)
            assert equal[i] == over + ch.equal_words(a[p + over : p + dp], b[q + over : q + dq]) and abs(gain[i] - equal[i] + ch.IDENTITY * max(dp, dq)) < 1e-9


def test_answers_name_seeds_by_their_steps(spark, monkeypatch):
    """Blocks are answered by places among their own seeds; what they read is what their hashes are told."""
    from orrery.llm import holders
    from orrery.llm.blocks import Block, each_block, with_blocks

    monkeypatch.setattr(holders, "BLOCK_BYTES", 600)
    rnd = random.Random(41)
    rows = [(i, " ".join(rnd.choice("abcde") for _ in range(60))) for i in range(30)]
    blocks = holders.ordered_blocks(spark.createDataFrame(rows, "id long, text string").repartition(3))

    def hashes(t):
        one = Block.__new__(Block)
        one.text, one.ids, one.starts, one.sizes = t.encode(), np.array([0]), np.array([0]), np.array([len(t)])
        return ch.occurrences(one)[0].tolist()

    held: dict = {}
    for i, t in rows:
        for h in set(hashes(t)):
            held.setdefault(h, []).append(i)
    seen = 0
    for block, got in each_block(iter([with_blocks(blocks, holders.told(blocks, ch.occurrences), 1).toPandas()])):
        known = holders.read(got, ch.occurrences(block)[0])
        for h, first, n in zip(known[0].tolist(), known[1].tolist(), known[5].tolist()):
            assert (first, n) == (held[h][0], len(held[h]))
            seen += 1
    assert blocks.count() > 1 and seen


def plain_runs(spans, least=ch.MIN_WORDS):
    runs = []
    for s in sorted(spans):
        if runs and s[0] <= runs[-1][1]:
            r = runs[-1]
            if s[1] - s[0] > r[5]:
                r[2:] = [*s[2:], s[1] - s[0]]
            r[1] = max(r[1], s[1])
        else:
            runs.append([*s, s[1] - s[0]])
    kept = [tuple(r[:5]) for r in runs if r[1] - r[0] >= least]
    return sum(r[1] - r[0] for r in kept), kept, sorted(x for x in spans if any(k[0] <= x[0] and x[1] <= k[1] for k in kept))


def test_runs_of_many_documents_at_once(spark):
    rnd = random.Random(11)
    span = lambda: (s := rnd.randrange(300), s + rnd.randrange(5, 60), rnd.randrange(4), rnd.randrange(9), rnd.choice([0.8, 0.9, 1.0]))
    docs = {i: [span() for _ in range(rnd.randrange(1, 9))] for i in range(400)}
    per = spark.createDataFrame(list(docs.items()), f"id long, c {ch._P}").repartition(3)
    got = {r.id: (r.n_repeated, [tuple(x) for x in r.passages], sorted(tuple(x) for x in r.chains), r.n_passages) for r in ch._runs(per).collect()}
    want = {i: (*r, len(r[1])) for i, c in docs.items() if (r := plain_runs(c))[1]}
    assert 50 < len(want) < 400 and got == want


def test_runs_hold_many_chains_in_little_memory():
    span = pa.array([{"start": 7 * i, "end": 7 * i + 50, "other_id": 1, "other_start": i, "identity": 1.0} for i in range(50)], pa.struct([("start", pa.int32()), ("end", pa.int32()), ("other_id", pa.int64()), ("other_start", pa.int32()), ("identity", pa.float64())]))
    lists = pa.ListArray.from_arrays(pa.array(range(0, 100_001, 50), pa.int32()), pa.concat_arrays([span] * 2000))
    took = []

    class Rows:
        def mapInArrow(self, run, schema):  # noqa: N802 - as Spark names it
            tracemalloc.start()
            took.extend(len(b) for b in run(iter([pa.RecordBatch.from_arrays([pa.array(range(2000)), lists], names=["id", "c"])])))
            took.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()

    ch._runs(Rows())
    assert took[0] == 2000 and took[1] < 20e6  # as Python objects the input alone takes 21.6 MB


def test_freed_memory_goes_back():
    rss = lambda: psutil.Process().memory_info().rss

    def run(batches):
        for _ in batches:
            held = [bytes(60_000) for _ in range(4000)]
            keep.append(held[-1])  # pins the top of the heap
            del held
            yield None

    keep: list = []
    before = rss()
    assert list(lean(run)(iter([1]))) == [None]
    assert rss() < before + 60e6
