"""Language identification by cross-parsing entropy.

Each language has the suffix automaton of a bounded sample of its labelled text. A text is cut greedily into phrases, each
the longest that occurs in that sample (a walk along the automaton until no transition is left); fewer phrases mean a closer
language. Phrases are weighted by the bits that name a place in the sample, so samples of unequal size compare, and the
language with the fewest bits a symbol wins.

The sample is bounded by ``SAMPLE_DOCS`` documents (the first ``SAMPLE_DOC_CHARS`` characters of each, from its first letter where
those hold none) and ``SAMPLE_SYMBOLS`` symbols a language, drawn by hash whatever their length; everything else covers whole texts, as one string each. Automata of all languages advance together over lanes of
a batch of texts, so the work is array operations (``Parser.phrases`` says how a phrase goes on from one lane to the next).

Symbols: letters without case, each its own; anything else is one blank, and blanks do not repeat. Letters that no sample holds
are one unknown symbol. A letter that a language's sample lacks is a phrase of its own and costs its name among all letters as well.

Results in the odd cases: null text, or text without a letter, is ``und`` with score 0; without any labelled text everything is
``und`` with score 0; ties go to the language first in code point order; repeated rows are each judged; null labels are not
learnt from; other columns pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from orrery.llm.columns import free_names

UNDETERMINED = "und"
SAMPLE_DOCS, SAMPLE_DOC_CHARS, SAMPLE_SYMBOLS = 60, 8_000, 24_000
LANE = 512  # symbols walked side by side; no phrase ends because of it
BATCH_SYMBOLS = 4_000_000  # over all languages
JUNK_SHARE, JUNK_LETTERS = 0.95, 60  # a text of so many letters that costs this share of what unrelated letters cost is in no language
PREDICTED = T.StructType.fromJson({"type": "struct", "fields": [{"name": "lang_pred", "type": "string", "nullable": False, "metadata": {}}, {"name": "score", "type": "double", "nullable": False, "metadata": {}}, {"name": "bits", "type": "double", "nullable": True, "metadata": {}}, {"name": "junk", "type": "boolean", "nullable": False, "metadata": {}}]})
PAD, BLANK, UNKNOWN = 0, 1, 2
NEAR = 64


def sample(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs: int = SAMPLE_DOCS, most: int = SAMPLE_DOC_CHARS) -> DataFrame:
    """The starts of at most ``docs`` texts a language, first by hash; the limit is applied before the shuffle as well as after."""
    start = F.substring(text, 1, most)
    start = F.when(start.rlike(r"\p{L}"), start).otherwise(F.substring(F.regexp_replace(text, r"^\P{L}++", ""), 1, most))
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), start.alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("h"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("n") <= docs).select("lang", "text", "n")


def automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton by state (0 none, 1 start)."""
    nxt: list[dict] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in symbols.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if not p:
            link[cur] = 1
        else:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = twin
                while p and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
        last = cur
    return nxt


class Transitions:
    """Transitions of several automata: those of the first ``NEAR`` symbols (the most frequent letters) in a plain table, those of all
    others in one open-addressing table of (state, symbol), whose size follows the transitions, whatever the alphabet."""

    def __init__(self, near: list[np.ndarray], far: list[np.ndarray], width: int):
        """``near``: rows of the plain table; ``far``: (state, symbol, next state) of the others."""
        self.near = np.concatenate([np.zeros((1, NEAR), np.int32), *near]).ravel()
        state, symbol, to = np.concatenate([np.zeros((0, 3), np.int64), *far]).T
        n = len(state)
        self.width, self.bits = np.int64(width), max(6, int(3 * n).bit_length())
        key, to = state * self.width + symbol, to.astype(np.int32)
        self.key, self.to = np.full((1 << self.bits) + 1, -1, np.int64), np.zeros((1 << self.bits) + 1, np.int32)
        slot = self._slot(key)
        while len(key):
            free = self.key[slot] < 0
            take = np.flatnonzero(free)[np.unique(slot[free], return_index=True)[1]]
            self.key[slot[take]], self.to[slot[take]] = key[take], to[take]
            left = np.ones(len(key), bool)
            left[take] = False
            key, to, slot = key[left], to[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def of(rows: list[dict[int, int]], first: int) -> tuple[np.ndarray, np.ndarray]:
        """One automaton's transitions (states from 1 on) with its states numbered from ``first``: a plain table, and the others."""
        near = np.zeros((len(rows) - 1, NEAR), np.int32)
        far = []
        for s, row in enumerate(rows[1:]):
            for c, t in row.items():
                if c in (PAD, UNKNOWN):
                    continue
                if c < NEAR:
                    near[s, c] = t - 1 + first
                else:
                    far.append((s + first, c, t - 1 + first))
        return near, np.array(far, np.int64).reshape(-1, 3)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next states (languages x lanes) by the lanes' symbols, 0 where there is no transition."""
        near = symbol < NEAR
        if near.all():
            return self.near[state * np.int32(NEAR) + symbol]
        out = self.near[state * np.int32(NEAR) + np.where(near, symbol, 0)]
        out[:, ~near] = self._far(state[:, ~near], symbol[~near])
        return out

    def _far(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = (state * self.width + symbol).ravel()
        slot = self._slot(key)
        got = self.key[slot]
        out = np.where(got == key, self.to[slot], 0)
        on = np.flatnonzero((got != key) & (got >= 0))
        slot = slot[on]
        while len(on):
            slot = slot + 1 & (1 << self.bits) - 1
            got = self.key[slot]
            hit = got == key[on]
            out[on[hit]] = self.to[slot[hit]]
            more = ~hit & (got >= 0)
            on, slot = on[more], slot[more]
        return out.reshape(state.shape)


class Parser:
    """Automata of all languages, and the symbol of every code point: one for each letter of any sample."""

    def __init__(self, samples: dict[str, list[str]], most: int = SAMPLE_SYMBOLS):
        self.langs = sorted(samples)
        seen = Counter(ch for ts in samples.values() for t in ts for ch in t.lower() if ch.isalpha())
        letters = sorted(seen, key=lambda ch: (-seen[ch], ch))
        self.symbol = {ch: i + 3 for i, ch in enumerate(letters)}
        self.table = np.full(0x110000, -1, np.int32)
        near, far, first = [], [], 1  # state 0: none
        start, bits, held = [], [], []
        for lang in self.langs:
            s = np.concatenate([self.symbols(t)[0] for t in samples[lang]])[:most] if samples[lang] else np.zeros(0, np.int32)
            held.append(s)
            table, others = Transitions.of(automaton(s), first)  # a language at a time, so that one automaton's dictionaries are held
            near.append(table)
            far.append(others)
            start.append(first)
            first += len(table)
            bits.append(np.log2(len(s) + 2))
        self.moves = Transitions(near, far, len(letters) + 3)
        del near, far
        self.start, self.bits = np.array(start, np.int32), np.array(bits)
        # What unrelated letters cost in each language: its own sample with the letters in random order.
        rng = np.random.default_rng(1)
        self.unrelated = np.full(len(self.langs), np.inf)
        for i, s in enumerate(held):
            if len(s):
                self.unrelated[i] = self._bits([rng.permutation(s)])[i, 0]

    def symbols(self, text: str) -> tuple[np.ndarray, int]:
        """Symbols of a text, and how many are letters."""
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.table[cp]
        if (s < 0).any():
            for c in np.unique(cp[s < 0]).tolist():
                ch = chr(c).lower()[:1]
                self.table[c] = self.symbol.get(ch, UNKNOWN) if ch.isalpha() else BLANK
            s = self.table[cp]
        keep = s != BLANK
        n = int(keep.sum())
        if len(keep):
            keep[1:] |= s[:-1] != BLANK
            keep[0] |= True
        return s[keep], n

    def _walk(self, lanes: np.ndarray, state: np.ndarray, states: np.ndarray, ends: np.ndarray, at: np.ndarray) -> None:
        """Parse lanes ``at`` (last axis of all arrays; the first is the place in a lane) from ``state`` (languages x lanes), until they pass through states that
        are there already: from there on an earlier walk stands. ``states``: after each symbol; ``ends``: phrases ended by it."""
        start = self.start[:, None]
        for t in range(len(lanes)):
            c = lanes[t, at]
            live = c != PAD
            if not live.all():
                at, state, c = at[live], state[:, live], c[live]
            if not len(at):
                break
            to = self.moves.step(state, c)
            stop = to == 0
            n = np.zeros(to.shape, np.int8)
            if stop.any():
                again = self.moves.step(np.broadcast_to(start, to.shape), c)
                lone = stop & (again == 0)  # a symbol no sample holds is a phrase of its own
                n = (stop & (state != start)).astype(np.int8) + lone * np.int8(17)
                to = np.where(stop, np.where(lone, start, again), to)
            new = states[t][:, at] != to
            states[t][:, at], ends[t][:, at] = to, n
            state = to
            more = new.any(0)
            if not more.all():
                at, state = at[more], state[:, more]

    def phrases(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(languages, texts) phrases of each symbol string, and how many of them are a letter that the sample lacks.

        Strings are cut in lanes that are walked side by side, each as if a phrase began there. Then the state in which the lane before
        really ends is carried on: from it a lane is walked again until it meets the states of the first walk, which takes
        a few symbols, and so on while any lane's end changes. So phrases are those of one walk over the whole string.
        """
        k, size = len(self.langs), np.array([len(s) for s in texts], np.int64)
        lens = -(-size // LANE)
        n = int(lens.sum())
        count, lacking = np.zeros((k, len(texts)), np.int64), np.zeros((k, len(texts)), np.int64)
        if not n or not k:
            return count, lacking
        lanes = np.zeros((n, LANE), np.int32)  # turned below
        first = np.concatenate([[0], np.cumsum(lens)[:-1]])
        for s, r in zip(texts, first.tolist()):
            lanes[r : r + -(-len(s) // LANE)].reshape(-1)[: len(s)] = s
        owner = np.repeat(np.arange(len(texts)), lens)
        filled = np.full(n, LANE)
        last = (first + lens - 1)[size > 0]
        filled[last] = (size - (lens - 1) * LANE)[size > 0]
        states, ends = np.zeros((LANE, k, n), np.int32), np.zeros((LANE, k, n), np.int8)
        lanes = np.ascontiguousarray(lanes.T)
        order = np.argsort(-filled, kind="stable")
        for part in np.array_split(order, max(1, n // 1024)):
            self._walk(lanes, np.repeat(self.start[:, None], len(part), 1), states, ends, part)
        inner = np.setdiff1d(np.arange(n), first[size > 0])  # lanes with one before them
        begun = np.repeat(self.start[:, None], n, 1)
        while len(inner):
            carried = states[LANE - 1][:, inner - 1]
            changed = (carried != begun[:, inner]).any(0)
            inner_now, carried = inner[changed], carried[:, changed]
            if not len(inner_now):
                break
            begun[:, inner_now] = carried
            self._walk(lanes, carried, states, ends, inner_now)
        for i in range(k):
            lacking[i] = np.bincount(owner, (ends[:, i] >> 4).sum(0, dtype=np.int64), len(texts))
            count[i] = np.bincount(owner, (ends[:, i] & 15).sum(0, dtype=np.int64), len(texts))
            tail = states[filled[last] - 1, i, last] != self.start[i]
            count[i, np.flatnonzero(size > 0)] += tail
        return count, lacking

    def _bits(self, strings: list[np.ndarray]) -> np.ndarray:
        """(languages, strings) bits a symbol."""
        count, lacking = self.phrases(strings)
        return (count * self.bits[:, None] + lacking * np.log2(len(self.symbol) + 1)) / np.maximum([len(s) for s in strings], 1)

    def bits_per_symbol(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(languages, texts) bits a symbol; letters and symbols of each text. Texts are parsed a few at a time, so little more than those is held."""
        out = np.zeros((len(self.langs), len(texts)))
        letters, size = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        part: list[np.ndarray] = []
        held, most = 0, max(1, BATCH_SYMBOLS // max(1, len(self.langs)))
        for i, t in enumerate(texts):
            s, letters[i] = self.symbols(t) if t else (np.zeros(0, np.int32), 0)
            size[i] = len(s)
            part.append(s)
            held += -(-len(s) // LANE) * LANE
            if held >= most or i + 1 == len(texts):
                out[:, i + 1 - len(part) : i + 1] = self._bits(part)
                part, held = [], 0
        return out, letters, size

    def predict(self, texts: list) -> pd.DataFrame:
        k = len(texts)
        if not self.langs:
            return pd.DataFrame({"lang_pred": [UNDETERMINED] * k, "score": 0.0, "bits": np.nan, "junk": False})
        b, letters, _ = self.bits_per_symbol(texts)
        best = b.argmin(0)
        low = b.min(0) if k else np.zeros(0)
        odds = np.exp2(np.clip((low - b) * 8, -60, 0)).sum(0)
        none = letters == 0
        names = np.array(self.langs, object)[best]
        junk = ~none & (letters >= JUNK_LETTERS) & (low >= JUNK_SHARE * self.unrelated[best])
        return pd.DataFrame({"lang_pred": np.where(none, UNDETERMINED, names), "score": np.where(none, 0.0, 1 / odds), "bits": np.where(none, np.nan, low), "junk": junk})


def predictor(labelled: DataFrame, **columns):
    """A column function text -> (lang_pred, score, bits, junk), fitted on the sample of ``labelled``."""
    spark = labelled.sparkSession
    rows = sample(labelled, **columns).toLocalIterator()  # bounded a language
    samples: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.n)):
        samples.setdefault(r.lang, []).append(r.text)
    kept = spark.sparkContext.broadcast(samples)
    built: list = []

    @F.pandas_udf(PREDICTED)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not built:
            built.append(Parser(kept.value))
        for texts in batches:
            yield built[0].predict([None if t is None else t for t in texts])

    return predict


def held_out(key: Column, mod: int = 3, part: int = 1) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(mod)) == part, F.lit(False))


def keep_identified(docs: DataFrame, labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows in some learned language; text without a letter is rejected, and text of ``JUNK_LETTERS`` letters or more in which the best language
    finds no more than in letters at random. A null ``lang`` becomes the predicted one. Columns stay, whatever their names."""
    (p,) = free_names(docs, "predicted")
    # marked as not deterministic, or the optimizer would evaluate it for the filter and for the columns apart
    known = docs.withColumn(p, predictor(labelled).asNondeterministic()(F.col(text))).filter((F.col(f"{p}.lang_pred") != UNDETERMINED) & ~F.col(f"{p}.junk"))
    return known.withColumn(lang, F.coalesce(F.col(lang), F.col(f"{p}.lang_pred"))).drop(p) if lang in docs.columns else known.drop(p)
