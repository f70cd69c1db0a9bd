"""Levenshtein automata of many terms at once, intersected with the trie of the terms, and run over whole vocabularies.

A position is a trie node and the edits spent (insert, delete, substitute, or swap of neighbours, one each). A term that ends in ``*`` is a stem: any ending may follow it. A state of the automaton is the set of
positions that a prefix of a word can be in; only states that some word reaches are built, and each transition once. Words are
stepped side by side, a character at a time, as arrays; a word whose state is empty is done.
"""

from __future__ import annotations

import numpy as np

DEAD, START = 0, 1
ENDING = "any"  # a position past a stem, which every character keeps


class Matcher:
    """``terms`` with the edits that each allows (stems: none). ``match`` names the nearest term of every word that is near enough, the first of equally near ones."""

    def __init__(self, terms: list[str], edits: list[int]):
        self.terms, self.edits = terms, edits
        self.child: list[dict[str, int]] = [{}]
        self.most, self.term, self.stem = [0], [-1], [-1]  # per node: edits any term below allows; the term and the stem that end here
        for i, (t, e) in enumerate(zip(terms, edits)):
            n, stem, t = 0, t.endswith("*"), t.removesuffix("*")
            self.most[0] = max(self.most[0], e)
            for ch in t:
                if ch not in self.child[n]:
                    self.child[n][ch] = len(self.child)
                    self.child.append({})
                    self.most.append(0)
                    self.term.append(-1)
                    self.stem.append(-1)
                n = self.child[n][ch]
                self.most[n] = max(self.most[n], e)
            (self.stem if stem else self.term)[n] = i
        letters = sorted({ch for t in terms for ch in t.removesuffix("*")})
        self.symbols = [None, *letters]  # 0: a character that no term has
        self.code = np.zeros(0x110000, np.int16)
        for i, ch in enumerate(letters):
            self.code[ord(ch)] = i + 1
        self.lengths = (min((len(t) - e for t, e in zip(terms, edits)), default=0), max((len(t) + e for t, e in zip(terms, edits)), default=0))
        self.table = np.full((2, len(self.symbols)), -1, np.int32)
        self.table[DEAD] = DEAD
        self.states = [frozenset(), self._closed({(0, "", 0): 0})]
        self.number = {s: i for i, s in enumerate(self.states)}
        self.accepts = [None, self._accept(self.states[START])]

    def _closed(self, at: dict) -> frozenset:
        """All positions after leaving out characters of terms. Positions: (node, character still to come, node after it) to edits."""
        todo = list(at.items())
        while todo:
            (n, wait, then), e = todo.pop()
            if wait or at[n, wait, then] < e:  # only positions at a node go on
                continue
            for m in self.child[n].values():
                if e < self.most[m] and at.get((m, "", 0), 99) > e + 1:
                    at[m, "", 0] = e + 1
                    todo.append(((m, "", 0), e + 1))
        return frozenset(at.items())

    def _accept(self, state: frozenset) -> tuple[int, int] | None:
        """(edits, term) of the nearest term a word may end in."""
        whole = [(e, self.term[n]) for (n, wait, _), e in state if not wait and self.term[n] >= 0 and e <= self.edits[self.term[n]]]
        return min(whole + [(e, self.stem[n]) for (n, wait, _), e in state if wait == ENDING], default=None)

    def _next(self, state: int, symbol: int) -> int:
        ch, at = self.symbols[symbol], {}

        def add(key: tuple, e: int) -> None:
            if e <= self.most[key[0]] and at.get(key, 99) > e:
                at[key] = e
            if not e and not key[1] and self.stem[key[0]] >= 0:
                at[key[0], ENDING, 0] = 0

        for (n, wait, then), e in self.states[state]:
            if wait == ENDING:
                at[n, wait, then] = e
                continue
            if wait:
                if wait == ch:
                    add((then, "", 0), e)
                continue
            add((n, "", 0), e + 1)
            for x, m in self.child[n].items():
                add((m, "", 0), e + (x != ch))
                if x != ch and ch is not None and ch in self.child[m]:
                    add((m, x, self.child[m][ch]), e + 1)
        s = self._closed(at) if at else frozenset()
        if s not in self.number:
            self.number[s] = len(self.states)
            self.states.append(s)
            self.accepts.append(self._accept(s))
        return self.number[s]

    def match(self, words: list[str]) -> dict[str, tuple[int, int]]:
        """word to (term, edits)."""
        low, high = self.lengths
        stems = any(t.endswith("*") for t in self.terms)
        words = [w for w in words if low <= len(w) and (stems or len(w) <= high) and "\0" not in w]
        if not words or not self.terms:
            return {}
        high += 1  # of longer words one character too many is read, so that only stems match
        chars = np.array(words, f"<U{high}").view(np.uint32).reshape(len(words), high)
        state, live = np.full(len(words), START, np.int32), np.arange(len(words))
        for t in range(high):
            live = live[(chars[live, t] != 0) & (state[live] != DEAD)]
            if not len(live):
                break
            at, c = state[live], self.code[chars[live, t]]
            new = self.table[at, c]
            missing = np.flatnonzero(new < 0)
            if len(missing):
                width = len(self.symbols)
                for pair in np.unique(at[missing].astype(np.int64) * width + c[missing]).tolist():
                    to = self._next(pair // width, pair % width)
                    if to >= len(self.table):
                        self.table = np.vstack([self.table, np.full((max(256, len(self.table)), width), -1, np.int32)])
                    self.table[pair // width, pair % width] = to
                new = self.table[at, c]
            state[live] = new
        out = {}
        for i in np.flatnonzero(state != DEAD).tolist():
            hit = self.accepts[state[i]]
            if hit:
                out[words[i]] = (hit[1], hit[0])
        return out
