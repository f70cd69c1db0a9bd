"""Toxicity by a learned lexicon, matched with misspellings, and judged in context.

Terms are words that labelled toxic texts hold far more often than clean ones (a likelihood ratio beyond what the number of words tried would yield by
chance), counted by distinct neighbours (the word before and after), so that copied passages count once; a stem that toxic texts hold with several endings is
a term too, unless what it adds to the terms below it is found in clean texts. ``levenshtein.Matcher`` finds each term and its misspellings among the words of a text. A match counts by its term's log odds, by how far such misspellings
were right in labelled text, and by its context: quotation marks, words of reporting or of address, and words that labelled text has around
harmless matches, give the odds that it abuses rather than quotes. A logistic model of the strongest match and of all together, fitted on labelled
texts, turns that into a score.

The fit reads a sample of about ``FIT_ROWS`` labelled rows a class, drawn by hash of the key (all where there are fewer); texts that repeat are taken once.
Scoring is a map over whole texts, read a stretch at a time; nothing is shuffled.

Results in the odd cases: null or empty text has no match and gets the score of such texts; without labels of both classes no term is learnt and
every score is the share of toxic ones (a half without labels); a key with several labels is toxic if one is; null labels and keys are
not learnt from; repeated rows are each scored; among terms that match a word the one with fewest edits counts, then the strongest, then the first in code point order; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from orrery.llm.columns import free_names
from orrery.llm.levenshtein import Matcher
from orrery.storage import discard, stored

FIT_ROWS = 20_000
MOST_TERMS, MOST_CANDIDATES, MOST_CUES, MOST_LETTERS = 2_000, 20_000, 1_000, 40
STEM_LETTERS, LEAST_ENDINGS = range(4, 9), 4
WINDOW, NEAR_CHARS = 6, 160
STRETCH = 1 << 20
PREDICT_AT = 0.7
WORD = re.compile(r"""[^\W_](?:[^\s.,;:!?"“”„«»()\[\]{}<>|/\\]*[^\W_])?""")
OPENED = re.compile(r"""(?:^|[\s(\[>:])["“„«‘'][^"“”„«»]*$""")
CLOSED = re.compile(r"""^[^"“”„«»]*?["”“»’'](?!\w)""")
REPORTING = frozenset("said says say saying called calls calling quote quotes quoted wrote writes word words term terms phrase means meaning comment insult insults dit disait mot sagte sagt schrieb wort dijo dice palabra".split())
ADDRESS = frozenset("you your yours you're u ur du dich dir dein ihr euch tu te toi ton vous votre usted tú ti".split())
PRIOR = {"<quoted>": 3.0, "<reported>": 1.5, "<addressed>": -1.0}  # log odds of quotation
PLAIN = 2.0  # log odds of abuse of a match without any cue
TRUST = 10.0  # matches by which a prior is outweighed half
FUZZY_RIGHT, FUZZY_TRUST, FUZZY_NONE = 0.9, 4.0, 0.6  # share of misspellings taken as right before any is seen, its weight, and the share that counts nothing
KNOWN = 1_000_000  # words remembered as matching nothing


def allowed(term: str) -> int:
    """Edits by which a term may be misspelt; none in a stem."""
    return 0 if term.endswith("*") else 0 if len(term) < 4 else 1 if len(term) < 9 else 2


def stems(word: str) -> list[str]:
    return [word[:k] + "*" for k in STEM_LETTERS if len(word) > k]


def stretches(text: str) -> Iterator[tuple[int, str]]:
    """Parts of a text, cut at white space."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        if end < len(text):
            m = re.compile(r"\s").search(text, end)
            end = m.start() if m else len(text)
        yield at, text[at:end]
        at = end


def cues(text: str, start: int, end: int) -> list[str]:
    """Words around a match, and marks of quotation, reporting and address."""
    left, right = text[max(0, start - NEAR_CHARS) : start], text[end : end + NEAR_CHARS]
    before, after = WORD.findall(left), WORD.findall(right)
    if start > NEAR_CHARS and before:
        before = before[1:]
    near = before[-WINDOW:] + after[:WINDOW]
    out = sorted(set(near))
    if OPENED.search(left) and CLOSED.search(right):
        out.append("<quoted>")
    if not REPORTING.isdisjoint(near):
        out.append("<reported>")
    if not ADDRESS.isdisjoint(near):
        out.append("<addressed>")
    return out


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)
    right: dict[tuple[int, int], float] = field(default_factory=dict)  # (term, edits) to what such a match counts of an exact one
    cue: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    coef: tuple[float, float, float] = (0.0, 0.0, 0.0)  # constant, strongest match, all matches

    def strength(self, term: int, edits: int, around: list[str]) -> float:
        odds = PLAIN - sum(self.cue.get(c, 0.0) for c in around)
        return self.weight[term] * (1.0 if not edits else self.right[term, edits]) / (1 + math.exp(-max(-30.0, min(30.0, odds))))


class Reader:
    """Matches of a model's terms in texts; words seen to match nothing are remembered, up to ``KNOWN``."""

    def __init__(self, model: Model):
        self.model, self.matcher = model, Matcher(model.terms, [allowed(t) for t in model.terms])
        self.hit: dict[str, tuple[int, int]] = {}
        self.miss: set[str] = set()

    def matches(self, text: str | None) -> Iterator[tuple[int, int, list[str]]]:
        """(term, edits, cues around) of every match."""
        if not text or not self.model.terms:
            return
        text = text.lower()
        for at, part in stretches(text):
            words = set(WORD.findall(part))
            new = [w for w in words - self.miss if w not in self.hit]
            found = self.matcher.match(new)
            self.hit |= found
            if len(self.miss) > KNOWN:
                self.miss.clear()
            self.miss.update(w for w in new if w not in found)
            if not self.hit.keys().isdisjoint(words):
                for m in WORD.finditer(part):
                    if m.group() in self.hit:
                        yield *self.hit[m.group()], cues(text, at + m.start(), at + m.end())

    def features(self, text: str | None) -> tuple[float, float]:
        s = [self.model.strength(*m) for m in self.matches(text)]
        return (max(s), math.log1p(sum(s))) if s else (0.0, 0.0)

    def score(self, text: str | None) -> float:
        a, b, c = self.model.coef
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, int]]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist())


def _batch(schema: list[tuple], columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, schema)], [n for n, _ in schema])


def g2(t: float, n: float, share: float) -> float:
    """Twice the log likelihood ratio of t toxic among t + n, against ``share``."""
    return 2 * sum(x * math.log(x / (p * (t + n))) for x, p in ((t, share), (n, 1 - share)) if x)


def _g2(t: Column, n: Column, share: float) -> Column:
    part = lambda x, p: F.when(x > 0, x * F.log(x / (p * (t + n)))).otherwise(0.0)
    return 2 * (part(t, share) + part(n, 1 - share))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, learn: Column | None, most: int) -> DataFrame:
    """``text, y`` of distinct labelled texts, about ``most`` rows a class by hash of the key."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
    known = known if learn is None else known.filter(learn)
    y = stored(known.groupBy(F.col(key).alias("k")).agg(F.max((F.col(label) == 1).cast("int")).alias("y")), "labels")
    n = {r.y: r["count"] for r in y.groupBy("y").count().collect()}
    share = F.when(F.col("y") == 1, most / max(most, n.get(1, 0))).otherwise(most / max(most, n.get(0, 0)))
    drawn = y.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < share * (1 << 20))  # about 2 x most rows
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(drawn), "k").select("text", "y").dropDuplicates()
    out = stored(rows, "labelled")
    discard(y)
    return out


def word_counts(sample: DataFrame) -> DataFrame:
    """``word, t, n``: toxic and clean texts that hold it, a word or a stem."""
    schema = [("word", pa.string()), ("t", pa.int64()), ("n", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = Counter(), Counter()
        for text, y in _texts(batches):
            words: set[str] = set()
            for _, part in stretches((text or "").lower()):
                words |= {w for w in WORD.findall(part) if len(w) <= MOST_LETTERS}
            held[y].update(words.union(*map(stems, words)))
            if len(held[0]) + len(held[1]) > 500_000:
                yield _batch(schema, zip(*((w, held[1][w], held[0][w]) for w in held[0].keys() | held[1].keys())))
                held = Counter(), Counter()
        if held[0] or held[1]:
            yield _batch(schema, zip(*((w, held[1][w], held[0][w]) for w in held[0].keys() | held[1].keys())))

    return sample.mapInArrow(run, "word string, t long, n long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))


def neighbours(sample: DataFrame, words: list[str]) -> DataFrame:
    """``word, t, n``: distinct pairs of words around it in toxic and in clean texts."""
    wanted = frozenset(words)
    schema = [("word", pa.string()), ("around", pa.string()), ("y", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, y in _texts(batches):
            for _, part in stretches((text or "").lower()):
                w = ["", *WORD.findall(part), ""]
                seen = {(x, f"{w[i - 1][:MOST_LETTERS]} {w[i + 1][:MOST_LETTERS]}") for i in range(1, len(w) - 1) for x in (w[i], *stems(w[i])) if x in wanted}
                if seen:
                    yield _batch(schema, [*zip(*seen), [y] * len(seen)])

    rows = sample.mapInArrow(run, "word string, around string, y int").distinct()
    return rows.groupBy("word").agg(F.sum(F.col("y").cast("long")).alias("t"), F.sum(1 - F.col("y").cast("long")).alias("n"))


def learn_terms(sample: DataFrame) -> tuple[list[str], list[float]]:
    """Terms and their log odds, the strongest first."""
    counts = stored(word_counts(sample), "words")
    is_stem = F.col("word").endswith("*")
    all_ = counts.agg(*[F.sum(F.when(~is_stem, F.col(c))).alias(c) for c in "tn"], F.sum((F.col("t") + F.col("n") > 1).cast("long")).alias("tried")).first()
    if not all_.t or not all_.n:
        discard(counts)
        return [], []
    share, least = all_.t / (all_.t + all_.n), 2 * math.log(max(all_.tried, 2))
    likely = counts.filter((F.col("t") > share * (F.col("t") + F.col("n"))) & (F.col("t") > 1)).withColumn("g", _g2(F.col("t"), F.col("n"), share)).filter(F.col("g") > least)
    words = [r.word for r in likely.orderBy(F.desc("g"), "word").limit(MOST_CANDIDATES).select("word").collect()]
    roots = [(w,) for w in words if w.endswith("*")]
    if roots:
        of = F.explode(F.array_compact(F.array(*[F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in STEM_LETTERS])))
        endings = counts.filter(~is_stem & (F.col("t") > 0)).select(of.alias("stem")).join(F.broadcast(sample.sparkSession.createDataFrame(roots, "stem string")), "stem")
        many = {r.stem for r in endings.groupBy("stem").count().filter(F.col("count") >= LEAST_ENDINGS).collect()}  # a row a candidate at most
        words = [w for w in words if not w.endswith("*") or w in many]
    discard(counts)
    ranked = []
    within: dict = {}  # stem to the counts of terms chosen below it
    log_odds = lambda t, n: math.log((t + 0.5) / all_.t) - math.log((n + 0.5) / all_.n)
    for r in neighbours(sample, words).orderBy(F.desc(F.length("word")), "word").collect() if words else ():  # a row a candidate, the longest first
        g, odds = g2(r.t, r.n, share), log_odds(r.t, r.n)
        t, n = within.get(r.word, (0, 0))
        if r.t > share * (r.t + r.n) and g > least and odds > 1 and (r.t, r.n) != (t, n) and not (r.n > n and log_odds(max(0, r.t - t), r.n - n) < 1):
            ranked.append((-g, r.word, odds))
            for s in stems(r.word.removesuffix("*")):
                a, b = within.get(s, (0, 0))
                within[s] = (a + r.t - t, b + r.n - n)
    best = sorted((-odds, w) for _, w, odds in sorted(ranked)[:MOST_TERMS])
    return [w for _, w in best], [-o for o, _ in best]


def learn_context(sample: DataFrame, model: Model) -> None:
    """How far misspellings are right, and what surrounds harmless matches; sets ``right`` and ``cue``."""
    schema = [("y", pa.int32()), ("term", pa.int32()), ("edits", pa.int32()), ("cues", pa.list_(pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for text, y in _texts(batches):
            found = list(reader.matches(text))
            if found:
                yield _batch(schema, [[y] * len(found), *zip(*found)])

    rows = stored(sample.mapInArrow(run, "y int, term int, edits int, cues array<string>"), "matches")
    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    scale = sizes.get(1, 0) / max(1, sizes.get(0, 0))  # clean matches as in so many texts as are toxic
    tally: dict = {}
    for r in rows.groupBy("term", "edits", "y").count().collect():  # at most six rows a term
        tally.setdefault((r.term, r.edits), [0.0, 0.0])[r.y] = r["count"] * (1.0 if r.y else scale)
    for i, w in enumerate(model.terms):
        for e in range(1, allowed(w) + 1):
            n, t = tally.get((i, e), (0.0, 0.0))
            share = (t + FUZZY_TRUST * FUZZY_RIGHT) / (t + n + FUZZY_TRUST)
            model.right[i, e] = max(0.0, (share - FUZZY_NONE) / (1 - FUZZY_NONE))
    # What surrounds harmless matches, term by term: counts against those that each term's own share of harmless matches would give.
    toxic = {i: t * scale / (t * scale + n) for (i, e), (n, t) in tally.items() if not e and n and t}
    if toxic:
        shares = sample.sparkSession.createDataFrame(list(toxic.items()), "term int, share double")  # a row a term
        c = rows.filter("edits = 0").join(F.broadcast(shares), "term").select("y", "share", F.explode("cues").alias("c"))
        c = c.groupBy("c").agg(F.sum(F.col("y").cast("double")).alias("t"), F.sum(1.0 - F.col("y")).alias("n"), F.sum("share").alias("et")).withColumn("en", F.col("t") + F.col("n") - F.col("et"))
        part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
        c = c.withColumn("g", 2 * (part(F.col("t"), F.col("et")) + part(F.col("n"), F.col("en"))))
        c = stored(c.withColumn("odds", F.log((F.col("n") + 0.5) / (F.col("en") + 0.5)) - F.log((F.col("t") + 0.5) / (F.col("et") + 0.5))), "cues")
        least = 2 * math.log(max(2, c.filter("t + n > 1").count()))
        for r in c.filter((F.col("g") > least) | F.col("c").isin(*PRIOR)).orderBy(~F.col("c").isin(*PRIOR), F.desc("g"), "c").limit(MOST_CUES).collect():
            n = min(r.n, r.en) + min(r.t, r.et)
            model.cue[r.c] = (PRIOR.get(r.c, 0.0) * TRUST + r.odds * n) / (TRUST + n)
        discard(c)
    discard(rows)


def fit_logistic(rows: DataFrame, rounds: int = 25) -> tuple[float, float, float]:
    """Coefficients of ``y`` by ``x1, x2`` (neither below 0) in ``w`` texts a row, by Newton steps over sums that Spark adds up; a weak ridge keeps separable data finite."""
    used = [True, True]
    while True:
        b = np.zeros(3)
        for _ in range(rounds):
            z = F.lit(float(b[0])) + float(b[1]) * F.col("x1") + float(b[2]) * F.col("x2")
            p, x = 1 / (1 + F.exp(-z)), [F.lit(1.0), F.col("x1"), F.col("x2")]
            grad = [F.sum(F.col("w") * (F.col("y") - p) * x[i]).alias(f"g{i}") for i in range(3)]
            hess = [F.sum(F.col("w") * p * (1 - p) * x[i] * x[j]).alias(f"h{i}{j}") for i in range(3) for j in range(i, 3)]
            s = rows.agg(*grad, *hess).first()
            if s.g0 is None:
                return 0.0, 0.0, 0.0
            keep = [0, *[i + 1 for i in range(2) if used[i]]]
            ridge = np.diag([0.5, 1.0, 1.0])
            g = np.array([s[f"g{i}"] for i in range(3)]) - ridge @ b
            h = np.array([[s[f"h{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)]) + ridge
            step = np.zeros(3)
            step[keep] = np.linalg.solve(h[np.ix_(keep, keep)], g[keep])
            b = b + np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-6:
                break
        bad = [i for i in range(2) if used[i] and b[i + 1] < 0]
        if not bad:
            return tuple(float(v) for v in b)
        used[bad[0]] = False


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", learn: Column | None = None, most: int = FIT_ROWS) -> Model:
    """A model of the labelled texts; ``learn``: which rows of ``labels`` may be learnt from."""
    sample = labelled_sample(docs, labels, key, text, label, learn, most)
    model = Model(*learn_terms(sample))
    if model.terms:
        learn_context(sample, model)
    schema = [("y", pa.int32()), ("x1", pa.float64()), ("x2", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for b in batches:
            x = [reader.features(t) for t in b.column(0).to_pylist()]
            if x:
                yield _batch(schema, [b.column(1).to_pylist(), *zip(*x)])

    rows = stored(sample.mapInArrow(run, "y int, x1 double, x2 double").groupBy("y", "x1", "x2").agg(F.count("*").alias("w")), "features")
    model.coef = fit_logistic(rows)
    discard(rows, sample)
    return model


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Rows with a score from 0 to 1."""
    readers: list[Reader] = []

    @F.udf("double", useArrow=True)  # marked below as not deterministic, or it may be evaluated for each use of the column
    def one(t):
        if not readers:
            readers.append(Reader(model))
        return readers[0].score(t)

    (score,) = free_names(docs, name)
    return docs.withColumn(score, one.asNondeterministic()(F.col(text)))
