"""SimHash near-duplicates: links between fingerprints of at most ``DISTANCE`` differing bits, and their components.

Fingerprints map to the counts of set bits in 32 segments of two bits. The Manhattan distance of two such count vectors is a
lower bound of the Hamming distance, so links are a range join of radius 4 on a grid over the vectors: the 32 coordinates are
cut in 8 bands of four; two vectors within 4 differ in at most four bands, so they agree in some four, and each vector is
put in the 70 cells named by four of its bands. Pairs that meet in a cell pass the Manhattan bound, then the exact distance.

Only distinct fingerprints enter the grid. A cell does not list its pairs: a search that takes every found neighbour out
of the rest leaves a spanning forest of the cell's links, so a cell of near copies costs about its size. Cells of over
``BLOCK`` fingerprints are divided again by halves of the bands that need not agree; only what is still crowded then is dealt in blocks, and
pairs of blocks are searched as separate rows. Connectivity is exact in each case.

Tables that grow with the input are joined by merging sorted shuffles, never by broadcast: files and shuffles tell Spark too low a size.

Results in the odd cases: null or wordless text has fingerprint 0 and links like any other; fewer than four words are one
shingle; repeated rows share a component; a null id never is a component's name unless all its ids are null; an empty
table gives no rows; other columns are not read (``keep_one`` passes them through).
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from orrery.llm.components import components
from orrery.storage import stored

DISTANCE = 4
SHINGLE = 4
BANDS, SAME = 8, 4
BLOCK = 4096
SPREAD = 20_000  # fingerprints of a task that puts them in cells
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
_LINKS = T.ArrayType(T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.LongType(), False)]), False)


def fingerprint_of(text: str | None, size: int = SHINGLE) -> int:
    """64 bits; bit i is set if it is set in over half the shingles' hashes."""
    if not text:
        return 0
    raw = text if text.isascii() and text.islower() else (text.lower() if text.isascii() else text.translate(_UPPER))
    w = _WORD.findall(raw)
    if not w:
        return 0
    hash_ = xxhash.xxh64_intdigest
    grams = zip(*[w[i:] for i in range(size)]) if len(w) >= size else [w]
    h = np.array([hash_(" ".join(g).encode("utf-8", "surrogatepass"), 42) for g in grams], np.uint64)
    votes = np.zeros(64, np.int64)
    for a in range(0, len(h), 4096):
        votes += np.unpackbits(h[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(h), bitorder="little")
    return int(bits.view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fingerprint(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(t) for t in text], dtype="int64")


def segment_counts(fp: Column) -> Column:
    """Set bits of each two-bit segment, in place: 32 fields of 0..2."""
    odd = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(fps: DataFrame) -> DataFrame:
    """``fp`` to its grid cells: which bands (combo), and their counts (cell)."""
    masks = [_signed(sum(0xFF << (8 * b) for b in bands)) for bands in combinations(range(BANDS), SAME)]
    c = fps.select("fp", segment_counts(F.col("fp")).alias("_c"))
    return c.select("fp", F.posexplode(F.array(*[F.col("_c").bitwiseAND(F.lit(m)) for m in masks])).alias("combo", "cell"))


def forest(fps: np.ndarray, most: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that connect what distances up to ``most`` connect: breadth first, found fingerprints leave the rest."""
    rest = np.unique(fps).view(np.uint64)
    counts = _count_matrix(rest)
    out: list[tuple[int, int]] = []
    while len(rest):
        queue = [(rest[0], counts[0])]
        rest, counts = rest[1:], counts[1:]
        root = queue[0][0]
        while queue and len(rest):
            x, cx = queue.pop()
            near = np.abs(counts - cx).sum(1, dtype=np.int16) <= most  # the lower bound
            at = np.flatnonzero(near)
            at = at[np.bitwise_count(rest[at] ^ x) <= most]
            if len(at):
                queue += list(zip(rest[at], counts[at]))
                out += [(int(root.view(np.int64)), int(y)) for y in rest[at].view(np.int64)]
                stay = np.ones(len(rest), bool)
                stay[at] = False
                rest, counts = rest[stay], counts[stay]
    return out


def _count_matrix(x: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1)
    return (bits[:, 0::2] + bits[:, 1::2]).astype(np.int8)


@F.pandas_udf(_LINKS)
def _forest(groups: pd.Series) -> pd.Series:
    return pd.Series([[{"a": a, "b": b} for a, b in forest(np.asarray(g, np.int64))] for g in groups])


def _refined(members: DataFrame) -> DataFrame:
    """Members (combo, cell, fp) of crowded cells to smaller ones. In a cell four bands agree and the others differ by ``DISTANCE`` at most, so
    of the eight halves of those others some four agree too: 70 cells again, named by the halves as well."""
    table = []
    for combo, bands in enumerate(combinations(range(BANDS), SAME)):
        halves = [8 * b + 4 * h for b in range(BANDS) if b not in bands for h in (0, 1)]
        table += [(combo, sub, _signed(sum(0xF << at for at in four))) for sub, four in enumerate(combinations(halves, SAME))]
    masks = members.sparkSession.createDataFrame(table, "combo int, sub int, mask long")  # 70 x 70 rows, always
    return members.join(F.broadcast(masks), "combo").select("combo", "cell", "sub", segment_counts(F.col("fp")).bitwiseAND(F.col("mask")).alias("half"), "fp")


def _parts(grid: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cells with up to ``BLOCK`` members as lists, and the members of the others."""
    sizes = grid.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select(*by, F.ceil(F.col("n") * 2 / BLOCK).cast("long").alias("blocks"))
    dealt = grid.join(sizes.hint("merge"), by, "left")  # the grid is 70 rows a fingerprint, of which Spark's estimate knows nothing
    few = dealt.filter("blocks is null").groupBy(*by).agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")
    return few, dealt.filter("blocks is not null")


def links(fps: DataFrame) -> DataFrame:
    """Distinct ``fp`` to links (a, b) whose components are those of all pairs within the distance."""
    few, crowded = _parts(cells(fps), ["combo", "cell"])
    crowded = stored(crowded.select("combo", "cell", "fp"), "crowded")
    found = few
    if not crowded.isEmpty():
        by = ["combo", "cell", "sub", "half"]
        small, rest = _parts(_refined(crowded), by)
        # What is left agrees in 24 of 32 segments' counts; pairs of blocks of such a cell are searched as rows of their own.
        held = rest.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks"))).groupBy(*by, "block").agg(F.collect_list("fp").alias("fps"))
        a, b = held, held.select(*by, F.col("block").alias("_block"), F.col("fps").alias("_fps"))
        across = a.join(b.hint("merge"), by).filter("block < _block").select(F.concat("fps", "_fps").alias("fps"))
        found = found.unionByName(small).unionByName(held.filter(F.size("fps") > 1).select("fps")).unionByName(across)
    return found.select(F.explode(_forest("fps")).alias("l")).select("l.a", "l.b").distinct()


def with_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, fp (long), component_id (smallest key reachable)."""
    marked = stored(docs.select(F.col(key).alias("id"), fingerprint(F.col(text)).alias("fp")), "fingerprints")
    named = class_names(marked)
    return marked.join(named.select("fp", "component_id").hint("merge"), "fp").select(F.col("id").alias(key), "fp", "component_id")


def class_names(marked: DataFrame) -> DataFrame:
    """``id, fp`` rows to ``fp, id, root, component_id`` for every distinct fingerprint, stored. id: its smallest; root: the fingerprint that
    holds the component's smallest id.

    Nodes are (no id, smallest id, fingerprint), so the smallest node that a component reaches names it, and no join by
    component is needed. The grid's input is spread by a count that follows its rows, not by its few bytes.
    """
    fps = stored(marked.groupBy("fp").agg(F.min("id").alias("id")), "distinct")
    n = max(fps.sparkSession.sparkContext.defaultParallelism, -(-fps.count() // SPREAD))
    near = links(fps.select("fp").repartition(n, "fp"))
    node = lambda side: fps.select(F.col("fp").alias(side), F.struct(F.col("id").isNull().alias("none"), "id", "fp").alias(f"n{side}"))
    roots = components(near.join(node("a").hint("merge"), "a").join(node("b").hint("merge"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b")))
    roots = roots.select(F.col("node.fp").alias("fp"), F.col("root.fp").alias("root"), F.col("root.id").alias("component_id"))
    named = fps.join(roots.hint("merge"), "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return stored(named, "names")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component (smallest key, then smallest fingerprint, then smallest text); its columns stay."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = stored(docs.select(F.struct(*columns).alias("row"), F.col(key).alias("id"), fingerprint(F.col(text)).alias("fp")), "fingerprints")
    named = class_names(marked.select("id", "fp"))
    first = named.filter(F.col("fp") == F.col("root")).select(F.col("fp").alias("_fp"), F.col("id").alias("_id"))
    rows = marked.join(first.hint("merge"), (F.col("fp") == F.col("_fp")) & F.col("id").eqNullSafe(F.col("_id")))
    n = F.row_number().over(Window.partitionBy("fp").orderBy(F.col(f"row.`{text}`"), F.to_json("row")))
    return rows.withColumn("n", n).filter("n = 1").select("row.*")
