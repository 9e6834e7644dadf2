"""Join of documents by the Jaccard similarity of their word shingles, as a blocked sparse matrix product.

Rows of the incidence matrix are the distinct shingle sets, its columns the shingles. Entries of the product of the matrix
with its transpose are the overlaps of two sets, and sets link when their overlap is at least the least one that their sizes
allow. The product is blocked in both directions:

* Columns lie in blocks by their hash. Two linked sets of s and t shingles differ in at most ``(1 - J) / (1 + J) (s + t)``
  columns, so of one block more than that some block is the same in both. Pairs without an equal block are below the bound
  and are never formed. How many blocks there are follows from the size, in classes of sizes; a set at the lower end of its
  class is blocked as the class below it, too.
* Rows lie in blocks: the sets that share a column block with the same least set, directly or by one step. In a block of rows
  overlaps are accumulated over dense tiles of columns; a pair goes as soon as its overlap and what is left of the smaller
  set cannot reach the bound. A block emits a spanning forest of its links, not all pairs.
* Blocks beyond ``ROWS`` sets or ``SHINGLES`` shingles are split, each part with the least set beside it. The sets of a split
  block that are not yet connected to its largest component meet all its parts, two parts a task, so nothing is left out.

A set is known by a 64-bit hash, as is a shingle: among N distinct sets two different ones are taken for the same with a
probability below N * N / 2 ** 65.

Words are lower-cased in A-Z; shorter texts than a shingle are one shingle as a whole. Null texts and texts without words
have the empty set, linked with nothing, so their component is their own key. Equal texts are one row of the matrix. Keys
that repeat keep a row each. Components take the least key, null only where all keys are. Whole texts count, however long.
An empty table gives an empty result; other columns are ignored.
"""

from bisect import bisect_right
from functools import lru_cache
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sieveline.llm.common import stored
from sieveline.llm.components import components

#: words of a shingle and the similarity asked for, in hundredths
SHINGLE, PERCENT = 3, 90
#: sets and shingles of a part of a block, columns of a tile
ROWS, SHINGLES, COLUMNS = 256, 1_000_000, 4096
#: from one class of sizes to the next
GROWTH = 1.25
#: words whose hash a task remembers, and the longest of them
REMEMBERED, LONGEST = 200_000, 64
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _mixed(x):
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Words to 64-bit hashes, remembered within bounds."""

    def __missing__(self, word):
        from xxhash import xxh64_intdigest
        value = xxh64_intdigest(word, 7)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


def shingle_set(text, known: Words, size: int = SHINGLE):
    """The distinct shingle hashes of a text, ascending."""
    words = (text if isinstance(text, str) else "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    count = len(words) - size + 1
    joined = np.full(count, size, np.uint64)
    for n in range(size):
        joined = _mixed(joined * np.uint64(_FACTORS[0]) + hashes[n:n + count])
    return np.unique(joined)


def set_id(shingles) -> int:
    """A set's hash as a signed number of 64 bits; 0 for the empty set."""
    from xxhash import xxh64_intdigest
    h = xxh64_intdigest(shingles.tobytes(), 11) if len(shingles) else 0
    return h - (1 << 64) if h >> 63 else h


def needed(s, t, percent: int = PERCENT):
    """The least overlap at which sets of s and t shingles link: percent * union <= 100 * overlap."""
    return -(-percent * (s + t) // (100 + percent))


def differences(largest: int, percent: int) -> int:
    """In how many shingles linked sets can differ at most, the smaller with up to ``largest``."""
    return (largest + 100 * largest // percent) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=None)
def classes(percent: int, most: int):
    """Least sizes of the classes up to ``most``, the blocks of columns of each, and how many may be empty."""
    first = 1
    while differences(first, percent) == 0:  # smaller sets link with equal ones alone
        first += 1
    starts = [first]
    while starts[-1] <= most:
        starts.append(max(starts[-1] + 1, -(-100 * starts[-1] // percent), int(starts[-1] * GROWTH)))
    counts, spare = [], []
    for end in starts[1:]:
        d = differences(end - 1, percent)
        spare.append(1 + d // 50)
        counts.append(d + 1 + spare[-1])
    return starts, counts, spare


def column_blocks(shingles, percent: int = PERCENT):
    """Hashes of a set's column blocks: sets that can link have at least one in common."""
    n = len(shingles)
    starts, counts, spare = classes(percent, 1 << max(1, n).bit_length())
    own = bisect_right(starts, n) - 1
    out = []
    if own < 0:
        return np.zeros(0, np.int64)
    for c in (own, own - 1):
        if c < 0 or c < own and -(-percent * n // 100) >= starts[own]:
            continue
        block = ((shingles >> np.uint64(32)) * np.uint64(counts[c])) >> np.uint64(32)
        begins = np.flatnonzero(np.diff(block, prepend=np.uint64(1 << 63)))
        sums = np.add.reduceat(_mixed(shingles + np.uint64(_FACTORS[1])), begins)
        name = block[begins] + np.uint64((c + 1) << 32)
        out.append(_mixed(sums * np.uint64(_FACTORS[2]) + _mixed(name * np.uint64(_FACTORS[3]))))
        if counts[c] - len(begins) > spare[c]:
            # with so many empty blocks all that agree may be empty ones, so these count as well
            empty = np.setdiff1d(np.arange(counts[c], dtype=np.uint64), block[begins]) + np.uint64((c + 1) << 32)
            out.append(_mixed(_mixed(empty * np.uint64(_FACTORS[3])) + np.uint64(_FACTORS[4])))
    return np.concatenate(out).view(np.int64)


def overlapping(sets, sides=None, percent: int = PERCENT, columns: int = COLUMNS):
    """The matrix of links among sets; if sides are given, only those of a set on side 1."""
    b = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    need = needed(sizes[:, None], sizes[None, :], percent)
    alive = percent * np.maximum.outer(sizes, sizes) <= 100 * np.minimum.outer(sizes, sizes)
    if sides is not None:
        alive &= (sides[:, None] | sides[None, :]) > 0
    np.fill_diagonal(alive, False)
    alive &= (sizes > 0)[:, None]
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    row = np.repeat(np.arange(b), sizes)[order]
    every = every[order]
    column = np.cumsum(np.append(True, every[1:] != every[:-1])[:len(every)]) - 1
    members = np.bincount(column, minlength=1)
    # columns of all rows add the same to all pairs, columns of one row nothing
    overlap = np.full((b, b), np.count_nonzero(members == b), np.float32)
    some = (members > 1) & (members < b)
    row, column = row[some[column]], (np.cumsum(some) - 1)[column[some[column]]]
    left = np.bincount(row, minlength=b)
    for first in range(0, int(some.sum()), columns):
        alive &= overlap + np.minimum.outer(left, left) >= need
        live = np.flatnonzero(alive.any(axis=1))
        if not len(live):
            break
        a, z = np.searchsorted(column, (first, first + columns))
        place = np.full(b, -1)
        place[live] = np.arange(len(live))
        tile = np.zeros((len(live), columns), np.float32)
        inside = place[row[a:z]] >= 0
        tile[place[row[a:z][inside]], column[a:z][inside] - first] = 1
        overlap[np.ix_(live, live)] += tile @ tile.T
        left = left - np.bincount(row[a:z], minlength=b)
    return alive & (overlap >= need)


def forest(linked):
    """A spanning forest of a matrix of links."""
    left = np.ones(len(linked), bool)
    out = []
    for begin in range(len(linked)):
        if not left[begin]:
            continue
        left[begin], waiting = False, [begin]
        while waiting:
            x = waiting.pop()
            near = np.flatnonzero(linked[x] & left)
            left[near] = False
            out += [(x, y) for y in near.tolist()]
            waiting += near.tolist()
    return out


def _described(size, percent):
    def describe(batches):
        known = Words()
        for texts in batches:
            rows = []
            for text in texts:
                shingles = shingle_set(text, known, size)
                rows.append((len(shingles), set_id(shingles), column_blocks(shingles, percent)))
            yield pd.DataFrame(rows, columns=["n", "node", "blocks"])

    describe.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(describe, "n long, node long, blocks array<long>")


def _product(size, percent):
    """Links within sorted blocks of rows; a block may run over several batches."""
    def product(batches):
        known, key, sets, sides = Words(), None, {}, {}

        def links():
            nodes = list(sets)
            if len(nodes) < 2:
                return []
            side = np.array([sides[x] for x in nodes])
            linked = overlapping([sets[x] for x in nodes], side if side.any() else None, percent)
            return [(nodes[x], nodes[y]) for x, y in forest(linked)]

        def framed(found):
            return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

        for batch in batches:
            found = []
            for g, i, j, side, node, text in zip(*(batch[c] for c in ("g", "i", "j", "side", "node", "t"))):
                if key != (g, i, j):
                    found += links()
                    key, sets, sides = (g, i, j), {}, {}
                if node not in sets:
                    sets[node] = shingle_set(text, known, size)
                sides[node] = max(side, sides.get(node, 0))
            yield framed(found)
        yield framed(links())
    return product


def _links(blocks: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The links within blocks of rows (g, i, j, side, node)."""
    return texts.join(blocks, "node").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").select(
        "g", "i", "j", "side", "node", "t").mapInPandas(_product(size, percent), "u long, v long")


def links(docs: DataFrame, sets: DataFrame, nodes: DataFrame, size: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS,
          shingles: int = SHINGLES) -> DataFrame:
    """Links (u, v) that connect all linked sets, directly or in steps.

    ``docs`` holds row and t, ``sets`` node and blocks of every document, ``nodes`` node, n and row of every set.
    """
    keyed = sets.select(F.explode("blocks").alias("block"), "node")
    crowded = keyed.groupBy("block").agg(F.min("node").alias("m"), F.max("node").alias("x")).filter("m < x").drop("x")
    shared = stored(keyed.join(crowded.hint("merge"), "block").groupBy("m", "node").agg(F.lit(1).alias("one")).drop("one"), "jaccard-shared")
    # a least set that shares a block with a smaller one hands its sets over to that
    above = shared.groupBy(F.col("node").alias("m")).agg(F.min("m").alias("g"))
    members = stored(shared.join(above, "m").select("g", "node").distinct().join(nodes, "node").select(
        "g", "node", "n", "row"), "jaccard-members")
    # the texts move once, and only those of sets in blocks move again; what grows with the documents is never broadcast
    needed = members.select("row", "node").distinct().hint("merge")
    texts = stored(docs.join(needed, "row").groupBy("node").agg(F.first("t").alias("t")),
                   "jaccard-texts")
    parts = stored(members.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum("n") / shingles)).cast("int")
                                            .alias("parts")), "jaccard-parts")
    dealt = members.join(parts, "g").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    first = dealt.withColumn("i", F.explode(F.when(F.col("node") == F.col("g"), every).otherwise(F.array("own")))).select(
        "g", "i", F.col("i").alias("j"), F.lit(0).alias("side"), "node")
    found = stored(_links(first, texts, size, percent), "jaccard-links")

    split = stored(dealt.filter("parts > 1"), "jaccard-split")
    if split.isEmpty():
        return found
    roots = components(found)
    rooted = split.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counts = stored(rooted.groupBy("g", "root").count(), "jaccard-roots")
    largest = counts.groupBy("g").agg(F.max(F.struct("count", "root")).alias("most")).select(
        "g", F.col("most.root").alias("largest"))
    apart = stored(rooted.join(largest, "g").filter("root <> largest").select("g", "node", "n", "parts"), "jaccard-apart")
    if apart.isEmpty():
        return found
    groups = stored(apart.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum("n") / shingles)).cast("int")
                                           .alias("groups")), "jaccard-groups")
    own = F.pmod(F.xxhash64("node"), F.col("groups")).cast("int")
    one = apart.join(groups, "g").select("g", own.alias("i"), F.explode(every).alias("j"), F.lit(1).alias("side"), "node")
    other = split.join(groups, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("i"),
                                           F.col("own").alias("j"), F.lit(0).alias("side"), "node")
    return found.union(stored(_links(one.union(other), texts, size, percent), "jaccard-links"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT,
         **blocked) -> DataFrame:
    """key, row (a hash of key and text), n_shingles, node (the set) and component_id of every document."""
    base = docs.select(F.col(key).alias("k"), F.xxhash64(key, text).alias("row"), F.col(text).alias("t"))
    sets = stored(base.select("k", "row", _described(size, percent)("t").alias("s")).select("k", "row", "s.*"), "jaccard-sets")
    nodes = stored(sets.filter("n > 0").groupBy("node").agg(F.min("k").alias("least"), F.max("n").alias("n"), F.min("row").alias("row")),
                   "jaccard-nodes")
    found = links(base.select("row", "t"), sets, nodes, size, percent, **blocked)
    rooted = stored(nodes.join(components(found), "node", "left").select(
        "node", "least", F.coalesce("root", "node").alias("root")), "jaccard-rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = stored(rooted.join(named, "root").select("node", "component_id"), "jaccard-components")
    full = sets.filter("n > 0").select("k", "row", "n", "node").join(members, "node")
    empty = sets.filter("n = 0").select("node", "k", "row", "n", F.col("k").alias("component_id"))
    return full.unionByName(empty).select(F.col("k").alias(key), "row", F.col("n").alias("n_shingles"), "node", "component_id")


ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < {SHINGLE} THEN array_to_string(ws, ' ')
    ELSE array_to_string(ws[i:i + {SHINGLE - 1}], ' ') END AS g
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - {SHINGLE - 2}))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM o JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
r(doc_id, x) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.v, r.x FROM r JOIN l ON l.u = r.doc_id)
SELECT doc_id, any_value(coalesce(n, 0))::BIGINT AS n_shingles, min(x) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
