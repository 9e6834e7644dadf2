"""Hard-negative mining by a vertical scan of the dimensions (BOND).

For every anchor the positives are its highest-scoring other rows of the same label, and the negatives of a positive are the
highest-scoring rows of other labels within a window of scores below it; a score is the inner product of integer vectors. A
block of rows is kept by dimension. For an anchor its dimensions are read in descending order of the anchor's magnitude
there; after every few of them a row's score lies between what is summed so far and the least and the greatest that the
remaining dimensions of the block can add. Rows that cannot reach the best scores found so far, or whose scores cannot meet
a window, leave the candidate bitmap; what stays to the last dimension has its exact score.

The anchors are a part of the table and grow with it. They go to the tasks in portions of at most about ``PORTION`` bytes,
each of which meets all rows, read block by block where they lie: first for the positives, then, with their scores known,
for the negatives. A task keeps a few rows for an anchor and positive, and these are merged by rank. No pair of rows is
written that is not among a task's best.

Rows with a null key or label, or with a vector that ``vectors.quantized`` leaves out, take no part. Of rows that share a key
the one with the least label takes part, of equal labels the one with the least vector. Ties of scores go to the smaller key.
An anchor without other rows of its label has no rows in the result, a positive without negatives in its window neither.
Scores beyond the precision of doubles are computed with Python's integers; they leave as decimal(38,0). An empty table gives
an empty result; other columns are ignored.
"""

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sieveline.llm.common import stored
from sieveline.llm.vectors import exact, matrix, quantized

#: positives of an anchor, negatives of a positive, and the window's lower end in hundredths of the positive's score
POSITIVES, NEGATIVES, PERCENT = 5, 5, 80
#: bytes of a portion of anchors, rows of a block, and after which shares of the dimensions candidates are looked at
PORTION, BLOCK, LOOKS = 8 << 20, 8192, (0.25, 0.5, 0.625, 0.75, 0.875)


def prepared(rows: DataFrame, key: str, label, vector: str) -> DataFrame:
    """One row (k, label, x) for a key."""
    base = rows.select(F.col(key).alias("k"), label.alias("label"), F.col(vector).alias("v")).filter(
        "k IS NOT NULL AND label IS NOT NULL")
    return quantized(base, "v").groupBy("k").agg(F.min(F.struct("label", "x")).alias("r")).select("k", "r.label", "r.x")


def kind_of(squares: float):
    """In which numbers products of vectors with such squared lengths, and their partial sums, are exact."""
    return np.float32 if squares < 1 << 22 else np.float64 if squares < 1 << 51 else object


def _under(bound, kind):
    """``bound`` as a number of the kind, not rounded up."""
    if kind is object or not np.isfinite(bound):
        return bound
    near = kind(bound)
    return near if near <= bound else np.nextafter(near, kind(-np.inf))


def _over(bound, kind):
    return -_under(-bound, kind)


class Block:
    """Rows by dimension, ordered by label, with the least and greatest entry of every dimension."""

    def __init__(self, keys, labels, x, kind):
        order = np.argsort(labels, kind="stable")
        self.keys, self.labels, self.kind = keys[order], labels[order], kind
        self.columns = np.ascontiguousarray(x[order].T.astype(kind))
        self.least, self.greatest = self.columns.min(axis=1), self.columns.max(axis=1)
        self.looks = sorted({max(1, round(s * len(self.columns))) for s in LOOKS} | {len(self.columns)})

    def of_label(self, label):
        return slice(*np.searchsorted(self.labels, [label, label + 1]))

    def scan(self, q, rows, low, high=np.inf, best: int = 0):
        """Places and exact scores of the rows whose inner product with q is at least ``low`` and at most ``high``.

        ``rows`` are the places to look at. With ``best`` rows are left out that are surely not among so many best ones.
        """
        kind = self.kind
        order = np.argsort(-np.abs(q), kind="stable")
        wide = q if kind is object else q.astype(np.float64)
        ends = np.stack([wide * self.least, wide * self.greatest])[:, order]
        least, greatest = ends.min(axis=0)[::-1].cumsum()[::-1], ends.max(axis=0)[::-1].cumsum()[::-1]
        weights, scores, begin = q[order].astype(kind), None, 0
        for end in self.looks:
            dims = order[begin:end]
            part = weights[begin:end] @ (self.columns[dims, rows] if isinstance(rows, slice) else
                                         self.columns[dims[:, None], rows[None, :]])
            scores = part if scores is None else scores + part
            begin = end
            if isinstance(rows, slice):
                rows = np.arange(rows.start, rows.stop)
            if not len(scores):
                break
            more, less = (greatest[end], least[end]) if end < len(order) else (0, 0)
            floor = low
            if best and len(scores) > best:
                floor = max(floor, np.partition(scores, len(scores) - best)[len(scores) - best] + less)
            stay = scores >= _under(floor - more, kind)
            if high != np.inf:
                stay &= scores <= _over(high - less, kind)
            if not stay.all():
                rows, scores = rows[stay], scores[stay]
        return rows, scores


def _best(keys, scores, most):
    """Places of the ``most`` highest scores, ties by key."""
    if len(scores) > most:
        few = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
    else:
        few = np.arange(len(scores))
    return few[np.lexsort((keys[few], -scores[few]))][:most]


class Ranked:
    """The best keys and scores so far."""

    def __init__(self, most):
        self.most, self.keys, self.scores = most, np.zeros(0, np.int64), np.zeros(0)

    @property
    def full(self):
        """The score that a further row has to reach."""
        return self.scores[-1] if len(self.scores) == self.most else -np.inf

    def add(self, keys, scores):
        keys, scores = np.concatenate([self.keys, keys]), np.concatenate([self.scores, scores])
        top = _best(keys, scores, self.most)
        self.keys, self.scores = keys[top], scores[top]


def _blocks(batches, kind, size):
    """The rows of a task in blocks."""
    def made(parts):
        return Block(*(np.concatenate(p) for p in zip(*parts)), kind)

    parts, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "label"))
        x = matrix(batch)
        for n in range(0, len(x), size):
            parts.append((keys[n:n + size], labels[n:n + size], x[n:n + size]))
            rows += len(parts[-1][0])
            if rows >= size:
                yield made(parts)
                parts, rows = [], 0
    if parts:
        yield made(parts)


_FOUND = pa.schema([("a", pa.int32()), ("p", pa.int32()), ("k", pa.int64()), ("score", pa.decimal128(38, 0))])
_FOUND_SQL = "a int, p int, k long, score decimal(38,0)"


def _written(ranked):
    """The ranked rows of a task, by numbers of anchors and positives."""
    a, p, k, score = [], [], [], []
    for (x, y), best in ranked:
        a += [x] * len(best.keys)
        p += [y] * len(best.keys)
        k += best.keys.tolist()
        score += [Decimal(int(s)) for s in best.scores]
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip((a, p, k, score), _FOUND)], schema=_FOUND)


def _positives(keys, labels, q, kind, most, size):
    def find(batches):
        ranked = [Ranked(most) for _ in keys]
        for block in _blocks(batches, kind, size):
            for a in np.flatnonzero(np.isin(labels, block.labels)).tolist():
                # one more than asked for, as the anchor itself may be among them
                rows, scores = block.scan(q[a], block.of_label(labels[a]), ranked[a].full, best=most + 1)
                other = block.keys[rows] != keys[a]
                ranked[a].add(block.keys[rows[other]], scores[other])
        yield from _written(((a, 0), best) for a, best in enumerate(ranked))
    return find


def _negatives(labels, q, windows, kind, most, size):
    """``windows`` has for each anchor the ends of its positives' windows."""
    def find(batches):
        ranked = [[Ranked(most) for _ in w] for w in windows]
        for block in _blocks(batches, kind, size):
            for a, ends in enumerate(windows):
                open_ends = [(max(low, best.full), high) for (low, high), best in zip(ends, ranked[a]) if best.full < high
                             and low <= high]
                if not open_ends:
                    continue
                own = block.of_label(labels[a])
                rows = slice(0, len(block.keys)) if own.start == own.stop else np.concatenate(
                    [np.arange(own.start), np.arange(own.stop, len(block.keys))])
                rows, scores = block.scan(q[a], rows, min(e[0] for e in open_ends), max(e[1] for e in open_ends))
                for (low, high), best in zip(ends, ranked[a]):
                    inside = (scores >= max(low, best.full)) & (scores <= high)
                    if inside.any():
                        best.add(block.keys[rows[inside]], scores[inside])
        yield from _written(((a, p), best) for a, each in enumerate(ranked) for p, best in enumerate(each))
    return find


def _merged(found: DataFrame, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("a", "p").orderBy(F.desc("score"), "k"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most)


def mine(rows: DataFrame, key: str = "vec_id", label="label", vector: str = "embedding", anchors="vec_id % 100 = 0",
         positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = PERCENT, portion: int = PORTION,
         block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``label`` is a column or a column's name; ``anchors`` is SQL over the key under its own name that tells the anchors.
    """
    spark = rows.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    held = stored(prepared(rows, key, label, vector), "negatives-rows")
    squares = F.aggregate("x", F.lit(0.0), lambda s, e: s + e.cast("double") * e)
    facts = held.agg(F.max(squares), F.first(F.size("x"))).first()
    kind, d = kind_of(facts[0] or 0.0), facts[1] or 1
    chosen = stored(held.withColumnRenamed("k", key).filter(anchors).select(F.col(key).alias("k"), "label", "x"), "negatives-anchors")
    portions = -(-chosen.count() * 8 * d // portion)
    chosen = chosen.withColumn("portion", F.pmod(F.xxhash64("k"), F.lit(max(1, portions))))
    found = []
    for n in range(portions):
        some = chosen.filter(F.col("portion") == n).select("k", "label", "x").orderBy("k").collect()
        if not some:
            continue
        keys, labels = (np.array([r[c] for r in some]) for c in (0, 1))
        q = exact(np.array([r[2] for r in some]), 0) if kind is not object else np.array([r[2] for r in some], object)
        near = _merged(held.mapInArrow(_positives(keys, labels, q, kind, positives, block), _FOUND_SQL), positives)
        near = sorted(map(tuple, near.select("a", "rank", "k", "score").collect()))
        windows = [[] for _ in some]
        for a, _, _, score in near:
            # scores s with percent * score <= 100 * s <= 100 * score
            windows[a].append((-(-percent * int(score) // 100), int(score)))
        names = spark.createDataFrame([(a, rank - 1, int(keys[a]), k, score) for a, rank, k, score in near],
                                      "a int, p int, anchor_id long, positive_id long, positive_score decimal(38,0)")
        far = _merged(held.mapInArrow(_negatives(labels, q, windows, kind, negatives, block), _FOUND_SQL), negatives)
        found.append(stored(far.join(F.broadcast(names), ["a", "p"]).select(
            "anchor_id", "positive_id", "rank", F.col("k").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")), "negatives"))
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score decimal(38,0), negative_score decimal(38,0)")
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return out


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding,
    lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {PERCENT} * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
