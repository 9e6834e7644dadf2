"""SimHash near-duplicates, linked through pivot distance tables.

A fingerprint has a bit set where over half of the XXH64 hashes of the text's word shingles have it. Distinct fingerprints
are dealt into buckets by the bits of two of ``bits + 2`` blocks: of fingerprints within ``bits`` at least two blocks agree,
so every link lies within some bucket. Inside a bucket the Hamming distances of its members to ``REFERENCES`` reference
fingerprints form a table; by the triangle inequality no pair whose rows differ by more than ``bits`` in any place can be a
link, and only the pairs left are verified. Small buckets test their pairs at once; in larger ones a search grows a
spanning forest, so a group of n near copies yields n - 1 links and not all pairs. Buckets beyond ``BLOCK`` members are
split into blocks, and pairs of blocks are searched in tasks of their own: no bucket is cut off.

Null texts and texts without words have the fingerprint zero, linked like any other; shorter texts than a shingle hash
whole. Equal fingerprints are one node, so copies cost nothing. Components take the least key, null only where all keys
are. Long texts are hashed whole, in pieces. An empty table gives an empty result; other columns are ignored.
"""

from itertools import combinations
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sieveline.llm.components import components
from sieveline.llm.common import stored

SHINGLE, BITS, REFERENCES = 4, 4, 16
#: members of a bucket searched in one task; members of a bucket whose pairs are tested at once
BLOCK, SMALL = 2048, 32
PIECE = 1 << 16
_BYTES = 0x0101010101010101


def fingerprint(text, shingle: int = SHINGLE) -> int:
    """The SimHash of a text as an unsigned number of 64 bits."""
    from xxhash import xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.append(0, ends[:-1] + 1)
    begins, ends = begins[:len(words) - size + 1].tolist(), ends[size - 1:].tolist()
    counts = np.zeros(64, np.int64)
    for p in range(0, len(begins), PIECE):
        hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(begins[p:p + PIECE], ends[p:p + PIECE])], np.uint64)
        padded = np.zeros(-(-len(hashes) // 255) * 255, np.uint64)
        padded[:len(hashes)] = hashes
        for k in range(8):  # bytes count bit k of each byte, over 255 hashes at a time
            sums = ((padded >> np.uint64(k)) & np.uint64(_BYTES)).reshape(-1, 255).sum(axis=1, dtype=np.uint64)
            counts[k::8] += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > len(begins)).tolist()))


def fingerprinter(shingle: int = SHINGLE):
    """A pandas UDF: text to its fingerprint as a long."""
    def prints(batches):
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t if isinstance(t, str) else None, shingle) for t in texts],
                                     np.uint64).view(np.int64))

    prints.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(prints, "long")


def references(n: int = REFERENCES):
    return np.random.default_rng(2024).integers(0, 1 << 64, n, np.uint64, endpoint=False)


def distance_table(prints, pivots):
    """Hamming distances of every fingerprint to every pivot."""
    return np.bitwise_count(prints[:, None] ^ pivots[None, :]).astype(np.int8)


def survivors(table, x, y, bits):
    """Places of the pairs (x, y) whose table rows differ by at most ``bits`` everywhere."""
    left = np.arange(len(x))
    for column in table.T:
        left = left[np.abs(column[x[left]] - column[y[left]]) <= bits]
    return left


def pair_links(prints, groups, pivots, bits):
    """Links within groups of sorted group numbers, by testing all pairs of a group."""
    table, out = distance_table(prints, pivots), []
    for apart in range(1, len(prints)):
        x = np.flatnonzero(groups[apart:] == groups[:-apart])
        if not len(x):
            break
        y = x + apart
        left = survivors(table, x, y, bits)
        left = left[np.bitwise_count(prints[x[left]] ^ prints[y[left]]) <= bits]
        out.append(np.stack([x[left], y[left]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), int)


def forest_links(prints, pivots, bits):
    """A spanning forest of the links among fingerprints."""
    table, out = distance_table(prints, pivots), []
    left = np.arange(len(prints))
    while len(left):
        waiting, left = [left[0]], left[1:]
        while waiting and len(left):
            x = waiting.pop()
            near = left[survivors(table, np.full(len(left), x), left, bits)]
            near = near[np.bitwise_count(prints[near] ^ prints[x]) <= bits]
            if len(near):
                out.append(np.stack([np.full(len(near), x), near], axis=1))
                waiting += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
    return np.concatenate(out) if out else np.zeros((0, 2), int)


def _search(pivots, bits, small):
    """Links within sorted groups; a group may run over several batches."""
    def links(frame):
        prints = frame["fp"].to_numpy().view(np.uint64)
        keys = frame[["c", "m", "i", "j"]].to_numpy()
        begins = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))[:len(keys)])
        sizes = np.diff(np.append(begins, len(keys)))
        groups = np.repeat(np.arange(len(sizes)), sizes)
        few = np.flatnonzero((sizes <= small)[groups])
        found = [few[pair_links(prints[few], groups[few], pivots, bits)]]
        for g in np.flatnonzero(sizes > small):
            found.append(begins[g] + forest_links(prints[begins[g]:begins[g] + sizes[g]], pivots, bits))
        found = np.concatenate(found).astype(int)
        signed = prints.view(np.int64)
        return pd.DataFrame({"u": signed[found[:, 0]], "v": signed[found[:, 1]]})

    def search(batches):
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            keys = batch[["c", "m", "i", "j"]].to_numpy()
            last = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            rest = batch.iloc[cut:]
            if cut:
                yield links(batch.iloc[:cut])
        if rest is not None and len(rest):
            yield links(rest)
    return search


def blocks(bits: int) -> list[int]:
    """Masks of ``bits + 2`` blocks of the fingerprint."""
    edges = np.linspace(0, 64, bits + 3).round().astype(int).tolist()
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def _signed(n):
    return n - (1 << 64) if n >> 63 else n


def links(prints: DataFrame, bits: int = BITS, block: int = BLOCK, small: int = SMALL, pivots: int = REFERENCES) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints ``fp`` within ``bits`` of each other, directly or in steps."""
    masks = [_signed(a | b) for a, b in combinations(blocks(bits), 2)]
    keyed = prints.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("c", "m"))
    crowded = stored(keyed.groupBy("c", "m").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-buckets")
    parts = F.ceil(F.col("n") / block).cast("int")
    members = keyed.join(crowded, ["c", "m"]).withColumn("parts", parts).withColumn(
        "own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).select(
        "fp", "c", "m", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    pairs = members.select("fp", "c", "m", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return pairs.repartition("c", "m", "i", "j").sortWithinPartitions("c", "m", "i", "j", "fp").mapInPandas(
        _search(references(pivots), bits, small), "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS,
                    **search) -> DataFrame:
    """key, row (a hash of key and text), fp, root (the component as a fingerprint) and component_id of every row."""
    prints = stored(docs.select(F.col(key).alias("k"), F.xxhash64(key, text).alias("row"),
                                fingerprinter(shingle)(F.col(text)).alias("fp")), "simhash")
    distinct = stored(prints.groupBy("fp").agg(F.min("k").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), bits, **search))
    rooted = stored(distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    named = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-components")
    return prints.join(stored(rooted.join(named, "root").select("fp", "root", "component_id"), "simhash-members"), "fp") \
        .select(F.col("k").alias(key), "row", "fp", "root", "component_id")


def hex_of(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **search) -> DataFrame:
    """The rows of ``docs`` without all but one of every component: the least key stays, ties by a hash of the text."""
    found = near_duplicates(docs, key, text, **search)
    row, place = "_sieveline_row", "_sieveline_place"
    stay = stored(found.groupBy("root").agg(F.min(F.struct(F.col(key).isNull(), key, "row")).alias("x")).select(
        F.col("x.row").alias(row)), "simhash-kept")
    kept = docs.withColumn(row, F.xxhash64(key, text)).join(stay, row, "left_semi")
    # rows repeated word for word share the hash: one of them stays
    first = Window.partitionBy(row).orderBy(key)
    return kept.withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).select(*docs.columns)
