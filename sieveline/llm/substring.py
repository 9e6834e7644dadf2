"""Substring removal: repeated windows of words, found by a count-min prefilter and grouped exactly.

Documents are stored once, divided into ranges of the key, each about ``RANGE_CHARS`` characters long. Then:

1. Every range hashes its windows into a count-min sketch of ``ROWS`` rows. The rows together are about as wide as the text
   is long, so a range keeps only the cells it touches, sorted and packed.
2. The sketches are merged by slices of cells. Each range is told, one bit a touched cell, where the merged count is two or
   more. Estimates never fall short, so no repeated window is lost.
3. The ranges send the 96-bit hashes of the windows estimated repeated in every row, and only these, to be grouped exactly.
   Ranges ascend with the key, so the lowest range that holds a hash has its first occurrence: one bit back a hash.
4. Each range removes the words under windows that started earlier, in a lower range or in itself, and gives the text left.

What moves besides the documents is a few bits a window, and nothing of it depends on how often a passage occurs: a
range names a hash once. Null texts have no words. Documents shorter than a window lose nothing. Rows of equal key
count as one after the other, in order of their texts; null keys come first. An empty table gives an empty result. Texts are
read whole; other columns are ignored.
"""

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sieveline.llm.common import range_of, range_starts, stored
from sieveline.session import shared_folder

WINDOW, ROWS = 20, 2
RANGE_CHARS = 8_000_000
#: bits of the cells in one slice at least, and of the number of slices at most
SLICE_BITS, SLICES_BITS = 24, 10
#: windows grouped exactly in one task, if all were repeated
GROUP_WINDOWS = 2_000_000
#: words remembered by a task before it starts afresh
REMEMBERED = 300_000
#: odd multipliers of the two rolling hashes
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """Words to 16 bytes."""

    def __missing__(self, word):
        import xxhash
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_128_digest(word)
        return value


def _mixed(h):
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def windows(texts, size, known):
    """Two hashes of every window of every text, in order, with its place among the words of all texts and each text's words."""
    words = [t.encode("utf-8", "surrogatepass").split() if isinstance(t, str) else [] for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer(b"".join([known[w] for ws in words for w in ws]), "<u8").reshape(-1, 2)
    ends = np.cumsum(lengths)
    n = max(0, len(flat) - size + 1)
    inside = np.repeat(ends, lengths)[:n] >= np.arange(n) + size
    lanes = []
    for lane, factor in enumerate(_FACTORS):
        # doubling: h[k] covers k words
        base, power, length = np.ascontiguousarray(flat[:, lane]), factor, 1
        total, done = None, 0
        h = base
        while length <= size:
            if size & length:
                part = h[done:done + n] if total is None else h[done:][:n]
                total = part[:n] if total is None else total[:n] * np.uint64(pow(factor, length, 1 << 64)) + part[:n]
                done += length
            if 2 * length <= size:
                h = h[:-length] * np.uint64(power) + h[length:] if len(h) > length else h[:0]
                power = power * power % (1 << 64)
            length *= 2
        lanes.append(_mixed((total if total is not None else base[:0])[:n][inside]))
    return lanes, np.flatnonzero(inside), lengths, words


def _packed(numbers):
    """Ascending numbers as compressed gaps, byte by byte."""
    import zstandard
    gaps = np.diff(numbers, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(blob):
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel())


def _cells(lanes, bits):
    """For every row of the sketch: the touched cells ascending, each window's place among them, and their counts."""
    for lane in lanes:
        yield np.unique(lane >> np.uint64(64 - bits), return_inverse=True, return_counts=True)


def _flags(bits, n):
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def _slices(cells, bits, slice_bits):
    """Number, begin and end of each slice among the ascending cells."""
    numbers = cells >> np.uint64(slice_bits)
    found, starts = np.unique(numbers, return_index=True)
    return zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(cells)])


def _sketch(bits, slice_bits, size):
    def sketch(key, rows):
        lanes, _, _, _ = windows(rows.sort_values(["nul", "k", "t"], ascending=[False, True, True])["t"], size, _Hashes())
        out = []
        for row, (cells, _, counts) in enumerate(_cells(lanes, bits)):
            for number, a, b in _slices(cells, bits, slice_bits):
                out.append((row, number, int(key[0]), _packed(cells[a:b] - np.uint64(number << slice_bits)),
                            np.packbits(counts[a:b] > 1).tobytes()))
        return pd.DataFrame(out, columns=["row", "slice", "range", "cells", "twice"])
    return sketch


def _merge(slice_bits):
    def merge(key, rows):
        counts = np.zeros(1 << slice_bits, np.uint8)
        touched = [_unpacked(c) for c in rows["cells"]]
        for cells, twice in zip(touched, rows["twice"]):
            counts[cells] = np.minimum(2, counts[cells] + 1 + _flags(twice, len(cells)))
        return pd.DataFrame({"range": rows["range"], "kind": int(key[0]), "part": int(key[1]),
                             "bits": [np.packbits(counts[cells] > 1).tobytes() for cells in touched]})
    return merge


def _suspects(lanes, replies, bits, slice_bits):
    """Windows estimated repeated in every row."""
    suspect = np.ones(len(lanes[0]), bool)
    for row, (cells, place, _) in enumerate(_cells(lanes, bits)):
        mine = replies[replies["kind"] == row]
        told = dict(zip(mine["part"], mine["bits"]))
        repeated = np.ones(len(cells), bool)
        for number, a, b in _slices(cells, bits, slice_bits):
            repeated[a:b] = _flags(told[number], b - a)
        suspect &= repeated[place]
    return suspect


def _exact(lanes, suspect):
    """The distinct hashes of suspected windows, ascending, with each window's place among them."""
    pairs = np.empty(int(suspect.sum()), [("a", "<u8"), ("b", "<u4")])
    pairs["a"], pairs["b"] = lanes[0][suspect], lanes[1][suspect].astype("<u4")
    order = np.lexsort((pairs["b"], pairs["a"]))
    ordered = pairs[order]
    fresh = np.append(True, ordered[1:] != ordered[:-1])[:len(ordered)]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return ordered[fresh], place


def _parts(distinct, part_bits):
    numbers = (distinct["a"] >> np.uint64(64 - part_bits)) if part_bits else np.zeros(len(distinct), np.uint64)
    found, starts = np.unique(numbers, return_index=True)
    return zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(distinct)])


def _name(bits, slice_bits, part_bits, size):
    def name(rows, replies):
        if not len(rows):
            return pd.DataFrame([], columns=["part", "range", "a", "b"])
        lanes, _, _, _ = windows(rows.sort_values(["nul", "k", "t"], ascending=[False, True, True])["t"], size, _Hashes())
        distinct, _ = _exact(lanes, _suspects(lanes, replies, bits, slice_bits))
        out = [(number, int(rows["range"].iloc[0]), _packed(distinct["a"][i:j]), distinct["b"][i:j].tobytes())
               for number, i, j in _parts(distinct, part_bits)]
        return pd.DataFrame(out, columns=["part", "range", "a", "b"])
    return name


def _first(key, rows):
    """For each range and hash: does no lower range name it?"""
    rows = rows.sort_values("range")
    a = [_unpacked(x) for x in rows["a"]]
    lengths = [len(x) for x in a]
    a, b = np.concatenate(a), np.concatenate([np.frombuffer(x, "<u4") for x in rows["b"]])
    order = np.lexsort((np.arange(len(a)), b, a))
    fresh = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
    first = np.empty(len(a), bool)
    first[order] = fresh
    cuts = np.cumsum(lengths)[:-1]
    return pd.DataFrame({"range": rows["range"], "kind": ROWS, "part": int(key[0]),
                         "bits": [np.packbits(x).tobytes() for x in np.split(first, cuts)]})


def _remove(bits, slice_bits, part_bits, size):
    columns = ["nul", "k", "n_words", "kept", "removed"]

    def remove(rows, replies):
        if not len(rows):
            return pd.DataFrame([], columns=columns)
        rows = rows.sort_values(["nul", "k", "t"], ascending=[False, True, True])
        lanes, at, lengths, words = windows(rows["t"], size, _Hashes())
        suspect = _suspects(lanes, replies, bits, slice_bits)
        distinct, place = _exact(lanes, suspect)
        answers = replies[replies["kind"] == ROWS]
        told = dict(zip(answers["part"], answers["bits"]))
        first = np.zeros(len(distinct), bool)
        for number, i, j in _parts(distinct, part_bits):
            first[i:j] = _flags(told[number], j - i)
        # of windows that no lower range names, the first here stays
        starts_here = np.zeros(len(place), bool)
        if len(place):
            starts_here[np.unique(place, return_index=True)[1]] = True
        gone = at[suspect][~(first[place] & starts_here)]
        marks = np.zeros(int(lengths.sum()) + 1, np.int64)
        np.add.at(marks, gone, 1)
        np.add.at(marks, np.minimum(gone + size, len(marks) - 1), -1)
        kept = np.cumsum(marks)[:-1] == 0
        out, begin = [], 0
        for nul, k, n, ws in zip(rows["nul"], rows["k"], lengths.tolist(), words):
            keep = kept[begin:begin + n]
            left, spans = ws, []
            if not keep.all():
                left = [w for w, x in zip(ws, keep.tolist()) if x]
                edges = np.flatnonzero(np.diff(keep, prepend=True, append=True)).tolist()
                spans = [{"begin": i, "end": j} for i, j in zip(edges[::2], edges[1::2])]
            out.append((nul, k, n, b" ".join(left).decode("utf-8", "surrogatepass"), spans))
            begin += n
        return pd.DataFrame(out, columns=columns)
    return remove


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW,
                   range_chars: int = RANGE_CHARS) -> DataFrame:
    """key, n_words, kept, removed, n_removed and kept_sha256 of every document.

    ``kept`` is the text without its repeats, the words that stay with one blank between them; ``removed`` holds the spans of
    removed words, ends exclusive. The other two are the number of removed words and the hash of ``kept``.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    starts, _, chars = range_starts(base, range_chars)
    ranges = max(1, len(starts))
    bits = max(20, int(chars).bit_length())
    slice_bits = max(min(bits, SLICE_BITS), bits - SLICES_BITS)
    part_bits = max(0, int(chars // (6 * GROUP_WINDOWS)).bit_length())

    # kept by range, so that the passes below read it without moving it again
    name = f"substring_{uuid.uuid4().hex}"
    base.select(range_of(starts).alias("range"), F.col("k").isNull().alias("nul"),
                F.coalesce(F.col("k").cast("long"), F.lit(0)).alias("k"), F.coalesce("t", F.lit("")).alias("t")) \
        .repartition(ranges, "range").write.bucketBy(ranges, "range").option("compression", "zstd") \
        .option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    by_range = spark.table(name).groupBy("range")

    sketches = by_range.applyInPandas(_sketch(bits, slice_bits, size),
                                      "row int, slice int, range int, cells binary, twice binary")
    told = "range int, kind int, part int, bits binary"
    replies = stored(sketches.groupBy("row", "slice").applyInPandas(_merge(slice_bits), told), "substring-counts")
    named = by_range.cogroup(replies.groupBy("range")).applyInPandas(
        _name(bits, slice_bits, part_bits, size), "part int, range int, a binary, b binary")
    answers = named.groupBy("part").applyInPandas(_first, told)
    result = by_range.cogroup(replies.unionByName(answers).groupBy("range")).applyInPandas(
        _remove(bits, slice_bits, part_bits, size),
        "nul boolean, k long, n_words long, kept string, removed array<struct<begin: long, end: long>>")
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return result.select(F.when(~F.col("nul"), F.col("k")).cast(docs.schema[key].dataType).alias(key), "n_words", "kept",
                         "removed", n_removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
           FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d WHERE len(ws) >= {WINDOW}),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS x FROM w),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS n FROM h) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM late, range({WINDOW}) AS r(o)),
lists AS (SELECT doc_id, list(i) AS l, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN l IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)),
       lambda p: NOT list_contains(l, p[2])), lambda p: p[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id)
"""
