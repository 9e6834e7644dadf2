"""Vector bin packing of examples into sequences by the dot-product heuristic.

A sequence has three limits: tokens, segments and loss-bearing tokens. It is filled with the example that fits all three
and has the largest dot product of its demands with what is left, both in shares of the limits; so an example heavy in what
is plentiful goes first. Every partition packs on its own from a window of waiting examples, in bounded memory, and numbers
its sequences within its own range.

``pack_examples`` keeps examples whole (instruction data). ``pack_documents`` tokenizes documents and may cut: where nothing
fits, the example with most tokens fills the rest, so that sequences come out full; what is left at the end of a partition
is laid out in sequences whose lengths are powers of two, which need no padding.

Null and empty texts are documents of the closing id alone. Null counts of tokens or loss are 0. Examples beyond a limit of
their own get a sequence to themselves. Repeated rows are packed as often as they occur; an empty table gives an empty
result. Long texts are cut into full sequences and a rest.
"""

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: tokens, segments and loss-bearing tokens of a sequence
LIMITS = (2048, 512, 2048)
#: examples a partition lets wait for a place; more than the segments of a sequence, so that their limit can bind
WINDOW = 1024
CLOSING_ID = 1
#: bytes of words and ids a task remembers before it starts afresh, what a word takes beside its characters and ids, and the
#: longest word remembered in characters
REMEMBERED, ENTRY, LONGEST = 192 << 20, 200, 48
#: characters of texts whose new words are learnt together, and parts that are encoded together
GROUP_CHARS, TOGETHER = 1 << 16, 512


class Pool:
    """Waiting examples with their demands."""

    def __init__(self, limits):
        self.limits = np.array(limits, float)
        self.items, self.demands = [], np.zeros((0, 3))

    def add(self, item, demand):
        n = len(self.items)
        if n == len(self.demands):
            self.demands = np.vstack([self.demands, np.zeros((max(64, n), 3))])
        self.demands[n] = demand
        self.items.append(item)

    def best(self, free):
        """The waiting example that fits ``free`` with the largest dot product; None where none fits."""
        demands = self.demands[:len(self.items)]
        fits = (demands <= free).all(axis=1)
        if not fits.any():
            return None
        return int(np.where(fits, demands @ (free / self.limits ** 2), -1.0).argmax())

    def take(self, i):
        item, demand = self.items[i], self.demands[i].copy()
        last = len(self.items) - 1
        self.items[i], self.demands[i] = self.items[last], self.demands[last]
        self.items.pop()
        return item, demand


def _numbers():
    """Numbers of sequences, apart from those of other partitions."""
    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    while True:
        yield first
        first += 1


def pack_examples(examples: DataFrame, key: str, tokens: str, loss: str, limits=LIMITS, window: int = WINDOW) -> DataFrame:
    """key, n_tokens, n_loss, sequence_id and offset of every example, which stays whole."""
    limits = tuple(limits)

    def pack(batches):
        pool, numbers = Pool(limits), _numbers()

        def sequence():
            free, number, at, rows = np.array(limits, float), next(numbers), 0, []
            while (i := pool.best(free)) is not None:
                item, demand = pool.take(i)
                rows.append((*item, number, at))
                at, free = at + item[1], free - demand
            if not rows:  # beyond a limit of its own
                item, _ = pool.take(0)
                rows.append((*item, number, 0))
            return rows

        columns = ["k", "n_tokens", "n_loss", "sequence_id", "offset"]
        for batch in batches:
            rows = []
            for k, n, m in zip(batch["k"], batch["n"], batch["m"]):
                pool.add((k, n, m), (n, 1, m))
                while len(pool.items) > window:
                    rows += sequence()
            yield pd.DataFrame(rows, columns=columns)
        while pool.items:
            yield pd.DataFrame(sequence(), columns=columns)

    kind = examples.schema[key].dataType.simpleString()
    counts = examples.select(F.col(key).alias("k"), *(F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0)).alias(a)
                                                      for c, a in ((tokens, "n"), (loss, "m"))))
    return counts.mapInPandas(pack, f"k {kind}, n_tokens long, n_loss long, sequence_id long, offset long") \
        .withColumnRenamed("k", key)


#: texts of other characters than these are encoded word by word as they are; these split and change case alike everywhere
_UNUSUAL = r"[^\t\n\r -~\xa1-\u012f\u0131-\u024f]|<\|"
#: fixed value: how the vocabulary's own splitter parts lower-cased text
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: characters that end words and make one part where they stand together
_TAIL = ".,;:!?#$%&*|"


class _Words:
    """Words to their ids as little-endian bytes, remembered within a task.

    White space parts words and leaves nothing behind, so words are encoded apart and remembered. In usual texts a word is
    parted as the tokenizer does; new parts are encoded many at a time, and the ids come apart again where one ends a part.
    A part is a word as well, of the same ids.
    """

    def __init__(self, path):
        import re

        import regex
        from tokenizers import Tokenizer, pre_tokenizers
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path("word_bpe_49k.json")
        self.path, self.whole, self.of_parts = path, None, Tokenizer.from_file(path)
        self.of_parts.normalizer = None  # parts are lower-cased already, and one space stands between two of them
        self.of_parts.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.unusual, self.split = re.compile(_UNUSUAL).search, regex.compile(_PARTS).findall
        vocabulary = self.of_parts.get_vocab(with_added_tokens=True)
        self.ending = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ending[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.closing = np.array([CLOSING_ID], "<u4").tobytes()
        self.known, self.held = {"": b""}, 0

    def as_they_are(self, words):
        """Ids of words of any characters."""
        if self.whole is None:
            self.whole = type(self.of_parts).from_file(self.path)
        found = self.whole.encode_batch_fast(words, add_special_tokens=False)
        return b"".join([np.array(e.ids, "<u4").tobytes() for e in found])

    def remember(self, words, ids):
        self.known.update(zip(words, ids, strict=True))
        self.held += ENTRY * len(ids) + sum(map(len, ids)) + sum(map(len, words))

    def learn(self, words):
        """Remembers new words of usual texts."""
        known, single, double, other, parts = self.known, [], [], [], set()
        for w in words:
            if w.isalpha():
                low = w.lower()
                if low != w:
                    single.append((w, low))
                parts.add(low)
                continue
            core = w.rstrip(_TAIL)
            if core.isalpha():
                pair = core.lower(), w[len(core):]
                double.append((w, pair))
                parts.update(pair)
            else:
                found = self.split(w.lower())
                if found != [w]:
                    other.append((w, found))
                parts.update(found)
        fresh = list(parts.difference(known))
        for k in range(0, len(fresh), TOGETHER):
            some = fresh[k:k + TOGETHER]
            ids = np.array(self.of_parts.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            data, bounds = ids.tobytes(), [0, *(4 * np.flatnonzero(self.ending[ids]) + 4).tolist()]
            self.remember(some, [data[a:b] for a, b in zip(bounds, bounds[1:])])
        self.remember([w for w, _ in single], [known[p] for _, p in single])
        self.remember([w for w, _ in double], [known[p] + known[q] for _, (p, q) in double])
        self.remember([w for w, _ in other], [b"".join([known[p] for p in found]) for _, found in other])
        for w in (*words, *fresh):
            if len(w) > LONGEST:
                self.long.add(w)

    def encode(self, texts):
        """The ids of every text and the closing id."""
        if self.held > REMEMBERED:
            self.known, self.held = {"": b""}, 0
        self.long, parted, fresh = set(), [], set()
        for text in texts:
            flat = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
            words = flat.split(" ")
            plain = (flat.isascii() and flat.isprintable() and "<|" not in flat) or not self.unusual(flat)
            parted.append((plain, words))
            if plain:
                fresh.update(set(words).difference(self.known))
        if fresh:
            self.learn(fresh)
        ids_of = self.known.__getitem__
        out = [(b"".join(map(ids_of, words)) if plain else self.as_they_are(words)) + self.closing for plain, words in parted]
        for w in self.long:
            self.held -= ENTRY + len(w) + len(self.known.pop(w))
        return out


def _groups(keys, texts):
    """Rows of a batch, as many at a time as make up ``GROUP_CHARS``."""
    ks, ts, chars = [], [], 0
    for k, t in zip(keys, texts):
        ks.append(k)
        ts.append(t)
        chars += len(t)
        if chars >= GROUP_CHARS:
            yield ks, ts
            ks, ts, chars = [], [], 0
    if ks:
        yield ks, ts


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = None, limits=LIMITS,
                   window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their places in sequences.

    key, start and length in the document's ids, ids_crc32, doc_tokens, sequence_id and offset. ``tokenizer`` is the path of
    a tokenizer file on every executor, by default that of the installed vocabulary ``word_bpe_49k.json``. ``with_ids`` adds
    the ids of every piece; ``sequences`` joins them to what a model is trained on.
    """
    limits = tuple(limits)
    full = limits[0]

    def pack(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, pool, numbers = _Words(tokenizer), Pool(limits), _numbers()
        rows = []

        def place(k, ids, begin, n, total, number, at):
            """``ids`` begins with the piece."""
            row = (k, begin, n, zlib.crc32(ids[:4 * n]), total, number, at)
            rows.append((*row, np.frombuffer(ids, "<i4", n)) if with_ids else row)

        def wait(k, ids, begin, n, total):
            pool.add((k, ids, begin, n, total), (n, 1, n))

        def sequence():
            """Pieces of one sequence, in order."""
            free, pieces = np.array(limits, float), []
            while pool.items and free.min() >= 1:
                i = pool.best(free)
                if i is None:  # all are too long: the longest is cut
                    i, n = int(pool.demands[:len(pool.items), 0].argmax()), int(min(free[0], free[2]))
                    (k, ids, begin, length, total), _ = pool.take(i)
                    wait(k, ids[4 * n:], begin + n, length - n, total)
                else:
                    (k, ids, begin, n, total), _ = pool.take(i)
                pieces.append((k, ids, begin, n, total))
                free -= (n, 1, n)
            return pieces

        def lay_out(pieces):
            """One full sequence, or several whose lengths are powers of two."""
            left = sum(p[3] for p in pieces)
            number, at, room = next(numbers), 0, full if left == full else 1 << (left.bit_length() - 1)
            for k, ids, begin, n, total in pieces:
                while n:
                    part = min(n, room)
                    place(k, ids, begin, part, total, number, at)
                    ids, begin, n = ids[4 * part:], begin + part, n - part
                    at, room, left = at + part, room - part, left - part
                    if not room and left:
                        number, at, room = next(numbers), 0, 1 << (left.bit_length() - 1)

        for batch in batches:
            for k, ids in ((k, i) for ks, ts in _groups(batch["k"], batch["t"]) for k, i in zip(ks, words.encode(ts))):
                total = len(ids) // 4
                whole = total // full * full
                for begin in range(0, whole, full):
                    place(k, ids[4 * begin:4 * (begin + full)], begin, full, total, next(numbers), 0)
                if total > whole:
                    wait(k, ids[4 * whole:], whole, total - whole, total)
                while len(pool.items) > window:
                    lay_out(sequence())
            yield pd.DataFrame(rows, columns=columns)
            rows.clear()
        while pool.items:
            lay_out(sequence())
        yield pd.DataFrame(rows, columns=columns)

    columns = ["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInPandas(
        pack, f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        + (", ids array<int>" if with_ids else "")).withColumnRenamed("k", key)


def sequences(pieces: DataFrame, key: str = "doc_id", full: int = LIMITS[0], padding: int = 0) -> DataFrame:
    """The packed sequences of pieces with their ids: sequence_id, n_tokens, ids, segments (key, start, offset, length) and mask.

    ``ids`` is padded with ``padding`` to ``full``, except where the tokens are a power of two; ``mask`` is 1 on tokens and 0
    on padding. A sequence holds at most ``full`` tokens, so no group grows with the table.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", F.col(key).alias("key"), "start", "length", "ids")))
    n = F.col("n_tokens").cast("int")
    even = F.bitwise_not(n - 1).bitwiseAND(n) == n
    spare = F.when(even, 0).otherwise(F.greatest(F.lit(full) - n, F.lit(0)))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select(
        "sequence_id", "n_tokens",
        F.concat(F.flatten("parts.ids"), F.array_repeat(F.lit(padding), spare)).alias("ids"),
        F.expr("transform(parts, p -> named_struct('key', p.key, 'start', p.start, 'offset', p.offset, 'length', p.length))")
        .alias("segments"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), spare)).alias("mask"))
