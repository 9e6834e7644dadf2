"""Substring removal against brute force; the multiset hash's algebra."""

import hashlib
import random
import re

import pytest
from samples import prose
from pyspark.sql import functions as F

from sieveline.llm import fingerprint, substring


def plain_removal(rows, size):
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - size + 1):
            window = tuple(words[i:i + size])
            if window in seen:
                gone.update(range(i, i + size))
            seen.add(window)
        left = [w for i, w in enumerate(words) if i not in gone]
        out.setdefault(key, []).append((len(words), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def texts():
    rng = random.Random(5)
    passages = [prose(50 + n, 30, 2) for n in range(4)]
    rows = []
    for n in range(120):
        text = prose(100 + n, rng.randint(1, 90), 1)
        if n % 3 == 0:
            text += " " + rng.choice(passages) + "\n" + prose(300 + n, 12, 1)
        if n % 10 == 0:
            text += "\t" + "again and again " * 15
        rows.append((rng.randrange(-50, 400) * 7, text))
    return rows + [(3, None), (4, ""), (5, rows[0][1]), (5, rows[0][1]), (None, rows[3][1]), (6, "é " * 60)]


@pytest.mark.parametrize("size, chars", [(20, 8_000_000), (20, 5000), (5, 3000), (1, 20000)])
def test_removal(make_docs, size, chars):
    rows = texts()
    got = {}
    for r in substring.remove_repeats(make_docs(rows), size=size, range_chars=chars).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"], r["kept_sha256"]))
    assert {k: sorted(v) for k, v in got.items()} == plain_removal(rows, size)


def test_kept_text_and_removed_words(make_docs):
    """The operator gives the text without its repeats, and where they were."""
    rows = [(n, text) for n, (_, text) in enumerate(texts())]
    plain = plain_removal(rows, 20)
    got = substring.remove_repeats(make_docs(rows), range_chars=5000).collect()
    assert len(got) == len(rows) and any(r["removed"] for r in got)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", rows[r["doc_id"]][1] or "")
        gone = {i for s in r["removed"] for i in range(s["begin"], s["end"])}
        assert r["kept"] == " ".join(w for i, w in enumerate(words) if i not in gone)
        assert plain[r["doc_id"]] == [(len(words), len(gone), hashlib.sha256(r["kept"].encode()).hexdigest())]


def test_narrow_sketch_loses_nothing(make_docs, monkeypatch):
    """Where every cell is crowded, the exact pass alone decides."""
    monkeypatch.setattr(substring, "SLICE_BITS", 4)
    rows = texts()[:40]
    plain = plain_removal(rows, 20)
    got = substring.remove_repeats(make_docs(rows), range_chars=2000).collect()
    assert sum(r["n_removed"] for r in got) == sum(x[1] for v in plain.values() for x in v)


def test_gaps_round_trip():
    import numpy as np
    numbers = np.array([0, 1, 2, 500, (1 << 53) + 1, (1 << 63) + 12345, (1 << 64) - 1], np.uint64)
    assert substring._unpacked(substring._packed(numbers)).tolist() == numbers.tolist()


def test_order_insertion_and_deletion(spark):
    a, b = prose(1, 60, 6).split("\n"), prose(2, 40, 4).split("\n")
    shuffled = a + b
    random.Random(3).shuffle(shuffled)
    frame = spark.createDataFrame([("\n".join(a), "\n".join(b), "\n".join(a + b), "\n\n".join(shuffled), "")],
                                  "a string, b string, both string, mixed string, none string")
    prints = frame.select(*(fingerprint.fingerprint(c).alias(c) for c in frame.columns))
    row = prints.select(
        (fingerprint.insert(F.col("a"), F.col("b")) == F.col("both")).alias("inserted"),
        (fingerprint.delete(F.col("both"), F.col("b")) == F.col("a")).alias("deleted"),
        (fingerprint.delete(F.col("a"), F.col("a")) == F.col("none")).alias("emptied"),
        (F.col("both") == F.col("mixed")).alias("order"), (F.col("a") == F.col("b")).alias("other"),
        fingerprint.likeness("a", "both").alias("near"), fingerprint.likeness("a", "b").alias("far"),
        fingerprint.likeness("none", "a").alias("empty"), fingerprint.likeness("none", "none").alias("same")).first()
    assert row["inserted"] and row["deleted"] and row["emptied"] and row["order"] and not row["other"]
    assert row["near"] > 0.5 > 0.3 > row["far"] and row["empty"] == 0.0 and row["same"] == 1.0


@pytest.mark.parametrize("copies", [1 << 14, 1 << 15, (1 << 16) + 3])
def test_many_equal_paragraphs(spark, copies):
    """Paragraphs that occur many times do not vanish from the sums."""
    frame = spark.createDataFrame([("a\n" * copies, "b\n" * copies, "a\n" * copies + "b", "a\n" * (copies // 2) + "b\n" * (copies // 2))],
                                  "a string, b string, more string, half string")
    prints = frame.select(*(fingerprint.fingerprint(c).alias(c) for c in frame.columns)).select(
        "*", fingerprint.fingerprint("'b'").alias("one"))
    row = prints.select(
        F.expr("a = b").alias("equal"), fingerprint.likeness("a", "b").alias("near"), fingerprint.likeness("a", "half").alias("half"),
        (fingerprint.delete(F.col("more"), F.col("one")) == F.col("a")).alias("deleted"),
        fingerprint.text_of("a").alias("x"), fingerprint.text_of("b").alias("y")).first()
    assert not row["equal"] and row["x"] != row["y"] and len(row["x"]) == len(row["y"]) and row["deleted"]
    assert row["near"] < 0.3 < 0.5 < row["half"]


def test_neighbours_over_ranges(make_docs):
    rows = [(n * n % 101 - 20, prose(n, 20 + n, 2)) for n in range(1, 51)] + [(500, None), (501, "")]
    one = sorted(map(tuple, fingerprint.edited_documents(make_docs(rows)).collect()))
    many = sorted(map(tuple, fingerprint.edited_documents(make_docs(rows), range_chars=700).collect()))
    assert one == many
    order = sorted((k, t or "") for k, t in rows)
    by = {r[0]: r for r in one}
    for (k, t), (_, f) in zip(order, order[1:] + order[:1]):
        n = len(t)
        same = [x for x in order if x[0] == k]
        if len(same) == 1:
            edited = t[:n - n // 4] + f[:n // 4]
            assert by[k][1:3] == (n, hashlib.sha256(edited.encode()).hexdigest())
