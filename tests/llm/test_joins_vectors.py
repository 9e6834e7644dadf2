"""Jaccard join, whitening and hard negatives against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import EDGES, prose

from sieveline.llm import jaccard, negatives, whitening
from sieveline.llm.queries import QUERIES


# --- Jaccard join -----------------------------------------------------------------------

def plain_set(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[n:n + size]) for n in range(len(words) - size + 1)} or ({" ".join(words)} if words else set())


def plain_join(rows, percent=90):
    """(key, size, component) of every row, sorted."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = []
    for n, (k, _) in enumerate(rows):
        keys = [rows[m][0] for m in range(len(rows)) if find(m) == find(n) and rows[m][0] is not None]
        out.append((k, len(sets[n]), min(keys) if sets[n] and keys else k))
    return sorted(out, key=repr)


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        n = rng.randrange(len(words))
        action = rng.randrange(3)
        if action == 0:
            words[n] = f"w{rng.randrange(10**6)}"
        elif action == 1:
            del words[n]
        else:
            words.insert(n, f"w{rng.randrange(10**6)}")
    return words


def similar_texts(seed, groups=8, size=9):
    """Groups of texts about as alike as the limit asks, of many sizes, with passages that all of them share."""
    rng = random.Random(seed)
    out, shared = [], [f"s{n}" for n in range(30)]
    for g in range(groups):
        n = rng.choice((7, 10, 12, 13, 14, 20, 40, 90, 300))
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(n)] + shared[:rng.choice((0, 5, 12, 30))]
        out += [" ".join(edited(rng, base, rng.randint(0, 1 + len(base) // 40))) for _ in range(size)]
    return out + out[:5] + ["", None, "one", "One", "one two", "A b c", "a B C"]


@pytest.mark.parametrize("seed, percent", [(1, 90), (2, 90), (3, 90), (4, 75), (5, 94)])
def test_linked_sets_share_a_column_block(seed, percent):
    known = jaccard.Words()
    sets = [jaccard.shingle_set(t, known) for t in similar_texts(seed, 20, 12)]
    blocks = [set(jaccard.column_blocks(s, percent).tolist()) for s in sets]
    links = shared = 0
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if len(sets[a]) and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and set(sets[a]) != set(sets[b]):
                links += 1
                assert blocks[a] & blocks[b]
            shared += bool(blocks[a] & blocks[b])
    assert links > 10 and shared < len(sets) * (len(sets) - 1) / 4


def test_every_size_of_sets_shares_a_block():
    rng = np.random.default_rng(5)
    for n in list(range(9, 80)) + [150, 333, 1000, 4000]:
        for _ in range(6):
            both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            most = n + n * 100 // 90
            apart = n - jaccard.needed(n, n * 100 // 90)
            a, b = both, np.concatenate([both[apart:], rng.integers(0, 1 << 63, n * 100 // 90 - n + apart, dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            assert len(a) + len(b) <= most
            assert set(jaccard.column_blocks(a).tolist()) & set(jaccard.column_blocks(b).tolist())


@pytest.mark.parametrize("columns", [4096, 7])
def test_product_in_tiles(columns):
    known = jaccard.Words()
    sets = [jaccard.shingle_set(t, known) for t in similar_texts(6)]
    linked = jaccard.overlapping(sets, columns=columns)
    for a in range(len(sets)):
        for b in range(len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            union = len(sets[a]) + len(sets[b]) - both
            assert linked[a, b] == (a != b and union > 0 and 100 * both >= 90 * union)


@pytest.mark.parametrize("blocked", [{}, {"rows": 4}, {"shingles": 60}])
def test_join_against_all_pairs(spark, make_docs, blocked):
    rows = [(100 - n, t) for n, t in enumerate(similar_texts(7))]
    got = jaccard.join(make_docs(rows, clashing=True), **blocked).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == plain_join(rows)


def test_join_of_awkward_tables(edges, nothing):
    rows = [(e[0], e[1]) for e in EDGES]
    got = jaccard.join(edges).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == plain_join(rows)
    assert jaccard.join(nothing).collect() == []


def test_a_chain_in_a_split_block(make_docs):
    # neighbours link, the ends do not; a block of rows is split among them
    words = [f"w{n}" for n in range(400)]
    rows = [(n, " ".join(words[4 * n:4 * n + 120])) for n in range(40)] + [(50, prose(1))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(make_docs(rows), rows=3).collect()}
    assert got == {k: c for k, _, c in plain_join(rows)}


# --- whitening --------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, x string, k string, deviation string"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, label, "x", "k", "d") for k, v, label in rows], VECTORS)


def plain_whitening(rows, components=4):
    """Vector id to (deviation, whitened), and the shares explained."""
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] for _, v in rows], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = fit - s / n
    values, turn = np.linalg.eigh(z.T @ z / n)
    values, turn = values[::-1][:components], turn[:, ::-1][:, :components]
    white = (x - s / n) @ turn / np.sqrt(values)
    return [int(((n * r - s) ** 2).sum()) for r in x], white, values / np.trace(z.T @ z / n), n


def spectrum(seed, n, d, flat):
    rng = np.random.default_rng(seed)
    scale = np.ones(d) if flat else 1 / np.sqrt(1 + np.arange(d))
    rows = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((n, d)).astype(np.float32) * scale.astype(np.float32))]
    return rows + [(n + k, rows[0][1]) for k in range(n // 3)]  # a third of all rows are copies


@pytest.mark.parametrize("n, d, flat", [(600, 48, True), (300, 70, False), (40, 5, True), (50, 90, False), (60, 3, False)])
def test_whitening_against_the_whole_covariance(spark, n, d, flat):
    rows = spectrum(n, n, d, flat)
    got = whitening.digest(*whitening.whiten(vectors(spark, [(k, v, 1) for k, v in rows]))).collect()
    deviation, white, explained, length = plain_whitening(rows)
    top = min(4, d)
    assert len(got) == top * len(rows)
    found = np.zeros_like(white)
    for r in got:
        found[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[r["vec_id"]] and r["n"] == length
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-10 and r["identity_error"] < 1e-10
    for c in range(top):
        sign = np.sign(found[:, c] @ white[:, c])
        assert np.abs(found[:, c] - sign * white[:, c]).max() < 1e-7


def test_iteration_uses_products_alone_and_is_certified():
    rng = np.random.default_rng(3)
    base = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    spread = np.concatenate([[5, 4, 3.9, 3.8, 3.7], np.linspace(3, 0.1, 195)])
    matrix, blocks = (base * spread) @ base.T, []

    def times(q):
        blocks.append(q.shape)
        return matrix @ q
    values, vectors_, residual, certified = whitening.leading(times, 200, 4, lambda: spread.sum())
    assert certified and residual < 1e-12 and np.allclose(values, spread[:4], atol=1e-11)
    assert np.abs(np.abs((base[:, :4] * vectors_).sum(axis=0)) - 1).max() < 1e-11
    assert max(b[1] for b in blocks) <= 32


def test_filter_damps_the_unwanted_spectrum():
    values = np.array([4.0, 3.0, 2.0, 1.0, 0.5, 0.0])
    times = lambda q: values[:, None] * q
    q = np.eye(6)
    out = np.abs(np.diag(whitening._filtered(times, q, times(q), 2.0, 4.0, 10)))
    assert abs(out[0] - 1) < 1e-12 and out[2:].max() <= 1.0001 * out[2] < 1e-4 and out[1] > 100 * out[2]


def test_whitening_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = spectrum(9, 30, 3, False)
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, nan, 2.0]), (103, [inf, 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    got = whitening.digest(*whitening.whiten(vectors(spark, [(k, v, None) for k, v in good + bad] + [(None, good[3][1], 1)]))).collect()
    assert {r["vec_id"] for r in got} == {k for k, _ in good} | {None}
    for rows in ([], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], bad[:5]):  # no rows, one distinct vector, none that is left
        assert whitening.digest(*whitening.whiten(vectors(spark, [(k, v, 1) for k, v in rows]))).collect() == []
    line = [(k, [float(k), 2.0 * k, 0.0]) for k in range(5)]  # one component alone
    assert {r["component"] for r in whitening.digest(*whitening.whiten(vectors(spark, [(k, v, 1) for k, v in line]))).collect()} == {1}
    # exact beyond 64 bits: such deviations are decimals in the operator's rows, and null as a long
    huge = [(k, [1e15 * k, 1.0 + k, 5.0]) for k in range(6)]
    model, rows = whitening.whiten(vectors(spark, [(k, v, 1) for k, v in huge]))
    x = [[int(np.floor(256 * float(np.float32(c)))) for c in v] for _, v in huge]
    sums = [sum(c) for c in zip(*x)]
    assert model.sums == sums
    assert {r["k"]: int(r["deviation"]) for r in rows.collect()} == {
        k: sum((6 * c - s) ** 2 for c, s in zip(v, sums)) for k, v in enumerate(x)}
    assert whitening.digest(model, rows).filter("deviation IS NULL").count() > 0


# --- hard negatives ---------------------------------------------------------------------

def plain_negatives(rows, step=100):
    x = {k: [int(np.floor(256 * float(np.float32(c)))) for c in v] for k, v, _ in rows}
    label = {k: y for k, _, y in rows}
    out = []
    for a in sorted(x):
        if a % step:
            continue
        ranked = sorted(((-sum(p * q for p, q in zip(x[a], x[b])), b) for b in x if b != a))
        for s, p in [r for r in ranked if label[r[1]] == label[a]][:5]:
            hard = [(n, -t) for t, n in ranked if label[n] != label[a] and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, p, rank + 1, n, -s, t) for rank, (n, t) in enumerate(hard)]
    return sorted(out)


def mined(frame):
    return sorted(tuple(int(v) for v in r) for r in frame.collect())


def some_rows(seed, n, d, kind):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, d)) / np.sqrt(d) if kind != "whole" else rng.integers(-2, 3, (n, d)) / 16
    if kind == "huge":
        v = v * 1e6
    rows = [(k, x.astype(np.float32).tolist(), int(rng.integers(0, 4))) for k, x in enumerate(v)]
    return rows + [(n + k, rows[7][1], k % 4) for k in range(n // 3)]  # equal vectors, equal scores


@pytest.mark.parametrize("n, d, kind, sizes", [
    (400, 24, "plain", {}), (400, 24, "plain", {"block": 64, "portion": 500}), (300, 5, "whole", {}), (200, 12, "huge", {}),
    (250, 1, "plain", {}), (300, 32, "whole", {"block": 50})])
def test_negatives_against_all_pairs(spark, n, d, kind, sizes):
    rows = some_rows(n + d, n, d, kind)
    got = mined(negatives.mine(vectors(spark, rows), anchors="vec_id % 20 = 0", **sizes))
    assert got == plain_negatives(rows, 20)
    assert got


def test_numbers_beyond_doubles(spark):
    rows = [(k, [1e14 + k * 1e10, 1.0 + k, -2.0 * k], k % 2) for k in range(12)]
    assert mined(negatives.mine(vectors(spark, rows), anchors="vec_id % 4 = 0")) == plain_negatives(rows, 4)
    assert negatives.kind_of(1e30) is object


def test_a_scan_leaves_rows_out_early():
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, (2000, 32))
    x[:, 0] = rng.integers(-9000, 9000, 2000)
    block = negatives.Block(np.arange(2000), np.zeros(2000, np.int64), x, np.float64)
    q = x[5].copy()
    q[0] = 9000
    exact = x @ q
    rows, scores = block.scan(q, slice(0, 2000), np.sort(exact)[-5])
    assert sorted(rows.tolist()) == sorted(np.flatnonzero(exact >= np.sort(exact)[-5]).tolist())
    assert (scores == exact[rows]).all()
    rows, scores = block.scan(q, slice(0, 2000), -np.inf, best=6)
    assert set(np.argsort(-exact)[:6].tolist()) <= set(rows.tolist()) and len(rows) < 200


def test_negatives_of_awkward_rows(spark):
    good = some_rows(5, 120, 6, "plain")
    bad = [(1000, None, 1), (2000, [1.0], 1), (300, [None] * 6, 1), (400, [float("nan")] * 6, 2), (500, good[0][1], None),
           (None, good[1][1], 1)]
    again = [(7, good[7][1], good[7][2]), (8, good[9][1], good[8][2] + 10)]  # a repeated row and a repeated key
    got = mined(negatives.mine(vectors(spark, good + bad + again), anchors="vec_id % 20 = 0"))
    assert got == plain_negatives(good, 20)
    assert negatives.mine(vectors(spark, [])).collect() == []
    assert negatives.mine(vectors(spark, [(100, [1.0], 1)])).collect() == []
    assert negatives.mine(vectors(spark, [(1, [1.0], 1)])).collect() == []


def test_query_changes_labels(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in rows]
    frame = QUERIES["op13_bond_negatives"](spark, sf_dir)
    assert dict(frame.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint",
                                  "positive_score": "bigint", "negative_score": "bigint"}
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert mined(frame.select(*[F.col(c) for c in columns])) == plain_negatives(rows)
