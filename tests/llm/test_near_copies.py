"""SimHash and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from samples import prose

from sieveline.llm import simhash
from sieveline.llm.components import components


def roots_of(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def plain_fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, "One", "a b c", "a b c d", "A b c d\x0be f ÀÉ x", "la " * 900, prose(5, 700)])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_in_pieces(monkeypatch):
    text = prose(6, 2000)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 300)
    assert simhash.fingerprint(text) == whole


def near_prints(seed, groups=6, size=40):
    """Clusters of close fingerprints, chains of them, and far ones."""
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(groups):
        centre = rng.getrandbits(64)
        for _ in range(size):
            out.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
        for _ in range(12):  # a chain
            centre ^= sum(1 << b for b in rng.sample(range(64), 4))
            out.add(centre)
    out.update(rng.getrandbits(64) for _ in range(60))
    return sorted(out)


@pytest.mark.parametrize("block, small", [(2048, 32), (2048, 2), (7, 3)])
def test_links_connect_all_near_prints(spark, block, small):
    prints = near_prints(3)
    signed = [simhash._signed(p) for p in prints]
    number = {p: n for n, p in enumerate(signed)}
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = [(number[r["u"]], number[r["v"]]) for r in simhash.links(frame, 4, block, small).collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= 4 for a, b in found)
    every = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert roots_of(len(prints), found) == roots_of(len(prints), every)
    # no bucket with all pairs: within a bucket a forest, and a bucket for every two blocks
    assert block < 2048 or small > 2 or len(found) <= 15 * len(prints)


def test_table_discards_no_link():
    prints = np.array(near_prints(4), np.uint64)
    table = simhash.distance_table(prints, simhash.references())
    x, y = np.triu_indices(len(prints), 1)
    left = set(simhash.survivors(table, x, y, 4).tolist())
    near = np.flatnonzero(np.bitwise_count(prints[x] ^ prints[y]) <= 4)
    assert left.issuperset(near.tolist())
    assert len(left) < len(x) / 4


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(n, n + 1) for n in range(400, 460)]
    links += [(500, n) for n in range(501, 640)] + [(7, 7)]
    roots = roots_of(640, links)
    found = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert [found.get(n, n) for n in range(640)] == roots
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_near_copies_of_texts(spark, make_docs):
    rng = random.Random(1)
    rows, base = [], prose(20, 400).split()
    for n in range(60):
        words = list(base)
        words[rng.randrange(len(words))] = f"new{n}"
        rows.append((100 - n, " ".join(words)))
    rows += [(200 + n, prose(30 + n)) for n in range(10)] + [(300, prose(30)), (301, ""), (302, None)]
    prints = [plain_fingerprint(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    roots = roots_of(len(rows), links)
    least = {r: min(rows[n][0] for n in range(len(rows)) if roots[n] == r) for r in set(roots)}
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(make_docs(rows)).collect()}
    assert got == {rows[n][0]: (simhash._signed(prints[n]), least[roots[n]]) for n in range(len(rows))}
    kept = [r["doc_id"] for r in simhash.one_of_each(make_docs(rows + rows[:5])).collect()]
    assert sorted(kept) == sorted(least.values())
