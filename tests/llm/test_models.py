"""Language, toxicity, quality, mixing, packing, secrets and URL terms against plain computations and held-out rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from samples import prose
from pyspark.sql import functions as F

from sieveline.llm import language, mixing, packing, quality, secrets, toxicity, url_filter
from sieveline.llm.queries import QUERIES


# --- language ------------------------------------------------------------------------------

def plain_subwords(text):
    s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    out = []
    for n in language.ORDERS:
        for i in range(len(s) - n + 1):
            gram = s[i:i + n]
            if " " not in gram[1:-1] and gram.strip():
                out.append((n, gram))
    return out


@pytest.mark.parametrize("piece", [1 << 18, 7])
def test_subwords(monkeypatch, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    letters = language._letters()
    for text in ("", "a", "ab cd", "Été à l'ombre; x9y", "one two three four"):
        found = np.sort(np.concatenate([np.zeros(0, np.uint32), *language.subwords(text, letters)]))
        assert len(found) == len(plain_subwords(text))
        whole = np.sort(np.concatenate([np.zeros(0, np.uint32), *language.subwords(" " + text + "  ", letters)]))
        assert (whole == found).all()


def test_languages_held_out(spark, sf_dir):
    rows = QUERIES["op6_subword_language"](spark, sf_dir).join(
        spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 20 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows) and not any(r["rejected"] for r in held if r["score"] > 0.5)


@pytest.mark.parametrize("known", [("en", "fr"), ("de", "en", "es", "fr")])
def test_foreign_texts_go_and_short_clean_texts_stay(spark, make_docs, known):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taught = docs.filter(F.col("lang").isin(*known))
    model = language.train(taught.filter(~language.held_out()), "doc_id", "text", "lang")
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "xkqzj wvbqx zzkjq pqxwv kjhgf qwzxv bvnmq xzqjk wkqpz vxqzj kqjwx zvbxk qpwjz xvkqz jwqxk pzvqx kwjzq"]
    got = language.identify(make_docs(list(enumerate(foreign))), model).collect()
    assert all(r["_language"]["rejected"] for r in got), got
    others = language.identify(docs.filter(~F.col("lang").isin(*known) & (F.length("text") > 500)), model).collect()
    assert sum(r["_language"]["rejected"] for r in others) >= 0.95 * len(others)
    held = taught.filter(language.held_out())
    short = held.select("doc_id", F.explode(F.array(F.substring("text", 1, 30), F.substring_index("text", " ", 4), "text")).alias("text"))
    kept = language.identify(short, model).filter("text RLIKE '[a-z]'").collect()
    assert len(kept) > 200 and sum(r["_language"]["rejected"] for r in kept) <= 0.005 * len(kept)


# --- toxicity ------------------------------------------------------------------------------

def test_noisy_or_and_places(spark):
    weights = np.zeros(toxicity.BUCKETS, np.float32)
    weights[toxicity.word_features("vile")[0]] = 7.0
    texts = ["Good day. You VILE thing! Fine", "good day", "", None, "vile\nvile"]
    frame = toxicity.assess(spark.createDataFrame([(t,) for t in texts], "text string"), (weights, -4.0))
    got = [r["_toxicity"] for r in frame.collect()]

    def p(z):
        return 1 / (1 + math.exp(-z))
    assert got[0]["score"] == pytest.approx(1 - (1 - p(-4)) ** 2 * (1 - p(3)))
    assert got[1]["score"] == pytest.approx(p(-4)) and got[2]["score"] == got[3]["score"] == 0
    assert got[4]["score"] == pytest.approx(1 - (1 - p(3)) ** 2)
    assert [(s["begin"], s["end"]) for s in got[0]["offending"]] == [(10, 24)] and got[0]["predicted"] == 1
    assert [(s["begin"], s["end"]) for s in got[4]["offending"]] == [(0, 4), (5, 9)]


def test_toxic_sentences_are_learnt_from_documents():
    rng = random.Random(2)
    examples, held = [], []
    for n in range(600):
        lines = [prose(rng.randrange(10**6), 12, 1) for _ in range(5)]
        toxic = n % 5 == 0
        if toxic:
            lines[rng.randrange(5)] += " you " + rng.choice(["dolt", "cretin", "cretinous", "dunce"])
        (examples if n % 4 else held).append((*toxicity.sentences(". ".join(lines)), int(toxic)))
    weights, bias = toxicity.fit(examples)
    right = 0
    for flat, starts, label in held:
        p = 1 / (1 + np.exp(-(np.add.reduceat(weights[flat], starts) + bias)))
        right += (1 - np.prod(1 - p) >= 0.5) == label
    assert right >= 0.97 * len(held)


def test_toxicity_held_out(spark):
    """More rows than the smallest table has are needed to learn from."""
    rows = QUERIES["op9_sentence_toxicity"](spark, "/root/testdata/sf0.1").join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").collect()
    clean, toxic = [[r["predicted"] for r in rows if r["toxic"] == t] for t in (0, 1)]
    assert sum(clean) <= 0.01 * len(clean) and sum(toxic) >= 0.8 * len(toxic)


# --- quality -------------------------------------------------------------------------------

def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(words) < 400 else None
    covered = None if twice is None else len({i + o for i, w in enumerate(windows) if w in twice for o in range(3)})
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), covered)


def test_counts(make_docs):
    rng = random.Random(4)
    rows = [(n, " ".join(rng.choice(["a", "bé", "c#", "d|", "\n", "e\n", "\t"]) for _ in range(rng.randint(0, 90)))) for n in range(80)]
    rows += [(100, None), (101, ""), (102, "x\n\n x\nx\n"), (103, "a b"), (104, "a b c a b c")]
    got = {r["doc_id"]: tuple(r)[1:6] for r in quality.counted(make_docs(rows)).collect()}
    assert got == {k: plain_counts(t) for k, t in rows}


def test_estimation_finds_planted_rates():
    rng = np.random.default_rng(1)
    rules = [(f"r{j}", -1 if j < 4 else 1, "") for j in range(7)]
    good, bad = [0.02, 0.05, 0.01, 0.03, 0.9, 0.85, 0.95], [0.4, 0.5, 0.3, 0.6, 0.1, 0.3, 0.2]
    truth = rng.random(20000) < 0.8
    fires = np.where(truth[:, None], rng.random((20000, 7)) < good, rng.random((20000, 7)) < bad)
    votes, counts = np.unique(fires * np.array([r[1] for r in rules]), axis=0, return_counts=True)
    share, g, b = quality.estimate([(tuple(v), int(c)) for v, c in zip(votes.tolist(), counts)], rules)
    assert share == pytest.approx(0.8, abs=0.02)
    assert np.allclose(g, good, atol=0.03) and np.allclose(b, bad, atol=0.05)


def test_quality_against_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.judge(docs).withColumnRenamed("quality", "p").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("NOT base_failed").collect()
    assert all(r["kept"] == (r["quality"] == 1) for r in rows)


# --- mixing --------------------------------------------------------------------------------

def test_rates_reach_the_least_squares_minimum(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4, 0.3, 0.2], 300)
    t = rng.integers(0, 900, 300)
    frame = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p)], "tokens long, p array<double>").repartition(4)
    total = t.sum()
    for goal in ([0.5, 0.3, 0.2], [0.9, 0.05, 0.0], [0.2, 0.2, 3.5]):
        rated, error = mixing.fit_rates(frame, goal, steps=60, tolerance=1e-7)
        got = rated.select("tokens", "p", "r").collect()
        t2, p2, r = (np.array([x[k] for x in got]) for k in range(3))
        best = np.ones(300)
        for _ in range(20000):
            best = np.clip(best - 1.0 * p2 @ ((t2 * best) @ p2 / total - goal), 0, mixing.MOST)
        assert np.linalg.norm((t2 * r) @ p2 / total - goal) <= np.linalg.norm((t2 * best) @ p2 / total - goal) + 1e-3
        assert r.min() >= 0 and r.max() <= mixing.MOST


def test_mixture_comes_as_near_its_targets_as_any(spark, sf_dir):
    rows = QUERIES["op1_soft_mixture"](spark, sf_dir).collect()
    t = np.array([r["tokens"] for r in rows])
    p = np.array([[r[f"p_{d}"] for d in sorted(mixing.TARGETS)] for r in rows])
    goal = np.array([mixing.TARGETS[d] for d in sorted(mixing.TARGETS)])
    best = np.ones(len(t))
    for _ in range(3000):
        best = np.clip(best - p @ ((t * best) @ p / t.sum() - goal), 0, mixing.MOST)

    def error(rates):
        return np.linalg.norm((t * rates) @ p / t.sum() - goal)
    assert error(np.array([r["rate"] for r in rows])) <= error(best) + 0.005
    assert np.allclose(p.sum(axis=1), 1)
    assert all(math.floor(r["rate"]) <= r["copies"] <= math.ceil(r["rate"]) for r in rows)


def test_scarce_domains_reach_their_targets(spark):
    """Toxic tokens are four in a thousand, two in a hundred are wanted: rates over 4 are needed."""
    rng = np.random.default_rng(8)
    p = rng.dirichlet([6, 0.5, 0.02], 3000)
    p[rng.random(3000) < 0.004] = [0.01, 0.01, 0.98]
    t = rng.integers(1, 900, 3000)
    frame = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p)], "tokens long, p array<double>").repartition(4)
    goal = [0.9, 0.08, 0.02]
    assert (t @ p / t.sum())[2] < goal[2] / 3
    rated, shares = mixing.fit_rates_and_shares(frame, goal)
    got = rated.collect()
    rates = np.array([r["r"] for r in got])
    reached = (np.array([r["tokens"] for r in got]) * rates) @ np.array([r["p"] for r in got]) / t.sum()
    assert np.allclose(reached, goal, atol=2e-4) and np.allclose(shares, reached) and rates.min() >= 0
    bounded, shares = mixing.fit_rates_and_shares(frame, goal, most=1.2)
    assert max(r["r"] for r in bounded.collect()) <= 1.2 and shares[2] < goal[2] - 1e-3


def test_unmeetable_targets_move_rates_a_little(spark):
    """Posteriors that tell nothing apart, tokenless documents, a domain without any document."""
    rng = np.random.default_rng(5)
    flat = np.array([0.4, 0.35, 0.25]) + rng.normal(0, 1e-4, (50, 3))
    for p, goal in ((flat, [0.9, 0.08, 0.02]), (np.tile([0.5, 0.5, 0.0], (50, 1)), [0.3, 0.2, 0.5]),
                    (np.eye(3)[rng.integers(0, 2, 50)], [0.5, 0.3, 0.2])):
        t = [0 if n % 10 == 0 else int(x) for n, x in enumerate(rng.integers(1, 900, 50))]
        frame = spark.createDataFrame([(a, b.tolist()) for a, b in zip(t, p)], "tokens long, p array<double>").repartition(3)
        rated, shares = mixing.fit_rates_and_shares(frame, goal)
        got = rated.collect()
        assert all(r["r"] == 1 for r in got if not r["tokens"])
        assert max(r["r"] for r in got) <= mixing.TRUST and np.linalg.norm(shares - np.array(goal)) > 0.05
        reached = np.sum([r["tokens"] * r["r"] * np.array(r["p"]) for r in got], axis=0) / sum(t)
        assert np.allclose(reached, shares)
    # a domain that nothing can bring does not spoil the others
    assert np.allclose(shares[:2], [0.5, 0.3], atol=1e-2)


def test_rates_follow_the_projected_gradient(spark):
    """Steps of the operator are those of the formula, document by document."""
    rng = np.random.default_rng(6)
    p, t = rng.dirichlet([1, 1, 1], 40), rng.integers(0, 99, 40)
    frame = spark.createDataFrame([(n, int(a), b.tolist()) for n, (a, b) in enumerate(zip(t, p))], "n int, tokens long, p array<double>")
    rates = mixing.Rates(frame, 3, most=1.5)
    now = np.ones(40)
    for n in range(mixing.HELD + 3):
        shares, free = rates.sums(float(t.sum()))
        assert np.allclose(shares, (t * now) @ p / t.sum())
        moving = (now > 0) & (now < 1.5)
        assert np.allclose(free, (p[moving] * t[moving, None]).T @ p[moving] / t.sum())
        gradient = rng.normal(0, 0.3, 3)
        rates.step(rng.normal(0, 0.3, 3))
        rates.back()
        rates.step(gradient)
        now = np.where(t > 0, np.clip(now - p @ gradient, 0, 1.5), 1.0)
    got = {r["n"]: r["r"] for r in rates.rated().collect()}
    assert np.allclose([got[n] for n in range(40)], now)


# --- packing -------------------------------------------------------------------------------

def test_documents_round_trip(spark, make_docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [prose(n, 5 + 37 * n % 3000, 3) for n in range(60)] + [
        "a b\x1cc\x85d é <|endoftext|> it's 'll x y\r\nZ", "Ⅷ ﬁ ß İ ΑΣ", "", None, "word " * 9000, "1 " * 2047]
    rows = list(enumerate(texts))
    ids = {k: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for k, t in rows}
    pieces = packing.pack_documents(make_docs(rows).repartition(3)).collect()
    for k, want in ids.items():
        at = 0
        for r in sorted((r for r in pieces if r["doc_id"] == k), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(want))
            assert r["ids_crc32"] == zlib.crc32(want[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want)
    for _, group in itertools.groupby(sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in group:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0


def test_words_are_remembered_within_a_bound(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(12)
    odd = ["It's", "we'll,", "!'s", "...", "#%&", "x" * 70, "A1b2", "ÀÉ.", "ª", "don't!!", "'", "É" * 60 + ",", "--", "a.b.c"]
    texts = [" ".join(rng.choice([prose(rng.randint(0, 10 ** 6), 1, 1), *odd]) for _ in range(rng.randint(0, 60)))
             for _ in range(300)]
    monkeypatch.setattr(packing, "REMEMBERED", 20_000)
    monkeypatch.setattr(packing, "GROUP_CHARS", 700)
    words, got = packing._Words(None), []
    for some, _ in packing._groups(texts, texts):
        got += words.encode(some)
        assert max(map(len, words.known)) <= packing.LONGEST
        assert words.held == sum(packing.ENTRY + len(w) + len(i) for w, i in words.known.items() if w)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1], text


def test_sequences_carry_the_ids_of_their_pieces(spark, make_docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [prose(n, 5 + 37 * n % 1500, 3) for n in range(40)] + ["", None] * 1500
    want = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for k, t in enumerate(texts)}
    pieces = packing.pack_documents(make_docs(list(enumerate(texts))).repartition(2), with_ids=True)
    found, of_documents = packing.sequences(pieces).collect(), {}
    for r in found:
        assert len(r["segments"]) <= 512 and r["n_tokens"] == sum(r["mask"]) <= 2048
        assert len(r["ids"]) == len(r["mask"]) == r["n_tokens"], "powers of two take no padding"
        assert [s["offset"] for s in r["segments"]] == list(itertools.accumulate([0] + [s["length"] for s in r["segments"]]))[:-1]
        for s in r["segments"]:
            of_documents.setdefault(s["key"], {})[s["start"]] = r["ids"][s["offset"]:s["offset"] + s["length"]]
    assert max(len(r["segments"]) for r in found) == 512, "the limit of segments binds"
    assert {k: [i for _, ids in sorted(v.items()) for i in ids] for k, v in of_documents.items()} == want
    odd = spark.createDataFrame([(1, 0, 2, 7, 0, [5, 6]), (2, 4, 1, 7, 2, [9])],
                                "doc_id long, start long, length long, sequence_id long, offset long, ids array<int>")
    row = packing.sequences(odd, full=8, padding=3).first()
    assert row["ids"] == [5, 6, 9, 3, 3, 3, 3, 3] and row["mask"] == [1, 1, 1, 0, 0, 0, 0, 0]


def test_examples_stay_whole_within_all_limits(spark):
    rng = random.Random(6)
    rows = [(n, rng.randint(1, 900), rng.randint(0, 300)) for n in range(800)] + [(900, 5000, 10), (901, None, None), (902, 10, 2000)]
    frame = spark.createDataFrame(rows, "id long, n long, m long").repartition(2)
    limits = (2048, 6, 700)
    packed = packing.pack_examples(frame, "id", "n", "m", limits).collect()
    assert sorted(r["id"] for r in packed) == [r[0] for r in rows]
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append(r)
    for group in bins.values():
        ends = [r["offset"] + r["n_tokens"] for r in sorted(group, key=lambda r: (r["offset"], r["n_tokens"]))]
        assert [r["offset"] for r in sorted(group, key=lambda r: (r["offset"], r["n_tokens"]))] == [0, *ends[:-1]]
        assert len(group) == 1 or (ends[-1] <= limits[0] and len(group) <= limits[1] and sum(r["n_loss"] for r in group) <= limits[2])
    least = max(sum(r[1] or 0 for r in rows[:800]) / limits[0], 800 / limits[1], sum(r[2] or 0 for r in rows[:800]) / limits[2])
    assert len(bins) <= 1.15 * least + 5


# --- secrets -------------------------------------------------------------------------------

RANKS = {w: n + 1 for n, w in enumerate((*secrets.USUAL, "the", "house", "blue"))}


def plain_segments(text):
    """Every segment by its definition, from scratch."""
    n = len(text)
    for i in range(n):
        for j in range(i + 1, n + 1):
            part = text[i:j]
            if j == i + 1:
                yield i, j, secrets.spelt(part)
            if 3 <= j - i <= 24:
                yield from ((i, j, b) for b in (secrets.word_bits(part, RANKS), secrets.walk_bits(part)) if b is not None)
            for pattern, bits in zip(secrets._DATES, secrets._DATE_BITS):
                if re.fullmatch(pattern, part):
                    yield i, j, bits
            for unit in range(1, 9):
                times = (j - i) // unit
                whole = times * unit == j - i and part == part[:unit] * times
                if whole and times >= (3 if unit == 1 else 2) and text[j:j + unit] != part[:unit]:
                    named = secrets.word_bits(part[:unit], RANKS) if unit >= 3 else None
                    bits = secrets.spelt(part[:unit])
                    yield i, j, (bits if named is None else min(named, bits)) + math.log2(times)


@pytest.mark.parametrize("value", ["aaaaaa", "abababab9", "dragondragon1999", "qwerty2020-01-31xx", "P@ssw0rdP@ssw0rd!", "xyzxyzx",
                                   "1234512345123", "aabaabaab", "a", "zz", "monkeyMONKEY12.05.1987"])
def test_segments_by_definition(value):
    assert sorted(set(secrets.segments(value, RANKS))) == sorted(set(plain_segments(value)))
    whole = secrets.guess_bits(value, RANKS)
    for enough in (5.0, 20.0, 36.0, 200.0):
        assert (secrets.guess_bits(value, RANKS, enough) >= enough) == (whole >= enough)


def test_long_values_take_linear_time():
    import random
    import time
    rng = random.Random(1)
    for value in ("a" * 1_000_000, "ab" * 500_000, "".join(rng.choice("abcXYZ123!") for _ in range(1_000_000))):
        begin = time.process_time()
        assert (secrets.guess_bits(value, RANKS, secrets.MIN_BITS) >= secrets.MIN_BITS) == (len(set(value)) > 2)
        assert time.process_time() - begin < 60
    begin = time.process_time()
    secrets.guess_bits("a" * 8000, RANKS)
    assert time.process_time() - begin < 5


def plain_bits(text):
    """The least bits over all segmentations, tried one by one."""
    costs = {}
    for i, j, bits in secrets.segments(text, RANKS):
        costs[i, j] = min(bits, costs.get((i, j), math.inf))
    best = math.inf
    for cuts in range(1 << (len(text) - 1)):
        places = [0, *(i + 1 for i in range(len(text) - 1) if cuts >> i & 1), len(text)]
        spans = list(zip(places, places[1:]))
        best = min(best, sum(costs.get(s, math.inf) + (1 if s[0] and s[1] > s[0] + 1 else 0) for s in spans))
    return best


@pytest.mark.parametrize("value", ["blue2019", "Passw0rd", "aaaa7", "qwert!", "abcabc", "x9$Kq2", "19990412", "hou5eblue", "a"])
def test_least_guesses(value):
    assert secrets.guess_bits(value, RANKS) == pytest.approx(plain_bits(value))


def test_named_parts_are_cheap():
    spelt = secrets.spelt
    for value in ("blue", "BLUE", "h0use", "20190412", "12-04-2019", "aaaaaaaa", "xyxyxyxy", "qwertyuiop", "abcdefgh", "87654321"):
        assert secrets.guess_bits(value, RANKS) < spelt(value) / 1.3, value
    assert secrets.guess_bits("x9$Kq2!vLp7z", RANKS) >= secrets.MIN_BITS > secrets.guess_bits("blue2019!", RANKS)


def test_spans():
    cases = {
        "Token = 'abc' secret:abcdef": [("assign", 14, 27)],
        "secret=token: abcdefgh": [],
        "API_KEY: abc123def, apikey=\"xyz\"": [("assign", 0, 18)],
        "éé AKIA" + "A1" * 8 + " AKIAshort": [("access", 3, 23)],
        "0123456789abcdef01234567 0123456789abcdef0123456": [("hex", 0, 24)],
        "pwd: x9$Kq2!vLp7z": [("guess", 5, 17)],
        "pwd: blue2019 the pin: 123456": [],
        "see ftp://bob:Zq8!kfP2wm@host/x": [("guess", 14, 24)],
        "PAſſword = abcdefg": [],
        "token=" + "f" * 30: [("assign", 0, 36), ("hex", 6, 36)],
    }
    for text, want in cases.items():
        assert [(secrets.KINDS[k], s, e) for s, k, e in secrets.all_spans(text, RANKS)] == want, text


def test_values_past_the_base_pattern_are_judged_whole(spark):
    text = "password: hunter22!Zq8#kf$2 and more"
    spans = [(secrets.KINDS[k], s, e) for s, k, e in secrets.all_spans(text, RANKS)]
    assert spans == [("assign", 0, 18), ("guess", 10, 27)]
    docs = spark.createDataFrame([(1, text), (2, "password: hunter22x and more")], "doc_id long, text string")
    assert [r["text"] for r in secrets.redact(docs, RANKS).orderBy("doc_id").collect()] == ["[SECRET] and more"] * 2
    found = secrets.digest(secrets.find_secrets(docs, RANKS)).orderBy("doc_id").first()
    assert (found["n_assign"], found["spans"]) == (1, "assign:0:18,guess:10:27")
    assert found["base_sha256"] == hashlib.sha256(b"assign:0:18").hexdigest()


def test_hidden_assignment_is_dropped_with_the_failing_match():
    assert secrets.base_spans("secret=token: abcdefgh") == []
    assert [s for s in secrets.base_spans("secret=abc token: abcdefgh")] == [(11, 0, 26)]


# --- URL terms -----------------------------------------------------------------------------

def test_terms_by_automaton_and_by_expression(spark):
    rng = random.Random(9)
    parts = [*url_filter.STRICT, *url_filter.SOFT, "x", "7", "é", "Win", "FREE"]
    urls = ["http://h.net/" + "".join(rng.choice(parts) + rng.choice(["", "-", "/", "_", ".", "é"]) for _ in range(rng.randint(0, 5)))
            for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.judge(frame).join(frame, "page_id").collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), r["url"])
        hits = [[bool(re.search(f"(^|[^a-z0-9]){t}($|[^a-z0-9])", low)) for t in terms] for terms in (url_filter.STRICT, url_filter.SOFT)]
        assert (r["strict_hits"], r["soft_hits"]) == (sum(hits[0]), sum(hits[1]))
        assert r["verdict"] == ("block" if any(hits[0]) or sum(hits[1]) >= 2 else "allow")
