"""The queries against their SQL, and every operator over awkward and empty tables."""

import os

import duckdb
import pytest
from samples import EDGES
from pyspark.sql import functions as F

import corpus_pipeline
from sieveline.llm import fingerprint, language, mixing, packing, quality, secrets, simhash, substring, toxicity, url_filter
from sieveline.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted(map(repr, (tuple(r) for r in frame.select(*columns).collect())))
    result = duck.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())
    assert got


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(n, n % 2, int(n in (6, 9))) for n in range(1, 13)] + [(None, 1, 0), (4, None, None)],
                                 "doc_id long, quality int, toxic int")


def _operators(labels):
    """Name to a function from documents to rows that carry doc_id or k."""
    tox = labels.select("doc_id", "toxic")
    return {
        "mixing": lambda d: mixing.mix(d, mixing.domain_of_labels(labels)),
        "simhash": simhash.near_duplicates,
        "substring": substring.remove_repeats,
        "fingerprint": fingerprint.edited_documents,
        "packing": packing.pack_documents,
        "language": lambda d: language.identify(d, language.train(d, "doc_id", "text", "lang")),
        "secrets": lambda d: secrets.digest(secrets.find_secrets(d, secrets.word_ranks(d))),
        "toxicity": lambda d: toxicity.assess(d, toxicity.train(d, tox)),
        "quality": quality.judge,
    }


@pytest.mark.parametrize("name", ["mixing", "simhash", "substring", "fingerprint", "packing", "language", "secrets",
                                  "toxicity", "quality"])
def test_awkward_and_empty_tables(edges, nothing, labels, name):
    operator = _operators(labels)[name]
    rows = operator(edges).collect()
    key = "k" if name == "mixing" else "doc_id"
    wanted = sorted((str(e[0]) for e in EDGES))
    got = [str(r[key]) for r in rows]
    # packing has several rows a document
    assert sorted(set(got)) == sorted(set(wanted)) if name == "packing" else sorted(got) == wanted
    assert operator(nothing).collect() == []


def test_defined_results(edges, labels):
    ops = _operators(labels)
    by = {r["doc_id"]: r for r in ops["language"](edges).collect()}
    for n in (1, 2, 3, 12):
        assert tuple(by[n]["_language"]) == ("und", 0.0, True)
    by = {r["doc_id"]: r["_toxicity"] for r in ops["toxicity"](edges).collect()}
    assert by[1]["score"] == by[2]["score"] == 0.0 and by[1]["offending"] == []
    by = {r["doc_id"]: r for r in ops["secrets"](edges).collect()}
    assert by[13]["spans"] == "assign:0:21" and by[1]["spans"] == "" and by[1]["n_hex"] == 0
    by = {r["doc_id"]: r for r in ops["quality"](edges).collect()}
    assert by[1]["n_words"] == 0 and by[1]["base_failed"] and not by[1]["kept"]
    assert by[9]["n_words"] == 40000 == by[9]["n_repeat_words"]
    found = ops["simhash"](edges).collect()
    assert {r["fp"] for r in found if r["doc_id"] in (1, 2, 3)} == {0}
    assert {r["component_id"] for r in found if r["doc_id"] in (1, 2, 3)} == {1}
    assert {r["component_id"] for r in found if r["doc_id"] in (4, 5)} == {4}
    rows = ops["packing"](edges).collect()
    assert {(r["doc_tokens"], r["length"]) for r in rows if r["doc_id"] in (1, 2, 3)} == {(1, 1)}
    by = {r["k"]: r for r in ops["mixing"](edges).collect()}
    assert by[1]["tokens"] == 0 and all(r["rate"] >= 0 and r["copies"] >= 0 for r in by.values())


def test_urls_awkward(spark):
    pages = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "no scheme", "a"), (4, "http://Ex.ORG?x=/y", "b"),
                                   (4, "http://Ex.ORG?x=/y", "b"), (None, "https://a.example.org/en/12#t", "c"),
                                   (5, "http://a.net/" + "x/" * 50000 + "casino", "c")], "page_id long, url string, host string")
    rows = {(r["page_id"]): r for r in url_filter.judge(pages).collect()}
    assert (rows[1]["host"], rows[1]["path"], rows[1]["rule"], rows[1]["verdict"]) == ("", "", None, "allow")
    assert (rows[4]["host"], rows[4]["path"], rows[4]["rule"]) == ("ex.org", "", None)
    assert (rows[None]["rule"], rows[None]["verdict"]) == ("example.org/en/1", "block")
    assert rows[5]["verdict"] == "block"
    assert url_filter.judge(pages).count() == 7 and url_filter.judge(pages.limit(0)).count() == 0


def test_pipeline_over_awkward_tables(spark, edges, nothing, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs, n in ((edges, None), (nothing, 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert n is None or docs.count() == n


def test_pipeline_stages_against_plain_steps(spark, sf_dir):
    """Every stage on its own input: what stays, what changes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(docs, "doc_id", "text", "lang")
    stage = dict(corpus_pipeline.STAGES)
    before = {r["doc_id"]: r for r in docs.collect()}
    rejected = {r["doc_id"] for r in language.identify(docs, model).filter("_language.rejected").collect()}
    known = stage["language"](spark, docs, sf_dir)
    assert {r["doc_id"] for r in known.collect()} == set(before) - rejected
    found = simhash.near_duplicates(docs).collect()
    unique = stage["near_copies"](spark, docs, sf_dir)
    assert {r["doc_id"] for r in unique.collect()} == {r["component_id"] for r in found}
    ranks = secrets.word_ranks(docs)
    for r in stage["secrets"](spark, docs, sf_dir).collect():
        text, spans = before[r["doc_id"]]["text"], secrets.all_spans(before[r["doc_id"]]["text"], ranks)
        assert (r["text"] == text) == (not spans) and r["n_chars"] == len(r["text"])
        assert "[SECRET]" in r["text"] if spans else r["n_chars"] == before[r["doc_id"]]["n_chars"]
    labels = mixing.domain_of_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    copies = {r["k"]: r["copies"] for r in mixing.mix(docs, labels).collect()}
    counts = {r["doc_id"]: r["count"] for r in stage["mixing"](spark, docs, sf_dir).groupBy("doc_id").count().collect()}
    assert counts == {k: c for k, c in copies.items() if c}
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
