"""The index of triples finds what a look at every row finds."""

import pytest

from sieveline.operators import text_index
from sieveline.operators.search import contains_word

ROWS = [(0, "SQL injection", "User input"), (1, "Weak hash", None), (2, None, None), (3, "", "sql"), (4, "ÄÖÜ straße", "😀😀 emoji"),
        (5, "x" * 300_000 + "needle", "long"), (6, "aaa aaaa", "aa"), (7, "SQL injection", "User input"), (7, "SQL injection", "again"),
        *[(n, "Copied title of a rule", f"row {n}") for n in range(100, 400)]]
WORDS = ["sql", "SQL user", "injection", "needle", "xxxneedle", "ss", "aa", "aaaa", "äöü", "😀 emoji", "😀😀", "title rule", "row 10", "q",
         "nothing of it", "", "  ", "rule 399", "aaa aaaa aa", "in_ection", "%"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    table = spark.createDataFrame(ROWS, "id long, a string, b string").cache()
    path = str(tmp_path_factory.mktemp("index"))
    text_index.add(table.filter("id < 200"), "id", ("a", "b"), path, 16)
    text_index.add(table.filter("id >= 150"), "id", ("a", "b"), path, 16)  # some rows twice
    return table, path


@pytest.mark.parametrize("word", WORDS)
def test_same_rows_as_a_scan(indexed, word):
    table, path = indexed
    found = text_index.search(table, "id", ("a", "b"), path, word, 16)
    wanted = table.filter(contains_word(word, ("a", "b")))
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))


def test_reads_the_folders_of_the_triples_alone(spark, indexed):
    _, path = indexed
    plan = text_index.values_with(spark, path, "injection", 16)._jdf.queryExecution().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line and "triple" in line]
    assert filters and all("bucket" in f.split("PartitionFilters", 1)[1] for f in filters)


def test_changed_rows_are_tested_again(spark, indexed):
    table, path = indexed
    changed = spark.createDataFrame([(0, "other", "text"), (1, "sql", None)], table.schema)
    assert text_index.search(changed, "id", ("a", "b"), path, "sql", 16).count() == 0


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, a string")
    text_index.add(empty, "id", ("a",), str(tmp_path / "x"), 4)
    assert text_index.search(empty, "id", ("a",), str(tmp_path / "x"), "sql", 4).count() == 0
