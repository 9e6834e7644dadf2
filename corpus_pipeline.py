"""The training-data pipeline over the documents: each stage calls one operator of ``sieveline.llm``.

A stage takes the session, the documents its predecessor kept and the folder of the tables. All but the last return the
columns of ``documents``; mixing may repeat a document.
"""

from pyspark.sql import functions as F

from sieveline.llm import language, mixing, packing, secrets, simhash
from sieveline.llm.common import stored, table


def keep_known_languages(spark, docs, sf_dir):
    """Documents whose language is rejected go."""
    model = language.train(docs, "doc_id", "text", "lang")
    return language.identify(docs, model).filter("NOT _language.rejected").select(*docs.columns)


def keep_one_of_near_copies(spark, docs, sf_dir):
    """Of documents linked by near-equal fingerprints the one with the least key stays."""
    return simhash.one_of_each(docs, shingle=4, bits=4)


def redact_secrets(spark, docs, sf_dir):
    """Spans of secrets are replaced by a mark."""
    before = "_sieveline_before"
    found = secrets.redact(docs.withColumn(before, F.col("text")), secrets.word_ranks(docs))
    changed = ~F.col("text").eqNullSafe(F.col(before))
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))) \
        .select(*docs.columns)


def mix_domains(spark, docs, sf_dir):
    """Documents are left out or repeated so that the domains' expected tokens meet the targets."""
    return mixing.mixed(docs, mixing.domain_of_labels(table(spark, sf_dir, "labels")))


def pack_sequences(spark, docs, sf_dir):
    """Pieces of the documents in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", keep_known_languages),
    ("near_copies", keep_one_of_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]

#: language models and the packing order have no SQL counterpart
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
