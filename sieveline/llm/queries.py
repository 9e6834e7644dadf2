"""The operators of this folder as queries over the given tables, with SQL counterparts where SQL can express them."""

from pyspark.sql import functions as F

from sieveline.llm import (fingerprint, jaccard, language, mixing, negatives, packing, quality, secrets, simhash, substring,
                           toxicity, url_filter, whitening)
from sieveline.llm.common import table

QUERIES = {}
ORACLE = {"op4_multiset_fingerprint": fingerprint.ORACLE_SQL, "op8_url_vocabulary": url_filter.oracle_sql(),
          "op10_weak_supervision": quality.oracle_sql(), "op3_repeated_windows": substring.ORACLE_SQL,
          "op11_blocked_jaccard": jaccard.ORACLE_SQL, "op13_bond_negatives": negatives.ORACLE_SQL}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_multiset_fingerprint(spark, sf_dir):
    return fingerprint.edited_documents(table(spark, sf_dir, "documents"))


@query
def op8_url_vocabulary(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query
def op10_weak_supervision(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents")).drop("quality")


@query
def op6_subword_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out())
    model = language.train(docs.filter("NOT held_out"), "doc_id", "text", "lang")
    return language.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "_language.*")


@query
def op9_sentence_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    scored = toxicity.assess(docs, toxicity.train(docs, labels))
    sentences = "array_join(transform(_toxicity.offending, s -> concat(s.begin, ':', s.end)), ',') AS offending"
    return scored.withColumn("held_out", toxicity.held_out()).selectExpr(
        "doc_id", "held_out", "_toxicity.score", "_toxicity.predicted", sentences)


@query
def op5_vector_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op7_guess_cost_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.find_secrets(docs, secrets.word_ranks(docs)))


@query
def op3_repeated_windows(spark, sf_dir):
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op2_pivot_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, bits=4)
    return found.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


@query
def op1_soft_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = mixing.mix(docs, mixing.domain_of_labels(table(spark, sf_dir, "labels")))
    shares = (F.col("p")[n].alias(f"p_{d}") for n, d in enumerate(sorted(mixing.TARGETS)))
    reached = (F.col("shares")[n].alias(f"share_{d}") for n, d in enumerate(sorted(mixing.TARGETS)))
    return found.select(F.col("k").alias("doc_id"), "tokens", *shares, "rate", "copies", *reached)


@query
def op11_blocked_jaccard(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op12_chebyshev_whitening(spark, sf_dir):
    return whitening.digest(*whitening.whiten(table(spark, sf_dir, "embeddings")))


@query
def op13_bond_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.mine(table(spark, sf_dir, "embeddings"), label=label)
    return found.withColumns({c: F.expr(f"try_cast({c} AS long)") for c in ("positive_score", "negative_score")})
