"""Every operator as a query over the given tables: ``name -> callable(spark, sf_dir)``."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from sieveline.functions.text import html_escape
from sieveline.operators import (activity, diagnostics, explain, export, lines, pages, pieces, reports, runs, scan,
                                 score, search, structure, text_index, tokens)
from sieveline.operators.dedup import deduplicate
from sieveline.plans import analysis, tree
from sieveline.rules import PACKS, SERVICE_PACK
from sieveline.session import shared_folder, written
from sieveline.sources import corpus, ingest, vault
from sieveline.streaming import rates, scan as stream_scan, status as stream_status

QUERIES = {}

#: fixed "now" of the reports, so that they can be repeated
REPORT_TIME = "2024-02-01 00:00:00"
DEMO_KEY = bytes(range(32))
OTHER_KEY = bytes(range(1, 33))
DELETED_PROJECTS = ("src3", "src7")
SECURITY_ONLY = {name: tuple(r for r in rules if "-SEC-" in r.rule_id) for name, rules in PACKS.items()}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- shared inputs ----------------------------------------------------------------------

def _files(spark, sf):
    return corpus.files(spark, sf)


def _findings(spark, sf, **kw):
    return scan.scan_files(_files(spark, sf), **kw)


def _status():
    return (F.when(F.col("file_id") % 13 == 0, "analyzing").when(F.col("file_id") % 11 == 0, "failed")
            .when(F.col("file_id") % 7 == 0, "pending").otherwise("complete"))


def _scored(spark, sf):
    """Files with status and score; only finished files have one."""
    scores = analysis.file_scores(_files(spark, sf)).withColumn("status", _status())
    return scores.withColumn("risk_score", F.when(F.col("status") == "complete", F.col("risk_score"))) \
        .withColumn("uploaded_at", F.col("file_id") + corpus.UPLOAD_EPOCH)


def _file_list(spark, sf):
    return corpus.file_list(spark, sf).withColumn("status", _status())


def _explained(spark, sf, noise="none"):
    return explain.attribute(_findings(spark, sf, signals=True), noise)


def _explanations(spark, sf):
    """Explanations stored for critical and high findings only."""
    grave = reports.with_ids(_findings(spark, sf, signals=True)).filter(F.col("severity").isin("critical", "high"))
    return explain.explain(grave).withColumnRenamed("title", "finding_title")


def _tree(spark, sf):
    """The tree of the corpus, grown by one scan and stored; critical and high findings have explanations."""
    folder = _run_folder(spark, "tree")
    tree.store(tree.grow(_files(spark, sf), F.col("severity").isin("critical", "high")), folder, "corpus")
    return tree.stored(spark, folder)


def _raw_files(spark, sf):
    """Documents as uploaded bytes, some with a wrong name or damaged encoding."""
    docs = corpus.read_table(spark, sf, "documents").select("doc_id", "source", "text", "lang")
    ending = (F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".JAVA")
              .when(F.col("lang") == "de", ".txt").otherwise(".mjs"))
    damaged = F.col("source") == "src3"
    content = F.encode("text", "UTF-8")
    return docs.select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("project_id"),
        F.concat(F.lit("up/f"), F.col("doc_id").cast("string"), ending).alias("filename"),
        F.when(damaged, F.concat(F.lit(b"\xff"), content)).otherwise(content).alias("content"))


#: the size limit of the ingest queries, that of the original behaviour; the operators have none unless it is given
RAW_LIMIT = 1_048_576


# --- sources ----------------------------------------------------------------------------

@query
def ingest_files(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.accepted(_raw_files(spark, sf), RAW_LIMIT).select(
        "file_id", "project_id", "filename", "language", "size_bytes", "line_count", "status",
        F.md5("source").alias("text_md5"))


@query
def ingest_rejects(spark, sf):
    return ingest.rejected(_raw_files(spark, sf), RAW_LIMIT)


@query
def ingest_totals(spark, sf):
    return ingest.totals(_raw_files(spark, sf), RAW_LIMIT)


@query
def detect_language(spark, sf):
    raw = _raw_files(spark, sf).drop("content")
    declared = F.when(F.col("file_id") % 5 == 0, "csharp")
    return raw.select("file_id", ingest.extension(F.col("filename")).alias("extension"),
                      ingest.detect_language(F.col("filename"), declared).alias("language"))


@query
def project_validation(spark, sf):
    docs = corpus.read_table(spark, sf, "documents")
    name = F.when(F.col("lang") == "es", F.concat(F.lit(" \t"), F.substring("text", 1, 1), F.lit("\n"))) \
        .otherwise(F.col("text"))
    return docs.select("doc_id", F.coalesce(ingest.project_reason(name), F.lit("ok")).alias("reason"))


@query
def encrypt_roundtrip(spark, sf):
    stored = vault.store(_files(spark, sf), DEMO_KEY)
    blob = F.col("encrypted_source")
    altered = F.concat(F.substring(blob, 1, 20), F.unhex(F.lit("00")), F.substring(blob, 22, 2_000_000_000))
    return stored.select(
        "file_id", "line_count", "size_bytes", F.octet_length(blob).alias("blob_bytes"),
        F.md5(vault.decrypt(blob, DEMO_KEY)).alias("text_md5"),
        vault.decrypt(blob, OTHER_KEY).isNull().alias("other_key_refused"),
        (vault.decrypt(altered, DEMO_KEY).isNull() | (altered == blob)).alias("altered_refused"))


# --- lines and findings -----------------------------------------------------------------

@query
def explode_lines(spark, sf):
    return lines.explode_lines(_files(spark, sf))


FINDING_KEYS = ["file_id", "rule_id", "line_start", "line_end", "title", "description", "category", "severity",
                "confidence_score", "recommendation", "code_snippet", "cwe_id", "owasp_category", "ordinal"]


@query
def line_findings(spark, sf):
    return _findings(spark, sf, structural=False).select(
        *FINDING_KEYS, F.array_join("shap_features", ",").alias("features"))


@query
def rule_join_findings(spark, sf):
    return scan.scan_with_table(_files(spark, sf), scan.rule_table(spark))


@query
def service_findings(spark, sf):
    """The rule pack of the C# service, whose ids partly mean something else."""
    return scan.service_findings(_files(spark, sf), SERVICE_PACK).select(
        "file_id", "rule_id", "line_start", "title", "severity", "category", "confidence_score", "snippet")


@query
def long_functions(spark, sf):
    rows = _findings(spark, sf).filter(F.col("ordinal") == scan.LONG_FUNCTION_ORDINAL)
    return rows.select("file_id", "rule_id", "line_start", "line_end", "code_snippet", "description")


@query
def function_complexity(spark, sf):
    rows = _findings(spark, sf).filter(F.col("ordinal") == scan.COMPLEXITY_ORDINAL)
    return rows.select("file_id", "rule_id", "line_start", "confidence_score", "code_snippet", "description")


@query
def all_findings(spark, sf):
    return reports.with_ids(_findings(spark, sf)).select("finding_id", *FINDING_KEYS)


@query
def findings_in_pieces(spark, sf):
    """The findings of all files, each file cut into pieces of lines that are scanned apart."""
    return reports.with_ids(pieces.scan_pieces(pieces.cut(_files(spark, sf)))).select("finding_id", *FINDING_KEYS)


@query
def dedup_findings(spark, sf):
    """Copies of findings derived from order lines: many per key."""
    items = corpus.read_table(spark, sf, "lineitem")
    raw = items.select(
        F.floor(F.col("l_orderkey") / 15).cast("long").alias("file_id"),
        F.concat(F.lit("R"), F.col("l_returnflag")).alias("rule_id"),
        F.col("l_linenumber").cast("int").alias("line_start"),
        (F.lit(0.5) + F.col("l_discount")).alias("confidence_score"),
        (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ordinal"),
        F.col("l_shipdate").cast("date").cast("string").alias("code_snippet"))
    # equal rows are one feed entry
    return deduplicate(raw.distinct()).drop("code_snippet")


@query
def findings_by_severity(spark, sf):
    return reports.by_severity(_findings(spark, sf), "high").select("file_id", "rule_id", "line_start", "severity")


@query
def search_findings(spark, sf):
    return search.search_findings(_findings(spark, sf), None, "injection", language="python") \
        .select("file_id", "rule_id", "line_start", "title")


@query
def search_files(spark, sf):
    return search.search_files(_file_list(spark, sf), corpus.projects(spark, sf), "SRC1 .py", status="complete") \
        .select("file_id", "filename", "project_name")


@query
def search_projects(spark, sf):
    projects = corpus.projects(spark, sf).withColumn("created_at", F.timestamp_seconds("created_at"))
    today = F.lit("2023-11-25").cast("date")
    return search.search_projects(projects, "documents src", "past_7_days", today) \
        .select("project_id", "name", F.unix_seconds("created_at").alias("created_at"))


@query
def search_explanations(spark, sf):
    return search.search_explanations(_explanations(spark, sf), "sql user", "shap") \
        .select("finding_id", "finding_title", "top_feature_name")


@query
def indexed_search_findings(spark, sf):
    folder = _run_folder(spark, "index")
    found = written(reports.with_ids(_findings(spark, sf)), "findings")
    text_index.add(found, "finding_id", search.SEARCHED["findings"], folder)
    hits = text_index.search(found, "finding_id", search.SEARCHED["findings"], folder, "injection")
    return hits.filter(F.col("language") == "python").select("file_id", "rule_id", "line_start", "title")


@query
def indexed_search_documents(spark, sf):
    """Whole documents by an index of their texts."""
    folder = _run_folder(spark, "index")
    docs = corpus.read_table(spark, sf, "documents").select("doc_id", "text", "source")
    text_index.add(docs, "doc_id", ("text", "source"), folder)
    return text_index.search(docs, "doc_id", ("text", "source"), folder, "SRC1 ata er").select("doc_id")


# --- structure --------------------------------------------------------------------------

@query
def file_metrics(spark, sf):
    return structure.file_metrics(_files(spark, sf))


@query
def csharp_metrics(spark, sf):
    return structure.csharp_metrics(_files(spark, sf))


@query
def class_name(spark, sf):
    files = _files(spark, sf).filter(F.col("language") == "java")
    hint = F.when(F.col("file_id") % 3 == 0, F.col("filename")).when(F.col("file_id") % 4 == 1, F.col("project_id"))
    return files.select("file_id", structure.class_name(F.col("source"), hint).alias("class_name"))


@query
def token_counts(spark, sf):
    return tokens.token_counts(_files(spark, sf))


@query
def html_escaped(spark, sf):
    return corpus.read_table(spark, sf, "documents").select("doc_id", html_escape(F.col("text")).alias("escaped"))


# --- scores -----------------------------------------------------------------------------

@query
def file_risk(spark, sf):
    return analysis.file_scores(_files(spark, sf)).select("file_id", "risk_score", "findings", "critical", "high")


@query
def file_risk_of_table(spark, sf):
    return score.file_risk(_findings(spark, sf))


@query
def top_risk_files(spark, sf):
    return analysis.top_files(analysis.file_scores(_files(spark, sf))).select("file_id", "risk_score", "findings")


@query
def project_risk(spark, sf):
    return score.project_risk(_scored(spark, sf))


@query
def risk_bands(spark, sf):
    return reports.risk_bands(_scored(spark, sf))


@query
def severity_weights(spark, sf):
    return reports.severity_weights(_findings(spark, sf)).groupBy("severity").agg(
        F.max("severity_weight").alias("severity_weight"), F.count(F.lit(1)).alias("findings"))


@query
def project_summary(spark, sf):
    return reports.summarise_projects(_scored(spark, sf))


@query
def file_counts(spark, sf):
    return score.file_counts(_file_list(spark, sf), _findings(spark, sf))


@query
def severity_pivot(spark, sf):
    return reports.severity_pivot(_findings(spark, sf))


@query
def severity_table(spark, sf):
    return reports.severity_table(_findings(spark, sf))


@query
def line_map(spark, sf):
    return reports.line_map(_findings(spark, sf))


# --- diagnostics ------------------------------------------------------------------------

@query
def java_diag_findings(spark, sf):
    found = diagnostics.java_findings(corpus.java_diagnostics(spark, sf), _files(spark, sf))
    return found.select(*[c for c in FINDING_KEYS if c != "recommendation"],
                        F.array_join("shap_features", ",").alias("features"))


@query
def csharp_diag_findings(spark, sf):
    found = diagnostics.csharp_findings(corpus.csharp_responses(spark, sf), _files(spark, sf))
    return found.select(*[c for c in FINDING_KEYS if c != "recommendation"],
                        F.array_join("shap_features", ",").alias("features"))


@query
def diag_counts(spark, sf):
    return diagnostics.diagnostic_counts(corpus.java_diagnostics(spark, sf))


def _enriched(spark, sf, *columns):
    return diagnostics.enrich(_findings(spark, sf), _files(spark, sf), corpus.java_diagnostics(spark, sf),
                              corpus.csharp_responses(spark, sf), columns=columns)


@query
def enriched_findings(spark, sf):
    return _enriched(spark, sf, "file_id", "rule_id", "line_start", "severity", "confidence_score", "title", "ordinal")


@query
def enriched_risk(spark, sf):
    return score.file_risk(_enriched(spark, sf, "file_id", "rule_id", "line_start", "severity", "confidence_score", "ordinal"))


@query
def enrich_optional(spark, sf):
    """No feed: the local findings unchanged."""
    return diagnostics.enrich(_findings(spark, sf), _files(spark, sf), enabled=False) \
        .select("file_id", "rule_id", "line_start", "severity", "confidence_score")


# --- reports ----------------------------------------------------------------------------

@query
def file_detail(spark, sf):
    files = _files(spark, sf).withColumn("status", _status())
    return reports.file_details(scan.scan_files(files, keep=("filename", "status"), outer=True)).select(
        "file_id", "filename", "language_display", "status", "finding_id", "rule_id", "line_range", "severity")


LOOKED_UP = 8


@query
def file_lookup(spark, sf):
    return reports.file_detail(_file_list(spark, sf), _findings(spark, sf), LOOKED_UP).select(
        "file_id", "filename", "language_display", "status", "finding_id", "rule_id", "line_range", "severity")


@query
def stored_order(spark, sf):
    return score.in_text_order(_findings(spark, sf)).select("file_id", "position", "rule_id", "line_start", "severity")


@query
def project_tree(spark, sf):
    rows = _tree(spark, sf)
    listed = tree.projects(rows).select("project_id", corpus.project_name(F.col("project_id")).alias("name"))
    return tree.under(listed, rows).select("project_id", "name", "file_id", "filename", "finding_id", "rule_id", "line_start",
                                           F.col("explanation.top_feature_name").alias("top_feature_name"))


@query
def project_listing(spark, sf):
    return reports.listing(corpus.projects(spark, sf), _file_list(spark, sf))


@query
def default_file(spark, sf):
    return reports.default_files(_file_list(spark, sf))


@query
def file_status(spark, sf):
    files = _file_list(spark, sf).withColumn("risk_score", F.lit(None).cast("double"))
    scores = analysis.file_scores(_files(spark, sf)).withColumn("duration_ms", F.lit(None).cast("long"))
    texts = corpus.read_table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("error"))
    failed = activity.file_status(corpus.status_events(spark, sf)).filter(F.col("status") == "failed")
    now = F.lit(REPORT_TIME).cast("timestamp")
    out = runs.finished(files, scores, texts.join(failed.select("file_id"), "file_id", "left_semi"), now)
    return out.select("file_id", "status", "risk_score", "error_message",
                      F.unix_seconds("analyzed_at").alias("analyzed_at"))


@query
def report_header(spark, sf):
    return reports.report_header(_scored(spark, sf))


@query
def file_report(spark, sf):
    return reports.report_findings(scan.local_findings(_files(spark, sf), signals=False))


def _exported(spark, sf):
    """Report documents written, and read again."""
    folder = _run_folder(spark, "reports")
    status = F.col("status") == "complete"
    analysed = analysis.analyze(_files(spark, sf)).withColumn("status", _status())
    docs = export.documents(analysed.withColumn("risk_score", F.when(status, F.col("risk_score"))))
    run = export.write(docs, folder, "reports")
    return export.read(spark, folder, docs.schema, run)


@query
def export_heads(spark, sf):
    return export.heads(_exported(spark, sf))


@query
def export_findings(spark, sf):
    return export.findings(_exported(spark, sf))


@query
def risk_rollup(spark, sf):
    return reports.risk_rollup(_findings(spark, sf, keep=("project_id",)))


@query
def facet_cube(spark, sf):
    return reports.facets(_findings(spark, sf))


@query
def rule_coverage(spark, sf):
    return reports.rule_coverage(_findings(spark, sf), scan.rule_table(spark))


@query
def finding_navigation(spark, sf):
    return reports.navigation(scan.local_findings(_files(spark, sf), signals=False))


@query
def fix_diff(spark, sf):
    return reports.fix_diff(_findings(spark, sf))


@query
def has_explanation(spark, sf):
    rows = _tree(spark, sf).filter(F.col("finding_id").isNotNull())
    return rows.select("finding_id", F.col("explanation").isNotNull().alias("has_explanation"))


@query
def missing_explanations(spark, sf):
    """Explanations made for findings that have none yet."""
    return explain.explain(tree.unexplained(_tree(spark, sf))) \
        .select("finding_id", "prediction", "top_feature_name", "top_feature_importance")


@query
def cascade_delete(spark, sf):
    deleted = spark.createDataFrame([(p,) for p in DELETED_PROJECTS], "project_id string")
    rows = tree.without(_tree(spark, sf), deleted)
    left = {"projects": tree.projects(rows), "files": tree.files(rows), "findings": tree.findings(rows),
            "explanations": tree.explanations(rows)}
    key = {"projects": F.col("project_id"), "files": F.col("file_id").cast("string"),
           "findings": F.col("finding_id"), "explanations": F.col("finding_id")}
    parts = [left[name].select(F.lit(name).alias("table_name"), key[name].alias("key")) for name in left]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def reanalyze_replace(spark, sf):
    """An old run with security rules only, replaced wherever a file may be analysed."""
    files = _files(spark, sf)
    old = scan.scan_files(files, SECURITY_ONLY, structural=False)
    scanned = runs.runnable(files.withColumn("status", _status()))
    new = scan.scan_files(scanned.drop("status"))
    listed = runs.runnable(_file_list(spark, sf))
    return runs.replace_findings(old, new, listed).select("file_id", "rule_id", "line_start", "severity")


@query
def latest_runs(spark, sf):
    """The last event of every file as its last run."""
    events = corpus.status_events(spark, sf)
    all_runs = events.select("file_id", F.col("event_id").alias("run_id"), F.unix_micros("ts").alias("analyzed_at"), "status")
    return runs.latest_runs(all_runs)


@query
def run_diff(spark, sf):
    files = _files(spark, sf)
    trimmed = {name: tuple(r for r in rules if "MAINT" not in r.rule_id) for name, rules in PACKS.items()}
    return runs.run_diff(scan.scan_files(files, trimmed, structural=False),
                         scan.scan_files(files, structural=False)) \
        .select("file_id", "rule_id", "line_start", "change")


# --- explanations -----------------------------------------------------------------------

@query
def context_signals(spark, sf):
    return _findings(spark, sf, signals=True).select("file_id", "rule_id", "line_start", "signals.*")


@query
def shap_features(spark, sf):
    rows = _explained(spark, sf)
    return rows.select("file_id", "rule_id", "line_start", F.posexplode("features").alias("position", "f")) \
        .select("file_id", "rule_id", "line_start", "position", "f.*")


@query
def shap_prediction(spark, sf):
    return _explained(spark, sf).select("file_id", "rule_id", "line_start", "base_value", "prediction")


@query
def shap_seeded(spark, sf):
    rows = _explained(spark, sf, "seeded")
    return rows.select("file_id", "rule_id", "line_start", "base_value", "prediction",
                       F.transform("features", lambda f: f["shap_value"]).alias("shap_values"))


@query
def lime_features(spark, sf):
    rows = explain.localise(_explained(spark, sf))
    return rows.select("file_id", "rule_id", "line_start", F.col("lime.intercept").alias("intercept"),
                       F.element_at("lime.prediction_proba", 1).alias("p_clean"),
                       F.element_at("lime.prediction_proba", 2).alias("p_risk"),
                       F.posexplode("lime.features").alias("position", "f")) \
        .select("file_id", "rule_id", "line_start", "intercept", "p_clean", "p_risk", "position", "f.name", "f.weight")


@query
def lime_seeded(spark, sf):
    rows = explain.localise(_explained(spark, sf, "seeded"), "seeded")
    return rows.select("file_id", "rule_id", "line_start", F.col("lime.intercept").alias("intercept"),
                       F.transform("lime.features", lambda f: f["weight"]).alias("weights"))


@query
def lime_fallback(spark, sf):
    rows = explain.fallback_local(_explained(spark, sf))
    return rows.select("file_id", "rule_id", "line_start", F.col("lime.intercept").alias("intercept"),
                       F.posexplode("lime.features").alias("position", "f")) \
        .select("file_id", "rule_id", "line_start", "intercept", "position", "f.name", "f.weight")


@query
def top_feature(spark, sf):
    return explain.summarise(_explained(spark, sf)).select(
        "file_id", "rule_id", "line_start", "top_feature_name", "top_feature_importance")


@query
def top_features_k(spark, sf):
    return explain.top_features(_explained(spark, sf), 3)


@query
def finding_summary(spark, sf):
    return explain.summarise(_explained(spark, sf)).select("file_id", "rule_id", "line_start", "summary")


@query
def explanation_json(spark, sf):
    """Written as JSON and read back."""
    stored = explain.localise(_explained(spark, sf)).select(
        "file_id", "rule_id", "line_start", explain.explanation_json().alias("document"))
    doc = explain.read_explanation(F.col("document"))
    return stored.select("file_id", "rule_id", "line_start", doc.alias("d")).select(
        "file_id", "rule_id", "line_start", "d.method", "d.base_value", "d.prediction",
        F.size("d.features").alias("features"), F.col("d.lime.intercept").alias("intercept"))


# --- pages ------------------------------------------------------------------------------

@query
def page_links(spark, sf):
    return pages.page_links(corpus.read_table(spark, sf, "pages"))


@query
def broken_links(spark, sf):
    return pages.broken_links(corpus.read_table(spark, sf, "pages"))


@query
def page_weight(spark, sf):
    return pages.page_weight(corpus.read_table(spark, sf, "pages"))


# --- activity ---------------------------------------------------------------------------

@query
def rate_limit_violations(spark, sf):
    return activity.rate_limit_violations(corpus.read_table(spark, sf, "events"), limit=2, seconds=6 * 3600)


@query
def stuck_files(spark, sf):
    now = F.lit(REPORT_TIME).cast("timestamp")
    return activity.stuck_files(corpus.status_events(spark, sf), now)


@query
def user_sessions(spark, sf):
    return activity.sessions(corpus.read_table(spark, sf, "events"))


# --- streams ----------------------------------------------------------------------------

def _run_folder(spark, name):
    import uuid
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark, sf, table):
    # the pattern matches the table whether it is one file or a folder of files
    schema = corpus.read_table(spark, sf, table).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{table}.parque[t]")


@query
def stream_findings(spark, sf):
    """The corpus scanned as a stream; the resulting finding table."""
    from sieveline.sources.sinks import read_latest
    folder = _run_folder(spark, "stream-findings")
    documents = _stream(spark, sf, "documents").select("doc_id", "source", "text")
    arriving = corpus.files_of(documents)
    stream_scan.scan_stream(arriving, f"{folder}/findings", f"{folder}/checkpoint").awaitTermination()
    return read_latest(spark, f"{folder}/findings").select("file_id", "rule_id", "line_start", "severity")


@query
def stream_rate_windows(spark, sf):
    folder = _run_folder(spark, "stream-rates")
    windows = rates.rate_windows(_stream(spark, sf, "events"), width="1 hour")
    rates.counts_to_table(windows, f"{folder}/windows", f"{folder}/checkpoint").awaitTermination()
    return rates.latest_counts(spark, f"{folder}/windows")


@query
def stream_stuck_files(spark, sf):
    folder = _run_folder(spark, "stream-stuck")
    events = _stream(spark, sf, "events")
    changes = corpus.status_of_events(events)
    stuck = stream_status.stuck_stream(changes)
    rates.to_table(stuck, f"{folder}/stuck", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(stuck.schema).parquet(f"{folder}/stuck")


@query
def stream_stuck_now(spark, sf):
    """The files that are stuck when the stream has read all there is, those of its last minutes included."""
    folder = _run_folder(spark, "stream-episodes")
    told = stream_status.stuck_episodes(corpus.status_of_events(_stream(spark, sf, "events")))
    rates.to_table(told, f"{folder}/told", f"{folder}/checkpoint").awaitTermination()
    now = F.lit(REPORT_TIME).cast("timestamp")
    stuck = stream_status.stuck_at_end(spark.read.schema(told.schema).parquet(f"{folder}/told"), f"{folder}/checkpoint", now)
    return stuck.select("file_id", (F.unix_seconds(now) - F.floor(F.col("since_ms") / 1000)).alias("age_seconds"))


@query
def stream_uploads(spark, sf):
    """Files uploaded at least once: repeated uploads of a stream dropped within the watermark, then over the whole table."""
    folder = _run_folder(spark, "stream-uploads")
    uploads = corpus.status_of_events(_stream(spark, sf, "events")).select("file_id", F.col("ts").alias("uploaded_at"))
    once = stream_scan.without_repeats(uploads)
    rates.to_table(once, f"{folder}/uploads", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{folder}/uploads").select("file_id").distinct()
