"""Registered queries of inventories, prompts, plug-in models and progress, each beside the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import prompts
from textloom.operators import manifest, models, similarity
from textloom.plans.more import PAIRS, pairs
from textloom.plans.queries import documents
from textloom.plans.registry import query
from textloom.session import table
from textloom.streaming import files as streams

ENTRIES = """WITH e AS (SELECT 'd' || doc_id AS pdf_id, CASE WHEN doc_id % 4 <> 0 THEN lang END AS doc_type, CASE WHEN n_chars > 3000 THEN 'needs_ocr' ELSE 'clean' END AS ocr_status,
 CASE WHEN n_chars < 600 THEN 'excluded_with_reason' WHEN doc_id % 7 = 0 THEN 'excluded' WHEN doc_id % 5 <> 0 THEN 'included' END AS inclusion_status, CASE WHEN n_chars < 600 THEN 'too_short' END AS exclusion_reason, source FROM documents)
"""


def entries(spark, sf_dir):
    """documents as an inventory, with entries that lack a type, a state or a reason."""
    d, n = F.col("doc_id"), F.col("n_chars")
    return documents(spark, sf_dir).select(
        F.concat(F.lit("d"), d.cast("string")).alias("pdf_id"),
        F.col("source").alias("source_pdf"),
        F.when(d % 4 != 0, F.col("lang")).alias("doc_type"),
        F.when(n > 3000, "needs_ocr").otherwise("clean").alias("ocr_status"),
        F.when(n < 600, "excluded_with_reason").when(d % 7 == 0, "excluded").when(d % 5 != 0, "included").alias("inclusion_status"),
        F.when(n < 600, "too_short").alias("exclusion_reason"),
        F.lit(None).cast("string").alias("exclusion_details"),
    )


OUT = "coalesce(inclusion_status IN ('excluded', 'excluded_with_reason'), false)"


@query("inventory_distributions", ENTRIES + ", u AS (SELECT 'doc_type' AS kind, doc_type AS value FROM e UNION ALL SELECT 'ocr_status', ocr_status FROM e UNION ALL SELECT 'inclusion_status', inclusion_status FROM e) SELECT kind, coalesce(value, 'unknown') AS value, count(*) AS n FROM u GROUP BY ALL")
def inventory_distributions(spark, sf_dir):
    return manifest.distributions(entries(spark, sf_dir))


@query("exclusion_totals", ENTRIES + f"SELECT count(*) AS total_documents, count(*) FILTER ({OUT}) AS excluded_count, count(*) FILTER (NOT {OUT}) AS included_count, round(count(*) FILTER ({OUT}) / count(*), 4) AS exclusion_rate FROM e")
def exclusion_totals(spark, sf_dir):
    return manifest.exclusion_totals(entries(spark, sf_dir))


@query("exclusion_report", ENTRIES + f"SELECT coalesce(exclusion_reason, 'unknown') AS reason, pdf_id, source AS source_pdf FROM e WHERE {OUT}")
def exclusion_report(spark, sf_dir):
    """Each excluded document with its reason."""
    return manifest.exclusion_rows(entries(spark, sf_dir)).drop("details")


@query("without_excluded", ENTRIES + f"SELECT pdf_id FROM e WHERE NOT {OUT}")
def without_excluded(spark, sf_dir):
    listed = entries(spark, sf_dir)
    return manifest.without_excluded(listed.select("pdf_id"), listed)


@query("manifest_upsert", ENTRIES + ", n AS (SELECT 'd' || doc_id AS pdf_id, 'new' AS doc_type FROM labels) SELECT coalesce(n.doc_type, e.doc_type, '-') AS doc_type, count(*) AS n FROM e FULL JOIN n USING (pdf_id) GROUP BY 1")
def manifest_upsert(spark, sf_dir):
    old = entries(spark, sf_dir).select("pdf_id", "doc_type")
    new = table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("pdf_id"), F.lit("new").alias("doc_type"))
    return manifest.upsert(old, new).groupBy(F.coalesce("doc_type", F.lit("-")).alias("doc_type")).agg(F.count("*").alias("n"))


@query("answer_prompts", f"""SELECT item_id, md5('{prompts.WITH_CONTEXT}' || chr(10) || chr(10) || 'Contexto recuperado:' || chr(10) || '[1] first' || chr(10) || chr(10) || '[2] ' || text || chr(10) || chr(10) || 'Pregunta: ' || text) AS with_context,
 md5('{prompts.WITHOUT_CONTEXT}' || chr(10) || chr(10) || 'Pregunta: ' || text) AS without_context, md5('{prompts.HYPOTHETICAL}' || chr(10) || chr(10) || 'Pregunta: ' || text) AS hypothetical,
 md5('Contexto fuente:' || chr(10) || trim(text) || chr(10) || chr(10) || 'Pregunta:' || chr(10) || text) AS grounded FROM benchmark""")
def answer_prompts(spark, sf_dir):
    c = F.col("text")
    found = {"with_context": prompts.answer(c, F.array(F.lit("first"), c)), "without_context": prompts.answer(c), "hypothetical": prompts.hypothetical(c), "grounded": prompts.grounded(c, c)}
    return table(spark, sf_dir, "benchmark").select("item_id", *[F.md5(v).alias(k) for k, v in found.items()])


@query("judgements", "SELECT doc_id, least(1.0e0, quality * 2.0e0) AS faithfulness, 0.0e0 AS answer_relevancy, CASE WHEN toxic = 0 THEN 'accept' ELSE 'reject' END AS verdict FROM labels")
def judgements(spark, sf_dir):
    """Judges' replies with scores out of bounds and verdicts of other forms."""
    said = F.format_string('Sure: {"faithfulness": %d, "answer_relevancy": -1, "verdict": "%s"} done', (F.col("quality") * 2).cast("int"), F.when(F.col("toxic") == 0, " ACCEPT ").otherwise("maybe"))
    rows = table(spark, sf_dir, "labels").select("doc_id", prompts.judgement(said).alias("j"))
    return rows.select("doc_id", "j.faithfulness", "j.answer_relevancy", "j.verdict")


LETTERS = "[1.0e0, " + ", ".join(f"(length(text) - length(replace(lower(text), '{chr(97 + i)}', '')))::DOUBLE" for i in range(26)) + "]"


@query("hyde_search", f"""WITH v AS (SELECT doc_id, {LETTERS} AS v FROM documents), q AS (SELECT item_id AS query_id, {LETTERS} AS q FROM (SELECT item_id, trim(text) AS text FROM benchmark)),
 s AS (SELECT query_id, doc_id, round(list_cosine_similarity(q, v), 9) AS score FROM q, v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
 SELECT query_id, doc_id, rank FROM r WHERE rank <= 5""")
def hyde_search(spark, sf_dir):
    """Dense search by hypothetical texts, with the offline writer (which repeats the question) and the offline encoder."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    vectors = documents(spark, sf_dir).select("doc_id", models.encode(F.col("text"), models.LetterEncoder).alias("v"))
    return models.hyde_search(asked, vectors, models.EchoGenerator, models.LetterEncoder, 5, digits=9).select("query_id", "doc_id", "rank")


SPLIT = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> ''))"


@query("model_scores", PAIRS + f", w AS (SELECT conv_id, turn, {SPLIT.format('answer')} AS a, {SPLIT.format('question')} AS b FROM p) SELECT conv_id, turn, CASE WHEN len(b) > 0 THEN len(list_intersect(a, b)) / len(b) ELSE 0 END AS semantic_similarity, 1 AS errors FROM w")
def model_scores(spark, sf_dir):
    """A metric that works beside one that always fails."""
    names = ("semantic_similarity", "answer_relevancy")

    def fails(**_):
        raise ValueError("no model")

    factory = lambda: dict(zip(names, (models.overlap_metric, fails), strict=True))
    sample = F.struct(F.col("question").alias("user_input"), F.col("answer").alias("response"), F.col("question").alias("reference"))
    rows = pairs(spark, sf_dir).select("conv_id", "turn", models.score(sample, factory, names).alias("s"))
    return rows.select("conv_id", "turn", "s.semantic_similarity", F.size("s.errors").alias("errors"))


@query("generated_answers", "SELECT item_id, 'ok' AS status, md5(trim(text)) AS answer, 1 AS attempts FROM benchmark")
def generated_answers(spark, sf_dir):
    """Answers of the offline generator."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", models.generate(prompts.answer(F.col("text")), models.EchoGenerator).alias("r"))
    return rows.select("item_id", "r.status", F.md5("r.text").alias("answer"), "r.attempts")


@query("unit_progress", "WITH l AS (SELECT doc_id, max(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) AS ok FROM labels GROUP BY doc_id), j AS (SELECT l.ok FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN l USING (doc_id)), c AS (SELECT count(*) AS total, count(*) FILTER (ok = 1) AS processed, count(*) FILTER (ok = 0) AS failed FROM j) SELECT total, processed, failed, total - processed - failed AS remaining, floor((total - processed - failed) / ((processed + failed) / 60.0e0))::BIGINT AS eta_seconds FROM c")
def unit_progress(spark, sf_dir):
    """Units done, failed and left after a minute."""
    log = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 0, "ok").otherwise("failed").alias("status"))
    return streams.progress(log, documents(spark, sf_dir), "doc_id", 60).select("total", "processed", "failed", "remaining", "eta_seconds")


@query("pending_units", "SELECT doc_id FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 0) USING (doc_id)")
def pending_units(spark, sf_dir):
    """Units that no ended row names, failed ones among them."""
    log = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 0, "refused").otherwise("failed").alias("status"))
    return streams.pending(documents(spark, sf_dir).select("doc_id"), log, "doc_id")


@query("similar_nations")
def similar_nations(spark, sf_dir):
    """Names of nations that match in six tenths of their characters; nation is a table of fixed size."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pdf_id"), F.col("n_name").alias("text_sample"))
    return similarity.similar_documents(rows, least=0.6, blocks=4)
