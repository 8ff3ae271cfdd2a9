"""Registered queries of filters, joins, reshapes and reports, each beside the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.packs import SAMPLE, Pack
from textloom.operators import classify, evaluate, publish
from textloom.plans.queries import LINES, NORM, OPENINGS, POINTS, REF, RATIO, W, documents, sql_hits
from textloom.plans.registry import query
from textloom.session import table

P, PACK = T.Patterns(), Pack()
listed = lambda words: ", ".join(f"'{w}'" for w in words)
WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"
DEFAULT_SCORE = "(" + " + ".join(f"{2 if ' ' in t else 1} * CAST(contains(norm, '{t}') AS INT)" for t in PACK.terms) + " + " + sql_hits("norm", PACK.actions) + ")"


@query("default_pack_score", f"WITH n AS (SELECT doc_id, {NORM} AS norm, len(regexp_extract_all(text, '{W}')) AS words, {RATIO} AS ratio FROM documents) SELECT doc_id, greatest(0, {DEFAULT_SCORE} + CASE WHEN words >= 120 THEN 2 ELSE 0 END + CASE WHEN words >= 350 THEN 2 ELSE 0 END - CASE WHEN ratio >= 0.35 THEN 3 ELSE 0 END) AS score FROM n")
def default_pack_score(spark, sf_dir):
    """The default pack's score, with its reference branch."""
    rows = documents(spark, sf_dir).select("doc_id", T.normalize(F.col("text")).alias("norm"), T.word_count(F.col("text")).alias("words"), T.reference_line_ratio(F.col("text")).alias("ratio"))
    return rows.select("doc_id", classify.score(F.col("norm"), F.col("words"), F.col("ratio"), PACK).alias("score"))


@query("reference_lines", f"SELECT doc_id, CAST(len(list_filter({LINES}, lambda x: regexp_matches(x, '{REF}', 'i'))) AS DOUBLE) / greatest(1, len({LINES})) AS ratio FROM documents")
def reference_lines(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.reference_line_ratio(F.col("text")).alias("ratio"))


@query("looks_spanish", f"SELECT doc_id, {sql_hits(chr(39) + ' ' + chr(39) + ' || lower(text) || ' + chr(39) + ' ' + chr(39), P.spanish_signals)} + CASE WHEN regexp_matches(lower(text), '{P.spanish_letters}') THEN 2 ELSE 0 END >= 4 AS spanish FROM documents")
def looks_spanish(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.looks_spanish(F.col("text")).alias("spanish"))


@query("lexicon_density", f"WITH w AS (SELECT doc_id, list_filter(string_split({NORM}, ' '), lambda x: x <> '') AS w FROM documents) SELECT doc_id, CASE WHEN len(w) = 0 THEN 0.0 ELSE round(len(list_filter(w, lambda x: list_contains([{listed(SAMPLE.spanish)}], x))) / len(w), 4) END AS density FROM w")
def lexicon_density(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.density(F.col("text"), SAMPLE.spanish).alias("density"))


@query("slugs", f"WITH b AS (SELECT page_id, regexp_replace(list_last(string_split(url, '/')), '\\.[^.]*$', '') AS text FROM pages), n AS (SELECT page_id, trim(regexp_replace({NORM}, '[^a-z0-9]+', '_', 'g'), '_') AS s FROM b) SELECT page_id, CASE WHEN s = '' THEN 'document' ELSE s END AS slug FROM n")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("safe_names", "SELECT page_id, CASE WHEN s = '' THEN 'default' ELSE s END AS name FROM (SELECT page_id, trim(regexp_replace(url, '[^a-zA-Z0-9._-]+', '-', 'g'), '-') AS s FROM pages)")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


PAIRS = "WITH q AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, role FROM conversations), p AS (SELECT conv_id, turn, text AS question, coalesce(answer, '') AS answer FROM q WHERE role = 'user')"


def pairs(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))


def sql_any(column: str, words) -> str:
    return f"({sql_hits(f'lower({column})', words)}) > 0"


@query("cleanliness", PAIRS + f" SELECT conv_id, turn, {sql_any('question', P.meta_phrase)} AS question_has_meta_reference, {sql_any('answer', P.meta_phrase)} AS answer_has_meta_reference, len(question) - len(replace(replace(question, '?', ''), '¿', '')) AS question_mark_count, {WORDS.replace('text', 'answer')} AS answer_word_count FROM p")
def cleanliness(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", *[c.alias(k) for k, c in T.cleanliness(F.col("question"), F.col("answer")).items()])


@query("experiment_summary", PAIRS + f" SELECT count(*) AS pairs, avg({WORDS.replace('text', 'question')}) AS question_words, avg({WORDS.replace('text', 'answer')}) AS answer_words, min({WORDS.replace('text', 'answer')}) AS least_answer_words, max({WORDS.replace('text', 'answer')}) AS most_answer_words, count_if(contains(lower(question), ' y ')) AS questions_with_y FROM p")
def experiment_summary(spark, sf_dir):
    flags = T.meta_flags(F.col("question"), F.col("answer"))
    q, a = F.size(T.tokens(F.col("question"))), F.size(T.tokens(F.col("answer")))
    return pairs(spark, sf_dir).agg(F.count("*").alias("pairs"), F.avg(q).alias("question_words"), F.avg(a).alias("answer_words"), F.min(a).alias("least_answer_words"), F.max(a).alias("most_answer_words"), F.count_if(flags["question_with_y"]).alias("questions_with_y"))


@query("filtered_chunks", OPENINGS + f", r AS (SELECT doc_id, {', '.join(f'{x} AS r_{role}' for role, x in POINTS.items())}, score FROM s), t AS (SELECT *, greatest({', '.join(f'r_{role}' for role in POINTS)}) AS best FROM r)," + f" x AS (SELECT doc_id, CASE {' '.join(f'WHEN best > 100 AND best = r_{role} THEN {chr(39)}{role}{chr(39)}' for role in POINTS)} WHEN score >= 8 THEN 'evidence' WHEN score >= 4 THEN 'background' ELSE 'unknown' END AS role FROM t)" + f" SELECT role, lang, role NOT IN ({listed(SAMPLE.dropped_roles)}) AND lang IN ('es', 'en') AS kept, role IN ({listed(SAMPLE.clinical_roles)}) AS clinical, count(*) AS chunks FROM x JOIN documents USING (doc_id) GROUP BY ALL")
def filtered_chunks(spark, sf_dir):
    """Chunks kept and dropped by role and language, counted."""
    from textloom.plans.queries import content_role

    rows = content_role(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    return rows.groupBy("role", "lang", classify.keeps_chunk(F.col("role"), F.col("lang"), SAMPLE, ("es", "en")).alias("kept"), classify.is_clinical(F.col("role"), SAMPLE).alias("clinical")).agg(F.count("*").alias("chunks"))


NAMES = {"gpc": ("1",), "manual": ("22",)}
OPENS = {"article": ("que", "tion"), "protocol": ("the", "ing"), "book": ("und", "sch")}


@query("document_types", "WITH d AS (SELECT doc_id, lower(source) AS low, lower(substr(text, 1, 5000)) AS head FROM documents), n AS (SELECT *, " + ", ".join(f"({sql_hits('head', ws)}) * 100 - {i} AS n_{k}" for i, (k, ws) in enumerate(OPENS.items())) + f" FROM d), b AS (SELECT *, greatest({', '.join(f'n_{k}' for k in OPENS)}) AS best FROM n) SELECT doc_id, CASE " + " ".join(f"WHEN ({sql_hits('low', ws)}) > 0 THEN '{k}'" for k, ws in NAMES.items()) + " " + " ".join(f"WHEN best > 100 AND best = n_{k} THEN '{k}'" for k in OPENS) + " WHEN contains(low, '5') THEN 'book' ELSE 'unknown' END AS type FROM b")
def document_types(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", classify.document_type(F.col("source"), F.col("text"), NAMES, OPENS, ("5",)).alias("type"))


@query("document_types_default", f"""WITH d AS (SELECT doc_id, lower(source) AS low, lower(substr(text, 1, 5000)) AS head FROM documents), n AS (SELECT *, {", ".join(f"({sql_hits('head', ws)}) * 100 - {i} AS n_{k}" for i, (k, ws) in enumerate(classify.OPENING_TYPES.items()))} FROM d), b AS (SELECT *, greatest({", ".join(f"n_{k}" for k in classify.OPENING_TYPES)}) AS best FROM n)
 SELECT type, count(*) AS documents FROM (SELECT CASE {" ".join(f"WHEN ({sql_hits('low', ws)}) > 0 THEN '{k}'" for k, ws in classify.NAME_TYPES.items())} {" ".join(f"WHEN best > 100 AND best = n_{k} THEN '{k}'" for k in classify.OPENING_TYPES)} WHEN ({sql_hits('low', classify.CHAPTER_NAMES)}) > 0 THEN 'book' ELSE 'unknown' END AS type FROM b) GROUP BY type""")
def document_types_default(spark, sf_dir):
    return documents(spark, sf_dir).groupBy(classify.document_type(F.col("source"), F.col("text")).alias("type")).agg(F.count("*").alias("documents"))


@query("inclusion_detail", """WITH s AS (SELECT source, count(*) AS pages, count_if(n_chars < 300) AS ocr, count_if(lang = 'es') / count(*) AS ratio FROM documents GROUP BY source)
 SELECT source, CASE WHEN ocr / pages > 0.5 OR ratio < 0.1 OR pages < 3 THEN 'excluded' ELSE 'included' END AS status,
 CASE WHEN ocr / pages > 0.5 THEN 'ocr_dominated' WHEN ratio < 0.1 THEN 'non_clinical' WHEN pages < 3 THEN 'empty' END AS reason,
 CASE WHEN ocr / pages > 0.5 THEN printf('%d/%d páginas (%.1f%%) requieren OCR', ocr, pages, ocr / pages * 100) WHEN ratio < 0.1 THEN printf('Ratio de términos clínicos: %.1f%% (mínimo: 10%%)', ratio * 100) WHEN pages < 3 THEN printf('Solo %d páginas (mínimo: 3)', pages) END AS detail FROM s""")
def inclusion_detail(spark, sf_dir):
    rows = documents(spark, sf_dir).groupBy("source").agg(F.count("*").alias("pages"), F.count_if(F.col("n_chars") < 300).alias("ocr"), (F.count_if(F.col("lang") == "es") / F.count("*")).alias("ratio"))
    return rows.select("source", classify.evaluated_inclusion(F.col("pages"), F.col("ocr"), F.col("ratio")).alias("x")).select("source", "x.status", "x.reason", "x.detail")


CELLS = "WITH t AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda r: list_transform(string_split(r, '|'), lambda x: trim(x))) AS r FROM documents), c AS (SELECT doc_id, len(r) AS n_rows, list_max(list_transform(r, lambda x: len(x))) AS n_cols, flatten(r) AS cells, list_filter(flatten(r), lambda x: x <> '') AS filled, list_filter(r[1], lambda x: x <> '') AS head FROM t), m AS (SELECT *, list_transform(filled, lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> ''))) AS words FROM c), v AS (SELECT doc_id, n_rows, n_cols, len(filled) AS non_empty_cells, len(filled) / greatest(1, len(cells)) AS non_empty_density, len(list_filter(filled, lambda x: regexp_matches(x, '[0-9]'))) / greatest(1, len(filled)) AS numeric_ratio, len(list_filter(filled, lambda x: length(x) <= 3)) / greatest(1, len(filled)) AS short_cell_ratio, coalesce(list_sum(words), 0) / greatest(1, len(filled)) AS avg_words_per_cell, coalesce(list_max(words), 0) AS max_words_cell, len(head) >= 2 AND len(list_filter(head, lambda x: len(regexp_split_to_array(x, '\\s+')) > 6)) = 0 AS is_header_like FROM m)"


@query("table_gates", CELLS + """, g AS (SELECT *, (n_cols >= 6 AND n_rows >= 30 AND numeric_ratio < 0.08) OR (avg_words_per_cell > 8 AND numeric_ratio < 0.1) OR max_words_cell > 45 OR (short_cell_ratio > 0.55 AND numeric_ratio < 0.1) OR non_empty_density < 0.35 AS fragment FROM v)
 SELECT *, n_rows >= 2 AND n_cols >= 2 AND non_empty_cells >= 4 AND NOT fragment AS kept, n_rows >= 2 AND n_cols >= 2 AND non_empty_cells >= 4 AND NOT fragment AND numeric_ratio >= 0.18 AS kept_by_text FROM g""")
def table_gates(spark, sf_dir):
    """Texts as tables (lines, cells between bars): metrics, layout fragments and gates."""
    rows = F.transform(F.split("text", "\n"), lambda r: F.transform(F.split(r, r"\|"), lambda x: F.trim(x)))
    df = documents(spark, sf_dir).select("doc_id", rows.alias("r")).withColumns({"n_rows": F.size("r"), "n_cols": F.array_max(F.transform("r", lambda x: F.size(x)))})
    df = df.withColumns(classify.cell_metrics(F.col("r"))).withColumn("is_header_like", classify.header_like(F.element_at("r", 1))).drop("r")
    m = {c: F.col(c) for c in df.columns}
    gate = lambda by_text: classify.table_gate(m["n_rows"], m["n_cols"], m, m["is_header_like"], by_text)
    return df.withColumns({"fragment": classify.layout_fragment(m["n_rows"], m["n_cols"], m), "kept": gate(False), "kept_by_text": gate(True)})


@query("qa_contexts", "SELECT l.doc_id, CASE WHEN d.text IS NULL OR trim(d.text) = '' THEN 'label ' || l.doc_id ELSE trim(d.text) END AS context FROM labels l LEFT JOIN (SELECT * FROM documents WHERE doc_id % 2 = 0) d USING (doc_id)")
def qa_contexts(spark, sf_dir):
    """The text of each labelled row's document where it is at hand (every second one here), else an excerpt of its own."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("label "), F.col("doc_id").cast("string")).alias("excerpt"))
    return publish.with_context(rows, documents(spark, sf_dir).where("doc_id % 2 = 0"), "doc_id", "excerpt").select("doc_id", "context")


LAST = lambda kind: f"SELECT user_id, max_by(value, event_id) AS {kind} FROM events WHERE event_type = '{kind}' GROUP BY user_id"
KINDS = ("click", "view", "purchase")


@query("metric_merge", f"WITH u AS (SELECT DISTINCT user_id FROM events), {', '.join(f't_{k} AS ({LAST(k)})' for k in KINDS)} SELECT user_id, {', '.join(KINDS)} FROM u {' '.join(f'LEFT JOIN t_{k} USING (user_id)' for k in KINDS)}")
def metric_merge(spark, sf_dir):
    """The last value of three kinds of events beside each user."""
    events = table(spark, sf_dir, "events")
    passes = [events.where(F.col("event_type") == k).select("user_id", "event_id", F.col("value").alias(k)) for k in KINDS]
    return publish.merged_metrics(events.select("user_id").distinct(), passes, "user_id", "event_id")


@query("key_sets", "SELECT count(*) FILTER (a AND b) AS both_sides, count(*) FILTER (a AND b IS NULL) AS only_a, count(*) FILTER (a IS NULL AND b) AS only_b FROM (SELECT doc_id, true AS a FROM documents WHERE doc_id % 3 <> 0) x FULL JOIN (SELECT DISTINCT doc_id, true AS b FROM labels) y USING (doc_id)")
def key_sets(spark, sf_dir):
    return publish.key_sets(documents(spark, sf_dir).where("doc_id % 3 <> 0"), table(spark, sf_dir, "labels"), "doc_id")


@query("split_counts", "SELECT count(*) AS n_rows, count(DISTINCT nullif(source, '')) AS unique_source, count(DISTINCT nullif(lang, '')) AS unique_lang, count(DISTINCT nullif(text, '')) AS unique_text FROM documents")
def split_counts(spark, sf_dir):
    return publish.distinct_counts(documents(spark, sf_dir), ["source", "lang", "text"])


@query("volume_estimate", f"SELECT count(*) AS n_rows, sum(t) AS tokens, sum(t) / count(*) AS tokens_per_row FROM (SELECT greatest(1, CAST(ceil(len(regexp_extract_all(text, '{W}')) * 1.35e0) AS INT)) AS t FROM documents)")
def volume_estimate(spark, sf_dir):
    return publish.volume(documents(spark, sf_dir), T.estimate_tokens(F.col("text")))


@query("mean_tokens_by_source", f"SELECT source, round(sum(t) / greatest(count(*), 1), 2) AS mean_tokens FROM (SELECT source, greatest(1, CAST(ceil(len(regexp_extract_all(text, '{W}')) * 1.35e0) AS INT)) AS t FROM documents) GROUP BY source")
def mean_tokens_by_source(spark, sf_dir):
    rows = documents(spark, sf_dir).select("source", T.estimate_tokens(F.col("text")).alias("t"))
    return rows.groupBy("source").agg(F.round(F.sum("t") / F.greatest(F.count("*"), F.lit(1)), 2).alias("mean_tokens"))


@query("continued_ids", "WITH k AS (SELECT source, count(*) AS last FROM documents WHERE doc_id % 2 = 0 GROUP BY source) SELECT d.doc_id, d.source || '_' || printf('%04d', row_number() OVER (PARTITION BY d.source ORDER BY doc_id) + coalesce(last, 0)) AS chunk_id FROM documents d LEFT JOIN k USING (source) WHERE doc_id % 2 = 1")
def continued_ids(spark, sf_dir):
    """Documents of odd ids numbered on from where those of even ids end."""
    docs = documents(spark, sf_dir).select("doc_id", "source")
    known = publish.continued_ids(docs.where("doc_id % 2 = 0"), docs.limit(0).withColumn("chunk_id", F.lit("")), "source", "chunk_id", ["doc_id"])
    return publish.continued_ids(docs.where("doc_id % 2 = 1"), known, "source", "chunk_id", ["doc_id"]).select("doc_id", "chunk_id")


@query("sample_by_source", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 5")
def sample_by_source(spark, sf_dir):
    return publish.sample_of_each(documents(spark, sf_dir).select("source", "doc_id"), "source", "doc_id")


@query("update_counters", "SELECT count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.v IS DISTINCT FROM b.v) AS updated, count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.v IS NOT DISTINCT FROM b.v) AS unchanged, count(*) FILTER (a.doc_id IS NULL) AS added, count(*) FILTER (b.doc_id IS NULL) AS removed FROM (SELECT doc_id, quality AS v FROM labels WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT doc_id, toxic AS v FROM labels WHERE doc_id % 7 <> 0) b ON a.doc_id = b.doc_id")
def update_counters(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return publish.changes(labels.where("doc_id % 5 <> 0").select("doc_id", F.col("quality").alias("v")), labels.where("doc_id % 7 <> 0").select("doc_id", F.col("toxic").alias("v")), "doc_id", "v")


@query("missing_references", "SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0)")
def missing_references(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.array("doc_id").alias("ids"))
    return publish.missing_references(rows, "ids", documents(spark, sf_dir).where("doc_id % 4 <> 0"), "doc_id")


@query("lm_records", "SELECT doc_id, text, source, lang, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM documents")
def lm_records(spark, sf_dir):
    split = F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train")
    return publish.lm_records(documents(spark, sf_dir), "text", ["doc_id", "source", "lang"], split).select("metadata.doc_id", "text", "metadata.source", "metadata.lang", "metadata.split")


@query("record_errors", "SELECT doc_id AS line, 'empty text' AS error FROM documents WHERE trim(CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE text END) = '' UNION ALL SELECT doc_id, 'missing metadata' FROM documents WHERE doc_id % 4 = 0")
def record_errors(spark, sf_dir):
    """Records with planted faults: blank texts and no metadata."""
    rows = documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") % 4 != 0, F.struct("source")).alias("metadata"))
    return publish.record_errors(rows, "doc_id", None)


@query("prompt_completion", "SELECT conv_id, count(*) - 1 AS prompt_messages, max_by(role, turn) AS completion_role, max_by(text, turn) AS completion FROM conversations GROUP BY conv_id")
def prompt_completion(spark, sf_dir):
    rows = evaluate.messages(table(spark, sf_dir, "conversations"))
    rows = rows.select("conv_id", *publish.prompt_completion(F.col("messages")))
    return rows.select("conv_id", F.size("prompt").alias("prompt_messages"), F.element_at("completion", 1)["role"].alias("completion_role"), F.element_at("completion", 1)["content"].alias("completion"))


@query("publication_variants", "SELECT 'full' AS variant, count(*) AS n, count(quality) AS with_quality FROM labels UNION ALL SELECT 'clean', count(*), 0 FROM labels UNION ALL SELECT 'ids', count(*), 0 FROM labels")
def publication_variants(spark, sf_dir):
    """Three shapes of the same rows; quality fields, also nested ones, are gone from all but the first."""
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", F.struct("quality", "toxic").alias("meta"))
    clean = publish.without_fields(rows, {"quality"})
    shapes = publish.variants(rows, "doc_id", {"full": ["quality", "meta"], "ids": []}) | publish.variants(clean, "doc_id", {"clean": ["meta"]})
    out = None
    for name, df in shapes.items():
        left = F.count("quality") if "quality" in df.columns else F.count("meta.quality") if "meta" in df.columns and "quality" in df.schema["meta"].dataType.names else F.lit(0)
        one = df.agg(F.lit(name).alias("variant"), F.count("*").alias("n"), left.cast("long").alias("with_quality"))
        out = one if out is None else out.union(one)
    return out


MODELS, STRATEGIES = ["m1", "m2", "m3", "m4"], ["no_rag", "dense", "hybrid"]


@query("strategy_matrix", "SELECT i * 3 + j AS run, m AS model, s AS strategy FROM (SELECT unnest(['m1', 'm2', 'm3', 'm4']) AS m, unnest([0, 1, 2, 3]) AS i) CROSS JOIN (SELECT unnest(['no_rag', 'dense', 'hybrid']) AS s, unnest([0, 1, 2]) AS j)")
def strategy_matrix(spark, sf_dir):
    return publish.strategy_matrix(spark, MODELS, STRATEGIES)


@query("strategy_contexts", """WITH r AS (SELECT item_id, 'by_id' AS strategy, k AS rank, 'doc ' || (item_id + k) AS context FROM benchmark CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) WHERE item_id % 2 = 0)
 SELECT b.item_id, s.strategy, coalesce(string_agg(r.context, ';' ORDER BY r.rank), '') AS contexts FROM benchmark b CROSS JOIN (SELECT unnest(['no_rag', 'by_id']) AS strategy) s LEFT JOIN r ON r.item_id = b.item_id AND r.strategy = s.strategy GROUP BY ALL""")
def strategy_contexts(spark, sf_dir):
    """Contexts by strategy: none without retrieval, and none where a strategy finds nothing."""
    items = table(spark, sf_dir, "benchmark")
    found = items.where("item_id % 2 = 0").select("item_id", F.explode(F.array(F.lit(3), F.lit(1), F.lit(2))).alias("rank")).withColumn("context", F.concat(F.lit("doc "), (F.col("item_id") + F.col("rank")).cast("string")))
    out = publish.contexts_for(items, {"no_rag": found.limit(0), "by_id": found}, "item_id")
    return out.select("item_id", "strategy", F.array_join("contexts", ";").alias("contexts"))


@query("hyde_cache", "SELECT item_id, item_id % 3 = 0 AS hit, CASE WHEN item_id % 3 = 0 THEN 'answer ' || item_id END AS hypothetical FROM benchmark")
def hyde_cache(spark, sf_dir):
    """A cache that has two thirds of the questions, half of them as they were worded before."""
    items = table(spark, sf_dir, "benchmark")
    now = F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" ")))
    cache = items.where("item_id % 3 <> 2").select("item_id", F.sha2(now, 256).alias("question_hash"), F.concat(F.lit("answer "), F.col("item_id").cast("string")).alias("hypothetical"))
    return publish.cached(items, cache, "item_id", "text").select("item_id", "hit", "hypothetical")


@query("distinct_tables", "SELECT pdf_id, count(DISTINCT (n_chars, lang)) AS tables FROM (SELECT source AS pdf_id, n_chars % 50 AS n_chars, lang FROM documents) GROUP BY pdf_id")
def distinct_tables(spark, sf_dir):
    """Tables of a document that look alike (page, size, box, headers, first row), once each."""
    rows = documents(spark, sf_dir).select(F.col("source").alias("pdf_id"), "doc_id", (F.col("n_chars") % 50).cast("int").alias("page"), F.lit(2).alias("row_count"), F.lit(2).alias("col_count"), F.array(F.lit(1.04), F.lit(2.0)).alias("bbox"), F.array(F.concat(F.lit(" "), F.col("lang"))).alias("headers"), F.array(F.array(F.lit("x "))).alias("rows"))
    return publish.distinct_tables(rows, ["doc_id"]).groupBy("pdf_id").agg(F.count("*").alias("tables"))


@query("union_of_splits", "SELECT split, count(*) AS n, count(toxic) AS with_toxic FROM (SELECT 'a' AS split, toxic FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT 'b', NULL FROM labels WHERE doc_id % 2 = 1) GROUP BY split")
def union_of_splits(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return publish.union_of_splits({"a": labels.where("doc_id % 2 = 0"), "b": labels.where("doc_id % 2 = 1").drop("toxic")}).groupBy("split").agg(F.count("*").alias("n"), F.count("toxic").alias("with_toxic"))


@query("report_summaries", "SELECT r.name, coalesce(s.total, 0) AS total FROM (SELECT DISTINCT 'report_' || event_type AS name, event_type FROM events) r LEFT JOIN (SELECT event_type, count(*) AS total FROM events WHERE event_type <> 'click' GROUP BY event_type) s USING (event_type)")
def report_summaries(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind = F.regexp_replace("event_type", "_", "-")
    reports = events.select(F.concat(F.lit("report_"), "event_type").alias("name"), F.concat(F.lit("report_"), kind).alias("key")).distinct()
    summaries = events.where("event_type <> 'click'").groupBy(F.concat(F.lit("raw_"), kind, F.lit(".json")).alias("file")).agg(F.count("*").alias("total"))
    return publish.matched_reports(reports, summaries, "key", "file").select("name", F.coalesce("total", F.lit(0)).alias("total"))


@query("weighted_grounding", "SELECT event_type, sum(value * (user_id % 5 + 1)) / sum(user_id % 5 + 1) AS mean, avg(CASE WHEN value < 0.15 THEN 1.0 ELSE 0.0 END) AS low_rate FROM events GROUP BY event_type")
def weighted_grounding(spark, sf_dir):
    return evaluate.weighted_mean(table(spark, sf_dir, "events").withColumn("weight", F.col("user_id") % 5 + 1), "event_type", "value", "weight")
