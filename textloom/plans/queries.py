"""Registered queries over the test tables, each with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.packs import SAMPLE
from textloom.operators import classify, corpus, evaluate, incremental, retrieval
from textloom.plans.registry import query
from textloom.session import table

W = r"[\p{L}\p{N}_]+"
NORM = "trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
REF = T.Patterns().reference.replace("(?i)", "").replace(r"(?<![\p{L}\p{N}_])", r"(?:^|[^\p{L}\p{N}_])").replace(r"(?![\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def sql_hits(column: str, words) -> str:
    return " + ".join(f"CAST(contains({column}, '{w}') AS INT)" for w in words) or "0"


BM25 = f"""
WITH q AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS qn FROM q GROUP BY ALL),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '{W}') AS w FROM documents),
s AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM d),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS term FROM d) GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5e0) - ln(df + 0.5e0) AS r FROM df, s),
m AS (SELECT avg(r) AS a FROM raw),
idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25e0 * a ELSE r END AS idf FROM raw, m),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY ALL),
sc AS (SELECT item_id AS query_id, doc_id, round(sum(qn * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / mean))), 9) AS score
       FROM qt JOIN tf USING (term) JOIN idf USING (term), s GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)
"""


@query("bm25_topk", BM25 + "SELECT query_id, doc_id, rank, round(score, 6) AS score FROM rk WHERE rank <= 5")
def bm25_topk(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25(asked, documents(spark, sf_dir), 5).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def vector_queries(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))


DENSE = """
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
"""


@query("dense_topk", DENSE + "SELECT query_id, doc_id, rank FROM r WHERE rank <= 5")
def dense_topk(spark, sf_dir):
    return retrieval.dense(*vector_queries(spark, sf_dir), 5).select("query_id", "doc_id", "rank")


@query("rrf_hybrid", BM25 + """, de AS (SELECT a.item_id AS query_id, b.vec_id AS doc_id, list_inner_product(v.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
  FROM benchmark a JOIN embeddings v ON v.vec_id = a.item_id, embeddings b),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM de),
al AS (SELECT query_id, doc_id, rank FROM rk WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, rank FROM dr WHERE rank <= 50),
f AS (SELECT query_id, doc_id, sum(1e0 / (60e0 + rank)) AS score FROM al GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)
SELECT query_id, doc_id, rank FROM o WHERE rank <= 5""")
def rrf_hybrid(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    vectors = vector_queries(spark, sf_dir)[1]
    q = asked.join(vectors.withColumnRenamed("doc_id", "query_id"), "query_id").select("query_id", F.col("v").alias("q"))
    return retrieval.hybrid(asked, documents(spark, sf_dir), q, vectors, 5).select("query_id", "doc_id", "rank")


@query("text_metrics", f"""SELECT doc_id, len(regexp_extract_all(text, '{W}')) AS words,
 greatest(1, ceil(len(regexp_extract_all(text, '{W}')) * 1.35e0)::INT) AS token_estimate,
 len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: regexp_matches(x, '\\d'))) AS numeric_tokens,
 len({LINES}) AS n_lines, length(text) - length(translate(text, '‡ƒ¦„¥‚┫�', '')) AS odd_chars FROM documents""")
def text_metrics(spark, sf_dir):
    c = F.col("text")
    return documents(spark, sf_dir).select("doc_id", T.word_count(c).alias("words"), T.estimate_tokens(c).alias("token_estimate"), F.size(F.filter(T.tokens(c), lambda w: w.rlike(r"\d"))).alias("numeric_tokens"), F.size(T.lines(c)).alias("n_lines"), (F.length(c) - F.length(F.translate(c, "‡ƒ¦„¥‚┫�", ""))).alias("odd_chars"))


@query("normalize_text", f"SELECT doc_id, md5({NORM}) AS norm FROM documents")
def normalize_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(T.normalize(F.col("text"))).alias("norm"))


@query("slug_urls", "SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[^a-zA-Z0-9._-]+', '-', 'g') AS name FROM pages")
def slug_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[^a-zA-Z0-9._-]+", "-").alias("name"))


SCORE = "(" + " + ".join(f"{2 if ' ' in t else 1} * CAST(contains(norm, '{t}') AS INT)" for t in SAMPLE.terms) + " + " + sql_hits("norm", SAMPLE.actions) + ")"


def _case(parts: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in parts) + f" ELSE '{other}' END"


@query("topic_tags", f"""WITH n AS (SELECT doc_id, {NORM} AS norm FROM documents),
 t AS (SELECT doc_id, unnest([{", ".join(f"CASE WHEN ({sql_hits('norm', ws)}) > 0 THEN '{name}' END" for name, ws in SAMPLE.topics.items())}]) AS topic FROM n)
 SELECT topic, count(*) AS documents FROM t WHERE topic IS NOT NULL GROUP BY topic""")
def topic_tags(spark, sf_dir):
    """Topics of each document, counted."""
    norm = documents(spark, sf_dir).select(T.normalize(F.col("text")).alias("norm"))  # a column of its own, so it is computed once
    tagged = norm.select(F.explode(classify.topics(F.col("norm"), SAMPLE)).alias("topic"))
    return tagged.groupBy("topic").agg(F.count("*").alias("documents"))


@query("lexicon_score", f"WITH n AS (SELECT doc_id, {NORM} AS norm, len(regexp_extract_all(text, '{W}')) AS words FROM documents) SELECT doc_id, {SCORE} + CASE WHEN words >= 120 THEN 2 ELSE 0 END + CASE WHEN words >= 350 THEN 2 ELSE 0 END AS score FROM n")
def lexicon_score(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", T.normalize(F.col("text")).alias("norm"), T.word_count(F.col("text")).alias("words"))
    return rows.select("doc_id", classify.score(F.col("norm"), F.col("words"), F.lit(0.0), SAMPLE).alias("score"))


#: The score that SQL gives to a normalised text with columns words and ratio.
WHOLE_SCORE = f"greatest(0, {SCORE} + CASE WHEN words >= 120 THEN 2 ELSE 0 END + CASE WHEN words >= 350 THEN 2 ELSE 0 END - CASE WHEN ratio >= 0.35 THEN 3 ELSE 0 END)"
RATIO = f"CASE WHEN len({LINES}) > 0 THEN len(list_filter({LINES}, lambda x: regexp_matches(x, '{REF}', 'i'))) / len({LINES}) ELSE 0 END"
SCORED = f"SELECT doc_id, {NORM} AS norm, len(regexp_extract_all(text, '{W}')) AS words, {RATIO} AS ratio FROM"
OPENINGS = f"""WITH h AS (SELECT doc_id, substr(text, 1, 1000) AS text FROM documents), hs AS (SELECT doc_id, {WHOLE_SCORE} AS head_score FROM ({SCORED} h)),
 ws AS (SELECT doc_id, {WHOLE_SCORE} AS score FROM ({SCORED} documents)),
 a AS (SELECT doc_id, {NORM} AS norm_1500 FROM (SELECT doc_id, substr(text, 1, 1500) AS text FROM documents)),
 b AS (SELECT doc_id, {NORM} AS norm_2000 FROM (SELECT doc_id, substr(text, 1, 2000) AS text FROM documents)),
 o AS (SELECT * FROM hs JOIN ws USING (doc_id) JOIN a USING (doc_id) JOIN b USING (doc_id)),
 s AS (SELECT *, {_case([(f"({sql_hits('substr(norm_1500, 1, 500)', ws)}) > 0", name) for name, ws in SAMPLE.sections.items()] + [("head_score >= 5", "clinical_content")], "unknown")} AS section FROM o)
"""


@query("section_type", OPENINGS + "SELECT doc_id, section AS section_type FROM s")
def section_type(spark, sf_dir):
    """Sections by the opening, else by the score of the first 1000 characters."""
    rows = classify.openings(documents(spark, sf_dir).select("doc_id", "text"), SAMPLE)
    return rows.select("doc_id", classify.section_type(F.lit(""), F.col("norm_1500"), F.col("head_score"), SAMPLE).alias("section_type"))


@query("detect_language", f"""WITH w AS (SELECT doc_id, string_split({NORM}, ' ') AS w FROM documents),
 h AS (SELECT doc_id, len(list_filter(w, lambda x: list_contains({list(SAMPLE.spanish)}, x))) AS a, len(list_filter(w, lambda x: list_contains({list(SAMPLE.english)}, x))) AS b FROM w)
 SELECT doc_id, CASE WHEN a = 0 AND b = 0 THEN 'unknown' WHEN a >= b THEN 'es' ELSE 'en' END AS language FROM h""")
def detect_language(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.marker_language(F.col("text"), SAMPLE.spanish, SAMPLE.english).alias("language"))


def re2(pattern: str) -> str:
    """A pattern of the library for SQL, whose engine looks at no neighbours: edges of words become characters of the match."""
    return pattern.replace("(?i)", "").replace("'", "''").replace(r"(?<![\p{L}\p{N}_])", r"(?:^|[^\p{L}\p{N}_])").replace(r"(?![\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)")


def norm_of(c: str) -> str:
    return NORM.replace("strip_accents(text)", f"strip_accents({c})")


def lines_of(c: str) -> str:
    return LINES.replace("text", c)


def has(c: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({c}, '{re2(pattern)}', '{flags}')"


def found(c: str, pattern: str) -> str:
    """How often a pattern comes; blanks are doubled, so that neighbours each have an edge of their own."""
    return f"len(regexp_extract_all(regexp_replace({c}, '(\\s)', '\\1\\1', 'g'), '{re2(pattern).replace(' ', ' +')}', 0, 'i'))"


PAT = T.Patterns()
ODD = "‡ƒ¦„¥‚┫�"
NOISE = " OR ".join([
    *[has("x", p) for p in (PAT.broken_url, PAT.url, PAT.email, PAT.doi, PAT.phone, PAT.admin)],
    f"({has('x', PAT.numbered, 'c')} AND {has('x', PAT.reference)})",
    f"({has('x', PAT.person, 'c')} AND len(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> '')) > 5 AND ({sql_hits(norm_of('x'), SAMPLE.terms)}) = 0)",
    f"{norm_of('x')} IN ({', '.join(repr(h) for h in SAMPLE.drop_headings)})",
])


def _cleaned() -> str:
    c = "regexp_replace(text, chr(13) || chr(10) || '|' || chr(13) || '|' || chr(8232) || '|' || chr(8233), chr(10), 'g')"
    c = f"regexp_replace({c}, '[' || chr(65279) || chr(8203) || ']', '', 'g')"
    c = f"regexp_replace({c}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', ' ', 'g')"
    for p in (PAT.broken_url, PAT.url, PAT.doi, PAT.email):
        c = f"regexp_replace({c}, '{re2(p).replace('(?:^|', '(^|', 1) if p.startswith('(?i)(?<!') else '()(?:' + re2(p) + ')'}', '\\1 ', 'gi')"
    c = f"regexp_replace({c}, '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')"
    c = f"regexp_replace({c}, '(?m)^[ \\t]*[•●▪◦][ \\t]*', '- ', 'g')"
    c = f"string_split(regexp_replace({c}, '[ \\t]+', ' ', 'g'), chr(10))"
    kept = f"list_filter(list_transform({c}, lambda x: trim(x)), lambda x: x = '' OR NOT ({NOISE}))"
    return f"trim(regexp_replace(array_to_string({kept}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'))"


#: The metrics that classifiers share, as SQL over a table with a column text.
METRICS = f"""*, {NORM} AS norm, len(regexp_extract_all(text, '{W}')) AS words, {LINES} AS ls, {norm_of("substr(text, 1, 2500)")} AS norm_head, {RATIO} AS ratio,
 CASE WHEN length(text) > 0 THEN (length(text) - length(translate(text, '{ODD}', '')) + greatest(0, length(text) - length(replace(text, '"', '')) - 4)) / length(text) ELSE 0 END AS suspicious,
 {" + ".join(found("text", p) for p in (PAT.reference, PAT.url, PAT.broken_url, PAT.doi, PAT.bibliography))} AS markers"""
LEADERS, SHORT = ("len(list_filter(ls, lambda x: " + c + "))" for c in ("regexp_matches(x, '\\.{3,}\\s*\\d+$')", "length(x) <= 28"))
DROPS = f"""WITH p AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, {_cleaned()} AS text FROM documents), m AS (SELECT {METRICS} FROM p), s AS (SELECT *, {WHOLE_SCORE} AS score FROM m),
 r AS (SELECT CASE WHEN length(text) < 180 OR words < 25 THEN 'too_short' WHEN suspicious >= 0.018e0 THEN 'corrupt_extraction'
  WHEN page <= 2 AND ({sql_hits("norm_head", SAMPLE.credits)}) > 0 AND score < 3 THEN 'cover_or_credits'
  WHEN len(list_filter(ls[1:15], lambda x: {norm_of("x")} IN ({", ".join(repr(h) for h in SAMPLE.drop_headings)}))) > 0 THEN 'non_clinical_section'
  WHEN ({sql_hits("substr(norm_head, 1, 800)", SAMPLE.index_terms)}) > 0 AND ({LEADERS} >= 3 OR score < 4) THEN 'index_or_table_of_contents'
  WHEN {" OR ".join(f"starts_with(norm_head, '{h}')" for h in SAMPLE.drop_headings)} THEN 'non_clinical_section'
  WHEN (ratio >= 0.45e0 AND score < 6) OR (markers >= 5 AND score < 10) THEN 'reference_heavy'
  WHEN len(ls) >= 12 AND {SHORT} >= len(ls) * 0.72e0 AND score < 5 THEN 'fragmented_text' ELSE '' END AS drop_reason FROM s)
 SELECT drop_reason, count(*) AS pages FROM r GROUP BY drop_reason"""
TOKENS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
STRIPPED = f"trim(array_to_string(list_filter(string_split(regexp_replace(text, '{re2(PAT.answer_key)}', ' ', 'gi'), chr(10)), lambda x: NOT regexp_matches(x, '\\.{{4,}}')), chr(10)))"
FLAGS = f"""WITH m AS (SELECT {METRICS}, {STRIPPED} AS stripped, {found("text", T.EDGE_L + r"\d+[.,]\d+" + T.EDGE_R)} AS decimals,
 len(list_filter({TOKENS}, lambda x: regexp_matches(x, '\\d'))) / greatest(1, len({TOKENS})) AS numbers FROM documents),
 s AS (SELECT *, {WHOLE_SCORE} AS score, greatest(1, ceil(words * 1.35e0)) AS tokens, greatest(1, ceil(len(regexp_extract_all(stripped, '{W}')) * 1.35e0)) AS stripped_tokens, len(list_distinct(list_filter(string_split(norm, ' '), lambda x: x <> ''))) AS variety FROM m)
 SELECT doc_id, concat_ws(',', CASE WHEN tokens < 180 THEN 'short_chunk' END, CASE WHEN tokens > 1500 THEN 'long_chunk' END, CASE WHEN score < 5 THEN 'low_clinical_score' END, CASE WHEN ratio >= 0.3e0 THEN 'reference_heavy' END,
  CASE WHEN markers >= 4 THEN 'reference_markers' END, CASE WHEN suspicious >= 0.012e0 THEN 'corrupt_extraction' END, CASE WHEN numbers >= 0.38e0 THEN 'numeric_or_table_heavy' END, CASE WHEN decimals >= 12 THEN 'decimal_table_like' END,
  CASE WHEN variety < 35 THEN 'low_vocabulary_variety' END) AS flags,
 CASE WHEN stripped_tokens < 180 THEN 'too_short_after_noise_cleanup' WHEN tokens < 180 THEN 'too_short' WHEN score < 4 THEN 'low_clinical_score' WHEN ratio >= 0.45e0 OR markers >= 4 THEN 'reference_heavy'
  WHEN suspicious >= 0.012e0 THEN 'corrupt_extraction' WHEN contains(norm, 'license') THEN 'admin_or_contact_text' WHEN (numbers >= 0.38e0 OR decimals >= 12) AND score < 9 THEN 'numeric_or_table_heavy'
  WHEN {has("stripped", PAT.answer_key)} THEN 'exam_answer_key' WHEN regexp_matches(text, '\\.{{4,}}') AND score < 10 THEN 'toc_or_layout_noise' ELSE '' END AS reject_reason FROM s"""


@query("page_drop_reasons", DROPS)
def page_drop_reasons(spark, sf_dir):
    """Pages by drop reason. A text's reason as a later page, and whether an early one would be a cover, need no number, so texts go to tasks evenly, by id, and not by source."""
    texts = documents(spark, sf_dir).select("doc_id", "source", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    rows = classify.page_metrics(texts, SAMPLE, clean=True).withColumn("_late", F.lit(classify.EARLY + 1))
    rows = corpus.paged(rows.select("doc_id", "source", classify.drop_reason(SAMPLE, "_late").alias("late"), classify.credited(SAMPLE).alias("credits")))
    cover = (F.col("page") <= classify.EARLY) & F.col("credits") & ~F.col("late").isin("too_short", "corrupt_extraction")
    return rows.groupBy(F.when(cover, "cover_or_credits").otherwise(F.col("late")).alias("drop_reason")).agg(F.count("*").alias("pages"))


@query("chunk_quality_flags", FLAGS)
def chunk_quality_flags(spark, sf_dir):
    return classify.page_metrics(documents(spark, sf_dir), SAMPLE).select("doc_id", F.array_join(classify.quality_flags(), ",").alias("flags"), classify.reject_reason(("license",)).alias("reject_reason"))


def _role_points(role: str, i: int) -> str:
    home = [name for name, of in SAMPLE.section_role.items() if of == role]
    own = f"CASE WHEN section IN ({', '.join(repr(x) for x in home)}) THEN 2 ELSE 0 END" if home else "0"
    return f"(({sql_hits('norm_2000', SAMPLE.roles[role])} + {own}) * 100 - {i})"


POINTS = {role: _role_points(role, i) for i, role in enumerate(SAMPLE.roles)}


@query("content_role", OPENINGS + f""", r AS (SELECT doc_id, section, score, {", ".join(f"{x} AS r_{role}" for role, x in POINTS.items())} FROM s),
 t AS (SELECT *, greatest({", ".join(f"r_{role}" for role in POINTS)}) AS best FROM r)
 SELECT doc_id, section, CASE {" ".join(f"WHEN best > 100 AND best = r_{role} THEN '{role}'" for role in POINTS)} WHEN score >= 8 THEN 'evidence' WHEN score >= 4 THEN 'background' ELSE 'unknown' END AS role FROM t""")
def content_role(spark, sf_dir):
    """Section and role: two keyword hits of the first 2000 characters at least, else by the whole text's score."""
    rows = classify.openings(classify.page_metrics(documents(spark, sf_dir).select("doc_id", "text"), SAMPLE), SAMPLE)
    rows = rows.withColumn("section", classify.section_type(F.lit(""), F.col("norm_1500"), F.col("head_score"), SAMPLE))
    return rows.select("doc_id", "section", classify.content_role(F.col("norm_2000"), F.col("section"), F.col("clinical_score"), SAMPLE).alias("role"))


SIG = "CASE WHEN length(n) < 4 OR regexp_matches(n, '^[0-9 ]+$') THEN '' ELSE n END"
PAGED = "p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page FROM documents)"
REPEATED = f"""WITH {PAGED}, l AS (SELECT source, page, trim(unnest(string_split(text, chr(10)))) AS text FROM p),
 g AS (SELECT source, page, text AS line, {NORM} AS n FROM l WHERE text <> '' AND length(text) <= 120),
 s AS (SELECT source, page, {SIG} AS signature FROM g),
 c AS (SELECT source, signature, count(DISTINCT page) AS pages FROM s WHERE signature <> '' GROUP BY ALL),
 t AS (SELECT source, count(*) AS total FROM p GROUP BY source)
 SELECT source, signature, pages FROM c JOIN t USING (source) WHERE pages >= greatest(3, ceil(total * 0.05e0))"""


@query("repeated_lines", REPEATED)
def repeated_lines(spark, sf_dir):
    return corpus.repeated_lines(corpus.paged(documents(spark, sf_dir)), ratio=0.05).select("source", "signature", "pages")


@query("without_repeated_lines", f"""WITH cut AS (SELECT source, list(signature) AS cut FROM ({REPEATED}) GROUP BY source),
 l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), n AS (SELECT doc_id, source, pos, text, {NORM} AS n FROM l),
 s AS (SELECT doc_id, pos, text, coalesce(list_contains(cut, {SIG}), false) AS gone FROM n LEFT JOIN cut USING (source))
 SELECT doc_id, md5(coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_md5 FROM s GROUP BY doc_id""")
def without_repeated_lines(spark, sf_dir):
    pages = corpus.paged(documents(spark, sf_dir))
    return corpus.without_lines(pages, corpus.repeated_lines(pages, ratio=0.05)).select("doc_id", F.md5("text").alias("text_md5"))


@query("section_fill", f"""WITH {PAGED}, h AS (SELECT *, CASE WHEN n_chars < 600 THEN string_split(text, ' ')[1] END AS heading FROM p)
 SELECT doc_id, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY source ORDER BY page ROWS UNBOUNDED PRECEDING), '') AS section FROM h""")
def section_fill(spark, sf_dir):
    heading = F.when(F.col("n_chars") < 600, F.element_at(F.split("text", " "), 1))
    return corpus.sections(corpus.paged(documents(spark, sf_dir)), heading).select("doc_id", "section")


KEY = "array_to_string(list_slice(string_split(norm, ' '), 1, 240), ' ')"


@query("near_dedupe_keep_best", f"""WITH n AS (SELECT doc_id, n_chars, {NORM} AS norm FROM documents),
 r AS (SELECT doc_id, row_number() OVER (PARTITION BY {KEY} ORDER BY n_chars DESC, doc_id) AS r FROM n) SELECT doc_id FROM r WHERE r = 1""")
def near_dedupe_keep_best(spark, sf_dir):
    return corpus.keep_best(documents(spark, sf_dir), T.near_key(F.col("text")), [F.desc("n_chars"), "doc_id"]).select("doc_id")


@query("dedupe_audit", """WITH f AS (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r,
 first_value(source) OVER (PARTITION BY text ORDER BY doc_id) AS first FROM documents)
 SELECT sum(CAST(r > 1 AS INT)) AS exact_duplicates, sum(CAST(r > 1 AND source <> first AS INT)) AS across_sources, count(*) AS n FROM f""")
def dedupe_audit(spark, sf_dir):
    w = Window.partitionBy("text").orderBy("doc_id")
    rows = documents(spark, sf_dir).select("source", F.row_number().over(w).alias("r"), F.first("source").over(w).alias("first"))
    return rows.agg(F.sum((F.col("r") > 1).cast("long")).alias("exact_duplicates"), F.sum(((F.col("r") > 1) & (F.col("source") != F.col("first"))).cast("long")).alias("across_sources"), F.count("*").alias("n"))


@query("chunk_ids", "SELECT doc_id, printf('%s_%05d', source, row_number() OVER (PARTITION BY source ORDER BY doc_id)) AS chunk_id FROM documents")
def chunk_ids(spark, sf_dir):
    return corpus.numbered_ids(documents(spark, sf_dir), F.col("source"), ["doc_id"]).select("doc_id", "chunk_id")


@query("pack_chunks")
def pack_chunks(spark, sf_dir):
    pages = corpus.paged(documents(spark, sf_dir)).withColumn("section", F.lit(""))
    return corpus.pack_chunks(pages).select("source", "chunk", "token_estimate", F.md5("text").alias("text_md5"))


def _held(name: str, of: str) -> str:
    """Recursive SQL: whole sources, each time the one nearest to what is missing; from the third on only where that comes nearer."""
    pick = "min(struct_pack(big := CASE WHEN k = 0 AND n > round(0.75e0 * goal) THEN 1 ELSE 0 END, far := abs(goal - total - n), source := source, n := n))"
    return f"""{name}(k, chosen, total, goal) AS (SELECT 0, []::VARCHAR[], 0::BIGINT, goal FROM goal UNION ALL
  SELECT k + 1, list_append(chosen, best.source), total + best.n, goal FROM (SELECT k, chosen, total, goal, {pick} AS best FROM {name}, {of} WHERE NOT list_contains(chosen, source) AND goal > 0 GROUP BY ALL)
  WHERE NOT (k >= 3 AND best.far >= abs(goal - total)))"""


@query("document_split", f"""WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), goal AS (SELECT round(sum(n) * 0.1e0)::BIGINT AS goal FROM c), {_held("t", "c")},
 tests AS (SELECT unnest(arg_max(chosen, k)) AS source FROM t), d AS (SELECT c.* FROM c ANTI JOIN tests USING (source)), {_held("v", "d")},
 vals AS (SELECT unnest(arg_max(chosen, k)) AS source FROM v),
 s AS (SELECT n, CASE WHEN t.source IS NOT NULL THEN 'test' WHEN v.source IS NOT NULL THEN 'validation' ELSE 'train' END AS split FROM c LEFT JOIN tests t ON t.source = c.source LEFT JOIN vals v ON v.source = c.source)
 SELECT split, sum(n)::BIGINT AS chunks, count(*) AS documents FROM s GROUP BY split""")
def document_split(spark, sf_dir):
    split = corpus.split_by_document(documents(spark, sf_dir), 0.1, 0.1)
    return split.groupBy("split").agg(F.count("*").alias("chunks"), F.countDistinct("source").alias("documents"))


@query("systematic_split", """WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n, count(*) OVER (PARTITION BY source) AS c FROM documents)
 SELECT doc_id, CASE WHEN c > 2 AND (n + 7) % 20 = 0 THEN 'validation' ELSE 'train' END AS split FROM r""")
def systematic_split(spark, sf_dir):
    return corpus.systematic_split(documents(spark, sf_dir), 0.05, offset=7).select("doc_id", "split")


@query("split_leakage", "WITH s AS (SELECT text, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents) SELECT count(*) AS leaked FROM (SELECT text FROM s GROUP BY text HAVING count(DISTINCT split) > 1)")
def split_leakage(spark, sf_dir):
    rows = documents(spark, sf_dir).select("text", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"))
    return corpus.leakage(rows, "text").agg(F.count("*").alias("leaked"))


@query("stratified_quota", """WITH z AS (SELECT lang, count(*) AS c FROM documents GROUP BY lang),
 q AS (SELECT lang, greatest(1, floor(100 * c / (SELECT sum(c) FROM z))) AS quota FROM z),
 r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents)
 SELECT doc_id FROM r JOIN q USING (lang) ORDER BY CAST(r > quota AS INT), doc_id LIMIT 100""")
def stratified_quota(spark, sf_dir):
    """The sampling operator, ranked by id."""
    return corpus.stratified(documents(spark, sf_dir), "lang", "doc_id", 100, rank=F.col("doc_id")).select("doc_id")


@query("grounding_overlap", f"""WITH m AS (SELECT conv_id, min(CASE WHEN role = 'user' THEN turn END) AS u, min(CASE WHEN role = 'assistant' THEN turn END) AS a FROM conversations GROUP BY conv_id),
 x AS (SELECT m.conv_id, list_distinct(regexp_extract_all(lower(c1.text), '{W}')) AS q, list_distinct(regexp_extract_all(lower(c2.text), '{W}')) AS r
 FROM m JOIN conversations c1 ON c1.conv_id = m.conv_id AND c1.turn = m.u JOIN conversations c2 ON c2.conv_id = m.conv_id AND c2.turn = m.a)
 SELECT conv_id, len(list_intersect(q, r)) AS shared, len(q) AS context_words FROM x""")
def grounding_overlap(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    pairs = turns.groupBy("conv_id").agg(first("user").alias("q"), first("assistant").alias("r")).where("q IS NOT NULL AND r IS NOT NULL")
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(T.WORD), 0))
    return pairs.select("conv_id", F.size(F.array_intersect(words(F.col("q")), words(F.col("r")))).alias("shared"), F.size(words(F.col("q"))).alias("context_words"))


@query("last_question", "SELECT conv_id, max_by(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_question(spark, sf_dir):
    chats = evaluate.messages(table(spark, sf_dir, "conversations"))
    return chats.select("conv_id", T.last_of_role(F.col("messages"), "user").alias("question")).where("question IS NOT NULL")


@query("label_gate", "SELECT lang, count(*) AS n, sum(CAST(quality >= 1 AND toxic <= 0 AS INT)) AS accepted FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def label_gate(spark, sf_dir):
    rows = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").withColumn("clean", 1 - F.col("toxic"))
    gated = evaluate.gate(rows, {"quality": 1, "clean": 1})
    return gated.groupBy("lang").agg(F.count("*").alias("n"), F.sum((F.col("verdict") == "accept").cast("long")).alias("accepted"))


@query("resume_unlabelled", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_unlabelled(spark, sf_dir):
    return incremental.resume(documents(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("left_fill", "SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'unknown') AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def left_fill(spark, sf_dir):
    rows = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return incremental.fill_missing(rows.withColumn("quality", F.col("quality").cast("string")), {"quality": "unknown"}).select("doc_id", "quality")


@query("eval_summary", "SELECT event_type, count(*) AS n_rows, count(value) AS value_n, round(avg(value), 6) AS value_mean, min(value) AS value_min, max(value) AS value_max FROM events GROUP BY event_type")
def eval_summary(spark, sf_dir):
    return evaluate.summary(table(spark, sf_dir, "events"), "event_type", ["value"]).withColumn("value_mean", F.round("value_mean", 6))


LABELS = ["click", "purchase", "search", "signup", "view"]


@query("wide_pivot", "SELECT user_id, count(*) AS n, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def wide_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    wide = rows.groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.max("value"))
    return wide.join(rows.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")


@query("telemetry_rollup", "SELECT l_returnflag, sum(l_quantity) AS output_tokens, sum(l_linenumber) AS input_tokens, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def telemetry_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_linenumber").alias("input_tokens"), F.col("l_quantity").alias("output_tokens"), F.lit(1.0).alias("latency"))
    return evaluate.telemetry(rows, "l_returnflag").select("l_returnflag", "output_tokens", "input_tokens", F.col("latency").cast("long").alias("n"))


@query("top_customers", "SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey ORDER BY orders DESC, o_custkey LIMIT 10")
def top_customers(spark, sf_dir):
    """A top-k report."""
    return evaluate.examples(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders")), [F.desc("orders"), "o_custkey"], 10)


@query("source_balance", "SELECT source, lang, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source, lang), (lang))")
def source_balance(spark, sf_dir):
    documents(spark, sf_dir).createOrReplaceTempView("_balance")
    return spark.sql("SELECT source, lang, count(*) AS n FROM _balance GROUP BY GROUPING SETS ((source, lang), (lang))")


@query("replace_by_source", "SELECT doc_id, source, 'old' AS version FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT doc_id, source, 'new' FROM documents WHERE source IN ('src1', 'src2')")
def replace_by_source(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "source")
    return incremental.replace_by_source(rows.withColumn("version", F.lit("old")), rows.where("source IN ('src1', 'src2')").withColumn("version", F.lit("new")))


@query("changed_files", "SELECT doc_id AS source_path FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0")
def changed_files(spark, sf_dir):
    """A second snapshot in which every 7th file is new and every 11th has another size."""
    now = documents(spark, sf_dir).select(F.col("doc_id").alias("source_path"), F.col("n_chars").alias("file_size"), F.lit(1).alias("mtime"))
    before = now.where("source_path % 7 <> 0").withColumn("file_size", F.when(F.col("source_path") % 11 == 0, F.col("file_size") + 1).otherwise(F.col("file_size")))
    return incremental.changed(now, before).select("source_path")


@query("table_quality", "WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), t AS (SELECT doc_id, string_split(line, ' | ') AS cells FROM l WHERE contains(line, ' | ')) SELECT doc_id, count(*) AS row_count, max(len(cells)) AS col_count, sum(len(cells)) AS cells FROM t GROUP BY doc_id")
def table_quality(spark, sf_dir):
    rows = F.transform(F.filter(T.lines(F.col("text")), lambda x: x.contains(" | ")), lambda x: F.split(x, " \\| "))
    found = documents(spark, sf_dir).select("doc_id", rows.alias("rows")).where(F.size("rows") > 0)
    m = classify.table_metrics(F.col("rows"))
    return found.select("doc_id", m["row_count"].alias("row_count"), m["col_count"].alias("col_count"), F.size(F.flatten("rows")).alias("cells"))


@query("pair_counts", f"""WITH t AS (SELECT doc_id, greatest(1, ceil(len(regexp_extract_all(text, '{W}')) * 1.35e0)) AS t FROM documents)
 SELECT n_pairs, count(*) AS documents FROM (SELECT CASE WHEN t < 300 THEN 2 WHEN t < 600 THEN 3 WHEN t < 900 THEN 4 ELSE 5 END AS n_pairs FROM t) GROUP BY n_pairs""")
def pair_counts(spark, sf_dir):
    rows = documents(spark, sf_dir).select(classify.pair_count(T.estimate_tokens(F.col("text")), F.lit(0)).alias("n_pairs"))
    return rows.groupBy("n_pairs").agg(F.count("*").alias("documents"))


@query("cost_estimate", f"""WITH t AS (SELECT greatest(1, ceil(len(regexp_extract_all(text, '{W}')) * 1.35e0))::BIGINT AS t FROM documents)
 SELECT count(*) AS n, sum(t)::BIGINT AS input_tokens, sum(300)::BIGINT AS output_tokens, round((sum(t) * 0.25e0 + sum(300) * 2e0) / 1e6, 6) AS cost FROM t""")
def cost_estimate(spark, sf_dir):
    rows = documents(spark, sf_dir).select(T.estimate_tokens(F.col("text")).alias("t"))
    return evaluate.cost(rows, F.col("t"), F.lit(300), 0.25, 2.0).withColumn("cost", F.round("cost", 6))


@query("language_counts", "SELECT key, sum(n)::BIGINT AS n FROM (SELECT lang AS key, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT role, count(*) FROM conversations GROUP BY role) GROUP BY key")
def language_counts(spark, sf_dir):
    one = documents(spark, sf_dir).groupBy(F.col("lang").alias("key")).agg(F.count("*").alias("n"))
    return evaluate.combined(one, table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("key")).agg(F.count("*").alias("n")))


@query("topic_coverage", "WITH b AS (SELECT source AS topic, count(*) AS n FROM documents GROUP BY source), a AS (SELECT source AS topic, count(*) AS left_n FROM documents WHERE n_chars >= 2000 GROUP BY source) SELECT topic, n, coalesce(left_n, 0) AS left_n FROM b LEFT JOIN a USING (topic) WHERE coalesce(left_n, 0) / n::DOUBLE < 0.4e0")
def topic_coverage(spark, sf_dir):
    """Sources that keep under 40 % of their documents when short ones go."""
    count = lambda df: df.groupBy(F.col("source").alias("topic")).agg(F.count("*").alias("n"))
    docs = documents(spark, sf_dir)
    return evaluate.coverage(count(docs), count(docs.where("n_chars >= 2000")), 0.4).select("topic", "n", F.coalesce("left_n", F.lit(0)).alias("left_n"))


@query("qa_ids", "SELECT conv_id, printf('%s_qa_%03d', conv_id::VARCHAR, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS qa_id FROM conversations")
def qa_ids(spark, sf_dir):
    return evaluate.explode_pairs(evaluate.messages(table(spark, sf_dir, "conversations")), "conv_id", "messages").select("conv_id", "qa_id")


@query("running_samples", f"""WITH {PAGED}, b AS (SELECT source, page, text, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
 SELECT source, md5(substr(string_agg(text, chr(10) ORDER BY page), 1, 2000)) AS sample FROM b WHERE before < 3000 GROUP BY source""")
def running_samples(spark, sf_dir):
    return evaluate.running_sample(corpus.paged(documents(spark, sf_dir))).select("source", F.md5("sample").alias("sample"))
