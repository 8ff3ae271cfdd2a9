"""Ordered classifiers of pages, chunks, documents and tables: chains of conditions over metrics computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.packs import Pack


#: The last page that can be a cover or credits.
EARLY = 2


def score(norm: Column, words: Column, reference_ratio: Column, pack: Pack) -> Column:
    """One for a word, two for a phrase, one for an action; two each from 120 and 350 words on, three off for references."""
    hits = sum(((2 if " " in t else 1) * norm.contains(t).cast("int") for t in pack.terms), F.lit(0)) + T.contains_count(norm, pack.actions)
    extra = F.when(words >= 120, 2).otherwise(0) + F.when(words >= 350, 2).otherwise(0) - F.when(reference_ratio >= 0.35, 3).otherwise(0)
    return F.greatest(F.lit(0), hits + extra).cast("int")


def page_metrics(df: DataFrame, pack: Pack, text: str = "text", clean: bool = False) -> DataFrame:
    """Add the metrics that classifiers share, so that each is computed once; of the cleaned text if so asked (pages)."""
    if clean:
        df = df.withColumn("page_text", T.clean_extracted(F.col(text), drop=pack.drop_headings, terms=pack.terms))
        text = "page_text"
    c = F.col(text)
    df = df.withColumns({"norm": T.normalize(c), "words": T.word_count(c), "page_lines": T.lines(c), "norm_head": T.normalize(F.substring(c, 1, 2500))})
    p = T.Patterns()
    lines = F.col("page_lines")
    share = F.when(F.size(lines) > 0, F.size(F.filter(lines, lambda x: x.rlike(p.reference))) / F.size(lines).cast("double")).otherwise(F.lit(0.0))
    df = df.withColumn("reference_ratio", share)
    return df.withColumns({"chars": F.length(c), "token_estimate": T.estimate_tokens(c), "clinical_score": score(F.col("norm"), F.col("words"), F.col("reference_ratio"), pack), "suspicious": T.suspicious_ratio(c), "markers": T.reference_marker_count(c), "numeric_ratio": T.numeric_token_ratio(c), "decimals": T.decimal_count(c)})


def credited(pack: Pack) -> Column:
    """Whether a page with page_metrics is a cover or credits if it is an early one, and neither too short nor corrupt."""
    return (T.contains_count(F.col("norm_head"), pack.credits) > 0) & (F.col("clinical_score") < 3)


def drop_reason(pack: Pack, page: str = "page") -> Column:
    """Why a page with page_metrics is dropped; empty if it is kept. The first rule that holds decides."""
    c, s, lines = F.col, F.col("clinical_score"), F.col("page_lines")
    credits = (c(page) <= EARLY) & credited(pack)
    headings = F.exists(F.slice(lines, 1, 15), lambda x: T.normalize(x).isin(list(pack.drop_headings)))
    leaders = F.size(F.filter(lines, lambda x: x.rlike(r"\.{3,}\s*\d+$")))
    index = (T.contains_count(F.substring("norm_head", 1, 800), pack.index_terms) > 0) & ((leaders >= 3) | (s < 4))
    prefix = F.lit(False)
    for term in pack.drop_headings:
        prefix = prefix | c("norm_head").startswith(term)
    short = F.size(F.filter(lines, lambda x: F.length(x) <= 28))
    fragmented = (F.size(lines) >= 12) & (short >= F.size(lines) * F.lit(0.72)) & (s < 5)
    return (
        F.when((c("chars") < 180) | (c("words") < 25), "too_short")
        .when(c("suspicious") >= 0.018, "corrupt_extraction")
        .when(credits, "cover_or_credits")
        .when(headings, "non_clinical_section")
        .when(index, "index_or_table_of_contents")
        .when(prefix, "non_clinical_section")
        .when((c("reference_ratio") >= 0.45) & (s < 6), "reference_heavy")
        .when((c("markers") >= 5) & (s < 10), "reference_heavy")
        .when(fragmented, "fragmented_text")
        .otherwise("")
    )


def quality_flags() -> Column:
    """Flags of a chunk with page_metrics, in fixed order."""
    c = F.col
    variety = F.size(F.array_distinct(F.filter(F.split("norm", " "), lambda w: w != "")))
    rules = [
        (c("token_estimate") < 180, "short_chunk"), (c("token_estimate") > 1500, "long_chunk"), (c("clinical_score") < 5, "low_clinical_score"),
        (c("reference_ratio") >= 0.3, "reference_heavy"), (c("markers") >= 4, "reference_markers"), (c("suspicious") >= 0.012, "corrupt_extraction"),
        (c("numeric_ratio") >= 0.38, "numeric_or_table_heavy"), (c("decimals") >= 12, "decimal_table_like"), (variety < 35, "low_vocabulary_variety"),
    ]
    return F.array_compact(F.array(*[F.when(x, name) for x, name in rules]))


def reject_reason(admin: tuple[str, ...], least_tokens: int = 180, least_score: int = 4, p: T.Patterns = T.Patterns(), text: str = "text") -> Column:
    """Why a chunk with page_metrics is no training text; empty if it is accepted."""
    c, s = F.col, F.col("clinical_score")
    stripped = T.strip_layout_noise(c(text), p)
    return (
        F.when(T.estimate_tokens(stripped) < least_tokens, "too_short_after_noise_cleanup")
        .when(c("token_estimate") < least_tokens, "too_short")
        .when(s < least_score, "low_clinical_score")
        .when((c("reference_ratio") >= 0.45) | (c("markers") >= 4), "reference_heavy")
        .when(c("suspicious") >= 0.012, "corrupt_extraction")
        .when(T.contains_count(c("norm"), admin) > 0, "admin_or_contact_text")
        .when(((c("numeric_ratio") >= 0.38) | (c("decimals") >= 12)) & (s < 9), "numeric_or_table_heavy")
        .when(stripped.rlike(p.answer_key), "exam_answer_key")
        .when(c(text).rlike(p.dot_leader) & (s < 10), "toc_or_layout_noise")
        .otherwise("")
    )


def _first(c: Column, table: dict[str, tuple[str, ...]], chain):
    for name, words in table.items():
        cond = T.contains_count(c, words) > 0
        chain = F.when(cond, name) if chain is None else chain.when(cond, name)
    return chain


def openings(df: DataFrame, pack: Pack, text: str = "text") -> DataFrame:
    """Add what section and role look at: the normalised first 1500 and 2000 characters, and the score of the first 1000."""
    c = F.col(text)
    head = F.substring(c, 1, 1000)
    df = df.withColumns({"norm_1500": T.normalize(F.substring(c, 1, 1500)), "norm_2000": T.normalize(F.substring(c, 1, 2000)), "head_norm": T.normalize(head), "head_words": T.word_count(head), "head_references": T.reference_line_ratio(head)})
    return df.withColumn("head_score", score(F.col("head_norm"), F.col("head_words"), F.col("head_references"), pack)).drop("head_norm", "head_words", "head_references")


def section_type(heading: Column, norm: Column, clinical: Column, pack: Pack) -> Column:
    """By heading, else by the opening, else by the opening's score (see openings); the pack's order decides."""
    chain = _first(T.normalize(heading), pack.sections, None)
    chain = _first(F.substring(norm, 1, 500), pack.sections, chain)
    return chain.when(clinical >= 5, "clinical_content").otherwise("unknown")


def content_role(norm: Column, section: Column, clinical: Column, pack: Pack) -> Column:
    """The role with most keywords, two more for the section's own; ties go to the pack's order; two hits are needed."""
    home = F.create_map(*[F.lit(x) for kv in pack.section_role.items() for x in kv])
    rows = [F.struct((T.contains_count(norm, words) + F.when(F.try_element_at(home, section) == role, 2).otherwise(0)).alias("n"), F.lit(-i).alias("o"), F.lit(role).alias("role")) for i, (role, words) in enumerate(pack.roles.items())]
    best = F.array_max(F.array(*rows))
    return F.when(best["n"] >= 2, best["role"]).when(clinical >= 8, "evidence").when(clinical >= 4, "background").otherwise("unknown")


def topics(norm: Column, pack: Pack) -> Column:
    return F.array_compact(F.array(*[F.when(T.contains_count(norm, words) > 0, name) for name, words in pack.topics.items()]))


def document_ocr_status(needs: Column, pages: Column) -> Column:
    ratio = needs / F.greatest(pages, F.lit(1))
    return F.when(needs == 0, "clean").when(ratio <= 0.2, "minor_ocr").when(ratio <= 0.5, "needs_ocr").otherwise("ocr_dominated")


def inclusion(pages: Column, size: Column, sample: Column, markers: tuple[str, ...] = ("el", "la", "de", "y", "en", "que", "a", "los", "del")) -> Column:
    """Why a document is excluded; empty if it is included."""
    blank = F.regexp_count(sample, F.lit("\n\n")) / F.greatest(F.lit(1), F.length(sample))
    return F.when(pages < 3, "empty").when(size < 1024, "corrupted").when((sample != "") & (blank > 0.8), "empty").when((F.length(sample) > 200) & (T.contains_count(F.lower(sample), markers) < 3), "wrong_language").otherwise("")


def table_metrics(rows: Column) -> dict[str, Column]:
    """Of an array of arrays of cells: rows, columns, and shares of empty, numeric and short cells."""
    cells = F.transform(F.flatten(rows), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    full = F.filter(cells, lambda x: x != "")
    share = lambda found, of: F.when(F.size(of) > 0, F.size(found) / F.size(of).cast("double")).otherwise(F.lit(0.0))
    return {"row_count": F.size(rows), "col_count": F.array_max(F.transform(rows, lambda r: F.size(r))), "empty_ratio": share(F.filter(cells, lambda x: x == ""), cells), "numeric_ratio": share(F.filter(full, lambda x: x.rlike(r"\d")), full), "short_ratio": share(F.filter(full, lambda x: F.length(x) <= 3), full)}


def padded(rows: Column) -> Column:
    """Rows of a table made equally long with empty cells, cells trimmed and nulls empty."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    return F.transform(rows, lambda r: F.concat(F.transform(r, lambda x: F.trim(F.coalesce(x, F.lit("")))), F.array_repeat(F.lit(""), width - F.size(r))))


def pair_count(tokens: Column, clinical: Column, least: int = 2, most: int = 5) -> Column:
    """How many question pairs a chunk is good for."""
    base = F.when(tokens < 300, 2).when(tokens < 600, 3).when(tokens < 900, 4).otherwise(5) + F.when(clinical >= 12, 1).otherwise(0)
    return F.least(F.lit(most), F.greatest(F.lit(least), base))


def keeps_chunk(role: Column, language: Column, pack: Pack, languages: tuple[str, ...] = ("es", "unknown")) -> Column:
    """Whether a chunk stays in the training text: no dropped role, and one of the languages."""
    return ~F.coalesce(role, F.lit("")).isin(list(pack.dropped_roles)) & F.coalesce(language, F.lit("unknown")).isin(list(languages))


def is_clinical(role: Column, pack: Pack) -> Column:
    return F.coalesce(role.isin(list(pack.clinical_roles)), F.lit(False))


def source_filter(rows: DataFrame, language: Column, clinical: Column, role: Column, pack: Pack, text: str = "text", least_score: int = 4) -> DataFrame:
    """Add kept: Spanish by its metadata (by its words where they say nothing), a score of at least so much, and a clinical role."""
    spanish = F.when(F.coalesce(language, F.lit("")) != "", language == "es").otherwise(T.looks_spanish(F.col(text)))
    return rows.withColumn("kept", spanish & (clinical >= least_score) & is_clinical(role, pack))


#: What a file name says about a document's type, and what its opening says. Fixed values.
NAME_TYPES = {
    "gpc": ("gpc", "guía de práctica", "guia de practica", "clinical practice"),
    "protocol": ("protocolo", "protocol", "algoritmo", "algorithm", "procedimiento"),
    "manual": ("manual", "texto", "universidad", "académico", "academico"),
    "article": ("artículo", "articulo", "article", "paper", "pubmed"),
}
OPENING_TYPES = {
    "gpc": ("guía de práctica clínica", "evidencia científica", "nivel de evidencia", "recomendación formal", "grado de recomendación", "consenso"),
    "protocol": ("protocolo de", "algoritmo de", "flujo de", "procedimiento de", "manejo de", "pasos a seguir", "indicaciones"),
    "article": ("resumen", "abstract", "objetivo", "métodos", "resultados", "conclusiones", "palabras clave", "doi", "introducción"),
    "book": ("editorial", "isbn", "primera edición", "segunda edición", "derechos reservados", "tabla de contenido", "prólogo", "prefacio"),
}
CHAPTER_NAMES = ("cap", "capítulo", "capitulo", "chapter")


def document_type(name: Column, text: Column, names=NAME_TYPES, openings=OPENING_TYPES, chapters=CHAPTER_NAMES) -> Column:
    """By name, else by the type with most markers in the first 5000 characters (two at least, ties to the first), else a book by a chapter's name."""
    low, head = F.lower(name), F.lower(F.substring(text, 1, 5000))
    chain = _first(low, names, None)
    rows = [F.struct(T.contains_count(head, words).alias("n"), F.lit(-i).alias("o"), F.lit(kind).alias("kind")) for i, (kind, words) in enumerate(openings.items())]
    best = F.array_max(F.array(*rows))
    return chain.when(best["n"] >= 2, best["kind"]).when(T.contains_count(low, chapters) > 0, "book").otherwise("unknown")


def evaluated_inclusion(pages: Column, ocr_pages: Column, ratio: Column, least_ratio: float = 0.10, most_ocr: float = 0.50, least_pages: int = 3) -> Column:
    """struct(status, reason, detail); the first rule that holds decides, and reason and detail are null for what is included."""
    share = F.when(pages > 0, ocr_pages / pages).otherwise(F.lit(0.0))
    percent = lambda x: F.format_string("%.1f%%", x * 100)
    out = lambda why, detail: F.struct(F.lit("excluded").alias("status"), F.lit(why).alias("reason"), detail.alias("detail"))
    ocr = out("ocr_dominated", F.concat(ocr_pages.cast("string"), F.lit("/"), pages.cast("string"), F.lit(" páginas ("), percent(share), F.lit(") requieren OCR")))
    poor = out("non_clinical", F.concat(F.lit("Ratio de términos clínicos: "), percent(ratio), F.lit(f" (mínimo: {least_ratio:.0%})")))
    short = out("empty", F.concat(F.lit("Solo "), pages.cast("string"), F.lit(f" páginas (mínimo: {least_pages})")))
    good = F.struct(F.lit("included").alias("status"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("detail"))
    return F.when(share > most_ocr, ocr).when(ratio < least_ratio, poor).when(pages < least_pages, short).otherwise(good)


def cell_metrics(rows: Column) -> dict[str, Column]:
    """Of an array of arrays of cells: shares of filled, numeric and short cells, and words in a filled cell, mean and most."""
    cells = F.transform(F.flatten(rows), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    full = F.filter(cells, lambda x: x != "")
    words = F.transform(full, lambda x: F.size(T.tokens(x)))
    share = lambda found, of: F.when(F.size(of) > 0, F.size(found) / F.size(of).cast("double")).otherwise(F.lit(0.0))
    total = F.aggregate(words, F.lit(0), lambda s, x: s + x)
    return {
        "non_empty_density": share(full, cells), "numeric_ratio": share(F.filter(full, lambda x: x.rlike(r"\d")), full), "short_cell_ratio": share(F.filter(full, lambda x: F.length(x) <= 3), full),
        "avg_words_per_cell": F.when(F.size(full) > 0, total / F.size(full).cast("double")).otherwise(F.lit(0.0)), "max_words_cell": F.coalesce(F.array_max(words), F.lit(0)), "non_empty_cells": F.size(full),
    }


def header_like(first_row: Column) -> Column:
    """Two filled cells or more, of six words at most each."""
    full = F.filter(F.transform(first_row, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return (F.size(full) >= 2) & F.forall(full, lambda x: F.size(T.tokens(x)) <= 6)


def layout_fragment(n_rows: Column, n_cols: Column, m: dict[str, Column]) -> Column:
    """Whether a table is a piece of a page's layout, by its metrics (see cell_metrics)."""
    few = m["numeric_ratio"] < 0.1
    sparse = (n_cols >= 6) & (n_rows >= 30) & (m["numeric_ratio"] < 0.08)
    return sparse | ((m["avg_words_per_cell"] > 8) & few) | (m["max_words_cell"] > 45) | ((m["short_cell_ratio"] > 0.55) & few) | (m["non_empty_density"] < 0.35)


def table_gate(n_rows: Column, n_cols: Column, m: dict[str, Column], header: Column, by_text: bool = False, least_rows: int = 2, least_cols: int = 2) -> Column:
    """Whether a table is kept: large and full enough, no layout; tables found by text alone must be numeric too."""
    good = (n_rows >= least_rows) & (n_cols >= least_cols) & (m["non_empty_cells"] >= least_rows * least_cols) & ~layout_fragment(n_rows, n_cols, m)
    return good & (m["numeric_ratio"] >= 0.18) if by_text else good
