"""Scalar text functions as column expressions: no Python runs on executors.

Patterns are parameters of a Patterns value, whose defaults are fixed values.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word as a pattern, close to the usual Unicode word class.
WORD = r"[\p{L}\p{N}_]+"
EDGE_L, EDGE_R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


@dataclass(frozen=True)
class Patterns:
    """What counts as noise in extracted text. Fixed values."""

    url: str = r"(?i)https?://\S+|www\.\S+"
    broken_url: str = r"(?i)https?\s*:\s*/\s*/\s*\S+|www\s*\.\s*\S+"
    email: str = r"(?i)[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"
    doi: str = r"(?i)(?<![\p{L}\p{N}_])(?:doi\s*:?\s*)?10\.\d{4,9}/\S+"
    phone: str = r"(?i)(?<![\p{L}\p{N}_])(?:tel(?:e?fono)?|tel[eé]fono|fax|lada sin costo|conmutador)(?![\p{L}\p{N}_])|(?:\+?\d{1,3}[\s-]?)?(?:\(?\d{2,4}\)?[\s-]?){2,}\d{2,4}"
    # one test of a word's left edge for all alternatives but the year in brackets, as a test for each took three times as long
    reference: str = (
        r"(?i)(?<![\p{L}\p{N}_])(?:(?:doi|isbn|issn|pmid|revista|journal|vol\.?|ed\.?|editorial)(?![\p{L}\p{N}_])|\d{4};\d+|et\s+al(?![\p{L}\p{N}_])|"
        r"disponible en(?![\p{L}\p{N}_])|consultad[oa](?![\p{L}\p{N}_])|citad[oa](?![\p{L}\p{N}_]))|\(\d{4}\)"
    )
    bibliography: str = r"(?i)(?<![\p{L}\p{N}_])(?:referencias|bibliografia|bibliografía)(?![\p{L}\p{N}_])"
    admin: str = (
        r"(?i)(?<![\p{L}\p{N}_])(?:isbn|issn|copyright|derechos reservados|agradecimientos?|directorio|relacion general de autores|"
        r"relación general de autores|autores|afiliaci[oó]n|correspondencia|primera edici[oó]n|segunda edici[oó]n|editorial|comisionado|"
        r"director(?:a)?|subdirector(?:a)?|grupo de trabajo|correo electr[oó]nico|e-?mail|tel[eé]fono|fax|lada sin costo|"
        r"conflicto de inter[eé]s|financiamiento)(?![\p{L}\p{N}_])"
    )
    numbered: str = r"^\s*\d{1,3}\.\s+"
    person: str = r"^\s*[A-ZÁÉÍÓÚÜÑ][A-Za-zÁÉÍÓÚÜÑáéíóúüñ' -]{2,},\s*[A-ZÁÉÍÓÚÜÑ]"
    chapter: str = r"^(?:capitulo|cap|tema|seccion|anexo)\b"
    exam_header: str = r"(?i)(?<![\p{L}\p{N}_])RESPUESTAS?\s+ENARM(?![\p{L}\p{N}_])"
    answer_key: str = r"(?i)RESPUESTA\s+CORRECTA\s*:\s*[A-E](?![\p{L}\p{N}_])"
    dot_leader: str = r"\.{4,}"
    meta_phrase: tuple[str, ...] = (
        "según el texto", "según el fragmento", "según la tabla", "de acuerdo con el fragmento", "de acuerdo al fragmento", "con base en el texto",
        "basado en el texto", "el fragmento dice", "el contexto señala", "el contexto compartido",
    )
    meta_answer: str = r"(?<![\p{L}\p{N}_])(?:el fragmento|el contexto|el texto|seg[uú]n el|de acuerdo con|con base en)(?![\p{L}\p{N}_])"
    spanish_signals: tuple[str, ...] = (" el ", " la ", " los ", " las ", " de ", " del ", " que ", " por ", " para ", " con ", " una ", " uno ", " al ", " se ", " en ")
    spanish_letters: str = "[áéíóúñü]"


def _folding() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters below U+0250, and Latin ligatures, whose compatibility decomposition, without marks, differs: one to one, and one to several."""
    one, several = {}, []
    for code in [*range(0x80, 0x250), *range(0xFB00, 0xFB07)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if plain != chr(code):
            if len(plain) == 1:
                one[chr(code)] = plain
            else:
                several.append((chr(code), plain))
    return "".join(one), "".join(one.values()), several


_FROM, _TO, _SEVERAL = _folding()


def fold(c: Column) -> Column:
    """Compatibility decomposition without marks, exact below U+0250 and for Latin ligatures; other marks are dropped by class."""
    whole = F.translate(c, _FROM, _TO)
    longer = whole
    for a, b in _SEVERAL:
        longer = F.replace(longer, F.lit(a), F.lit(b))
    # few texts hold a character that becomes several, and many nothing to fold: a test spares them the passes
    whole = F.when(F.translate(c, "".join(a for a, _ in _SEVERAL), "") != c, longer).otherwise(whole)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(whole, r"\p{M}", "")).otherwise(c)


def normalize(c: Column) -> Column:
    """Lower-case a-z and 0-9 with single spaces."""
    return F.trim(F.regexp_replace(F.lower(fold(c)), r"[^a-z0-9]+", " "))


def slug(path: Column) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(normalize(stem), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), F.lit("")), F.lit("document"))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(word_count(c) * F.lit(1.35)).cast("int"))


def estimate_tokens_by_length(c: Column) -> Column:
    return F.greatest(F.lit(1), F.rint(F.length(c) / F.lit(4.0)).cast("int"))


def lines(c: Column) -> Column:
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _share(found: Column, of: Column) -> Column:
    return F.when(F.size(of) > 0, F.size(found) / F.size(of).cast("double")).otherwise(F.lit(0.0))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def is_noise_line(line: Column, p: Patterns = Patterns(), drop: tuple[str, ...] = (), terms: tuple[str, ...] = ()) -> Column:
    """Addresses, phone numbers, administrative lines, numbered references, and lists of names without a term of the domain."""
    bad = line.rlike(p.broken_url) | line.rlike(p.url) | (line.contains("@") & line.rlike(p.email) if p.email == Patterns.email else line.rlike(p.email)) | line.rlike(p.doi) | line.rlike(p.phone) | line.rlike(p.admin)
    bad = bad | (line.rlike(p.numbered) & line.rlike(p.reference))
    bad = bad | (line.rlike(p.person) & (F.size(tokens(line)) > 5) & (contains_count(normalize(line), terms) == 0))
    # a line with more plain letters and digits than the longest heading is none; few characters tell
    return bad | (~line.rlike(r"^(?:[^A-Za-z0-9]*+[A-Za-z0-9]){%d}" % (max(map(len, drop)) + 1)) & normalize(line).isin(list(drop))) if drop else bad


def clean_extracted(c: Column, p: Patterns = Patterns(), drop: tuple[str, ...] = (), terms: tuple[str, ...] = ()) -> Column:
    """Unify line ends, drop control characters, addresses and noise lines, join hyphenated words, keep one blank line."""
    c = F.regexp_replace(c, "\r\n|\r| | ", "\n")
    c = F.regexp_replace(c, "[﻿​]", "")
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")
    for pattern in (p.broken_url, p.url, p.doi):
        c = F.regexp_replace(c, pattern, " ")
    if p.email == Patterns.email:  # a text without the sign is spared the pass; an array of one, so that the text so far is made once
        c = F.element_at(F.transform(F.array(c), lambda x: F.when(x.contains("@"), F.regexp_replace(x, p.email, " ")).otherwise(x)), 1)
    else:
        c = F.regexp_replace(c, p.email, " ")
    c = F.regexp_replace(c, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    c = F.regexp_replace(c, r"(?m)^[ \t]*[•●▪◦][ \t]*", "- ")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    kept = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: (x == "") | ~is_noise_line(x, p, drop, terms))
    return F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def line_signature(line: Column) -> Column:
    n = normalize(line)
    return F.when((F.length(n) < 4) | n.rlike(r"^[0-9\s]+$"), "").otherwise(n)


def is_heading(line: Column, longest: int = 110, most_words: int = 14, known: tuple[str, ...] = (), p: Patterns = Patterns()) -> Column:
    """Short, and a known heading, one that begins like a chapter, numbered, or mostly upper case with six letters or more."""
    t = F.regexp_replace(line, r"^[ :\-]+|[ :\-]+$", "")
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    upper = F.length(F.regexp_replace(letters, r"[^\p{Lu}]", ""))
    numbered = t.rlike(r"^(?:\d{1,2}(?:\.\d{1,3}){0,4}|[IVXLCDM]{1,8})[\). -]+") & (words <= 12)
    named = normalize(t).isin(list(known)) | normalize(t).rlike(p.chapter)
    return (t != "") & (F.length(t) <= longest) & (words <= most_words) & (named | numbered | ((F.length(letters) >= 6) & (upper >= F.length(letters) * F.lit(0.72))))


def reference_line_ratio(c: Column, p: Patterns = Patterns()) -> Column:
    return _share(F.filter(lines(c), lambda x: x.rlike(p.reference)), lines(c))


def reference_marker_count(c: Column, p: Patterns = Patterns()) -> Column:
    return sum((F.regexp_count(c, F.lit(x)) for x in (p.reference, p.url, p.broken_url, p.doi, p.bibliography)), F.lit(0))


def suspicious_ratio(c: Column, weird: str = "‡ƒ¦„¥‚┫�") -> Column:
    """Share of odd characters, and of double quotes beyond four."""
    odd = F.length(c) - F.length(F.translate(c, weird, ""))
    quotes = F.length(c) - F.length(F.translate(c, '"', ""))
    return F.when(F.length(c) > 0, (odd + F.greatest(F.lit(0), quotes - 4)) / F.length(c).cast("double")).otherwise(F.lit(0.0))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def numeric_token_ratio(c: Column) -> Column:
    n = F.regexp_count(c, F.lit(r"(?U)\S+"))
    return F.when(n > 0, F.regexp_count(c, F.lit(r"(?U)(?<!\S)[^\s0-9]*+[0-9]\S*+")) / n.cast("double")).otherwise(F.lit(0.0))


def decimal_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(EDGE_L + r"\d+[.,]\d+" + EDGE_R))


def contains_count(c: Column, terms) -> Column:
    """How many of the terms the text contains; terms match inside words."""
    return sum((c.contains(t).cast("int") for t in terms), F.lit(0))


def marker_language(c: Column, first: tuple[str, ...], second: tuple[str, ...], names: tuple[str, str] = ("es", "en")) -> Column:
    """The language whose markers occur more often among the normalised words; ties go to the first; none is unknown."""
    w = F.split(normalize(c), " ")
    a, b = (F.size(F.filter(w, lambda x: x.isin(list(m)))) for m in (first, second))
    return F.when((a == 0) & (b == 0), "unknown").when(a >= b, names[0]).otherwise(names[1])


def density(c: Column, terms: tuple[str, ...]) -> Column:
    """Share of the normalised words that are terms, to four digits."""
    w = F.filter(F.split(normalize(c), " "), lambda x: x != "")
    return F.round(_share(F.filter(w, lambda x: x.isin(list(terms))), w), 4)


def looks_spanish(c: Column, p: Patterns = Patterns()) -> Column:
    """Four points or more: one for each frequent word, two for a letter that Spanish has."""
    low = F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    return contains_count(low, p.spanish_signals) + F.when(low.rlike(p.spanish_letters), 2).otherwise(0) >= 4


def cleanliness(question: Column, answer: Column, p: Patterns = Patterns()) -> dict[str, Column]:
    """Whether question and answer speak of their source, question marks, and words of the answer."""
    meta = lambda c: contains_count(F.lower(c), p.meta_phrase) > 0
    return {"question_has_meta_reference": meta(question), "answer_has_meta_reference": meta(answer), "question_mark_count": F.regexp_count(question, F.lit("[?¿]")), "answer_word_count": F.size(tokens(answer))}


def meta_flags(question: Column, answer: Column, p: Patterns = Patterns()) -> dict[str, Column]:
    """Whether an answer leans on its source, and whether a question asks for two things."""
    return {"meta_answer": F.lower(answer).rlike(p.meta_answer), "question_with_y": F.lower(question).contains(" y ")}


def row_id(ordinal: Column, *names: Column) -> Column:
    """The first name that is neither null nor empty, else the row's number."""
    return F.coalesce(*[F.nullif(F.trim(n.cast("string")), F.lit("")) for n in names], ordinal.cast("string"))


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(tokens(c), 1, n), " ")


def document_fingerprint(c: Column) -> Column:
    return F.array_join(F.slice(F.filter(F.split(normalize(c), " "), lambda w: F.length(w) > 3), 1, 100), " ")


def near_key(c: Column, kind: str = "folded", n: int = 240) -> Column:
    """Keys of near-duplicates over the first n words: folded, lower, or lower with the letters of Spanish only."""
    if kind == "folded":
        return first_words(normalize(c), n)
    if kind == "lower":
        return first_words(F.lower(c), n)
    return first_words(F.regexp_replace(F.lower(c), r"[^a-z0-9áéíóúüñ]+", " "), n)


def tail_words(c: Column, n: int) -> Column:
    w = tokens(c)
    return F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - n + 1), F.lit(n)), " ")


def overlap(context: Column, answer: Column) -> Column:
    """Shared distinct words as a share of the context's; 0 for an empty context."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(WORD), 0))
    return _share(F.array_intersect(words(context), words(answer)), words(context))


def preview(c: Column, n: int) -> Column:
    t = collapse(c)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, n - 3)), F.lit("...")))


def safe_name(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(c, r"[^a-zA-Z0-9._-]+", "-"), r"^-+|-+$", ""), F.lit("")), F.lit("default"))


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")


def strip_layout_noise(c: Column, p: Patterns = Patterns()) -> Column:
    kept = F.filter(F.split(F.regexp_replace(c, p.answer_key, " "), "\n"), lambda x: ~x.rlike(p.dot_leader))
    return F.trim(F.array_join(kept, "\n"))


def sha_key(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", *columns), 256)


def numbered_contexts(contexts: Column) -> Column:
    return F.array_join(F.transform(contexts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n\n")


def last_of_role(messages: Column, role: str) -> Column:
    """Content of the last message of a role, null without one; messages: array of struct(role, content)."""
    return F.try_element_at(F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: m["content"]), F.lit(-1))


def question_of(messages: Column, marker: str = "Pregunta:") -> Column:
    """The last user message, from behind the first marker if it has one."""
    q = last_of_role(messages, "user")
    return F.trim(F.when(q.contains(marker), F.regexp_replace(q, r"(?s)^.*?" + marker, "")).otherwise(q))


def json_object(c: Column) -> Column:
    """The outermost braces of a text, without code fences around them; null without any."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))
