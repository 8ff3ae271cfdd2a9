"""Prompts for generators and judges as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as T

# What the models are told.
WITH_CONTEXT = "Responde la pregunta clínica en español de forma precisa y directa. Usa exclusivamente la información respaldada por el contexto recuperado. Si el contexto no permite responder, indícalo claramente."
WITHOUT_CONTEXT = "Responde la pregunta clínica en español de forma precisa y directa usando tus conocimientos generales. Si no puedes establecer la respuesta con seguridad, indícalo claramente."
HYPOTHETICAL = "Redacta un documento clínico breve en español que probablemente contendría la información necesaria para resolver la pregunta. Escribe solo el documento hipotético, sin explicar el proceso."
GENERATION = "Genera hasta %d pares de pregunta-respuesta en español basados en el fragmento anterior. No intentes acercarte a ese número si el contenido no lo justifica:\nsi el fragmento solo permite 1 o 2 pares de alta calidad, genera solo esos.\n"


def answer(question: Column, contexts: Column | None = None) -> Column:
    """The instruction, the numbered contexts if retrieval is asked for (also where it found none), and the question."""
    if contexts is None:
        return F.concat(F.lit(WITHOUT_CONTEXT + "\n\nPregunta: "), question)
    return F.concat(F.lit(WITH_CONTEXT + "\n\nContexto recuperado:\n"), T.numbered_contexts(contexts), F.lit("\n\nPregunta: "), question)


def hypothetical(question: Column) -> Column:
    return F.concat(F.lit(HYPOTHETICAL + "\n\nPregunta: "), question)


def grounded(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Contexto fuente:\n"), F.trim(context), F.lit("\n\nPregunta:\n"), question)


def generation(source: Column, section: Column, text: Column, pairs: Column) -> Column:
    """A chunk, from which up to so many pairs are asked for."""
    named = F.coalesce(F.nullif(section, F.lit("")), F.lit("sin sección"))
    head = F.concat(F.lit("Documento fuente: "), F.coalesce(source, F.lit("documento")), F.lit("\nSección: "), named)
    return F.concat(head, F.lit("\n\n<contexto>\n"), F.trim(F.coalesce(text, F.lit(""))), F.lit("\n</contexto>\n\n"), F.format_string(GENERATION, pairs))


def roundtrip(text: Column, question: Column) -> Column:
    return F.concat(F.lit("<contexto>\n"), text, F.lit("\n</contexto>\n\nPregunta:\n"), question, F.lit("\n"))


def judge(context: Column, question: Column, answer: Column, second: Column) -> Column:
    parts = [F.lit("Contexto:\n"), context, F.lit("\n\nPregunta:\n"), question, F.lit("\n\nRespuesta original:\n"), answer, F.lit("\n\nRespuesta roundtrip:\n"), second, F.lit("\n")]
    return F.concat(*parts)


def verdict(c: Column) -> Column:
    """accept or reject; whatever is neither is reject."""
    v = F.lower(F.trim(c))
    return F.when(v.isin("accept", "reject"), v).otherwise("reject")


def judgement(reply: Column, scores: tuple[str, ...] = ("faithfulness", "answer_relevancy", "roundtrip_consistency", "question_groundness")) -> Column:
    """A judge's JSON as struct: scores clamped to 0 and 1, verdict, reason; null scores and reject where it isn't JSON."""
    row = F.from_json(T.json_object(reply), ", ".join(f"{s} double" for s in scores) + ", verdict string, reason string")
    clamped = [F.when(row[s].isNotNull(), T.clamp(row[s])).alias(s) for s in scores]
    return F.struct(*clamped, verdict(row["verdict"]).alias("verdict"), row["reason"].alias("reason"))
