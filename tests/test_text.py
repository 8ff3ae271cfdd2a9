import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T

TEXTS = ["", " ", "Diag-\nnóstico ½ ﬁn ł ß", "2013-2015 aÀÉ", "The  quick\tbrown—fox 12,5 3.14", "ª º Ǆ straße", "x" * 50]


def norm(s):
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", s)).strip()


def one(spark, c, texts=TEXTS):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[0] for r in rows.orderBy("i").select(c(F.col("text"))).collect()]


def test_normalize(spark):
    assert one(spark, T.normalize) == [norm(t) for t in TEXTS]


def test_counts(spark):
    words = [len(re.findall(r"\w+", t)) for t in TEXTS]
    assert one(spark, T.word_count) == words
    assert one(spark, T.estimate_tokens) == [max(1, math.ceil(w * 1.35)) for w in words]
    assert one(spark, T.decimal_count) == [len(re.findall(r"\b\d+[.,]\d+\b", t)) for t in TEXTS]


@pytest.mark.parametrize(("line", "noise"), [("2013-2015", True), ("51504", False), ("1200 mg", False), ("see www.a.org", True), ("a@b.org", True), ("plain words", False)])
def test_noise_lines(spark, line, noise):
    assert one(spark, T.is_noise_line, [line]) == [noise]


def test_clean(spark):
    assert one(spark, T.clean_extracted, ["diag-\nnóstico\r\n\r\n\r\n\r\n• item  one\nhttp://x.y z"]) == ["diagnóstico\n\n- item one\nz"]


def test_messages(spark):
    rows = spark.sql("SELECT array(named_struct('role','user','content','Contexto: x Pregunta: why?'), named_struct('role','assistant','content','so')) AS m, 1 AS i UNION ALL SELECT array(), 2")
    got = rows.orderBy("i").select(T.question_of(F.col("m")), T.last_of_role(F.col("m"), "assistant")).collect()
    assert [tuple(r) for r in got] == [("why?", "so"), (None, None)]


def test_previews_and_keys(spark):
    assert one(spark, lambda c: T.preview(c, 10), ["a b c", "abcdefgh ijkl"]) == ["a b c", "abcdefg..."]
    assert one(spark, lambda c: T.tail_words(c, 2), ["a b c", ""]) == ["b c", ""]
    assert one(spark, T.safe_name, ["a b/c", "//"]) == ["a-b-c", "default"]
    assert one(spark, T.slug, ["/x/Guía Clínica.pdf", ""]) == ["guia_clinica", "document"]
