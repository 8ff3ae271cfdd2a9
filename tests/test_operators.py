import json

import pytest
from pyspark.sql import functions as F

from textloom.functions.packs import Pack
from textloom.operators import classify, corpus, evaluate, incremental, retrieval
from textloom.sources import files
from textloom.streaming.files import process_new_files


def test_repeated_lines_need_three_pages(spark):
    rows = [(i, "s" if i < 4 else "t", f"Header line\nbody {i} words") for i in range(6)]
    pages = corpus.paged(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    found = corpus.repeated_lines(pages)
    assert [(r.source, r.signature, r.pages) for r in found.collect()] == [("s", "header line", 4)]
    left = {r.doc_id: r.text for r in corpus.without_lines(pages, found).collect()}
    assert left[0] == "body 0 words" and left[5].startswith("Header")


def test_sections_are_carried(spark):
    rows = spark.createDataFrame([("s", 1, None), ("s", 2, "A"), ("s", 3, None)], "source string, page int, h string")
    assert [r.section for r in corpus.sections(rows, F.col("h")).orderBy("page").collect()] == ["", "A", "A"]


def test_packing_keeps_words(spark):
    text = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(40)) for i in range(30))
    pages = spark.createDataFrame([("s", "", 1, text), ("s", "", 2, "last words")], "source string, section string, page int, text string")
    chunks = corpus.pack_chunks(pages, target=200).orderBy("chunk").collect()
    assert " ".join(c.text for c in chunks).split() == (text + " last words").split()
    assert max(c.token_estimate for c in chunks) <= 200


def test_hold_out_and_leakage(spark):
    rows = spark.createDataFrame([(f"d{i % 20}", i) for i in range(400)], "source string, doc_id long")
    split = corpus.split_by_document(rows, 0.2, 0.2)
    assert corpus.leakage(split).count() == 0
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 240, "validation": 80, "test": 80}
    with pytest.raises(ValueError):
        corpus.split_by_document(rows, 0.6, 0.5)


def test_role_ties_go_to_the_first(spark):
    pack = Pack(roles={"one": ("aa", "bb"), "two": ("cc", "dd")}, section_role={})
    row = spark.range(1).select(classify.content_role(F.lit("aa bb cc dd"), F.lit("x"), F.lit(0), pack)).first()
    assert row[0] == "one"


def test_page_edges(spark):
    text = " ".join(["word"] * 36)
    rows = spark.createDataFrame([(3, text[:179]), (3, text + " " * 1)], "page int, text string")
    got = [r[0] for r in classify.page_metrics(rows, Pack()).select(classify.drop_reason(Pack())).collect()]
    assert got[0] == "too_short" and got[1] != "corrupt_extraction"


def test_fusion_order(spark):
    a = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "c", 3)], "query_id int, doc_id string, rank int")
    b = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, doc_id string, rank int")
    assert [r.doc_id for r in retrieval.fuse([a, b], 3).orderBy("rank").collect()] == ["a", "b", "c"]


def test_bm25_on_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "x")], "query_id long, text string")
    assert retrieval.bm25(asked, none).count() == 0


def test_summary_skips_nulls(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 0.0)], "m string, x double")
    r = evaluate.summary(rows, "m", ["x"]).first()
    assert (r.n_rows, r.x_n, r.x_mean) == (4, 2, 0.5)


def test_telemetry(spark):
    rows = spark.createDataFrame([("q", 100, 20, 2.0), ("q", 40, 10, 1.0)], "k string, input_tokens int, output_tokens int, latency double")
    r = evaluate.telemetry(rows, "k").first()
    assert (r.total_tokens, r.latency, r.tokens_per_second) == (170, 3.0, 10.0)


def test_resume_and_replace(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, source string")
    done = spark.createDataFrame([(1, ""), (2, "boom")], "id int, error string")
    assert sorted(r.id for r in incremental.resume(rows, done, "id", "error").collect()) == [2, 3]
    assert sorted(r.id for r in incremental.replace_by_source(rows, rows.where("id = 2")).collect()) == [1, 2, 3]
    assert incremental.fill_missing(spark.createDataFrame([("",)], "m string"), {"m": "x"}).first().m == "x"


def test_jsonl(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}\n{"a": ')
    assert sorted(r.a for r in files.read_interrupted(spark, str(path), "a int").collect()) == [1, 2]
    path.write_text('{"a": 1}\n{"a"\n{"a": 2}\n')
    with pytest.raises(Exception, match="malformed"):
        files.read_interrupted(spark, str(path), "a int").collect()
    assert files.read_jsonl(spark, str(path), "a int", lenient=True).count() == 2
    assert json.loads(files.report(spark.range(1))) == {"id": 0}


def test_validation(spark):
    good = spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string")
    assert files.validated(good, "id", ["t"], 2).count() == 2
    for bad in (good.union(good), good.withColumn("t", F.lit(" "))):
        with pytest.raises(ValueError):
            files.validated(bad, "id", ["t"])


def test_stream_takes_each_file_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for n in (1, 2):
        spark.range(100 * n).write.mode("append").parquet(source)
        process_new_files(spark, source, "id long", target, str(tmp_path / "check"))
        process_new_files(spark, source, "id long", target, str(tmp_path / "check"))
    assert spark.read.parquet(target).count() == 300
