import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.packs import SAMPLE
from textloom.plans import queries  # noqa: F401
from textloom.plans.registry import ORACLES, QUERIES


def test_page_texts_are_dealt_by_id_and_not_by_source(spark, tmp_path):
    """Pages of all kinds around the second of a source, against the SQL; only numbers and reasons go by source."""
    credit, body = SAMPLE.credits[0], "plain words of a page that says little " * 20
    texts = ["short", body, f"{credit} {body}", f"{credit} short", f"{credit} ‡‡‡‡‡‡‡‡‡‡‡‡‡‡‡‡‡‡‡‡‡‡‡‡‡‡‡‡‡‡‡‡‡‡‡‡ {body}", f"{SAMPLE.drop_headings[0]}\n{body}", f"a@b.org {credit} {body}"]
    rows = [(i, texts[(i * 5 + i // 7) % len(texts)], f"s{i % 9}") for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["page_drop_reasons"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted((r.drop_reason, r.pages) for r in df.collect())
    assert got == sorted(db.execute(ORACLES["page_drop_reasons"]).fetchall()) and "cover_or_credits" in dict(got)
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    assert not any("Exchange hashpartitioning(_by" in above and "text#" in below for above, below in zip(plan, plan[1:]))
    assert not any("Window" in line and "text#" in line for line in plan)


@pytest.mark.parametrize("line", [h.upper() + x for h in SAMPLE.drop_headings[:6] for x in ("", " !" * 90, "x", " 1")] + ["a@b.c", "@", "no sign", "é" * 300, "Í n d i c e"])
def test_a_heading_is_found_whatever_stands_around_it(spark, line):
    row = spark.createDataFrame([(line,)], "x string").select(T.is_noise_line(F.col("x"), drop=SAMPLE.drop_headings).alias("a"), (T.is_noise_line(F.col("x")) | T.normalize(F.col("x")).isin(list(SAMPLE.drop_headings))).alias("b"), T.clean_extracted(F.col("x")).alias("c")).first()
    assert row.a == row.b and "a@b.c" not in row.c
