import math
import sys
from difflib import SequenceMatcher

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from textloom.functions import prompts
from textloom.operators import incremental, manifest, models, similarity
from textloom.sources import files
from textloom.streaming import files as streams

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests


def test_inventory(spark, tmp_path):
    rows = [("a", "a.pdf", "guide", "clean", "included", None, None), ("b", "b.pdf", None, None, "excluded", None, "x"), ("c", "c.pdf", "guide", "clean", "excluded_with_reason", "short", "2"), ("d", None, None, None, None, None, None)]
    entries = spark.createDataFrame(rows, manifest.ENTRY)
    assert {r[0] for r in manifest.excluded_ids(entries).collect()} == {"b", "c"}
    assert {r[0] for r in manifest.without_excluded(entries.select("pdf_id"), entries).collect()} == {"a", "d"}
    assert {tuple(r) for r in manifest.distributions(entries).collect()} >= {("doc_type", "guide", 2), ("doc_type", "unknown", 2), ("ocr_status", "unknown", 2)}
    assert manifest.exclusion_totals(entries).first().asDict() == {"total_documents": 4, "excluded_count": 2, "included_count": 2, "exclusion_rate": 0.5}
    assert manifest.exclusion_totals(entries.limit(0)).first()["exclusion_rate"] == 0
    assert {tuple(r) for r in manifest.exclusion_counts(entries).collect()} == {("unknown", 1), ("short", 1)}
    newer = manifest.upsert(entries, spark.createDataFrame([("a", "z.pdf", "x", None, None, None, None)], manifest.ENTRY))
    assert newer.count() == 4 and newer.where("pdf_id = 'a'").first()["source_pdf"] == "z.pdf"
    assert manifest.of_type(entries, "guide").count() == 2
    manifest.save(entries, f"{tmp_path}/inventory")
    assert sorted(manifest.load(spark, f"{tmp_path}/inventory").collect()) == sorted(entries.collect())
    assert manifest.load(spark, f"{tmp_path}/none").count() == 0


def test_similar_documents_match_brute_force(spark):
    base = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango"
    texts = {f"d{i:02}": base.replace(w, w[::-1]) for i, w in enumerate(base.split()[:12])}
    texts |= {"e1": base, "e2": base, "f1": base + " extra words here and there", "g1": "entirely different content without likeness", "h1": ""}
    rows = spark.createDataFrame([(k, v) for k, v in texts.items()] + [(None, base), ("z", None)], "pdf_id string, text_sample string")
    got = {(r["id_a"], r["id_b"]): r["similarity"] for r in similarity.similar_documents(rows, blocks=4).collect()}
    prints = {r["pdf_id"]: r["p"] for r in rows.select("pdf_id", similarity.T.document_fingerprint(F.col("text_sample")).alias("p")).collect() if r["pdf_id"] and r["p"]}
    first = {}
    for k in sorted(prints):
        first.setdefault(prints[k], k)
    want = {(first[p], k): 1.0 for k, p in prints.items() if first[p] != k}
    for i, a in enumerate(ids := sorted(first.values())):
        for b in ids[i + 1 :]:
            if (r := SequenceMatcher(None, prints[a], prints[b]).ratio()) >= 0.85:
                want[a, b] = round(r, 4)
    assert got == want and len(got) > 50
    left = similarity.without_duplicates(rows.where("pdf_id is not null"), similarity.similar_documents(rows, blocks=4))
    assert {r[0] for r in left.collect()} == set(texts) - {b for _, b in want} | {"z"}


class Moody:
    """Refuses, fails, is busy or cut short as the prompt asks."""

    def __init__(self):
        self.calls = 0

    def generate(self, prompt):
        self.calls += 1
        if prompt == "no":
            raise models.Refused("no")
        if prompt == "bad":
            raise RuntimeError("bad")
        if prompt == "busy" and self.calls % 3:
            raise models.Busy("later")
        return models.Reply("" if prompt == "nothing" else prompt.upper(), "length" if prompt == "long" else "stop", 1, 2)


def test_generation_states(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(["hi", "no", "bad", "nothing", "long", None])], "i int, p string").coalesce(1)
    got = {r["i"]: r["r"] for r in rows.select("i", models.generate(F.col("p"), Moody, base=0.0).alias("r")).collect()}
    assert [got[i]["status"] for i in range(6)] == ["ok", "refused", "failed", "empty", "failed", None]
    assert got[0]["text"] == "HI" and got[0]["output_tokens"] == 2 and got[2]["attempts"] == 1 and "length" in got[4]["error"]
    waits = []
    assert models.ask(Moody(), "busy", pause=waits.append)["attempts"] == 3 and [int(w) for w in waits] == [2, 4]
    busy = type("Busy5", (), {"generate": lambda self, p: (_ for _ in ()).throw(models.Busy("x"))})()
    assert models.ask(busy, "x", pause=waits.append)["status"] == "failed" and len(waits) == 6


def test_encoders(spark):
    rows = spark.createDataFrame([("ab",), (None,)], "t string")
    for r in rows.select(models.encode(F.col("t"), models.LetterEncoder).alias("v")).collect():
        assert len(r["v"]) == 27 and math.isclose(sum(x * x for x in r["v"]), 1)
    for vectors in ([[0.0]], [[1.0], [1.0]], [[math.nan]]):
        bad = lambda vectors=vectors: type("E", (), {"encode": lambda self, t: vectors})()
        with pytest.raises(Exception, match="vectors"):
            rows.limit(1).select(models.encode(F.col("t"), bad)).collect()


async def slow(**_):
    import asyncio

    await asyncio.sleep(5)


def test_scores_isolate_failures(spark):
    names = ("semantic_similarity", "answer_relevancy", "answer_correctness", "faithfulness", "context_recall")
    factory = lambda: dict(zip(names, [models.overlap_metric, lambda **k: float("inf"), lambda **k: 1 / 0, slow, lambda **k: len(k["retrieved_contexts"])], strict=True))
    rows = spark.createDataFrame([("q", "a b", "a c", ["x", "y"]), ("q", "a", "a", None)], "user_input string, response string, reference string, retrieved_contexts array<string>").coalesce(1)
    a, b = [r["s"] for r in rows.select(models.score(F.struct("*"), factory, names, timeout=0.2).alias("s")).collect()]
    assert (a["semantic_similarity"], a["context_recall"]) == (0.5, 2.0) and a["answer_relevancy"] is a["answer_correctness"] is a["faithfulness"] is None
    assert sorted(e.split(":")[0] for e in a["errors"]) == ["answer_correctness", "answer_relevancy", "faithfulness"]
    assert b["context_recall"] is b["faithfulness"] is None and b["semantic_similarity"] == 1.0 and len(b["errors"]) == 2


def test_registry_and_steps(spark):
    specs = [models.ModelSpec("base", "m", "m"), models.ModelSpec("tuned", "t", "m", "t")]
    assert models.registry(spark, specs).count() == 2
    assert models.adapter(specs[0], "/x") is None and models.adapter(specs[1]) == "t"
    assert models.adapter(specs[1], "/x", {"adapter_config.json", "adapter_model.bin"}) == "/x"
    with pytest.raises(FileNotFoundError):
        models.adapter(specs[1], "/x", {"adapter_config.json"})
    with pytest.raises(ValueError, match="unique"):
        models.registry(spark, [specs[0], specs[0]])
    ran = []
    steps = [(n, lambda n=n: ran.append(n)) for n in "abc"]
    assert models.run_steps(steps, frozenset("b")) == [("a", "done"), ("b", "skipped"), ("c", "done")] and ran == ["a", "c"]
    assert models.run_steps(steps, dry_run=True)[0] == ("a", "planned") and ran == ["a", "c"]
    with pytest.raises(ValueError, match="unknown strategy"):
        models.search("x", spark.range(1), {})


def test_prompts_and_judgements(spark):
    row = spark.createDataFrame([("q?", ["one", "two"], '```json\n{"faithfulness": 1.7, "answer_relevancy": -1, "verdict": " Accept ", "reason": "r"}\n```')], "q string, c array<string>, j string")
    got = row.select(prompts.answer(F.col("q"), F.col("c")).alias("a"), prompts.answer(F.col("q")).alias("n"), prompts.grounded(F.lit(" x "), F.col("q")).alias("g"), prompts.generation(F.lit(None).cast("string"), F.lit(""), F.lit(" t "), F.lit(3)).alias("p"), prompts.judgement(F.col("j")).alias("j"), prompts.judgement(F.lit("none")).alias("bad")).first()
    assert got["a"].endswith("Contexto recuperado:\n[1] one\n\n[2] two\n\nPregunta: q?") and "recuperado:" not in got["n"]
    assert got["g"] == "Contexto fuente:\nx\n\nPregunta:\nq?"
    assert got["p"].startswith("Documento fuente: documento\nSección: sin sección\n\n<contexto>\nt\n</contexto>\n\nGenera hasta 3 pares")
    assert (got["j"]["faithfulness"], got["j"]["answer_relevancy"], got["j"]["verdict"], got["j"]["question_groundness"]) == (1.0, 0.0, "accept", None)
    assert got["bad"]["verdict"] == "reject" and got["bad"]["faithfulness"] is None


def test_streaming_merge_replaces_sources(spark, tmp_path):
    source, target, ck = (f"{tmp_path}/{n}" for n in ("in", "out", "ck"))
    schema = "source string, v int"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    put([("a", 1), ("a", 2), ("b", 3)])
    merge = lambda: streams.merge_by_source(spark, source, schema, target, ck)
    with pytest.raises(ValueError, match="no version"):
        streams.latest(spark, target)
    merge()
    merge()
    assert sorted(map(tuple, streams.latest(spark, target).collect())) == [("a", 1), ("a", 2), ("b", 3)]
    put([("a", 9), ("c", 4)])
    merge()
    put([("c", 5)])
    merge()
    assert sorted(map(tuple, streams.latest(spark, target).collect())) == [("a", 9), ("b", 3), ("c", 5)]
    assert len(streams.versions(spark, target)) == 2  # the one before is kept for readers


def test_units_are_resumed(spark, tmp_path):
    units = spark.range(10).withColumnRenamed("id", "unit")
    log = f"{tmp_path}/log"
    state = lambda rows: rows.withColumn("status", F.when(F.col("unit") % 3 == 0, "failed").otherwise("ok"))
    assert streams.append_results(units, log, state, "unit") == 10
    found = streams.progress(spark.read.parquet(log), units, "unit", 2).first()
    assert (found["processed"], found["failed"], found["remaining"], found["rate"], found["eta_seconds"], found["state"]) == (6, 4, 0, 5.0, 0, "complete")
    assert streams.append_results(units, log, lambda rows: rows.withColumn("status", F.lit("empty")), "unit") == 4
    assert streams.append_results(units, log, state, "unit") == 0
    nothing = streams.progress(spark.read.parquet(log).limit(0), units, "unit", 0).first()
    assert (nothing["remaining"], nothing["eta_seconds"], nothing["state"]) == (10, None, "running")


def test_numbered_lines_and_ids(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": "a"}\n\n{"id": "b"}\n{"id": ""}\n')
    assert [(r["line"], r["id"]) for r in files.read_numbered(spark, str(p), "id string").orderBy("line").collect()] == [(1, "a"), (3, "b"), (4, "")]
    assert {r[0] for r in files.known_ids(spark, str(p), "id").collect()} == {"a", "b"}
    p.write_text('{"id": "a"}\n{"id": \n')
    with pytest.raises(Exception, match="line 2"):
        files.read_numbered(spark, str(p), "id string").collect()


def test_markdown(spark):
    df = spark.createDataFrame([("a|b", 0.256, 3), ("c", None, 4)], "name string, rate double, n int")
    text = files.markdown(df, {"name": "{}", "rate": "{:.1%}", "n": "{}"}, "Report", ("note",))
    assert text.splitlines() == ["# Report", "", "| name | rate | n |", "|---|---:|---:|", "| a\\|b | 25.6% | 3 |", "| c | 0.0% | 4 |", "", "## Notas", "- note"]
    with pytest.raises(ValueError, match="over 1 rows"):
        files.markdown(df, {"name": "{}"}, "x", most=1)


def test_vector_table_is_built_once(spark, tmp_path):
    corpus, calls = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), []

    def build(rows):
        calls.append(1)
        return rows.select("doc_id", models.encode(F.col("text"), models.LetterEncoder).alias("v"))

    for rows in (corpus, corpus.repartition(3), corpus.where("doc_id = 1")):
        assert files.vector_table(spark, str(tmp_path), rows, "org/model", "main", build).count() == rows.count()
    assert len(calls) == 2 and all("chunks_org-model_main_" in p.name for p in tmp_path.iterdir())


def lines_reader():
    def read(content):
        if content.startswith(b"!"):
            raise ValueError("unreadable")
        return [(t, [[["x", None]]]) for t in content.decode().split("\f") if t]

    return read


def test_pages_of_files(spark, tmp_path):
    for name, content in {"a.pdf": b"one\ftwo", "b.pdf": b"!", "c.pdf": b"\f", "d.txt": b"no"}.items():
        (tmp_path / name).write_bytes(content)
    got = {(r["source_path"].rsplit("/")[-1], r["page"]): r for r in files.extract_pages(spark, str(tmp_path), lines_reader).collect()}
    assert set(got) == {("a.pdf", 1), ("a.pdf", 2), ("b.pdf", 0), ("c.pdf", 0)}
    assert got["a.pdf", 2]["text"] == "two" and got["a.pdf", 1]["tables"] == [[["x", None]]] and "unreadable" in got["b.pdf", 0]["error"] and got["c.pdf", 0]["error"] is None


def test_hyde_search(spark):
    vectors = spark.createDataFrame([(1, "aaaa"), (2, "bbbb")], "doc_id long, text string").select("doc_id", models.encode(F.col("text"), models.LetterEncoder).alias("v"))
    asked = spark.createDataFrame([(7, "bb?", None), (8, "bb?", "aa")], "query_id long, text string, hypothetical string")
    got = models.hyde_search(asked, vectors, models.EchoGenerator, models.LetterEncoder, 1).collect()
    assert {(r["query_id"], r["doc_id"]) for r in got} == {(7, 2), (8, 1)}
    assert models.search("no_rag", asked, {}).count() == 0
    assert models.search("hyde", asked, {"hyde": lambda q: models.hyde_search(q, vectors, models.EchoGenerator, models.LetterEncoder, 2)}).count() == 4




def test_upsert_ties(spark):
    schema = "pdf_id string, at int, v string"
    old, new = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 1, "x")], schema), spark.createDataFrame([("a", 1, "y"), ("a", 1, "z"), ("b", 1, "y")], schema)
    assert {tuple(r) for r in incremental.upsert(old, new, "pdf_id", "at").collect()} == {("a", 1, "z"), ("b", 2, "x"), ("c", 1, "x")}
