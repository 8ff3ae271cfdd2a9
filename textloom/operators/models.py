"""Encoders, generators and scorers as plug-ins: a factory makes one on each worker, and batches reach it through Arrow.

A factory takes nothing and returns the model; it is sent to the workers, so it loads the model there. The classes at the
end need no network and serve tests and dry runs.
"""

from __future__ import annotations

import asyncio
import inspect
import math
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import prompts
from textloom.operators import retrieval


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def generate(self, prompt: str) -> Reply: ...


class Busy(Exception):
    """The model asks to be called again later: too many requests, or an error of its server."""


class Refused(Exception):
    """The model will not answer; it is not asked again."""


@dataclass(frozen=True)
class Reply:
    text: str | None
    finish: str = "stop"
    input_tokens: int | None = 0
    output_tokens: int | None = 0


#: What each metric is given.
METRIC_FIELDS: dict[str, tuple[str, ...]] = {
    "context_precision": ("user_input", "retrieved_contexts", "reference"),
    "context_recall": ("user_input", "retrieved_contexts", "reference"),
    "faithfulness": ("user_input", "response", "retrieved_contexts"),
    "noise_sensitivity": ("user_input", "response", "reference", "retrieved_contexts"),
    "answer_relevancy": ("user_input", "response"),
    "answer_correctness": ("user_input", "response", "reference"),
    "semantic_similarity": ("response", "reference"),
}
REPLY = "text string, status string, error string, attempts int, input_tokens long, output_tokens long, latency double"


def encode(text: Column, factory: Callable[[], Encoder]) -> Column:
    """Unit vectors of texts (null: empty). A wrong count, mixed dimensions, or a vector without direction fails."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, size = factory(), None
        for texts in batches:
            vectors = [[float(x) for x in v] for v in model.encode(texts.fillna("").tolist())] if len(texts) else []
            if len(vectors) != len(texts):
                raise ValueError(f"{len(texts)} texts gave {len(vectors)} vectors")
            out = []
            for v in vectors:
                size = len(v) if size is None else size
                length = math.sqrt(sum(x * x for x in v))
                if len(v) != size or not math.isfinite(length) or length == 0:
                    raise ValueError("vectors must have one dimension and a direction")
                out.append([x / length for x in v])
            yield pd.Series(out, dtype=object)

    return run.asNondeterministic()(text)


def ask(model: Generator, prompt: str, tries: int = 5, base: float = 2.0, pause: Callable[[float], None] = time.sleep) -> dict[str, Any]:
    """One prompt's reply with status ok, empty, refused or failed. Only Busy is tried again, after base * 2 ** (n - 1) seconds and a random part of one."""
    began = time.monotonic()
    out: dict[str, Any] = {"text": None, "error": None, "input_tokens": None, "output_tokens": None}
    for attempt in range(1, tries + 1):
        out["attempts"] = attempt
        try:
            reply = model.generate(prompt)
            counts = (reply.input_tokens, reply.output_tokens)
            if reply.finish != "stop" or any(n is None or n < 0 for n in counts):
                raise ValueError(f"incomplete reply: {reply.finish}, tokens {counts}")
            text = (reply.text or "").strip()
            out |= {"text": text, "status": "ok" if text else "empty", "error": None, "input_tokens": counts[0], "output_tokens": counts[1]}
            break
        except Refused as e:
            out |= {"status": "refused", "error": str(e)}
            break
        except Exception as e:  # a prompt that fails must not lose the others of its batch
            out |= {"status": "failed", "error": f"{type(e).__name__}: {e}"}
            if not isinstance(e, Busy) or attempt == tries:
                break
            pause(base * 2 ** (attempt - 1) + random.random())
    return out | {"latency": time.monotonic() - began}


def generate(prompt: Column, factory: Callable[[], Generator], tries: int = 5, base: float = 2.0) -> Column:
    """A struct for each prompt (see REPLY); a null prompt is not sent and gets a null status."""

    @F.pandas_udf(REPLY)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        names = [part.split()[0] for part in REPLY.split(", ")]
        for texts in batches:
            rows = [{} if p is None else ask(model, p, tries, base) for p in texts]
            yield pd.DataFrame(rows, columns=names, dtype=object).astype({"attempts": "Int32", "input_tokens": "Int64", "output_tokens": "Int64", "latency": "float64"})

    return run.asNondeterministic()(prompt)


def score(sample: Column, factory: Callable[[], dict[str, Callable]], names: tuple[str, ...], fields: dict[str, tuple[str, ...]] = METRIC_FIELDS, timeout: float = 600, at_once: int = 3) -> Column:
    """A struct of a double for each metric, and errors; sample is a struct with the fields that metrics take.

    The factory returns a function for each name, plain or async. A metric that fails, takes too long or is not finite is
    null, and its error is listed; the others count. Where retrieved_contexts is null, metrics that need it aren't run.
    """
    if at_once < 1:
        raise ValueError("at least one metric must run at once")

    async def one(metrics: dict[str, Callable], row: dict[str, Any]) -> dict[str, Any]:
        gate = asyncio.Semaphore(at_once)

        async def call(name: str):
            wanted = {f: row[f] for f in fields[name]}
            if "retrieved_contexts" in wanted and wanted["retrieved_contexts"] is None:
                return name, None, None
            try:
                async with gate:
                    f = metrics[name]
                    work = f(**wanted) if inspect.iscoroutinefunction(f) else asyncio.to_thread(f, **wanted)
                    value = await asyncio.wait_for(work, timeout)
                if value is not None and not math.isfinite(value := float(value)):
                    raise ValueError(f"not finite: {value}")
                return name, value, None
            except Exception as e:
                return name, None, f"{name}: {type(e).__name__}: {e}"

        done = await asyncio.gather(*(call(n) for n in names))
        return {n: v for n, v, _ in done} | {"errors": [e for _, _, e in done if e]}

    @F.pandas_udf(", ".join(f"{n} double" for n in names) + ", errors array<string>")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        metrics = factory()
        if tuple(metrics) != tuple(names):
            raise ValueError(f"metrics {tuple(metrics)} are not {tuple(names)}")
        for rows in batches:
            plain = [{k: list(v) if hasattr(v, "tolist") and not isinstance(v, str) else v for k, v in r.items()} for r in rows.to_dict("records")]
            out = pd.DataFrame([asyncio.run(one(metrics, r)) for r in plain], columns=[*names, "errors"], dtype=object)
            yield out.astype({n: "float64" for n in names})

    return run.asNondeterministic()(sample)


def hyde_search(questions: DataFrame, vectors: DataFrame, writer: Callable[[], Generator], encoder: Callable[[], Encoder], k: int = 5, digits: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): dense search by a hypothetical text instead of the question (query_id, text).

    Questions with a text in a column hypothetical keep it (a cache's hits); the others ask the writer, and those whose
    reply isn't ok are left out. Scores may be rounded before they are ranked.
    """
    if "hypothetical" not in questions.columns:
        questions = questions.withColumn("hypothetical", F.lit(None).cast("string"))
    prompt = F.when(F.col("hypothetical").isNull(), prompts.hypothetical(F.col("text")))
    replies = questions.withColumn("reply", generate(prompt, writer))
    texts = replies.select("query_id", F.coalesce("hypothetical", F.when(F.col("reply.status") == "ok", F.col("reply.text"))).alias("text")).where("text is not null")
    return retrieval.dense(texts.select("query_id", encode(F.col("text"), encoder).alias("q")), vectors, k, digits)


def search(strategy: str, questions: DataFrame, legs: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(query_id, doc_id, score, rank) by one of the named strategies; no_rag finds nothing, and an unknown one fails."""
    if strategy == "no_rag":
        return questions.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    if strategy not in legs:
        raise ValueError(f"unknown strategy {strategy}: no_rag, {', '.join(sorted(legs))}")
    return legs[strategy](questions)


@dataclass(frozen=True)
class ModelSpec:
    """A model, or an adapter on a base model."""

    key: str
    model_id: str
    base_id: str
    adapter_id: str | None = None


def registry(spark: SparkSession, specs: list[ModelSpec]) -> DataFrame:
    """The configured models as a table; keys must be unique."""
    if len({s.key for s in specs}) < len(specs):
        raise ValueError("model keys must be unique")
    rows = [(s.key, s.model_id, s.base_id, s.adapter_id) for s in specs]
    return spark.createDataFrame(rows, "key string, model_id string, base_id string, adapter_id string")


def adapter(spec: ModelSpec, path: str | None = None, files: set[str] | None = None) -> str | None:
    """Where an adapter is loaded from: a path whose files hold its config and weights, else its id; none for a base model."""
    if spec.adapter_id is None or path is None:
        return spec.adapter_id
    if "adapter_config.json" not in (files or ()) or not {"adapter_model.safetensors", "adapter_model.bin"} & (files or set()):
        raise FileNotFoundError(f"no adapter config and weights in {path}")
    return path


def run_steps(steps: list[tuple[str, Callable[[], None]]], skip: frozenset[str] = frozenset(), dry_run: bool = False) -> list[tuple[str, str]]:
    """Steps in order, each done, skipped or planned; one that fails ends the run."""
    log = []
    for name, step in steps:
        state = "skipped" if name in skip else "planned" if dry_run else "done"
        if state == "done":
            step()
        log.append((name, state))
    return log


class LetterEncoder:
    """Offline encoder: how often each letter a to z comes, and a constant, so that each text has a direction."""

    def encode(self, texts: list[str]) -> list[list[float]]:
        return [[1.0, *(float(t.lower().count(chr(97 + i))) for i in range(26))] for t in texts]


class EchoGenerator:
    """Offline generator: answers with the question, what follows the prompt's last "Pregunta:"."""

    def generate(self, prompt: str) -> Reply:
        text = prompt.rsplit("Pregunta:", 1)[-1].strip()
        return Reply(text, "stop", len(prompt.split()), len(text.split()))


def overlap_metric(response: str, reference: str, **_: Any) -> float:
    """Offline metric: shared distinct words as a share of the reference's."""
    a, b = set((response or "").lower().split()), set((reference or "").lower().split())
    return len(a & b) / len(b) if b else 0.0
