"""JSON lines, reports, CSV and file listings."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def read_jsonl(spark: SparkSession, path: str, schema: str, lenient: bool = False) -> DataFrame:
    """Objects by line; blank lines are skipped, malformed ones fail the read or, if lenient, are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if lenient else "FAILFAST").json(path)


def read_interrupted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSONL file whose last line may be cut: that line alone may be bad."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where("trim(value) <> ''")
    last = lines.agg(F.max("at")).first()[0]
    parsed = lines.withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    good = F.try_parse_json("value").isNotNull()
    bad = F.raise_error(F.concat(F.lit("malformed line: "), F.col("value")))
    kept = parsed.where(good | (F.col("at") != F.lit(last)))
    return kept.select(F.when(good, F.col("row")).otherwise(bad).alias("row")).select("row.*")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def report(row: DataFrame) -> str:
    """A one-row table as indented JSON."""
    found = row.select(F.to_json(F.struct("*")).alias("json")).first()
    return json.dumps(json.loads(found.json if found else "{}"), indent=2, ensure_ascii=False)


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(source_path, file_size, mtime), contents unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select(F.col("path").alias("source_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("mtime"))


def validated(df: DataFrame, key: str, required: list[str], rows: int | None = None) -> DataFrame:
    """df, or ValueError: required fields must not be null or blank, keys unique, the count as given."""
    blank = [F.sum((F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).cast("int")).alias(c) for c in required]
    found = df.agg(F.count("*").alias("_n"), *blank).first()
    if bad := [c for c in required if found[c]]:
        raise ValueError(f"null or blank: {', '.join(bad)}")
    if df.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} is not unique")
    if rows is not None and found["_n"] != rows:
        raise ValueError(f"{rows} rows are expected, {found['_n']} found")
    return df


def read_numbered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of JSONL files with file and line, from 1, as in each file; a malformed line fails the read and names both.

    A file is one partition here: line numbers need its lines in order. Blank lines are counted and left out.
    """
    w = Window.partitionBy("file").orderBy("at")
    text = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    rows = text.withColumn("line", F.row_number().over(w)).where("trim(value) <> ''")
    bad = F.raise_error(F.concat(F.col("file"), F.lit(", line "), F.col("line").cast("string"), F.lit(": malformed")))
    object_ = F.when(F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{"), F.from_json("value", schema)).otherwise(bad)
    return rows.select("file", "line", object_.alias("row")).select("file", "line", "row.*")


def known_ids(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key): distinct ids of a JSONL file, malformed lines and missing ids left out."""
    return read_jsonl(spark, path, f"`{key}` string", lenient=True).where(F.coalesce(F.col(key), F.lit("")) != "").distinct()


def markdown(df: DataFrame, columns: dict[str, str], title: str, notes: tuple[str, ...] = (), most: int = 1000) -> str:
    """A small report as a table: columns gives each heading's Python format, such as {:.1%}; numbers align right.

    Null is shown as 0 where the column is a number. A report of over most rows fails instead of filling the driver.
    """
    rows = df.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of over {most} rows")
    numbers = {f.name: isinstance(f.dataType, NumericType) for f in df.select(*columns).schema.fields}
    cell = lambda name, v: columns[name].format(0 if v is None and numbers[name] else "" if v is None else v).replace("|", "\\|")
    lines = [f"# {title}", "", f"| {' | '.join(columns)} |", "|" + "|".join("---:" if numbers[c] else "---" for c in columns) + "|"]
    lines += [f"| {' | '.join(cell(c, r[c]) for c in columns)} |" for r in rows]
    return "\n".join([*lines, *(["", "## Notas", *[f"- {n}" for n in notes]] if notes else [])]) + "\n"


def vector_table(spark: SparkSession, root: str, corpus: DataFrame, model: str, revision: str, build, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The Parquet table of a corpus's vectors under a name of model, revision and content; built where it is not whole yet.

    The content's identity is a sum over rows of hashes of (key, text), so order and partitions don't matter.
    """
    half = lambda at: F.conv(F.substring(F.sha2(F.concat_ws("\u0000", F.col(key).cast("string"), F.coalesce(F.col(text), F.lit(""))), 256), at, 15), 16, 10).cast("decimal(20,0)")
    sums = corpus.agg(F.count("*").alias("n"), F.sum(half(1)).alias("a"), F.sum(half(16)).alias("b")).first()
    identity = hashlib.sha256(f"{sums['n']} {sums['a']} {sums['b']}".encode()).hexdigest()
    safe = lambda s: re.sub(r"[^a-zA-Z0-9._-]+", "-", s).strip("-") or "default"
    path = f"{root}/chunks_{safe(model)}_{safe(revision)}_{identity[:16]}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        rows = build(corpus).withColumns({"corpus_sha256": F.lit(identity), "embedding_model": F.lit(model), "embedding_revision": F.lit(revision)})
        rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def extract_pages(spark: SparkSession, path: str, factory, pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """(source_path, page, text, tables, error): a row for each page that a reader finds in each file.

    The factory makes the reader on a worker: bytes to (text, tables) of each page, tables as rows of cells. A file that
    can't be read is one row with its error and page 0; a file without pages is one row with page 0 and no error. Spark does
    not read files of no bytes: they give no row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)

    def run(batches):
        reader = factory()
        for batch in batches:
            for name, content in batch.itertuples(index=False):
                try:
                    rows = [(name, i, text, tables, None) for i, (text, tables) in enumerate(reader(bytes(content)), 1)] or [(name, 0, "", [], None)]
                except Exception as e:  # one bad file must not lose the others
                    rows = [(name, 0, None, [], f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["source_path", "page", "text", "tables", "error"])

    return files.select("path", "content").mapInPandas(run, "source_path string, page int, text string, tables array<array<array<string>>>, error string")
