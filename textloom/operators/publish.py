"""From rows to what is published or merged: records, variants, merges of metrics, key sets, numbering, strategies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S


def lm_records(chunks: DataFrame, text: str, metadata: list[str], split: Column) -> DataFrame:
    """(text, metadata): a chunk as a training record, whose metadata struct ends in its split."""
    return chunks.select(F.col(text).alias("text"), F.struct(*metadata, split.alias("split")).alias("metadata"))


def record_errors(records: DataFrame, number: str, most: int | None = 50) -> DataFrame:
    """(line, error) of records that are no training records, by line; the first so many, or all of them."""
    has = lambda c: c in records.columns
    rules = [(F.col("messages").isNotNull() if has("messages") else F.lit(False), "unexpected messages field"), (F.trim(F.coalesce(F.col("text"), F.lit(""))) == "", "empty text"), (F.col("metadata").isNull() if has("metadata") else F.lit(True), "missing metadata")]
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(i).alias("rule"), F.lit(name).alias("error"))) for i, (bad, name) in enumerate(rules)]))
    rows = records.select(F.col(number).alias("line"), F.explode(found).alias("x")).select("line", "x.rule", "x.error")
    rows = rows.orderBy("line", "rule").limit(most) if most is not None else rows
    return rows.select("line", "error")


def without_fields(df: DataFrame, names: set[str]) -> DataFrame:
    """df without columns and struct fields of these names, at any depth, also in arrays of structs."""

    def clean(c: Column, kind: S.DataType) -> Column:
        if isinstance(kind, S.StructType):
            return F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields if f.name not in names])
        if isinstance(kind, S.ArrayType) and isinstance(kind.elementType, S.StructType | S.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        return c

    def whole(c: Column, kind: S.DataType) -> Column:
        return F.when(c.isNotNull(), clean(c, kind)) if isinstance(kind, S.StructType) else clean(c, kind)

    return df.select(*[whole(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if f.name not in names])


def variants(rows: DataFrame, key: str, shapes: dict[str, list[Column]]) -> dict[str, DataFrame]:
    """Projections of the same rows, by name; each keeps the key, and so as many rows."""
    return {name: rows.select(key, *columns) for name, columns in shapes.items()}


def prompt_completion(messages: Column) -> list[Column]:
    """prompt (all but the last message) and completion (the last one); null without a message."""
    n = F.size(messages)
    return [F.when(n > 0, F.slice(messages, 1, F.greatest(F.lit(0), n - 1))).alias("prompt"), F.when(n > 0, F.slice(messages, F.greatest(F.lit(1), n), F.lit(1))).alias("completion")]


def merged_metrics(base: DataFrame, passes: list[DataFrame], key: str, newest: str) -> DataFrame:
    """base with the columns of each pass, by key; of several rows of a key the one with the largest number counts."""

    def last(df: DataFrame) -> DataFrame:
        values = [c for c in df.columns if c not in (key, newest)]
        return df.groupBy(key).agg(F.max_by(F.struct(*values), newest).alias("x")).select(key, *[f"x.{c}" for c in values])

    return reduce(lambda left, df: left.join(last(df), key, "left"), passes, base)


def with_context(pairs: DataFrame, chunks: DataFrame, key: str, excerpt: str, text: str = "text") -> DataFrame:
    """pairs with context: the text of their chunk, or their own excerpt where the chunk is unknown or empty."""
    of = chunks.select(F.col(key).alias("chunk_key"), F.col(text).alias("chunk_text"))
    joined = pairs.join(of, F.col(key) == F.col("chunk_key"), "left")
    return joined.withColumn("context", F.coalesce(F.nullif(F.trim("chunk_text"), F.lit("")), F.col(excerpt))).drop("chunk_key", "chunk_text")


def missing_references(rows: DataFrame, ids: str, known: DataFrame, key: str) -> DataFrame:
    """Ids that rows refer to (column of ids) and that no row of known has; empty if all is well."""
    return rows.select(F.explode(ids).alias(key)).distinct().join(known.select(key), key, "left_anti")


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(both_sides, only_a, only_b): how many distinct keys; nulls are no keys."""
    side = lambda df, n: df.select(F.col(key)).where(F.col(key).isNotNull()).distinct().select(key, F.lit(n).alias("side"))
    sides = side(a, 1).union(side(b, 2)).groupBy(key).agg(F.sum("side").alias("s"))
    count = lambda n: F.count_if(F.col("s") == n)
    return sides.agg(count(3).alias("both_sides"), count(1).alias("only_a"), count(2).alias("only_b"))


def distinct_counts(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows, and distinct values of each column, null and empty ones aside."""
    return rows.agg(F.count("*").alias("n_rows"), *[F.count_distinct(F.nullif(F.col(c).cast("string"), F.lit(""))).alias(f"unique_{c}") for c in names])


def volume(rows: DataFrame, tokens: Column) -> DataFrame:
    """Rows, tokens, and tokens a row."""
    return rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.coalesce(F.sum(tokens) / F.greatest(F.count("*"), F.lit(1)), F.lit(0.0)).alias("tokens_per_row"))


def changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(updated, unchanged, added, removed): how many keys, by their values before and after."""
    a, b = before.select(key, F.col(value).alias("x"), F.lit(True).alias("was")), after.select(key, F.col(value).alias("y"), F.lit(True).alias("is"))
    both, same = F.col("was") & F.col("is"), F.col("x").eqNullSafe(F.col("y"))
    return a.join(b, key, "full").agg(F.count_if(both & ~same).alias("updated"), F.count_if(both & same).alias("unchanged"), F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("is").isNull()).alias("removed"))


def continued_ids(new: DataFrame, known: DataFrame, by: str, id_col: str, order: list[str]) -> DataFrame:
    """new with ids by_0001 and on, numbered for each value of by from behind the largest number that known has."""
    last = known.groupBy(by).agg(F.max(F.regexp_extract(id_col, r"_(\d+)$", 1).cast("int")).alias("last"))
    numbered = new.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    joined = numbered.join(last, by, "left")
    return joined.withColumn(id_col, F.format_string("%s_%04d", F.col(by), F.col("n") + F.coalesce("last", F.lit(0)))).drop("n", "last")


def sample_of_each(rows: DataFrame, by: str, key: str, n: int = 5, seed: int = 42) -> DataFrame:
    """n rows of each group at most, the least by a seeded hash of the key (ties by the key)."""
    w = Window.partitionBy(by).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("place")


def distinct_tables(tables: DataFrame, order: list[str]) -> DataFrame:
    """The first of tables with equal document, page, size, rounded box, trimmed headers and trimmed first row."""
    trimmed = lambda c: F.transform(c, lambda x: F.trim(F.coalesce(x, F.lit(""))))
    box = F.transform(F.coalesce("bbox", F.array().cast("array<double>")), lambda x: F.round(x, 1))
    row = F.coalesce(trimmed(F.try_element_at("rows", F.lit(1))), F.array().cast("array<string>"))
    signature = F.xxhash64("pdf_id", "page", "row_count", "col_count", box, trimmed(F.col("headers")), row), F.md5(F.to_json(F.struct("pdf_id", "page", "row_count", "col_count", box.alias("b"), trimmed(F.col("headers")).alias("h"), row.alias("r"))))
    w = Window.partitionBy("sig_a", "sig_b").orderBy(*order)
    rows = tables.withColumns({"sig_a": signature[0], "sig_b": signature[1]}).withColumn("place", F.row_number().over(w))
    return rows.where("place = 1").drop("sig_a", "sig_b", "place")


def union_of_splits(splits: dict[str, DataFrame], name: str = "split") -> DataFrame:
    """All splits one below the other, each row with its split's name; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(name, F.lit(k)) for k, df in splits.items()])


def strategy_matrix(spark, models: list[str], strategies: list[str]) -> DataFrame:
    """(run, model, strategy): a row for each pair, models first; both lists are configuration."""
    rows = [(i * len(strategies) + j, m, s) for i, m in enumerate(models) for j, s in enumerate(strategies)]
    return spark.createDataFrame(rows, "run int, model string, strategy string")


def contexts_for(questions: DataFrame, strategies: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, strategy, contexts): for each question and strategy the ranked contexts that it retrieved.

    strategies: by name, rows (key, rank, context); a question without rows (any one under no_rag, whose table is empty)
    has an empty array.
    """
    found = reduce(DataFrame.unionByName, [df.select(key, "rank", "context", F.lit(name).alias("strategy")) for name, df in strategies.items()])
    ranked = found.groupBy(key, "strategy").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "context"))), lambda x: x["context"]).alias("contexts"))
    every = questions.select(key, F.explode(F.array(*[F.lit(x) for x in strategies])).alias("strategy"))
    return every.join(ranked, [key, "strategy"], "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))


def cached(questions: DataFrame, cache: DataFrame, key: str, text: str) -> DataFrame:
    """questions with hypothetical and hit: the cached text counts if the question's hash is still that of the cache."""
    of = cache.select(F.col(key), F.col("question_hash").alias("cached_hash"), F.col("hypothetical").alias("cached_text"))
    joined = questions.join(of, key, "left").withColumn("hit", F.coalesce(F.col("cached_hash") == F.sha2(text, 256), F.lit(False)))
    return joined.withColumn("hypothetical", F.when(F.col("hit"), F.col("cached_text"))).drop("cached_hash", "cached_text")


def matched_reports(reports: DataFrame, summaries: DataFrame, name: str, file: str) -> DataFrame:
    """Reports with the summary whose file has the report's suffix (what follows the last underscore), or nulls."""
    suffix = lambda c: F.regexp_extract(c, r"_([^_.]+)(?:\.[^.]*)?$", 1)
    a, b = reports.withColumn("suffix", suffix(F.col(name))), summaries.withColumn("suffix", suffix(F.col(file)))
    return a.join(b, "suffix", "left")
