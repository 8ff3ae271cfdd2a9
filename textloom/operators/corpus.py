"""Corpus building: repeated lines, sections, chunks, dedupe, ids and splits."""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import plain
from textloom.functions import text as T
from textloom.functions.packs import Pack
from textloom.operators import ordered

#: What packed() gives.
CHUNK = pa.schema([("source", pa.string()), ("section", pa.string()), ("chunk", pa.int32()), ("text", pa.string()), ("pages", pa.list_(pa.int32())), ("token_estimate", pa.int32())])


def paged(documents: DataFrame) -> DataFrame:
    """Documents as pages of their source: page is the rank by id, as there is no order but an explicit one."""
    return ordered.numbered(documents, F.col("source"), ["doc_id"], "page")


def repeated_lines(pages: DataFrame, ratio: float = 0.28, least: int = 3, longest: int = 120) -> DataFrame:
    """Lines that recur as headers or footers: distinct pages of a signature in its source, at least max(least, ceil(pages * ratio))."""
    rows = pages.select("source", "page", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    rows = rows.where((F.col("line") != "") & (F.length("line") <= longest)).withColumn("signature", T.line_signature(F.col("line"))).where("signature <> ''")
    seen = rows.groupBy("source", "signature").agg(F.countDistinct("page").alias("pages"), F.min_by("line", F.struct("page", "pos")).alias("line"))
    totals = pages.groupBy("source").agg(F.count("*").alias("total"))  # a row a source
    return seen.join(totals, "source").where(F.col("pages") >= F.greatest(F.lit(least), F.ceil(F.col("total") * F.lit(ratio)))).drop("total")


def without_lines(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """Pages without their source's repeated lines."""
    lists = repeated.groupBy("source").agg(F.collect_set("signature").alias("_cut"))
    joined = pages.join(lists, "source", "left").withColumn("_cut", F.coalesce("_cut", F.array().cast("array<string>")))
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("_cut", T.line_signature(F.trim(x))))
    return joined.withColumn("text", F.array_join(kept, "\n")).drop("_cut")


def sections(pages: DataFrame, heading: Column) -> DataFrame:
    """section: the last heading so far in the source, empty before the first."""
    rows = ordered.filled(pages, F.col("source"), "page", heading, "section")
    return rows.withColumn("section", F.coalesce("section", F.lit("")))


def keep_best(chunks: DataFrame, key: Column, order: list) -> DataFrame:
    """Of rows with one key the first by order stays."""
    return chunks.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def numbered_ids(chunks: DataFrame, source: Column, order: list[str]) -> DataFrame:
    """chunk_id: the source's slug and a running number of five digits."""
    rows = ordered.numbered(chunks.withColumn("_slug", T.slug(source)), F.col("_slug"), order, "_n")
    return rows.withColumn("chunk_id", F.format_string("%s_%05d", "_slug", "_n")).drop("_slug", "_n")


def pack_chunks(pages: DataFrame, target: int | None = None, most: int = 1200, overlap: int = 100, pack: Pack = Pack()) -> DataFrame:
    """Paragraphs of a source and section, in page order, packed until most tokens (or target, if given) would be passed.

    (source, section, chunk, text, pages, token_estimate). Sizes before a paragraph are those of the normalised chunk; at the
    end of a page the raw one counts. Normalisation sees a chunk as one line unless its paragraphs hold line ends, so a
    noise match empties the chunk, and an emptied chunk is dropped, as in the surveyed rules. A chunk above most tokens
    carries its last words over, and the last page with them. Pages of a source and section come to a task in order and are
    read batch by batch, so that a task holds a chunk and a batch, not the group; pages with is_kept false are left out.
    """
    limit = most if target is None else target
    if "is_kept" in pages.columns:
        pages = pages.where(F.coalesce("is_kept", F.lit(True)))
    # sources are few: many partitions keep two of them from meeting in one
    n = max(100, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = pages.select("source", "section", "page", "text").repartition(n, "source", "section").sortWithinPartitions("source", "section", F.asc_nulls_last("page"))
    return rows.mapInArrow(lambda batches: packed(batches, limit, most, overlap, pack), "source string, section string, chunk int, text string, pages array<int>, token_estimate int")


def packed(batches: Iterable[pa.RecordBatch], limit: int, most: int, overlap: int, pack: Pack, at_once: int = 1000) -> Iterator[pa.RecordBatch]:
    """The chunks of (source, section, page, text), in their order."""
    rows, key, chunk = [], None, 0
    held, pages_held, n_words, noise = [], [], 0, False

    def flush():
        nonlocal held, pages_held, n_words, noise, chunk
        text = "" if noise else plain.normalize_lm(" ".join(held), pack)
        n = plain.tokens_of(plain.words(text))
        if text:
            rows.append((*key, chunk, text, sorted(set(pages_held)), n))
            chunk += 1
        tail = " ".join(text.split()[-overlap:]) if text and overlap > 0 and n > most else ""
        held, pages_held = ([tail], pages_held[-1:]) if tail else ([], [])
        n_words, noise = plain.words(tail), False

    def passes(block, size):
        """Whether the chunk with the block is over the limit; noise is set where it is empty whatever follows on its line."""
        nonlocal noise
        noise = noise and plain.one_line(block)
        if not held or noise or plain.tokens_of(n_words + size) <= limit:
            return False  # normalisation never adds words
        whole = " ".join([*held, block])
        text = plain.normalize_lm(whole, pack)
        noise = not text and plain.stays_noise(whole)
        return plain.tokens_of(plain.words(text)) > limit

    def sent():
        done, rows[:] = rows[:], []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), CHUNK.types)], schema=CHUNK)

    for batch in batches:
        for i in range(batch.num_rows):
            *of, page, text = (c[i].as_py() for c in batch.columns)
            if key != tuple(of):
                if key is not None:
                    flush()
                key, chunk, held, pages_held, n_words, noise = tuple(of), 0, [], [], 0, False
            text = (text or "").strip()
            if not text:
                continue
            for block in plain.paragraphs(text, pack=pack):
                size = plain.words(block)
                if passes(block, size):
                    flush()
                held.append(block)
                n_words += size
                if page:
                    pages_held.append(int(page))
            if plain.tokens_of(n_words) >= limit:
                flush()
            if len(rows) >= at_once:
                yield sent()
    if key is not None:
        flush()
    if rows:
        yield sent()


def hold_out(counts: dict[str, int], target: int, least_docs: int = 3) -> list[str]:
    """Whole documents for a hold-out of about target chunks; deterministic, ids break ties."""
    chosen, total, left = [], 0, dict(counts)
    while target > 0 and left:
        small = {d: n for d, n in left.items() if n <= round(0.75 * target)} if not chosen else left
        doc = min(small or left, key=lambda d: (abs(target - total - (small or left)[d]), d))
        if len(chosen) >= least_docs and abs(target - total - left[doc]) >= abs(target - total):
            break
        chosen.append(doc)
        total += left.pop(doc)
    return chosen


def split_by_document(chunks: DataFrame, validation: float = 0.05, test: float = 0.05, doc: str = "source") -> DataFrame:
    """Add split: whole documents to test and validation, the rest to train. The driver sees a count for each document."""
    if validation < 0 or test < 0 or validation + test >= 1:
        raise ValueError("ratios must not be negative and must sum to less than one")
    counts = {r[doc]: r["count"] for r in chunks.groupBy(doc).count().collect()}
    n = sum(counts.values())
    tests = hold_out(counts, round(n * test))
    vals = hold_out({d: c for d, c in counts.items() if d not in tests}, round(n * validation))
    rows = [(d, "test") for d in tests] + [(d, "validation") for d in vals]
    of = chunks.sparkSession.createDataFrame(rows, f"{doc} string, split string")
    return chunks.drop("split").join(F.broadcast(of), doc, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def systematic_split(chunks: DataFrame, ratio: float, seed: int = 42, doc: str = "source", order: str = "doc_id", offset: int | None = None) -> DataFrame:
    """Every k-th chunk of a document for validation, k = round(1 / ratio), from a seeded offset; up to two chunks all train."""
    k = max(2, round(1 / ratio))
    offset = random.Random(seed).randrange(k) if offset is None else offset
    sizes = chunks.groupBy(F.col(doc).alias("_doc")).agg(F.count("*").alias("_size"))  # a row a document
    rows = ordered.numbered(chunks, F.col(doc), [order], "_n").join(sizes, F.col(doc).eqNullSafe(F.col("_doc")))
    chosen = (F.col("_size") > 2) & (F.pmod(F.col("_n") - 1 + offset, F.lit(k)) == 0)
    return rows.withColumn("split", F.when(chosen, "validation").otherwise("train")).drop("_n", "_doc", "_size")


def leakage(splits: DataFrame, doc: str = "source") -> DataFrame:
    """Documents in more than one split; empty if the split is clean."""
    return splits.groupBy(doc).agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 42, rank: Column | None = None) -> DataFrame:
    """n rows with each stratum's floor share (one at least if strata allow), filled or cut by rank; the rank is a seeded hash."""
    rank = F.xxhash64(key, F.lit(seed)) if rank is None else rank
    sizes = rows.groupBy(stratum).count()
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))  # a row a stratum
    strata = F.count("*").over(Window.partitionBy(F.lit(1)))
    quota = sizes.select(stratum, F.greatest(F.when(strata <= n, 1).otherwise(0), F.floor(F.lit(n) * F.col("count") / total)).alias("quota"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(rank, key))).join(F.broadcast(quota), stratum)
    return ranked.orderBy((F.col("_r") > F.col("quota")).cast("int"), rank, key).limit(n).drop("_r", "quota")
