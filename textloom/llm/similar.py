"""SimHash near-duplicates at a Jaccard similarity of word shingles, verified shingle by shingle.

Fingerprints of 64 bits of pairs at similarity 0.8 differ in 10 bits in the mean, too many for the blocks that serve a radius
of 3 (see simhash). Fingerprints here have WORDS times 64 bits. They are dealt by their blocks of BITS bits, and those that
share a block are compared in tiles by exclusive or and bit counts of their first 128 bits (simhash.meetings); pairs within
RADIUS bits are candidates. A bit differs with probability 0.15 for a pair at 0.8 (0.19 for the smallest, of 4 and 5
shingles), so none of 100 blocks is shared with one of 3,000,000 (5,000), and over RADIUS bits differ in fewer than one
of 1,000,000 (20,000). What then follows loses no pair at the threshold: bounds by the sizes' ratio and the Hamming
distance of parity sketches, and at last all shingles, so that no pair below the threshold is linked.

A bucket first links each text to the nearest before it, within CLOSE bits; its other pairs are compared only where these links have not
joined them already, so a group of n near copies costs far fewer than its pairs. The blocks of the first two words are dealt first. Texts that
meet more than DENSE others in one bucket there (large groups of near copies, or texts around a common passage) are dense: they take their
sketches to the other blocks' buckets, which list pairs of two dense ones only where no link has joined them and the sketches allow one.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import shared, simhash
from textloom.llm.components import components

#: Buckets of so many texts at most are compared together.
LARGE = 16
#: 64-bit words of a fingerprint, and bits of the blocks by which fingerprints are dealt.
WORDS, BITS = 20, 12
#: The first 128 bits of fingerprints that are compared further differ in so many at most.
RADIUS = 42
#: Pairs of so many bits at most are compared at once, others where those have not joined them.
CLOSE = 24
#: Texts that meet more than so many others in a bucket are dense.
DENSE = 8
#: Bits of a parity sketch.
SKETCH = 1024
#: Bits of the table that marks which texts may be compared; more texts than bits cost a second look, not a pair.
MARKS = 1 << 20
#: Rows of a task that looks at buckets again.
ROWS = 100_000


def shingle_set(text: str, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; case does not count, words end at white space."""
    return np.unique(simhash.shingles(" ".join(text.lower().split()).encode("utf-8", "surrogatepass").split(), words, seed))


def parity(hashes: np.ndarray) -> np.ndarray:
    """A bit of SKETCH is set where an odd number of hashes falls on it."""
    bits = (np.bincount((hashes >> np.uint64(20)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.int64)


def _sets(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int) -> DataFrame:
    """(doc_id, digest, set_id, n, fp, sketch) for each row of docs; shingles themselves are made again for texts that are compared."""
    shared.bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("_text"))

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            ids, sizes, prints, sketches = [], [], [], []
            for x in b.column(2):
                own = shingle_set(x.as_py(), words, seed)
                ids.append(xxhash.xxh64_intdigest(own.tobytes(), seed))
                sizes.append(len(own))
                prints.append(simhash.wide(own, WORDS).view(np.int64))
                sketches.append(parity(own))
            columns = [b.column(0), b.column(1), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(prints, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "set_id", "n", "fp", "sketch"])

    return shared.save(rows.mapInArrow(run, "doc_id long, digest long, set_id long, n int, fp array<long>, sketch array<long>"), "shingles")


def _apart(t: Fraction):
    """The pairs of a crowd's sets that no link has joined yet."""
    spread = Fraction(1 - t, 1 + t)

    def run(pdf):
        import pandas as pd

        found = [np.zeros((0, 2), np.int64)]
        for _, rows in pdf.groupby("u"):
            key, of, n = rows.v.to_numpy(), rows.component.to_numpy(), rows.n.to_numpy().astype(np.int64)
            fp, sketch = rows[["a", "b"]].to_numpy(np.int64).view(np.uint64), np.stack(rows.sketch.to_numpy()).view(np.uint64)
            for k in range(len(rows) - 1):
                x = k + 1 + np.nonzero((of[k + 1 :] != of[k]) & (np.minimum(n[k + 1 :], n[k]) * t.denominator >= t.numerator * np.maximum(n[k + 1 :], n[k])))[0]
                x = x[np.bitwise_count(fp[x] ^ fp[k]).sum(axis=1) <= RADIUS]
                x = x[np.bitwise_count(sketch[x] ^ sketch[k]).sum(axis=1, dtype=np.int64) * spread.denominator <= spread.numerator * (n[x] + n[k])]
                if len(x):
                    found.append(np.stack([np.minimum(key[x], key[k]), np.maximum(key[x], key[k])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    return run


def _marked(texts: DataFrame, of: DataFrame, words: int, seed: int) -> DataFrame:
    """(digest, hashes) for the texts with a digest in of, and few others, so that whole texts are not shuffled."""
    marks = np.zeros(MARKS // 64, np.uint64)
    for w, bits in of.groupBy(F.expr(f"cast(shiftright(pmod(digest, {MARKS}L), 6) AS int)")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(digest, 64L) AS int)))")).collect():
        marks[w] = np.int64(bits).view(np.uint64)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at = b.column(0).to_numpy() % MARKS
            rows = np.nonzero((marks[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))[0]
            found = [shingle_set(b.column(1)[int(i)].as_py(), words, seed).tobytes() for i in rows]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(found, pa.binary())], names=["digest", "hashes"])

    return texts.mapInArrow(run, "digest long, hashes binary")


def _similar(pairs: DataFrame, table: DataFrame, texts: DataFrame, t: Fraction, words: int, seed: int) -> DataFrame:
    """The pairs (u, v) whose shingles are similar enough, compared one by one."""
    spread = Fraction(1 - t, 1 + t)
    slim = table.select("set_id", "n", "sketch").dropDuplicates(["set_id"])
    side = lambda df, c: df.select(F.col("set_id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in df.columns[1:]])
    apart = F.aggregate(F.zip_with("sketch_u", "sketch_v", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    pairs = pairs.distinct().join(side(slim, "u"), "u").join(side(slim, "v"), "v").where(apart * F.lit(spread.denominator) <= (F.col("n_u") + F.col("n_v")) * F.lit(spread.numerator))
    pairs = shared.save(pairs.select("u", "v"), "near-pairs")
    ids = pairs.select(F.col("u").alias("set_id")).union(pairs.select(F.col("v").alias("set_id"))).distinct()
    of = shared.save(ids.join(table.groupBy("set_id").agg(F.min("digest").alias("digest")), "set_id"), "near-ids")
    whole = shared.save(_marked(texts, of, words, seed).dropDuplicates(["digest"]).join(of, "digest").select("set_id", "hashes"), "near-sets")
    both = pairs.join(side(whole, "u"), "u").join(side(whole, "v"), "v").select("u", "v", "hashes_u", "hashes_v")
    a, b = t.numerator, t.denominator

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
                good.append(len(np.intersect1d(x, y, assume_unique=True)) * (a + b) >= a * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return shared.save(both.mapInArrow(run, "u long, v long"), "near-links")


def groups(docs: DataFrame, similarity: str = "0.8", words: int = 5, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """(doc_id, digest, component_id) for each row of docs; rows share a component if links of at least the similarity join them.

    Texts with equal shingles are linked, and so are texts without a word. similarity is a decimal number as a string.
    """
    t = Fraction(similarity)
    table = _sets(docs, id_col, text_col, words, seed)
    distinct = shared.save(table.select(F.col("set_id").alias("node"), "n", "fp").dropDuplicates(["node"]), "near-prints")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("digest"), text.alias("_text"))
    asked, early = (BITS, RADIUS, CLOSE, float(t) - 1e-9, LARGE), 2 * (64 // BITS)
    slim = table.select(F.col("set_id").alias("node"), "sketch").dropDuplicates(["node"])

    def joined(met, links):
        """The links with those of met, and (node, component)."""
        found = _similar(met.where("kind = 0").select("u", "v"), table, texts, t, words, seed)
        links = links.union(found) if links else found
        member, large = components(links, "near"), met.where("kind = 1")
        if large.isEmpty():
            return links, member
        # a text's group and sketch are fetched once, not for each of its crowds
        of = large.groupBy("v").agg(*[F.first(c).alias(c) for c in ("n", "a", "b")], F.collect_set("u").alias("crowds"))
        known = of.withColumnRenamed("v", "node").join(member, "node", "left").join(slim, "node")
        rows = known.select(F.explode("crowds").alias("u"), F.col("node").alias("v"), "n", "a", "b", F.coalesce("component", "node").alias("component"), "sketch")
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), large.count() // ROWS)
        more = rows.withColumn("g", F.pmod(F.xxhash64("u"), F.lit(parts)).cast("int")).groupBy("g").applyInPandas(_apart(t), "u long, v long")
        links = links.union(_similar(more, table, texts, t, words, seed))
        return links, components(links, "near")

    near = shared.save(simhash.meetings(distinct, *asked, 0, early, DENSE), "near-met")
    links, member = joined(near, None)
    dense = near.where("kind = 2").select(F.col("v").alias("node")).distinct().join(slim, "node")
    marked = distinct.join(dense, "node", "left").join(member, "node", "left")
    marked = shared.save(marked.select("node", "n", "fp", F.col("sketch").isNotNull().alias("dense"), F.coalesce("component", "node").alias("component"), "sketch"), "near-prints")
    shared.drop(distinct)
    links, member = joined(shared.save(simhash.meetings(marked, *asked, early), "near-met"), links)
    return table.join(member, F.col("set_id") == F.col("node"), "left").select("doc_id", "digest", F.coalesce("component", "set_id").alias("component_id"))


def one_of_each(docs: DataFrame, similarity: str = "0.8", words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: of each group, the row with the smallest id stays (null ids last, then by text hash)."""
    return simhash.first_of_each(docs, groups(docs, similarity, words, id_col, text_col), id_col, text_col)
