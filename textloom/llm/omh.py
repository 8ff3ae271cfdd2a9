"""Order MinHash: document fingerprints that follow edit distance, in DataFrame operations only.

Every k-mer of words is numbered by its occurrence, so a text's k-mers are a set (Marcais and others, 2019). Each entry of
a fingerprint selects TUPLE of them, each minimal under a permutation of its own (a hash of k-mer, occurrence number and
the permutation's number), puts them back into text order and hashes them as a tuple.

Occurrence numbers come from the sorted k-mers: equal ones stand beside each other in text order, and how many stand before
one is found by steps of halving size. Selection is a grouped minimum over the exploded k-mers; it follows the rows'
partitioning by bucket, so k-mers are never shuffled. What a text and its edited text share is selected from once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import shared

K = 2
ENTRIES = 64
TUPLE = 2
#: A k-mer's number: 32 bits of hash above 32 bits of position, which no text reaches.
HALF = 32
LOW = (1 << HALF) - 1


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _packed(hashed: Column, position: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~LOW)).bitwiseOR(position.cast("long").bitwiseAND(F.lit(LOW)))


def _hash_of(packed: Column) -> Column:
    return F.shiftright(packed, HALF)


def numbered(text: Column) -> Column:
    """array<long>: each k-mer's hash, with its occurrence number in it, above its position.

    Words end at white space; a text of fewer than K words has its words as k-mers.
    """
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def grams(h: Column) -> Column:
        runs = F.transform(F.slice(h, 1, F.greatest(F.lit(1), F.size(h) - (K - 1))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, K)]))
        found = F.when(F.size(h) >= K, runs).otherwise(F.transform(h, lambda x: F.xxhash64(x)))
        return F.sort_array(F.transform(found, lambda x, i: _packed(x, i)))

    def before(s: Column, x: Column, i: Column) -> Column:
        """How many equal k-mers stand before place i of the sorted ones."""
        same = lambda j: F.coalesce(_hash_of(F.get(s, i - j)) == _hash_of(x), F.lit(False))
        steps = F.lit([1 << b for b in range(30, -1, -1)])
        return F.when(same(F.lit(1)), F.aggregate(steps, F.lit(0), lambda n, b: F.when((n + b <= i) & same(n + b), n + b).otherwise(n))).otherwise(F.lit(0))

    return _let(hashes, lambda h: _let(grams(h), lambda s: F.transform(s, lambda x, i: _packed(F.xxhash64(_hash_of(x), before(s, x, i)), x))))


def selections(packed: Column) -> list[Column]:
    """For each entry and member, the aggregate that selects the minimal k-mer."""
    return [F.min(_packed(F.xxhash64(_hash_of(packed), F.lit(j)), packed)).alias(f"m{j}") for j in range(ENTRIES * TUPLE)]


def entries() -> Column:
    """array<int> of ENTRIES over the columns of selections: tuples of members in text order; null without a k-mer."""

    def entry(j: int) -> Column:
        own = [F.struct(F.col(f"m{j + t}").bitwiseAND(F.lit(LOW)).alias("at"), _hash_of(F.col(f"m{j + t}")).alias("h")) for t in range(TUPLE)]
        return F.hash(F.sort_array(F.array(*own)).getField("h"))

    return F.when(F.col("m0").isNotNull(), F.array(*[entry(j) for j in range(0, ENTRIES * TUPLE, TUPLE)]))


def minima(rows: DataFrame, keys: list[str], kmers: str) -> DataFrame:
    """(keys, m0, m1, ...): what each row's array of k-mers selects; the keys tell rows apart, and partitioning by some of them is kept."""
    (p,) = shared.free(rows, "kmer")
    return rows.select(*keys, F.explode_outer(kmers).alias(p)).groupBy(*keys).agg(*selections(F.col(p)))


def fingerprints(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, e): entries of each row's text; keys as for minima."""
    (g,) = shared.free(rows, "kmers")
    return minima(rows.withColumn(g, numbered(F.col(text_col))), keys, g).select(*keys, entries().alias("e"))


def fingerprints_of_pairs(rows: DataFrame, keys: list[str], text_col: str, other_col: str) -> DataFrame:
    """(keys, side, e): entries of two texts of each row, sides 0 and 1; keys as for minima.

    K-mers of equal hash, occurrence number and position in both texts are selected from once: a minimum over a text is the
    lesser of those over its shared and its own k-mers. A null text has no k-mer.
    """
    a, b, kmers, part, side = shared.free(rows, "a", "b", "kmers", "part", "side")
    kmers_of = lambda c: F.coalesce(numbered(F.col(c)), F.array().cast("array<bigint>"))
    both = rows.select(*keys, kmers_of(text_col).alias(a), kmers_of(other_col).alias(b))
    # no k-mer is lost as a repeated value, since it has its position
    dealt = both.select(*keys, F.posexplode(F.array(F.array_intersect(a, b), F.array_except(a, b), F.array_except(b, a))).alias(part, kmers))
    found = minima(dealt, [*keys, part], kmers)
    sides = F.when(F.col(part) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.col(part) - 1))
    names = [c for c in found.columns if c not in (*keys, part)]
    found = found.select(*keys, F.explode(sides).alias(side), *names).groupBy(*keys, side).agg(*[F.min(c).alias(c) for c in names])
    return found.select(*keys, F.col(side).alias("side"), entries().alias("e"))


def text_form(e: Column) -> Column:
    """The entries as text: eight hexadecimal digits for each; a text without a word has none."""
    return F.coalesce(F.array_join(F.transform(e, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(LOW))), 8, "0"))), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries; 1 if neither text has a word, 0 if one has none."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).otherwise(F.coalesce(equal.cast("double") / F.lit(float(ENTRIES)), F.lit(0.0)))


def with_next(docs: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, at, ghost, doc_id, text, next_text): each row beside the next by descending id, the last beside the first.

    Null ids come last; rows of one id are ordered by text hash and text. Rows are dealt to ranges of ids (buckets), and
    the first row of each range comes once more as the ghost that ends the range before it, so no task sees all rows and
    texts move once. at numbers a bucket's rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    table = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    cuts = table.agg(F.percentile_approx("key", F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 100 * buckets).alias("c")).first()["c"] if buckets > 1 else []
    cuts = sorted(set(cuts or []))
    # bucket: how many cuts are at or above the key, so that bucket 0 has the largest ids
    at = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c >= F.col("key"))) if cuts else F.lit(0)
    dealt = table.withColumn("bucket", at)
    tops = [(r["bucket"], r["top"]) for r in dealt.groupBy("bucket").agg(F.max("key").alias("top")).orderBy("bucket").collect()]  # a row a bucket
    heads = docs.sparkSession.createDataFrame([(top, tops[i - 1][0]) for i, (_, top) in enumerate(tops)], "key long, before int")
    # of a head's rows the first is needed; others may come along and are never asked for
    ghosts = dealt.join(F.broadcast(heads), "key").select("key", "doc_id", "text", F.col("before").alias("bucket"), F.lit(1).alias("ghost"))
    ghosts = ghosts.groupBy("bucket", "key").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "doc_id")).alias("x")).select("key", "x.doc_id", "x.text", "bucket", F.lit(1).alias("ghost"))
    rows = dealt.select("key", "doc_id", "text", "bucket", F.lit(0).alias("ghost")).union(ghosts)
    w = Window.partitionBy("bucket").orderBy("ghost", F.desc("key"), F.xxhash64("text"), "text")
    return rows.select("bucket", F.row_number().over(w).alias("at"), "ghost", "doc_id", "text", F.lead("text").over(w).alias("next_text"))


def edited(text: Column, other: Column) -> Column:
    """text with its last floor(n / 3) code points replaced by the first as many, or all, of other."""
    n = F.length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(other, F.lit(1), k))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are; a row for each row of docs.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). Null texts are empty; two
    texts without a word are alike (1). A single row is its own next. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, buckets, id_col, text_col)
    # a ghost stands for its own text alone
    rows = rows.withColumn("changed", F.when(F.col("ghost") == 0, edited(F.col("text"), F.col("next_text"))))
    rows = rows.select("bucket", "at", "ghost", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("changed", 256).alias("edited_sha256"), "text", "changed")
    found = fingerprints_of_pairs(rows, ["bucket", "at", "ghost", "doc_id", "n_chars", "edited_sha256"], "text", "changed")
    w = Window.partitionBy("bucket").orderBy("at", "side")
    after = lambda n: F.lead("e", n).over(w).alias(f"e{n}")
    # a row's own side is followed by its edited one, and that by the next row's own
    found = found.select("doc_id", "n_chars", "edited_sha256", "ghost", "side", "e", after(1), after(2)).where("ghost = 0 AND side = 0")
    near = lambda c: likeness(F.col("e"), F.col(c))
    return found.select("doc_id", "n_chars", "edited_sha256", text_form(F.col("e")).alias("fingerprint"), text_form(F.col("e1")).alias("edited_fingerprint"), near("e1").alias("near_edited"), near("e2").alias("near_next"))
