"""SimHash near-duplicates: fingerprints, an exact tiled comparison, and the groups that links form.

Fingerprints within a few bits are found without loss: two that differ in at most r bits agree in one of r + 1 blocks of
bits. Distinct fingerprints are dealt to buckets by each block's value; a bucket is sorted by population count and cut
into tiles, and tiles are compared whole, with numpy's exclusive or and bit counts. Tile pairs whose population counts
are more than r apart are skipped. A bucket above CHUNK rows is dealt to several tasks as pairs of chunks. A tile pair
returns a spanning forest of its links, never all its pairs, so a group of n near copies costs about n rows.

Radii too wide for such blocks take wide fingerprints (wide, meetings): many blocks, of which pairs in question share one
with a known chance, and the same buckets, chunks and tiles.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import shared
from textloom.llm.components import components, forest

TILE = 1024
CHUNK = 8192
BLOCK = 255 * 256  # shingles whose bits are counted at once
PAIRS = 1 << 15  # pairs of a tile that are looked at together: each may take two sketches and their exclusive or


def shingles(found: list[bytes], words: int, seed: int) -> np.ndarray:
    """A hash for each run of so many words; fewer words are one run, and no word is none."""
    import xxhash

    digest, joined = xxhash.xxh64_intdigest, b" ".join(found)
    if not found:
        return np.array([], dtype=np.uint64)
    if len(found) <= words:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    starts = [0, *accumulate(len(w) + 1 for w in found)]
    return np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[words:])), dtype=np.uint64, count=len(found) - words + 1)


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """64 bits over word shingles of the text; A-Z count as a-z, words end at ASCII white space."""
    return majority(shingles(text.lower().split(), words, seed))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half of the hashes; 0 without any."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        part = hashes[at : at + BLOCK]
        pad = -len(part) % 255
        bits = np.unpackbits(np.concatenate([part, np.zeros(pad, np.uint64)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(((2 * counts > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def wide(hashes: np.ndarray, words: int) -> np.ndarray:
    """A SimHash fingerprint of so many 64-bit words: the first is majority(hashes), each other one that of the hashes mixed anew."""
    n, salts = len(hashes), np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros(64 * words, dtype=np.int64)
    step = max(255, BLOCK // words // 255 * 255)
    for at in range(0, n, step):
        part = hashes[at : at + step]
        mixed = part[:, None] ^ salts
        for odd in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            mixed ^= mixed >> np.uint64(33)
            mixed *= np.uint64(odd)
        mixed ^= mixed >> np.uint64(33)
        mixed[:, 0] = part
        bits, whole = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little"), len(part) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, 64 * words).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.uint8)
    return ((2 * counts > n).reshape(words, 64).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 3, seed: int = 42, keep: dict | None = None) -> DataFrame:
    """The columns in keep (name: expression), and fp long: the signed form of each text's fingerprint; a null text is empty."""
    import pyarrow as pa

    shared.bound_batches(docs.sparkSession)
    kept = docs.select(*[x.alias(k) for k, x in (keep or {}).items()], F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text"))
    names = kept.columns[:-1]
    out = kept.drop("_text").withColumn("fp", F.lit(0).cast("long"))

    def run(batches):
        for b in batches:
            fp = [fingerprint(t.as_py(), words, seed) for t in b.column(len(names))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(np.array(fp, dtype=np.uint64).view(np.int64), pa.int64())], names=[*names, "fp"])

    return kept.mapInArrow(run, out.schema)


def tiles(counts: np.ndarray, left: np.ndarray, right: np.ndarray | None, radius: int):
    """Pairs (x, y) of tiles, and whether they are one, of rows of left and right (of left alone where right is None) whose population counts allow radius bits."""
    cut = lambda rows: [rows[i : i + TILE] for i in range(0, len(rows), TILE)]
    first = cut(left[np.argsort(counts[left], kind="stable")])
    second = first if right is None else cut(right[np.argsort(counts[right], kind="stable")])
    for i, x in enumerate(first):
        for y in second[i:] if right is None else second:
            if counts[y[0]] - counts[x[-1]] > radius:
                break
            if counts[x[0]] - counts[y[-1]] <= radius:
                yield x, y, x is y


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (u, v) between fingerprints of a and b, or among a where b is None; nothing is lost but redundant links."""
    points = a if b is None else np.concatenate([a, b])
    right = None if b is None else np.arange(len(a), len(points))
    label = np.arange(len(points))
    for x, y, one in tiles(np.bitwise_count(points).astype(np.int16), np.arange(len(a)), right, radius):
        close = np.bitwise_count(points[x][:, None] ^ points[y][None, :]) <= radius
        if one:
            close = np.triu(close, 1)
        u, v = np.nonzero(close)
        if len(u):
            u, v = x[u], y[v]
            new = label[u] != label[v]
            if new.any():
                label = _merge(label, u[new], v[new])
    moved = np.nonzero(label != np.arange(len(points)))[0]
    return points[moved], points[label[moved]]


def _merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return forest(label[u], label[v], len(label))[label]


def place(dealt: DataFrame, bucket: list[str], key: str, n: int) -> DataFrame:
    """dealt, of n rows, with the task g, the chunks (i, j) of the bucket that a row is compared in, and the row's own chunk c."""
    counts = dealt.groupBy(*bucket).agg(F.count("*").alias("rows"))
    large = counts.where(F.col("rows") > CHUNK)
    # chunks of the large buckets; their number is small, as each holds over CHUNK of the fingerprints
    chunks = F.coalesce(F.ceil(F.col("rows") / F.lit(float(CHUNK))).cast("int"), F.lit(1))
    placed = dealt.join(large, bucket, "left").select(*dealt.columns, chunks.alias("k"))
    mine = F.when(F.col("k") > 1, F.pmod(F.xxhash64(key, F.lit(7)), F.col("k")).cast("int")).otherwise(F.lit(0))
    placed = placed.withColumn("c", mine).select(*dealt.columns, "c", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    task = F.struct(*bucket, F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"))
    placed = placed.select(*[x for x in dealt.columns if x not in bucket], "c", task.alias("task"))

    # small buckets share tasks: as many groups as keep a task near CHUNK rows
    groups = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // CHUNK)
    placed = placed.withColumn("g", F.pmod(F.xxhash64("task"), F.lit(groups)).cast("int"))
    return placed.select("g", *[F.col(f"task.{x}").alias(x) for x in [*bucket, "i", "j"]], *[x for x in placed.columns if x not in ("task", "g")])


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(u, v) such that two fingerprints reach each other over these rows just if they do so over links of at most radius bits.

    fps: one row for each distinct fingerprint, column fp long.
    """
    import pandas as pd

    cuts = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    block = lambda lo, hi: F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))
    dealt = fps.select("fp", F.posexplode(F.array(*[block(lo, hi) for lo, hi in zip(cuts, cuts[1:])])).alias("block", "value"))
    placed = place(dealt, ["block", "value"], "fp", (radius + 1) * fps.count())

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        us, vs = [], []
        pdf = pdf.sort_values(["block", "value", "i", "j", "c", "fp"], kind="stable")
        keys = pdf[["block", "value", "i", "j"]].to_numpy()
        fp, c = pdf.fp.to_numpy().view(np.uint64), pdf.c.to_numpy()
        ends = [*(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1), len(pdf)]
        at = 0
        for end in ends:
            if end - at > 1:
                i, j = keys[at, 2], keys[at, 3]
                part, own = fp[at:end], c[at:end]
                u, v = tile_links(part, None, radius) if i == j else tile_links(part[own == i], part[own == j], radius)
                us.append(u)
                vs.append(v)
            at = end
        u = np.concatenate(us) if us else np.array([], np.uint64)
        v = np.concatenate(vs) if vs else np.array([], np.uint64)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return placed.groupBy("g").applyInPandas(compare, "u long, v long")


def _meet(bits: int, radius: int, close: int, share: float, large: int, most: int):
    """Rows (kind, u, v, n, a, b) of meetings for the buckets of a task."""
    import pandas as pd

    def run(pdf):
        pdf = pdf.sort_values(["bucket", "i", "j", "node"], kind="stable")
        task, own = pdf[["bucket", "i", "j"]].to_numpy(np.int64), pdf.c.to_numpy()
        node, n, dense = pdf.node.to_numpy(), pdf.n.to_numpy().astype(np.int64), pdf.dense.to_numpy(bool)
        fp = pdf[["a", "b"]].to_numpy(np.int64).view(np.uint64)
        start = np.nonzero(np.r_[True, (task[1:] != task[:-1]).any(axis=1)])[0]
        size = np.diff(np.r_[start, len(pdf)])
        of, many = np.repeat(start, size), np.repeat(size, size)
        count = np.bitwise_count(fp).sum(axis=1, dtype=np.int16)
        # of its partners before it in the bucket: the nearest (bits apart, then place), and how many there are
        nearest, partners, near = np.full(len(pdf), 1 << 40), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool)
        degree, joined, known = np.zeros(len(pdf), np.int64), pdf.component.to_numpy(), []
        sketch = np.zeros((len(pdf), len(pdf.sketch[dense].iloc[0]) if dense.any() else 0), np.uint64)
        if dense.any():
            sketch[dense] = np.stack(pdf.sketch[dense].to_numpy()).view(np.uint64)

        def note(x, y, apart):
            good = (np.minimum(n[x], n[y]) >= share * np.maximum(n[x], n[y])) & (joined[x] != joined[y])
            # a pair that agrees in an earlier block of the two words is met there
            block, each = task[x, 0] >> bits, 64 // bits
            for k in range(2 * each):
                same = (fp[x, k // each] ^ fp[y, k // each]) >> np.uint64(bits * (k % each)) & np.uint64((1 << bits) - 1) == 0
                good &= ~(same & (block > k))
            both = good & dense[x] & dense[y]
            if both.any():
                i, j = x[both], y[both]
                close = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64) <= (1 - share) / (1 + share) * (n[i] + n[j])
                i, j = node[i[close]], node[j[close]]
                known.append(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1))
            good &= ~both
            x, y, apart = np.minimum(x, y)[good], np.maximum(x, y)[good], apart[good].astype(np.int64)
            np.minimum.at(nearest, y, (apart << 32) | x)
            np.add.at(partners, y, 1)
            np.add.at(degree, np.concatenate([x, y]), 1)
            near[x] = near[y] = True

        # small buckets all at once
        for d in range(1, min(large, int(size.max()))):
            x = np.nonzero((many[:-d] <= large) & (of[d:] == of[:-d]))[0]
            apart = np.bitwise_count(fp[x] ^ fp[x + d]).sum(axis=1)
            note(x[apart <= radius], x[apart <= radius] + d, apart[apart <= radius])
        for s, k in zip(start[size > large], size[size > large]):
            rows, (_, i, j) = np.arange(s, s + k), task[s]
            parts = (rows, None) if i == j else (rows[own[s : s + k] == i], rows[own[s : s + k] == j])
            for x, y, one in tiles(count, *parts, radius):
                apart = np.bitwise_count(fp[x, 0][:, None] ^ fp[y, 0][None, :])
                apart += np.bitwise_count(fp[x, 1][:, None] ^ fp[y, 1][None, :])
                found = np.flatnonzero(np.triu(apart <= radius, 1) if one else apart <= radius)
                for at in range(0, len(found), PAIRS):
                    u, v = np.divmod(found[at : at + PAIRS], len(y))
                    note(x[u], y[v], apart[u, v])
        y = np.nonzero(nearest < (close + 1 << 32))[0]
        x, k = nearest[y] & 0xFFFFFFFF, np.nonzero(near & np.isin(of, of[partners > (nearest < (close + 1 << 32))]))[0]
        pairs = np.unique(np.concatenate([np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], axis=1), *known]), axis=0)
        none = np.zeros(len(pairs), np.int64)
        out = pd.DataFrame({"kind": none.astype(np.int32), "u": pairs[:, 0], "v": pairs[:, 1], "n": none.astype(np.int32), "a": none, "b": none})
        u = (task[k, 0] << 40) | (task[k, 1] << 20) | task[k, 2]
        more = pd.DataFrame({"kind": np.ones(len(k), np.int32), "u": u, "v": node[k], "n": n[k].astype(np.int32), "a": fp[k, 0].view(np.int64), "b": fp[k, 1].view(np.int64)})
        many = np.unique(node[degree > most]) if most else node[:0]
        return pd.concat([out, more, pd.DataFrame({"kind": np.int32(2), "u": many, "v": many, "n": np.int32(0), "a": np.int64(0), "b": np.int64(0)})])

    return run


def deal(fps: DataFrame, bits: int, first: int = 0, last: int | None = None) -> tuple[DataFrame, int]:
    """fps (columns node, fp and others) by each of its fingerprint's blocks of so many bits from first to before last: a and b, the first two words, and bucket in place of fp; and the number of rows."""
    each = 64 // bits
    words = fps.select(F.size("fp")).first()
    last = last or (words[0] if words else 2) * each
    value = f"cast(shiftrightunsigned(fp[cast(x div {each} AS int)], cast({bits} * (x % {each}) AS int)) & {(1 << bits) - 1}L AS int)"
    bucket = F.explode(F.expr(f"transform(sequence({first}, {last - 1}), x -> x * {1 << bits} + {value})")).alias("bucket")
    return fps.select(*[c for c in fps.columns if c != "fp"], F.col("fp")[0].alias("a"), F.col("fp")[1].alias("b"), bucket), (last - first) * fps.count()


def meetings(fps: DataFrame, bits: int, radius: int, close: int, share: float, large: int, first: int = 0, last: int | None = None, most: int = 0) -> DataFrame:
    """Pairs of wide fingerprints that agree in one of the blocks of so many bits and differ in radius of their first 128 bits at most.

    fps: one row for each node, columns node long, n int and fp array<long>; pairs whose n are below share of each other are
    left out, and so are pairs of one component, if there is such a column. Of pairs of two nodes that a column dense marks, those whose column sketch
    allows that share are all listed, as kind 0. Returns (kind, u, v, n, a, b). Kind 0: a pair of nodes u, v; of a node's partners
    before it in a bucket, the nearest, if it is within close bits. Where that leaves pairs out, kind 1 holds all nodes v of the bucket u that have a
    partner, with n and the first two words; all other pairs are in kind 0. Kind 2, where most is given: nodes v of more than most partners in a
    bucket. Buckets of large rows at most are compared together.
    Blocks before first and from last on can be left to another call, but a pair that agrees in one of the first two words is met there alone.
    """
    if "dense" not in fps.columns:
        fps = fps.select("node", "n", "fp", F.lit(False).alias("dense"), F.col("node").alias("component"), F.lit(None).cast("array<long>").alias("sketch"))
    dealt, rows = deal(fps, bits, first, last)
    return place(dealt, ["bucket"], "node", rows).groupBy("g").applyInPandas(_meet(bits, radius, close, share, large, most), "kind int, u long, v long, n int, a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id, digest) for each row of docs, whatever else its columns are called.

    component_id is the smallest id that links of at most radius bits reach, the row's own included. Equal texts have
    equal fingerprints and so share a component; a null text counts as empty, and texts without a word have fingerprint
    zero and are linked as any other. A null id never names a group, unless all its ids are null. An empty table gives
    an empty one. digest is xxhash64 of the text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    table = shared.save(fingerprints(docs, text_col, words, seed, {"doc_id": F.col(id_col).cast("long"), "digest": F.xxhash64(text)}), "fingerprints")
    fps = shared.save(table.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint")
    member = components(links(fps.select("fp"), radius), "simhash")
    of = fps.join(member, F.col("fp") == F.col("node")).select("fp", "first_id", "component")
    least = of.groupBy("component").agg(F.min("first_id").alias("least_id"))
    of = of.join(least, "component").select("fp", "least_id")
    named = shared.save(fps.join(of, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id")), "named")
    return table.join(named, "fp").select("doc_id", "fp", "component_id", "digest")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without near-duplicates: of each group, the row with the smallest id stays (of rows with equal ids and texts, one).

    Columns named like the operator's own are untouched: it works on ids and text hashes alone and joins by them.
    """
    return first_of_each(docs, groups(docs, id_col, text_col, **options), id_col, text_col)


def first_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group in found (doc_id, digest, component_id), the row of docs with the smallest id."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    best = found.groupBy("component_id").agg(F.min(first).alias("best"))
    *keys, row, one = shared.free(docs, "keep_id", "keep_none", "keep_digest", "row", "one")
    keep = best.select(F.coalesce("best.doc_id", F.lit(0)).alias(keys[0]), F.col("best.none").alias(keys[1]), F.col("best.digest").alias(keys[2]))
    text, key = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    rows = docs.select("*", F.coalesce(key, F.lit(0)).alias(keys[0]), key.isNull().alias(keys[1]), F.xxhash64(text).alias(keys[2]), F.monotonically_increasing_id().alias(row))
    # repeated rows of one id and text are beside each other after the join: one stays, without another shuffle
    first_row = F.row_number().over(Window.partitionBy(*keys).orderBy(row))
    return rows.join(keep, keys).withColumn(one, first_row).where(F.col(one) == 1).select(*docs.columns)
