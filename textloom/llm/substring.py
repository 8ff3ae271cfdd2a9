"""Substring dedup: words covered by a window of words that also begins elsewhere are removed, exactly.

The corpus is cut into reference shards without loss. In each window the word q-gram of least hash is its anchor; equal
windows have equal anchors, so neighbouring windows with one anchor form a segment and segments are dealt by anchor.
An anchor seen once holds no repeated window, and a segment whose text recurs is repeated throughout; both follow from
counts of hashes. Only for anchors with several different segment texts are texts compared: a shard of such texts, of
bounded size, becomes a suffix automaton with occurrence counts, and the shard's texts are streamed through it for
matching statistics. A window whose state counts two occurrences or more is repeated. Anchors with more than WIDE
segments (a phrase that much of the corpus shares) would make a shard of unbounded size: their texts are cut again by
anchors under other hashes, LEVELS times, and windows of what is still together then are counted by their words.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import shared

Q = 8
WIDE = 400
#: How often the texts of an anchor with more are cut by anchors under other hashes.
LEVELS = 2
#: Texts of compared segments for each shard.
SHARD = 500
#: Rows of a batch that goes back from Python.
ROWS = 20_000
KEY = "doc_id long, digest long"


def _slices(text: bytes) -> tuple[bytes, list[int], list[bytes]]:
    """The words joined by one space, where each word starts (and one past the end), and the words."""
    words = text.split()
    return b" ".join(words), [0, *accumulate(len(w) + 1 for w in words)], words


def anchors(words: list[bytes], window: int, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each segment: first window, past the last window, and the hash of their anchor; each level has hashes of its own."""
    import xxhash

    n = len(words) - window + 1
    if n <= 0:
        none = np.array([], np.int64)
        return none, none, none.astype(np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    q = min(Q, window)
    g = np.zeros(len(words) - q + 1, np.uint64)
    for j in range(q):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(g)]
    g += np.uint64(level * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    # (hash, position) with position below, so that the leftmost of equals wins
    least = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    span, width = window - q + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width : span - width + n])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.concatenate([[0], np.nonzero(at[1:] != at[:-1])[0] + 1])
    return starts, np.append(starts[1:], n), g[at[starts]]


def _table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.cast("binary").alias("text"))


def segments(table: DataFrame, window: int) -> DataFrame:
    """(doc_id, digest, a, n, m, sh): a segment's first window, its windows, its anchor and the hash of its text."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            parts: list[list] = [[], [], [], [], []]
            for row, t in enumerate(b.column(2)):
                joined, at, words = _slices(t.as_py())
                a, e, m = anchors(words, window)
                if len(a):
                    first, last = a.tolist(), (e + window - 1).tolist()
                    sh = [digest(joined[at[x] : at[y] - 1]) for x, y in zip(first, last)]
                    for to, x in zip(parts, (np.full(len(a), row), a, e - a, m.view(np.int64), np.array(sh, np.uint64).view(np.int64))):
                        to.append(x)
            if parts[0]:
                row, a, n, m, sh = (np.concatenate(x) for x in parts)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(a, pa.int32()), pa.array(n, pa.int32()), pa.array(m), pa.array(sh)], names=["doc_id", "digest", "a", "n", "m", "sh"])

    return table.mapInArrow(run, KEY + ", a int, n int, m long, sh long")


class SuffixAutomaton:
    """Over sequences of integers, each with a weight: how often its substrings occur in all."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self.last, self.mark = 0, -1

    def _state(self, length: int, count: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.count.append(count)
        return len(self.next) - 1

    def _extend(self, c: int, weight: int) -> None:
        new, p = self._state(self.length[self.last] + 1, weight), self.last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            if self.length[q] != self.length[p] + 1:
                clone = self._state(self.length[p] + 1, 0)
                self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
                while p >= 0 and self.next[p].get(c) == q:
                    self.next[p][c] = clone
                    p = self.link[p]
                self.link[q] = clone
                q = clone
            self.link[new] = q
        self.last = new

    def add(self, symbols: list[int], weight: int) -> None:
        for c in symbols:
            self._extend(c, weight)
        self._extend(self.mark, 0)  # a symbol that comes once: no match crosses it
        self.mark -= 1

    def finish(self) -> None:
        """Sum occurrences up the suffix links."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def repeated(self, symbols: list[int], window: int) -> list[int]:
        """First positions of the windows that occur twice or more, by matching statistics capped at the window."""
        s = size = 0
        out = []
        for i, c in enumerate(symbols):
            while s and c not in self.next[s]:
                s = self.link[s]
                size = self.length[s]
            if c in self.next[s]:
                s, size = self.next[s][c], size + 1
            if size >= window:
                while self.length[self.link[s]] >= window:
                    s = self.link[s]
                size = window
                if self.count[s] > 1:
                    out.append(i - window + 1)
        return out


def _ranges(starts: list[int]) -> list[tuple[int, int]]:
    """Consecutive numbers as (first, past the last)."""
    out: list[tuple[int, int]] = []
    for x in starts:
        if out and out[-1][1] == x:
            out[-1] = (out[-1][0], x + 1)
        else:
            out.append((x, x + 1))
    return out


def _counts(segments: DataFrame, m: str, sh: str) -> DataFrame:
    """(m, k, mixed) of the anchors that are seen twice or more: how many segments have it, and whether their texts differ.

    Saved, so that a join with it is of two plain shuffles, and adaptive execution can split an anchor of many segments.
    """
    found = segments.groupBy(F.col(m).alias("m")).agg(F.count("*").alias("k"), (F.min(sh) != F.max(sh)).alias("mixed"))
    return shared.save(found.where("k > 1"), "anchors")


def compared(texts: DataFrame, window: int, level: int = 0) -> DataFrame:
    """Ranges of repeated windows (m, sh, s, e) of segment texts (m, sh, cnt, k, text); m has at most k texts."""
    spark = texts.sparkSession
    narrow = texts.where(F.col("k") <= WIDE)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), narrow.count() // SHARD)

    def automaton(pdf: pd.DataFrame) -> pd.DataFrame:
        ids: dict[bytes, int] = {}
        found, sa = [[ids.setdefault(w, len(ids)) for w in bytes(t).split()] for t in pdf.text], SuffixAutomaton()
        for symbols, cnt in zip(found, pdf.cnt):
            sa.add(symbols, int(cnt))
        sa.finish()
        # a text that comes twice is repeated throughout already
        rows = [(m, sh, s, e) for symbols, m, sh, cnt in zip(found, pdf.m, pdf.sh, pdf.cnt) if cnt == 1 for s, e in _ranges(sa.repeated(symbols, window))]
        return pd.DataFrame(rows, columns=["m", "sh", "s", "e"])

    near = narrow.withColumn("shard", F.pmod(F.xxhash64("m"), F.lit(shards))).groupBy("shard").applyInPandas(automaton, "m long, sh long, s int, e int")
    wide = texts.where(F.col("k") > WIDE).select("m", "sh", "cnt", "text")
    if wide.isEmpty():
        return near
    return near.union(_anchored_again(wide, window, level + 1) if level < LEVELS else _counted(wide, window))


def _anchored_again(wide: DataFrame, window: int, level: int) -> DataFrame:
    """Cut texts that share an anchor by anchors under other hashes; windows equal before are together again."""

    def cut(batches):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for pdf in batches:
            rows = []
            for m, sh, cnt, t in zip(pdf.m, pdf.sh, pdf.cnt, pdf.text):
                joined, at, words = _slices(bytes(t))
                for a, e, x in zip(*(y.tolist() for y in anchors(words, window, level))):
                    part = joined[at[a] : at[e + window - 1] - 1]
                    rows.append((m, sh, cnt, a, e - a, digest(x.to_bytes(8, "little") + int(m).to_bytes(8, "little", signed=True)), digest(part), part))
            out = pd.DataFrame(rows, columns=["m", "sh", "cnt", "a", "n", "m2", "sh2", "text"])
            yield out.assign(m2=out.m2.to_numpy(np.uint64).view(np.int64), sh2=out.sh2.to_numpy(np.uint64).view(np.int64))

    parts = shared.save(wide.mapInPandas(cut, "m long, sh long, cnt long, a int, n int, m2 long, sh2 long, text binary"), "parts")
    counts = _counts(parts, "m2", "sh2").withColumnRenamed("m", "m2")
    whole = parts.groupBy("m2", "sh2").agg(F.sum("cnt").alias("cnt"), F.first("n").alias("n")).where("cnt > 1").select("m2", "sh2", F.lit(0).alias("s"), F.col("n").alias("e"))
    # a text once for each of its anchors: the rows of an anchor are joined with its count, then equal texts are put together
    open_ = shared.save(parts.join(counts.where("mixed"), "m2").select("m2", "sh2", "cnt", "k", "text"), "part-texts")
    texts = open_.groupBy(F.col("m2").alias("m"), F.col("sh2").alias("sh")).agg(F.sum("cnt").alias("cnt"), F.first("k").alias("k"), F.first("text").alias("text"))
    ranges = compared(shared.save(texts, "part-classes"), window, level)
    ranges = whole.union(ranges.select(F.col("m").alias("m2"), F.col("sh").alias("sh2"), "s", "e"))
    return parts.where("cnt = 1").drop("text").join(ranges, ["m2", "sh2"]).select("m", "sh", (F.col("a") + F.col("s")).alias("s"), (F.col("a") + F.col("e")).alias("e"))


def _counted(wide: DataFrame, window: int) -> DataFrame:
    """Count the windows of texts, word for word: for anchors that no level has told apart."""

    def windows(batches):
        for pdf in batches:
            rows = []
            for m, sh, cnt, t in zip(pdf.m, pdf.sh, pdf.cnt, pdf.text):
                joined, at, words = _slices(bytes(t))
                rows += [(m, sh, i, cnt, joined[at[i] : at[i + window] - 1]) for i in range(len(words) - window + 1)]
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=["m", "sh", "s", "cnt", "w"])
                    rows = []
            yield pd.DataFrame(rows, columns=["m", "sh", "s", "cnt", "w"])

    rows = shared.save(wide.mapInPandas(windows, "m long, sh long, s int, cnt long, w binary"), "windows")
    again = shared.save(rows.groupBy("w").agg(F.sum("cnt").alias("t")).where("t > 1").select("w"), "again")
    return rows.where("cnt = 1").join(again, "w").select("m", "sh", "s", (F.col("s") + 1).alias("e"))


def repeated_windows(table: DataFrame, window: int) -> DataFrame:
    """(doc_id, digest, ranges): for each id and text with repeated windows, their (first, past the last) positions."""
    found = shared.save(segments(table, window), "segments")
    counts = _counts(found, "m", "sh")
    again = shared.save(found.join(counts, "m"), "repeated")
    shared.drop(found, counts)
    first = F.min(F.struct("doc_id", "digest", "a", "n", "k", "mixed"))
    classes = shared.save(again.groupBy("m", "sh").agg(F.count("*").alias("cnt"), first.alias("r")), "classes")
    # a text that comes twice is repeated throughout, whatever else its anchor has
    whole = classes.where("cnt > 1").select("m", "sh", F.lit(0).alias("s"), F.col("r.n").alias("e"))
    open_ = classes.where("r.mixed")
    wanted = open_.groupBy(F.col("r.doc_id").alias("doc_id"), F.col("r.digest").alias("digest")).agg(F.collect_list(F.struct("m", "sh", "cnt", F.col("r.k").alias("k"), F.col("r.a").alias("a"), F.col("r.n").alias("n"))).alias("wanted"))
    one = table.alias("t").join(wanted.alias("x"), F.col("t.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("t.digest") == F.col("x.digest")))

    def texts(batches):
        for pdf in batches:
            rows = []
            for t, wanted in zip(pdf.text, pdf.wanted):
                joined, at, _ = _slices(bytes(t))
                rows += [(x["m"], x["sh"], x["cnt"], x["k"], joined[at[x["a"]] : at[x["a"] + x["n"] + window - 1] - 1]) for x in wanted]
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=["m", "sh", "cnt", "k", "text"])
                    rows = []
            yield pd.DataFrame(rows, columns=["m", "sh", "cnt", "k", "text"])

    # rows of one id and text name their segments once each
    text = one.select("t.text", "x.wanted").mapInPandas(texts, "m long, sh long, cnt long, k long, text binary")
    text = shared.save(text.dropDuplicates(["m", "sh"]), "segment-texts")
    # a row for each text, so that the join gives a row for each segment at most
    ranges = whole.union(compared(text, window)).groupBy("m", "sh").agg(F.collect_list(F.struct("s", "e")).alias("r"))
    ranges = shared.save(ranges, "ranges")
    own = F.transform("r", lambda x: F.struct((F.col("a") + x["s"]).alias("s"), (F.col("a") + x["e"]).alias("e")))
    # each segment stays, repeated or not, so the join returns as many rows as come in whatever the texts repeat
    marked = again.join(ranges, ["m", "sh"], "left").select("doc_id", "digest", own.alias("r"))
    out = shared.save(marked.groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("r")).alias("ranges")), "marked")
    shared.drop(again, classes, text, ranges)
    return out


def spans(ranges, n_words: int, window: int) -> list[tuple[int, int]]:
    """Maximal spans of words covered by windows beginning in the ranges."""
    out: list[list[int]] = []
    for s, e in sorted((int(x["s"]), int(x["e"]) + window - 1) for x in ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, min(e, n_words)) for s, e in out]


def deduplicate(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with kept_text (the words left, joined by one space), n_words, n_removed and spans (of removed words).

    Words end at ASCII white space and are not changed; a null text has none. Windows are judged on the input, so every
    copy of a repeated passage goes. Repeated rows count as copies of each other; null ids are ids. Columns of these
    names are replaced, all others are kept. An empty table gives an empty one.
    """
    rest = [c for c in docs.columns if c.lower() not in ("kept_text", "n_words", "n_removed", "spans")]
    done, x = _removed(docs, window, id_col, text_col)
    return done.select(*rest, f"{x}.kept_text", f"{x}.n_words", f"{x}.n_removed", f"{x}.spans")


def replaced(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs, whose texts have lost repeated passages; chars_col follows the text, and texts without a loss stay as they are."""
    done, x = _removed(docs, window, id_col, text_col)
    lost = F.col(f"{x}.n_removed") > 0
    text = F.when(lost, F.col(f"{x}.kept_text")).otherwise(F.col(text_col))
    chars = F.when(lost, F.length(f"{x}.kept_text").cast("long")).otherwise(F.col(chars_col))
    return done.select(*[text.alias(c) if c == text_col else chars.alias(c) if c == chars_col else c for c in docs.columns])


def _removed(docs: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """docs with more columns, and the name of the one with the struct (kept_text, n_words, n_removed, spans)."""
    shared.bound_batches(docs.sparkSession)
    table = _table(docs, id_col, text_col)
    whole, d, g, r, x = shared.free(docs, "whole_text", "key_id", "key_digest", "cut_ranges", "cut")
    marked = repeated_windows(table, window).select(F.col("doc_id").alias(d), F.col("digest").alias(g), F.col("ranges").alias(r))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    joined = docs.withColumn(whole, text).join(marked, F.col(id_col).cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(whole) == F.col(g)), "left")

    @F.pandas_udf("struct<kept_text: string, n_words: long, n_removed: long, spans: array<array<int>>>")
    def removed(text, ranges):
        rows = []
        for t, r in zip(text, ranges):
            words = bytes(t).split()
            cut = spans(r, len(words), window) if r is not None else []
            kept, at = [], 0
            for s, e in cut:
                kept += words[at:s]
                at = e
            kept += words[at:]
            rows.append((b" ".join(kept).decode(), len(words), len(words) - len(kept), [list(x) for x in cut]))
        return pd.DataFrame(rows, columns=["kept_text", "n_words", "n_removed", "spans"])

    return joined.withColumn(x, removed(F.col(whole).cast("binary"), F.col(r))), x
