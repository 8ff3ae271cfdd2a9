"""Token ids, and two ways of packing documents into sequences of equal capacity.

Ids are those of the ``tokenizers`` file named, without special tokens added, followed by an end id. The file's own
vocabulary drives a faster byte-level encoder with the same result; where a text holds a special token's string, or the
fast encoder fails, the library itself encodes it.

Long documents are cut where they are encoded; pieces, none longer than a sequence, are shuffled to groups of about
GROUP_TOKENS ids by a hash, so no task's share grows with a document, a key or the table. Cost-balanced packing cuts
into equal pieces of half a sequence at most: a piece of a whole sequence could not be balanced by anything beside it.
"""

from __future__ import annotations

import functools
import json
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import shared

GROUP_TOKENS = 1 << 21


@functools.cache
def library(path: str):
    """The library's own tokenizer, which most workers never need."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def encoder(path: str):
    """A function from a text to its ids (numpy) for a byte-level BPE file of the tokenizers library; and the id type."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    # byte-level files write a byte as a printable character: itself, or the next one from 256 on
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {x["content"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
    in_order = all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(merges)) and len(ranks) == 256 + len(merges)
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if in_order else None
    kind = np.dtype("<u2") if max(vocab.values()) < 1 << 16 else np.dtype("<u4")

    def encode(text: str) -> np.ndarray:
        if fast is not None and not any(x in text for x in special):
            try:
                return np.array(fast.encode_ordinary(text), dtype=kind)
            except BaseException as e:  # the regex library gives up on some very long runs, with a panic of its own
                if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                    raise
        return np.array(library(path).encode(text, add_special_tokens=False).ids, dtype=kind)

    return encode, kind


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pieces(docs: DataFrame, capacity: int, end_id: int, path: str | None, id_col: str, text_col: str, even: bool = False) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids_crc32, ids): each document cut at multiples of the capacity, or (even) into
    as many pieces of lengths that differ by one at most. A null text is empty: its only id is the end id.
    """
    shared.bound_batches(docs.sparkSession)
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa

        encode, kind = encoder(path or default_path())
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
        for b in batches:
            rows, held = [], 0
            for key, text in zip(b.column(0), b.column(1)):
                key, ids = key.as_py(), np.append(encode(text.as_py()), kind.type(end_id))
                n = -(-len(ids) // capacity)
                cuts = [len(ids) * i // n for i in range(n + 1)] if even else [*range(0, len(ids), capacity), len(ids)]
                for at, end in zip(cuts, cuts[1:]):
                    part = ids[at:end]
                    rows.append((key, at, len(part), len(ids), crc(part), part.tobytes()))
                    held += len(part)
                if held >= 1 << 21:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return table.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary")


def grouped(docs: DataFrame, cut: DataFrame, text_col: str, group_tokens: int) -> DataFrame:
    """Deal pieces to groups; their number follows the table's bytes, at about three to an id."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long")), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    n = max(1, math.ceil((total["n"] / 3 + total["rows"]) / group_tokens))
    return cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n)).cast("long")).groupBy("g")


def balance(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Cost-balanced packing of pieces no longer than the capacity into as few sequences as their tokens need.

    A piece of n tokens costs linear * n + quadratic * n * n. Pieces go in descending order, each to the cheapest
    sequence with room for it; one that fits nowhere is cut over the sequences with the most room. Returns
    (piece, begin, length, sequence, offset).
    """
    n = -(-int(lengths.sum()) // capacity)
    room, cost, out = np.full(n, capacity), np.zeros(n), []
    for i in np.argsort(-lengths, kind="stable"):
        begin, left = 0, int(lengths[i])
        while left:
            fits = room >= left
            s = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(room))
            take = min(left, int(room[s]))
            out.append((int(i), begin, take, s, capacity - int(room[s])))
            room[s] -= take
            cost[s] += linear * take + quadratic * take * take
            begin, left = begin + take, left - take
    return out


def pack_balanced(docs: DataFrame, capacity: int = 2048, end_id: int = 1, path: str | None = None, linear: float = 1.0, quadratic: float = 1 / 2048, id_col: str = "doc_id", text_col: str = "text", group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pack every document into sequences of at most capacity ids, balanced by attention cost; a row for each piece.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): each id of each document lies in one piece, and
    a sequence's pieces follow each other from offset 0. Padding is under one sequence for each group. Documents of over
    half a capacity come as equal pieces, and all pieces go through the balance. A null text is an empty document, of the
    end id alone. Repeated rows and null ids are packed as rows of their own; other columns are not read. An empty table
    gives an empty one.
    """
    import pandas as pd

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        base, kind = int(pdf.g.iloc[0]) << 32, np.dtype("<u2") if len(pdf.ids.iloc[0]) == 2 * pdf.length.iloc[0] else np.dtype("<u4")
        rows = []
        for i, begin, take, s, offset in balance(pdf.length.to_numpy(), capacity, linear, quadratic):
            whole = take == pdf.length.iat[i]
            check = pdf.ids_crc32.iat[i] if whole else crc(np.frombuffer(pdf.ids.iat[i], kind)[begin : begin + take])
            rows.append((pdf.doc_id.iat[i], pdf.start.iat[i] + begin, take, check, pdf.doc_tokens.iat[i], base + s, offset))
        return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]).astype({"doc_id": "Int64"})

    cut = pieces(docs, max(1, capacity // 2), end_id, path, id_col, text_col, even=True)
    return grouped(docs, cut, text_col, group_tokens).applyInPandas(pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


class CapacityTree:
    """Open sequences by room left, in a segment tree over 0..capacity: the least room that suffices in O(log capacity)."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.width)
        self.at: list[list[int]] = [[] for _ in range(self.width)]

    def add(self, room: int, sequence: int) -> None:
        self.at[room].append(sequence)
        i = self.width + room
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) of an open sequence with the least room of at least need, which is removed."""
        i = self.width + need
        while not self.any[i]:
            while i & 1:  # a right child: nothing to the right below this parent
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.width:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.width
        sequence = self.at[room].pop()
        if not self.at[room]:
            while i and not (i < self.width and (self.any[2 * i] or self.any[2 * i + 1])):
                self.any[i] = 0
                i >>= 1
        return room, sequence


def best_fit(lengths: np.ndarray, capacity: int) -> list[int]:
    """Best-fit-decreasing: the sequence of each piece; lengths are at most the capacity and come in descending order."""
    tree, out, n = CapacityTree(capacity), [], 0
    for need in map(int, lengths):
        room, s = tree.take(need) or (capacity, n)
        n = max(n, s + 1)
        tree.add(room - need, s)
        out.append(s)
    return out


def pack_matrices(docs: DataFrame, capacity: int = 2048, end_id: int = 1, pad_id: int = 50256, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", group_tokens: int = GROUP_TOKENS, directory: str | None = None) -> DataFrame:
    """Pack every document by best-fit-decreasing and write packed id matrices; a row for each sequence.

    Each group is a file of its own in the directory (a new one in the shared folder by default): a matrix of ids, one
    row for each sequence, padded with pad_id. Returned: sequence_id, file, row, n_tokens, doc_ids and starts (of the
    segments, in order), cu_seqlens (0 first, n_tokens last), position_resets (where positions begin at 0 again), and
    ids_crc32 of the sequence's ids. Documents are cut only if longer than the capacity, without loss. A null text is an
    empty document, of the end id alone; null ids and repeated rows are packed as rows of their own; other columns are
    not read. An empty table writes no file and gives an empty result.
    """
    import pandas as pd

    directory = directory or shared.folder(docs.sparkSession, "token-ids")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        import io

        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        g = int(pdf.g.iloc[0])
        kind = np.dtype("<u2") if (pdf.ids.str.len() == 2 * pdf.length).all() else np.dtype("<u4")
        placed = best_fit(pdf.length.to_numpy(), capacity)
        members: list[list[int]] = [[] for _ in range(max(placed) + 1)]
        for i, s in enumerate(placed):
            members[s].append(i)
        matrix = np.full((len(members), capacity), pad_id, dtype=kind)
        rows, name = [], f"ids-{g:08d}.npy"
        keys = [None if pd.isna(x) else int(x) for x in pdf.doc_id]
        for s, own in enumerate(members):
            at = 0
            ends = [0]
            for i in own:
                ids = np.frombuffer(pdf.ids.iat[i], kind)
                matrix[s, at : at + len(ids)] = ids
                at += len(ids)
                ends.append(at)
            rows.append(((g << 32) + s, name, s, at, [keys[i] for i in own], [int(pdf.start.iat[i]) for i in own], ends, ends[:-1], crc(matrix[s, :at])))
        buffer = io.BytesIO()
        np.save(buffer, matrix)
        shared.commit(directory, name, buffer.getbuffer())
        return pd.DataFrame(rows, columns=["sequence_id", "file", "row", "n_tokens", "doc_ids", "starts", "cu_seqlens", "position_resets", "ids_crc32"])

    cut = pieces(docs, capacity, end_id, path, id_col, text_col)
    out = grouped(docs, cut.withColumn("doc_id", F.col("doc_id").cast("string")), text_col, group_tokens)
    return shared.save(out.applyInPandas(pack, "sequence_id long, file string, row int, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, position_resets array<int>, ids_crc32 long"), "packed")
