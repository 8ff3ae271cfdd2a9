"""WARC archives: writing, reading by byte range, and revisit resolution.

Records are gzip members of their own, so a reader can start at any record's offset. Resolution shuffles headers only
(digest, sizes, place): payloads are copied straight from the source archive to the new one by offset.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import shared

#: Salts over which the headers of a much repeated payload are dealt.
SALTS = 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER = "archive string, offset long, stored long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_uri string"


def record(fields: dict[str, str], payload: bytes, level: int = 1) -> bytes:
    """One record as a gzip member; Content-Length is that of the payload given."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(payload)}", "", ""]
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(lines).encode()) + press.compress(payload) + press.compress(b"\r\n\r\n") + press.flush()


def now() -> str:
    """The date of a run's records; the driver takes it once, so that a second attempt of a task writes the same bytes."""
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def fresh(record_id: str, date: str, kind: str, page_id, url: str | None, payload_bytes: int, digest: str, refers_to=None, refers_uri=None) -> dict[str, str]:
    """Headers of a new record; what the reader needs of a page is in them, so a revisit stands alone."""
    clean = lambda x: " ".join((x or "").split())  # noqa: E731  no line ends in a header
    out = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{record_id}>", "WARC-Date": date}
    out |= {"WARC-Target-URI": clean(url)} if url is not None else {}
    out |= {"WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(payload_bytes), "Content-Type": "text/html; charset=utf-8"}
    out |= {"X-Page-Id": str(page_id)} if page_id is not None else {}
    if kind == "revisit":
        out |= {"WARC-Profile": PROFILE, "X-Refers-To-Page-Id": str(refers_to)}
        out |= {"WARC-Refers-To-Target-URI": clean(refers_uri)} if refers_uri is not None else {}
    return out


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; it must end as its Content-Length says."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if not lines[0].startswith("WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    return fields, rest[:n]


class Writer:
    """Archives of bounded size for one task.

    Names follow the partition, and record ids the directory, the partition and the record's number there: a second
    attempt of a task writes the same bytes under the same names, whichever of the two ends last.
    """

    def __init__(self, directory: str, part: int | None = None):
        from pyspark import TaskContext

        self.directory, self.part, self.k, self.n = directory, TaskContext.get().partitionId() if part is None else part, 0, 0
        self.file = None

    def record_id(self) -> str:
        self.n += 1
        return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{self.directory}/{self.part}/{self.n}"))

    @property
    def name(self) -> str:
        return f"part-{self.part:06d}-{self.k:05d}.warc.gz"

    def add(self, data: bytes) -> tuple[str, int, int]:
        """(archive, offset, stored bytes) of a record."""
        if self.file is not None and self.file.tell() >= shared.ARCHIVE_BYTES:
            self.close()
            self.k += 1
        if self.file is None:
            self.file = shared.File(self.directory, self.name)
        at = self.file.tell()
        self.file.write(data)
        return self.name, at, len(data)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def _rows(rows: list[tuple]):
    import pandas as pd

    names = [x.split()[0] for x in HEADER.split(", ")]
    pdf = pd.DataFrame(rows, columns=names)
    return pdf.astype({"page_id": "Int64", "refers_to": "Int64"})


def write_pages(pages: DataFrame, directory: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write each row as a response record; returns the headers with each record's place, written once.

    A null payload is empty; a null id or url leaves its header out. Repeated rows are records of their own.
    """
    table = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("html"))

    date = now()

    def run(batches):
        writer = Writer(directory)
        for b in batches:
            rows = []
            for page, url, html in zip(b.page_id.astype("object"), b.url, b.html):
                page, payload = None if page is None or page != page else int(page), bytes(html)
                digest = hashlib.sha1(payload).hexdigest()
                place = writer.add(record(fresh(writer.record_id(), date, "response", page, url, len(payload), digest), payload))
                rows.append((*place, page, url, len(payload), digest, "response", None, None))
            yield _rows(rows)
        writer.close()

    return shared.save(table.withColumn("page_id", F.col("page_id").cast("string")).mapInPandas(run, HEADER), "warc-headers")


def resolve(headers: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Decide each record's type: of records with equal payloads of at least least_bytes, the one with the largest page_id is
    the response (of equal ids the last by place; null ids come before all others), the others revisit it.

    A record that came in as a revisit joins the responses of its digest; without any it stays one, with refers_to null.
    """
    key = F.struct(F.col("page_id").isNotNull(), "page_id", "archive", "offset")
    best = headers.groupBy("payload_digest").agg(F.max(F.when(F.col("record_type") == "response", F.struct(key.alias("key"), "url"))).alias("best"), F.count("*").alias("n"), F.max((F.col("payload_bytes") >= least_bytes) | (F.col("record_type") == "revisit")).alias("needed"))
    best = best.where("n > 1 AND needed").select("payload_digest", F.col("best.key.page_id").alias("to"), F.col("best.url").alias("to_url"), F.col("best.key.archive").alias("to_archive"), F.col("best.key.offset").alias("to_offset"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    mine = headers.withColumn("salt", F.pmod(F.xxhash64("archive", "offset"), F.lit(SALTS)).cast("int"))
    joined = mine.join(best, ["payload_digest", "salt"], "left")
    other = ((F.col("payload_bytes") >= least_bytes) | (F.col("record_type") == "revisit")) & F.col("to_archive").isNotNull() & ~((F.col("to_archive") == F.col("archive")) & (F.col("to_offset") == F.col("offset")))
    kind = F.when(other, "revisit").otherwise(F.col("record_type"))
    return joined.select("archive", "offset", "stored", "page_id", "url", "payload_bytes", "payload_digest", kind.alias("record_type"), F.when(other, F.col("to")).alias("refers_to"), F.when(other, F.col("to_url")).alias("refers_uri"))


def rewrite(resolved: DataFrame, source: str, directory: str) -> DataFrame:
    """Write the deduplicated archives with fresh headers, payloads copied by offset; returns their headers, written once."""
    spark = resolved.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = resolved.repartitionByRange(n, "archive", "offset").sortWithinPartitions("archive", "offset")
    date = now()

    def run(batches):
        fs, base = shared.filesystem(source)
        writer, name, file = Writer(directory), None, None
        for b in batches:
            rows = []
            ids = zip(b.page_id.astype("object"), b.refers_to.astype("object"))
            for r, (page, to) in zip(b.itertuples(index=False), ids):
                page, to = (None if x is None or x != x else int(x) for x in (page, to))
                payload = b""
                if r.record_type == "response":
                    if r.archive != name:
                        name, file = r.archive, fs.open_input_file(f"{base}/{r.archive}")
                    file.seek(r.offset)
                    _, payload = parse(zlib.decompress(file.read(r.stored), 31))
                    if hashlib.sha1(payload).hexdigest() != r.payload_digest:
                        raise ValueError(f"{name} at {r.offset} fails its digest")
                place = writer.add(record(fresh(writer.record_id(), date, r.record_type, page, r.url, r.payload_bytes, r.payload_digest, to, r.refers_uri), payload))
                rows.append((*place, page, r.url, r.payload_bytes, r.payload_digest, r.record_type, to, r.refers_uri))
            yield _rows(rows)
        writer.close()

    ordered = ordered.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return shared.save(ordered.mapInPandas(run, HEADER), "warc-deduplicated")


def read(places: DataFrame, directory: str) -> DataFrame:
    """Read records back by place (archive, offset, stored): page_id, payload_bytes, payload_digest, record_type, refers_to,
    url and payload. For a response, length and digest are those of the payload read; for a revisit, its headers'."""

    def run(batches):
        import pandas as pd

        fs, base = shared.filesystem(directory)
        name, file = None, None
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                if r.archive != name:
                    name, file = r.archive, fs.open_input_file(f"{base}/{r.archive}")
                file.seek(r.offset)
                fields, payload = parse(zlib.decompress(file.read(r.stored), 31))
                whole = fields["WARC-Type"] == "response"
                digest = hashlib.sha1(payload).hexdigest() if whole else fields["WARC-Payload-Digest"].removeprefix("sha1:")
                page, to = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                rows.append((int(page) if page else None, len(payload) if whole else int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], int(to) if to and to != "None" else None, fields.get("WARC-Target-URI"), payload))
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return places.select("archive", "offset", "stored").mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def deduplicate(pages: DataFrame, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive a table of pages, resolve revisits, write deduplicated archives and read them back: a row for each row of pages.

    A null html is an empty payload; null ids and urls stay null; repeated rows are records of their own, of which all but
    one revisit. Columns other than the three are not read. An empty table gives an empty one. The first archives are
    deleted once the deduplicated ones are written.
    """
    spark = pages.sparkSession
    shared.bound_batches(spark)
    first, second = shared.folder(spark, "warc"), shared.folder(spark, "warc")
    headers = write_pages(pages, first, id_col, url_col, html_col)
    places = rewrite(resolve(headers, least_bytes), first, second)
    shared.discard(spark, first)
    shared.drop(headers)
    return read(places, second)
