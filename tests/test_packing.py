import random
import re
import tracemalloc
import unicodedata

import pyarrow as pa

from textloom.functions import plain
from textloom.functions.packs import Pack
from textloom.operators import corpus


def comparable_in_full(text):
    folded = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^a-z0-9\s]", " ", folded.lower()).split())


def noise_in_full(line, pack=Pack()):
    """The rule with each pattern over the whole line."""
    line = line.strip()
    if not line:
        return False
    p = plain
    if any(x.search(line) for x in (p.BROKEN_URL, p.URL, p.EMAIL, p.DOI, p.PHONE, p.ADMIN)) or p.LISTED.match(line) and p.REFERENCE.search(line):
        return True
    folded = comparable_in_full(line)
    return folded in pack.drop_headings or bool(p.AUTHOR.match(line)) and len(line.split()) > 5 and not any(term in folded for term in pack.terms)


def without_addresses_in_full(text):
    p = plain
    text = re.sub("\r\n|\r| | ", "\n", text)
    for x in (re.compile("[﻿​]"), p.CONTROL, p.BROKEN_URL, p.URL, p.DOI, p.EMAIL):
        text = x.sub("", text)
    return re.sub(r"[ \t]+", " ", re.sub("[•◦▪·]", "- ", p.HYPHEN.sub(r"\1\2", text)))


def test_rules_are_those_of_the_whole_patterns():
    rng = random.Random(5)
    bits = ["tel", "TELÉFONO", "fax", "lada ſin coſto", "İSBN", "ıssn", "copyrıght", "55 12 34", "(55) 1234-5678", "12-34-56", "2013-2015", "٣٤٥٦٧٨", "10.1234/ab", "a@b.c", "www . x", "http : / / y", "httpſ://z"]
    bits += ["HTTP://a b", "•", "·", "\t", "  ", "\n", "\r\n", " ", "﻿", "\x00", "\x1c", "été", "Smith, John of the big house here", "pag. 3", "ﬁn", "x-\ny", "_", "parto", "3. doi", "ﬁnancıamiento", "edición", "e-mail", "½", "hotel"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", " ", "", "\n", ", "]) for _ in range(rng.randint(1, 40 if i % 3 else 6))) for i in range(4000)]
    texts += [h.upper() + "!" * n for h in Pack().drop_headings for n in (0, 1, 500)]
    for t in texts:
        assert plain.is_noise(t) == noise_in_full(t), t
        assert plain.without_addresses(t) == without_addresses_in_full(t), t
        assert plain.words(t) == len(re.findall(r"\w+", t)) and plain.comparable(t) == comparable_in_full(t), t


def test_a_task_holds_a_batch_and_not_the_group():
    line = " ".join(f"w{c}rd" for c in "abcdefghijklmnopqrst")

    def peak(pages):
        """Bytes held at most while a source of so many pages is packed, a page a batch."""
        names, n = ["source", "section", "page", "text"], 0
        batches = (pa.RecordBatch.from_arrays([pa.array(["s"]), pa.array([""]), pa.array([i + 1]), pa.array(["\n".join([line] * 100)])], names) for i in range(pages))
        tracemalloc.start()
        for batch in corpus.packed(batches, 1200, 1200, 100, Pack(), at_once=5):
            n += batch.num_rows
            assert batch.column("chunk")[-1].as_py() == n - 1
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n >= pages * 2
        return most

    peak(2)
    assert peak(100) < 1.3 * peak(10)


def test_groups_meet_in_a_task_but_not_in_a_frame(spark):
    rows = [(f"s{i % 7}" if i % 7 else None, "" if i % 2 else "x", i, "one two three\n\nfour") for i in range(210)]
    pages = spark.createDataFrame(rows, "source string, section string, page int, text string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        df = corpus.pack_chunks(pages, target=20)
        assert "InPandas" not in df._jdf.queryExecution().executedPlan().toString()
        got = df.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for source, section in {(r[0], r[1]) for r in rows}:
        chunks = sorted((r.chunk, r.pages) for r in got if (r.source, r.section) == (source, section))
        of = [p for _, pages in chunks for p in pages]
        assert [c for c, _ in chunks] == list(range(len(chunks))) and of == sorted(of) and set(of) == {r[2] for r in rows if (r[0], r[1]) == (source, section) and r[2]}
