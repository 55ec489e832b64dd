"""Line deduplication and the WARC archive against plain Python, and on odd rows."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from weirworks.llm import linededup, warc

STRIP = " \t\n\x0b\x0c\r"


def brute_lines(rows):
    docs = [(d, (t or "").split("\n")) for d, t in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = defaultdict(set)
    for d, lines in docs:
        for line in lines:
            key = line.strip(STRIP).translate(lower)
            if len(key) >= 20 and d is not None:
                holders[key].add(d)
    out = []
    for d, lines in docs:
        keys = [line.strip(STRIP).translate(lower) for line in lines]
        kept = [x for x, k in zip(lines, keys) if not (d is not None and len(holders.get(k, ())) >= 3 and d != max(holders[k]))]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_match_brute_force(spark):
    common, accented = "A line that many documents share", "Élan vital, a line with an accent É"
    rows = [(i, f"Own line of document number {i}\n{common if i % 2 else common.upper()}  \r\n\n{common}\nshort") for i in range(1, 7)]
    rows += [(10, accented), (11, accented.lower()), (12, accented), (13, None), (14, ""), (15, "\n\n"), (16, common), (16, f"{common}\n{common}"), (None, common)]
    rows += [(20, "x" * 30_000 + "\n" + "y" * 25), (21, "\x0b" + "y" * 25 + "\t"), (22, "y" * 25 + "\n" + "exactly nineteen ch"), (23, "exactly nineteen ch")]
    docs = spark.createDataFrame([(*r, "h", "k", 1) for r in rows], "doc_id long, text string, hash string, hashes string, keeper long")
    got = sorted(map(tuple, linededup.line_digest(docs).collect()), key=str)
    assert got == brute_lines(rows)
    cleaned = linededup.dedup_lines(docs)
    assert cleaned.columns == docs.columns
    digests = sorted((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in cleaned.select("doc_id", "text").where("doc_id IS NOT NULL").collect())
    assert digests == sorted((d, h) for d, _, _, h in brute_lines(rows) if d is not None)
    assert cleaned.where("text IS NULL").count() == 1
    assert linededup.line_digest(docs.limit(0)).count() == 0


def test_batches_meet_runs_by_merging(spark, tmp_path):
    runs = linededup.LineRuns(spark, str(tmp_path / "runs"), fanout=2)
    batches = [[(bytes([k]), 10 * batch + k) for k in range(batch, 5 + batch)] for batch in range(5)]
    for batch in batches:
        runs.add(spark.createDataFrame(batch, "hash binary, doc_id long"))
    assert {level: len(names) for level, names in runs.levels.items() if names} == {0: 1, 2: 1}
    # A key is new once: runs of new keys share none; all later sightings are updates.
    held = [bytes(r.hash) for name in runs._names(runs.levels) for r in spark.table(name).collect()]
    assert sorted(held) == [bytes([k]) for k in range(9)]
    assert sum(r.n_docs for name in runs._names(runs.updates) for r in spark.table(name).collect()) == 25 - 9
    want = {k: [10 * b + k for b in range(5) if b <= k < 5 + b] for k in range(9)}
    for least in (1, 3, 5):
        assert {(bytes(r.hash)[0], r.keeper) for r in runs.frequent(least).collect()} == {(k, max(v)) for k, v in want.items() if len(v) >= least}
    # Neither side of an anti-join with a run is shuffled.
    batch = spark.table(runs._write(linededup._merged(spark.createDataFrame([(b"x", 1, 1)], "hash binary, n_docs long, keeper long")).repartition(runs.buckets, "hash")))
    plan = runs.new_keys(batch)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Exchange" not in plan
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_a_text_of_many_lost_lines(spark):
    lines = [f"a line of a log, number {i:06d}" for i in range(30_000)]
    rows = [(i, "\n".join(lines)) for i in (1, 2, 3)] + [(4, "é" * 19), (5, "é" * 19), (6, "é" * 19), (7, "é" * 20), (8, "É" * 20), (9, "é" * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, linededup.line_digest(docs).collect()), key=str) == brute_lines(rows)
    clash = docs.select("doc_id", "text", F.lit(1).alias("_lost"), F.lit("h").alias("hashes"))
    assert {r.doc_id: len(r.text) for r in linededup.dedup_lines(clash).collect()}[1] == 0


def pages():
    big, other = "<p>" + "é" * 600 + "</p>", "<p>" + "b" * 1200
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (7, None, big), (3, "http://a/3\r\nX: y", other), (4, "http://a/4", "small"), (5, "u", "small")]
    return rows + [(6, "u", None), (8, "u", ""), (9, "u", "x" * 999), (10, "u", "x" * 999), (11, "u", "z" * 1000), (12, "u", "z" * 1000), (12, "u", "z" * 1000), (None, "u", "q" * 2000)]


def test_archive_reads_back(spark, tmp_path):
    docs = spark.createDataFrame([(*r, "s", "h", b"p") for r in pages()], "page_id long, url string, html string, sha256 string, header string, payload binary")
    path = str(tmp_path / "archive")
    warc.write_archive(docs, path)
    records = warc.read_archive(spark, path)
    got = sorted(map(tuple, warc.parsed(records).collect()), key=str)
    wanted = []
    for page_id, _, html in pages():
        payload = (html or "").encode()
        same = [p for p, _, h in pages() if (h or "").encode() == payload and p is not None]
        revisit = len(payload) >= 1000 and bool(same) and page_id != max(same)
        wanted.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert got == sorted(wanted, key=str)
    assert spark.read.parquet(f"{path}/payloads").count() == len({(h or "") for _, _, h in pages()})
    headers = [bytes(r.header).decode() for r in records.collect()]
    assert all(h.count("\r\n\r\n") == 2 and "\nX: y" not in h for h in headers)


def test_exported_files_are_warc(spark, tmp_path):
    docs = spark.createDataFrame(pages(), "page_id long, url string, html string")
    warc.write_archive(docs, str(tmp_path / "archive"))
    warc.export_warc(warc.read_archive(spark, str(tmp_path / "archive")), str(tmp_path / "files"))
    found = 0
    for file in (tmp_path / "files").glob("part-*"):
        data = file.read_bytes()
        while data:
            head, rest = data.split(b"\r\n\r\n", 1)
            size = int(re.search(rb"\nContent-Length: (\d+)", head)[1])
            assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
            data, found = rest[size + 4 :], found + 1
    assert found == len(pages())
    warc.write_archive(docs.limit(0), str(tmp_path / "none"))
    assert warc.parsed(warc.read_archive(spark, str(tmp_path / "none"))).count() == 0


def test_urls_cannot_start_header_fields(spark, tmp_path):
    breaks = ["\r\n", "\n", "\r", "\x85", "\u2028", "\u2029", "\x0b", "\x0c", "\x1e"]
    bad = [f"http://h/{b}WARC-Refers-To: <urn:weirworks:page:77>{b}WARC-Payload-Digest: sha1:0{b}WARC-Type: revisit{b}{b}x" for b in breaks]
    docs = spark.createDataFrame([(i, url, "page " * 300 + str(i)) for i, url in enumerate(bad)], "page_id long, url string, html string")
    warc.write_archive(docs, str(tmp_path / "a"))
    rows = warc.parsed(warc.read_archive(spark, str(tmp_path / "a"))).collect()
    assert sorted(r.page_id for r in rows) == list(range(len(bad)))
    assert {(r.record_type, r.refers_to) for r in rows} == {("response", None)}
