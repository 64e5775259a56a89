import gzip
import hashlib

from graphloom.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, first string")


def test_copies_become_revisits(spark, tmp_path):
    big, other = "<p>" + "x" * 200, "<p>" + "é" * 60
    rows = [(5, "http://a/ b\r\nX: y", big), (3, "http://b", big), (9, None, big), (4, "u", "tiny"), (6, "u", "tiny"), (7, "u", None), (8, "u", other), (8, "u", other), (None, "u", other), (None, "u", "z" * 100)]
    to = f"file://{tmp_path}/w"
    got = warc.archive(pages(spark, [(*r, "x", "x") for r in rows]), to).collect()
    assert len(got) == len(rows)
    s = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    by = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got), key=str)
    want = [(5, "revisit", 3, 203, s(big)), (3, "response", None, 203, s(big)), (9, "revisit", 3, 203, s(big)), (4, "response", None, 4, s("tiny")), (6, "response", None, 4, s("tiny")), (7, "response", None, 0, s("")), (8, "response", None, 123, s(other)), (8, "revisit", 8, 123, s(other)), (None, "revisit", 8, 123, s(other)), (None, "response", None, 100, s("z" * 100))]
    assert by == sorted(want, key=str)
    files = list((tmp_path / "w").glob("part-*.warc.gz"))
    assert files and not list((tmp_path / "w").glob("_*"))
    n = 0
    for f in files:
        for head, block in warc.records(gzip.open(f)):
            n += 1
            assert "\r" not in head["warc-target-uri"] and head["warc-type"] in ("response", "revisit") and block.startswith(b"HTTP/1.1 200 OK\r\n")
    assert n == len(rows)


def test_files_roll_and_empty_tables(spark, tmp_path):
    to = f"file://{tmp_path}/w"
    rows = [(i, "u", "q" * 500 + str(i), "", "") for i in range(50)]
    files = warc.write(pages(spark, rows).coalesce(1), to, roll=1000)
    assert files.count() > 5
    assert warc.resolve(files, to).count() == 50
    to = f"file://{tmp_path}/e"
    assert warc.archive(pages(spark, []), to).count() == 0
