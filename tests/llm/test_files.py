import hashlib
import os
import shutil

import pytest
from pyspark.sql import functions as F

from hirelake.llm import token_files, warc
from hirelake.llm.files import open_input
from hirelake.llm.frames import FrameReader
from hirelake.llm.queries import op6_token_files, op7_warc_bundles
from hirelake.llm.tokens import public_vocabulary
from tests.llm import brute
from tests.llm.conftest import SF

PATH = public_vocabulary("byte_bpe_50k.json")


def expected_tokens(docs, end_id):
    start, out = 0, []
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        own = [*brute.ids(t), end_id]
        out.append((d, start, len(own), brute.crc(own)))
        start += len(own)
    return out


def test_token_files_of_the_whole_table(spark, documents):
    rows = [tuple(r) for r in op6_token_files(spark, SF).collect()]
    assert sorted(rows) == expected_tokens(documents, 2)


def test_token_files_edge_cases(spark, make_docs):
    docs = [(3, None), (1, ""), (2, "long " * 40000), (None, "x"), (2, "a"), (2, "a")]
    rows = token_files.read(token_files.write(make_docs(docs), PATH, 5)).collect()
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == expected_tokens(docs, 5)
    assert token_files.read(token_files.write(make_docs([]), PATH, 5)).count() == 0


def test_the_least_doc_id_is_no_null(spark, make_docs):
    docs = [(-(1 << 63), "a"), (None, "b"), (None, "b"), ((1 << 63) - 1, "c"), (0, "d"), (None, None)]
    rows = token_files.read(token_files.write(make_docs(docs), PATH, 5)).collect()
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == expected_tokens(docs, 5)


def test_a_third_of_null_ids_spans_several_files(spark, make_docs):
    docs = [(None if i % 3 == 0 else i, "equal" if i % 6 else f"text {i}") for i in range(6000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    manifest = token_files.write(make_docs(docs).repartition(8), PATH, 5)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = sorted(r["documents"] for r in manifest.collect())
    assert sum(sizes) == 6000 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_ids_that_do_not_fit_raise_or_take_four_bytes(spark, make_docs):
    docs = make_docs([(1, "a"), (2, "b c")])
    rows = token_files.read(token_files.write(docs, PATH, 70_000)).collect()
    assert sorted(map(tuple, rows)) == expected_tokens([(1, "a"), (2, "b c")], 70_000)
    with pytest.raises(Exception, match="does not fit 2 bytes"):
        token_files.write(docs, PATH, 70_000, width=2)


def test_only_the_wanted_frame_is_read(spark, make_docs, tmp_path):
    docs = [(i, f"document {i} " * 9000) for i in range(6)]
    manifest = token_files.write(make_docs(docs).coalesce(1), PATH, 5, folder=f"file://{tmp_path}/t").collect()
    path = max(manifest, key=lambda r: r["documents"])["file"]
    with open_input(path) as source:
        reader = token_files.TokenReader(source)
        wanted = int(reader.records["doc_id"][1])
        assert len(FrameReader(source)) > 1
        got = dict(reader.only([wanted]))
        assert list(got) == [wanted] and got[wanted].tolist() == [*brute.ids(docs[wanted][1]), 5]
    damaged = str(tmp_path / "damaged.zst")
    shutil.copy(path.removeprefix("file://"), damaged)
    with open(damaged, "r+b") as f:
        f.seek(30)
        f.write(b"\xff\x00\xff")
    with open(damaged, "rb") as source:
        reader = token_files.TokenReader(source)
        last = int(reader.records["doc_id"][-1])
        assert len(dict(reader.only([last]))) == 1
        with pytest.raises(Exception):
            dict(reader.only([int(reader.records["doc_id"][0])]))


def test_warc_of_the_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    rows = {r["page_id"]: r for r in op7_warc_bundles(spark, SF).collect()}
    assert len(rows) == len(pages)
    for p in pages:
        assert rows[p["page_id"]]["payload_digest"] == hashlib.sha1((p["html"] or "").encode()).hexdigest()


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {"digest": F.lit(1), "rep": F.lit(2), "number": F.lit(3)}
    )


def test_warc_edge_cases(spark):
    large, other = "é" * 600, "y" * 1000
    rows = [(1, "http://a/ b\r\nX: 1", large), (5, None, large), (3, "u", large), (7, "u", "x" * 999), (8, "u", "x" * 999)]
    rows += [(9, "u", None), (10, "u", ""), (None, "u", other), (11, "u", other), (12, "u", "a\r\n\r\nb" * 300)]
    out = {r["page_id"]: tuple(r)[1:] for r in warc.read(warc.write(pages_of(spark, rows).repartition(3))).collect()}
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()
    assert out[1] == (1200, sha(large), "revisit", 5) and out[3] == out[1]
    assert out[5] == (1200, sha(large), "response", None)
    assert out[7][2] == out[8][2] == "response" and out[9] == out[10] == (0, sha(""), "response", None)
    assert out[None] == (1000, sha(other), "revisit", 11) and out[12][0] == 1800
    assert warc.read(warc.write(pages_of(spark, []))).count() == 0
    both = [warc.with_references(pages_of(spark, rows), 1000, n).select("page_id", "rep") for n in (0, 100)]
    assert sorted(map(repr, both[0].collect())) == sorted(map(repr, both[1].collect()))


def test_repeated_page_ids_and_very_long_payloads(spark):
    large, huge = "z" * 1500, "<p>long</p>" * 600_000
    rows = [(5, "u", large), (5, "v", large), (3, "u", large), (8, "u", huge), (9, "u", huge)]
    frame = pages_of(spark, rows).withColumns({n: F.lit(n) for n in "digest rep payload_bytes record_type".split()})
    out = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read(warc.write(frame)).collect())
    assert out[:3] == [(3, "revisit", 5, 1500), (5, "response", None, 1500), (5, "response", None, 1500)]
    assert out[3:] == [(8, "revisit", 9, len(huge)), (9, "response", None, len(huge))]


def test_a_single_record_is_found_by_name(spark, tmp_path):
    rows = [(i, "u", f"<p>{i}</p>" * 4000) for i in range(30)]
    manifest = warc.write(pages_of(spark, rows).coalesce(1), folder=str(tmp_path / "w")).collect()
    with open_input(manifest[0]["file"]) as source:
        reader = warc.BundleReader(source)
        fields, http, payload, _ = warc.parse(reader.get("<urn:page:17>")[0])
    assert payload.decode() == rows[17][2] and fields["warc-type"] == "response" and http["content-length"] == str(len(payload))
    assert os.path.exists(manifest[0]["file"])
