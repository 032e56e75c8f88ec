import base64
import hashlib

import pyarrow.fs as fs
import pytest

from levyscope.llm import warc


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def pages(spark, rows, parts=4):
    return spark.createDataFrame(rows, "page_id long, url string, html string, key string, shard int").repartition(parts)


ROWS = [(i, f"http://x/{i}", f"<p>page {i % 7} é</p>" * (i % 5), "k", i) for i in range(60)]
ROWS += [(100, None, None, None, None), (101, "", "", None, None), (102, "http://a\r\nb", "x" * 300_000, None, None)]


@pytest.mark.parametrize("roll,least", [(16 << 20, 0), (700, 0), (2000, 30)])
def test_round_trip(spark, tmp_path, roll, least):
    folder = f"file://{tmp_path}/a"
    manifest = warc.write_archives(pages(spark, ROWS), folder, roll_bytes=roll, min_payload=least).collect()
    first = {}
    for i, _, html, *_ in ROWS:
        first.setdefault(html or "", i)
    out = warc.read_archives(spark, folder, with_payload=True).collect()
    assert len(out) == len(ROWS) == sum(r.records for r in manifest)
    got = {r.page_id: r for r in out}
    for i, _, html, *_ in ROWS:
        r, data = got[i], (html or "").encode()
        again = first[html or ""] != i and len(data) >= least
        assert (r.payload_bytes, r.payload_digest) == (len(data), digest(html))
        assert (r.record_type, r.refers_to) == (("revisit", first[html or ""]) if again else ("response", None))
        assert bytes(r.payload) == (b"" if again else data)
    names = sorted(r.name for r in manifest)
    files = [f for f in fs.LocalFileSystem().get_file_info(fs.FileSelector(f"{tmp_path}/a")) if f.base_name.endswith(".gz")]
    assert sorted(f.base_name for f in files) == names
    for r in manifest:
        data = (tmp_path / "a" / r.name).read_bytes()
        assert len(data) == r.bytes and hashlib.sha256(data).hexdigest() == r.sha256
    assert roll > 1000 or len(names) > 8


def test_same_input_gives_the_same_bytes(spark, tmp_path):
    sums = []
    for k in range(2):
        manifest = warc.write_archives(pages(spark, ROWS), f"file://{tmp_path}/{k}", roll_bytes=900).collect()
        sums.append(sorted((r.name, r.sha256) for r in manifest))
    assert sums[0] == sums[1]


def test_repeated_rows_null_ids_and_empty(spark, tmp_path):
    rows = [(1, "u", "same", None, None), (1, "u", "same", None, None), (None, "v", "same", None, None), (2, "w", "same", None, None)]
    warc.write_archives(pages(spark, rows), f"file://{tmp_path}/n")
    out = [(r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(spark, f"file://{tmp_path}/n").collect()]
    assert sorted(out, key=str) == [(1, "response", None), (1, "revisit", 1), (2, "revisit", 1), (None, "response", None)]
    warc.write_archives(pages(spark, [], 1), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0


def test_only_what_the_manifest_names_is_read(spark, tmp_path):
    folder = f"file://{tmp_path}/g"
    manifest = warc.write_archives(pages(spark, ROWS), folder, roll_bytes=700).collect()
    here = tmp_path / "g"
    assert not (here / "_temporary").exists()
    stray = (here / manifest[0].name).read_bytes()
    (here / "pages-99999-00000.warc.gz").write_bytes(stray)  # of no manifest
    assert warc.read_archives(spark, folder).count() == len(ROWS)
    name = here / manifest[1].name
    whole = name.read_bytes()
    name.write_bytes(whole[:-9])
    with pytest.raises(Exception, match="not what the manifest says"):
        warc.read_archives(spark, folder).count()
    name.unlink()
    with pytest.raises(Exception, match="(?i)no such file|not found|cannot find"):
        warc.read_archives(spark, folder).count()
    name.write_bytes(whole)
    (here / "_manifest.json").unlink()  # a writer that died before the end
    with pytest.raises(FileNotFoundError):
        warc.read_archives(spark, folder)


def test_null_and_repeated_ids_spread(spark, tmp_path):
    rows = [(None if i % 2 else 7, f"u{i}", f"page {i}", None, None) for i in range(400)]
    manifest = warc.write_archives(pages(spark, rows, 8), f"file://{tmp_path}/s").collect()
    assert len(manifest) >= 6 and max(r.records for r in manifest) < 200
    out = warc.read_archives(spark, f"file://{tmp_path}/s").collect()
    assert len(out) == 400 and {r.record_type for r in out} == {"response"}
