import gzip
import hashlib
import io
import random
from pathlib import Path

import pytest
from kinsheet.llm import queries, warc

PAGES = "page_id long, url string, html string, digest string, size int, keeper long, payload string"


def expected(rows):
    best = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and i is not None:
            best[data] = max(i, best.get(data, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        keeper = best.get(data, i)
        kind = ("response", None) if keeper == i else ("revisit", keeper)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), *kind))
    return sorted(out, key=str)


def page_rows():
    rng = random.Random(4)
    long = ["".join(rng.choices("abc\x1f\u00e9 <p>", k=3000)) for _ in range(3)]
    noise = "".join(chr(rng.randint(1, 0x7FF)) for _ in range(200_000))
    rows = [(i, f"http://x/{i}", long[i % 3]) for i in range(12)]
    rows += [(20, None, None), (21, "http://x/a b\r\nWARC-Type: evil", ""), (22, "é", "short"), (23, "é", "short")]
    rows += [(30, "u", noise), (31, "u", noise), (31, "u", noise), (None, "u", long[0]), (None, "u", None)]
    rows += [(40, "u", "\x1f\u008b\x08" + "WARC/1.1\r\n" * 200)]
    return rows


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "a")
    rows = [(*r, "d", 1, 2, "p") for r in page_rows()]
    warc.write_archive(spark.createDataFrame(rows, PAGES).repartition(3), path)
    return path


@pytest.mark.parametrize("split", [100, 4097, 1 << 20])
def test_round_trip_by_ranges(spark, archive, split):
    found = warc.read_archive(spark, archive, split).collect()
    assert sorted(map(tuple, found), key=str) == expected(page_rows())


def test_payloads(spark, archive):
    found = warc.read_archive(spark, archive, payloads=True).where("record_type = 'response'").collect()
    texts = {r[0]: (r[2] or "").encode() for r in page_rows()}
    assert all(bytes(r["payload"]) == texts[r["page_id"]] for r in found if r["page_id"] is not None)


def test_files_are_plain_gzip(archive):
    for file in Path(archive).glob("part-*"):
        data = gzip.decompress(file.read_bytes())
        assert data.startswith(b"WARC/1.1\r\n")


def test_long_members_end_in_an_empty_one():
    data = bytes(17 << 20)
    member = warc._gzip(data)
    assert member[-1] != 0 and gzip.decompress(member + warc.EMPTY_MEMBER) == data
    assert warc.EMPTY_MEMBER[-1] == 0


def test_scan_is_exact_at_every_range():
    rng = random.Random(9)
    records = [warc.record(i, "u", rng.randbytes(rng.randint(0, 300)), 0, "", None) for i in range(30)]
    data = b"".join(map(warc._gzip, records))
    noise = b"\x1f\x8b\x08\x00" + rng.randbytes(50)
    data = noise + data + noise
    for split in (1, 17, 1000):
        found = []
        for start in range(0, len(data), split):
            found += warc.scan(io.BytesIO(data), start, start + split, len(data))
        assert found == records


def test_damage_is_seen(spark, tmp_path):
    path = tmp_path / "d"
    path.mkdir()
    good = warc.record(1, "u", b"payload", 7, hashlib.sha1(b"payload").hexdigest(), None)
    (path / "part-0").write_bytes(warc._gzip(good.replace(b"payload", b"PAYLOAD", 1)))
    with pytest.raises(Exception, match="damaged record"):
        warc.read_archive(spark, str(path)).collect()


def test_query_and_no_rows(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    assert sorted(map(tuple, queries.op9_warc(spark, sf_dir).collect()), key=str) == expected(rows)
    path = str(tmp_path / "none")
    warc.write_archive(pages.limit(0), path)
    assert warc.read_archive(spark, path).count() == 0
