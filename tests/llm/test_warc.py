import gzip
import hashlib
import io
import random

import pytest

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, file string, refers_to int"


class Bytes:
    def __init__(self, raw):
        self.raw = raw

    def read_at(self, n, place):
        return self.raw[place : place + n]


def make_rows():
    rng = random.Random(4)
    page = lambda n: "".join(rng.choices("<p>ab é\r\n", k=n))
    rows = [(i, f"http://x/{i}", page(rng.randint(0, 400))) for i in range(40)]
    copy = page(150)
    rows += [(i, "u", copy) for i in (90, 70, 80, 70)] + [(None, "u", copy), (60, "u", "short"), (61, "u", "short")]
    rows += [(100, None, None), (101, "a\r\nb: c", ""), (102, "u", "x" * 700_000), (103, "u", "x" * 700_000), (None, None, None)]
    rows += [(104, "u", "y" * 100), (105, "u", "y" * 100), (106, "u", "z" * 99), (107, "u", "z" * 99)]
    return rows


def expected(rows):
    least = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if i is not None and len(raw) >= 100:
            least[raw] = min(least.get(raw, i), i)
    made = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = least.get(raw) if i is not None else None
        refers = first if first is not None and first != i else None
        kind = "response" if refers is None else "revisit"
        made.append((i, len(raw), hashlib.sha256(raw).hexdigest(), kind, refers))
    return sorted(made, key=str)


@pytest.mark.parametrize("range_bytes, file_bytes", [(97, 3_000), (4 << 20, 64 << 20)])
def test_archives_give_the_pages_again(spark, tmp_path, range_bytes, file_bytes):
    rows = make_rows()
    frame = spark.createDataFrame([(*r, "d", "f", 1) for r in rows], SCHEMA)
    folder = str(tmp_path / "warc")
    manifest = warc.write_warc(frame, folder, file_bytes=file_bytes)
    got = warc.read_warc(manifest, folder, range_bytes).drop("url").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)
    assert sum(r["records"] for r in manifest.collect()) == len(rows)
    with gzip.open(next((tmp_path / "warc").glob("*.warc.gz"))) as f:
        assert f.read().startswith(b"WARC/1.1\r\nWARC-Type: ")


@pytest.mark.parametrize("step", [1, 13, 50, 100_000])
def test_every_record_belongs_to_one_range(step):
    decoy = "\x1f" + "".join(chr(x) for x in range(0x80, 0xA0))
    members = [warc.record_bytes(i, "u", (decoy * i).encode(), "d", None) for i in range(6)]
    raw = b"noise\x1f\x8b\x08" + b"".join(members)
    records = [r for a in range(0, len(raw), step) for r in warc.range_records(Bytes(raw), len(raw), a, min(a + step, len(raw)))]
    assert [int(f["X-Page-Id"]) for f, _ in records] == list(range(6))
    assert all(block.endswith((decoy * i).encode()) for i, (_, block) in enumerate(records))


def test_cut_record_is_an_error():
    good = warc.record_bytes(1, "u", b"abc", "d", None)
    raw = good + good[:-20]
    with pytest.raises(ValueError):
        list(warc.range_records(Bytes(raw), len(raw), 0, len(raw)))


def test_empty_table(spark, tmp_path):
    manifest = warc.write_warc(spark.createDataFrame([], SCHEMA), str(tmp_path / "w"))
    assert warc.read_warc(manifest, str(tmp_path / "w")).collect() == []
    assert io.BytesIO().read() == b""
