import hashlib
import io
import random
import struct
import zipfile

import pyarrow as pa
import pytest

from alertweave.llm import warc


class Source:
    """What the reader needs of a file; counts the bytes it is asked for."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        self.read += n
        return self.data[at : at + n]


def package(rows):
    sink = io.BytesIO()
    warc.write_package(sink, iter(rows))
    return sink.getvalue()


def row(i, text, revisit=False, to=None):
    data = text.encode()
    return i, f"http://a.example/{i}", data, hashlib.sha256(data).hexdigest(), to, revisit


def test_package_is_a_plain_zip_and_its_ranges_are_records():
    rows = [row(1, "é" * 200), row(2, ""), row(3, "é" * 200, True, 1), row(None, "x\r\n\r\ny")]
    data = package(rows)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.namelist() == [warc.ARCHIVE, warc.INDEX] and z.testzip() is None
        archive = z.read(warc.ARCHIVE)
    places = warc.read_index(Source(data))
    assert len(places) == 4
    got = [warc.parse_record(warc.zlib.decompress(data[o : o + n], 31)) for o, n in places]
    assert [g["page_id"] for g in got] == [1, 2, 3, None]
    assert [g["payload"] for g in got] == [rows[0][2], b"", None, rows[3][2]]
    assert got[2]["refers_to"] == 1 and got[2]["declared_bytes"] == 400
    assert archive == data[places[0][0] : places[-1][0] + places[-1][1]]


def test_zip64_directory():
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        for i in range(65_600):  # more entries than the short form can count
            z.writestr(f"m{i}", b"x")
    found = warc.directory(Source(sink.getvalue()))
    assert len(found) == 65_600 and found["m65599"].size == 1
    source = Source(sink.getvalue())
    at = warc.data_offset(source, found["m65599"])
    assert source.read_at(1, at) == b"x"


def test_zip64_fields_of_an_entry():
    extra = struct.pack("<HH", 9, 2) + b"ab" + struct.pack("<HHQQQ", 1, 24, 7, 8, 9)
    full = 0xFFFFFFFF
    assert warc._wide(extra, full, full, full) == (8, 9)
    assert warc._wide(struct.pack("<HHQ", 1, 8, 9), 5, 5, full) == (5, 9)


def test_what_is_no_package_or_not_stored_is_refused():
    with pytest.raises(ValueError):
        warc.directory(Source(b"no zip at all"))
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.ARCHIVE, b"x" * 1000)
    source = Source(sink.getvalue())
    with pytest.raises(ValueError, match="compressed"):
        warc.data_offset(source, warc.directory(source)[warc.ARCHIVE])


def test_reading_one_record_reads_little():
    rng = random.Random(1)
    source = Source(package([row(i, rng.randbytes(4000).hex()) for i in range(300)]))
    places = warc.read_index(source)
    source.read_at(places[7][1], places[7][0])
    assert source.read < len(source.data) / 2


def test_blocks_are_runs_of_neighbours():
    assert list(warc.blocks([(0, 5), (5, 5), (20, 5)])) == [[(0, 5), (5, 5)], [(20, 5)]]
    many = list(warc.blocks([(i << 20, 1 << 20) for i in range(7)]))
    assert [len(b) for b in many] == [2, 2, 2, 1] and list(warc.blocks([])) == []


def brute(rows):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(i, first.get(data, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = data in first and i != first[data]
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response",
                    first[data] if revisit else None))
    return sorted(out, key=repr)


ROWS = [
    (4, "http://x.example/a", "e" * 100), (2, "http://x.example/b", "e" * 100), (9, None, "e" * 100), (3, "u", "e" * 99),
    (5, "u", "e" * 99), (6, "bad\r\nurl: é", None), (7, "u", ""), (8, "http://[", "é" * 400_000), (2, "u", "e" * 100),
    (None, "u", "e" * 100), (10, "u", "a\r\n\r\nWARC/1.1\r\n"),
]


def pages(corpus, rows):
    return corpus.createDataFrame([(*r, "z", "z") for r in rows], "page_id bigint, url string, html string, digest string, payload string")


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_round_trip(corpus):
    assert result(warc.round_trip(pages(corpus, ROWS))) == brute(ROWS)
    assert warc.round_trip(pages(corpus, [])).count() == 0


def test_round_trip_with_many_repeats_and_small_packages(corpus, monkeypatch):
    monkeypatch.setattr(warc, "SHARED_ROWS", 0)  # joins by shuffle
    rows = [(i, "u", f"{i % 7}" * 150) for i in range(120)]
    assert result(warc.round_trip(pages(corpus, rows))) == brute(rows)


def test_a_full_package_is_followed_by_another(monkeypatch):
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 1)
    rows = iter([row(1, "a"), row(2, "b")])
    for i in (1, 2):
        sink = pa.BufferOutputStream()
        assert warc.write_package(sink, rows) == 1
        places = warc.read_index(Source(sink.getvalue().to_pybytes()))
        assert len(places) == 1 and i
