import gzip

import pytest

from wordkiln.llm import warc as W
from wordkiln.llm.common import new_path

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def files(spark):
    path = new_path(spark, "warc-test")
    rows = [(i, f"https://{'a' if i % 2 else 'b'}.example/{i}", f"<p>page {i} — é</p>" + "x" * (i * 997 % 60_000)) for i in range(60)]
    W.registered(spark)
    W.page_records(spark.createDataFrame(rows, PAGES).repartition(3)).write.format("warc").mode("append").save(path)
    return path, rows



def test_round_trip_matches_the_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html")
    got = W.round_trip(pages, new_path(spark, "warc-pages"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pages.collect()))


def test_filters_reach_the_headers(spark, files):
    path, rows = files
    r = spark.read.format("warc").load(path)
    assert r.count() == 120
    f = r.filter("warc_type = 'response' and target_uri like 'https://a%' and content_length > 5000")
    want = [x for x in rows if x[1].startswith("https://a") and len((W._EMPTY_HTTP + x[2]).encode()) > 5000]
    assert f.count() == len(want)
    reader = W.WarcReader({"path": path}, path)
    left = list(reader.pushFilters([W.EqualTo(("warc_type",), "response"), W.EqualTo(("headers", "x"), "1"), W.In(("target_uri",), ("u", None))]))
    assert len(left) == 2 and len(reader.filters) == 1


def test_unwanted_payloads_are_not_decoded(files, monkeypatch):
    path, _ = files
    system, base = W._system(path)
    name = next(x.path for x in system.get_file_info(W.pafs.FileSelector(base)) if x.path.endswith(".gz"))
    size = system.get_file_info(name).size
    fed = []
    real = W.zlib.decompressobj

    def counting(bits):
        d = real(bits)

        class Counting:
            eof = property(lambda self: d.eof)
            unused_data = property(lambda self: d.unused_data)
            unconsumed_tail = property(lambda self: d.unconsumed_tail)

            def decompress(self, data, most=0):
                out = d.decompress(data, most)
                fed.append(len(out))
                return out

        return Counting()

    monkeypatch.setattr(W.zlib, "decompressobj", counting)
    with system.open_input_file(name) as f:
        n = len(list(W.records(f, size, True, [W.EqualTo(("warc_type",), "nothing")], True)))
    assert n == 0 and max(fed) <= W.HEAD


@pytest.mark.parametrize("compressed", [True, False])
def test_records_of_other_writers(tmp_path, compressed):
    """Members without a length in their extra field, headers on continued lines, an end without a blank line."""
    records = [b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n", b"WARC/1.0\r\nwarc-type: response\r\nX-Long: one\r\n two\r\nContent-Length: 3\r\n\r\n\r\n\r\r\n\r\n"]
    raw = b"".join(gzip.compress(r) for r in records) if compressed else b"".join(records)
    p = tmp_path / ("x.warc.gz" if compressed else "x.warc")
    p.write_bytes(raw)
    with open(p, "rb") as f:
        got = list(W.records(f, len(raw), compressed, [], True))
    assert [g[2] for g in got] == [b"abcde", b"\r\n\r"] and got[1][1]["x-long"] == "one two"


def test_planning():
    sizes = [("c", 5), ("a", 60), ("b", 50), ("d", 500), ("e", 1)]
    assert [[n for n, _ in x.files] for x in W.plan(sizes, 100)] == [["a"], ["b", "c"], ["d"], ["e"]]


def test_bad_file_says_where(tmp_path):
    p = tmp_path / "bad.warc"
    p.write_bytes(b"HTTP/1.1 200 OK\r\n\r\n")
    with open(p, "rb") as f, pytest.raises(ValueError, match="no record"):
        list(W.records(f, 19, False, [], True))


def test_awkward(spark):
    rows = [(None, None, None), (1, "u\r\nv", ""), (1, "u\r\nv", ""), (2, None, "long " * 100_000), (3, "x", "WARC/1.0\r\n\r\nWARC-Type: response\r\n\r\n")]
    d = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as r", "2 as k", "'x' as payload")
    got = sorted((tuple(r) for r in W.round_trip(d, new_path(spark, "warc-awkward")).collect()), key=repr)
    assert got == sorted([(None, None, ""), (1, "u v", ""), (1, "u v", ""), (2, None, "long " * 100_000), (3, "x", rows[4][2])], key=repr)
    assert W.round_trip(spark.createDataFrame([], PAGES), new_path(spark, "warc-empty")).count() == 0


def _response(body: bytes, length=None) -> bytes:
    return b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: " + str(len(body) if length is None else length).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _member(record: bytes, told: int) -> bytes:
    """A gzip member whose extra field tells a length, right or wrong."""
    import zlib

    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + (8).to_bytes(2, "little") + b"sl" + (4).to_bytes(2, "little") + told.to_bytes(4, "little") + body + zlib.crc32(record).to_bytes(4, "little") + len(record).to_bytes(4, "little")


@pytest.mark.parametrize("length", ["-80", "-1", "x", "9999", "+3", ""])
def test_broken_lengths_are_passed_over(tmp_path, length):
    raw = _response(b"one") + _response(b"two", length) + _response(b"three")
    p = tmp_path / "x.warc"
    p.write_bytes(raw)
    with open(p, "rb") as f:
        got = list(W.records(f, len(raw), False, [], True, permissive=True))
        assert [g[2] for g in got] == [b"one", None, b"three"] and got[1][3] and got[1][1] == {}
        assert [g[2] for g in W.records(f, len(raw), False, [W.EqualTo(("warc_type",), "response")], True, permissive=True)] == [b"one", b"three"]
        with pytest.raises(ValueError):
            list(W.records(f, len(raw), False, [], True))


@pytest.mark.parametrize("told", [0, 3])
def test_a_members_length_too_short_isnt_believed(tmp_path, told):
    raw = _member(_response(b"one"), told) + _member(_response(b"two"), told)
    p = tmp_path / "x.warc.gz"
    p.write_bytes(raw)
    with open(p, "rb") as f:
        assert [g[2] for g in W.records(f, len(raw), True, [], True)] == [b"one", b"two"]


def test_cut_and_damaged_files(spark, tmp_path):
    good = [gzip.compress(_response(b"HTTP/1.1 200 OK\r\n\r\n" + x)) for x in (b"one", b"caf\xe9", "caf\u00e9".encode())]
    (tmp_path / "a.warc.gz").write_bytes(good[0] + b"\x1f\x8b\x08 damaged" + good[1])
    (tmp_path / "b.warc.gz").write_bytes(good[2] + good[0][:-12])
    (tmp_path / "c.warc").write_bytes(_response(b"four") + _response(b"five")[:-6])
    read = W.registered(spark).read.format("warc")
    rows = read.load(f"file://{tmp_path}").select(W.http_body(W.F.col("payload")).alias("t"), "error").collect()
    assert sorted(r.t for r in rows if r.error is None) == ["caf\u00e9", "caf\u00e9", "four", "one"]
    assert sum(r.error is not None and r.t is None for r in rows) == 3
    assert W.responses(spark, f"file://{tmp_path}").count() == 4
    with pytest.raises(Exception, match="ends early|no record|incorrect|error"):
        read.option("mode", "failfast").load(f"file://{tmp_path}").collect()
