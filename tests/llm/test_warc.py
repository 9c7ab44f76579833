import gzip
import hashlib
import io
import zlib

import pytest

from gridweave.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, bytes int"
LONG = "<p>é</p>" * 40


def written(spark, tmp_path, rows, schema=SCHEMA):
    warc.write_archives(spark.createDataFrame(rows, schema).repartition(3), str(tmp_path / "w"))
    return warc.read_archives(spark, str(tmp_path / "w"), keep=True)


def brute(rows, least=100):
    """(page_id, bytes, digest, type, refers_to) of rows (page_id, url, html)."""
    first, out = {}, []
    for p, u, h in sorted(((r[0], r[1], r[2] or "") for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        b = h.encode()
        revisit = len(b) >= least and b in first
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[b] if revisit else None))
        first.setdefault(b, p)
    return sorted(out, key=str)


def test_against_brute_force_with_edges(spark, tmp_path):
    rows = [(5, "http://a/ü b?q=\r\nx", LONG), (3, "http://b/", LONG), (3, "http://a/", LONG), (9, None, LONG), (None, "u", LONG), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", "x" * 3_000_000)]
    rows += [(8, "u", "y" * 100)] * 5 + [(10, "u", "y" * 99)] * 2
    d = written(spark, tmp_path, [(*r, "clash", 1) for r in rows])
    got = d.collect()
    assert all(r.problem is None for r in got)
    found = sorted((tuple(r) for r in warc.page_records(d, "bigint").collect()), key=str)
    assert found == brute(rows)
    texts = {int(r.page): r.payload.decode() for r in got if r.record_type == "response" and r.page}
    assert texts[7] == "x" * 3_000_000 and texts[3] == LONG and texts[4] == "short"
    assert {r.url for r in got if r.page == "5"} == {"http://a/%C3%BC%20b?q=%0D%0Ax"}


def test_a_member_is_a_record_and_can_be_read_alone(spark, tmp_path):
    d = written(spark, tmp_path, [(i, f"http://h/{i}", LONG + str(i), "", 0) for i in range(20)])
    for r in d.collect():
        data = (tmp_path / "w" / "data" / r.file).read_bytes()[r.offset : r.offset + r.member_bytes]
        text = gzip.decompress(data)
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith((LONG + r.page).encode() + b"\r\n\r\n")


def test_copies_beyond_a_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 3)
    rows = [(2, "u", LONG)] * 11 + [(4, "u", LONG)]
    d = written(spark, tmp_path, [(*r, "", 0) for r in rows])
    assert sorted((tuple(r) for r in warc.page_records(d, "bigint").collect()), key=str) == brute(rows)


def test_empty_table_and_files_of_lost_attempts(spark, tmp_path):
    assert written(spark, tmp_path / "e", []).count() == 0
    d = written(spark, tmp_path, [(1, "u", "a", "", 0)])
    (tmp_path / "w" / "data" / "part-000000-999-0.warc.gz").write_bytes(b"left behind")
    assert [r.page for r in d.collect()] == ["1"]


def read(data, block=7):
    return [(used, one.headers, problem) for _, used, one, problem in warc.read_records(io.BytesIO(data), False, block)]


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 18])
def test_pieces_of_any_size(block):
    payload = b"<html>" + bytes(range(256)) * 50
    member = warc.record(1, "http://a/", payload, len(payload), hashlib.sha256(payload).hexdigest(), "response", None)
    out = list(warc.read_records(io.BytesIO(member * 3), True, block))
    assert [(o, u, p) for o, u, _, p in out] == [(i * len(member), len(member), None) for i in range(3)]
    assert all(b"".join(r.pieces) == payload for _, _, r, _ in out)


def test_damage_is_named():
    digest = hashlib.sha256(b"abc").hexdigest()
    good = warc.record(1, None, b"abc", 3, digest, "response", None)
    assert [p for *_, p in read(warc.record(1, None, b"abd", 3, digest, "response", None) + good)] == ["warc-payload-digest differs", None]
    plain = gzip.decompress(good)
    again = lambda text: zlib.compress(text, wbits=31)
    assert [p for *_, p in read(again(plain[:-5]) + good)][0] == "1 bytes of the block are missing"
    assert [p for *_, p in read(again(plain + b"x") + good)] == ["the record does not end with two line ends", None]
    assert [p for *_, p in read(again(b"no headers here") + good)] == ["no headers", None]
    assert "malformed" in read(again(plain.replace(b"Content-Length: 8", b"Content-Len: 8")) + good)[0][2]
    cut = read(good + good[:-10])
    assert cut[0][2] is None and cut[1][2].startswith("damaged")
    assert read(good[:40] + b"\xff" * 30 + good[70:])[-1][2].startswith("damaged")
    assert read(b"not gzip")[0][2].startswith("damaged")


def test_digests_in_base_32():
    import base64

    sha1 = hashlib.sha1(b"abc").digest()
    block = b"abc"
    text = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Block-Digest: sha1:{base64.b32encode(sha1).decode()}\r\nContent-Type: text/plain\r\nContent-Length: 3\r\n\r\n".encode() + block + b"\r\n\r\n"
    assert read(zlib.compress(text, wbits=31))[0][2] is None
