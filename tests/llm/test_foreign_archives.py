"""Archives that others wrote: digests of any spelling, folded headers, odd lengths, damage anywhere."""

import base64
import gzip
import hashlib
import random

import pytest

from quarrykit.llm import files, warc

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
BODY = b"<p>some words</p>" * 20


def _record(block, *lines):
    head = "".join(f"{x}\r\n" for x in ("WARC/1.0", *lines, f"Content-Length: {len(block)}"))
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


RESPONSE = ("WARC-Type: response", "Content-Type: application/http; msgtype=response", "WARC-Target-URI: http://h/")
CASES = {
    "hex block digest": _record(HTTP + BODY, *RESPONSE, f"WARC-Block-Digest: sha1:{hashlib.sha1(HTTP + BODY).hexdigest()}"),
    "lower-case base32": _record(HTTP + BODY, *RESPONSE, f"WARC-Block-Digest: sha1:{_b32(HTTP + BODY).lower()}"),
    "sha256 payload digest": _record(HTTP + BODY, *RESPONSE, f"WARC-Payload-Digest: sha256:{hashlib.sha256(BODY).hexdigest()}"),
    "unknown algorithm": _record(HTTP + BODY, *RESPONSE, "WARC-Payload-Digest: crc32:00000000", "WARC-Block-Digest: what"),
    "resource": _record(BODY, "WARC-Type: resource", "Content-Type: text/html", f"WARC-Payload-Digest: sha1:{_b32(BODY)}"),
    "folded header": _record(HTTP + BODY, *RESPONSE, "X-Note: one\r\n two\r\n\tthree", f"WARC-Payload-Digest: SHA1:{_b32(BODY)}"),
    "revisit with a hex digest": _record(HTTP, "WARC-Type: revisit", "Content-Type: application/http", f"WARC-Payload-Digest: sha1:{hashlib.sha1(BODY).hexdigest()}"),
    "revisit without a digest": _record(HTTP, "WARC-Type: revisit", "Content-Type: application/http", "X-Payload-Length: ²"),
}


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_valid_records_of_others_are_kept(spark, tmp_path, pack):
    (tmp_path / "a.warc").write_bytes(b"".join(map(pack, CASES.values())))
    rows = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/a.warc",)], "file string"), with_payload=True).orderBy("offset").collect()
    assert [r["kind"] for r in rows] == ["record"] * len(CASES), [r["reason"] for r in rows]
    by = dict(zip(CASES, rows, strict=True))
    assert all(bytes(r["payload"]) == BODY for n, r in by.items() if not n.startswith("revisit"))
    assert by["revisit with a hex digest"]["payload_digest"] == hashlib.sha1(BODY).hexdigest() and by["revisit without a digest"]["payload_digest"] is None


def _kinds(path):
    source = files.Source(f"file://{path}")
    found = list(warc.salvage(source))
    assert sum(n for kind, _, n, _, _ in found if kind == "gap") <= source.size
    source.close()
    return [kind for kind, *_ in found]


@pytest.mark.parametrize("value", ["²", "9" * 5000, "-1", "", "1e3", "99999999999999999999"])
def test_odd_lengths_are_gaps(tmp_path, value):
    good = CASES["resource"]
    bad = good.replace(f"Content-Length: {len(BODY)}".encode(), f"Content-Length: {value}".encode())
    for pack in (bytes, gzip.compress):
        (tmp_path / "a.warc").write_bytes(pack(bad) + pack(good))
        assert _kinds(tmp_path / "a.warc")[-1] == "record" and "gap" in _kinds(tmp_path / "a.warc")


def test_no_damage_raises(tmp_path):
    r = random.Random(7)
    for pack in (bytes, gzip.compress):
        whole = b"".join(map(pack, CASES.values()))
        for _ in range(150):
            data = bytearray(whole)
            for _ in range(r.randint(1, 4)):
                data[r.randrange(len(data))] ^= 1 << r.randrange(8)
            (tmp_path / "a.warc").write_bytes(data[: r.choice([len(data), r.randrange(len(data))])])
            _kinds(tmp_path / "a.warc")
