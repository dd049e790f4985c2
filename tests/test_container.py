import gzip
import uuid

import pytest
import zstandard

from quarrykit.jobs import inspect as job
from quarrykit.sources import container
from quarrykit.sources.container_writer import Writer

BODIES = ["", "\n", "import os\n\n\nx = 1\n", "é\n日本\n\n", "a\r\nb", "x" * 5000, "\n\n\n", "tab\there"]


def hostile() -> Writer:
    box = Writer()
    box.text("run.py", "import socket\nsocket.socket()", flags=21)
    box.text("notes", "just prose", flags=4)
    box.library("//host/share/x.blend")
    box.library("////evil/share/y.blend")
    box.driver("__import__('os').system('calc.exe')", owner="location", index=2)
    box.driver("var * 2")
    box.node(1, "C:/x.osl", "abc", b"\1\2\3")
    return box


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("body", BODIES)
def test_bodies_come_back_byte_for_byte(body, large):
    box = Writer()
    box.text("t", body)
    rows = container.inspect(box.to_bytes(large=large))
    assert [r["body"] for r in rows if r["category"] == "text"] == [body]


@pytest.mark.parametrize("pack", [lambda d: d, gzip.compress, zstandard.compress])
def test_compressed_files_read_alike(pack):
    kinds = [r["category"] for r in container.inspect(pack(hostile().to_bytes()))]
    assert kinds == ["text", "text", "fcurve", "driver", "driver", "osl", "library", "library", "file"]


def test_ring_of_lines_ends():
    box = Writer()
    box.text("ring", "a\nb", ring=True)
    assert container.inspect(box.to_bytes())[0]["body"] == "a\nb"


GOOD = hostile().to_bytes()


@pytest.mark.parametrize(
    "data, kind",
    [
        (b"", "not_a_blend"),
        (b"PK\3\4" + b"\0" * 40, "not_a_blend"),
        (GOOD[:7] + b"x" + GOOD[8:], "malformed"),
        (GOOD[:8] + b"x" + GOOD[9:], "malformed"),
        (GOOD[:9] + b"4x4" + GOOD[12:], "malformed"),
        (GOOD[:-30], "malformed"),
        (GOOD[:16] + b"\xff\xff\xff\x7f" + GOOD[20:], "malformed"),
        (GOOD[:16] + b"\xff\xff\xff\xff" + GOOD[20:], "malformed"),
        (GOOD.replace(b"DNA1", b"DNA2", 1), "malformed"),
        (gzip.compress(GOOD)[:-20], "malformed"),
    ],
)
def test_damage_is_an_error_row(data, kind):
    rows = container.inspect(data)
    assert [(r["category"], r["name"]) for r in rows] == [("error", kind)]


def test_limits_refuse_or_cut():
    assert container.inspect(GOOD, container.Limits(blocks=3))[0]["detail"] == "too many blocks"
    assert container.inspect(gzip.compress(GOOD), container.Limits(inflated_bytes=100))[0]["detail"] == "decompression bomb"
    box = Writer()
    box.text("t", "abc\ndef")
    assert [(r["body"], r["truncated"]) for r in container.inspect(box.to_bytes(), container.Limits(script_chars=5)) if r["category"] == "text"] == [("abc", True)]
    assert container.inspect(GOOD, container.Limits(seconds=-1))[0]["category"] == "error"


def test_report_from_files(spark, tmp_path):
    (tmp_path / "a.blend").write_bytes(GOOD)
    (tmp_path / "sub").mkdir()
    quiet = Writer()
    quiet.text("readme", "x = 1")
    (tmp_path / "sub" / "b.blend").write_bytes(quiet.to_bytes(large=True, version="500"))
    (tmp_path / "c.blend").write_bytes(b"nothing")
    (tmp_path / "d.txt").write_bytes(GOOD)
    rows = container.read(spark, str(tmp_path))
    out = {r["path"].rsplit("/", 1)[1]: r for r in job.reports(spark, rows).collect()}
    assert set(out) == {"a.blend", "b.blend"}
    a, b = out["a.blend"], out["b.blend"]
    assert a["tier"] == "red" and a["reasons"] == ["x_network", "x_subprocess", "x_indirect_call", "library_unc"] or a["reasons"][0] == "x_network"
    assert "library_unc" in a["reasons"] and a["steps"][0] == "needs_human" and "autorun_present" in a["steps"]
    assert b["tier"] == "neutral" and b["reasons"] == [] and b["steps"] == ["looks_ordinary"] and b["version_display"] == "5.0"
    assert [r["kind"] for r in container.errors(rows).collect()] == ["not_a_blend"]
    owners = {r["owner"] for r in container.drivers(rows).collect()}
    assert owners == {"location[2]", "<unattached driver>"}
    json = [r["json"] for r in job.report_json(job.reports(spark, rows)).collect()]
    assert all(j.isascii() for j in json) and any('"tier":"red"' in j for j in json)


def test_stream_takes_each_file_once(spark, tmp_path):
    from quarrykit.streaming.watch import watch

    label = f"w{uuid.uuid4().hex}"  # the shared folder outlives a test run
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.blend").write_bytes(GOOD)
    for more in (1, 2):
        watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), label=label).awaitTermination(120)
        assert container.files(spark.read.parquet(str(tmp_path / "out"))).count() == more
        (tmp_path / "in" / f"b{more}.blend").write_bytes(GOOD)


def test_findings_carry_their_evidence(spark, tmp_path):
    import json as js

    (tmp_path / "a.blend").write_bytes(GOOD)
    known_body = "import socket\nsocket.socket()"
    rows = container.read(spark, str(tmp_path / "a.blend"))
    known = spark.createDataFrame([("0" * 64, "s.py", "o\x1b", job.syntax.structure(known_body)[0], ["q"], True, 0)], job.NO_KNOWN)
    of = job.inspection(spark, rows, known=known)
    found = {(r["category"], r["name"]): r for r in job.findings(of).collect()}
    run = found["text", "run.py"]
    assert run["severity"] == "alarming" and [(s["key"], s["evidence"]) for s in run["statements"]] == [("x_network", ["socket", "socket.socket"])]
    assert js.loads(run["details"])["identity"]["evidence"] == "structure"
    assert [s["key"] for s in found["driver", "location[2]"]["statements"]] == ["x_indirect_call", "x_runtime_import"] or found["driver", "location[2]"]["severity"] == "alarming"
    assert js.loads(found["library", "////evil/share/y.blend"]["details"])["is_unc"] and found["library", "////evil/share/y.blend"]["statements"] == []
    files = job.summaries(of)
    whole = js.loads(job.report_json(files, job.findings(of), container.errors(of.rows)).first()["json"])
    assert whole["banner"]["tier"] == "red" and len(whole["findings"]) == 7
    text = job.report_text(files, job.findings(of)).first()["report"]
    assert "  text: run.py (alarming)" in text and "    x_network: socket; socket.socket" in text and "\x1b" not in text and "known script s.py of o\\x1b by structure, generated" in text
    assert text.endswith("An inventory, not a verdict.")


def test_targets(spark, tmp_path):
    for name in ("a.blend", "b.dat", "c.blend"):
        (tmp_path / name).write_bytes(GOOD)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.blend").write_bytes(GOOD)
    names = lambda *targets: sorted(r["path"].rsplit("/", 1)[1] for r in container.files(container.read(spark, [str(tmp_path / x) for x in targets])).collect())
    assert names("") == ["a.blend", "c.blend", "d.blend"]
    assert names("b.dat", "a.blend", "a.blend") == ["a.blend", "b.dat"]
    assert names("*") == ["a.blend", "b.dat", "c.blend", "d.blend"] and names("*.dat", "sub") == ["d.blend"] and names("b.*") == ["b.dat"]
    assert names("", "sub", "sub/d.blend") == ["a.blend", "c.blend", "d.blend"] and names("nothing") == []


def test_damaged_streams():
    whole = gzip.compress(GOOD)
    assert container.inflated(whole + gzip.compress(b"tail") + b"\0" * 8, container.Limits()) == GOOD + b"tail"
    assert container.inspect(whole[:-9])[0]["name"] == "malformed"
    with pytest.raises(container.Late):
        container.inflated(whole, container.Limits(), late=-1.0)


def test_entry_point_prints_and_exits(spark, tmp_path, capsys):
    (tmp_path / "a.blend").write_bytes(GOOD)
    assert job.run(spark, [str(tmp_path)]) == 1 and "[red]" in capsys.readouterr().out
    (tmp_path / "z.blend").write_bytes(b"nothing")
    assert job.run(spark, [str(tmp_path), "--json", "--out", str(tmp_path / "out")]) == 2
    assert len(spark.read.text(str(tmp_path / "out")).collect()) == 2
    assert job.run(spark, [str(tmp_path / "none")]) == 3
