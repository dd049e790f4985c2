"""One JSON document of all reports."""

import json

from test_container import GOOD

from quarrykit import __version__
from quarrykit.jobs import inspect as job
from quarrykit.sources.document import DocumentWriter


def test_document_of_a_run(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for name, data in (("b", GOOD), ("a", GOOD), ("c", b"nothing"), ("é", GOOD[:50])):
        (tmp_path / "in" / f"{name}.blend").write_bytes(data)
    for _ in range(2):  # a document that is there is replaced
        assert job.run(spark, [str(tmp_path / "in"), "--document", str(tmp_path / "all.json")]) == 2
    raw = (tmp_path / "all.json").read_bytes()
    whole = json.loads(raw)
    assert raw.isascii() and capsys.readouterr().out == ""
    assert [whole[k] for k in ("tool", "version", "schema", "lang")] == ["quarrykit", __version__, 1, "en"]
    assert [f["path"].rsplit("/", 1)[1] for f in whole["files"]] == ["a.blend", "b.blend"] and [len(f["findings"]) for f in whole["files"]] == [7, 7]
    assert [(e["path"].rsplit("/", 1)[1], e["kind"]) for e in whole["errors"]] == [("c.blend", "not_a_blend"), ("é.blend", "malformed")]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["all.json", "in"]


def test_attempts_that_do_not_count_leave_nothing(tmp_path):
    rows = lambda *n: [{"kind": "file" if k % 2 else "error", "json": json.dumps({"k": k})} for k in n]
    writer = DocumentWriter(str(tmp_path / "d.json"), False)
    lost, first, second, empty = writer.write(iter(rows(1, 2))), writer.write(iter(rows(1, 2))), writer.write(iter(rows(3, 5))), writer.write(iter([]))
    assert lost.held and not empty.held
    writer.commit([first, None, second, empty])
    whole = json.loads((tmp_path / "d.json").read_text())
    assert [f["k"] for f in whole["files"]] == [1, 3, 5] and [e["k"] for e in whole["errors"]] == [2]
    assert [p.name for p in tmp_path.iterdir()] == ["d.json"]
    failed = DocumentWriter(str(tmp_path / "e.json"), False)
    failed.abort([failed.write(iter(rows(1)))])
    nothing = DocumentWriter(str(tmp_path / "f.json"), False)
    nothing.commit([])
    assert json.loads((tmp_path / "f.json").read_text())["files"] == [] and sorted(p.name for p in tmp_path.iterdir()) == ["d.json", "f.json"]
