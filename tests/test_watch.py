"""Reports of files that keep arriving and changing."""

import os
import uuid

from test_container import GOOD

from quarrykit.operators.fact_store import FactStore
from quarrykit.sources.container_writer import Writer
from quarrykit.streaming.watch import watch_reports


def _box(*bodies):
    box = Writer()
    for k, b in enumerate(bodies):
        box.text(f"t{k}", b)
    return box.to_bytes()


def test_only_changed_reports_come_out(spark, tmp_path):
    label, files, out = f"w{uuid.uuid4().hex}", tmp_path / "in", str(tmp_path / "out")
    files.mkdir()
    store = FactStore(spark, str(tmp_path / "facts"))
    stamp = [1_700_000_000]

    def put(name, data):
        (files / name).write_bytes(data)
        stamp[0] += 60
        os.utime(files / name, (stamp[0], stamp[0]))

    def run():
        before = {(r["path"], r["batch"]) for r in held()}
        query = watch_reports(spark, str(files), out, store=store, label=label)
        query.awaitTermination(150)
        assert query.exception() is None
        return {r["path"].rsplit("/", 1)[1]: r for r in held() if (r["path"], r["batch"]) not in before}

    def held():
        return spark.read.parquet(out).collect() if os.path.isdir(out) else []

    put("a.blend", GOOD)
    put("b.blend", _box("x = 1"))
    put("c.blend", b"nothing")
    first = run()
    assert {n: (r["tier"], r["error"]) for n, r in first.items()} == {"a.blend": ("red", None), "b.blend": ("neutral", None), "c.blend": (None, "not_a_blend")}
    put("a.blend", GOOD)  # written again as it was
    put("b.blend", _box("x = 1", "import socket\nsocket.socket()"))
    put("d.blend", _box("y = 2"))
    second = run()
    assert {n: r["tier"] for n, r in second.items()} == {"b.blend": "red", "d.blend": "neutral"} and second["b.blend"]["reasons"] == ["x_network"]
    assert run() == {}
