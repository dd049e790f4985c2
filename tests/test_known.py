"""Known-script tables that are odd, missing or too large, and facts kept from run to run."""

import json

import pytest
from test_container import GOOD

from quarrykit.jobs import inspect as job
from quarrykit.operators import identity
from quarrykit.operators.fact_store import FactStore
from quarrykit.sources import container
from quarrykit.sources.container_writer import Writer

ENTRY = {c: "x" for c in identity.REQUIRED} | {"sha256": "AB" * 32, "byte_size": 7}


def _table(path, entries, schema=2):
    path.write_text(json.dumps({"schema": schema, "entries": entries}))
    return str(path)


def test_one_odd_entry_spoils_only_itself(spark, tmp_path):
    odd = [1, "x", ENTRY, None, [ENTRY], ENTRY | {"structure": "x"}, ENTRY | {"structure": None, "generated": None}, ENTRY | {"byte_size": "many"}, {}]
    entries, problems = identity.load_known(spark, _table(tmp_path / "k.json", odd))
    assert [(r["place"], r["sha256"], r["byte_size"], r["generated"]) for r in entries.orderBy("place").collect()] == [(2, "ab" * 32, 7, False), (6, "ab" * 32, 7, False), (7, "ab" * 32, None, False)]
    said = {r["place"]: r["problem"] for r in problems.collect()}
    assert said == {0: "not an object", 1: "not an object", 3: "not an object", 4: "not an object", 5: "bad structure", 8: "missing field"}
    assert identity.warnings_of(problems, 2) == ["known scripts: entry 0: not an object", "known scripts: entry 1: not an object", "known scripts: 4 more problems"]


@pytest.mark.parametrize("text, problem", [("{", "unusable table"), ('{"schema": "2", "entries": []}', "unusable table"), ('{"schema": 2, "entries": {}}', "unusable table"), ("[" * 3000, "unusable table"), ('{"schema": ' + "9" * 5000 + "}", "unusable table")])
def test_a_bad_table_is_one_problem(spark, tmp_path, text, problem):
    (tmp_path / "k.json").write_text(text)
    entries, problems = identity.load_known(spark, str(tmp_path / "k.json"))
    assert entries.count() == 0 and [tuple(r) for r in problems.collect()] == [(-1, problem)]


def test_missing_and_too_large_tables(spark, tmp_path, monkeypatch):
    for path, problem in ((str(tmp_path / "none.json"), "missing table"), (_table(tmp_path / "large.json", [ENTRY] * 9), "table too large")):
        entries, problems = identity.load_known(spark, path, table_bytes=1000)
        assert entries.count() == 0 and [tuple(r) for r in problems.collect()] == [(-1, problem)]
    monkeypatch.setattr(identity, "TABLE_ENTRIES", 3)
    assert [r["problem"] for r in identity.load_known(spark, _table(tmp_path / "k.json", [ENTRY] * 4))[1].collect()] == ["too many entries"]
    monkeypatch.setattr(identity, "ENTRY_LITERALS", 2)
    shape = {"scheme": 1, "sha256": "0" * 64, "literals": ["a", 2, "c"]}
    assert [r["problem"] for r in identity.load_known(spark, _table(tmp_path / "k.json", [ENTRY | {"structure": shape}]))[1].collect()] == ["too many literals"]


def test_warnings_reach_both_reports(spark, tmp_path, capsys):
    (tmp_path / "a.blend").write_bytes(GOOD)
    known = _table(tmp_path / "k.json", ["x", ENTRY])
    assert job.run(spark, [str(tmp_path), "--known", known]) == 1 and "warning: known scripts: entry 0: not an object" in capsys.readouterr().out
    job.run(spark, [str(tmp_path), "--json", "--known", str(tmp_path / "none.json")])
    assert json.loads(capsys.readouterr().out)["warnings"] == ["known scripts: missing table"]


def _found(of):
    return sorted(map(repr, job.findings(of).collect())), sorted(map(repr, job.summaries(of).collect()))


def test_a_second_run_parses_new_bodies_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.blend").write_bytes(GOOD)
    rows = lambda: container.read(spark, str(tmp_path / "in"))
    plain = _found(job.inspection(spark, rows()))
    parsed = []
    for _ in range(2):
        store = FactStore(spark, str(tmp_path / "facts"))
        counts, facts = [], store.facts
        store.facts = lambda bodies, facts=facts, store=store, counts=counts, **k: (facts(bodies, **k), counts.append(store.parsed))[0]
        assert _found(job.inspection(spark, rows(), store=store)) == plain
        parsed.append(sum(counts))
    assert parsed[0] == 3 and parsed[1] == 0
    box = Writer()
    box.text("new", "y = 1")
    box.text("old", "just prose")
    (tmp_path / "in" / "b.blend").write_bytes(box.to_bytes())
    store = FactStore(spark, str(tmp_path / "facts"))
    bodies = job.stored(container.texts(rows()).select(job.sha256_hex(job.F.col("source")).alias("body"), "source").dropDuplicates(["body"]), "b")
    again = store.facts(bodies)
    assert store.parsed == 1 and again.where("kind = 'took'").count() == 3


def test_two_runs_at_once_and_late_bodies(spark, tmp_path):
    bodies = spark.createDataFrame([("a", "x = 1"), ("b", "f('y')")], "body string, source string")
    store = FactStore(spark, str(tmp_path))
    first = sorted(map(repr, store.facts(bodies).where("kind <> 'took'").collect()))
    store._add(store.held().drop("run"))  # what another run would have added meanwhile
    assert sorted(map(repr, store.facts(bodies).where("kind <> 'took'").collect())) == first and store.parsed == 0
    late = FactStore(spark, str(tmp_path / "late"))
    assert late.facts(bodies, seconds=-1.0).where("kind = 'late'").count() == 2
    assert late.facts(bodies).where("kind = 'late'").count() == 0 and late.parsed == 2
    assert FactStore(spark, str(tmp_path), label="other").held() is None
