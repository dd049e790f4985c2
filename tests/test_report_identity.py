"""Reports of files whose scripts are known, and rules on members of builtins."""

import hashlib

from quarrykit.jobs import inspect as job
from quarrykit.operators import statements, syntax
from quarrykit.sources import container
from quarrykit.sources.container_writer import Writer

AMBER = "import pickle\npickle.loads(b'')\n"
RED = "import socket\nsocket.socket()\n"


def _files(folder):
    for name, bodies in (("amber", [AMBER]), ("red", [RED]), ("both", [AMBER, RED + "# another"])):
        box = Writer()
        for k, body in enumerate(bodies):
            box.text(f"t{k}", body)
        (folder / f"{name}.blend").write_bytes(box.to_bytes())


def test_known_scripts_clear_amber_and_are_named_under_red(spark, tmp_path):
    _files(tmp_path)
    rows = container.read(spark, str(tmp_path))
    sha = lambda body: hashlib.sha256(body.encode()).hexdigest()
    known = spark.createDataFrame([(sha(AMBER), "io.py", "pack 1", None, None, False, 0), (sha(RED), "net.py", "pack 2", None, None, False, 1)], job.NO_KNOWN)
    got = {r["path"].rsplit("/", 1)[1]: r for r in job.reports(spark, rows, known=known).collect()}
    assert (got["amber.blend"]["tier"], got["amber.blend"]["reasons"], got["amber.blend"]["steps"]) == ("neutral", [], ["looks_ordinary"])
    assert (got["red.blend"]["tier"], got["red.blend"]["recognised"], got["red.blend"]["steps"]) == ("red", ["net.py -- pack 2"], ["known_release"])
    assert (got["both.blend"]["tier"], got["both.blend"]["recognised"], got["both.blend"]["steps"]) == ("red", [], ["needs_human"])
    made = known.withColumn("generated", job.F.lit(True))
    got = {r["path"].rsplit("/", 1)[1]: r["tier"] for r in job.reports(spark, rows, known=made).collect()}
    assert got == {"amber.blend": "amber", "red.blend": "red", "both.blend": "red"}


def test_members_of_builtins(spark):
    forms = ["__builtins__.__dict__", "__builtins__['eval']", "import builtins\nbuiltins.__dict__['x']", "b = __builtins__\nb.__getattribute__('eval')", "x.__dict__", "x['eval']"]
    facts = syntax.facts(spark.createDataFrame([(f,) for f in forms], "source string"))
    told = {r["body"]: r["evidence"] for r in statements.statements(facts).where("key = 'x_builtins_indirection'").collect()}
    found = [told.get(hashlib.sha256(f.encode()).hexdigest()) for f in forms]
    assert found[0] == ["__builtins__.__dict__"] and found[1] == ["__builtins__[...]"] and found[2] and found[3] and found[4:] == [None, None]
