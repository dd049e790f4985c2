"""Decoded layers of secrets: time in long runs, memory of inflated layers."""

import base64
import gzip
import random
import subprocess
import sys
import time
from urllib.parse import quote

import pytest

from quarrykit.llm import secrets

RUNS = {
    "percent": lambda t: quote(t, safe=""),
    "percent in two": lambda t: quote(quote(t, safe=""), safe=""),
    "escapes": lambda t: "".join(f"\\u{ord(c):04x}" if not c.isalnum() else c for c in t),
    "base64": lambda t: base64.b64encode(t.encode()).decode(),
    "base64, beyond ASCII": lambda t: base64.b64encode(("é " + t).encode()).decode(),
}


@pytest.mark.parametrize("name", RUNS)
def test_many_secrets_in_one_run_take_linear_time(name):
    r = random.Random(1)
    text = RUNS[name](" ".join("token=" + "".join(r.choices("ABCDEFGHJKMN", k=14)) for _ in range(8000)))
    began = time.process_time()
    found = secrets.decoded_findings(text)
    assert len(found) >= 8000 and time.process_time() - began < 6
    spans = sorted((s, e) for s, e, k in found if k == 0)
    assert spans[0][0] <= 40 and spans[-1][1] >= len(text) - 40 and len(set(spans)) == len(spans) >= 8000


def test_inflated_layers_are_not_held():
    probe = """
import base64, gzip, io, resource, sys
sys.path.insert(0, {root!r})
from quarrykit.llm import secrets
raw = io.BytesIO()
with gzip.open(raw, "wb", 1) as f:
    for k in range(160):
        f.write(b"plain words of no account, " * 40000)
    f.write(b"password=abcdefghijkl end")
text = base64.b64encode(raw.getvalue()).decode()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = secrets.decoded_findings(text)
print(len(found), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", probe.format(root=sys.path[0])], capture_output=True, text=True, timeout=280)
    found, grown = map(int, out.stdout.split())
    assert found == 1 and grown < 120  # of 170 MB


def test_nested_streams_end():
    inner = b"token=abcdefghijklmn "
    for _ in range(6):
        inner = b"see " + base64.b64encode(gzip.compress(inner)) + b" there"
    assert {k for _, _, k in secrets.decoded_findings(inner.decode())} == {0}
