import pytest
from pyspark.sql import functions as F

from quarrykit.functions import literals, paths, text
from quarrykit.functions import tables as t


def apply(spark, column, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["r"] for r in rows.select("i", column(F.col("v")).alias("r")).orderBy("i").collect()]


def test_root_kinds(spark):
    spellings = {
        "//host/share": ("unc", "host"), "//?/UNC/host/share": ("unc", "host"), "//./unc/host/s": ("unc", "host"), "//?/C:/x": ("drive", "C"), "C:/x": ("drive", "C"),
        "/x/y": ("root", None), "x/y": ("relative", None), "": ("relative", None), "//": ("unc", None), "//?": ("unc", None), "é:/x": ("drive", "é"), "1:/x": ("relative", None),
    }
    assert [tuple(r) for r in apply(spark, paths.root_kind, spellings)] == list(spellings.values())


@pytest.mark.parametrize("base, path, inside", [("C:\\proj\\shot", "c:/PROJ/shot/lib", True), ("/a", "/a/b", True), ("/a", "/A/b", False), ("/a", "/a", False), ("/a/b", "/a/c/../b/x", True), ("/a/b", "/a/b/../x", False), ("//h/s", "//H/S/x", True), ("//h/s", "//?/UNC/h/s/x", True), ("C:/x", "C:y/z", False), ("/a", "b", False)])
def test_containment(spark, base, path, inside):
    assert apply(spark, lambda v: paths.contained(F.lit(base), v), [path]) == [inside]


def test_classify(spark):
    got = apply(spark, lambda v: paths.classify(v, F.lit("/proj/shot")), ["//../../lib/x", "//tex/x", "////evil/s", "//C:/x", "..", "/proj/shot/x"])
    seen = [(r["resolved_path"], r["is_relative"], r["escapes_folder"], r["is_unc"], r["has_drive_letter"], r["disguised"], r["absolute_inside_base"], r["notable"]) for r in got]
    assert seen == [
        ("/lib/x", True, True, False, False, False, False, True),
        ("/proj/shot/tex/x", True, False, False, False, False, False, False),
        (None, False, False, True, False, True, False, True),
        (None, False, False, False, True, True, False, True),
        ("/proj", False, True, False, False, False, False, True),
        (None, False, False, False, False, False, True, True),
    ]


def test_literal_kinds(spark):
    cases = {
        "see https://a.b/c and ftp://d.e/f": ["url", "url"], "example.com": ["host"], "rig.snap": [], "x.app": [], "out.bin": [], "cmd /c dir": ["command"], "C:\\x": ["path"], "bones selected/assigned": [],
        "./a b/c": ["path"], "textures/wood.png": ["path"], "%APPDATA%": ["path"], "costs $5": [], "${HOME}/x": ["path"], "QUJD" * 60: ["blob"], "a" * 5000: [], "": [], "powershell": ["command"],
    }
    got = apply(spark, lambda v: F.transform(literals.sorted_distinct(literals.literals(v)), lambda x: x["kind"]), cases)
    assert dict(zip(cases, got, strict=True)) == cases
    assert apply(spark, lambda v: F.size(literals.literals(v, bare=True)), ["self.co"]) == [0]


def test_escaping(spark):
    assert apply(spark, text.printable_line, ["a\tb", "a\nb\r", "\x1b[0m", "\u202e", "\x00", "\ufeffx", "é"]) == ["a\tb", "a\\x0ab\\x0d", "\\x1b[0m", "\\u202e", "\\x00", "\\ufeffx", "é"]
    assert apply(spark, text.printable_block, ["a\r\nb\rc\n"]) == ["a\nb\\x0dc\n"]
    assert apply(spark, text.is_steering, ["a b", "a\u200bb", "a\nb"]) == [False, True, True]
    assert apply(spark, text.without_controls, ["a\x07b\u2028\tc"]) == ["abc"]


def test_small_functions(spark):
    assert apply(spark, text.version_display, ["403", "249", "500", "0405", "x"]) == ["4.3", "2.49", "5.0", "4.5", "x"]
    assert apply(spark, text.max_nesting, ["(([{}]))", ")))(", ""]) == [4, 1, 0]
    assert apply(spark, lambda v: text.flag_names(v.cast("int"), t.TEXT_FLAGS), ["21", "0", "2", "-1"])[:3] == [["TXT_ISDIRTY", "TXT_ISMEM", "TXT_ISSCRIPT"], [], ["bit1"]]
    assert apply(spark, text.is_sha256, [" " + "A" * 64, "g" * 64, "a" * 63]) == [True, False, False]


def test_windows_bases_join_with_backslashes(spark):
    cases = [
        ("C:\\proj", "tex/../a.png", "C:\\proj\\a.png"), ("C:\\proj", "../../../a", "C:\\a"), ("C:", "../a", "C:\\a"[:2] + "a"), ("\\\\nas\\share\\x", "../../b", "\\\\nas\\share\\b"),
        ("/srv/x", "../../../b", "/b"), ("a/b", "../../../c", "../c"), ("a", "..", "."), ("C:/p/q", "C:/evil", "C:\\p\\q\\C:\\evil"),
    ]
    df = spark.createDataFrame(cases, "base string, path string, want string").withColumn("got", paths.joined(F.col("base"), F.col("path")))
    assert [(r["base"], r["path"], r["got"]) for r in df.collect()] == cases


def test_literals_for_a_report(spark):
    rows = ["a\tb", "it's", "it's \"so\"", "x" * 130, "\x1b[0m", "back\\slash"]
    df = spark.createDataFrame([(r,) for r in rows], "v string").select(text.quote_literal(F.col("v")).alias("q"), text.show_literal(F.col("v")).alias("s")).collect()
    assert [r["q"] for r in df] == ["'a\\\\tb'", '"it\'s"', "'it\\'s \"so\"'", "'" + "x" * 120 + "...'", "'\\x1b[0m'", "'back\\\\slash'"]
    assert df[4]["s"] == "\\x1b[0m" and df[3]["s"] == "x" * 130
    joined = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "p array<string>").select(text.listed(F.col("p")).alias("l"))
    assert [r["l"] for r in joined.collect()] == ["", "a", "a and b", "a, b and c"]
