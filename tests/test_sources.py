import os
import zipfile

import numpy as np
import pytest

from lumispec.plans import nodes
from lumispec.sources import instrument, tables


def bruker(path, exp="noesygppr1d", n=16, data=True, big=False):
    os.makedirs(f"{path}/pdata/1")
    files = {"acqus": f"##TITLE= x\n$$ 2020-01-02 10:11:12.000 +0100 me@host\n##$EXP= <{exp}>\n##$D= (0..3)\n0 1.5\n2 3\n##$NS= 8\n##END=\n", "pdata/1/procs": f"##$BYTORDP= {int(big)}\n##$NC_proc= -2\n##$SI= {n}\n##$OFFSET= 10\n##$SW_p= 6000\n##$SF= 600\n##$XDIM= {n}\n", "pdata/1/title": "Sample one\nDose high\n", "orig": "who someone else\n"}
    for name, text in files.items():
        with open(f"{path}/{name}", "w") as f:
            f.write(text)
    if data:
        np.arange(n, dtype=">i4" if big else "<i4").tofile(f"{path}/pdata/1/1r")


@pytest.fixture()
def samples(tmp_path):
    d = tmp_path / "in"
    bruker(f"{d}/10")
    bruker(f"{d}/9", big=True)
    bruker(f"{d}/bad", data=False)
    bruker(f"{d}/cp", exp="CPMGpr1d")
    bruker(f"{tmp_path}/z/77")
    bruker(f"{tmp_path}/z/98888")
    with zipfile.ZipFile(f"{d}/arch.zip", "w") as z:
        for top in ("98888", "77"):
            for r, _, fs in os.walk(f"{tmp_path}/z/{top}"):
                for f in fs:
                    z.write(os.path.join(r, f), os.path.relpath(os.path.join(r, f), f"{tmp_path}/z"))
    return str(d)


def test_bruker(spark, samples):
    rows = {r.sample_id: r for r in instrument.read_samples_dir(spark, samples, pulse_sequence="noesy").collect()}
    assert set(rows) == {"9", "10", "arch", "bad"}
    assert rows["bad"].status == "failed" and rows["bad"].error
    for k in ("9", "10", "arch"):
        r = rows[k]
        assert r.data_1r == [v / 4 for v in range(16)] and r.axis[0] == 10 and abs(r.axis[-1]) < 1e-9
        assert r.parameters["acqus_D"] == "0.0 1.5 2.0 3.0" and r.parameters["title_Sample"] == "one" and r.parameters["orig_who"] == "someone else"
        assert r.acquired.year == 2020
    kept = instrument.read_samples_dir(spark, samples, pulse_sequence="noesy", metadata_only=True, keep_skipped=True)
    assert {r.sample_id: r.status for r in kept.collect()}["cp"] == "skipped"
    with pytest.raises(FileNotFoundError):
        instrument.read_samples_dir(spark, samples + "/none")


def test_two_dimensions():
    whole = np.arange(32).reshape(4, 8)
    blocks = np.concatenate([whole[a : a + 2, b : b + 4].ravel() for a in (0, 2) for b in (0, 4)])
    assert (instrument.reorder(blocks, (4, 8), (2, 4)) == whole).all()


def test_names():
    assert instrument.sample_names(["bar/a.zip", "foo/b.zip"]) == ["a", "b"]
    assert instrument.sample_names(["bar/a.zip", "foo/a.zip"]) == ["bar/a", "foo/a"]
    assert sorted(["a10", "10", "a2", "2", "a1b3"], key=instrument.natural) == ["2", "10", "a1b3", "a2", "a10"]


JDX = "##TITLE=t $$ c\n##JCAMP-DX=5.0\n##XUNITS=HZ\n##.OBSERVE FREQUENCY=500\n##XFACTOR=1\n##YFACTOR=2\n##FIRSTX=1000\n##LASTX=500\n##XYDATA=(X++(Y..Y))\n1000 1 2\n800 3\n500 -4.5\n##END=\n"


def test_jcamp(spark, tmp_path):
    assert instrument.strip_comments(["##TITLE=Hello $$ world", "$$ Hello world", "12343 $$ hello world"]) == ["##TITLE=Hello ", "", "12343 "]
    (tmp_path / "one.jdx").write_text(JDX)
    (tmp_path / "two.jdx").write_text("##TITLE=a\n##XYDATA=(XY..XY)\n1,2 3,4\n5,6\n##END=\n")
    (tmp_path / "odd.jdx").write_text("##TITLE=a\n##XYDATA=(R++(A..A))\n1 2\n##END=\n")
    rows = {r.sample_id: r for r in instrument.read_samples_dir(spark, str(tmp_path), "jdx").collect()}
    assert rows["one"].data_1r == [2.0, 4.0, 6.0, -9.0] and rows["one"].axis[0] == 2.0 and rows["one"].axis[-1] == 1.0
    assert rows["two"].axis == [1.0, 3.0, 5.0] and rows["odd"].status == "failed"


def test_steps_and_exports(spark, samples, tmp_path):
    p = lambda n: str(tmp_path / n)
    nodes.load_samples(spark, samples, p("a"), pulse_sequence="NOESY")
    assert spark.read.parquet(p("a/rejected")).count() == 1
    nodes.interpolate(spark, p("a"), (1.0, 9.0, 0.5), p("b"))
    nodes.exclude_regions(spark, p("b"), {"w": (4.0, 5.0)}, p("c"))
    nodes.filter_samples(spark, p("c"), ["sample_id <> '9'"], p("d"))
    nodes.normalize(spark, p("d"), p("e"), calibrant=(8.0, 9.0))
    got = spark.read.parquet(p("e/spectra"))
    assert got.select("sample_id").distinct().count() == 2 and got.where("ppm between 4 and 5 or ppm >= 8").count() == 0
    with pytest.raises(ValueError):
        nodes.filter_samples(spark, p("c"), [], None)
    points = sorted(r[0] for r in got.select("ppm").distinct().collect())
    w = tables.wide(got, points)
    tables.export_csv(w, p("csv"))
    back = tables.from_wide(spark.read.option("header", True).csv(p("csv")))
    a = {(r.sample_id, r.ppm): round(r.intensity, 9) for r in back.collect()}
    assert a == {(r.sample_id, r.ppm): round(r.intensity, 9) for r in got.collect()}
    with pytest.raises(Exception):
        tables.export_csv(w, p("csv"))
    assert instrument.zip_samples(samples, str(tmp_path)) and os.path.exists(tmp_path / "10.zip")
