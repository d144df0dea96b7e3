"""What the plans must look like: pruned scans, pushed filters, and no Python in native operators."""

from lumispec import catalog
from lumispec.operators import spectra

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_native_operators_have_no_python(spark):
    for name in catalog.ORACLE:
        text = plan(catalog.QUERIES[name](spark, SF))
        assert not any(x in text for x in ("MapInPandas", "MapInArrow", "PythonUDF", "ArrowEvalPython", "FlatMapGroups", "CartesianProduct")), name


def test_scans_are_pruned(spark):
    text = plan(catalog.accept_filter(spark, SF))
    assert "l_shipdate" not in text.split("== Physical Plan ==")[1] and "PushedFilters: [IsNotNull" in text
    text = plan(spectra.filter_samples(catalog.grid(spark, SF), catalog.classes(spark, SF), "label = 1"))
    assert "EqualTo(label,1)" in text


def test_regions_take_one_pass(spark):
    """All regions are integrated in one scan; the axis and the samples take one more each."""
    text = plan(spectra.integrate(catalog.grid(spark, SF), catalog.REGIONS)).split("== Physical Plan ==")[1]
    assert text.count("FileScan parquet") <= 3
