"""Checks of whole sets, accessors, spreadsheets, pages, splits and clusters, by hand-made cases."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from lumispec.operators import datasets, model, peaks, spectra
from lumispec.sources import pages, tables, workbook


def grid(spark, rows, axis=None):
    data = [(s, k, float(axis[k] if axis else k + 1), float(v)) for s, values in rows.items() for k, v in enumerate(values)]
    return spark.createDataFrame(data, "sample_id string, idx int, ppm double, intensity double")


def test_valid_and_broken_sets(spark):
    g = grid(spark, {"10": [1, 2, 1], "20": [2, 2, 1]})
    meta = spark.createDataFrame([("10", "Ana"), ("20", "Elia")], "sample_id string, subject string")
    assert datasets.validated(g, meta) is g and datasets.is_spectra(g) and not datasets.is_peaks(g)
    assert datasets.summary(g).first() == (2, 3, 1.0, 3.0)
    broken = g.unionByName(g.where("sample_id = '10' and idx = 0")).where("not (sample_id = '20' and idx = 2)")
    broken = broken.unionByName(spark.createDataFrame([("20", 1, 9.0, 0.0)], g.schema))
    found = {r.problem: r.n for r in datasets.problems(broken, meta.where("sample_id = '10'").unionByName(spark.createDataFrame([("30", "x")], meta.schema))).collect()}
    assert found == {"repeated point": 2, "position with several places": 1, "position that samples lack": 1, "metadata without spectrum": 1, "spectrum without metadata": 1}
    with pytest.raises(ValueError, match="repeated point"):
        datasets.validated(broken)
    assert datasets.problems(g.limit(0)).count() == 0


def test_positions_and_subset(spark):
    g = grid(spark, {k: [1, 2] for k in "dacbe"})
    ids = lambda df: sorted({r.sample_id for r in df.collect()})
    assert sorted(datasets.positions(g).collect()) == [(s, k) for k, s in enumerate("abcde")]
    assert ids(datasets.subset(g, g, [0, 3])) == ["a", "d"] and ids(datasets.subset(g, g, [-1, -4])) == ["b", "c", "e"]
    assert datasets.subset(g, g, []).count() == 0
    for wrong in ([9], [1, -1]):
        with pytest.raises(ValueError):
            datasets.subset(g, g, wrong)


def test_new_values(spark):
    g = grid(spark, {"a": [1, 2], "b": [3, 4]})
    out = datasets.with_matrix(g, g.select("sample_id", "idx", (-F.col("intensity")).alias("value")))
    assert out.agg(F.sum("intensity")).first()[0] == -10
    with pytest.raises(Exception, match="values and points differ"):
        datasets.with_matrix(g, g.where("idx = 0").select("sample_id", "idx", F.col("intensity").alias("value"))).collect()


def test_metadata_accessors(spark):
    groups = {"external": spark.createDataFrame([("10", "Ana")], "sample_id string, subject string"), "acqus": spark.createDataFrame([("10", 298.0)], "sample_id string, temperature double")}
    assert datasets.meta_get(groups).columns == ["sample_id", "subject", "temperature"]
    assert datasets.meta_get(groups, names=["acqus"]).columns == ["sample_id", "temperature"]
    assert datasets.meta_column(groups, "subject").first() == ("10", "Ana") and datasets.meta_groups(groups) == ["external", "acqus"]
    for how in ({"names": ["none"]}, {"columns": ["none"]}, {"columns": ["subject"], "names": ["acqus"]}):
        with pytest.raises(ValueError):
            datasets.meta_get(groups, **how)


def test_regions_are_remembered(spark):
    e = datasets.Excluding(grid(spark, {"a": [1, 2, 1]})).exclude({"low": (2.0, 1.0)})
    assert [tuple(r) for r in e.excluded().collect()] == [("low", 1.0, 2.0)] and [r.ppm for r in e.spectra.collect()] == [3.0]
    assert e.exclude({}).regions == e.regions


def test_workbook_round_trip_and_joins(spark, tmp_path):
    samples = spark.createDataFrame([("10", "Ana", "baseline", None), ("20", "Ana", "3 months", 2.5), ("30", "Elia", 'a<b & "c"', -1e-9)], "sample_id string, SubjectID string, TimePoint string, dose double")
    people = spark.createDataFrame([("Ana", 29, "F"), ("Elia", 0, None)], "SubjectID string, Age int, Sex string")
    path = f"file:{tmp_path}/meta.xlsx"
    assert workbook.export_workbook({"samples": samples, "people": people, "empty": people.limit(0)}, path, ["samples", "people", "empty", "none"]) == ["none"]
    with pytest.raises(Exception):
        workbook.export_workbook({"samples": samples}, path)
    found = workbook.read_workbook(spark, path)
    assert list(found) == ["samples", "people"]
    assert [tuple(r)[:-1] for r in found["samples"].orderBy("_row").collect()] == [tuple(r) for r in samples.collect()]
    meta = samples.select("sample_id")
    out = datasets.meta_add_sheets(meta, list(found.values()))
    assert {(r.sample_id, r.Age, r.TimePoint) for r in out.collect()} == {("10", 29.0, "baseline"), ("20", 29.0, "3 months"), ("30", 0.0, 'a<b & "c"')}
    with pytest.raises(ValueError):
        datasets.meta_add_sheets(meta, [found["people"]])


def test_workbook_columns_and_shared_strings():
    assert [workbook.column_number(x) for x in ("A1", "Z9", "AA3", "BC12")] == [0, 25, 26, 54]
    assert all(workbook.column_number(workbook.column_name(k)) == k for k in range(2000))


def test_page(spark):
    g = grid(spark, {"a": [1, 2, 1], "</script>": [0, 1, 0], "c": [5, 5, 5]})
    text = pages.page(g, ["a", "</script>"], "x<y")
    assert '"id": "a"' in text and '"id": "c"' not in text and text.count("</script>") == 1 and "x&lt;y" in text


def test_page_is_not_cut(spark, monkeypatch):
    monkeypatch.setattr(pages, "POINTS", 2)
    with pytest.raises(ValueError):
        pages.page(grid(spark, {"a": [1, 2, 1]}), ["a"])


def test_splits(spark):
    groups = spark.createDataFrame([(s,) for s in "aabbccdd"], "group string")
    found = model.checked_splits(model.subsample(groups, 2, 0.25), "iteration")
    assert found.where("role = 'test'").groupBy("iteration").count().select("count").distinct().first()[0] == 1
    with pytest.raises(ValueError, match="empty"):
        model.checked_splits(model.subsample(groups.limit(2), 1, 0.25), "iteration")
    with pytest.raises(ValueError, match="both"):
        model.checked_splits(found.unionByName(found.where("role = 'test'").withColumn("role", F.lit("train"))), "iteration")
    for size in (0, 1, 1.5):
        with pytest.raises(ValueError):
            model.subsample(groups, 1, size)


def test_noise_threshold(spark):
    values = [0, 1, 2, 1, 0, 2, 1, 0, 1, 2, 1, 0]
    one = grid(spark, {"a": values})
    assert spectra.threshold(one, (1.0, 13.0)).first()[0] == pytest.approx(statistics.mean(values) + 3 * statistics.stdev(values))
    two = grid(spark, {"a": values, "b": [2 * v for v in values]})
    each = [(v * 1.5, statistics.stdev([v, 2 * v])) for v in values]
    assert spectra.threshold(two, (1.0, 13.0)).first()[0] == pytest.approx(statistics.mean(m for m, _ in each) + 3 * statistics.mean(s for _, s in each))
    for method in ("mean3sd", "median3mad"):
        with pytest.raises(Exception, match="fewer than 10"):
            spectra.threshold(one, (1.0, 10.0), method).collect()


def listed(spark, rows):
    return spark.createDataFrame([(f"p{k}", s, float(x)) for k, (s, x) in enumerate(rows)], "peak_id string, sample_id string, ppm double")


def test_components_over_buckets(spark):
    rows = [("a", x) for x in (0.0, 0.4, 0.8, 70.0, 70.0, 70.9, 71.95, 200.0)] + [("b", 1000.5), ("b", 1001.4), ("a", -3.0)]
    got = {r.peak_id: r.component for r in peaks.gap_components(listed(spark, rows), 1.0).collect()}
    assert [got[f"p{k}"] for k in range(len(rows))] == [1, 1, 1, 2, 2, 2, 3, 4, 5, 5, 0]
    by = {r.peak_id: r.component for r in peaks.gap_components(listed(spark, rows), 1.0, "sample_id").collect()}
    assert [by[f"p{k}"] for k in range(len(rows))] == [1, 1, 1, 2, 2, 2, 3, 4, 0, 0, 0]


def test_number_of_clusters(spark):
    rows = listed(spark, [("s1", 1.000), ("s1", 2.000), ("s2", 1.001), ("s2", 2.002), ("s3", 2.009)])
    assert peaks.cluster_bounds(rows).first() == (2, 5)
    table = [(r.max_ppb, r.clusters) for r in peaks.linkage_table(rows, [20.0, 0.5, 5.0]).orderBy("max_ppb").collect()]
    assert table == [(0.5, 5), (5.0, 3), (20.0, 2)]
    assert peaks.linkage_to(rows, 3, [0.5, 5.0, 20.0]).select("cluster").distinct().count() == 3
    with pytest.raises(ValueError):
        peaks.linkage_to(rows, 1, [5.0])


def test_reference_sample_by_hand(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 10), ("b", 1), ("b", 11), ("c", 4), ("c", 30), ("c", 4)], "sample_id string, pos int")
    lists = {"a": [0, 10], "b": [1, 11], "c": [4, 30, 4]}
    want = {s: sum(min(abs(p - q) for q in own) for o, other in lists.items() if o != s for p in other) for s, own in lists.items()}
    assert {r.sample_id: r.distance for r in peaks.reference_sample(rows).collect()} == want


def test_widest_gap(spark):
    at = lambda v: model.gap_threshold(spark.createDataFrame([(float(x),) for x in v], "x double")).first()[0]
    assert at([*range(1, 20), 100]) == 59.5 and math.isinf(at([1, 2, 3, 10])) and at([4, 4, 4]) == 4


def test_no_growing_table_in_one_task(spark):
    """What one task sees of all rows is an aggregate by place, bucket or sample."""
    rows = listed(spark, [("a", 1.0)])
    for df in (peaks.gap_components(rows, 1.0), model.gap_threshold(rows, "ppm")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for line in plan.split("Exchange SinglePartition")[1:]:
            assert "HashAggregate" in line[:400] or "Project" in line[:400]


def test_profiling_inputs(spark):
    lookup = spark.createDataFrame([("a,b", 1.5, "2", None, 1.0)], "metabolite string, position double, couple_code string, j double, intensity double")
    row = tables.multiplets(lookup).first()
    assert row["Metabolite"] == "a_b" and row["J_constant"] == 0.0
