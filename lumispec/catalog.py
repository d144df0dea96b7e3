"""All registered queries of the library and the DuckDB SQL that must give the same rows.

The driver's tables stand in for spectra: embeddings are gridded spectra with a class, events are irregular ones,
lineitem is a peak table, part a list of peak positions and a look-up table, the rest is metadata.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import natural_key, rounded
from .operators import analysis, datasets, model, peaks, spectra
from .sources import tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def grid(spark, sf: str) -> DataFrame:
    df = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.transform("embedding", lambda v: F.lit(1.0) + v.cast("double")).alias("intensity"))
    return spectra.from_arrays(df, (F.col("idx") + 2) / F.lit(10.0))


def classes(spark, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), "label")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


#: The same spectra in SQL, and those without the excluded region.
G = """with g as (select sample_id, idx::int as idx, (idx + 2)::double / 10.0::double as ppm, 1.0::double + v::double as intensity, label
  from (select vec_id as sample_id, label, unnest(embedding) as v, unnest(range(len(embedding))) as idx from embeddings)),
x as (select * from g where not (ppm between 4.7::double and 5.0::double))"""
WATER = {"water": (4.7, 5.0)}
REGIONS = {"a": (0.5, 1.5), "b": (2.0, 3.0), "c": (5.2, 6.5)}
REGION_ROWS = "(values ('a', 0.5::double, 1.5::double), ('b', 2.0::double, 3.0::double), ('c', 5.2::double, 6.5::double)) r(region, lo, hi)"

PQN = """, area0 as (select sample_id, sum(intensity) as s from x group by 1),
area as (select sample_id, s / (select median(s) from area0) as a from area0),
y0 as (select x.*, intensity / a as y, a from x join area using (sample_id)),
y1 as (select *, y - least((select min(y) from y0), 0) as ys from y0),
med as (select idx, median(ys) as m from y1 group by 1),
f as (select sample_id, median(ys / m) * any_value(a) as factor from y1 join med using (idx) group by 1)"""


@query(G + PQN + f""", n as (select x.sample_id, label, ppm, intensity / factor as y from x join f using (sample_id)),
i as (select sample_id, any_value(label) as label, region, sum(y) * 0.1::double as area from n join {REGION_ROWS} on ppm >= lo and ppm < hi group by 1, 3)
select label, region, count(*)::bigint as n, round(avg(area), 6) as mean_area from i group by 1, 2""")
def flagship(spark, sf):
    s = spectra.normalize(spectra.exclude_regions(grid(spark, sf), WATER), "pqn")
    out = spectra.integrate(s, REGIONS).join(classes(spark, sf), "sample_id")
    return out.groupBy("label", "region").agg(F.count("*").alias("n"), r6(F.avg("area"), "mean_area"))


@query(G + "select sample_id, idx, ppm, intensity, label from g where ppm between 1.0::double and 2.0::double")
def tidy_range(spark, sf):
    return spectra.tidy(grid(spark, sf), classes(spark, sf), (1.0, 2.0))


@query(G + "select sample_id, idx, ppm, intensity from g where idx % 3 = 0 and ppm between 1.0::double and 5.0::double")
def tidy_decimated(spark, sf):
    return spectra.tidy(grid(spark, sf), None, (1.0, 5.0), every=3)


@query(G + "select sample_id, idx, ppm, intensity from x")
def exclude_region(spark, sf):
    return spectra.exclude_regions(grid(spark, sf), WATER)


@query(G + "select sample_id, idx, ppm, intensity from g where label in (1, 3)")
def filter_meta_semi(spark, sf):
    return spectra.filter_samples(grid(spark, sf), classes(spark, sf), "label in (1, 3)")


@query("select c_custkey, c_mktsegment, n_name, r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def meta_left_chain(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    n = table(spark, sf, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    first = spectra.meta_join([c, n], "n_nationkey")
    return spectra.meta_join([first, table(spark, sf, "region")], "r_regionkey").select("c_custkey", "c_mktsegment", "n_name", "r_name")


@query("""select c_custkey, o_orderkey, o_orderpriority from customer left join
  (select o_custkey, o_orderkey, o_orderpriority from orders qualify row_number() over (partition by o_custkey order by o_orderkey) = 1) on c_custkey = o_custkey""")
def meta_add_dedupe(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority", F.col("o_orderkey").alias("ordinal"))
    return spectra.meta_add(table(spark, sf, "customer").select("c_custkey"), o, "c_custkey", "ordinal")


@query("""select count(*) filter (where d.lang is distinct from s.lang)::bigint as lang_conflicts, count(*) filter (where d.source is distinct from s.source)::bigint as source_conflicts
from documents d left join (select doc_id, lang, case when doc_id % 3 = 0 then 'other' else source end as source from documents where doc_id % 2 = 0) s using (doc_id)""")
def meta_conflict_count(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    half = d.where("doc_id % 2 = 0").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "other").otherwise(F.col("source")))
    return spectra.conflicts(d, half, "doc_id", ["lang", "source"])


@query("""select name, row_number() over (order by key)::bigint as position from (select name, array_to_string(list_transform(regexp_extract_all(name, '(\\d+|\\D+)'), lambda t: case when regexp_matches(t, '^\\d') then lpad(t::varchar, 20, '0') else t end), '') as key
  from (select distinct 'x' || s_suppkey || 'b' || s_nationkey as name from supplier))""")
def natural_sort(spark, sf):
    names = table(spark, sf, "supplier").select(F.concat(F.lit("x"), F.col("s_suppkey").cast("string"), F.lit("b"), F.col("s_nationkey").cast("string")).alias("name")).distinct()
    return names.select("name", F.row_number().over(Window.orderBy(natural_key(F.col("name")))).cast("long").alias("position"))


@query(G + ", d as (select sample_id, abs(ppm - lag(ppm) over (partition by sample_id order by idx)) as s from x) select sample_id, round(median(s), 6) as resolution from d group by 1")
def ppm_resolution(spark, sf):
    return spectra.resolution(spectra.exclude_regions(grid(spark, sf), WATER)).select("sample_id", r6(F.col("resolution"), "resolution"))


@query("""with e as (select user_id, epoch_us(ts) / 1000000.0::double as t from events),
s as (select user_id, min(t) as lo, max(t) as hi, median(d) as step from (select *, abs(t - lag(t) over (partition by user_id order by t)) as d from e) group by 1)
select round(max(lo), 3) as lo, round(min(hi), 3) as hi, round(min(step), 3) as step from s""")
def axis_infer(spark, sf):
    raw = table(spark, sf, "events").select(F.col("user_id").alias("sample_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("x"))
    return spectra.axis_bounds(raw).select(F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"), F.round("by", 3).alias("step"))


def norm_sql(factor: str) -> str:
    return G + f", f0 as ({factor}), f as (select sample_id, factor / (select median(factor) from f0) as r from f0) select sample_id, idx, round(intensity / r, 6) as intensity from g join f using (sample_id)"


def normed(s, method, **how):
    return spectra.normalize(s, method, **how).select("sample_id", "idx", r6(F.col("intensity"), "intensity"))


@query(norm_sql("select sample_id, sum(intensity) as factor from g group by 1"))
def norm_area(spark, sf):
    return normed(grid(spark, sf), "area")


@query(norm_sql("select sample_id, max(intensity) as factor from g group by 1"))
def norm_max(spark, sf):
    return normed(grid(spark, sf), "max")


@query(norm_sql("select vec_id as sample_id, 1.0::double + label as factor from embeddings"))
def norm_value(spark, sf):
    return normed(grid(spark, sf), "value", values=classes(spark, sf).select("sample_id", (1.0 + F.col("label")).alias("value")))


@query(norm_sql("select sample_id, sum(intensity) as factor from g where ppm between 2.0::double and 3.0::double group by 1"))
def norm_region(spark, sf):
    return normed(grid(spark, sf), "region", regions=(2.0, 3.0))


@query(G + PQN + " select sample_id, idx, round(intensity / factor, 6) as intensity from x join f using (sample_id)")
def norm_pqn(spark, sf):
    return normed(spectra.exclude_regions(grid(spark, sf), WATER), "pqn")


@query(G + PQN + " select sample_id, round(factor, 6) as factor, round(factor / (select median(factor) from f), 6) as relative from f")
def norm_factors(spark, sf):
    return spectra.factors(spectra.exclude_regions(grid(spark, sf), WATER), "pqn").select("sample_id", r6(F.col("factor"), "factor"), r6(F.col("relative"), "relative"))


@query(G + ", t as (select idx, avg(intensity) as m, stddev_samp(intensity) as s from g where ppm >= 5.2::double and ppm < 6.5::double group by 1) select round(avg(m) + 3 * avg(s), 6) as threshold from t")
def threshold_mean3sd(spark, sf):
    return spectra.threshold(grid(spark, sf), (5.2, 6.5)).select(r6(F.col("threshold"), "threshold"))


@query(G + ", p as (select * from g where ppm >= 5.2::double and ppm < 6.5::double), m as (select sample_id, median(intensity) as m from p group by 1) select sample_id, round(any_value(m) + 3 * 1.4826::double * median(abs(intensity - m)), 6) as threshold from p join m using (sample_id) group by 1")
def threshold_median3mad(spark, sf):
    return spectra.threshold(grid(spark, sf), (5.2, 6.5), "median3mad").select("sample_id", r6(F.col("threshold"), "threshold"))


def integrate_sql(value: str, source: str = "x", null_if: str = "false") -> str:
    return G + f""", p as (select sample_id, region, idx, ppm, intensity, ppm - lag(ppm) over w as d, row_number() over w as k, count(*) over (partition by sample_id, region) as n,
  first_value(intensity) over w as y1, last_value(intensity) over (partition by sample_id, region order by idx rows between unbounded preceding and unbounded following) as yn
  from {source} join {REGION_ROWS} on ppm >= lo and ppm < hi window w as (partition by sample_id, region order by idx)),
l as (select *, y1 + (yn - y1) * (k - 1) / greatest(n - 1, 1) as line from p)
select sample_id, region, case when {null_if} then null else round(sum({value}) * 0.1::double, 6) end as area from l group by 1, 2"""


@query(integrate_sql("intensity", "g"))
def integrate_regions(spark, sf):
    return spectra.integrate(grid(spark, sf), REGIONS).select("sample_id", "region", r6(F.col("area"), "area"))


@query(integrate_sql("intensity - line", "g"))
def integrate_fix_baseline(spark, sf):
    return spectra.integrate(grid(spark, sf), REGIONS, fix_baseline=True).select("sample_id", "region", r6(F.col("area"), "area"))


@query(integrate_sql("intensity - least(line, intensity)", "g"))
def integrate_clip(spark, sf):
    return spectra.integrate(grid(spark, sf), REGIONS, fix_baseline=True, clip=True).select("sample_id", "region", r6(F.col("area"), "area"))


@query(integrate_sql("intensity", "(select * from g where not (ppm between 2.3::double and 2.7::double))", "coalesce(max(d), 0) >= 0.3::double - 1e-6"))
def integrate_gap_null(spark, sf):
    return spectra.integrate(spectra.exclude_regions(grid(spark, sf), {"w": (2.3, 2.7)}), REGIONS).select("sample_id", "region", r6(F.col("area"), "area"))


@query(G + """ select sample_id, 'ppm_' || printf('%.4f', p) as region, round(sum(intensity) * 0.1::double, 6) as area
from g join (values (1.05::double), (3.25::double)) q(p) on ppm >= p - 0.3::double and ppm < p + 0.3::double group by sample_id, p""")
def peak_positions(spark, sf):
    return spectra.integrate_positions(grid(spark, sf), [1.05, 3.25], 0.6).select("sample_id", "region", r6(F.col("area"), "area"))


@query(G + """, p as (select * from g where sample_id = (select min(sample_id) from g) and ppm > 1.0::double and ppm < 3.0::double),
t as (select arg_max(ppm, intensity) as tx, max(intensity) as ty from p)
select round(arg_min(2 * abs(ppm - tx), abs(intensity - ty / 2)), 6) as width from p, t where ppm > tx""")
def peak_width_halfmax(spark, sf):
    return spectra.peak_width(grid(spark, sf), (1.0, 3.0)).select(r6(F.col("width"), "width"))


MAXIMA = """, nb as (select *, lag(intensity) over w as l, lead(intensity) over w as r from g window w as (partition by sample_id order by idx)),
pk as (select sample_id, ppm, idx as pos, intensity from nb where intensity > l and intensity > r and intensity > 1.1::double)"""


def found(spark, sf):
    return peaks.local_maxima(grid(spark, sf), 1.1)


@query(G + MAXIMA + " select sample_id, ppm, pos, intensity from pk")
def local_max_peaks(spark, sf):
    return found(spark, sf)


IDS = MAXIMA + ", ids as (select *, 'Peak' || lpad(cast(row_number() over (order by sample_id, pos) as varchar), length(cast((select count(*) from pk) as varchar))::int, '0') as peak_id from pk)"


@query(G + IDS + " select peak_id, sample_id, pos from ids")
def peak_ids(spark, sf):
    return peaks.with_ids(found(spark, sf)).select("peak_id", "sample_id", "pos")


def priced(spark, sf):
    return table(spark, sf, "lineitem").select(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("peak_id"), F.col("l_suppkey").alias("sample_id"), F.col("l_quantity").alias("ppm"), F.col("l_extendedprice").alias("area"), F.col("l_discount").alias("norm_rmse"), (F.col("l_quantity") - 1).alias("ppm_infl_min"), (F.col("l_quantity") + 1).alias("ppm_infl_max"))


PRICED = "with p as (select l_orderkey || '_' || l_linenumber as peak_id, l_suppkey as sample_id, l_quantity as ppm, l_extendedprice as area, l_discount as norm_rmse from lineitem)"


@query(PRICED + " select peak_id, (area between 1000 and 30000 and ppm between 5 and 40 and norm_rmse <= 0.05::double) as accepted from p")
def accept_flag(spark, sf):
    return peaks.accept(priced(spark, sf), 0.05, (1000.0, 30000.0), (5.0, 40.0), keep_rejected=True).select("peak_id", "accepted")


@query(PRICED + " select peak_id, sample_id, ppm, area from p where area between 1000 and 30000 and ppm between 5 and 40 and norm_rmse <= 0.05::double")
def accept_filter(spark, sf):
    return peaks.accept(priced(spark, sf), 0.05, (1000.0, 30000.0), (5.0, 40.0)).select("peak_id", "sample_id", "ppm", "area")


@query(PRICED + " select peak_id from p where not (ppm - 1 <= 12 and ppm + 1 >= 10)")
def excluded_overlap(spark, sf):
    return peaks.accept(priced(spark, sf), 1e9, excluded={"w": (10.0, 12.0)}).select("peak_id")


@query(PRICED + " select sample_id, ppm, area from p qualify count(*) over (partition by sample_id, ppm) = 1 or area = max(area) over (partition by sample_id, ppm)")
def dedupe_same_inflection(spark, sf):
    return peaks.one_per_span(priced(spark, sf).withColumn("intensity", F.col("area"))).select("sample_id", "ppm", "area")


@query(G + MAXIMA + " select sample_id, ceil(ppm / 0.5::double)::bigint as bin, count(*)::bigint as n from pk group by 1, 2")
def peaks_overview_bins(spark, sf):
    return peaks.overview(found(spark, sf), 0.5)


@query(G + MAXIMA + " select t as threshold, round_even(ppm / 0.5::double, 0) * 0.5::double as region, count(*)::bigint as n from pk, (values (1.1::double), (1.2::double), (1.3::double)) v(t) where intensity > t group by 1, 2")
def tune_snr_regions(spark, sf):
    return peaks.tune(found(spark, sf).withColumn("snr", F.col("intensity")), [1.1, 1.2, 1.3])


@query(G + MAXIMA + " select e.vec_id as sample_id, coalesce(string_agg(cast(pos as varchar), ',' order by pos), '') as positions from embeddings e left join pk on pk.sample_id = e.vec_id group by 1")
def peaklist_collect(spark, sf):
    return peaks.collected(classes(spark, sf), found(spark, sf)).select("sample_id", F.array_join("positions", ",").alias("positions"))


SAVGOL_M = sum(i * i for i in range(-10, 11)) / 21
SAVGOL_N = sum((i * i - SAVGOL_M) ** 2 for i in range(-10, 11))
SAVGOL = ", sg as (select *, (" + " + ".join(f"{'lag' if i < 0 else 'lead'}(intensity, {abs(i)}) over w * {2 * (i * i - SAVGOL_M) / SAVGOL_N!r}::double" for i in range(-10, 11)) + ") / power(nth_value(ppm, 2) over v - first_value(ppm) over v, 2) as d2 from g window w as (partition by sample_id order by idx), v as (partition by sample_id order by idx rows between unbounded preceding and unbounded following))"


@query(G + SAVGOL + " select sample_id, idx, round(d2, 6) as d2 from sg")
def savgol_d2(spark, sf):
    return spectra.savgol_second(grid(spark, sf)).select("sample_id", "idx", r6(F.col("d2"), "d2"))


BOUNDS = MAXIMA + SAVGOL + """, cr as (select *, lag(d2) over w as pd, lag(ppm) over w as pp from sg window w as (partition by sample_id order by idx)),
cx as (select *, case when sign(d2) * sign(pd) < 0 then pp + (ppm - pp) * pd / (pd - d2) end as z from cr),
bd as (select sample_id, idx as pos, last_value(z ignore nulls) over (partition by sample_id order by idx rows between unbounded preceding and current row) as a,
  first_value(z ignore nulls) over (partition by sample_id order by idx rows between 1 following and unbounded following) as b from cx)"""


def bounded(spark, sf):
    return peaks.inflections(grid(spark, sf), found(spark, sf))


@query(G + BOUNDS + " select pk.sample_id, pos, round(least(a, b), 6) as ppm_infl_min, round(greatest(a, b), 6) as ppm_infl_max from pk left join bd using (sample_id, pos)")
def inflection_bounds(spark, sf):
    return bounded(spark, sf).select("sample_id", "pos", r6(F.col("ppm_infl_min"), "ppm_infl_min"), r6(F.col("ppm_infl_max"), "ppm_infl_max"))


@query(G + BOUNDS + " select pk.sample_id, pos, round(pi() * sqrt(3::double) / 2 * (greatest(a, b) - least(a, b)) * intensity, 6) as area from pk left join bd using (sample_id, pos)")
def lorentz_area_intensity(spark, sf):
    return bounded(spark, sf).select("sample_id", "pos", r6(F.col("area"), "area"))


@query(G + MAXIMA + ", nr as (select b.sample_id, a.sample_id as other, a.pos as pa, min(abs(a.pos - b.pos)) as d from pk a join pk b on a.sample_id <> b.sample_id group by 1, 2, 3) select sample_id, sum(d)::double as distance from nr group by 1")
def find_reference(spark, sf):
    return peaks.reference_sample(found(spark, sf))


def listed(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("peak_id"), F.col("p_brand").alias("sample_id"), F.col("p_retailprice").alias("ppm"), F.col("p_size").cast("double").alias("area"))


GAPS = """with p as (select cast(p_partkey as varchar) as peak_id, p_brand as sample_id, p_retailprice as ppm, p_size::double as area from part),
c as (select *, sum(case when d >= 0.35::double then 1 else 0 end) over (order by ppm, peak_id rows unbounded preceding) as component from (select *, ppm - lag(ppm) over (order by ppm, peak_id) as d from p))"""


@query(GAPS + " select peak_id, component::bigint as component from c")
def cluster_gap_components(spark, sf):
    return peaks.gap_components(listed(spark, sf), 0.35).select("peak_id", "component")


@query(GAPS + " select component::bigint as component, round_even(median(ppm), 2) as ppm_ref, count(*)::bigint as n from c group by 1")
def cluster_ppm_ref(spark, sf):
    parts = peaks.gap_components(listed(spark, sf), 0.35)
    return parts.groupBy("component").agg(F.bround(F.median("ppm"), 2).alias("ppm_ref"), F.count("*").alias("n"))


@query(PRICED + " select peak_id from p qualify count(*) over (partition by sample_id, ppm) > 1")
def cluster_ambiguous(spark, sf):
    return peaks.ambiguous(priced(spark, sf).withColumn("ppm_ref", F.col("ppm")))[1].select("peak_id")


@query("select l_suppkey as sample_id, " + ", ".join(f"round(sum(l_extendedprice) filter (where p_size = {k}), 4) as \"s{k}\"" for k in (1, 2, 3)) + " from lineitem join part on l_partkey = p_partkey group by 1")
def build_peak_table_pivot(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("sample_id"), F.col("p_size").alias("ppm_ref"), F.col("l_extendedprice").alias("area"))
    out = peaks.peak_table(rows, rows.select("sample_id").distinct(), [1, 2, 3])
    return out.select("sample_id", *[F.round(str(k), 4).alias(f"s{k}") for k in (1, 2, 3)])


@query("""select coalesce(a.k, b.k) as cluster, a.x as left_ppm, b.x as right_ppm, case when b.k is null then 'left' when a.k is null then 'right' else 'both' end as found
from (select p_partkey as k, p_retailprice as x from part where p_partkey % 2 = 0) a full join (select p_partkey as k, p_size::double as x from part where p_partkey % 3 = 0) b on a.k = b.k""")
def compare_two_full_outer(spark, sf):
    p = table(spark, sf, "part")
    left = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("cluster"), F.col("p_retailprice").alias("ppm"))
    right = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("cluster"), F.col("p_size").cast("double").alias("ppm"))
    return peaks.compare(left, right, "cluster")


@query("""with q as (select distinct p_size::double * 30 + 900 as ppm from part), m as (select ppm, p_partkey, p_retailprice, row_number() over (partition by ppm order by p_partkey) as nth
  from q join part on p_retailprice > ppm - 3 and p_retailprice < ppm + 3), n as (select ppm, k from q, (values (1), (2), (3)) v(k))
select n.ppm, k as nth, p_partkey as ordinal, p_retailprice as shift from n left join m on m.ppm = n.ppm and m.nth = n.k""")
def identify_range_topn(spark, sf):
    p = table(spark, sf, "part")
    return peaks.identify(p.select((F.col("p_size").cast("double") * 30 + 900).alias("ppm")), p.select(F.col("p_partkey").alias("ordinal"), F.col("p_retailprice").alias("shift")), 3, 3.0)


@query(G + " select idx, any_value(ppm) as ppm, round(quantile_cont(intensity, 0.1), 6) as q10, round(quantile_cont(intensity, 0.5), 6) as q50, round(quantile_cont(intensity, 0.9), 6) as q90 from g group by 1")
def quantile_spectra(spark, sf):
    q = spectra.quantile_spectra(grid(spark, sf), [0.1, 0.5, 0.9])
    return q.select("idx", "ppm", *[r6(F.col(c), c) for c in ("q10", "q50", "q90")])


@query("""with v as (select c_acctbal as x from customer), s as (select x, lead(x) over (order by x) - x as gap, row_number() over (order by x) as k, count(*) over () as n from v),
t as (select arg_max(x + gap / 2, gap) as t from s) select case when (select count(*) from v, t where x > t) > 0.1 * (select count(*) from v) then null else round(t, 6) end as threshold from t""")
def gap_threshold(spark, sf):
    return model.gap_threshold(table(spark, sf, "customer").select(F.col("c_acctbal").alias("x"))).select(F.when(F.col("threshold") < float("inf"), F.round("threshold", 6)).alias("threshold"))


@query("""with v as (select row_number() over (order by s desc) as comp, s from (select sum(l_extendedprice) as s from lineitem join part on l_partkey = p_partkey group by p_brand)),
c as (select comp, 100 * sum(s) over (order by comp) / sum(s) over () as cum from v) select comp::int as comp, round(cum, 6) as cum from c""")
def cum_variance(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum("l_extendedprice").alias("variance"))
    return model.cumulative(rows.select(F.row_number().over(Window.orderBy(F.desc("variance"))).alias("comp"), "variance")).select("comp", r6(F.col("cumulative"), "cum"))


@query("""with g as (select distinct o_custkey as grp from orders), k as (select grp, it, row_number() over (partition by it order by md5(grp || '_' || it || '_7'), grp) as r, count(*) over (partition by it) as n from g, (values (0), (1), (2)) v(it))
select it::int as iteration, grp as "group", case when r <= floor(n * 0.25::double) then 'test' else 'train' end as role from k""")
def subsample_groups(spark, sf):
    groups = table(spark, sf, "orders").select(F.col("o_custkey").alias("group"))
    return model.subsample(groups, 3, 0.25, seed=7)


AUCS = "with a as (select o_custkey % 50 as fold, (o_orderkey % 6)::int as ncomp, avg(o_totalprice) / 500000::double as auc from orders group by 1, 2)"


def aucs(spark, sf):
    return table(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("fold"), (F.col("o_orderkey") % 6).cast("int").alias("ncomp")).agg((F.avg("o_totalprice") / 500000).alias("auc"))


@query(AUCS + """, d as (select *, lead(auc) over (partition by fold order by ncomp) - auc as inc, row_number() over (partition by fold order by ncomp) as r from a)
select fold, coalesce(min(ncomp) filter (where inc < 0.01::double), max(ncomp))::int as ncomp from d group by 1""")
def choose_ncomp(spark, sf):
    return model.choose_ncomp(aucs(spark, sf), 0.01, "fold")


@query(AUCS + """, r as (select fold, ncomp, rank() over (partition by fold order by auc desc) + (count(*) over (partition by fold, auc) - 1) / 2.0 as rk from a)
select ncomp, round(exp(avg(ln(rk))), 6) as rank_product from r group by 1""")
def rank_product(spark, sf):
    return model.rank_product(aucs(spark, sf).select("fold", F.col("ncomp").alias("feature"), F.col("auc").alias("vip")), "fold").select(F.col("feature").alias("ncomp"), r6(F.col("rank_product"), "rank_product"))


@query(G + ", l as (select label as model, idx as feature, avg(intensity) as w from g group by 1, 2) select a.model as m1, b.model as m2, round(sum(a.w * b.w), 6) as dot from l a join l b using (feature) group by 1, 2")
def stability_dot(spark, sf):
    loads = grid(spark, sf).join(classes(spark, sf), "sample_id").groupBy(F.col("label").alias("model"), F.col("idx").alias("feature")).agg(F.avg("intensity").alias("weight"))
    return model.stability(loads).select("m1", "m2", r6(F.col("dot"), "dot"))


@query("with c as (select quality as r, toxic as p, count(*) as n from labels group by 1, 2) select r as class, round(sum(case when r = p then n else 0 end) / (select sum(n) from c)::double, 6) as accuracy from c group by 1")
def accuracy_by_class(spark, sf):
    return model.class_accuracy(table(spark, sf, "labels"), "quality", "toxic").select("class", r6(F.col("accuracy"), "accuracy"))


@query("select round(avg(case when o_totalprice <= 100000 then 1.0::double else 0 end), 6) as p from orders")
def perm_pvalue(spark, sf):
    return model.ecdf(table(spark, sf, "orders"), "o_totalprice", 100000.0).select(r6(F.col("p"), "p"))


@query("select o_orderkey, o_custkey from orders qualify count(*) over (partition by o_custkey) = 10")
def complete_subjects(spark, sf):
    return spectra.complete(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 10)


@query("select l_partkey % 40 as feature from lineitem group by 1 having count(distinct l_linenumber) = 7")
def feature_intersection(spark, sf):
    return model.in_all(table(spark, sf, "lineitem").select((F.col("l_partkey") % 40).alias("feature"), F.col("l_linenumber").alias("fold")), "feature", "fold", 7)


# Whole sets: checks, accessors, unions, exports that are read back.


@query(G + " select g.sample_id, idx, intensity from g join (select vec_id as sample_id, row_number() over (order by vec_id desc) - 1 as k from embeddings) o using (sample_id) where k in (0, 2, 3, 5, 8, 13, 21, 34, 55, 89)")
def positional_subset(spark, sf):
    order = classes(spark, sf).select("sample_id", (-F.col("sample_id")).alias("back"))
    return datasets.subset(grid(spark, sf), order, [0, 2, 3, 5, 8, 13, 21, 34, 55, 89], "back").select("sample_id", "idx", "intensity")


@query("select region, lo, hi from (values ('water', 4.7::double, 5.0::double), ('edge', 0.1::double, 0.4::double)) r(region, lo, hi)")
def excluded_regions(spark, sf):
    return datasets.Excluding(grid(spark, sf)).exclude(WATER).exclude({"edge": (0.4, 0.1)}).excluded()


@query("with b as (select l_suppkey as sample_id, l_linenumber as idx, count(*) as n, count(distinct l_extendedprice) as p from lineitem group by 1, 2) select 'repeated point' as problem, sum(n - 1)::bigint as n from b having sum(n - 1) > 0 union all select 'position with several places', count(*) from (select l_linenumber from lineitem group by 1 having count(distinct l_extendedprice) > 1) having count(*) > 0 union all select 'position that samples lack', count(*) from (select l_linenumber from lineitem group by 1 having count(distinct l_suppkey) < (select count(distinct l_suppkey) from lineitem)) having count(*) > 0 union all select 'metadata without spectrum', count(*) from supplier where s_suppkey not in (select l_suppkey from lineitem) having count(*) > 0")
def set_problems(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample_id"), F.col("l_linenumber").alias("idx"), F.col("l_extendedprice").alias("ppm"), F.lit(1.0).alias("intensity"))
    return datasets.problems(rows, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id")))


@query(G + " select count(distinct sample_id) as samples, count(distinct idx) as points, min(ppm) as ppm_min, max(ppm) as ppm_max from g")
def set_summary(spark, sf):
    return datasets.summary(grid(spark, sf))


@query(G + " select sample_id, idx, ppm, round(intensity * 2, 6) as intensity from g")
def matrix_replaced(spark, sf):
    g = grid(spark, sf)
    out = datasets.with_matrix(g, g.select("sample_id", "idx", (F.col("intensity") * 2).alias("value")))
    return out.select("sample_id", "idx", "ppm", r6(F.col("intensity"), "intensity"))


@query("select s_suppkey as sample_id, s_name, n_name from supplier left join nation on s_nationkey = n_nationkey")
def meta_groups_chosen(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    groups = {"own": s.select(F.col("s_suppkey").alias("sample_id"), "s_name"), "money": s.select(F.col("s_suppkey").alias("sample_id"), "s_acctbal"), "place": s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("sample_id"), "n_name")}
    return datasets.meta_get(groups, names=["own", "place"])


@query("select doc_id as sample_id, lang, source, quality, toxic, item from documents left join labels using (doc_id) left join (select item_id as doc_id, text as item from benchmark) using (doc_id)")
def meta_by_sheets(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), "lang", "source")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), "quality", "toxic", F.col("doc_id").alias("_row"))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("sample_id"), F.col("text").alias("item"), F.col("item_id").alias("_row"))
    return datasets.meta_add_sheets(d, [labels, labels.limit(0), items])


@query("select distinct o_custkey % 400 as k from orders except select distinct c_custkey % 350 from customer")
def set_difference(spark, sf):
    return datasets.without(table(spark, sf, "orders").select((F.col("o_custkey") % 400).alias("k")), table(spark, sf, "customer").select((F.col("c_custkey") % 350).alias("k")), "k")


@query("select 'part' as origin, p_partkey as id, p_name as name, null::double as balance from part union all select 'supplier', s_suppkey, s_name, s_acctbal from supplier")
def union_named(spark, sf):
    return datasets.union({"part": table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "supplier": table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))}).select("origin", "id", "name", "balance")


@query("select s_suppkey as sample_id, s_name, round(sum(l_extendedprice), 2) as area from supplier left join lineitem on l_suppkey = s_suppkey group by 1, 2")
def table_with_metadata(spark, sf):
    areas = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("area"))
    return tables.with_metadata(areas, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id"), "s_name"))


@query("select p_brand as cluster, max(p_retailprice) - min(p_retailprice) as range from part group by 1")
def cluster_ranges(spark, sf):
    return peaks.cluster_ranges(table(spark, sf, "part").select(F.col("p_brand").alias("cluster"), F.col("p_retailprice").alias("ppm")))


@query("select max(r) as range from (select max(p_retailprice) - min(p_retailprice) as r from part group by p_brand)")
def cluster_widest(spark, sf):
    return peaks.widest_cluster(table(spark, sf, "part").select(F.col("p_brand").alias("cluster"), F.col("p_retailprice").alias("ppm")))


@query(G + MAXIMA + " select max(n)::bigint as least, sum(n)::bigint as most from (select count(*) as n from pk group by sample_id)")
def cluster_number_bounds(spark, sf):
    return peaks.cluster_bounds(found(spark, sf))


@query("select p_brand as sample_id, string_agg(cast(p_partkey as varchar), ',' order by cast(p_partkey as varchar)) as peak_ids from part group by 1")
def peak_ids_of_samples(spark, sf):
    return peaks.ids_of_samples(listed(spark, sf)).select("sample_id", F.array_join("peak_ids", ",").alias("peak_ids"))


@query("select p_brand as sample_id, p_size::double as ppm_ref, string_agg(cast(p_partkey as varchar), ',' order by cast(p_partkey as varchar)) as peak_ids from part group by 1, 2 having count(*) > 1")
def ambiguous_cells(spark, sf):
    cells = peaks.ambiguous_cells(listed(spark, sf).withColumn("ppm_ref", F.col("area")))
    return cells.select("sample_id", "ppm_ref", F.array_join("peak_ids", ",").alias("peak_ids"))


@query(G + BOUNDS + " select pk.sample_id, pos, round(-pi() / 2 * pow(sqrt(3::double) / 2 * (greatest(a, b) - least(a, b)), 3) * d2, 6) + 0.0::double as area from pk left join bd using (sample_id, pos) left join sg on sg.sample_id = pk.sample_id and sg.idx = pos")
def lorentz_area_curvature(spark, sf):
    out = peaks.inflections(grid(spark, sf), found(spark, sf), amplitude="second_derivative")
    return out.select("sample_id", "pos", (F.round("area", 6) + F.lit(0.0)).alias("area"))  # no negative zeros


@query(G + BOUNDS + """, low as (select sample_id, min(intensity) as low from g group by 1)
select pk.sample_id, pos, round(pi() * sqrt(3::double) / 2 * (greatest(a, b) - least(a, b)) * (intensity - low), 6) as area from pk left join bd using (sample_id, pos) join low on low.sample_id = pk.sample_id""")
def lorentz_area_baseline(spark, sf):
    g = grid(spark, sf).withColumn("baseline", F.min("intensity").over(Window.partitionBy("sample_id")))
    return peaks.inflections(g, found(spark, sf), amplitude="without_baseline").select("sample_id", "pos", r6(F.col("area"), "area"))


@query(GAPS + " select a.peak_id as a, b.peak_id as b, round(case when a.sample_id = b.sample_id then 3 * 0.25 else abs(a.ppm - b.ppm) end, 6) as distance from p a join p b on a.peak_id < b.peak_id and abs(a.ppm - b.ppm) < 0.25::double")
def peak_distances(spark, sf):
    return peaks.distances(listed(spark, sf), 0.25).select("a", "b", rounded(F.col("distance"), 6).alias("distance"))


@query(AUCS + ", b as (select fold, arg_max(ncomp, auc) as ncomp from a group by 1) select round_even(median(ncomp), 0)::int as ncomp from b")
def median_ncomp(spark, sf):
    return model.best_ncomp(aucs(spark, sf).groupBy("fold").agg(F.max_by("ncomp", "auc").alias("ncomp")))


@query("""with q as (select distinct p_size::double * 30 + 900 as ppm from part), m as (select ppm, p_partkey, p_retailprice, row_number() over (partition by ppm order by p_partkey) as nth
  from q join part on p_retailprice > ppm - 3 and p_retailprice < ppm + 3), n as (select ppm, k from q, (values (1), (2)) v(k)),
o as (select n.ppm, n.k, p_partkey, p_retailprice from n left join m on m.ppm = n.ppm and m.nth = n.k)
select row_number() over (order by ppm, p_retailprice desc nulls last, p_partkey) as place, ppm, p_partkey as ordinal from o""")
def identify_sorted(spark, sf):
    p = table(spark, sf, "part")
    rows = peaks.identify(p.select((F.col("p_size").cast("double") * 30 + 900).alias("ppm")), p.select(F.col("p_partkey").alias("ordinal"), F.col("p_retailprice").alias("shift")), 2, 3.0, [F.desc_nulls_last("shift"), F.col("ordinal")])
    return rows.withColumn("_k", F.monotonically_increasing_id()).select(F.row_number().over(Window.orderBy("_k")).cast("long").alias("place"), "ppm", "ordinal")


def kept(spark, df: DataFrame, name: str) -> str:
    """df in the shared folder, wide or long; its path."""
    path = f"{tables.scratch(spark)}/lumispec/{name}-{uuid.uuid4().hex}"
    df.write.option("header", True).csv(path)
    return path


@query(G + " select sample_id, idx, round(ppm, 6) as ppm, round(intensity, 6) as intensity from g")
def wide_csv_round_trip(spark, sf):
    g = grid(spark, sf)
    axis = [r["ppm"] for r in g.select("ppm").distinct().orderBy("ppm").collect()]  # the axis
    path = kept(spark, tables.wide(g, axis), "wide")
    back = tables.from_wide(spark.read.option("header", True).csv(path))
    return back.select(F.col("sample_id").cast("long").alias("sample_id"), "idx", r6(F.col("ppm"), "ppm"), r6(F.col("intensity"), "intensity"))


@query(G + " select sample_id, idx, ppm, round(intensity, 6) as intensity from g")
def save_and_load(spark, sf):
    path = f"{tables.scratch(spark)}/lumispec/set-{uuid.uuid4().hex}"
    tables.save({"spectra": grid(spark, sf)}, path)
    return tables.load(spark, path, "spectra")["spectra"].select("sample_id", "idx", "ppm", r6(F.col("intensity"), "intensity"))


# Numeric kernels: no SQL form; the tests hold them against exact cases.


@query()
def als_baseline(spark, sf):
    return model.baseline(spectra.to_arrays(grid(spark, sf)), lam=2.0).select("sample_id", F.posexplode("baseline").alias("idx", "baseline"))


@query()
def spline_interp(spark, sf):
    return model.interpolate(spectra.to_arrays(grid(spark, sf)), (0.2, 6.5, 0.05)).select("sample_id", F.posexplode("intensity").alias("idx", "intensity"))


@query()
def cwt_peaks(spark, sf):
    return model.detect(spectra.to_arrays(grid(spark, sf)), snr=1.0)


@query()
def lorentz_refine(spark, sf):
    return model.refine(spectra.to_arrays(grid(spark, sf)), peaks.one_per_span(bounded(spark, sf).where("ppm_infl_min is not null and ppm_infl_max is not null")))


@query()
def align(spark, sf):
    p = peaks.collected(classes(spark, sf), found(spark, sf))
    return model.align(spectra.to_arrays(grid(spark, sf)), p, 0, 3).select("sample_id", F.posexplode("intensity").alias("idx", "intensity"))


@query()
def peak_clustering(spark, sf):
    return peaks.linkage(peaks.with_ids(found(spark, sf)), 250.0)


@query()
def pca_scores(spark, sf):
    return model.pca_scores(spectra.to_arrays(grid(spark, sf)), 3)


@query()
def pca_outliers(spark, sf):
    return model.outliers(spectra.to_arrays(grid(spark, sf)), 3)


@query()
def pca_outliers_robust(spark, sf):
    return model.outliers(spectra.to_arrays(grid(spark, sf)), 3, robust=True)


@query()
def plsda_auc(spark, sf):
    x = spectra.to_arrays(grid(spark, sf)).join(classes(spark, sf), "sample_id")
    return model.plsda_cv(x, "label", ncomp=3)


@query()
def vip_bootstrap(spark, sf):
    x = spectra.to_arrays(grid(spark, sf)).join(classes(spark, sf), "sample_id")
    return model.vip_bootstrap(x, "label", ncomp=2)


@query()
def permutation_test(spark, sf):
    x = spectra.to_arrays(grid(spark, sf)).join(classes(spark, sf), "sample_id")
    return model.permutation_test(x, "label", ncomp=2)


@query(G + ", p as (select * from g where ppm >= 5.2::double and ppm < 6.5::double), m as (select sample_id, median(intensity) as m from p group by 1), t as (select sample_id, any_value(m) + 3 * 1.4826::double * median(abs(intensity - m)) as th from p join m using (sample_id) group by 1) select sample_id, idx, intensity > th as over from g left join t using (sample_id)")
def threshold_overlay(spark, sf):
    t = spectra.threshold(grid(spark, sf), (5.2, 6.5), "median3mad")
    return analysis.threshold_overlay(grid(spark, sf), t).select("sample_id", "idx", (F.col("intensity") > F.col("threshold")).alias("over"))


@query()
def double_cv(spark, sf):
    x = spectra.to_arrays(grid(spark, sf)).join(classes(spark, sf), "sample_id")
    return analysis.double_cv(x, "label", method=analysis.plsda_method(3))[2]


@query()
def permuted_double_cv(spark, sf):
    x = spectra.to_arrays(grid(spark, sf)).join(classes(spark, sf), "sample_id")
    return analysis.permuted_double_cv(x, "label", ncomp=3)


@query()
def kfold_vip(spark, sf):
    x = spectra.to_arrays(grid(spark, sf)).join(classes(spark, sf), "sample_id")
    return analysis.kfold_vip(x, "label", ncomp=2)


@query()
def pca_variances(spark, sf):
    return analysis.variances(spectra.to_arrays(grid(spark, sf)), 5)
