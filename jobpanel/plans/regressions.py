"""Panel regressions on the cell view.

The unweighted cell panel holds every occupation x industry x year, so that the
three sets of effects can be swept out by means in the check SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import skills
from ..operators import absorb, econ, panel
from ..operators.econ import Term, covariate, fixed_effect, result_frame
from ..session import checkpoint
from ..sources import views
from ..sources.views import CELLS, EXPOSURE, PANEL, POSTINGS, table
from .panels import rounded
from .registry import query
from ..functions import fixed
from ..functions.text import alternation

CUT = 1999


def cells(spark, folder):
    return checkpoint(views.cells(spark, folder))


def small(spark, rows):
    out = result_frame(spark, rows).select("spec", "term", "beta", "se", "n")
    return out.select("spec", "term", F.round("beta", 8).alias("beta"), F.round("se", 8).alias("se"), "n")


def full(spark, rows):
    return rounded(result_frame(spark, rows), 8)


def _sweep(x: str, y: str = "ent", where: str = "1 = 1", name: str = "d", source: str = "cells") -> str:
    """CTEs of a three-way model on a complete panel: one row (beta, se, n) in `<name>r`."""
    def swept(c: str) -> str:
        return (f"{c} - avg({c}) OVER (PARTITION BY occ) - avg({c}) OVER (PARTITION BY ind) "
                f"- avg({c}) OVER (PARTITION BY \"year\") + 2 * avg({c}) OVER ()")

    return f"""{name}x AS (SELECT occ, ind, "year", CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {source} WHERE {where}),
{name}s AS (SELECT occ, {swept("x")} AS xd, {swept("y")} AS yd FROM {name}x),
{name}b AS (SELECT sum(xd * yd) / sum(xd * xd) AS beta, sum(xd * xd) AS sxx, count(*) AS n,
  (SELECT count(DISTINCT occ) + count(DISTINCT ind) + count(DISTINCT "year") - 1 FROM {name}x) AS k FROM {name}s),
{name}g AS (SELECT occ, sum(xd * (yd - beta * xd)) AS u FROM {name}s, {name}b GROUP BY occ),
{name}r AS (SELECT any_value(beta) AS beta, sqrt(sum(u * u)) / any_value(sxx)
  * sqrt(count(*) / (count(*) - 1.0::DOUBLE) * (any_value(n) - 1) / (any_value(n) - any_value(k))) AS se, any_value(n) AS n FROM {name}g, {name}b)"""


def _row(spec: str, term: str, name: str = "d") -> str:
    return f"SELECT '{spec}' AS spec, '{term}' AS term, round(beta, 8) AS beta, round(se, 8) AS se, n FROM {name}r"


ONE_WAY = CELLS + """,
o AS (SELECT occ, ind, n_jobs AS w, treat_x_post - sum(n_jobs * treat_x_post) OVER (PARTITION BY occ) / sum(n_jobs) OVER (PARTITION BY occ) AS xd,
  ent - sum(n_jobs * ent) OVER (PARTITION BY occ) / sum(n_jobs) OVER (PARTITION BY occ) AS yd, n_jobs / sum(n_jobs) OVER (PARTITION BY occ) AS ho FROM cells),
b AS (SELECT sum(w * xd * yd) / sum(w * xd * xd) AS beta, sum(w * xd * xd) AS sxx, count(*) AS n, (SELECT count(DISTINCT occ) + 1 FROM cells) AS k FROM o),
e AS (SELECT o.*, beta, sxx, n, k, yd - beta * xd AS e, ho + w * xd * xd / sxx AS h FROM o, b)"""
ONE = [fixed_effect("occ"), covariate("treat_x_post")]


@query("reg1_wls_core", f"""
WITH {ONE_WAY} SELECT round(any_value(beta), 8) AS beta, round(sqrt(sum(w * e * e) / (any_value(n) - any_value(k)) / any_value(sxx)), 8) AS se, any_value(n) AS n,
  round(1 - sum(w * e * e) / (SELECT sum(n_jobs * ent * ent) - sum(n_jobs * ent) ** 2 / sum(n_jobs) FROM cells), 6) AS r2 FROM e""")
def wls_core(spark, folder):
    fit = econ.wls(cells(spark, folder), "ent", ONE, "n_jobs")["treat_x_post"]
    return spark.createDataFrame([(round(fit["beta"], 8), round(fit["se"], 8), fit["n"], round(fit["r2"], 6))], "beta double, se double, n bigint, r2 double")


@query("reg1_one_regressor", f"""
WITH {PANEL} SELECT ind, round(regr_slope(ent, eff), 8) AS slope, round(regr_intercept(ent, eff), 6) AS intercept, round(regr_r2(ent, eff), 8) AS r2, count(*) AS n FROM panel GROUP BY ind""")
def one_regressor(spark, folder):
    return views.panel(spark, folder).groupBy("ind").agg(
        F.round(F.regr_slope("ent", "eff"), 8).alias("slope"), F.round(F.regr_intercept("ent", "eff"), 6).alias("intercept"),
        F.round(F.regr_r2("ent", "eff"), 8).alias("r2"), F.count(F.lit(1)).alias("n"))


@query("uda1_gram_sums", f"""
WITH {PANEL}, t AS (SELECT ind, CAST(size AS DOUBLE) AS x, ent AS y FROM panel)
SELECT 'ind=' || ind AS a, 'ind=' || ind AS b, CAST(count(*) AS DOUBLE) AS s FROM t GROUP BY ind
UNION ALL SELECT 'ind=' || ind, 'size', sum(x) FROM t GROUP BY ind
UNION ALL SELECT 'ind=' || ind, 'ent', round(sum(y), 4) FROM t GROUP BY ind
UNION ALL SELECT 'size', 'size', sum(x * x) FROM t
UNION ALL SELECT 'size', 'ent', round(sum(x * y), 4) FROM t""")
def gram_sums(spark, folder):
    return rounded(econ.gram(views.panel(spark, folder), "ent", [fixed_effect("ind"), covariate("size")]), 4)


@query("reg2_cluster_robust", f"""
WITH {ONE_WAY}, g AS (SELECT ind, sum(w * xd * e) AS u, any_value(sxx) AS sxx, any_value(n) AS n, any_value(k) AS k, any_value(beta) AS beta FROM e GROUP BY ind)
SELECT round(any_value(beta), 8) AS beta, round(sqrt(sum(u * u)) / any_value(sxx) * sqrt(count(*) / (count(*) - 1.0::DOUBLE) * (any_value(n) - 1) / (any_value(n) - any_value(k))), 8) AS se, any_value(n) AS n FROM g""")
def cluster_robust(spark, folder):
    fit = econ.wls(cells(spark, folder), "ent", ONE, "n_jobs", "cluster", "ind")["treat_x_post"]
    return spark.createDataFrame([(round(fit["beta"], 8), round(fit["se"], 8), fit["n"])], "beta double, se double, n bigint")


@query("reg3_hc1_hc3", f"""
WITH {ONE_WAY} SELECT 'hc1' AS cov, round(sqrt(sum((w * xd * e) ** 2) * any_value(n) / (any_value(n) - any_value(k))) / any_value(sxx), 8) AS se FROM e
UNION ALL SELECT 'hc3', round(sqrt(sum((w * xd * e / (1 - h)) ** 2)) / any_value(sxx), 8) FROM e""")
def hc1_hc3(spark, folder):
    rows = cells(spark, folder)
    out = [(cov, round(econ.wls(rows, "ent", ONE, "n_jobs", cov)["treat_x_post"]["se"], 8)) for cov in ("hc1", "hc3")]
    return spark.createDataFrame(out, "cov string, se double")


@query("reg4_did", f"WITH {CELLS}, {_sweep('treat_x_post')} {_row('continuous', 'treat_x_post')}")
def did(spark, folder):
    return small(spark, econ.did(cells(spark, folder), "ent", weight=None, spec="continuous"))


@query("reg4_did_binary", f"WITH {CELLS}, m AS (SELECT median(exposure) AS m FROM cells), bin AS (SELECT c.*, CASE WHEN exposure >= m THEN post ELSE 0 END AS high FROM cells c, m), {_sweep('high', source='bin')} {_row('binary', 'high_x_post')}")
def did_binary(spark, folder):
    return small(spark, econ.did(econ.high_exposure(cells(spark, folder)), "ent", "high_x_post", weight=None, spec="binary"))


def _absorbed(name: str, source: str, x: str, w: str = "n_jobs", y: str = "ent", effects: tuple[str, ...] = ("occ", "ind", '"year"'),
              rounds: int = 120) -> str:
    """CTEs of a weighted model with one regressor: its effects leave by repeated weighted demeaning."""
    inner = f"SELECT k, occ, {', '.join(e for e in effects if e != 'occ')}{', ' if len(effects) > 1 or effects[0] != 'occ' else ''}w, x, y FROM {name}d WHERE k < {rounds}"
    keep = ", ".join(dict.fromkeys(["k", "occ", *effects, "w"]))
    for e in effects:
        def less(c: str) -> str:
            return f"{c} - sum(w * {c}) OVER (PARTITION BY k, {e}) / sum(w) OVER (PARTITION BY k, {e}) AS {c}"
        inner = f"SELECT {keep}, {less('x')}, {less('y')} FROM ({inner})"
    columns = ", ".join(dict.fromkeys(["occ", *effects]))
    levels = " + ".join(f"count(DISTINCT {e})" for e in effects)
    return f"""{name}d AS (
  SELECT 0 AS k, {columns}, CAST({w} AS DOUBLE) AS w, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {source}
  UNION ALL SELECT k + 1, {columns}, w, x, y FROM ({inner})),
{name}f AS (SELECT * FROM {name}d WHERE k = {rounds}),
{name}b AS (SELECT sum(w * x * y) / sum(w * x * x) AS beta, sum(w * x * x) AS sxx, count(*) AS n, sum(w) AS weight, {levels} - {len(effects) - 2} AS p FROM {name}f),
{name}g AS (SELECT occ, sum(w * x * (y - beta * x)) AS u FROM {name}f, {name}b GROUP BY occ)"""


def _absorbed_row(name: str, spec: str, term: str = "treat_x_post", n: str = "n") -> str:
    spec = spec if spec.startswith("(") else f"'{spec}'"
    return f"""SELECT {spec} AS spec, '{term}' AS term, round(any_value(beta), 8) AS beta,
  round(sqrt(sum(u * u)) / any_value(sxx) * sqrt(count(*) / (count(*) - 1.0::DOUBLE) * (any_value({n}) - 1) / (any_value({n}) - any_value(p))), 8) AS se,
  CAST(any_value({n}) AS BIGINT) AS n FROM {name}g, {name}b"""


def _individual(dose: str, spec: str) -> str:
    """The (occupation, year) cells carry all regressors of the row-level model."""
    return f"""
WITH RECURSIVE {PANEL}, {EXPOSURE}, c AS (
  SELECT occ, "year", count(*) AS n_jobs, avg(ent) AS ent, any_value({dose}) * CASE WHEN "year" >= {CUT} THEN 1.0 ELSE 0.0 END AS x
  FROM panel JOIN exposure USING (occ) GROUP BY occ, "year"),
{_absorbed("a", "c", "x", effects=("occ", '"year"'))}
{_absorbed_row("a", spec, n="weight")}"""


@query("reg4_did_weighted", f"""
WITH RECURSIVE {CELLS}, {_absorbed("c", "cells", "treat_x_post")}, {_absorbed("b", "cells", "treat_x_post", effects=("occ", '"year"'))},
{_absorbed("a", "cells", "treat_x_post", effects=("occ",))}
{_absorbed_row("c", "did")} UNION ALL {_absorbed_row("b", "two_way")} UNION ALL {_absorbed_row("a", "one_way")}""")
def did_weighted(spark, folder):
    rows = cells(spark, folder)
    out = econ.did(rows, "ent") + econ.did(rows, "ent", effects=econ.FIXED_EFFECTS[:2], spec="two_way")
    return small(spark, out + econ.did(rows, "ent", effects=econ.FIXED_EFFECTS[:1], spec="one_way"))


@query("reg5_time_varying", f"""
WITH {CELLS}, i AS (SELECT "year", count(*) AS v FROM panel WHERE flag = 'R' GROUP BY "year"),
tv AS (SELECT c.*, exposure * v / (SELECT max(v) FROM i) AS treat_tv FROM cells c JOIN i ON i."year" = c."year"), {_sweep('treat_tv', source='tv')} {_row('time_varying', 'treat_tv')}""")
def time_varying(spark, folder):
    intensity = views.panel(spark, folder).filter("flag = 'R'").groupBy("year").agg(F.count(F.lit(1)).alias("intensity"))
    return small(spark, econ.time_varying_did(cells(spark, folder), "ent", checkpoint(intensity), weight=None))


@query("reg6_detrended", f"""
WITH {CELLS}, {_sweep('exposure * "year"', where=f'"year" < {CUT}', name='p')},
flat AS (SELECT c.*, ent - (SELECT beta FROM pr) * exposure * "year" AS flat_y FROM cells c), {_sweep('treat_x_post', 'flat_y', source='flat')}
{_row('detrended', 'treat_x_post')}""")
def detrended(spark, folder):
    return small(spark, econ.detrended_did(cells(spark, folder), "ent", CUT, weight=None)[:1])


@query("reg7_dose_response")
def dose_response(spark, folder):
    rows = cells(spark, folder)
    bins = panel.quantile_bins(rows, "occ", "exposure", 4, ["Q1", "Q2", "Q3", "Q4"])
    thirds = panel.quantile_bins(rows, "occ", "exposure", 3, ["T1", "T2", "T3"])
    return full(spark, econ.dose_response(rows, "ent", bins) + econ.dose_response(rows, "ent", thirds))


@query("reg8_group_interaction")
def group_interaction(spark, folder):
    return full(spark, econ.group_interaction(cells(spark, folder), "ent", "ind", "BUILDING"))


@query("reg9_spline")
def spline(spark, folder):
    return full(spark, econ.spline_did(cells(spark, folder), "ent", [1997, 1998, 1999]))


@query("reg10_event_study")
def event_study(spark, folder):
    return full(spark, econ.event_study(cells(spark, folder), "ent", CUT - 1))


@query("reg11_conditional_trends")
def conditional_trends(spark, folder):
    rows = cells(spark, folder)
    base = panel.baseline_means(rows, "occ", [1995, 1996], {"base_salary": "salary", "base_eff": "eff"})
    joined, controls = econ.trend_controls(rows, base, "occ", ["base_salary", "base_eff"])
    return full(spark, econ.did(joined, "ent", controls=controls, spec="conditional"))


def _gradients(spark, folder):
    e = F.col("exposure")
    group = F.when(e > 0.52, "G4").when(e > 0.51, "G3").when(e > 0.5, "G2").otherwise("G0")
    rows = views.panel(spark, folder).join(views.exposure(spark, folder), "occ").withColumn("gradient", group)
    out = rows.groupBy("year", "gradient").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ent").alias("mean_outcome"), F.avg(F.log1p("size")).alias("mean_log_tokens"))
    treated = F.col("gradient").isin("G3", "G4").cast("int")
    return checkpoint(out.withColumn("did", (F.col("year") >= CUT).cast("int") * treated).withColumn("exposure", treated))


@query("reg12_cell_did")
def cell_did(spark, folder):
    rows = _gradients(spark, folder)
    plain = econ.cell_did(rows, "mean_outcome")
    control = econ.cell_did(rows, "mean_outcome", [covariate("mean_log_tokens")])
    study = econ.event_study(rows, "mean_outcome", CUT - 1, effects=[fixed_effect("year"), fixed_effect("gradient")], weight="n", cov="hc3", cluster=None)
    return full(spark, plain + [{**r, "spec": "with_length"} for r in control] + study)


def _rows(spark, folder):
    return checkpoint(views.panel(spark, folder).join(views.exposure(spark, folder), "occ").select(
        "year", "occ", "exposure", "ent", "topic", "size", "eff"))


@query("reg13_individual_twfe")
def individual_twfe(spark, folder):
    rows, joint = econ.individual_twfe(_rows(spark, folder), "ent")
    return full(spark, rows + [{"spec": "joint_f", "term": "slope", "beta": joint["f"], "se": None, "stat": joint["f"], "pval": joint["pval"],
                                "ci_lo": None, "ci_hi": None, "n": rows[0]["n"], "r2": rows[0]["r2"]}])


@query("reg13_continuous", _individual("exposure", "continuous"))
def individual_continuous(spark, folder):
    return small(spark, econ.individual_did(_rows(spark, folder), "ent", CUT))


@query("reg13_binary", _individual("CASE WHEN exposure > 0.5 THEN 1.0 ELSE 0.0 END", "binary"))
def individual_binary(spark, folder):
    return small(spark, econ.individual_did(_rows(spark, folder), "ent", CUT, binary_above=0.5))


_ABSORBED = 25  # rounds of the check, more than the demeaning needs


@query("reg13_absorbed_effects", f"""
WITH RECURSIVE {PANEL},
z AS MATERIALIZED (SELECT row_number() OVER () AS row, company, title, ln(CAST(salary AS DOUBLE)) AS y, CAST(ent AS DOUBLE) AS x FROM panel),
r AS (
  SELECT 0 AS k, row, company, title, y, x FROM z
  UNION ALL SELECT k + 1, row, company, title, y - avg(y) OVER (PARTITION BY title), x - avg(x) OVER (PARTITION BY title) FROM (
    SELECT k, row, company, title, y - avg(y) OVER (PARTITION BY company) AS y, x - avg(x) OVER (PARTITION BY company) AS x FROM r WHERE k < {_ABSORBED})),
f AS MATERIALIZED (SELECT * FROM r WHERE k = {_ABSORBED}),
b AS (SELECT sum(x * y) / sum(x * x) AS beta, sum(x * x) AS sxx, count(*) AS n,
  count(DISTINCT company) + count(DISTINCT title) AS k, count(DISTINCT company) AS g FROM f),
u AS (SELECT company, sum(x * (y - beta * x)) AS u FROM f, b GROUP BY company)
SELECT 'absorbed' AS spec, 'ent' AS term, round(any_value(beta), 6) AS beta,
  round(sqrt(sum(u * u)) / any_value(sxx) * sqrt(any_value(g) / (any_value(g) - 1.0::DOUBLE) * (any_value(n) - 1) / (any_value(n) - any_value(k))), 6) AS se,
  any_value(n) AS n FROM u, b""")
def absorbed_effects(spark, folder):
    """Postings with effects of every company and title, clustered by company."""
    rows = views.panel(spark, folder).withColumn("log_salary", F.log("salary"))
    fit = absorb.absorbed_wls(rows, "log_salary", ["ent"], ["company", "title"], cov="cluster", cluster="company")
    out = result_frame(spark, [{**fit["ent"], "spec": "absorbed"}])
    return out.select("spec", "term", F.round("beta", 6).alias("beta"), F.round("se", 6).alias("se"), "n")


@query("reg14_linear_probability")
def linear_probability(spark, folder):
    rows = _rows(spark, folder).withColumn("analytic", F.col("topic").isin(1, 4, 6).cast("int"))
    return full(spark, econ.individual_twfe(rows, "analytic")[0])


@query("reg15_year_interaction")
def year_interaction(spark, folder):
    base = views.panel(spark, folder).groupBy("occ", "year").agg(F.count(F.lit(1)).alias("n"), F.avg("ent").alias("ent"))
    rows = checkpoint(base.join(views.exposure(spark, folder), "occ"))
    with_occ, joint = econ.year_interaction(rows, "ent")
    plain, _ = econ.year_interaction(rows, "ent", occ_effects=False)
    test = {"spec": "joint_f", "term": "slope", "beta": joint["f"], "se": None, "stat": joint["f"], "pval": joint["pval"],
            "ci_lo": None, "ci_hi": None, "n": with_occ[0]["n"], "r2": with_occ[0]["r2"]}
    return full(spark, with_occ + [{**r, "spec": "plain_" + r["spec"]} for r in plain] + [test])


def _shares(spark, folder):
    wide = panel.share_pivot(views.panel(spark, folder), ["occ", "ind", "year"], "topic", range(8), 0)
    return checkpoint(econ.did_columns(wide.join(views.exposure(spark, folder), "occ"), CUT))


@query("reg16_topic_regressions")
def topic_regressions(spark, folder):
    rows = econ.many_outcomes(_shares(spark, folder), [f"share_{k}" for k in range(8)])
    return rounded(econ.false_discovery(result_frame(spark, rows)), 8)


@query("reg16_false_discovery", """
WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS spec, ((p_partkey * 7919) % 10007) / 100070.0::DOUBLE AS pval FROM part),
r AS (SELECT *, row_number() OVER (ORDER BY pval, spec) AS rank, count(*) OVER () AS m FROM p)
SELECT spec, round(pval, 9) AS pval, CAST(rank AS INTEGER) AS rank, round(rank / m * 0.05::DOUBLE, 9) AS bh_threshold, CAST(pval <= rank / m * 0.05::DOUBLE AS INTEGER) AS fdr_sig FROM r""")
def false_discovery(spark, folder):
    rows = table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("spec"), ((F.col("p_partkey") * 7919 % 10007) / 100070.0).alias("pval"))
    return rounded(econ.false_discovery(rows), 9)


@query("reg17_task_share_did", f"""
WITH {CELLS}, sh AS (SELECT p.occ, p.ind, p."year", count(*) FILTER (topic = 3) / count(*) AS share_3 FROM panel p GROUP BY 1, 2, 3),
j AS (SELECT c.*, share_3 FROM cells c JOIN sh ON sh.occ = c.occ AND sh.ind = c.ind AND sh."year" = c."year"), {_sweep('treat_x_post', 'share_3', source='j')} {_row('share_3', 'treat_x_post')}""")
def task_share_did(spark, folder):
    return small(spark, econ.did(_shares(spark, folder), "share_3", weight=None, spec="share_3"))


@query("reg18_cut_points", "WITH " + CELLS + ", " + ", ".join(
    _sweep(f'exposure * CASE WHEN "year" >= {c} THEN 1 ELSE 0 END', name=f"c{c}") for c in (1998, 2000)) + ", " + ", ".join(
    _sweep(f'exposure * CASE WHEN "year" >= {c} THEN 1 ELSE 0 END', where=f'"year" < {CUT}', name=f"p{c}") for c in (1996, 1997)) + " "
    + " UNION ALL ".join([_row(f"cut_{c}", "treat_x_post", f"c{c}") for c in (1998, 2000)] + [_row(f"placebo_{c}", "treat_x_post", f"p{c}") for c in (1996, 1997)]))
def cut_points(spark, folder):
    rows = cells(spark, folder)
    return small(spark, econ.cut_points(rows, "ent", [1998, 2000], weight=None)
                 + econ.cut_points(rows, "ent", [1996, 1997], CUT, weight=None))


@query("reg19_randomization")
def randomization(spark, folder):
    betas, share = econ.randomization_inference(cells(spark, folder), "ent", CUT, draws=500)
    return rounded(betas.withColumn("p_value", F.lit(share)), 8)


@query("reg20_time_dose", f"WITH {CELLS}, {_sweep(f'exposure * greatest(0, {chr(34)}year{chr(34)} - {CUT - 1})')} {_row('time_dose', 'treat_x_time')}")
def time_dose(spark, folder):
    return small(spark, econ.post_time_dose(cells(spark, folder), "ent", CUT - 1, weight=None))


@query("reg20_cross_section", f"""
WITH {CELLS}, o AS (SELECT occ, n_jobs AS w, exposure - sum(n_jobs * exposure) OVER (PARTITION BY ind) / sum(n_jobs) OVER (PARTITION BY ind) AS xd,
  ent - sum(n_jobs * ent) OVER (PARTITION BY ind) / sum(n_jobs) OVER (PARTITION BY ind) AS yd FROM cells WHERE "year" = 2000),
b AS (SELECT sum(w * xd * yd) / sum(w * xd * xd) AS beta, sum(w * xd * xd) AS sxx, count(*) AS n, (SELECT count(DISTINCT ind) + 1 FROM cells) AS k FROM o),
g AS (SELECT occ, sum(w * xd * (yd - beta * xd)) AS u, any_value(beta) AS beta, any_value(sxx) AS sxx, any_value(n) AS n, any_value(k) AS k FROM o, b GROUP BY occ)
SELECT '2000' AS spec, 'exposure' AS term, round(any_value(beta), 8) AS beta, round(sqrt(sum(u * u)) / any_value(sxx) * sqrt(count(*) / (count(*) - 1.0::DOUBLE) * (any_value(n) - 1) / (any_value(n) - any_value(k))), 8) AS se, any_value(n) AS n FROM g""")
def cross_section(spark, folder):
    return small(spark, econ.cross_section(cells(spark, folder), "ent", 2000))


def _without(rank: int) -> str:
    return f"(SELECT occ FROM heaviest WHERE rank = {rank})"


@query("reg21_leave_one_out", f"""
WITH RECURSIVE {CELLS}, heaviest AS (SELECT occ, row_number() OVER (ORDER BY sum(n_jobs) DESC, occ) AS rank FROM cells GROUP BY occ),
{_absorbed("full", "cells", "treat_x_post")},
{", ".join(_absorbed(f"o{r}", f"(SELECT * FROM cells WHERE occ <> {_without(r)})", "treat_x_post") for r in range(1, 6))}
{_absorbed_row("full", "full")} {" ".join("UNION ALL " + _absorbed_row(f"o{r}", f"('without_' || {_without(r)})") for r in range(1, 6))}""")
def leave_one_out(spark, folder):
    return small(spark, econ.leave_one_out(cells(spark, folder), "ent", 5))


@query("reg22_trend_slopes", f"""
WITH {CELLS}, s AS (SELECT occ, sum(n_jobs) AS w, sum(n_jobs * "year") / sum(n_jobs) AS mx, sum(n_jobs * ent) / sum(n_jobs) AS my FROM cells GROUP BY occ)
SELECT s.occ, round(sum(n_jobs * ("year" - mx) * (ent - my)) / sum(n_jobs * ("year" - mx) ** 2), 8) AS slope, CAST(any_value(w) AS BIGINT) AS total_n FROM cells JOIN s ON s.occ = cells.occ GROUP BY s.occ""")
def trend_slopes(spark, folder):
    return rounded(panel.trend_slopes(views.cells(spark, folder), "occ", "ent", "n_jobs"), 8)


@query("reg22_slope_fit", f"""
WITH {CELLS}, s AS (SELECT occ, any_value(exposure) AS exposure, sum(n_jobs) AS w, sum(n_jobs * "year") / sum(n_jobs) AS mx, sum(n_jobs * ent) / sum(n_jobs) AS my FROM cells GROUP BY occ),
t AS (SELECT s.occ, any_value(s.exposure) AS x, sum(n_jobs * ("year" - mx) * (ent - my)) / sum(n_jobs * ("year" - mx) ** 2) AS slope FROM cells JOIN s ON s.occ = cells.occ GROUP BY s.occ)
SELECT round(regr_slope(slope, x), 7) AS slope, round(corr(slope, x), 6) AS r, count(*) AS n FROM t""")
def slope_fit(spark, folder):
    rows = views.cells(spark, folder)
    x = rows.groupBy("occ").agg(F.first("exposure").alias("x"))
    slopes = panel.trend_slopes(rows, "occ", "ent", "n_jobs").join(x, "occ")
    return slopes.agg(F.round(F.regr_slope("slope", "x"), 7).alias("b"), F.round(F.corr("slope", "x"), 6).alias("r"),
                      F.count(F.lit(1)).alias("n")).withColumnRenamed("b", "slope")


@query("reg23_residual_means", f"""
WITH {PANEL}, m AS (SELECT avg(ent) AS my, avg("year") AS m1, avg(size) AS m2, covar_pop(ent, "year") AS cy1, covar_pop(ent, size) AS cy2, var_pop("year") AS v1, var_pop(size) AS v2, covar_pop("year", size) AS c12 FROM panel),
b AS (SELECT *, (cy2 * v1 - cy1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM m)
SELECT "year", count(*) AS n, round(avg(ent), 6) AS mean_raw, round(avg(ent - my - b2 * (size - m2)), 6) + 0.0::DOUBLE AS mean_residual FROM panel, b GROUP BY "year" """)
def residual_means(spark, folder):
    return rounded(econ.residual_means(views.panel(spark, folder), "ent", ["size"]))


@query("reg24_within_heterogeneity", f"""
WITH RECURSIVE {CELLS}, a AS (SELECT occ, "year", sum(n_jobs) AS n, sum(n_jobs * ent) / sum(n_jobs) AS m FROM cells GROUP BY occ, "year" HAVING sum(n_jobs) >= 50),
h AS (SELECT c.occ, c."year", any_value(a.n) AS n_jobs, any_value(treat_x_post) AS x,
  sqrt(sum(n_jobs * sd_ent * sd_ent) / any_value(a.n) + sum(n_jobs * (ent - a.m) * (ent - a.m)) / any_value(a.n)) AS sd, any_value(a.m) AS m
  FROM cells c JOIN a ON a.occ = c.occ AND a."year" = c."year" GROUP BY c.occ, c."year"),
{_absorbed("s", "h", "x", y="sd", effects=("occ", '"year"'))}, {_absorbed("v", "h", "x", y="sd / m", effects=("occ", '"year"'))}
{_absorbed_row("s", "sd")} UNION ALL {_absorbed_row("v", "cv")}""")
def within_heterogeneity(spark, folder):
    base = views.cells(spark, folder).withColumnRenamed("ent", "mean_ent")
    pooled = panel.pooled_variance(base, ["occ", "year"], "ent").join(views.exposure(spark, folder), "occ")
    rows = checkpoint(econ.did_columns(pooled, CUT))
    effects = econ.FIXED_EFFECTS[:2]
    return small(spark, econ.did(rows, "sd_ent", effects=effects, spec="sd") + econ.did(rows, "cv_ent", effects=effects, spec="cv"))


@query("reg25_gradient_summary", f"""
WITH {PANEL}, {EXPOSURE}, c AS (SELECT CASE WHEN exposure > 0.52 THEN 'high' WHEN exposure > 0.5 THEN 'middle' ELSE 'low' END AS gradient, "year", count(*) AS n, avg(ent) AS ent, avg(exposure) AS score
  FROM panel p JOIN exposure e ON e.occ = p.occ GROUP BY 1, 2),
s AS (SELECT gradient, sum(n) AS n, sum(n * score) / sum(n) AS score, max(CASE WHEN "year" = 1995 THEN ent END) AS a, max(CASE WHEN "year" = 2001 THEN ent END) AS b, sum(n * "year") / sum(n) AS mx, sum(n * ent) / sum(n) AS my FROM c GROUP BY gradient),
t AS (SELECT c.gradient, sum(c.n * ("year" - mx) * (ent - my)) / sum(c.n * ("year" - mx) ** 2) * 1000 AS sl FROM c JOIN s ON s.gradient = c.gradient GROUP BY c.gradient)
SELECT s.gradient, CAST(n AS BIGINT) AS total_n, round(score, 6) AS mean_score, round(a, 6) AS value_first, round(b, 6) AS value_last, round(b - a, 6) AS change, round(sl, 5) AS slope_x1000 FROM s JOIN t ON t.gradient = s.gradient""")
def gradient_summary(spark, folder):
    e = F.col("exposure")
    rows = views.panel(spark, folder).join(views.exposure(spark, folder), "occ").withColumn(
        "gradient", F.when(e > 0.52, "high").when(e > 0.5, "middle").otherwise("low"))
    out = rows.groupBy("gradient", "year").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ent").alias("ent"), F.avg("exposure").alias("score"))
    got = panel.gradient_summary(out, "gradient", "ent", "score", "n", 1995, 2001)
    return rounded(got.withColumn("slope_x1000", F.round("slope_x1000", 5)))


@query("reg26_version_comparison")
def version_comparison(spark, folder):
    rows = cells(spark, folder)
    before = econ.did(rows.filter("ind != 'FURNITURE'"), "ent") + econ.event_study(rows.filter("ind != 'FURNITURE'"), "ent", CUT - 1)
    after = econ.did(rows, "ent") + econ.event_study(rows, "ent", CUT - 1)
    return rounded(econ.compare_versions(before, after, spark), 8)


_COUNTS = ", ".join(
    f"avg(coalesce(len(regexp_extract_all(coalesce(description, ''), '{alternation(w)}')), 0)) AS m{n}" for n, w in fixed.TASK_KEYWORDS)


@query("reg27_exposure_parts", f"""
WITH {POSTINGS}, c AS (SELECT category, year(CAST(publish_date AS DATE)) AS "year", count(*) AS n, 0.4 AS score, {_COUNTS} FROM postings GROUP BY 1, 2),
b AS (SELECT category, sum(mRC * n) / sum(n) AS rc, sum(mNRA * n) / sum(n) AS nra, sum(mNRI * n) / sum(n) AS nri, sum(mRM * n) / sum(n) AS rm FROM c WHERE "year" IN (1995, 1996) GROUP BY category)
SELECT c.category, "year", round(score * CASE WHEN rc + nra + nri + rm > 0 THEN rc / (rc + nra + nri + rm) ELSE 0.25 END, 6) AS subst_exposure,
  round(score * CASE WHEN rc + nra + nri + rm > 0 THEN nra / (rc + nra + nri + rm) ELSE 0.25 END, 6) AS aug_exposure FROM c LEFT JOIN b ON b.category = c.category""")
def exposure_parts(spark, folder):
    counts = skills.task_counts(F.col("description"))
    rows = views.postings(spark, folder).withColumn("year", F.year(F.col("publish_date").cast("date")))
    base = rows.groupBy("category", "year").agg(
        F.count(F.lit(1)).alias("n"), F.lit(0.4).alias("score"), *[F.avg(c).alias(f"mean_{n}_count") for n, c in counts.items()])
    return rounded(panel.exposure_parts(base, "category", "score", "n", [1995, 1996]).select(
        "category", "year", "subst_exposure", "aug_exposure"))
