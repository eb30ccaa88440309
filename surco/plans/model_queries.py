"""Queries over labelled samples: separability, forests, groups, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surco.operators import classify as CL
from surco.operators import cluster as K
from surco.operators import separability as SEP
from surco.operators.curve import features_of_pixels
from surco.plans.curve_queries import CTE_LONG, STAGE_SQL, STAGES, STEP, VARS, band_names, pixel_windows, rounded, with_cte
from surco.plans.registry import query
from surco.session import scratch_path, written_once
from surco.sources import results as RES
from surco.sources.adapters import oracle, view

NAMES = [f"e{i}" for i in range(1, 9)]


def samples(spark, sf_dir):
    return view(spark, sf_dir, "samples")


CTE_GROUPS = "s AS (SELECT * FROM {samples} s), sd AS (SELECT 'c4' AS comparison, clase <> 'otros' AS is_a, * FROM s UNION ALL SELECT 'ms', clase = 'maiz', * FROM s WHERE clase <> 'otros'), lg AS (" + " UNION ALL ".join(
    f"SELECT comparison, is_a, clase, grupo, '{n}' AS var, {n} AS value FROM sd WHERE {n} IS NOT NULL" for n in NAMES) + ")"
CTE_MOM = """,
mo AS (SELECT comparison, var, count(*) FILTER (WHERE is_a) AS n_a, count(*) FILTER (WHERE NOT is_a) AS n_b, avg(value) FILTER (WHERE is_a) AS mean_a,
  avg(value) FILTER (WHERE NOT is_a) AS mean_b, var_samp(value) FILTER (WHERE is_a) AS va, var_samp(value) FILTER (WHERE NOT is_a) AS vb,
  stddev_pop(value) FILTER (WHERE is_a) AS sd_a, stddev_pop(value) FILTER (WHERE NOT is_a) AS sd_b FROM {src} GROUP BY 1, 2),
m1 AS (SELECT *, va + 1e-12 + 1e-9 * greatest(va, vb, 1e-12) AS v1, vb + 1e-12 + 1e-9 * greatest(va, vb, 1e-12) AS v2 FROM mo),
jm AS (SELECT *, CASE WHEN n_a >= 3 AND n_b >= 3 THEN 2 * (1 - exp(-(pow(mean_a - mean_b, 2) / (4 * (v1 + v2)) + 0.5 * ln((v1 + v2) / (2 * sqrt(v1 * v2)))))) END AS jm FROM m1)"""
CTE_THR = """,
cn AS (SELECT comparison, var, value, count(*) FILTER (WHERE is_a) AS a, count(*) FILTER (WHERE NOT is_a) AS b FROM {src} GROUP BY 1, 2, 3),
rn AS (SELECT *, sum(a) OVER w AS au, sum(b) OVER w AS bu, sum(a) OVER p AS na, sum(b) OVER p AS nb, coalesce(lead(value) OVER w, value) AS nx FROM cn
  WINDOW w AS (PARTITION BY comparison, var ORDER BY value), p AS (PARTITION BY comparison, var)),
bl AS (SELECT *, ((na - au) / CAST(na AS DOUBLE) + bu / CAST(nb AS DOUBLE)) / 2 AS gt, (au / CAST(na AS DOUBLE) + (1 - bu / CAST(nb AS DOUBLE))) / 2 AS lt FROM rn WHERE na > 0 AND nb > 0),
g1 AS (SELECT comparison, var, gt, (value + nx) / 2 AS cut FROM (SELECT *, row_number() OVER (PARTITION BY comparison, var ORDER BY gt DESC, value) AS i FROM bl) WHERE i = 1),
l1 AS (SELECT comparison, var, lt, (value + nx) / 2 AS cut FROM (SELECT *, row_number() OVER (PARTITION BY comparison, var ORDER BY lt DESC, value) AS i FROM bl) WHERE i = 1),
th AS (SELECT comparison, var, CASE WHEN gt >= lt THEN g1.cut ELSE l1.cut END AS thr, CASE WHEN gt >= lt THEN '>' ELSE '<=' END AS dir, greatest(gt, lt) AS bal_acc FROM g1 JOIN l1 USING (comparison, var))"""
CTE_PIXEL = CTE_GROUPS + CTE_MOM.replace("{src}", "lg") + CTE_THR.replace("{src}", "lg")
CTE_FIELD = CTE_GROUPS + ", fm AS (SELECT comparison, is_a, grupo, var, median(value) AS value FROM lg GROUP BY 1, 2, 3, 4)" + CTE_MOM.replace("{src}", "fm") + CTE_THR.replace("{src}", "fm")
RANK = """SELECT comparison, var, round(jm, 6) + 0e0 AS jm, round(mean_a, 6) + 0e0 AS mean_a, round(mean_b, 6) + 0e0 AS mean_b, CASE WHEN n_a > 1 THEN round(sd_a, 6) END AS sd_a,
 CASE WHEN n_b > 1 THEN round(sd_b, 6) END AS sd_b, n_a, n_b, round(thr, 6) + 0e0 AS thr, dir, round(bal_acc, 6) AS bal_acc FROM jm JOIN th USING (comparison, var)"""


def pixel_groups(spark, sf_dir):
    return SEP.two_groups(samples(spark, sf_dir), NAMES)


@query("field_median", oracle("WITH " + CTE_GROUPS + " SELECT grupo, var, round(median(value), 6) + 0e0 AS value FROM lg WHERE comparison = 'c4' GROUP BY 1, 2"))
def field_median(spark, sf_dir):
    return rounded(SEP.field_medians(samples(spark, sf_dir), NAMES), ())


@query("jm_distance", with_cte(CTE_PIXEL, "SELECT comparison, var, round(jm, 6) + 0e0 AS jm, n_a, n_b FROM jm"))
def jm_distance(spark, sf_dir):
    return rounded(SEP.jm_distance(pixel_groups(spark, sf_dir)), ())


@query("best_threshold", with_cte(CTE_PIXEL, "SELECT comparison, var, round(thr, 6) + 0e0 AS thr, dir, round(bal_acc, 6) AS bal_acc FROM th"))
def best_threshold(spark, sf_dir):
    return rounded(SEP.best_threshold(pixel_groups(spark, sf_dir)), ())


@query("threshold_confusion", with_cte(CTE_PIXEL, """
SELECT comparison, var, count(*) FILTER (WHERE is_a AND hit) AS A_as_A, count(*) FILTER (WHERE is_a AND NOT hit) AS A_as_B, count(*) FILTER (WHERE NOT is_a AND hit) AS B_as_A,
 count(*) FILTER (WHERE NOT is_a AND NOT hit) AS B_as_B FROM (SELECT lg.*, CASE WHEN dir = '>' THEN value > thr ELSE value <= thr END AS hit FROM lg JOIN th USING (comparison, var)) GROUP BY 1, 2"""))
def threshold_confusion(spark, sf_dir):
    g = pixel_groups(spark, sf_dir)
    return SEP.threshold_confusion(g, SEP.best_threshold(g))


@query("separability_ranking", with_cte(CTE_PIXEL, RANK))
def separability_ranking(spark, sf_dir):
    return rounded(SEP.ranking(pixel_groups(spark, sf_dir)), ())


@query("separability_by_field", with_cte(CTE_FIELD, RANK))
def separability_by_field(spark, sf_dir):
    return rounded(SEP.ranking(SEP.two_groups(samples(spark, sf_dir), NAMES, by_field=True)), ())


def _jm2(cand: str) -> str:
    def side(s, cond):
        rows = f"{cond} AND e1 IS NOT NULL AND {cand} IS NOT NULL"
        return ", ".join([f"count(*) FILTER (WHERE {rows}) AS n{s}", f"avg(e1) FILTER (WHERE {rows}) AS x{s}", f"avg({cand}) FILTER (WHERE {rows}) AS y{s}",
                          f"var_samp(e1) FILTER (WHERE {rows}) AS p{s}", f"var_samp({cand}) FILTER (WHERE {rows}) AS q{s}",
                          f"covar_samp(e1, {cand}) FILTER (WHERE {rows}) AS r{s}"])
    return f"SELECT '{cand}' AS cand, {side('a', 'is_a')}, {side('b', 'NOT is_a')} FROM sd WHERE comparison = 'c4'"


@query("jm_multivariate", with_cte(CTE_GROUPS + ", mm AS (" + " UNION ALL ".join(_jm2(c) for c in NAMES[1:]) + """),
m2 AS (SELECT *, 1e-6 * (pa + pb + qa + qb) / 4 AS rg FROM mm),
m3 AS (SELECT *, (pa + pb) / 2 + rg AS p, (qa + qb) / 2 + rg AS q, (ra + rb) / 2 AS r, xa - xb AS dx, ya - yb AS dy FROM m2)""", """
SELECT 'c4' AS comparison, 'e1' AS chosen, cand, round(2 * (1 - exp(-((q * dx * dx - 2 * r * dx * dy + p * dy * dy) / (p * q - r * r) / 8
 + 0.5 * (ln(p * q - r * r) - 0.5 * (ln((pa + rg) * (qa + rg) - ra * ra) + ln((pb + rg) * (qb + rg) - rb * rb))))))
 , 6) + 0e0 AS jm FROM m3"""))
def jm_multivariate(spark, sf_dir):
    """Distance of the pairs (e1, candidate)."""
    got = SEP.jm_multivariate(samples(spark, sf_dir), "c4", ["e1"], NAMES[1:])
    rows = spark.createDataFrame(got, "cand string, jm double")
    return rounded(rows.select(F.lit("c4").alias("comparison"), F.lit("e1").alias("chosen"), "cand", "jm"), ())


def _steps_sql() -> str:
    """Both rounds in closed form: the best single variable, then its best partner."""
    one, two = [], []
    for i, v in enumerate(NAMES):
        one.append(f"""SELECT comparison, '{v}' AS var, {i} AS ord, avg({v}) FILTER (WHERE is_a) - avg({v}) FILTER (WHERE NOT is_a) AS d,
          var_samp({v}) FILTER (WHERE is_a) AS va, var_samp({v}) FILTER (WHERE NOT is_a) AS vb FROM sd GROUP BY 1""")
        for j, w in enumerate(NAMES):
            if i != j:
                ok = f"{v} IS NOT NULL AND {w} IS NOT NULL"
                a, b = f"FILTER (WHERE is_a AND {ok})", f"FILTER (WHERE NOT is_a AND {ok})"
                two.append(f"""SELECT comparison, '{v}' AS first, '{w}' AS var, {j} AS ord, avg({v}) {a} - avg({v}) {b} AS dx, avg({w}) {a} - avg({w}) {b} AS dy,
                  var_samp({v}) {a} AS pa, var_samp({v}) {b} AS pb, var_samp({w}) {a} AS qa, var_samp({w}) {b} AS qb, covar_samp({v}, {w}) {a} AS ra,
                  covar_samp({v}, {w}) {b} AS rb, corr({v}, {w}) FILTER (WHERE {ok}) AS cc FROM sd GROUP BY 1""")
    return f""",
u AS ({' UNION ALL '.join(one)}), u2 AS (SELECT *, 1e-6 * (va + vb) / 2 AS rg FROM u),
u3 AS (SELECT comparison, var, ord, 2 * (1 - exp(-(d * d / (8 * ((va + vb) / 2 + rg)) + 0.5 * (ln((va + vb) / 2 + rg) - 0.5 * (ln(va + rg) + ln(vb + rg)))))) AS jm FROM u2),
s1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY jm DESC, ord) AS i FROM u3) WHERE i = 1),
w AS ({' UNION ALL '.join(two)}), w2 AS (SELECT w.*, 1e-6 * (pa + pb + qa + qb) / 4 AS rg FROM w JOIN s1 ON s1.comparison = w.comparison AND s1.var = w.first WHERE abs(cc) <= 0.95),
w3 AS (SELECT *, (pa + pb) / 2 + rg AS p, (qa + qb) / 2 + rg AS q, (ra + rb) / 2 AS r FROM w2),
w4 AS (SELECT comparison, var, ord, 2 * (1 - exp(-((q * dx * dx - 2 * r * dx * dy + p * dy * dy) / (p * q - r * r) / 8
 + 0.5 * (ln(p * q - r * r) - 0.5 * (ln((pa + rg) * (qa + rg) - ra * ra) + ln((pb + rg) * (qb + rg) - rb * rb)))))) AS jm FROM w3),
s2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY jm DESC, ord) AS i FROM w4) WHERE i = 1)"""


@query("forward_selection", with_cte(CTE_GROUPS, "{{steps}}").replace(" {steps}", _steps_sql()) + """
SELECT comparison, 1 AS step, var, round(jm, 6) AS jm FROM s1 UNION ALL SELECT comparison, 2, var, round(jm, 6) FROM s2""")
def forward_selection(spark, sf_dir):
    """The best two variables of each comparison."""
    s, out = samples(spark, sf_dir), []
    for c in SEP.COMPARISONS:
        out += [(c, i, v, jm) for i, (v, jm) in enumerate(SEP.forward_selection(s, c, NAMES, 2), 1)]
    return rounded(spark.createDataFrame(out, "comparison string, step int, var string, jm double"), ())


WINDOW_NAMES = {"e1": "S2_REL1_arranque_NDVI", "e2": "S2_REL2_maximo_NDVI", "e3": "S2_REL3_postmax_NDVI", "e4": "S2_REL4_bajada_NDVI",
                "e5": "S2_FEN_NDVImax", "e6": "LS_REL2_maximo_NDVI", "e7": "S2_REL2_maximo_NDMI", "e8": "S2_00_siembra_NDVI"}


@query("class_profile", with_cte(CTE_GROUPS, """
SELECT clase, CASE var WHEN 'e1' THEN 'REL1_arranque' WHEN 'e2' THEN 'REL2_maximo' WHEN 'e3' THEN 'REL3_postmax' ELSE 'REL4_bajada' END AS "window",
 round(avg(value), 6) + 0e0 AS mean, round(stddev_pop(value), 6) + 0e0 AS sd FROM lg WHERE comparison = 'c4' AND var IN ('e1', 'e2', 'e3', 'e4') GROUP BY 1, 2"""))
def class_profile(spark, sf_dir):
    named = samples(spark, sf_dir).withColumnsRenamed(WINDOW_NAMES)
    return rounded(SEP.class_profile(named, list(WINDOW_NAMES.values()), "S2", "NDVI"), ())


@query("class_histogram", with_cte(CTE_GROUPS + """,
l4 AS (SELECT * FROM lg WHERE comparison = 'c4'),
qn AS (SELECT var, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM l4 GROUP BY 1),
bn AS (SELECT clase, var, CAST(least(floor((least(greatest(value, lo), hi) - lo) / (hi - lo) * 40), 39) AS INT) AS bin FROM l4 JOIN qn USING (var))""", """
SELECT clase, var, bin, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY clase, var) AS DOUBLE), 6) AS share FROM bn GROUP BY 1, 2, 3"""))
def class_histogram(spark, sf_dir):
    return rounded(SEP.class_histogram(samples(spark, sf_dir), NAMES), ())


# ------------------------------------------------------------------ agreement tables
PRED = "CASE WHEN e1 > 2e-2 AND e3 < 5e-2 THEN 'maiz' WHEN e4 > 0 THEN 'sorgo' WHEN px_id % 50 = 7 THEN 'nube' ELSE 'otros' END"
CTE_CONF = f"""pr AS (SELECT grupo, clase, {PRED} AS pred FROM {{samples}} s),
lb AS (SELECT * FROM (VALUES ('maiz'), ('sorgo'), ('otros')) AS t(clase)),
cm AS (SELECT lb.clase, count(*) FILTER (WHERE pred = 'maiz') AS maiz, count(*) FILTER (WHERE pred = 'sorgo') AS sorgo, count(*) FILTER (WHERE pred = 'otros') AS otros
  FROM lb LEFT JOIN pr ON pr.clase = lb.clase GROUP BY 1)"""


def pairs(spark, sf_dir) -> DataFrame:
    return samples(spark, sf_dir).select("grupo", "clase", F.expr(PRED).alias("pred"))


@query("confusion", with_cte(CTE_CONF, "SELECT clase, maiz, sorgo, otros FROM cm"))
def confusion(spark, sf_dir):
    return CL.confusion(pairs(spark, sf_dir))


@query("confusion_steps", with_cte(CTE_CONF + """,
c1 AS (SELECT CASE WHEN clase = 'otros' THEN 'otros' ELSE 'maiz+sorgo' END AS clase, sum(maiz + sorgo) AS a, sum(otros) AS b FROM cm GROUP BY 1)""", """
SELECT 'step1' AS step, clase, CAST(a AS BIGINT) AS n_first, CAST(b AS BIGINT) AS n_second FROM c1 UNION ALL SELECT 'step2', clase, maiz, sorgo FROM cm WHERE clase <> 'otros'"""))
def confusion_steps(spark, sf_dir):
    one, two = CL.two_step(pairs(spark, sf_dir))
    a = one.select(F.lit("step1").alias("step"), "clase", F.col("maiz+sorgo").alias("n_first"), F.col("otros").alias("n_second"))
    return a.unionByName(two.select(F.lit("step2").alias("step"), "clase", F.col("maiz").alias("n_first"), F.col("sorgo").alias("n_second")))


@query("accuracy_scores", with_cte(CTE_CONF + """,
sc AS (SELECT clase, maiz + sorgo + otros AS n, CASE clase WHEN 'maiz' THEN maiz WHEN 'sorgo' THEN sorgo ELSE otros END AS hit,
  CASE clase WHEN 'maiz' THEN sum(maiz) OVER () WHEN 'sorgo' THEN sum(sorgo) OVER () ELSE sum(otros) OVER () END AS col FROM cm),
s2 AS (SELECT *, hit / nullif(CAST(n AS DOUBLE), 0) AS pa, hit / nullif(CAST(col AS DOUBLE), 0) AS ua FROM sc)""", """
SELECT clase, n, round(pa, 6) AS producer, round(ua, 6) AS "user", round(2 * pa * ua / nullif(pa + ua, 0), 6) AS f1,
 round(sum(hit) OVER () / CAST(sum(n) OVER () AS DOUBLE), 6) AS oa, round(avg(pa) OVER (), 6) AS balanced FROM s2"""))
def accuracy_scores(spark, sf_dir):
    return rounded(CL.scores(CL.confusion(pairs(spark, sf_dir))), ())


@query("field_vote", with_cte(CTE_CONF + """,
v AS (SELECT grupo, pred, row_number() OVER (PARTITION BY grupo ORDER BY count(*) DESC, pred) AS i FROM pr GROUP BY 1, 2),
w AS (SELECT grupo, clase, row_number() OVER (PARTITION BY grupo ORDER BY count(*) DESC, clase) AS i FROM pr GROUP BY 1, 2)""", """
SELECT grupo, clase, pred FROM v JOIN w USING (grupo) WHERE v.i = 1 AND w.i = 1"""))
def field_vote(spark, sf_dir):
    return CL.field_vote(pairs(spark, sf_dir))


@query("missing_sentinel", oracle("SELECT px_id, " + ", ".join(f"round(coalesce({n}, -9999e0), 6) + 0e0 AS {n}" for n in NAMES) + " FROM {samples} s"))
def missing_sentinel(spark, sf_dir):
    return rounded(CL.fill_missing(samples(spark, sf_dir).select("px_id", *NAMES), NAMES), ())


# ------------------------------------------------------------------ forests
# Variables moved apart by class, so the right answer of a forest is known exactly.
APART = [n for n in NAMES if n != "e2"]


def apart(spark, sf_dir) -> DataFrame:
    shift = F.when(F.col("clase") == "maiz", 0.0).when(F.col("clase") == "sorgo", 10.0).otherwise(20.0)
    return samples(spark, sf_dir).withColumns({n: F.col(n) + shift for n in APART})


FOLDS = 5
#: The deal one field after another: each to the fold with the least of its class, then the least in all, then the first.
CTE_FOLDS = f"""s AS (SELECT * FROM {{samples}} s),
fl AS (SELECT grupo, any_value(clase) AS clase, count(*) AS n FROM s GROUP BY 1),
rk AS (SELECT *, row_number() OVER (ORDER BY list_position(['maiz', 'sorgo', 'otros'], clase), n DESC, md5(grupo || ':0')) AS r FROM fl),
dl AS (SELECT 0 AS i, {[0] * FOLDS} AS own, {[0] * FOLDS} AS total, NULL::VARCHAR AS clase, NULL::VARCHAR AS grupo, NULL::INT AS fold
 UNION ALL SELECT i + 1, list_transform(c, lambda v, j: CASE WHEN j = f + 1 THEN v + n ELSE v END), list_transform(total, lambda v, j: CASE WHEN j = f + 1 THEN v + n ELSE v END), nc, ng, CAST(f AS INT)
 FROM (SELECT *, list_min(list_transform(range({FOLDS}), lambda j: {{{{'a': c[j + 1], 'b': total[j + 1], 'f': j}}}})).f AS f
  FROM (SELECT dl.i, dl.total, rk.n, rk.clase AS nc, rk.grupo AS ng, CASE WHEN dl.clase IS DISTINCT FROM rk.clase THEN {[0] * FOLDS} ELSE own END AS c FROM dl JOIN rk ON rk.r = dl.i + 1))),
fo AS (SELECT grupo, fold FROM dl WHERE i > 0)"""


def with_recursive(cte: str, select: str) -> str:
    return oracle("WITH RECURSIVE " + cte + " " + select)


@query("group_folds", with_recursive(CTE_FOLDS, "SELECT grupo, fold FROM fo"))
def group_folds(spark, sf_dir):
    folds, _, _ = CL.group_folds(samples(spark, sf_dir), FOLDS)
    return folds


def _forest_query(name: str, mode: str):
    @query(name, oracle("SELECT px_id, clase, clase AS pred, 1e0 AS p_total FROM {samples} s"))
    def run(spark, sf_dir):
        s = apart(spark, sf_dir)
        model = CL.fit_final(s, APART, mode)
        p = model.probabilities(CL.assemble(s, APART))
        total = F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x)
        return rounded(p.select("px_id", "clase", CL.predicted(F.col("p")).alias("pred"), total.alias("p_total")), ())


_forest_query("rf_flat", "flat")
_forest_query("rf_hierarchical", "hierarchical")


@query("fit_final", oracle("""SELECT step, 200 AS trees, CAST(count(DISTINCT g) AS INT) AS classes, CAST(sum(least(n, 5000)) AS BIGINT) AS training_rows, 8 AS variables, TRUE AS fits
FROM (SELECT 'step1' AS step, clase, clase = 'otros' AS g, count(*) AS n FROM {samples} s GROUP BY ALL UNION ALL
 SELECT 'step2', clase, clase = 'maiz', count(*) FROM {samples} s WHERE clase <> 'otros' GROUP BY ALL) GROUP BY 1"""))
def fit_final(spark, sf_dir):
    """The final two-step forest by its own record, and whether it knows nearly all of its training rows."""
    s = samples(spark, sf_dir)
    m = CL.fit_final(s, NAMES, "hierarchical")
    known = CL.assemble(CL.cap(s, ["clase"], CL.MAX_PER_CLASS), NAMES)
    p = m.probabilities(known).withColumn("pred", CL.predicted(F.col("p")))
    hit, crops = F.col("pred") == F.col("clase"), F.col("clase").isin(*CL.C4)
    facts = p.agg(F.count(F.lit(1)).alias("n1"), F.count_if(crops).alias("n2"), (F.avg(hit.cast("int")) > 0.9).alias("f1"), (F.avg(F.when(crops, (F.col("step2") == F.col("clase")).cast("int"))) > 0.9).alias("f2"))
    per_step = F.array(*[F.struct(F.lit(step).alias("step"), F.lit(model.getNumTrees).alias("trees"), F.lit(model.numClasses).alias("classes"), F.col(n).alias("training_rows"),
                                  F.lit(model.numFeatures).alias("variables"), F.col(f).alias("fits")) for step, model, n, f in (("step1", m.first, "n1", "f1"), ("step2", m.second, "n2", "f2"))])
    return facts.select(F.inline(per_step))


@query("cross_validate", with_recursive(CTE_FOLDS, "SELECT px_id, s.grupo, s.clase, fold, TRUE AS known_class, 1e0 AS p_total FROM s JOIN fo USING (grupo)"))
def cross_validate(spark, sf_dir):
    """Every sample predicted once, by the forest of its own field's fold."""
    preds = CL.cross_validate(samples(spark, sf_dir), NAMES, "hierarchical", FOLDS)
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    return rounded(preds.select("px_id", "grupo", "clase", "fold", F.col("pred").isin(*CL.CLASSES).alias("known_class"), total.alias("p_total")), ())


@query("training_sets", with_recursive(CTE_FOLDS, """, fd AS (SELECT px_id, clase, fold FROM s JOIN fo USING (grupo)),
 ft AS (SELECT px_id, clase, CAST(f AS INT) AS for_fold FROM fd, range(5) AS t(f) WHERE f <> fold)
 SELECT px_id, clase, for_fold FROM (SELECT *, row_number() OVER (PARTITION BY for_fold, clase ORDER BY md5(px_id || ':' || for_fold), px_id) AS i FROM ft) WHERE i <= 5000""").replace(" , fd", ", fd"))
def training_sets(spark, sf_dir):
    """The capped training rows of every fold."""
    s = samples(spark, sf_dir)
    folds, k, _ = CL.group_folds(s, FOLDS)
    return CL.training_sets(CL.with_folds(s, folds).withColumn("features", F.lit(0)), k).select("px_id", "clase", "for_fold")


def importance(spark, sf_dir) -> DataFrame:
    return CL.cross_validate(samples(spark, sf_dir), NAMES, "hierarchical", FOLDS, importance=True)[1]


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    return rounded(importance(spark, sf_dir), ())


@query("importance_topk", with_cte(CTE_PIXEL, """SELECT var, round(max(bal_acc) FILTER (WHERE comparison = 'c4'), 6) AS step1, round(max(bal_acc) FILTER (WHERE comparison = 'ms'), 6) AS step2
FROM th GROUP BY 1 ORDER BY max(bal_acc) FILTER (WHERE comparison = 'c4') + max(bal_acc) FILTER (WHERE comparison = 'ms') DESC, var LIMIT 5"""))
def importance_topk(spark, sf_dir):
    """The five strongest variables, by the accuracy of their best single rule in each step."""
    th = SEP.best_threshold(pixel_groups(spark, sf_dir))
    step = lambda c: F.max(F.when(F.col("comparison") == c, F.col("bal_acc")))
    return rounded(CL.importance_topk(th.groupBy("var").agg(step("c4").alias("step1"), step("ms").alias("step2")), 5), ())


@query("predict_map", oracle("""SELECT px_id, CASE WHEN px_id % 13 = 0 THEN 0 WHEN clase = 'maiz' THEN 1 WHEN clase = 'sorgo' THEN 2 ELSE 3 END AS clase,
  CASE WHEN px_id % 13 = 0 THEN 'none' ELSE 'about 100' END AS percentages FROM {samples} s"""))
def predict_map(spark, sf_dir):
    """Every sample pixel classified; those with too few variables present get no class and no percentages."""
    s = apart(spark, sf_dir)
    model = CL.fit_final(s, APART, "flat")
    gaps = [F.when((F.col("px_id") % 13 != 0) | (F.lit(i) > 3), F.col(n)).alias(n) for i, n in enumerate(APART)]
    total = F.col("p_maiz") + F.col("p_sorgo") + F.col("p_otros")
    return CL.predict_map(model, s.select("px_id", *gaps)).select(
        "px_id", "clase", F.when(total == 765, "none").when(total.between(98, 102), "about 100").otherwise("wrong").alias("percentages"))


@query("snk_report", with_cte(CTE_CONF + """,
v AS (SELECT grupo, pred, row_number() OVER (PARTITION BY grupo ORDER BY count(*) DESC, pred) AS i FROM pr GROUP BY 1, 2),
w AS (SELECT grupo, clase, row_number() OVER (PARTITION BY grupo ORDER BY count(*) DESC, clase) AS i FROM pr GROUP BY 1, 2),
fv AS (SELECT clase, pred FROM v JOIN w USING (grupo) WHERE v.i = 1 AND w.i = 1),
lg AS (SELECT 'pixel' AS level, clase, pred, n FROM (UNPIVOT cm ON maiz, sorgo, otros INTO NAME pred VALUE n)
 UNION ALL SELECT 'field', a.clase, b.clase, count(fv.clase) FROM lb a CROSS JOIN lb b LEFT JOIN fv ON fv.clase = a.clase AND fv.pred = b.clase GROUP BY 2, 3),
st AS (SELECT CASE WHEN clase = 'otros' THEN 'otros' ELSE 'maiz+sorgo' END AS clase, CASE WHEN pred = 'otros' THEN 'otros' ELSE 'maiz+sorgo' END AS pred, n FROM lg WHERE level = 'pixel')""",
"""SELECT level, clase, pred, CAST(n AS BIGINT) AS n FROM lg UNION ALL SELECT 'step1', clase, pred, CAST(sum(n) AS BIGINT) FROM st GROUP BY 2, 3
 UNION ALL SELECT 'step2', clase, pred, CAST(n AS BIGINT) FROM lg WHERE level = 'pixel' AND clase <> 'otros' AND pred <> 'otros'
 UNION ALL SELECT 'parameter', 'trees', '200', 5"""))
def snk_report(spark, sf_dir):
    """Tables of all levels and the run's parameters, written as a report and read back."""
    path = scratch_path(spark, "report")
    own = written_once(pairs(spark, sf_dir))
    first, second = CL.two_step(own)
    RES.write_report(path, {"pixel": CL.confusion(own), "field": CL.confusion(CL.field_vote(own)), "step1": first, "step2": second}, parameters={"trees": CL.N_TREES, "k": FOLDS})
    used = RES.read_parameters(spark, path)
    facts = spark.createDataFrame([("parameter", "trees", str(used["trees"]), used["k"])], "level string, clase string, pred string, n bigint")
    return RES.read_confusion(spark, path).unionByName(facts)


@query("snk_features", with_cte(CTE_LONG + f""",
fx AS (SELECT sensor, px_id, {STAGE_SQL} AS win, """ + ", ".join(f"median({v}) AS {v}" for v in VARS) + f""", count(NDVI) AS nobs FROM obs WHERE {STAGE_SQL} <> 'fuera_de_etapa' GROUP BY 1, 2, 3),
sp AS (SELECT px_id, name, value, CASE WHEN name LIKE 'S2%' THEN 'S2' ELSE 'LANDSAT' END AS sensor, CASE WHEN name LIKE '%FEN%' THEN 'FEN'
  ELSE regexp_extract(name, '(REL[0-9]_[a-z]+)_', 1) END AS w FROM long UNION ALL """ + " UNION ALL ".join(
    f"SELECT px_id, '{'S2' if s == 'S2' else 'LS'}_' || win || '_{n}', {v}, sensor, win FROM fx WHERE sensor = '{s}'" for s in ("S2", "LANDSAT") for v, n in band_names(s)) + """),
cn AS (SELECT sensor, win AS w, CAST(sum(nobs) AS BIGINT) AS nobs, count(*) AS pixels FROM (SELECT sensor, win, nobs FROM rel UNION ALL SELECT sensor, win, nobs FROM fx) GROUP BY 1, 2)""",
"""SELECT sensor, w AS "window", count(*) AS rows, count(DISTINCT name) AS names, count(value) AS present, round(sum(value), 4) + 0e0 AS total, any_value(nobs) AS nobs, any_value(pixels) AS pixels
 FROM sp LEFT JOIN cn USING (sensor, w) GROUP BY 1, 2"""))
def snk_features(spark, sf_dir):
    """Variables of curve, relative windows and stages, counts, catalogue and parameters, written and read back."""
    path = scratch_path(spark, "variables")
    pixels = written_once(pixel_windows(spark, sf_dir, [s[0] for s in STAGES["OI"]]))
    counts = pixels.select("sensor", "px_id", F.inline("windows")).select("sensor", "window", "px_id", "nobs")
    RES.write_features(features_of_pixels(pixels, VARS), path, {"step": STEP, "variables": list(VARS)}, counts)
    rows, catalogue, _ = RES.read_features(spark, path)
    listed = rows.join(catalogue.select("name", "sensor", "window"), ["name", "sensor", "window"], "left_semi")
    counted = RES.read_counts(spark, path).groupBy("sensor", "window").agg(F.sum("nobs").alias("nobs"), F.count(F.lit(1)).alias("pixels"))
    return listed.groupBy("sensor", "window").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("name").alias("names"), F.count("value").alias("present"), (F.round(F.sum("value"), 4) + 0.0).alias("total")).join(
        counted, ["sensor", "window"], "left")


# ------------------------------------------------------------------ groups
@query("kmeans_groups", oracle("""
WITH s AS (SELECT px_id, clase, e2 IS NULL AS gap FROM {samples} s),
r AS (SELECT clase, CAST(row_number() OVER (ORDER BY count(*) DESC) AS INT) AS g FROM s WHERE NOT gap GROUP BY 1)
SELECT px_id, CASE WHEN gap THEN 0 ELSE g END AS "group" FROM s JOIN r USING (clase)"""))
def kmeans_groups(spark, sf_dir):
    """Three groups set apart by class; the largest is 1 and incomplete pixels are 0."""
    s = apart(spark, sf_dir).withColumn("e2", F.col("e2") + F.col("e1"))
    return K.kmeans_groups(s, NAMES, 3, 1)


@query("group_profile", oracle("""
WITH g AS (SELECT *, CAST(px_id % 4 AS INT) AS grp, CAST(floor(px_id / 7) % 6 AS INT) AS code FROM {samples} s),
a AS (SELECT grp AS "group", count(*) AS pixels, round(count(*) * 4e-4, 6) AS km2, round(avg(e1), 6) + 0e0 AS e1, round(avg(e2), 6) + 0e0 AS e2,
 """ + ", ".join(f"count(*) FILTER (WHERE code = {i}) AS ref_{n}" for i, n in enumerate(K.CODE_NAMES)) + """ FROM g WHERE grp > 0 GROUP BY 1),
l AS (SELECT *, [""" + ", ".join(f"ref_{n}" for n in K.CODE_NAMES[1:]) + """] AS c FROM a)
SELECT * EXCLUDE (c), ['maiz', 'sorgo', 'ambos', 'ninguno', 'incompleta'][list_position(c, list_max(c))] AS dominant,
 round(list_max(c) / CAST(list_sum(c) AS DOUBLE), 6) AS dominant_share FROM l"""))
def group_profile(spark, sf_dir):
    g = samples(spark, sf_dir).withColumns({"group": (F.col("px_id") % 4).cast("int"), "code": (F.floor(F.col("px_id") / 7) % 6).cast("int")})
    return rounded(K.group_profile(g, ["e1", "e2"], 4e-4, "code"), ())
