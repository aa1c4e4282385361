"""Reliability and Rasch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom import model
from surveyloom.functions.numeric import tidy
from surveyloom.operators import groups, rasch, reliability, screening
from surveyloom.plans import tables as t
from surveyloom.plans.registry import query
from surveyloom.session import cut_lineage


def _rounded(df, *cols):
    return df.withColumns({c: tidy(F.col(c)) for c in cols})


_SCALED = f"WITH {t.SCORED}, s AS (SELECT id, scale, item, score::DOUBLE AS score FROM scored)"


@query(
    "rel1_score_items",
    f"""{_SCALED}, m AS (SELECT scale, item, median(score) AS mid FROM s GROUP BY ALL),
        grid AS (SELECT c_custkey AS id, scale, item, mid FROM customer, m)
        SELECT id, scale, round(avg(coalesce(s.score, g.mid)), 6) AS score FROM grid g LEFT JOIN s USING (id, scale, item) GROUP BY id, scale""",
)
def score_items(spark, d):
    out = reliability.score_items(t.respondents(spark, d), cut_lineage(t.responses(spark, d)), t.SCALE_ROWS)
    return _rounded(out, "score")


_ALPHA = """pr AS (SELECT a.scale, a.item AS item_a, b.item AS item_b, covar_samp(a.score, b.score) AS cov,
      covar_samp(a.score, b.score) / nullif(stddev_samp(a.score) * stddev_samp(b.score), 0) AS r
      FROM s a JOIN s b ON a.id = b.id AND a.scale = b.scale AND a.item < b.item GROUP BY ALL),
    v AS (SELECT scale, sum(v) AS var, count(*) AS k FROM (SELECT scale, item, var_samp(score) AS v FROM s GROUP BY ALL) GROUP BY scale),
    q AS (SELECT scale, sum(cov) AS cov, avg(r) AS mean_r FROM pr GROUP BY scale),
    alpha AS (SELECT scale, k, k / (k - 1)::DOUBLE * (1 - var / (var + 2 * cov)) AS raw_alpha, k * mean_r / (1 + (k - 1) * mean_r) AS std_alpha, mean_r
    FROM v JOIN q USING (scale))"""


@query(
    "rel2_cronbach_alpha",
    f"""{_SCALED}, {_ALPHA} SELECT scale, k, round(raw_alpha, 6) AS raw_alpha, round(std_alpha, 6) AS std_alpha, round(mean_r, 6) AS mean_r FROM alpha""",
)
def cronbach_alpha(spark, d):
    return _rounded(reliability.cronbach_alpha(cut_lineage(t.responses(spark, d)), t.SCALE_ROWS), "raw_alpha", "std_alpha", "mean_r")


@query(
    "rel3_item_total_correlation",
    f"""{_SCALED}, tot AS (SELECT id, scale, sum(score) AS total FROM s GROUP BY ALL HAVING count(*) = 4)
        SELECT scale, item, round(covar_samp(score, total - score) / nullif(stddev_samp(score) * stddev_samp(total - score), 0), 6) AS r_drop,
               count(*) AS n FROM s JOIN tot USING (id, scale) GROUP BY ALL""",
)
def item_total_correlation(spark, d):
    return _rounded(reliability.item_total_correlation(t.responses(spark, d), t.SCALE_ROWS), "r_drop")


@query(
    "rel4_scale_intercorrelation",
    f"""{_SCALED}, {_ALPHA}, m AS (SELECT id, scale, avg(score) AS x FROM s GROUP BY ALL),
        c AS (SELECT a.scale AS scale_a, b.scale AS scale_b, count(*) AS n, covar_samp(a.x, b.x) / (stddev_samp(a.x) * stddev_samp(b.x)) AS r
              FROM m a JOIN m b ON a.id = b.id AND a.scale < b.scale GROUP BY ALL)
        SELECT scale_a, scale_b, n, round(r, 6) AS r,
               round(CASE WHEN x.raw_alpha * y.raw_alpha > 0 THEN r / sqrt(greatest(x.raw_alpha * y.raw_alpha, 0)) END, 6) AS r_corrected
        FROM c JOIN alpha x ON x.scale = scale_a JOIN alpha y ON y.scale = scale_b""",
)
def scale_intercorrelation(spark, d):
    return _rounded(reliability.scale_intercorrelation(cut_lineage(t.responses(spark, d)), t.SCALE_ROWS), "r", "r_corrected")


def rasch_sample(spark, d):
    """Keyed answers of respondents within the Rasch limits."""
    cells = cut_lineage(t.answers(spark, d))
    kept = screening.screen(t.screening_stats(spark, d, cells), model.RASCH_SAMPLE).select("id")
    return cut_lineage(t.keyed_scores(cells).join(kept, "id", "left_semi"))


_SAMPLE = (
    t.SCREEN.replace(t.ANSWERS, t.COGNITIVE)
    + ", sample AS (SELECT * FROM cognitive WHERE id IN (SELECT id FROM screened WHERE miss_c < 0.5 AND sincere <= 5))"
)
_DIFFICULTY = """, wins AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n FROM sample a JOIN sample b ON a.id = b.id
      AND a.score = 1 AND b.score = 0 GROUP BY ALL),
    gaps AS (SELECT w.item_a AS item, sum(ln(v.n / w.n::DOUBLE)) / (count(*) + 1) AS g, count(*) AS partners FROM wins w JOIN wins v ON w.item_a = v.item_b AND w.item_b = v.item_a GROUP BY 1),
    difficulty AS (SELECT item, g - avg(g) OVER () AS difficulty, partners FROM gaps)"""
_THETA = """, persons AS (SELECT id, list(item ORDER BY item) AS answered, sum(score)::BIGINT AS raw FROM sample GROUP BY id),
    keys AS (SELECT DISTINCT answered, raw FROM persons WHERE raw > 0 AND raw < len(answered)),
    betas AS (SELECT answered, raw, list(difficulty) AS b FROM (SELECT answered, raw, unnest(answered) AS item FROM keys) JOIN difficulty USING (item) GROUP BY ALL),
    newton AS (SELECT answered, raw, b, 0 AS step, 0.0::DOUBLE AS theta FROM betas UNION ALL
      SELECT answered, raw, b, step + 1, theta + greatest(-1, least(1, (raw - list_sum(list_transform(b, lambda x: 1 / (1 + exp(x - theta)))))
        / list_sum(list_transform(b, lambda x: exp(x - theta) / pow(1 + exp(x - theta), 2))))) FROM newton WHERE step < 30),
    solved AS (SELECT answered, raw, theta, 1 / sqrt(list_sum(list_transform(b, lambda x: exp(x - theta) / pow(1 + exp(x - theta), 2)))) AS se
      FROM newton WHERE step = 30),
    theta AS (SELECT id, p.raw, theta, se FROM persons p LEFT JOIN solved s ON p.answered = s.answered AND p.raw = s.raw)"""
_RASCH = "WITH RECURSIVE " + _SAMPLE + _DIFFICULTY + _THETA
_PARTS = """, parts AS (SELECT id, item, score, 1 / (1 + exp(difficulty - theta)) AS p FROM sample JOIN theta USING (id) JOIN difficulty USING (item)
    WHERE theta IS NOT NULL)"""


@query(
    "ras1_raw_score_counts",
    f"""WITH {_SAMPLE}, g AS (SELECT id, string_agg(item, ',' ORDER BY item) AS pattern, sum(score)::BIGINT AS raw FROM sample GROUP BY id)
        SELECT pattern, raw, count(*) AS n FROM g GROUP BY ALL""",
)
def raw_score_counts(spark, d):
    return rasch.raw_score_counts(rasch_sample(spark, d))


@query("ras1_item_totals", f'WITH {_SAMPLE} SELECT item, count(*) AS n, sum(score)::BIGINT AS "right" FROM sample GROUP BY item')
def item_totals(spark, d):
    return rasch.item_totals(rasch_sample(spark, d))


@query("ras2_item_difficulty", f"WITH {_SAMPLE}{_DIFFICULTY} SELECT item, round(difficulty, 6) AS difficulty, partners FROM difficulty")
def item_difficulty(spark, d):
    return _rounded(rasch.item_difficulty(rasch_sample(spark, d), t.COG_NAMES), "difficulty")


def _fitted(spark, d):
    sample = rasch_sample(spark, d)
    difficulty = cut_lineage(rasch.item_difficulty(sample, t.COG_NAMES))
    return sample, difficulty, rasch.person_theta(sample, difficulty)


@query(
    "ras3_person_theta",
    f"{_RASCH} SELECT id, raw, round(theta, 6) AS theta, round(se, 6) AS se, round(theta, 2) AS proficiency FROM theta",
)
def person_theta(spark, d):
    _, _, theta = _fitted(spark, d)
    return _rounded(theta, "theta", "se")


@query(
    "ras4_item_fit",
    f"""{_RASCH}{_PARTS} SELECT item, round(sum(pow(score - p, 2)) / sum(p * (1 - p)), 6) AS infit,
        round(avg(pow(score - p, 2) / (p * (1 - p))), 6) AS outfit, count(*) AS n FROM parts GROUP BY item""",
)
def item_fit(spark, d):
    return _rounded(rasch.item_fit(rasch.residuals(*_fitted(spark, d), len(t.COG_NAMES))), "infit", "outfit")


_PERSON_FIT = f"""{_RASCH}{_PARTS}, f AS (SELECT id, sum(pow(score - p, 2)) / sum(p * (1 - p)) AS infit,
    sqrt(sum(p * (1 - p) * (pow(p, 3) + pow(1 - p, 3)) - pow(p * (1 - p), 2))) / sum(p * (1 - p)) AS q FROM parts GROUP BY id),
    z AS (SELECT id, infit, (cbrt(infit) - 1) * 3 / q + q / 3 AS infit_z FROM f WHERE q > 0)"""


@query("ras5_person_fit", _PERSON_FIT + " SELECT id, round(infit, 6) AS infit, round(infit_z, 6) AS infit_z, infit_z > 1.96 AS misfit FROM z")
def person_fit(spark, d):
    return _rounded(rasch.person_fit(rasch.residuals(*_fitted(spark, d), len(t.COG_NAMES))), "infit", "infit_z")


@query("ras5_misfit_share", _PERSON_FIT + " SELECT count(*) AS n, round(avg((infit_z > 1.96)::INT), 6) AS misfit_share FROM z")
def misfit_share(spark, d):
    fit = rasch.person_fit(rasch.residuals(*_fitted(spark, d), len(t.COG_NAMES)))
    return _rounded(rasch.misfit_share(fit), "misfit_share")


@query(
    "ras6_separation_reliability",
    f"""{_RASCH} SELECT round(var_samp(theta), 6) AS variance, round(avg(se * se), 6) AS mse,
        round((var_samp(theta) - avg(se * se)) / var_samp(theta), 6) AS reliability FROM theta""",
)
def separation_reliability(spark, d):
    _, _, theta = _fitted(spark, d)
    return _rounded(rasch.separation_reliability(theta), "variance", "mse", "reliability")


@query(
    "ras7_item_curves",
    f"""WITH {_SAMPLE}{_DIFFICULTY} SELECT item, i::INT AS point, round(-4 + i * 0.1::DOUBLE, 6) AS theta,
        round(1 / (1 + exp(difficulty - (-4 + i * 0.1::DOUBLE))), 6) AS p FROM difficulty, range(81) r(i)""",
)
def item_curves(spark, d):
    difficulty = rasch.item_difficulty(rasch_sample(spark, d), t.COG_NAMES)
    return _rounded(rasch.item_curves(difficulty), "theta", "p")


@query(
    "ras7_person_histogram",
    f"""{_RASCH}, e AS (SELECT min(theta) AS lo, (max(theta) - min(theta)) / 30.0::DOUBLE AS w FROM theta)
        SELECT least(floor((theta - lo) / w), 29)::INT AS bin, count(*) AS n FROM theta, e WHERE theta IS NOT NULL GROUP BY ALL""",
)
def person_histogram(spark, d):
    _, _, theta = _fitted(spark, d)
    return groups.histogram(theta, "theta", 30)


@query(
    "ras8_theta_by_group",
    f"""{_RASCH}, j AS (SELECT role, theta, (raw - avg(raw) OVER ()) / stddev_samp(raw) OVER () AS z FROM theta JOIN respondents USING (id) WHERE theta IS NOT NULL)
        SELECT role, count(*) AS n, round(avg(theta), 6) AS mean, round(stddev_samp(theta), 6) AS sd, round(stddev_samp(theta) / sqrt(count(*)), 6) AS se,
               round(avg(z), 6) AS mean_raw_z FROM j GROUP BY role""",
)
def theta_by_group(spark, d):
    _, _, theta = _fitted(spark, d)
    return _rounded(rasch.theta_by_group(theta, t.respondents(spark, d), "role"), "mean", "sd", "se", "mean_raw_z")
