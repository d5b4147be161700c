"""DuckDB oracle SQL for the registered queries (same names as ``plans.queries``).

Plain SQL over the driver tables; fixed values (bins, whitelists, margins, thresholds)
come from the library, the logic does not.
Static SQL cannot change its own schema, so two data-dependent choices are fixed
here from FIXTURES.md: the Buenos Aires survey does contain a GBA municipality
(``la matanza``), and the candidates of the survey view are ``a``, ``b``, ``c``.
"""

from __future__ import annotations

from tallyrake.plans import sqltext as S
from tallyrake.sources.census import calibration_variables, targets_dict
from tallyrake.sources.driver_view import SURVEY_COLUMNS

NATIVE_SWEEPS = 6     # of the fixed-sweep cross-check only
CANDIDATES = ["a", "b", "c"]  # fixed by the survey view mapping (FIXTURES.md)
EVENT_TYPES_CTE = "SELECT DISTINCT voto AS candidate FROM ev WHERE voto IS NOT NULL"


def _r(expr: str, alias: str) -> str:
    return f"round({expr}, 6) AS {alias}"


def _prepared(population="pampeana", restrict_bsas=False, dups=False):
    ctes = S.survey_dups() if dups else S.survey()
    src = "survey"
    if restrict_bsas:
        ctes += [("survey_r", "SELECT * FROM survey WHERE lower(trim(estrato)) IN "
                              + S.in_list(["buenos aires"] + S.GBA_MUNICIPALITIES))]
        src = "survey_r"
    bsas = population == "buenos_aires"
    ctes += S.clean(src) + S.normalize("cleaned", population, bsas) + S.windows("normed")
    return ctes


def _raked(window, population="pampeana", restrict_bsas=False, sweeps=None):
    bsas = population == "buenos_aires"
    variables = calibration_variables(population, bsas)
    ctes = _prepared(population, restrict_bsas)
    ctes += S.rake("windowed", window, variables, targets_dict(population, bsas), sweeps)
    return ctes


SURVEY_OUT = ", ".join(_r(c, c) if c in ("edad", "imagen_del_candidato") else c for c in SURVEY_COLUMNS)


def survey_clean() -> str:
    return S.with_query(S.survey() + S.clean("survey"), f"SELECT {SURVEY_OUT} FROM cleaned")


def survey_dedup_lines() -> str:
    return S.with_query(S.survey_dups() + S.clean("survey"), f"SELECT {SURVEY_OUT} FROM cleaned")


def survey_null_profile() -> str:
    parts = []
    for stage, src in (("raw", "survey"), ("clean", "cleaned")):
        for c in SURVEY_COLUMNS:
            parts.append(f"SELECT '{c}' AS \"column\", round(avg(CAST({c} IS NULL AS DOUBLE)) * 100.0, 6) AS null_pct, "
                         f"'{stage}' AS stage FROM {src}")
    return S.with_query(S.survey() + S.clean("survey"), "\nUNION ALL\n".join(parts))


def survey_normalize_nacional() -> str:
    return S.with_query(_prepared("nacional"), "SELECT encuesta, estrato, sexo, edad_cat, region FROM windowed")


def survey_normalize_bsas() -> str:
    return S.with_query(_prepared("buenos_aires", restrict_bsas=True),
                        "SELECT encuesta, estrato, edad_cat, estrato_bsas, true AS has_municipalities FROM windowed")


def window_counts() -> str:
    lab = {
        "day": "strftime(win, '%Y-%m-%d')",
        "week": "strftime(win, '%Y-%m-%d') || '/' || strftime(CAST(win + INTERVAL 6 DAY AS DATE), '%Y-%m-%d')",
        "month": "strftime(win, '%Y-%m')",
    }
    parts = [f"SELECT '{u}' AS unit, win, {lab[u]} AS label, n FROM "
             f"(SELECT {col} AS win, count(*) AS n FROM windowed GROUP BY {col}) t"
             for u, col in (("day", "win_d"), ("week", "win_s"), ("month", "win_m"))]
    return S.with_query(_prepared(), "\nUNION ALL\n".join(parts))


def rake_month_weights() -> str:
    return S.with_query(_raked("win_m"), "SELECT encuesta, win_m, round(peso, 6) AS peso FROM raked")


def _diag(window, population="pampeana") -> str:
    return S.with_query(_raked(window, population), S.rake_diagnostics("raked_cells", window))


def rake_month_nacional_diagnostics() -> str:
    return _diag("win_m", "nacional")


def rake_month_diagnostics() -> str:
    return _diag("win_m")


def rake_week_diagnostics() -> str:
    return _diag("win_s")


def rake_day_diagnostics() -> str:
    return _diag("win_d")


def rake_month_bsas() -> str:
    return S.with_query(_raked("win_m", "buenos_aires", restrict_bsas=True),
                        "SELECT encuesta, win_m, estrato_bsas, round(peso, 6) AS peso FROM raked")


def rake_month_native() -> str:
    return S.with_query(_raked("win_m", sweeps=NATIVE_SWEEPS), "SELECT encuesta, win_m, round(peso, 6) AS peso FROM raked")


def _three_units():
    variables, tgt = calibration_variables("pampeana", False), targets_dict("pampeana", False)
    ctes = _prepared()
    for unit in "dsm":
        ctes = ctes + S.rake("windowed", f"win_{unit}", variables, tgt, weight=f"peso_{unit}", name=f"r{unit}")
    return ctes


def rake_units_weights() -> str:
    return S.with_query(_three_units(), """SELECT rd.encuesta, round(peso_d, 6) AS peso_d, round(peso_s, 6) AS peso_s, round(peso_m, 6) AS peso_m
FROM rd JOIN rs ON rs.encuesta = rd.encuesta JOIN rm ON rm.encuesta = rd.encuesta""")


# ----------------------------------------------------------------------- tracking

def _score_sums(src: str, window: str, w: str) -> str:
    return f"""SELECT {window}, count(imagen_del_candidato) AS n,
  sum(CASE WHEN imagen_del_candidato IS NOT NULL THEN {w} END) AS sw,
  sum(CASE WHEN imagen_del_candidato IS NOT NULL THEN {w} * imagen_del_candidato END) AS swx,
  sum(CASE WHEN imagen_del_candidato IS NOT NULL THEN {w} * imagen_del_candidato * imagen_del_candidato END) AS swxx,
  sum(CASE WHEN imagen_del_candidato IS NOT NULL THEN {w} * {w} END) AS sww
FROM {src} GROUP BY {window}"""


def _score_intervals(window: str) -> str:
    return f"""SELECT {window}, n, {_r('sw * sw / sww', 'n_eff')}, {_r('m', 'imagen_media')},
  {_r('1.96 * sd / sqrt(sw * sw / sww)', 'moe_95')},
  {_r('m - 1.96 * sd / sqrt(sw * sw / sww)', 'li_95')},
  {_r('m + 1.96 * sd / sqrt(sw * sw / sww)', 'ls_95')}
FROM (SELECT *, swx / sw AS m, sqrt(greatest(swxx / sw - (swx / sw) * (swx / sw), 0.0)) AS sd FROM sums) t"""


def _vote_long(src: str, window: str, w: str, cand_cte: str) -> list:
    return [
        ("cands", cand_cte),
        ("wins", f"SELECT {window}, sum({w}) AS sw, sum({w} * {w}) AS sww FROM {src} GROUP BY {window}"),
        ("per", f"SELECT {window}, voto AS candidate, sum({w}) AS wc FROM {src} WHERE voto IS NOT NULL "
                f"GROUP BY {window}, voto"),
        ("vl", f"""SELECT g.{window}, c.candidate, coalesce(p.wc, 0.0) / g.sw AS p, g.sw * g.sw / g.sww AS neff
FROM wins g CROSS JOIN cands c
LEFT JOIN per p ON p.{window} = g.{window} AND p.candidate = c.candidate"""),
    ]


def _vote_intervals(window: str) -> str:
    moe = "1.96 * sqrt(p * (1 - p) / neff)"
    return (f"SELECT {window}, candidate, {_r('p * 100', 'share')}, {_r(f'{moe} * 100', 'moe')}, "
            f"{_r(f'(p - {moe}) * 100', 'li')}, {_r(f'(p + {moe}) * 100', 'ls')} FROM vl")


SURVEY_CANDS = " UNION ALL ".join(f"SELECT '{c}' AS candidate" for c in CANDIDATES)


def track_score_month() -> str:
    ctes = _raked("win_m") + [("sums", _score_sums("raked", "win_m", "peso"))]
    return S.with_query(ctes, f"SELECT win_m, {_r('swx / sw', 'trackeo')} FROM sums")


def track_vote_month() -> str:
    ctes = _raked("win_m") + _vote_long("raked", "win_m", "peso", SURVEY_CANDS)
    return S.with_query(ctes, f"SELECT win_m, candidate, {_r('p * 100', 'share')} FROM vl")


def track_vote_month_wide() -> str:
    cols = ", ".join(_r(f"sum(CASE WHEN voto = '{c}' THEN peso ELSE 0.0 END) / sum(peso) * 100", f"vota_{c}")
                     for c in CANDIDATES)
    return S.with_query(_raked("win_m"), f"SELECT win_m, {cols} FROM raked GROUP BY win_m")


def track_vote_month_melt() -> str:
    return track_vote_month()


def intervals_score_month() -> str:
    ctes = _raked("win_m") + [("sums", _score_sums("raked", "win_m", "peso"))]
    return S.with_query(ctes, _score_intervals("win_m"))


def intervals_score_shifted() -> str:
    ctes = _raked("win_m") + [("sums", _score_sums("raked", "win_m", "peso")), ("iv", _score_intervals("win_m"))]
    return S.with_query(ctes, "SELECT win_m, n, n_eff, moe_95, round(imagen_media, 3) AS over_1e9 FROM iv")


def intervals_vote_month() -> str:
    ctes = _raked("win_m") + _vote_long("raked", "win_m", "peso", SURVEY_CANDS)
    return S.with_query(ctes, _vote_intervals("win_m"))


def _events_w():
    return S.events("ev0") + S.windows("ev0", "ev")


def track_events_day() -> str:
    ctes = _events_w() + [("sums", _score_sums("ev", "win_d", "1.0"))]
    return S.with_query(ctes, f"SELECT win_d, {_r('swx / sw', 'trackeo')} FROM sums")


def vote_events_week() -> str:
    ctes = _events_w() + _vote_long("ev", "win_s", "1.0", EVENT_TYPES_CTE)
    return S.with_query(ctes, _vote_intervals("win_s"))


def intervals_events_week() -> str:
    ctes = _events_w() + [("sums", _score_sums("ev", "win_s", "1.0"))]
    return S.with_query(ctes, _score_intervals("win_s"))


# ----------------------------------------------------------------------- tests

def _stat_ctes(ctes, src: str, window: str, pairs: str) -> list:
    pair_sql = ("SELECT min(win) AS w1, max(win) AS w2 FROM mom" if pairs == "first_last" else
                "SELECT * FROM (SELECT lag(win) OVER (ORDER BY win) AS w1, win AS w2 FROM mom) t WHERE w1 IS NOT NULL")
    ctes = ctes + [
        ("vals", f"SELECT {window} AS win, imagen_del_candidato AS x FROM {src} "
                 f"WHERE {window} IS NOT NULL AND imagen_del_candidato IS NOT NULL"),
        ("mom", "SELECT win, count(*) AS n, avg(x) AS mean, var_samp(x) AS var FROM vals GROUP BY win"),
        ("zz", "SELECT v.win, avg(abs(v.x - m.mean)) AS z_mean, var_samp(abs(v.x - m.mean)) * (count(*) - 1) AS z_ss "
               "FROM vals v JOIN mom m ON v.win = m.win GROUP BY v.win"),
        ("prs", pair_sql),
        ("hist", "SELECT win, x, count(*) AS c FROM vals GROUP BY win, x"),
        ("pv", "SELECT p.w1, p.w2, h.x, sum(CASE WHEN h.win = p.w1 THEN h.c ELSE 0 END) AS n1, "
               "sum(CASE WHEN h.win = p.w2 THEN h.c ELSE 0 END) AS n2 "
               "FROM prs p JOIN hist h ON h.win = p.w1 OR h.win = p.w2 GROUP BY p.w1, p.w2, h.x"),
        ("pvb", "SELECT *, coalesce(sum(n2) OVER (PARTITION BY w1, w2 ORDER BY x "
                "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM pv"),
        ("u", "SELECT w1, w2, sum(n1 * (below + n2 / 2.0)) AS u1, "
              "sum(pow(n1 + n2, 3) - (n1 + n2)) AS tie_term FROM pvb GROUP BY w1, w2"),
        ("j", """SELECT p.w1, p.w2, a.n AS n1, b.n AS n2, a.mean AS mean1, b.mean AS mean2, a.var AS var1, b.var AS var2,
  za.z_mean AS zm1, zb.z_mean AS zm2, za.z_ss AS zs1, zb.z_ss AS zs2
FROM prs p JOIN mom a ON a.win = p.w1 JOIN mom b ON b.win = p.w2
JOIN zz za ON za.win = p.w1 JOIN zz zb ON zb.win = p.w2"""),
    ]
    sp2 = "((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2)"
    se = "(var1 / n1 + var2 / n2)"
    zbar = "((n1 * zm1 + n2 * zm2) / (n1 + n2))"
    lev = f"(n1 + n2 - 2) * (n1 * pow(zm1 - {zbar}, 2) + n2 * pow(zm2 - {zbar}, 2)) / (zs1 + zs2)"
    ctes.append(("st", f"""SELECT j.w1, j.w2, n1, n2, mean1, mean2,
  (mean1 - mean2) / nullif(sqrt({sp2} * (1.0 / n1 + 1.0 / n2)), 0) AS t_pooled,
  CAST(n1 + n2 - 2 AS DOUBLE) AS df_pooled,
  (mean1 - mean2) / nullif(sqrt({se}), 0) AS t_welch,
  pow({se}, 2) / nullif(pow(var1 / n1, 2) / (n1 - 1) + pow(var2 / n2, 2) / (n2 - 1), 0) AS df_welch,
  CASE WHEN zs1 + zs2 > 0 THEN {lev} END AS levene_w, u.u1, u.tie_term
FROM j LEFT JOIN u ON u.w1 = j.w1 AND u.w2 = j.w2"""))
    return ctes


def _test_stats(ctes, src: str, window: str, pairs: str) -> str:
    cols = ["mean1", "mean2", "t_pooled", "df_pooled", "t_welch", "df_welch", "levene_w", "u1", "tie_term"]
    return S.with_query(_stat_ctes(ctes, src, window, pairs),
                        "SELECT w1, w2, n1, n2, " + ", ".join(_r(c, c) for c in cols) + " FROM st")


STEPS = 2000       # of Simpson's rule


def _tails(name: str, t: str, df: str) -> list:
    """Two-sided tail of Student's t by integrating its density: with t = sqrt(df) tan(a) it is
    a constant times the integral of cos(a) ** (df - 1) from a0 to the right angle."""
    return [(f"{name}_a", f"SELECT w1, w2, {df} AS d, atan(abs({t}) / sqrt({df})) AS a0 FROM st "
                          f"WHERE {t} IS NOT NULL AND {df} > 0"),
            (f"{name}_h", f"SELECT *, (least(pi() / 2, a0 + 16 / sqrt(d)) - a0) / {STEPS} AS h FROM {name}_a"),
            (name, f"""SELECT w1, w2, 2 * exp(lgamma((any_value(d) + 1) / 2) - lgamma(any_value(d) / 2)) / sqrt(pi())
  * any_value(h) / 3 * sum((CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
                           * pow(greatest(cos(a0 + i * h), 0), d - 1)) AS p
FROM {name}_h, generate_series(0, {STEPS}) AS g(i) GROUP BY w1, w2""")]


def _test_decision(ctes, src: str, window: str, pairs: str) -> str:
    """Test choice, statistic and p-value; Mann-Whitney by the normal tail, integrated likewise, or
    with a sample of at most 8 values and no ties by counting the arrangements: the smaller
    sample's ranks give 0 <= x1 <= .. <= xm <= n with U = sum of x."""
    ctes = _stat_ctes(ctes, src, window, pairs)
    ctes += _tails("pl", "sqrt(levene_w)", "(n1 + n2 - 2)") + _tails("pp", "t_pooled", "df_pooled") + _tails("pw", "t_welch", "df_welch")
    ctes += [("mz", """SELECT w1, w2, (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2.0 - 0.5)
  / nullif(sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tie_term / ((n1 + n2) * (n1 + n2 - 1.0)))), 0) AS z FROM st"""),
             ("pm", f"""SELECT w1, w2, least(1.0, 2 / sqrt(2 * pi()) * (12.0 / {STEPS}) / 3
  * sum((CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(z + i * 12.0 / {STEPS}, 2) / 2))) AS p
FROM mz, generate_series(0, {STEPS}) AS g(i) WHERE z IS NOT NULL GROUP BY w1, w2"""),
             ("ex", """SELECT w1, w2, CAST(least(n1, n2) AS BIGINT) AS m, CAST(greatest(n1, n2) AS BIGINT) AS n,
  greatest(u1, n1 * n2 - u1) AS u, 0 AS k, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS s, CAST(1 AS HUGEINT) AS ways
FROM st WHERE least(n1, n2) <= 8 AND tie_term = 0
UNION ALL
SELECT w1, w2, m, n, u, k, x, s, sum(ways) AS ways
FROM (SELECT w1, w2, m, n, u, k + 1 AS k, y AS x, s + y AS s, ways
      FROM (SELECT *, unnest(generate_series(x, n)) AS y FROM ex WHERE k < m) AS wider) AS summed
GROUP BY w1, w2, m, n, u, k, x, s"""),
             ("pe", """SELECT w1, w2, least(1.0, 2.0 * sum(CASE WHEN s >= u THEN ways ELSE 0 END) / sum(ways)) AS p
FROM ex WHERE k = m GROUP BY w1, w2"""),
             ("ch", """SELECT st.*, pl.p AS p_levene, pp.p AS p_pooled, pw.p AS p_welch, coalesce(pe.p, pm.p) AS p_mwu,
  CASE WHEN n1 >= 30 AND n2 >= 30 AND pl.p >= 0.05 THEN 'student' WHEN n1 >= 30 AND n2 >= 30 THEN 'welch' ELSE 'mann_whitney' END AS test
FROM st LEFT JOIN pl USING (w1, w2) LEFT JOIN pp USING (w1, w2) LEFT JOIN pw USING (w1, w2) LEFT JOIN pm USING (w1, w2)
LEFT JOIN pe USING (w1, w2)"""),
             ("de", """SELECT *, CASE test WHEN 'student' THEN t_pooled WHEN 'welch' THEN t_welch ELSE u1 END AS statistic,
  CASE test WHEN 'student' THEN p_pooled WHEN 'welch' THEN p_welch ELSE p_mwu END AS p_value FROM ch""")]
    return S.with_query(ctes, f"SELECT w1, w2, n1, n2, test, {_r('statistic', 'statistic')}, {_r('p_value', 'p_value')}, "
                              f"p_value < 0.05 AS reject, {_r('p_levene', 'p_levene')} FROM de")


def test_decision_first_last_week() -> str:
    return _test_decision(_prepared(), "windowed", "win_s", "first_last")


def test_decision_events_days() -> str:
    return _test_decision(_events_w(), "ev", "win_d", "consecutive")


def test_stats_first_last_week() -> str:
    return _test_stats(_prepared(), "windowed", "win_s", "first_last")


def test_stats_events_weeks() -> str:
    return _test_stats(_events_w(), "ev", "win_s", "consecutive")


# ----------------------------------------------------------------------- report

def _report_rows(population="pampeana"):
    variables = calibration_variables(population, False)
    tgt = targets_dict(population, False)
    ctes = _prepared(population) + S.rake("windowed", None, variables, tgt, trim_ratio=None, name="rr")
    lvs = ", ".join(f"{S.level_expr(v)} AS {S.lv(v)}" for v in variables)
    keys = ", ".join(S.lv(v) for v in variables)
    ctes += [
        ("rep_c", "SELECT *, sum(n * weight) OVER () / sum(n) OVER () AS _mean FROM rr_cells"),
        ("rep_t", "SELECT *, least(weight, _mean * 3.0) AS _wt FROM rep_c"),
        ("rep", f"SELECT {keys}, _wt * _mean / (sum(n * _wt) OVER () / sum(n) OVER ()) AS weight FROM rep_t"),
        ("repw", f"SELECT r.*, c.weight AS w FROM (SELECT *, {lvs} FROM windowed) r JOIN rep c USING ({keys})"),
    ]
    tvals = " UNION ALL ".join(f"SELECT {S.q(v)} AS variable, {S.q(lvl)} AS level, {S.dbl(p)} AS target_prop"
                               for v in variables for lvl, p in tgt[v].items())
    shares = " UNION ALL ".join(
        f"SELECT {S.q(v)} AS variable, {S.lv(v)} AS level, count(*) AS c, sum(w) AS cw FROM repw GROUP BY {S.lv(v)}"
        for v in variables)
    ctes += [
        ("tg", tvals),
        ("sh0", shares),
        ("sh", "SELECT variable, level, c / sum(c) OVER (PARTITION BY variable) AS sample_prop, "
               "cw / sum(cw) OVER (PARTITION BY variable) AS weighted_prop FROM sh0"),
        ("svp", "SELECT t.variable, t.level, t.target_prop, coalesce(s.sample_prop, 0.0) AS sample_prop, "
                "coalesce(s.weighted_prop, 0.0) AS weighted_prop FROM tg t "
                "LEFT JOIN sh s ON s.variable = t.variable AND s.level = t.level"),
    ]
    return ctes


def report_metrics() -> str:
    return S.with_query(_report_rows(), f"""SELECT count(*) AS n, {_r('1 + var_samp(w) / pow(avg(w), 2)', 'deff')},
  {_r('pow(sum(w), 2) / sum(w * w)', 'ess')}, {_r('pow(sum(w), 2) / sum(w * w) / count(*)', 'essp')},
  {_r('max(w)', 'w_max')}, {_r('min(w)', 'w_min')} FROM repw""")


def report_sample_vs_target() -> str:
    return S.with_query(_report_rows(), f"SELECT variable, level, {_r('target_prop', 'target_prop')}, "
                                        f"{_r('sample_prop', 'sample_prop')}, {_r('weighted_prop', 'weighted_prop')} FROM svp")


def report_asmd() -> str:
    ctes = _report_rows() + [
        ("per", "SELECT variable, abs(sample_prop - target_prop) / sqrt(target_prop * (1 - target_prop)) AS b, "
                "abs(weighted_prop - target_prop) / sqrt(target_prop * (1 - target_prop)) AS a FROM svp"),
        ("bv", "SELECT variable, avg(b) AS asmd_before, avg(a) AS asmd_after FROM per GROUP BY variable"),
        ("al", "SELECT * FROM bv UNION ALL SELECT 'mean(asmd)', avg(asmd_before), avg(asmd_after) FROM bv"),
    ]
    return S.with_query(ctes, f"""SELECT variable, {_r('asmd_before', 'asmd_before')}, {_r('asmd_after', 'asmd_after')},
  {_r('CASE WHEN asmd_before > 0 THEN (1 - asmd_after / asmd_before) * 100.0 END', 'reduction_pct')} FROM al""")


def report_weight_summary() -> str:
    from tallyrake.operators.report import PROP_ABOVE, PROP_BELOW
    stats = [("n", "CAST(count(*) AS DOUBLE)"), ("sum", "sum(w)"), ("mean", "avg(w)"), ("std", "stddev_samp(w)"),
             ("min", "min(w)"), ("q25", "quantile_cont(w, 0.25)"), ("median", "quantile_cont(w, 0.5)"),
             ("q75", "quantile_cont(w, 0.75)"), ("max", "max(w)")]
    stats += [(f"prop(w < {t})", f"avg(CASE WHEN w < {t} THEN 1.0 ELSE 0.0 END)") for t in PROP_BELOW]
    stats += [(f"prop(w >= {t})", f"avg(CASE WHEN w >= {t} THEN 1.0 ELSE 0.0 END)") for t in PROP_ABOVE]
    stats += [("deff", "1 + var_samp(w) / pow(avg(w), 2)"), ("ess", "pow(sum(w), 2) / sum(w * w)"),
              ("essp", "pow(sum(w), 2) / sum(w * w) / count(*)")]
    parts = [f"SELECT {S.q(k)} AS stat, round(CAST({e} AS DOUBLE), 6) AS value FROM repw" for k, e in stats]
    return S.with_query(_report_rows(), "\nUNION ALL\n".join(parts))


def calibration_value_shares() -> str:
    variables = calibration_variables("nacional", False)
    parts = " UNION ALL ".join(f"SELECT {S.q(v)} AS variable, {S.level_expr(v)} AS level FROM windowed"
                               for v in variables)
    ctes = _prepared("nacional") + [("lng", parts),
                                    ("g", "SELECT variable, level, count(*) AS c FROM lng GROUP BY variable, level")]
    return S.with_query(ctes, f"SELECT variable, level, {_r('c / sum(c) OVER (PARTITION BY variable)', 'share')} FROM g")


# ----------------------------------------------------------------------- sources

def survey_csv_load() -> str:
    return S.with_query(S.survey(), f"SELECT {SURVEY_OUT} FROM survey")


def survey_csv_quoted() -> str:
    level = """CASE WHEN k % 3 = 0 THEN chr(9) || nivel_educativo || chr(10) ELSE nivel_educativo END"""
    return S.with_query(S.survey() + [("keyed", "SELECT *, CAST(encuesta AS BIGINT) AS k FROM survey")], f"""SELECT encuesta,
CASE k % 5 WHEN 0 THEN 'la' || chr(10) || estrato WHEN 1 THEN '"' || estrato || '", x'
     WHEN 2 THEN estrato || chr(13) || chr(10) || chr(13) || chr(10) || '""fin' ELSE estrato END AS estrato,
{level} AS nivel_educativo, lower(trim({level}, ' ' || chr(9) || chr(10))) AS nivel, edad, voto_anterior FROM keyed""")


def survey_sorted_output() -> str:
    return S.with_query(_prepared(), "SELECT encuesta, fecha, row_number() OVER (ORDER BY fecha, encuesta) AS place FROM windowed")


def ledger_newest_first() -> str:
    return S.with_query(_prepared(), """SELECT strftime(win_m, '%Y%m') AS run_id, count(*) AS n_rows,
row_number() OVER (ORDER BY win_m DESC) AS place FROM windowed GROUP BY win_m""")


def calibration_targets_bsas() -> str:
    tgt = targets_dict("buenos_aires", True)
    rows = " UNION ALL ".join(f"SELECT {S.q(v)} AS variable, {S.q(lvl)} AS level, {S.dbl(p)} AS proportion"
                              for v, d in tgt.items() for lvl, p in d.items())
    ctes = _prepared("buenos_aires", restrict_bsas=True) + [("t", rows)]
    return S.with_query(ctes, f"""SELECT variable, level, {_r('proportion', 'proportion')} FROM t
WHERE variable <> 'estrato_bsas'
   OR EXISTS (SELECT 1 FROM windowed WHERE lower(trim(estrato)) IN {S.in_list(S.GBA_MUNICIPALITIES)})""")


def ledger_history() -> str:
    variables = calibration_variables("pampeana", False)
    tgt = targets_dict("pampeana", False)
    ctes = _prepared() + S.rake("windowed", "win_m", variables, tgt, trim_ratio=None, name="rr")
    lvs = ", ".join(f"{S.level_expr(v)} AS {S.lv(v)}" for v in variables)
    keys = ", ".join(["_win"] + [S.lv(v) for v in variables])
    ctes += [
        ("rep_c", "SELECT *, sum(n * weight) OVER (PARTITION BY _win) / sum(n) OVER (PARTITION BY _win) AS _mean "
                  "FROM rr_cells"),
        ("rep_t", "SELECT *, least(weight, _mean * 3.0) AS _wt FROM rep_c"),
        ("rep", f"SELECT {keys}, _wt * _mean / (sum(n * _wt) OVER (PARTITION BY _win) / "
                f"sum(n) OVER (PARTITION BY _win)) AS weight FROM rep_t"),
        ("repw", f"SELECT r.*, c.weight AS w FROM (SELECT *, win_m AS _win, {lvs} FROM windowed) r "
                 f"JOIN rep c USING ({keys})"),
    ]
    return S.with_query(ctes, f"""SELECT strftime(win_m, '%Y-%m') AS run_id, 'pampeana' AS population, count(*) AS n_rows,
  {S.q(', '.join(variables))} AS calib_vars,
  round(1 + var_samp(w) / pow(avg(w), 2), 3) AS deff, round(pow(sum(w), 2) / sum(w * w), 1) AS ess,
  round(pow(sum(w), 2) / sum(w * w) / count(*), 3) AS essp, {_r('max(w)', 'w_max')}, {_r('min(w)', 'w_min')}
FROM repw GROUP BY win_m""")


def history_monthly_batches() -> str:
    return S.with_query(_prepared(), """SELECT win_m, count(*) AS n_cases, CAST(1 AS BIGINT) AS n_ids,
  CAST(sum(count(*)) OVER () AS BIGINT) AS appended_total
FROM windowed
WHERE edad IS NOT NULL AND sexo IS NOT NULL AND estrato IS NOT NULL AND nivel_educativo IS NOT NULL
  AND voto_anterior IS NOT NULL
GROUP BY win_m""")


# ----------------------------------------------------------------------- imputation

def impute_score_gate() -> str:
    """Median branch (the score of the survey view is unrelated to the predictors, so
    the hold-out R2 is below the gate)."""
    ctes = _prepared() + [("med", "SELECT median(imagen_del_candidato) AS m FROM windowed")]
    return S.with_query(ctes, """SELECT encuesta,
  round(least(greatest(coalesce(imagen_del_candidato, (SELECT m FROM med)), 0.0), 100.0), 6) AS imagen_del_candidato,
  'median' AS method FROM windowed""")


_CASES = ("cases", "SELECT encuesta, win_m, edad, sexo, estrato, nivel_educativo, voto_anterior, voto, imagen_del_candidato "
          "FROM windowed WHERE edad IS NOT NULL AND sexo IS NOT NULL AND estrato IS NOT NULL AND nivel_educativo IS NOT NULL "
          "AND voto_anterior IS NOT NULL AND voto IS NOT NULL")


def split_vote_counts() -> str:
    ctes = _prepared() + [_CASES, ("rk", """SELECT *, row_number() OVER (PARTITION BY voto ORDER BY md5('42|' || encuesta), encuesta) AS k,
  count(*) OVER (PARTITION BY voto) AS n FROM cases"""),
        ("sd", "SELECT *, CASE WHEN k <= floor(0.7 * n + 0.5) THEN 'train' ELSE 'test' END AS side FROM rk")]
    return S.with_query(ctes, f"""SELECT voto, side, count(*) AS n, {_r('avg(edad)', 'mean_age')},
  CAST(sum(CAST(encuesta AS BIGINT)) AS BIGINT) AS id_sum FROM sd GROUP BY voto, side""")


def report_vote_rule() -> str:
    ctes = _prepared() + [_CASES, ("pr", "SELECT voto AS actual, CASE WHEN voto_anterior = 'no_voto' THEN 'c' ELSE voto_anterior END AS pred FROM cases"),
        ("cl", "SELECT actual AS cls FROM pr UNION SELECT pred FROM pr"),
        ("ct", """SELECT cls, (SELECT count(*) FROM pr WHERE actual = cls AND pred = cls) AS tp,
  (SELECT count(*) FROM pr WHERE actual = cls) AS support, (SELECT count(*) FROM pr WHERE pred = cls) AS n_pred FROM cl"""),
        ("rc", """SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM ct""")]
    return S.with_query(ctes, f"""SELECT cls, support, n_pred, tp, {_r('p', 'precision')}, {_r('r', 'recall')},
  {_r('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END', 'f1')},
  {_r('(SELECT sum(tp) FROM ct) / (SELECT sum(support) FROM ct)', 'accuracy')} FROM rc""")


def report_score_rule() -> str:
    ctes = _prepared() + [_CASES, ("y", "SELECT imagen_del_candidato AS y, edad * 0.5 + 20 AS p FROM cases WHERE imagen_del_candidato IS NOT NULL")]
    return S.with_query(ctes, f"""SELECT count(*) AS n, {_r('avg(abs(y - p))', 'mae')}, {_r('sqrt(avg(pow(y - p, 2)))', 'rmse')},
  {_r('1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*))', 'r2')} FROM y""")


def survey_null_profile_imputed() -> str:
    filled = ("voto", "voto_anterior", "imagen_del_candidato")
    parts = [f"SELECT '{c}' AS \"column\", " + ("0.0" if c in filled else f"round(avg(CAST({c} IS NULL AS DOUBLE)) * 100.0, 6)")
             + " AS null_pct" + ("" if c in filled else " FROM windowed") for c in SURVEY_COLUMNS]
    return S.with_query(_prepared(), "\nUNION ALL\n".join(parts))


def ols_level_means() -> str:
    where = "WHERE imagen_del_candidato IS NOT NULL"
    parts = [f"SELECT '{v}' AS variable, {v} AS level, count(*) AS n, round(avg(imagen_del_candidato), 4) AS mean_pred "
             f"FROM cases {where} GROUP BY {v}" for v in ("sexo", "estrato", "nivel_educativo", "voto", "voto_anterior")]
    return S.with_query(_prepared() + [_CASES], "\nUNION ALL\n".join(parts))


def logit_class_shares() -> str:
    return S.with_query(_prepared() + [_CASES], "SELECT voto AS cls, (SELECT count(*) FROM cases) AS n, "
                        "round(count(*) / (SELECT count(*) FROM cases), 3) AS mean_prob FROM cases GROUP BY voto")


def logit_optimality_vote() -> str:
    """At the optimum the fitted totals, penalty included, are those of the cases."""
    dummies = " UNION ALL ".join(
        f"SELECT voto AS cls, '{c}' AS predictor, {c} AS level, count(*) AS total FROM cases "
        f"WHERE {c} > (SELECT min({c}) FROM cases) GROUP BY voto, {c}" for c in ("sexo", "estrato", "nivel_educativo", "voto_anterior"))
    return S.with_query(_prepared() + [_CASES], f"""{dummies}
UNION ALL SELECT voto, 'edad', '', CAST(round(sum(edad)) AS BIGINT) FROM cases GROUP BY voto
UNION ALL SELECT voto, 'intercept', '', count(*) FROM cases GROUP BY voto""")


def ledger_checks() -> str:
    from tallyrake.sources.census import POPULATIONS
    ctes = _prepared() + [("r", "SELECT estrato AS population, count(*) AS n_rows FROM windowed GROUP BY estrato"),
                          ("t", f"SELECT *, population IN {S.in_list(POPULATIONS)} AS known FROM r")]
    return S.with_query(ctes, "SELECT 'run-' || population AS run_id, population, n_rows, "
                        "CASE WHEN known THEN 'stored' ELSE 'rejected' END AS state, "
                        "(SELECT count(*) FROM t WHERE known) AS total FROM t")


def process_entry_ledger() -> str:
    variables = calibration_variables("pampeana", False)
    units = {"day": "rd", "week": "rs", "month": "rm"}
    counts = ", ".join(f"""(SELECT count(DISTINCT _win) FROM {t}_cells) AS {u}s_all,
  (SELECT count(DISTINCT _win) FROM {t}_cells WHERE status = 'ok') AS {u}s_raked""" for u, t in units.items())
    done = {name for name, _ in _report_rows()}
    ctes = _report_rows() + [c for c in _three_units() if c[0] not in done]
    return S.with_query(ctes, f"""SELECT {counts}, 'run-1' AS run_id, 'pampeana' AS population, count(*) AS n_rows,
  {S.q(', '.join(variables))} AS calib_vars,
  round(1 + var_samp(w) / pow(avg(w), 2), 3) AS deff, round(pow(sum(w), 2) / sum(w * w), 1) AS ess,
  round(pow(sum(w), 2) / sum(w * w) / count(*), 3) AS essp, {_r('max(w)', 'w_max')}, {_r('min(w)', 'w_min')},
  0.0 AS null_pct_left FROM repw""")


def impute_score_regression() -> str:
    return S.with_query(_prepared(), """SELECT encuesta,
  round(edad * 0.5 + CASE WHEN sexo = 'femenino' THEN 20.0 ELSE 0.0 END, 4) AS imagen_del_candidato, 'regression' AS method FROM windowed""")


def flagship_track_month() -> str:
    ctes = _raked("win_m") + [
        ("sums", _score_sums("raked", "win_m", "peso")), ("iv", _score_intervals("win_m")),
        ("dg", "SELECT _win AS win_m, min(status) AS status, max(iterations) AS iterations FROM raked_cells GROUP BY _win")]
    return S.with_query(ctes, "SELECT iv.*, dg.status, dg.iterations FROM iv LEFT JOIN dg USING (win_m)")


def stream_week_weights() -> str:
    return S.with_query(_raked("win_s"), "SELECT encuesta, win_s, round(peso, 6) AS peso FROM raked")


ORACLES = {
    "survey_clean": survey_clean,
    "survey_dedup_lines": survey_dedup_lines,
    "survey_null_profile": survey_null_profile,
    "survey_normalize_nacional": survey_normalize_nacional,
    "survey_normalize_bsas": survey_normalize_bsas,
    "window_counts": window_counts,
    "rake_month_weights": rake_month_weights,
    "rake_month_diagnostics": rake_month_diagnostics,
    "rake_week_diagnostics": rake_week_diagnostics,
    "rake_day_diagnostics": rake_day_diagnostics,
    "rake_units_weights": rake_units_weights,
    "rake_month_bsas": rake_month_bsas,
    "rake_month_native": rake_month_native,
    "rake_month_nacional_diagnostics": rake_month_nacional_diagnostics,
    "track_score_month": track_score_month,
    "track_vote_month": track_vote_month,
    "track_vote_month_wide": track_vote_month_wide,
    "track_vote_month_melt": track_vote_month_melt,
    "intervals_score_month": intervals_score_month,
    "intervals_score_shifted": intervals_score_shifted,
    "intervals_vote_month": intervals_vote_month,
    "track_events_day": track_events_day,
    "vote_events_week": vote_events_week,
    "intervals_events_week": intervals_events_week,
    "test_stats_first_last_week": test_stats_first_last_week,
    "test_stats_events_weeks": test_stats_events_weeks,
    "report_metrics": report_metrics,
    "report_asmd": report_asmd,
    "report_weight_summary": report_weight_summary,
    "report_sample_vs_target": report_sample_vs_target,
    "calibration_value_shares": calibration_value_shares,
    "survey_csv_load": survey_csv_load,
    "survey_csv_quoted": survey_csv_quoted,
    "survey_sorted_output": survey_sorted_output,
    "ledger_newest_first": ledger_newest_first,
    "calibration_targets_bsas": calibration_targets_bsas,
    "ledger_history": ledger_history,
    "history_monthly_batches": history_monthly_batches,
    "impute_score_gate": impute_score_gate,
    "stream_week_weights": stream_week_weights,
    "test_decision_first_last_week": test_decision_first_last_week,
    "test_decision_events_days": test_decision_events_days,
    "split_vote_counts": split_vote_counts,
    "report_vote_rule": report_vote_rule,
    "report_score_rule": report_score_rule,
    "survey_null_profile_imputed": survey_null_profile_imputed,
    "ols_level_means": ols_level_means,
    "logit_class_shares": logit_class_shares,
    "logit_optimality_vote": logit_optimality_vote,
    "ledger_checks": ledger_checks,
    "process_entry_ledger": process_entry_ledger,
    "impute_score_regression": impute_score_regression,
    "flagship_track_month": flagship_track_month,
}


def all_sql() -> dict[str, str]:
    return {k: f() for k, f in ORACLES.items()}
