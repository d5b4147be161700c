"""The same plans as ANSI SQL text, for the independent DuckDB cross-check.

These builders only emit SQL strings over the driver tables (``orders``, ``customer``,
``lineitem``, ``events``); they are never executed by the library itself.  Each
builder returns a list of ``(cte_name, sql)`` pairs so chains can be composed, and
``with_query`` renders the final statement.  Raking is a recursive query, one sweep a
step with each window stopping at its own convergence; the fixed-K form (the native
cross-check) is written as K unrolled sweeps.
"""

from __future__ import annotations

from tallyrake.functions.recode import AGE_BINS, EDUCATION_PREFIXES, EDUCATION_REPLACE, SEX_WHITELIST
from tallyrake.sources.census import GBA_MUNICIPALITIES, PROVINCE_REGION
from tallyrake.sources.driver_view import PROVINCE_BY_NATION

Ctes = list[tuple[str, str]]


def q(s: str) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"CAST({q(repr(float(x)))} AS DOUBLE)"


def with_query(ctes: Ctes, final: str) -> str:
    if not ctes:
        return final
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS (\n{s}\n)" for n, s in ctes) + "\n" + final


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


# --------------------------------------------------------------------------- input

def _survey_select(fecha: str, encuesta: str, order: str) -> str:
    prov = " ".join(f"WHEN {k} THEN {q(v)}" for k, v in enumerate(PROVINCE_BY_NATION))
    return f"""SELECT {encuesta} AS encuesta, {fecha} AS fecha,
  CASE c.c_nationkey {prov} END AS estrato,
  CASE WHEN o.o_orderkey % 97 = 0 THEN 'otro' WHEN c.c_custkey % 2 = 0 THEN 'femenino' ELSE 'masculino' END AS sexo,
  CAST(14 + (c.c_custkey * 7 + o.o_orderkey) % 75 AS DOUBLE) AS edad,
  CASE WHEN c.c_mktsegment = 'AUTOMOBILE' THEN (CASE WHEN o.o_orderkey % 2 = 0 THEN 'Sin estudios' ELSE ' Primario' END)
       WHEN c.c_mktsegment = 'BUILDING' THEN 'Secundario completo'
       WHEN c.c_mktsegment = 'FURNITURE' THEN 'Terciario'
       WHEN c.c_mktsegment = 'HOUSEHOLD' THEN 'Universitario'
       WHEN c.c_mktsegment = 'MACHINERY' THEN 'Posgrado' END AS nivel_educativo,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(1 + o.o_orderkey % 6 AS VARCHAR) END AS integrantes_hogar,
  CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE CAST(floor(o.o_totalprice / 5000.0) AS DOUBLE) END AS imagen_del_candidato,
  CASE WHEN o.o_orderkey % 13 = 0 THEN NULL WHEN o.o_orderstatus = 'F' THEN 'a' WHEN o.o_orderstatus = 'O' THEN 'b' ELSE 'c' END AS voto,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL WHEN o.o_orderpriority = '5-LOW' THEN 'no_voto'
       WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'a' ELSE 'b' END AS voto_anterior,
  {order} AS _ord"""


def survey(name: str = "survey") -> Ctes:
    body = (_survey_select("o.o_orderdate", "CAST(o.o_orderkey AS VARCHAR)", "o.o_orderkey")
            + f"\nFROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"
            + f"\nWHERE c.c_nationkey BETWEEN 0 AND {len(PROVINCE_BY_NATION) - 1}")
    return [(name, body)]


def survey_dups(name: str = "survey") -> Ctes:
    body = (_survey_select("l.l_shipdate", "CAST(l.l_orderkey AS VARCHAR)", "l.l_orderkey * 16 + l.l_linenumber")
            + "\nFROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"
            + " JOIN customer c ON o.o_custkey = c.c_custkey"
            + f"\nWHERE c.c_nationkey BETWEEN 0 AND {len(PROVINCE_BY_NATION) - 1}")
    return [(name, body)]


def events(name: str = "ev") -> Ctes:
    return [(name, "SELECT CAST(event_id AS VARCHAR) AS encuesta, ts AS fecha, value AS imagen_del_candidato, "
                   "event_type AS voto FROM events")]


# --------------------------------------------------------------------------- clean

def education_expr(col: str) -> str:
    x = f"lower(trim({col}))"
    for src, dst in EDUCATION_REPLACE.items():
        x = f"(CASE WHEN {x} = {q(src)} THEN {q(dst)} ELSE {x} END)"
    whens = " ".join(f"WHEN starts_with({x}, {q(p)}) THEN {q(p)}" for p in EDUCATION_PREFIXES)
    return f"CASE {whens} ELSE {x} END"


def age_expr(col: str) -> str:
    whens = " ".join(f"WHEN {col} > {lo} AND {col} <= {hi} THEN {q(lbl)}" for lo, hi, lbl in AGE_BINS)
    return f"CASE {whens} END"


SURVEY_COLS = ["encuesta", "fecha", "estrato", "sexo", "edad", "nivel_educativo",
               "integrantes_hogar", "imagen_del_candidato", "voto", "voto_anterior", "_ord"]


def clean(src: str, name: str = "cleaned") -> Ctes:
    f = f"{name}_f"
    d = f"{name}_d"
    cols = ", ".join(SURVEY_COLS)
    return [
        (f, f"SELECT {cols} FROM {src} WHERE (voto IS NOT NULL OR imagen_del_candidato IS NOT NULL) AND edad >= 16"),
        (d, f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY encuesta ORDER BY _ord, fecha) AS _rn FROM {f}) t "
            f"WHERE _rn = 1"),
        (name, f"""SELECT encuesta, fecha, estrato, sexo, edad, {education_expr('nivel_educativo')} AS nivel_educativo,
  coalesce(CAST(integrantes_hogar AS VARCHAR), 'Desconocido') AS integrantes_hogar,
  imagen_del_candidato, voto, voto_anterior, _ord
FROM {d}
WHERE fecha IS NOT NULL AND estrato IS NOT NULL AND nivel_educativo IS NOT NULL AND sexo IS NOT NULL
  AND edad IS NOT NULL AND sexo IN {in_list(SEX_WHITELIST)}"""),
    ]


def normalize(src: str, population: str, bsas: bool, name: str = "normed") -> Ctes:
    extra = ""
    if bsas:
        extra += (f",\n  CASE WHEN lower(trim(estrato)) IN {in_list(GBA_MUNICIPALITIES)} "
                  f"THEN 'gba' ELSE 'interior' END AS estrato_bsas")
    if population == "nacional":
        whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in PROVINCE_REGION.items())
        extra += f",\n  CASE lower(trim(estrato)) {whens} END AS region"
    return [(name, f"""SELECT encuesta, fecha, lower(trim(estrato)) AS estrato, lower(trim(sexo)) AS sexo, edad,
  nivel_educativo, integrantes_hogar, imagen_del_candidato, voto, voto_anterior, _ord,
  {age_expr('edad')} AS edad_cat{extra}
FROM {src}""")]


def windows(src: str, name: str = "windowed", extra_cols: str = "*") -> Ctes:
    return [(name, f"""SELECT {extra_cols},
  CAST(date_trunc('day', fecha) AS DATE) AS win_d,
  CAST(date_trunc('week', fecha) AS DATE) AS win_s,
  CAST(date_trunc('month', fecha) AS DATE) AS win_m
FROM {src}""")]


# --------------------------------------------------------------------------- rake

def lv(v: str) -> str:
    return f"_lv_{v}"


def level_expr(v: str) -> str:
    return f"coalesce(CAST({v} AS VARCHAR), 'nan')"


TOL = 5e-4
MAX_ITER = 1000


def _target_expr(v: str, tgt: dict[str, dict[str, float]]) -> str:
    return "CASE " + lv(v) + " " + " ".join(f"WHEN {q(k)} THEN {dbl(p)}" for k, p in sorted(tgt[v].items())) + " END"


def _swept(prev: str, variables: list[str], tgt: dict[str, dict[str, float]], keep: str) -> str:
    """One sweep over all variables in name order, as nested selects over ``prev``."""
    for v in sorted(variables):
        prev = (f"(SELECT {keep}, w * ({_target_expr(v, tgt)}) / sum(w) OVER (PARTITION BY _win, {lv(v)}) AS w "
                f"FROM {prev}) AS by_{lv(v)}")
    return prev


def rake(src: str, window: str | None, variables: list[str], tgt: dict[str, dict[str, float]],
         sweeps: int | None = None, trim_ratio: float | None = 3.0, weight: str = "peso",
         name: str = "raked") -> Ctes:
    """Rows of ``src`` plus ``weight``; also defines ``{name}_cells`` (per-cell results).
    ``sweeps``: exactly that many; default: to TOL per window, at most MAX_ITER."""
    win = window if window else "0"
    lvs = ", ".join(f"{level_expr(v)} AS {lv(v)}" for v in variables)
    keys = ", ".join(["_win"] + [lv(v) for v in variables])
    ctes: Ctes = [(f"{name}_c0", f"SELECT {win} AS _win, {lvs}, count(*) AS n FROM {src} GROUP BY ALL")]
    conds_nt, conds_em = [], []
    for v in variables:
        levels = sorted(tgt[v])
        conds_nt.append(f"max(CASE WHEN {lv(v)} NOT IN {in_list(levels)} THEN 1 ELSE 0 END) > 0")
        conds_em.append(f"count(DISTINCT CASE WHEN {lv(v)} IN {in_list(levels)} THEN {lv(v)} END) < {len(levels)}")
    ctes.append((f"{name}_st", f"""SELECT _win,
  CASE WHEN {' OR '.join(conds_nt)} THEN 'fallback_no_target'
       WHEN {' OR '.join(conds_em)} THEN 'fallback_empty_level' ELSE 'ok' END AS status
FROM {name}_c0 GROUP BY _win"""))
    prev = f"{name}_s0"
    ctes.append((prev, f"SELECT c.*, s.status, c.n / sum(c.n) OVER (PARTITION BY c._win) AS w "
                       f"FROM {name}_c0 c JOIN {name}_st s ON c._win = s._win"))
    cols = ", ".join(["_win"] + [lv(v) for v in variables] + ["n", "status"])
    ok = "status IN ('ok', 'not_converged')"
    if sweeps is not None:
        for step in range(1, sweeps + 1):
            ctes.append((f"{name}_s{step}", f"SELECT {cols}, w FROM {_swept(prev, variables, tgt, cols)}"))
            prev = f"{name}_s{step}"
        ctes.append((f"{name}_r", f"""SELECT {cols},
  CASE WHEN status = 'ok' THEN w / n ELSE 1.0 END AS w_raw,
  CASE WHEN status = 'ok' THEN {sweeps} ELSE 0 END AS iterations
FROM {prev}"""))
    else:
        keep = cols + ", it"
        dev = ", ".join(f"abs(sum(w) OVER (PARTITION BY _win, {lv(v)}) / sum(w) OVER (PARTITION BY _win) - ({_target_expr(v, tgt)}))"
                        for v in variables)
        ctes.append((f"{name}_it", f"""SELECT {cols}, 0 AS it, w, false AS done FROM {prev} WHERE status = 'ok'
UNION ALL
SELECT {keep}, w, max(dev) OVER (PARTITION BY _win) < {dbl(TOL)} AS done
FROM (SELECT {keep}, w, greatest({dev}) AS dev
      FROM {_swept(f"(SELECT {cols}, it + 1 AS it, w FROM {name}_it WHERE NOT done AND it < {MAX_ITER}) AS live", variables, tgt, keep)}) AS swept"""))
        plain = ", ".join(["_win"] + [lv(v) for v in variables] + ["n"])
        ctes.append((f"{name}_r", f"""SELECT {plain}, CASE WHEN done THEN 'ok' ELSE 'not_converged' END AS status,
  w / n AS w_raw, it AS iterations
FROM {name}_it WHERE done OR it = {MAX_ITER}
UNION ALL
SELECT {cols}, 1.0 AS w_raw, 0 AS iterations FROM {prev} WHERE status <> 'ok'"""))
    ctes.append((f"{name}_m", f"""SELECT *, sum(n * w_raw) OVER (PARTITION BY _win) / sum(n) OVER (PARTITION BY _win) AS _mean,
  sum(n) OVER (PARTITION BY _win) AS _sum_n FROM {name}_r"""))
    trimmed = (f"least(greatest(w_raw, _mean / {float(trim_ratio)}), _mean * {float(trim_ratio)})"
               if trim_ratio else "w_raw")
    ctes.append((f"{name}_v", f"""SELECT *, sum(n * (w_raw - _mean) * (w_raw - _mean)) OVER (PARTITION BY _win) / _sum_n AS _var,
  CASE WHEN {ok} THEN {trimmed} ELSE 1.0 END AS _wt FROM {name}_m"""))
    ctes.append((f"{name}_cells", f"""SELECT {cols}, w_raw, iterations,
  _wt * _sum_n / sum(n * _wt) OVER (PARTITION BY _win) AS weight,
  CASE WHEN {ok} THEN 1 + _var / (_mean * _mean) END AS deff_pop,
  CASE WHEN {ok} THEN sqrt(_var) / _mean * 100.0 END AS cv
FROM {name}_v"""))
    ctes.append((name, f"""SELECT r.*, c.weight AS {weight}
FROM (SELECT *, {win} AS _win, {lvs} FROM {src}) r
JOIN {name}_cells c USING ({keys})"""))
    return ctes


def rake_diagnostics(cells: str, window: str | None) -> str:
    win = f"_win AS {window}, " if window else ""
    return f"""SELECT {win}CAST(sum(n) AS BIGINT) AS n, count(*) AS n_cells, min(status) AS status,
  max(iterations) AS iterations, round(max(deff_pop), 6) AS deff_pop, round(max(cv), 6) AS cv,
  round(max(weight), 6) AS w_max, round(min(weight), 6) AS w_min,
  coalesce(max(deff_pop) > 2.5, false) AS warn_deff, coalesce(max(cv) > 80.0, false) AS warn_cv,
  starts_with(min(status), 'fallback') AS warn_fallback
FROM {cells} GROUP BY _win"""
