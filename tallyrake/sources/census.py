"""Census margin dimension (S6-S9) and the geographic lookups.

The margins are a small fixed dimension (32 populations x 11 levels + 8 special rows),
so they are built once per session with ``createDataFrame`` and always joined with an
explicit ``broadcast`` hint: their size is bounded by the catalog, not by the survey.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (census 2022 margins and catalog; must equal the reference).
# One line per population, in catalog order:
#   key | description | sexo femenino masculino | edad 16-29 30-44 45-59 60+ |
#   nivel_educativo prim sec terc univ pos
# ---------------------------------------------------------------------------
CENSUS_MARGINS = """
nacional | Total Argentina | 0.519 0.481 | 0.202 0.284 0.237 0.277 | 0.285 0.430 0.105 0.158 0.022
gba | Gran Buenos Aires (39 partidos) | 0.521 0.479 | 0.218 0.293 0.232 0.257 | 0.291 0.441 0.104 0.141 0.023
interior_buenos_aires | Provincia de Buenos Aires sin GBA | 0.516 0.484 | 0.196 0.281 0.237 0.286 | 0.258 0.432 0.111 0.176 0.023
pampeana | Región Pampeana | 0.517 0.483 | 0.198 0.281 0.238 0.283 | 0.274 0.427 0.109 0.168 0.022
noa | Región NOA | 0.514 0.486 | 0.221 0.284 0.232 0.263 | 0.331 0.415 0.101 0.133 0.020
nea | Región NEA | 0.513 0.487 | 0.224 0.286 0.231 0.259 | 0.352 0.408 0.097 0.124 0.019
cuyo | Región Cuyo | 0.516 0.484 | 0.207 0.284 0.236 0.273 | 0.296 0.429 0.106 0.148 0.021
patagonia | Región Patagonia | 0.510 0.490 | 0.210 0.299 0.244 0.247 | 0.258 0.444 0.115 0.162 0.021
caba | Ciudad Autónoma de Buenos Aires | 0.530 0.470 | 0.174 0.279 0.248 0.299 | 0.152 0.380 0.118 0.297 0.053
buenos_aires | Provincia de Buenos Aires | 0.519 0.481 | 0.210 0.289 0.234 0.267 | 0.278 0.438 0.107 0.155 0.022
catamarca | Catamarca | 0.514 0.486 | 0.214 0.282 0.234 0.270 | 0.321 0.419 0.108 0.134 0.018
cordoba | Córdoba | 0.519 0.481 | 0.196 0.281 0.239 0.284 | 0.261 0.425 0.112 0.179 0.023
corrientes | Corrientes | 0.513 0.487 | 0.226 0.287 0.229 0.258 | 0.355 0.409 0.095 0.123 0.018
chaco | Chaco | 0.512 0.488 | 0.231 0.288 0.227 0.254 | 0.372 0.403 0.091 0.117 0.017
chubut | Chubut | 0.508 0.492 | 0.213 0.301 0.243 0.243 | 0.258 0.448 0.114 0.160 0.020
entre_rios | Entre Ríos | 0.517 0.483 | 0.197 0.280 0.238 0.285 | 0.279 0.431 0.108 0.161 0.021
formosa | Formosa | 0.511 0.489 | 0.228 0.287 0.228 0.257 | 0.368 0.405 0.093 0.117 0.017
jujuy | Jujuy | 0.513 0.487 | 0.221 0.287 0.232 0.260 | 0.319 0.419 0.103 0.140 0.019
la_pampa | La Pampa | 0.516 0.484 | 0.188 0.276 0.239 0.297 | 0.267 0.436 0.110 0.166 0.021
la_rioja | La Rioja | 0.514 0.486 | 0.218 0.284 0.232 0.266 | 0.305 0.424 0.107 0.146 0.018
mendoza | Mendoza | 0.516 0.484 | 0.206 0.284 0.236 0.274 | 0.292 0.431 0.106 0.150 0.021
misiones | Misiones | 0.512 0.488 | 0.225 0.288 0.230 0.257 | 0.363 0.406 0.093 0.121 0.017
neuquen | Neuquén | 0.509 0.491 | 0.211 0.302 0.244 0.243 | 0.249 0.446 0.117 0.167 0.021
rio_negro | Río Negro | 0.511 0.489 | 0.205 0.293 0.244 0.258 | 0.261 0.443 0.115 0.161 0.020
salta | Salta | 0.513 0.487 | 0.224 0.285 0.231 0.260 | 0.322 0.416 0.102 0.141 0.019
san_juan | San Juan | 0.515 0.485 | 0.207 0.283 0.236 0.274 | 0.299 0.429 0.106 0.146 0.020
san_luis | San Luis | 0.514 0.486 | 0.210 0.287 0.236 0.267 | 0.289 0.432 0.107 0.151 0.021
santa_cruz | Santa Cruz | 0.507 0.493 | 0.211 0.307 0.247 0.235 | 0.254 0.449 0.115 0.161 0.021
santa_fe | Santa Fe | 0.519 0.481 | 0.194 0.279 0.238 0.289 | 0.271 0.428 0.110 0.169 0.022
santiago_estero | Santiago del Estero | 0.513 0.487 | 0.222 0.284 0.231 0.263 | 0.358 0.407 0.097 0.121 0.017
tierra_del_fuego | Tierra del Fuego | 0.504 0.496 | 0.205 0.308 0.248 0.239 | 0.233 0.451 0.118 0.177 0.021
tucuman | Tucumán | 0.514 0.486 | 0.220 0.284 0.232 0.264 | 0.316 0.418 0.103 0.144 0.019
"""

# Level labels of the three base variables, in margin order.
SEXO_LEVELS = ["femenino", "masculino"]
EDAD_LEVELS = ["16-29", "30-44", "45-59", "60+"]
EDUCACION_LEVELS = ["prim", "sec", "terc", "univ", "pos"]

# GBA share within Buenos Aires province.
ESTRATO_BSAS = {"gba": 0.632, "interior": 0.368}

# National region shares.
REGION_NACIONAL = {
    "Región Metropolitana": 0.42,
    "Región Pampeana": 0.23,
    "Región NOA": 0.14,
    "Región NEA": 0.08,
    "Región Cuyo": 0.07,
    "Región Patagonia": 0.06,
}

# Province (lower case, accented) -> region.
PROVINCE_REGION = {
    "buenos aires": "Región Metropolitana",
    "ciudad autónoma de buenos aires": "Región Metropolitana",
    "córdoba": "Región Pampeana",
    "entre ríos": "Región Pampeana",
    "la pampa": "Región Pampeana",
    "santa fe": "Región Pampeana",
    "catamarca": "Región NOA",
    "jujuy": "Región NOA",
    "la rioja": "Región NOA",
    "salta": "Región NOA",
    "santiago del estero": "Región NOA",
    "tucumán": "Región NOA",
    "chaco": "Región NEA",
    "corrientes": "Región NEA",
    "formosa": "Región NEA",
    "misiones": "Región NEA",
    "mendoza": "Región Cuyo",
    "san juan": "Región Cuyo",
    "san luis": "Región Cuyo",
    "chubut": "Región Patagonia",
    "neuquén": "Región Patagonia",
    "río negro": "Región Patagonia",
    "santa cruz": "Región Patagonia",
    "tierra del fuego": "Región Patagonia",
}

# The 39 GBA municipalities (partidos), lower case.
GBA_MUNICIPALITIES = [
    "almirante brown", "avellaneda", "berazategui", "berisso",
    "brandsen", "campana", "cañuelas", "ensenada", "escobar",
    "esteban echeverría", "exaltación de la cruz", "ezeiza",
    "florencio varela", "general las heras", "general rodríguez",
    "general san martín", "hurlingham", "ituzaingó", "josé c. paz",
    "la matanza", "lanús", "la plata", "lomas de zamora", "luján",
    "marcos paz", "malvinas argentinas", "merlo", "moreno", "morón",
    "pilar", "presidente perón", "quilmes", "san fernando",
    "san isidro", "san miguel", "san vicente", "tigre",
    "tres de febrero", "vicente lópez",
]

BASE_VARIABLES = ["sexo", "edad_cat", "nivel_educativo"]


def _parse_margins() -> tuple[dict[str, str], list[tuple[str, str, str, float]]]:
    catalog: dict[str, str] = {}
    rows: list[tuple[str, str, str, float]] = []
    for line in CENSUS_MARGINS.strip().splitlines():
        key, desc, sexo, edad, edu = [p.strip() for p in line.split("|")]
        catalog[key] = desc
        for var, levels, vals in (("sexo", SEXO_LEVELS, sexo),
                                  ("edad_cat", EDAD_LEVELS, edad),
                                  ("nivel_educativo", EDUCACION_LEVELS, edu)):
            nums = [float(v) for v in vals.split()]
            assert len(nums) == len(levels), line
            rows.extend((key, var, lvl, p) for lvl, p in zip(levels, nums))
    return catalog, rows


POPULATIONS, _TARGET_ROWS = _parse_margins()

TARGET_SCHEMA = T.StructType([
    T.StructField("population", T.StringType(), False),
    T.StructField("variable", T.StringType(), False),
    T.StructField("level", T.StringType(), False),
    T.StructField("proportion", T.DoubleType(), False),
])


def population_catalog(spark: SparkSession) -> DataFrame:
    """``census_population(population, description)``, 32 rows."""
    return spark.createDataFrame(sorted(POPULATIONS.items()),
                                 "population string, description string")


def census_target(spark: SparkSession, include_special: bool = True) -> DataFrame:
    """Long margin table ``(population, variable, level, proportion)``.

    352 base rows; with ``include_special`` the GBA/interior rows are attached to
    ``buenos_aires`` (variable ``estrato_bsas``) and the region rows to ``nacional``
    (variable ``region``), 360 rows in total.
    """
    rows = list(_TARGET_ROWS)
    if include_special:
        rows += [("buenos_aires", "estrato_bsas", k, v) for k, v in ESTRATO_BSAS.items()]
        rows += [("nacional", "region", k, v) for k, v in REGION_NACIONAL.items()]
    return spark.createDataFrame(rows, TARGET_SCHEMA)


def check_population(population: str) -> None:
    """S8 existence check; unknown keys raise with the list of options."""
    if population not in POPULATIONS:
        raise KeyError(f"population {population!r} not found; options: {sorted(POPULATIONS)}")


def targets_for(spark: SparkSession, population: str) -> DataFrame:
    """The three base margins of one population ``(variable, level, proportion)``."""
    check_population(population)
    return (census_target(spark, include_special=False)
            .filter(F.col("population") == population)
            .select("variable", "level", "proportion"))


def calibration_targets(spark: SparkSession, population: str,
                        has_bsas_municipalities: bool = False) -> DataFrame:
    """Base margins plus the conditional extra variable.

    ``estrato_bsas`` is added for ``buenos_aires`` when municipalities were found in
    the survey; ``region`` is added for ``nacional``.
    """
    check_population(population)
    t = census_target(spark, include_special=True).filter(F.col("population") == population)
    keep = F.col("variable").isin(BASE_VARIABLES)
    if population == "buenos_aires" and has_bsas_municipalities:
        keep = keep | (F.col("variable") == "estrato_bsas")
    elif population == "nacional":
        keep = keep | (F.col("variable") == "region")
    return t.filter(keep).select("variable", "level", "proportion")


def calibration_variables(population: str, has_bsas_municipalities: bool = False) -> list[str]:
    """Variable list in the reference's order (sexo, edad_cat, nivel_educativo, extra)."""
    check_population(population)
    out = list(BASE_VARIABLES)
    if population == "buenos_aires" and has_bsas_municipalities:
        out.append("estrato_bsas")
    elif population == "nacional":
        out.append("region")
    return out


def province_region(spark: SparkSession) -> DataFrame:
    """Dimension ``province_region(estrato, region)``, 24 rows."""
    return spark.createDataFrame(sorted(PROVINCE_REGION.items()), "estrato string, region string")


def gba_municipality(spark: SparkSession) -> DataFrame:
    """Dimension ``gba_municipality(estrato)``, 39 rows."""
    return spark.createDataFrame([(m,) for m in GBA_MUNICIPALITIES], "estrato string")


def region_of(estrato: Column) -> Column:
    """J1 as an expression: map lookup, unmapped -> null (no join at all)."""
    pairs = []
    for k, v in PROVINCE_REGION.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), estrato)


def targets_dict(population: str, has_bsas_municipalities: bool = False) -> dict[str, dict[str, float]]:
    """S9 as plain Python (for SQL text): ``{variable: {level: proportion}}``, each
    variable rescaled to sum to one (the same rescaling the rake applies)."""
    variables = calibration_variables(population, has_bsas_municipalities)
    raw: dict[str, dict[str, float]] = {}
    for pop, var, lvl, p in _TARGET_ROWS:
        if pop == population and var in variables:
            raw.setdefault(var, {})[lvl] = p
    if "estrato_bsas" in variables:
        raw["estrato_bsas"] = dict(ESTRATO_BSAS)
    if "region" in variables:
        raw["region"] = dict(REGION_NACIONAL)
    return {v: {k: p / sum(raw[v].values()) for k, p in raw[v].items()} for v in variables}
