"""DuckDB SQL for the ingest, parsing, sink and data-quality keys."""

from __future__ import annotations

from tidewise import vocab as V
from tidewise.plans.registry import P
from tidewise.plans.registry_etl import FACT_OF, MORE_RULES
from tidewise.schemas import FACT_KEYS, FACT_SCHEMAS, FACT_VALUE, STAGING_WIDTH
from tidewise.sources.bindings_sql import FACT_CTE, q, with_facts
from tidewise.sources.staging import REVISED_LINE, SHORT_LINE, WIDE_LINE
from tidewise.sources.staging_sql import PARSE, STG, parsed_ctes, reject_pred

ORACLE = {}
Y = P["last_year"]


def _clean_select(name):
    cols = ", ".join(f.name for f in FACT_SCHEMAS[FACT_OF[name]].fields)
    _, v, _ = PARSE[name]
    return f"SELECT {cols} FROM prs_{name} WHERE NOT {reject_pred(name)} AND {v} IS NOT NULL"


for _n in PARSE:
    _f, _c = parsed_ctes(_n)
    ORACLE[f"etl_{_n}"] = with_facts(_f, _c, _clean_select(_n))

_fm, _cm = parsed_ctes("residents_motives")
_fl, _cl = parsed_ctes("residents_lodging")
ORACLE["fuse_marginals"] = with_facts(_fm + _fl, _cm + _cl,
                                      f"{_clean_select('residents_motives')} UNION ALL {_clean_select('residents_lodging')}")

_audit_ctes, _audit_facts, _audit_sel = [], [], []
for _n in PARSE:
    _f, _c = parsed_ctes(_n)
    _audit_facts += _f
    _audit_ctes += _c
    _, _v, _ = PARSE[_n]
    _audit_sel.append(f"""SELECT {q(_n)} AS tabla, COUNT(*) AS "read",
        CAST(SUM(CASE WHEN NOT {reject_pred(_n)} AND {_v} IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS kept,
        CAST(SUM(CASE WHEN NOT {reject_pred(_n)} AND {_v} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS dropped,
        CAST(SUM(CASE WHEN {reject_pred(_n)} THEN 1 ELSE 0 END) AS BIGINT) AS rejected FROM prs_{_n}""")
ORACLE["load_audit"] = with_facts(_audit_facts, _audit_ctes, " UNION ALL ".join(_audit_sel))

_f, _c = parsed_ctes("foreign_motives")
ORACLE["drop_missing_rows"] = with_facts(_f, _c, _clean_select("foreign_motives"))
ORACLE["append_load"] = ORACLE["fuse_marginals"]


def _summary(fact, cte):
    year = "anio" if "anio" in FACT_SCHEMAS[fact].names else "CAST(year(fecha) AS INTEGER)"
    return f"""SELECT {q(fact)} AS tabla, {year} AS anio, COUNT(*) AS filas, CAST(SUM({FACT_VALUE[fact]}) AS DOUBLE) AS total
        FROM {cte} GROUP BY ALL"""


ORACLE["published_facts"] = ORACLE["csv_export_facts"] = with_facts(
    list(FACT_CTE.values()), [], " UNION ALL ".join(_summary(n, c) for n, c in FACT_CTE.items()))
_files, _ctes, _scans = [], [], []
for _n in PARSE:
    _f, _c = STG[_n]
    _files += _f
    _ctes += _c
    _scans.append(f"""SELECT {q(_n)} AS tabla, COUNT(*) AS filas, COUNT(NULLIF(col1, '')) AS con_primera,
        COUNT(NULLIF(col{STAGING_WIDTH[_n]}, '')) AS con_valor FROM stg_{_n}""")
ORACLE["staging_scan_all"] = with_facts(_files, _ctes, " UNION ALL ".join(_scans))

ORACLE["table_row_counts"] = with_facts(list(FACT_CTE.values()), [], " UNION ALL ".join(
    f"SELECT {q(n)} AS tabla, COUNT(*) AS filas FROM {c}" for n, c in FACT_CTE.items()))
ORACLE["table_preview"] = with_facts(["fx_foreign_m"], [], """SELECT * FROM fx_foreign_m
    ORDER BY id_ccaa, motivo, fecha LIMIT 5""")
_f, _c = STG["quarterly_spend"]
ORACLE["constant_column_check"] = with_facts(_f, _c, """SELECT columna, n_distintos, n_distintos <= 1 AS constante FROM (
    SELECT 'col2' AS columna, COUNT(DISTINCT col2) AS n_distintos FROM stg_quarterly_spend
    UNION ALL SELECT 'col3', COUNT(DISTINCT col3) FROM stg_quarterly_spend) t""")
# In a delimited file an empty field and a NULL are the same thing: both read back as NULL.
ORACLE["csv_staging_scan"] = with_facts(_f, _c, "SELECT " + ", ".join(
    f"NULLIF(col{i}, '') AS col{i}" for i in range(1, 6)) + " FROM stg_quarterly_spend")
ORACLE["clean_export_roundtrip"] = with_facts(["fx_foreign_m"], [], f"""SELECT *, CAST(year(fecha) AS INTEGER) AS anio
    FROM fx_foreign_m""")
ORACLE["dim_region_join"] = with_facts(["fx_foreign_m"], [], f"""SELECT t.id_ccaa, t.turistas, n.n_name AS destino FROM (
    SELECT id_ccaa, SUM(turistas) AS turistas FROM fx_foreign_m WHERE year(fecha) = {Y} GROUP BY 1) t
    JOIN nation n ON n.n_nationkey = t.id_ccaa""")
ORACLE["schema_conform"] = with_facts(["fx_residents_y"], [], "SELECT * FROM fx_residents_y")


def _stg_key(name, col, exprs, distinct=True):
    f, c = STG[name]
    d = "DISTINCT " if distinct else ""
    return with_facts(f, c, f"SELECT {d}{col} AS texto, {exprs} FROM stg_{name}")


def _code(c):
    return f"TRY_CAST(left(trim({c}), 2) AS INTEGER)"


_QY = "TRY_CAST(left(trim(col4), 4) AS INTEGER)"
_QT = "TRY_CAST(right(trim(col4), 1) AS INTEGER)"
_MY = "TRY_CAST(left(trim(col8), 4) AS INTEGER)"
_MM = "TRY_CAST(right(trim(col8), 2) AS INTEGER)"
_MISS = "('', '.', '..')"


def _num(c, kind):
    t = (f"replace(trim({c}), '.', '')" if kind == "BIGINT"
         else f"replace(replace(trim({c}), '.', ''), ',', '.')")
    return f"(CASE WHEN {c} IS NULL OR trim({c}) IN {_MISS} THEN NULL ELSE TRY_CAST({t} AS {kind}) END)"


def _like(c, pairs):
    return "(CASE " + " ".join(f"WHEN {c} LIKE {q(p)} THEN {q(v)}" for p, v in pairs) + " END)"


ORACLE["parse_code_prefix"] = _stg_key("quarterly_spend", "col1",
    f"{_code('col1')} AS id_ccaa, trim(substr(trim(col1), strpos(trim(col1), ' ') + 1)) AS destino")
ORACLE["parse_period_quarter"] = _stg_key("quarterly_spend", "col4",
    f"{_QY} AS anio, {_QT} AS trimestre, CASE WHEN {_QT} BETWEEN 1 AND 4 THEN make_date({_QY}, ({_QT} - 1) * 3 + 1, 1) END AS fecha")
ORACLE["parse_period_month"] = _stg_key("foreign_motives", "col8",
    f"{_MY} AS anio, {_MM} AS mes, CASE WHEN {_MM} BETWEEN 1 AND 12 THEN make_date({_MY}, {_MM}, 1) END AS fecha")
ORACLE["parse_period_year"] = _stg_key("foreign_spend", "col4", "TRY_CAST(trim(col4) AS INTEGER) AS anio")
ORACLE["parse_number_es_decimal"] = _stg_key("foreign_spend", "col5",
    f"CAST({_num('col5', 'DECIMAL(14,2)')} AS DOUBLE) AS valor", False)
ORACLE["parse_number_es_bigint"] = _stg_key("foreign_motives", "col9", f"{_num('col9', 'BIGINT')} AS turistas", False)
ORACLE["missing_marker_to_null"] = _stg_key("quarterly_spend", "col5",
    f"(col5 IS NULL OR trim(col5) IN {_MISS}) AS faltante, CAST({_num('col5', 'DECIMAL(14,2)')} AS DOUBLE) AS valor", False)
ORACLE["empty_to_null"] = _stg_key("residents_lodging", "col4", "NULLIF(trim(col4), '') AS alojamiento_nivel2")
ORACLE["map_category_like"] = _stg_key("capacity", "col1", f"{_like('col1', V.SURVEY_TYPE_PATTERNS)} AS tipo_alojamiento")
ORACLE["map_residence"] = _stg_key("demand", "col5", f"{_like('trim(col5)', V.RESIDENCE_PATTERNS)} AS residencia")
ORACLE["map_value_passthrough"] = _stg_key("demand", "col6",
    "CASE WHEN trim(col6) = 'Viajero' THEN 'Viajeros' ELSE trim(col6) END AS metrica")


# ---- lots: the extract with faults, parsed, and the fate of each row ---------------

def _lot_ctes(name, known=None):
    """Facts and CTEs up to ``fate_<name>``; ``known`` names an extract that was loaded before into the same fact."""
    facts, stg = STG[name]
    n = STAGING_WIDTH[name]
    cols = [f"col{i}" for i in range(1, n + 1)]
    size = " + ".join(f"length(COALESCE({c}, ''))" for c in cols)
    text = " || ';' || ".join(f"COALESCE({c}, '')" for c in cols)
    (a, x), (b, y), (c, z) = SHORT_LINE, WIDE_LINE, REVISED_LINE
    sound = f"{size} AS size, size % {a} = {x} AS short, NOT short AND size % {b} = {y} AS wide"
    last = cols[-1]
    faulty = f"""SELECT * EXCLUDE (size, short, wide), CASE WHEN short THEN 'faltan_campos' WHEN wide THEN 'sobran_campos' END AS _bad,
            CASE WHEN short THEN {text.rsplit(" || ';' || ", 1)[0]} WHEN wide THEN {text} || ';x' ELSE {text} END AS _texto FROM raw_{name}
        UNION ALL SELECT * EXCLUDE (size, short, wide) REPLACE ('7' AS {last}), NULL, {text.rsplit(" || ';' || ", 1)[0]} || ';7' FROM raw_{name}
            WHERE NOT short AND NOT wide AND size % {c} = {z}"""
    select, _, where = PARSE[name][0].partition("WHERE ")
    select = select.replace(f"FROM stg_{name}", f", _bad, _texto FROM stg_{name}")
    if where and name != "residents_lodging":  # that one is fused by its key here
        select += f"WHERE _bad IS NOT NULL OR ({where})"
    _, value, period = PARSE[name]
    fact = FACT_OF[name]
    keys = FACT_KEYS[fact]
    same = " AND ".join(f"k.{c} IS NOT DISTINCT FROM p.{c}" for c in keys)
    is_known = f"EXISTS (SELECT 1 FROM fate_{known} k WHERE k.suerte = 'cargada' AND {same})" if known else "FALSE"
    reason = f"""CASE WHEN _bad IS NOT NULL THEN _bad WHEN id_ccaa IS NULL THEN 'codigo_region' WHEN {period} IS NULL THEN 'periodo'
        WHEN {value} IS NULL AND NOT _miss THEN 'valor' END"""
    fate = f"""SELECT *, CASE WHEN motivo_rechazo IS NOT NULL THEN 'rechazada' WHEN {value} IS NULL THEN 'suprimida'
            WHEN {is_known} THEN 'ya_cargada' WHEN place > 1 THEN 'repetida' ELSE 'cargada' END AS suerte FROM (
        SELECT *, row_number() OVER (PARTITION BY {", ".join(keys)}, motivo_rechazo IS NULL AND {value} IS NOT NULL ORDER BY _texto) AS place
        FROM (SELECT *, {reason} AS motivo_rechazo FROM lot_{name}) r) p"""
    ctes = stg[:-1] + [(f"raw_{name}", f"SELECT *, {sound} FROM ({stg[-1][1]}) s"), (f"stg_{name}", faulty), (f"lot_{name}", select), (f"fate_{name}", fate)]
    return facts, ctes


_lot_facts, _lots = [], []
for _n in PARSE:
    _f, _c = _lot_ctes(_n, "residents_motives" if _n == "residents_lodging" else None)
    _lot_facts += _f
    _lots += _c


def _over_lots(select):
    return with_facts(_lot_facts, _lots, " UNION ALL ".join(select(n) for n in PARSE))


_FATES = ("cargada", "suprimida", "rechazada", "ya_cargada", "repetida")
ORACLE["load_observed"] = _over_lots(lambda n: f"SELECT {q(n)} AS tabla, COUNT(*) AS leidas, " + ", ".join(
    f"COUNT(*) FILTER (suerte = {q(f)}) AS {f}" for f in _FATES) + f" FROM fate_{n}")
ORACLE["load_rejects"] = _over_lots(lambda n: f"""SELECT {q(n)} AS tabla, motivo_rechazo, COUNT(*) AS filas
    FROM fate_{n} WHERE motivo_rechazo IS NOT NULL GROUP BY 2""")
ORACLE["load_losers"] = _over_lots(lambda n: f"""SELECT {q(n)} AS tabla, suerte, _texto AS texto FROM fate_{n}
    WHERE suerte IN ('ya_cargada', 'repetida')""")


def _lot_summary(n):
    fact = FACT_OF[n]
    year = "anio" if "anio" in FACT_SCHEMAS[fact].names else "CAST(year(fecha) AS INTEGER)"
    return f"SELECT {q(fact)} AS tabla, {year} AS anio, {FACT_VALUE[fact]} AS v FROM fate_{n} WHERE suerte = 'cargada'"


ORACLE["repeated_load"] = with_facts(_lot_facts, _lots, f"""SELECT tabla, anio, COUNT(*) AS filas, CAST(SUM(v) AS DOUBLE) AS total
    FROM ({" UNION ALL ".join(_lot_summary(n) for n in PARSE)}) t GROUP BY 1, 2""")
_fk, _ck = parsed_ctes("residents_lodging")
_ck = [(n, s.replace("WHERE trim(col3) <> 'Total'", "") if n.startswith("prs_") else s) for n, s in _ck]
ORACLE["fuse_on_key"] = with_facts(_fm + _fk, _cm + _ck, f"""SELECT * FROM ({_clean_select('residents_motives')}) m
    UNION ALL SELECT * FROM ({_clean_select('residents_lodging')}) l WHERE NOT EXISTS (SELECT 1 FROM ({_clean_select('residents_motives')}) m
        WHERE {" AND ".join(f"m.{k} IS NOT DISTINCT FROM l.{k}" for k in FACT_KEYS["residents"])})""")


def _violations(n):
    fact, clean = FACT_OF[n], f"({_clean_select(n)}) c"
    keys, value = ", ".join(FACT_KEYS[fact]), FACT_VALUE[fact]
    cells = f"(SELECT COUNT(*) AS n, COUNT(DISTINCT {value}) AS m FROM {clean} GROUP BY {keys}) g"
    names = f"(SELECT id_ccaa, COUNT(*) AS n, COUNT(DISTINCT destino) AS m FROM {clean} GROUP BY 1) g"
    orphans = f"(SELECT id_ccaa, COUNT(*) AS n FROM {clean} WHERE id_ccaa NOT IN (SELECT n_nationkey FROM nation) GROUP BY 1) g"
    rules = {"clave_unica": f"COUNT(*) AS violaciones, SUM(n - 1) AS filas FROM {cells} WHERE n > 1",
             "celda_ambigua": f"COUNT(*), SUM(n) FROM {cells} WHERE m > 1", "region_nombre": f"COUNT(*), SUM(n) FROM {names} WHERE m > 1",
             "region_huerfana": f"COUNT(*), SUM(n) FROM {orphans}", "region_sin_codigo": f"COUNT(*), COUNT(*) FROM {clean} WHERE id_ccaa IS NULL"}
    return " UNION ALL ".join(f"SELECT {q(n)} AS tabla, {q(r)} AS regla, {s}" for r, s in rules.items())


_all_facts = [f for n in PARSE for f in parsed_ctes(n)[0]]
_all_ctes = [(c, s.replace("WHERE trim(col3) <> 'Total'", "") if c == "prs_residents_lodging" else s) for n in PARSE for c, s in parsed_ctes(n)[1]]
ORACLE["constraint_violations"] = with_facts(_all_facts, _all_ctes, f"""SELECT tabla, regla, violaciones,
    CAST(COALESCE(filas, 0) AS BIGINT) AS filas FROM ({" UNION ALL ".join(_violations(n) for n in PARSE)}) v""")

ORACLE["clustered_facts"] = ORACLE["published_facts"]
_f, _c = STG["capacity"]
ORACLE["map_by_rules"] = with_facts(_f, _c, f"""SELECT col1 AS texto, {_like('col1', V.SURVEY_TYPE_PATTERNS)} AS tipo,
    {_like('col1', [r[1:] for r in sorted([(i + 1, p, e) for i, (p, e) in enumerate(V.SURVEY_TYPE_PATTERNS)] + MORE_RULES)])} AS tipo_ampliado,
    COUNT(*) AS filas FROM stg_capacity GROUP BY 1, 2, 3""")
_f, _c = STG["demand"]
ORACLE["unmapped_names"] = with_facts(_f, _c, f"""SELECT col1 AS nombre, COUNT(*) AS filas FROM stg_demand
    WHERE col1 IS NOT NULL AND {_like('col1', V.SURVEY_TYPE_PATTERNS)} IS NULL GROUP BY 1""")
