"""DuckDB SQL mirror of the staging extracts and of the ETL parse, for the oracle."""

from __future__ import annotations

from tidewise import vocab as V
from tidewise.sources import staging as S
from tidewise.sources.bindings_sql import FX, q

MISSING = "('', '.', '..')"


def _len(c):
    return f"length(COALESCE({c}, ''))"


def label(k, id_col="id_ccaa", name_col="destino"):
    code = f"lpad(CAST({id_col} AS VARCHAR), 2, '0')"
    full = f"{code} || ' ' || {name_col}"
    return (f"(CASE WHEN ({k}) % 89 = 7 THEN 'Total Nacional' WHEN ({k}) % 89 = 8 THEN {code} "
            f"WHEN ({k}) % 3 = 0 THEN '  ' || {full} || '  ' ELSE {full} END)")


def es(c, decimals):
    if decimals:
        return f"translate(format('{{:,.2f}}', CAST({c} AS DOUBLE)), ',.', '.,')"
    return f"translate(format('{{:,}}', CAST({c} AS BIGINT)), ',.', '.,')"


def value_text(k, c, decimals):
    bad = f"{es(c, 0)} || ',5'" if decimals == 0 else "'n.d.'"
    return (f"(CASE WHEN ({k}) % 50 = 0 THEN '.' WHEN ({k}) % 50 = 1 THEN '..' WHEN ({k}) % 50 = 2 THEN '' "
            f"WHEN ({k}) % 50 = 3 THEN NULL WHEN ({k}) % 97 = 5 THEN {bad} ELSE {es(c, decimals)} END)")


def month_text(f="fecha"):
    return f"CAST(year({f}) AS VARCHAR) || 'M' || lpad(CAST(month({f}) AS VARCHAR), 2, '0')"


def cmap(c, pairs, default=None):
    body = " ".join(f"WHEN {c} = {q(a)} THEN {q(b)}" for a, b in pairs)
    return f"(CASE {body} ELSE {q(default) if default is not None else 'NULL'} END)"


def cols(*exprs):
    return ", ".join(f"{e} AS col{i}" for i, e in enumerate(exprs, 1))


K_Q = "(id_ccaa * 7 + anio * 13 + trimestre * 3 + length(metrica))"
K_R = f"(id_ccaa * 7 + anio * 13 + {_len('motivo')} + {_len('alojamiento_nivel1')} + {_len('alojamiento_nivel2')} * 2)"
K_F = "(id_ccaa * 7 + year(fecha) * 13 + month(fecha) * 3 + length(motivo))"
K_S = "(id_ccaa * 7 + anio * 13 + length(metrica))"
K_C = f"(id_ccaa * 7 + year(fecha) * 13 + month(fecha) * 3 + {_len('tipo_alojamiento')})"
K_D = (f"(id_ccaa * 7 + year(fecha) * 13 + month(fecha) * 3 + {_len('tipo_alojamiento')}"
       f" + {_len('residencia')} * 5 + {_len('metrica')})")


def _res_text(src, where=""):
    return (f"SELECT {cols(label(K_R), q(V.TRIPS), 'alojamiento_nivel1', "COALESCE(alojamiento_nivel2, '')", 'motivo',
                           q(V.TOTAL), q(V.TOTAL), q(V.TOTAL), q(V.TOTAL), 'CAST(anio AS VARCHAR)',
                           value_text(K_R, 'viajes', 0))} FROM {src} {where}")


_REGION_OR_EMPTY = lambda k: f"(CASE WHEN ({k}) % 41 = 0 THEN '' ELSE {label(k)} END)"

STG = {  # name -> (fixture CTEs needed, list of (cte, sql)); the extract is CTE stg_<name>
    "quarterly_spend": (["fx_trips_q"], [("stg_quarterly_spend", f"""SELECT {cols(
        label(K_Q), 'metrica', "'Valor absoluto'", "CAST(anio AS VARCHAR) || 'T' || CAST(trimestre AS VARCHAR)",
        f"CASE WHEN metrica = 'Viajes' THEN {value_text(K_Q, 'valor', 0)} ELSE {value_text(K_Q, 'valor', 2)} END")}
        FROM fx_trips_q""")]),
    "residents_motives": (["fx_residents_y"], [("stg_residents_motives",
                                                _res_text("fx_residents_y", "WHERE alojamiento_nivel1 = 'Total'"))]),
    "residents_lodging": ([], FX["fx_residents_y"][2:3] + [
        ("fxr_lod_t", """SELECT id_ccaa, anio, l1, l2, COUNT(*) AS viajes FROM (
            SELECT id_ccaa, anio, l1, l2 FROM fxr_lines
            UNION ALL SELECT id_ccaa, anio, l1, CAST(NULL AS VARCHAR) FROM fxr_lines
            UNION ALL SELECT id_ccaa, anio, 'Total', CAST(NULL AS VARCHAR) FROM fxr_lines) t GROUP BY 1, 2, 3, 4"""),
        ("lod_named", """SELECT l.id_ccaa, n.n_name AS destino, 'Total' AS motivo, l.l1 AS alojamiento_nivel1,
            l.l2 AS alojamiento_nivel2, l.anio, l.viajes FROM fxr_lod_t l JOIN nation n ON n.n_nationkey = l.id_ccaa"""),
        ("stg_residents_lodging", _res_text("lod_named"))]),
    "foreign_motives": (["fx_foreign_m"], [("stg_foreign_motives", f"""SELECT {cols(
        "'Total de vías de acceso'", label(K_F), 'motivo', "'Total de tipos de alojamiento'",
        "'Total de formas de organización del viaje'", "'Total noches'", "'Total país de residencia'",
        month_text(), value_text(K_F, 'turistas', 0))} FROM fx_foreign_m""")]),
    "foreign_spend": (["fx_spend_y"], [("stg_foreign_spend", f"""SELECT {cols(
        label(K_S), 'metrica', "'Dato base'", 'CAST(anio AS VARCHAR)', value_text(K_S, 'valor', 2))}
        FROM fx_spend_y""")]),
    "capacity": (["fx_capacity_m"], [("stg_capacity", f"""SELECT {cols(
        cmap('tipo_alojamiento', S.SURVEY_OF_TYPE, S.UNMAPPED_SURVEY), "'Total Nacional'", _REGION_OR_EMPTY(K_C),
        f"CASE WHEN ({K_C}) % 5 = 0 THEN {q(S.OTHER_METRIC)} ELSE {q(V.CAPACITY_METRIC)} END",
        month_text(), value_text(K_C, 'plazas', 0))} FROM fx_capacity_m""")]),
    "demand": (["fx_demand_m"], [("stg_demand", f"""SELECT {cols(
        cmap('tipo_alojamiento', S.SURVEY_OF_TYPE, S.UNMAPPED_SURVEY), "'Total Nacional'", _REGION_OR_EMPTY(K_D),
        "'Total'", f"COALESCE({cmap('residencia', S.RESIDENCE_TEXT)}, '')",
        "CASE WHEN metrica = 'Viajeros' THEN 'Viajero' ELSE metrica END", month_text(),
        value_text(K_D, 'valor', 0))} FROM fx_demand_m""")]),
}
# residents_lodging needs fxr_lines, which needs nothing else
STG["residents_lodging"] = ([], STG["residents_lodging"][1])


def code(c):
    return f"TRY_CAST(left(trim({c}), 2) AS INTEGER)"


def name(c):
    return f"trim(substr(trim({c}), strpos(trim({c}), ' ') + 1))"


def num(c, kind):
    t = (f"replace(trim({c}), '.', '')" if kind == "BIGINT"
         else f"replace(replace(trim({c}), '.', ''), ',', '.')")
    return f"(CASE WHEN {c} IS NULL OR trim({c}) IN {MISSING} THEN NULL ELSE TRY_CAST({t} AS {kind}) END)"


def missing(c):
    return f"({c} IS NULL OR trim({c}) IN {MISSING})"


def month_date(c):
    y = f"TRY_CAST(left(trim({c}), 4) AS INTEGER)"
    m = f"TRY_CAST(right(trim({c}), 2) AS INTEGER)"
    return f"(CASE WHEN {m} BETWEEN 1 AND 12 THEN make_date({y}, {m}, 1) END)"


def like_map(c, pairs):
    return "(CASE " + " ".join(f"WHEN {c} LIKE {q(p)} THEN {q(v)}" for p, v in pairs) + " END)"


def _src_filter(region, period, min_year):
    return (f"{region} IS NOT NULL AND trim({region}) <> '' "
            f"AND TRY_CAST(left(trim({period}), 4) AS INTEGER) >= {min_year}")


QY = "TRY_CAST(left(trim(col4), 4) AS INTEGER)"
QT = "TRY_CAST(right(trim(col4), 1) AS INTEGER)"
_RES_PARSE = f"""SELECT {code('col1')} AS id_ccaa, {name('col1')} AS destino, trim(col5) AS motivo,
    NULLIF(trim(col3), '') AS alojamiento_nivel1, NULLIF(trim(col4), '') AS alojamiento_nivel2,
    TRY_CAST(trim(col10) AS INTEGER) AS anio, {num('col11', 'BIGINT')} AS viajes, {missing('col11')} AS _miss"""

PARSE = {  # name -> (select list over stg_<name>, where, value col, period col)
    "quarterly_spend": (f"""SELECT {code('col1')} AS id_ccaa, {name('col1')} AS destino, trim(col2) AS metrica,
        {QY} AS anio, {QT} AS trimestre,
        CASE WHEN {QT} BETWEEN 1 AND 4 THEN make_date({QY}, ({QT} - 1) * 3 + 1, 1) END AS fecha,
        {num('col5', 'DECIMAL(14,2)')} AS valor, {missing('col5')} AS _miss FROM stg_quarterly_spend""",
                        "valor", "fecha"),
    "residents_motives": (f"{_RES_PARSE} FROM stg_residents_motives", "viajes", "anio"),
    "residents_lodging": (f"{_RES_PARSE} FROM stg_residents_lodging WHERE trim(col3) <> 'Total'", "viajes", "anio"),
    "foreign_motives": (f"""SELECT {code('col2')} AS id_ccaa, {name('col2')} AS destino, trim(col3) AS motivo,
        {month_date('col8')} AS fecha, {num('col9', 'BIGINT')} AS turistas, {missing('col9')} AS _miss
        FROM stg_foreign_motives""", "turistas", "fecha"),
    "foreign_spend": (f"""SELECT {code('col1')} AS id_ccaa, {name('col1')} AS destino, trim(col2) AS metrica,
        TRY_CAST(trim(col4) AS INTEGER) AS anio, {num('col5', 'DECIMAL(14,2)')} AS valor, {missing('col5')} AS _miss
        FROM stg_foreign_spend""", "valor", "anio"),
    "capacity": (f"""SELECT {code('col3')} AS id_ccaa, {name('col3')} AS destino,
        {like_map('col1', V.SURVEY_TYPE_PATTERNS)} AS tipo_alojamiento, {month_date('col5')} AS fecha,
        {num('col6', 'BIGINT')} AS plazas, {missing('col6')} AS _miss FROM stg_capacity
        WHERE trim(col4) = {q(V.CAPACITY_METRIC)} AND {_src_filter('col3', 'col5', S.MIN_YEAR)}""", "plazas", "fecha"),
    "demand": (f"""SELECT {code('col3')} AS id_ccaa, {name('col3')} AS destino,
        {like_map('col1', V.SURVEY_TYPE_PATTERNS)} AS tipo_alojamiento,
        {like_map('trim(col5)', V.RESIDENCE_PATTERNS)} AS residencia,
        CASE WHEN trim(col6) = 'Viajero' THEN 'Viajeros' ELSE trim(col6) END AS metrica,
        {month_date('col7')} AS fecha, {num('col8', 'BIGINT')} AS valor, {missing('col8')} AS _miss
        FROM stg_demand WHERE {_src_filter('col3', 'col7', S.MIN_YEAR)}""", "valor", "fecha"),
}

FACT_OF = {"quarterly_spend": "quarterly_spend", "residents_motives": "residents",
           "residents_lodging": "residents", "foreign_motives": "foreign_motives",
           "foreign_spend": "foreign_spend", "capacity": "capacity", "demand": "demand"}


def parsed_ctes(name):
    """Fixture + staging + parse CTEs; the parsed rows are CTE prs_<name>."""
    facts, stg = STG[name]
    sel, _, _ = PARSE[name]
    return facts, stg + [(f"prs_{name}", sel)]


def reject_pred(name):
    _, v, p = PARSE[name]
    return f"(id_ccaa IS NULL OR {p} IS NULL OR ({v} IS NULL AND NOT _miss))"
