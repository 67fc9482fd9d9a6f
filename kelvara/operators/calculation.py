"""Engineering formulas as numeric projections, and the reading of their parameters from questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelvara.lexicons import CITIES, FORMULA_ALIASES, FORMULA_FALLBACKS, FORMULAS

_VALUE = r"(-?\d+(?:\.\d+)?)"
_ANY = r"\s*[:=]?\s*"
_WORD = r"(?:^|[^\p{L}\p{N}_])"
# parameter: names in lower-case text with decimal points; a single letter must stand alone
_NAMES = {
    "A": ("(?:a|площадь)",), "R": ("сопротивление", "r"), "t_v": ("(?:tv|tв|внутренняя(?: температура)?)",), "t_n": ("(?:tn|tн|наружная(?: температура)?)",),
    "t_ot": ("(?:tot|tот|средняя температура отопительного периода)",), "z_ot": ("(?:zot|zот|продолжительность отопительного периода)",),
    "L": ("(?:расход воздуха|длина)", "l"), "delta": ("(?:delta|толщина|δ)",), "lambda_value": ("(?:lambda|λ|теплопроводность)",),
    "R_tr": ("(?:rtr|rтр|требуемое сопротивление)",), "Q": ("тепловой поток", "q"), "delta_t": ("(?:deltat|δt|разность температур)",),
}


def parameter_pattern(name: str) -> str:
    """The expression of a parameter; its value is group 1."""
    words, *letter = _NAMES[name]
    alone = f"|{_WORD}{letter[0]}(?:\\s*[:=]\\s*|\\s+)" if letter else ""
    return f"(?:{words}{_ANY}{alone}){_VALUE}"


PARAMETERS = tuple(_NAMES)


def parameters(query: Column) -> dict[str, Column]:
    """The first value of every parameter that a question names, or null."""
    text = F.replace(F.lower(query), F.lit(","), F.lit("."))
    return {p: F.nullif(F.regexp_extract(text, parameter_pattern(p), 1), F.lit("")).cast("double") for p in PARAMETERS}


def formula_key(query: Column) -> Column:
    """The first formula with an alias in the question, else the first whose stems all occur, else null."""
    text, out = F.lower(query), None
    for key, words in [*((k, (a,)) for k, aliases in FORMULA_ALIASES for a in aliases), *FORMULA_FALLBACKS]:
        hit = F.lit(True)
        for w in words:
            hit = hit & F.contains(text, F.lit(w))
        out = F.when(hit, key) if out is None else out.when(hit, key)
    return out


def city_in(query: Column, cities: tuple[str, ...] = CITIES) -> Column:
    """The longest city name in the question, the earlier of the list among equals."""
    text, out = F.lower(query), None
    for c in sorted(cities, key=len, reverse=True):
        hit = F.contains(text, F.lit(c.lower()))
        out = F.when(hit, c) if out is None else out.when(hit, c)
    return out


def gsop(t_v, t_ot, z_ot):
    return (t_v - t_ot) * z_ot


def ventilation_heat(flow, t_v, t_n):
    return F.lit(0.335) * flow * (t_v - t_n)


def heat_loss(area, delta_t, resistance):
    return F.try_divide(area * delta_t, resistance)


def layer_resistance(delta, conductivity):
    return F.try_divide(delta, conductivity)


def insulation_thickness(r_required, conductivity):
    return r_required * conductivity


def heat_flux(q, length):
    return F.try_divide(q, length)


def insulation(conductivity: Column, t_in: Column, t_out: Column, q: Column, r_outer: Column) -> dict[str, Column]:
    """Flat-surface insulation in mm, the size to order (to the nearest 10, halves to even) and the verdict."""
    mm = conductivity * (F.try_divide(t_in - t_out, q) - r_outer) * 1000
    verdict = F.when(mm < 20, "below minimum").when(mm > 320, "above maximum").when(mm > 200, "several layers").otherwise("ok")
    return {"delta_mm": mm, "recommended_mm": F.bround(mm / 10, 0) * 10, "verdict": verdict}


_RESULT = {
    "gsop": lambda p: gsop(p["t_v"], p["t_ot"], p["z_ot"]), "ventilation_heat": lambda p: ventilation_heat(p["L"], p["t_v"], p["t_n"]),
    "heat_loss": lambda p: heat_loss(p["A"], p["delta_t"], p["R"]), "thermal_resistance_layer": lambda p: layer_resistance(p["delta"], p["lambda_value"]),
    "required_insulation_thickness": lambda p: insulation_thickness(p["R_tr"], p["lambda_value"]), "pipe_surface_heat_flux": lambda p: heat_flux(p["Q"], p["L"]),
}


def answers(queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """(id_col, formula, missing, result, status, confidence): every question that asks for a known formula. status: ok, missing (parameters) or
    error (division by zero)."""
    p = parameters(F.col(text_col))
    rows = queries.select(id_col, formula_key(F.col(text_col)).alias("formula"), *(c.alias(n) for n, c in p.items())).where("formula is not null")
    missing = result = None
    for key, _, _, _, needed in FORMULAS:
        gap = F.concat_ws(",", *(F.when(F.col(n).isNull(), F.lit(n)) for n in needed))
        value = _RESULT[key]({n: F.col(n) for n in needed})
        here = F.col("formula") == key
        missing = F.when(here, gap) if missing is None else missing.when(here, gap)
        result = F.when(here, value) if result is None else result.when(here, value)
    out = rows.withColumn("missing", missing).withColumn("result", result)
    status = F.when(F.col("missing") != "", "missing").when(F.col("result").isNull(), "error").otherwise("ok")
    confidence = F.when(F.col("missing") != "", 0.3).when(F.col("result").isNull(), 0.0).otherwise(0.9)
    return out.select(id_col, "formula", "missing", "result", status.alias("status"), confidence.alias("confidence"))


def registry(spark) -> DataFrame:
    """(formula, name, unit, source, parameters): the known formulas."""
    return spark.createDataFrame([(k, n, u, s, ",".join(p)) for k, n, u, s, p in FORMULAS], "formula string, name string, unit string, source string, parameters string")


def table_plan(query: Column, city: Column) -> Column:
    """What to compute from a climate table for a question about a city: ventilation (needs a flow), heat_loss (needs area and resistance), else
    gsop; null without a city or with a need unmet."""
    low, p = F.lower(query), parameters(query)
    air = F.contains(low, F.lit("вентиляц")) | F.contains(low, F.lit("расход теплоты")) | F.contains(low, F.lit("нагрев воздуха"))
    wall = F.contains(low, F.lit("теплопотер")) | F.contains(low, F.lit("потери тепла")) | F.contains(low, F.lit("ограждени"))
    flow = F.coalesce(F.nullif(F.regexp_extract(low, r"(\d+[.,]?\d*)\s*м³/ч", 1), F.lit("")), F.nullif(F.regexp_extract(low, r"расход\s*(\d+[.,]?\d*)", 1), F.lit("")), p["L"].cast("string"))
    return F.when(city.isNull(), None).when(air, F.when(flow.isNotNull(), "ventilation")).when(wall, F.when(p["A"].isNotNull() & p["R"].isNotNull(), "heat_loss")).otherwise("gsop")


#: What the climate tables are searched by, in this order. Fixed values.
CLIMATE_PHRASES = ("климатические параметры температура отопительный период", "температура наружного воздуха отопительный период")
#: Room temperature of table-driven calculations. Fixed value.
ROOM_C = 20.0


def air_flow(query: Column) -> Column:
    """The air flow that a question names: before m³/h, after the word for flow, else the parameter L."""
    low = F.lower(query)
    read = lambda p: F.replace(F.nullif(F.regexp_extract(low, p, 1), F.lit("")), F.lit(","), F.lit(".")).cast("double")
    return F.coalesce(read(r"(\d+[.,]?\d*)\s*м³/ч"), read(r"расход\s*(\d+[.,]?\d*)"), parameters(query)["L"])


def table_answers(queries: DataFrame, climate: DataFrame, has_tables: Column) -> DataFrame:
    """(query_id, city, plan, outcome, result, confidence, source, answer): questions (query_id, query, city) that are computed from a climate table.

    outcome: ok, no_tables, city_not_found, no_numbers, no_climate (a calculation that needs a table row that isn't there) or error (resistance
    0). climate: one row per city (tables.climate_of); has_tables: whether any climate table was found."""
    p = parameters(F.col("query"))
    asked = queries.select("query_id", "city", table_plan(F.col("query"), F.col("city")).alias("plan"), air_flow(F.col("query")).alias("flow"), p["A"].alias("area"), p["R"].alias("resistance")).where("plan is not null")
    rows = asked.join(climate, "city", "left").withColumn("has_tables", has_tables)
    found = F.when(~F.col("has_tables"), "no_tables").when(F.col("numbers").isNull(), "city_not_found").when(F.col("z_ot").isNull() | F.col("t_ot").isNull(), "no_numbers").otherwise("ok")
    outside = F.round("t_ot", 1)
    value = (
        F.when(F.col("plan") == "gsop", gsop(F.lit(ROOM_C), F.col("t_ot"), F.col("z_ot"))).when(F.col("plan") == "ventilation", ventilation_heat(F.col("flow"), F.lit(ROOM_C), outside))
        .otherwise(heat_loss(F.col("area"), F.lit(ROOM_C) - outside, F.col("resistance")))
    )
    rows = rows.withColumn("found", found)
    rows = rows.withColumn("result", F.when(F.col("found") == "ok", value))
    simple = F.col("plan") == "gsop"
    outcome = F.when(simple | (F.col("found") == "ok"), F.when((F.col("found") == "ok") & F.col("result").isNull(), "error").otherwise(F.col("found"))).otherwise("no_climate")
    rows = rows.withColumn("outcome", outcome)
    confidence = F.when(F.col("outcome") == "ok", F.when(simple, 0.9).otherwise(0.85)).when(F.col("outcome") == "no_numbers", 0.2).otherwise(0.0)
    said = (
        F.when(F.col("outcome") == "ok", F.format_string("%s = %.2f %s", F.when(simple, "ГСОП для").when(F.col("plan") == "ventilation", "Расход теплоты на вентиляцию для").otherwise("Теплопотери для"), F.col("result"), F.when(simple, "°C·сут").otherwise("Вт")))
        .when(F.col("outcome") == "no_tables", F.concat(F.lit("Не найдены климатические таблицы для города "), "city")).when(F.col("outcome") == "city_not_found", F.concat(F.lit("Город не найден в климатических таблицах: "), "city"))
        .when(F.col("outcome") == "no_numbers", F.concat(F.lit("Нет климатических данных для города "), "city")).when(F.col("outcome") == "error", F.lit("Ошибка расчёта: деление на ноль"))
        .otherwise(F.concat(F.lit("Нет климатических данных для города "), "city"))
    )
    said = F.when(F.col("outcome") == "ok", F.regexp_replace(said, " для = ", F.concat(F.lit(" для "), "city", F.lit(" = ")))).otherwise(said)
    return rows.select("query_id", "city", "plan", "outcome", "result", confidence.alias("confidence"), F.when(F.col("outcome").isin("ok", "no_numbers"), F.col("source")).alias("source"), said.alias("answer"))


def driver(queries: DataFrame, tabled: DataFrame) -> DataFrame:
    """(query_id, formula, path, status, result, confidence, answer): every question that asks for a known formula; one that a climate table serves (tabled:
    table_answers) is answered from it, any other from its own parameters."""
    own = answers(queries)
    both = own.join(tabled.select("query_id", "outcome", F.col("result").alias("t_result"), F.col("confidence").alias("t_confidence"), F.col("answer").alias("t_answer")), "query_id", "left")
    served = F.col("outcome").isNotNull() & F.col("formula").isin("gsop", "ventilation_heat", "heat_loss")
    said = F.when(F.col("status") == "ok", F.format_string("%s = %.2f", "formula", "result")).when(F.col("status") == "missing", F.concat(F.lit("Укажите значения: "), F.replace("missing", F.lit(","), F.lit(", ")))).otherwise(F.lit("Ошибка расчёта: деление на ноль"))
    pick = lambda a, b: F.when(served, F.col(a)).otherwise(F.col(b) if isinstance(b, str) else b)
    return both.select("query_id", "formula", F.when(served, "table").otherwise("parameters").alias("path"), pick("outcome", "status").alias("status"), pick("t_result", "result").alias("result"), pick("t_confidence", "confidence").alias("confidence"), pick("t_answer", said).alias("answer"))
