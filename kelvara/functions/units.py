"""Units of the measured quantities: the fixed table of spellings, and the fuzzy map from any spelling to a unit.

A spelling seen in the data is matched against the table in two steps: an inverted index of character n-grams gives
the candidates, and a weighted edit distance verifies them. Edits that never change a unit (case, brackets, dots,
spaces, a letter of the other alphabet that looks or sounds the same) are nearly free; any other edit costs 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Quantity | unit | factor | offset | spellings. common = (value + offset) * factor.
UNIT_TABLE = """
conductivity | W/(m·K) | 1 | 0 | Вт/(м·К); Вт/(м·°С); Вт/м К; Вт/м·°C; Вт/(м·град); W/(m·K); W/(m·°C); ватт на метр-кельвин; watts per metre kelvin
conductivity | mW/(m·K) | 0.001 | 0 | мВт/(м·К); мВт/м·К; mW/(m·K); милливатт на метр-кельвин; milliwatts per metre kelvin
conductivity | kW/(m·K) | 1000 | 0 | кВт/(м·К); kW/(m·K); киловатт на метр-кельвин
conductivity | W/(cm·K) | 100 | 0 | Вт/(см·К); Вт/см·°C; W/(cm·K); ватт на сантиметр-кельвин; watts per centimetre kelvin
conductivity | kcal/(m·h·°C) | 1.163 | 0 | ккал/(м·ч·°C); ккал/м·ч·град; ккал/(ч·м·°С); kcal/(m·h·°C); kcal/(h·m·K); килокалория на метр-час-градус; килокалория в час на метр-градус
conductivity | BTU·in/(h·ft²·°F) | 0.1442279 | 0 | BTU·in/(h·ft²·°F); БТЕ·дюйм/(ч·фут²·°F)
conductivity | BTU/(h·ft·°F) | 1.730735 | 0 | BTU/(h·ft·°F); БТЕ/(ч·фут·°F)
density | kg/m³ | 1 | 0 | кг/м³; кг/куб. м; kg/m³; килограмм на кубический метр
density | g/cm³ | 1000 | 0 | г/см³; г/куб. см; g/cm³; кг/дм³; кг/л; kg/l; грамм на кубический сантиметр
density | t/m³ | 1000 | 0 | т/м³; т/куб. м; t/m³; тонна на кубический метр
density | lb/ft³ | 16.018463 | 0 | lb/ft³; фунт/фут³; фунт на кубический фут
thickness | mm | 1 | 0 | мм; mm; миллиметр; миллиметры; миллиметров; millimetres
thickness | cm | 10 | 0 | см; cm; сантиметр; сантиметры; сантиметров; centimetres
thickness | m | 1000 | 0 | м; m; метр; метры; метров; metres
thickness | dm | 100 | 0 | дм; dm; дециметр; дециметры; дециметров; decimetres
thickness | km | 1000000 | 0 | км; km; километр; километры; километров; kilometres
thickness | µm | 0.001 | 0 | мкм; µm; um; микрон; микрометр
thickness | in | 25.4 | 0 | дюйм; дюймы; дюймов; in; inch; inches
thickness | ft | 304.8 | 0 | фут; футы; футов; ft; feet
temperature | °C | 1 | 0 | °C; град. C; град. Цельсия; deg C; градус Цельсия; градусы Цельсия; degrees Celsius
temperature | K | 1 | -273.15 | К; K; кельвин; кельвины; kelvin
temperature | °F | 0.5555555555555556 | -32 | °F; град. F; град. Фаренгейта; deg F; градус Фаренгейта; градусы Фаренгейта; degrees Fahrenheit
heat_flow | W | 1 | 0 | Вт; W; ватт; ватты; watts
heat_flow | kW | 1000 | 0 | кВт; тыс. Вт; kW; киловатт; киловатты; kilowatts
heat_flow | MW | 1000000 | 0 | МВт; млн Вт; мегаватт; мегаватты; megawatts
heat_flow | kcal/h | 1.163 | 0 | ккал/ч; ккал/час; kcal/h; килокалория в час
heat_flow | Gcal/h | 1163000 | 0 | Гкал/ч; Гкал/час; Gcal/h; гигакалория в час
heat_flow | BTU/h | 0.29307107 | 0 | БТЕ/ч; BTU/h; BTU/hr
pressure | Pa | 1 | 0 | Па; Pa; паскаль; паскали; pascals
pressure | kPa | 1000 | 0 | кПа; kPa; килопаскаль; килопаскали; kilopascals
pressure | MPa | 1000000 | 0 | МПа; мегапаскаль; мегапаскали; megapascals
pressure | hPa | 100 | 0 | гПа; hPa; гектопаскаль; гектопаскали; hectopascals
pressure | GPa | 1000000000 | 0 | ГПа; GPa; гигапаскаль; гигапаскали; gigapascals
pressure | bar | 100000 | 0 | бар; bar
pressure | mbar | 100 | 0 | мбар; mbar; миллибар
pressure | kgf/cm² | 98066.5 | 0 | кгс/см²; kgf/cm²
pressure | mmH2O | 9.80665 | 0 | мм вод. ст.; мм в. ст.; мм водяного столба; mmH2O; mm H2O; кгс/м²; kgf/m²
pressure | mmHg | 133.322 | 0 | мм рт. ст.; mmHg
pressure | psi | 6894.757 | 0 | psi; фунт/дюйм²
pressure | atm | 101325 | 0 | атм; atm
air_flow | m³/h | 1 | 0 | м³/ч; куб. м/ч; куб. м/час; м³/час; m³/h; кубометр в час; кубический метр в час
air_flow | m³/s | 3600 | 0 | м³/с; куб. м/с; куб. м/сек; m³/s; кубометр в секунду
air_flow | m³/min | 60 | 0 | м³/мин; куб. м/мин; m³/min; кубометр в минуту
air_flow | l/s | 3.6 | 0 | л/с; л/сек; l/s; литр в секунду
air_flow | l/min | 0.06 | 0 | л/мин; l/min; литр в минуту
air_flow | l/h | 0.001 | 0 | л/ч; л/час; l/h; литр в час
air_flow | thousand m³/h | 1000 | 0 | тыс. м³/ч; тыс. куб. м/ч; тысяча кубометров в час; thousand m³/h
air_flow | cfm | 1.6990108 | 0 | CFM; ft³/min; фут³/мин
specific_heat | kJ/(kg·K) | 1 | 0 | кДж/(кг·К); кДж/(кг·°C); кДж/кг·град; kJ/(kg·K); килоджоуль на килограмм-кельвин
specific_heat | J/(kg·K) | 0.001 | 0 | Дж/(кг·К); Дж/(кг·°C); J/(kg·K); джоуль на килограмм-кельвин
specific_heat | kcal/(kg·°C) | 4.1868 | 0 | ккал/(кг·°C); ккал/кг·град; kcal/(kg·°C); килокалория на килограмм-градус
specific_heat | BTU/(lb·°F) | 4.1868 | 0 | BTU/(lb·°F); БТЕ/(фунт·°F)
resistance | m²·K/W | 1 | 0 | м²·К/Вт; м²·°C/Вт; м²·град/Вт; m²·K/W; кв. м·К/Вт; кв. м·°C/Вт
resistance | m²·h·°C/kcal | 0.8598452 | 0 | м²·ч·°C/ккал; м²·ч·град/ккал; m²·h·°C/kcal; кв. м·ч·°C/ккал
resistance | ft²·h·°F/BTU | 0.17611018 | 0 | ft²·h·°F/BTU; фут²·ч·°F/БТЕ
duration | d | 1 | 0 | сут; сут.; сутки; суток; дней; дни; день; дн.; days; day; d
duration | h | 0.041666666666666664 | 0 | ч; час; часы; часов; h; hours; hrs
duration | min | 0.0006944444444444445 | 0 | минуты; минут; minutes
duration | month | 30.4375 | 0 | мес.; месяц; месяцы; месяцев; months
duration | week | 7 | 0 | нед.; недели; недель; weeks
duration | year | 365.25 | 0 | год; годы; лет; years
"""

# Letters that look or sound the same inside a unit.
_SAME = str.maketrans({
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "³": "3", "²": "2", "⁻": "-", "−": "-", "–": "-", "—": "-", "º": "°", "˚": "°", "*": "·", "⋅": "·", "•": "·", "∙": "·", "×": "·",
    "\u00a0": " ", "\u2009": " ", "\u202f": " ", "µ": "u", "μ": "u", "ё": "e",
})
_FREE = set(" .()[]{}·,;:'\"_°")
#: The share of a spelling's length that may be edited at full cost.
MOST_EDITS = 0.12


def longest_spelling() -> int:
    """No longer text can be within MOST_EDITS of a spelling of the table: the limit buys so many free signs, or inflected letters, beside it."""
    most = 0
    for _, _, _, _, spelled in _table():
        for s in spelled.split(";"):
            room = MOST_EDITS * max(1, len(skeleton(s))) + 0.5
            most = max(most, len(folded(s)) + int(room / 0.05))
    return most


def units() -> dict[tuple[str, str], tuple[float, float]]:
    """(quantity, unit) -> (factor, offset)."""
    return {(q, u): (float(f), float(o)) for q, u, f, o, _ in _table()}


def common_unit(quantity: str) -> str:
    return next(u for q, u, *_ in _table() if q == quantity)


@lru_cache(maxsize=1)
def _table() -> list[list[str]]:
    return [[x.strip() for x in line.split("|")] for line in UNIT_TABLE.strip().splitlines()]


def folded(spelling: str) -> str:
    """A spelling without what never changes a unit, but with case where case counts (mW and MW)."""
    s = spelling.strip()
    mega = s[:1] in "MМ" and s[1:3].lower() in ("вт", "па", "w", "pa", "w/")
    giga = s[:1] in "GГ" and s[1:3].lower() in ("па", "pa")
    s = s.lower().translate(_SAME)
    return ("mega" if mega else "giga" if giga else "") + s


def skeleton(spelling: str) -> str:
    return "".join(ch for ch in folded(spelling) if ch not in _FREE)


def weighted_distance(a: str, b: str, limit: float) -> float:
    """Edit distance of two folded spellings: signs in _FREE cost 0.05, a letter 1, an end of word after the fourth letter
    0.3 (inflection). Rows beyond `limit` stop early."""
    cost = [0.05 if ch in _FREE else 1.0 for ch in b]
    for j, ch in enumerate(b):
        if ch.isalpha() and j >= 4 and b[j - 4 : j].isalpha():
            cost[j] = 0.3
    row = [0.0]
    for c in cost:
        row.append(row[-1] + c)
    for i, x in enumerate(a):
        drop = 0.05 if x in _FREE else 0.3 if i >= 4 and a[i - 4 : i + 1].isalpha() else 1.0
        new = [row[0] + drop]
        for j, y in enumerate(b):
            swap = row[j] + (0.0 if x == y else 0.05 if x in _FREE and y in _FREE else max(drop, cost[j]))
            new.append(min(swap, row[j + 1] + drop, new[j] + cost[j]))
        if min(new) > limit:
            return limit + 1
        row = new
    return row[-1]


def ngrams(skeleton_: str) -> list[str]:
    """Character 2-grams with ends."""
    s = f"^{skeleton_}$"
    return sorted({s[i : i + 2] for i in range(len(s) - 1)})


def alias_dictionary(spark: SparkSession, spellings: DataFrame) -> DataFrame:
    """(quantity, spelling, unit) for the spellings (quantity, spelling) that name a unit of their quantity.

    Distinct spellings only; the canonical side is the fixed table. The index join keeps candidates that share at least
    half of the n-grams; the nearest within MOST_EDITS of the length wins, and a tie between two units is no match.
    """
    canon = pd.DataFrame(
        [(q, u, s.strip(), g) for q, u, _, _, spelled in _table() for s in spelled.split(";") for g in ngrams(skeleton(s))],
        columns=["quantity", "unit", "known", "gram"],
    )
    index = F.broadcast(spark.createDataFrame(canon))

    @F.pandas_udf("array<string>")
    def grams(s: pd.Series) -> pd.Series:
        return s.map(lambda x: ngrams(skeleton(x)))

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([
            weighted_distance(x, y, MOST_EDITS * len(z) + 0.5) / max(1, len(z)) for x, y, z in ((folded(p), folded(q), skeleton(q)) for p, q in zip(a, b))
        ])

    distinct = spellings.where("spelling is not null and spelling <> ''").where(F.length("spelling") <= longest_spelling()).select("quantity", "spelling").distinct()
    seen = distinct.withColumn("g", grams("spelling")).withColumn("size", F.size("g")).withColumn("gram", F.explode("g"))
    near = (
        seen.join(index, ["quantity", "gram"]).groupBy("quantity", "spelling", "size", "unit", "known").agg(F.count("*").alias("shared"))
        .where("shared * 2 >= size")
        .withColumn("d", distance("spelling", "known")).where(F.col("d") <= MOST_EDITS)
    )
    best = near.groupBy("quantity", "spelling", "unit").agg(F.min("d").alias("d"))
    pick = best.groupBy("quantity", "spelling").agg(F.min_by("unit", "d").alias("unit"), F.min("d").alias("d0"), F.sort_array(F.collect_list("d")).alias("all"))
    return pick.where("size(all) = 1 or all[1] > d0").select("quantity", "spelling", "unit")


# Words of a bound before a number.
BOUNDS = "не более; не менее; не выше; не ниже; не свыше; до; от; свыше; более; менее; выше; ниже; около; ок.; примерно; порядка; прибл.; макс.; мин.; max; min; max.; min.; up to; at least; at most; not more than; not less than; about; approx.; ca.; от не менее; bis; ab"
_SIGN = r"[+\-−–]?"
_PLAIN = r"(?:\d{1,3}(?:[ \u00a0\u2009\u202f'’]\d{3})+(?:[.,]\d+)?|\d{1,3}(?:,\d{3})+\.\d+|\d{1,3}(?:\.\d{3})+,\d+|\d{1,3}(?:,\d{3}){2,}|\d{1,3}(?:\.\d{3}){2,}|\d+(?:[.,]\d+)?)"
_POWER = r"(?:[EeЕе][+\-−]?\d+|\s?[·*×⋅xхXХ]\s?10(?:\^|\*\*)?(?:[+\-−]?\d+|[⁺⁻]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+))?"
_NUMBER = _PLAIN + _POWER
_WORDS = "|".join(re.escape(w.strip()) for w in sorted(BOUNDS.split(";"), key=len, reverse=True))
_VALUE = re.compile(
    rf"\s*(?P<bound>[≥≤<>≈~∼⩾⩽=]+|(?:{_WORDS})(?=[\s\d+\-−]))?\s*(?P<a>{_SIGN}{_NUMBER})"
    rf"(?:\s*±\s*(?P<tol>{_NUMBER})|\s*\+/-\s*(?P<tol2>{_NUMBER})|(?:\s*(?:\.\.\.?|…|÷)\s*|\s+(?:[–—−\-]|до|to)\s+)(?P<b>{_SIGN}{_NUMBER})|\s*[–—−\-]\s*(?P<c>\+?{_NUMBER}))?"
    r"(?P<unit>.*)",
    re.IGNORECASE | re.DOTALL,
)
# letters that stand where a digit was misread
_NOT_UNIT = re.compile(r"[ОOоoЗбSlI|]{1,2}(?:[\s\d.,]|$)")
_LOWER, _UPPER = re.compile(r"[≥>⩾]|не (?:менее|ниже)|от|свыше|более|выше|мин|min|at least|not less|ab"), re.compile(r"[≤<⩽]|не (?:более|выше|свыше)|до|менее|ниже|макс|max|up to|at most|not more|bis")
_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻", "0123456789+-")
#: Cells that mean "no value". Fixed values.
MISSING = {"", "-", "–", "—", "−", "н/д"}


def _float(s: str) -> float:
    s = re.sub(r"[ \u00a0\u2009\u202f'’]", "", s).replace("−", "-").replace("–", "-").translate(_SUPER)
    m = re.fullmatch(r"([+-]?)([\d.,]+)(?:[EeЕе]([+-]?\d+)|[·*×⋅xхXХ]10(?:\^|\*\*)?([+-]?\d+))?", s)
    sign, digits, e1, e2 = m.groups()
    if digits.count(",") + digits.count(".") > 1:
        last = max(digits.rfind(","), digits.rfind("."))
        if digits.count(digits[last]) > 1:
            digits = digits.replace(",", "").replace(".", "")
        else:
            digits = re.sub(r"[.,]", "", digits[:last]) + "." + digits[last + 1 :]
    return float(f"{sign}{digits.replace(',', '.')}e{e1 or e2 or 0}")


def read_value(cell: str | None) -> tuple[str, float | None, float | None, str | None]:
    """(state, low, high, unit spelling) of a cell. state: missing, value or bad. A plain number has low = high, a bound has
    one side null, a tolerance or range has both."""
    s = (cell or "").strip(" \t\u00a0\u200b\ufeff")
    if s.lower() in MISSING:
        return "missing", None, None, None
    m = _VALUE.fullmatch(s)
    if not m:
        return "bad", None, None, None
    try:
        a = _float(m["a"])
        tol, other = m["tol"] or m["tol2"], m["b"] or m["c"]
        low, high = (a - _float(tol), a + _float(tol)) if tol else (a, _float(other)) if other else (a, a)
    except (ValueError, OverflowError):
        return "bad", None, None, None
    if low > high:
        low, high = high, low
    bound = (m["bound"] or "").lower()
    if bound and _UPPER.match(bound):
        low = None
    elif bound and _LOWER.match(bound):
        high = None
    unit = m["unit"].strip()
    if unit and (unit[0] in ".,;:" or unit[0].isdigit() or _NOT_UNIT.match(unit)):
        return "bad", None, None, None
    return "value", low, high, unit or None


# Words between a quantity's name and its unit.
_LINK = re.compile(r"(?:[\s,:;(\[«»\"—–/=.-]|дан[аоы]?\b|даётся\b|привед[её]н[аоы]?\b|указан[аоы]?\b|выражен[аоы]?\b|измер\w+|значени\w+|столбц\w+|values?\b|given\b|measured\b|is\b|are\b|в(?=\s)|in\s)+", re.IGNORECASE)


@lru_cache(maxsize=1)
def _reach() -> int:
    return longest_spelling()


def stated_spellings(rest: str) -> list[str]:
    """Candidate spellings at the start of a statement's text after the quantity's name, longest first: every beginning that ends at a word and that
    is not too long for any unit."""
    m = _LINK.match(rest)
    s = (rest[m.end() :] if m else rest)[: _reach() + 1]
    cut = re.search(r"[;«»]", s)
    s = s[: cut.start()] if cut else s
    out, stops = [], [x.start() for x in re.finditer(r"[\s,)\]]", s)] + [len(s)]
    for end in sorted(set(stops), reverse=True):
        c = s[:end].strip(" ,.;")
        if c.count("(") < c.count(")"):
            c = c.rstrip(")")
        if c.count("[") < c.count("]"):
            c = c.rstrip("]")
        if c and len(c) <= _reach() and c not in out:
            out.append(c)
    return out


def rows_of(spark: SparkSession) -> DataFrame:
    """The unit table as a frame: quantity, unit, factor, offset, common."""
    rows: Iterator = ((q, u, f, o, u == common_unit(q)) for (q, u), (f, o) in units().items())
    return spark.createDataFrame(list(rows), "quantity string, unit string, factor double, shift double, common boolean")
