"""Word lists of query routing and table mining. Fixed values; every operator takes them as parameters."""

CALC_TRIGGERS = ("рассчитай", "расчет", "вычисли", "посчитай", "формула", "теплопотери", "кратность", "расход", "гсоп", "r=", "q=", "площадь", "объем", "мощность")
DEFINITION_PREFIXES = (
    "что такое ", "что значит ", "что означает ", "что это ", "дай определение ", "дайте определение ", "определение ", "определи ", "термин ", "понятие ",
    "расшифруй ", "расшифровка ", "аббревиатура ",
)
COMPARISON_TRIGGERS = ("сравни", "разница", "отличие", "лучше", "хуже")
REGULATORY_TRIGGERS = ("требования", "норма", "нормы", "сп", "гост", "снип", "пункт", "таблица", "раздел", "допускается", "следует")
APP_CALC_TRIGGERS = ("рассчитай", "вычисли", "посчитай", "толщин", "температур", "потери", "формул", "вентиляц", "расход", "гсоп", "градусо")
APP_TABLE_TRIGGERS = ("таблица", "таблицы", "таблицу", "таблиц", "табл")
REGULATORY_MARKERS = ("должен", "обязан", "требуется", "не менее", "не более", "допустим", "предел", "норма", "стандарт")
STOP_WORDS = ("что", "как", "для", "при", "это", "или", "если")
TABLE_KEYWORDS = ("таблица", "табл", "таблиц", "показатели", "значения", "параметры", "характеристики", "нормативы", "требования")
TABLE_MARKER = "[ТАБЛИЦА"

# formula id: aliases, in order of precedence
FORMULA_ALIASES = (
    ("gsop", ("гсоп", "градусо-сутки", "градусосутки", "dd")),
    ("ventilation_heat", ("вентиляция", "расход теплоты", "нагрев воздуха", "приточный воздух")),
    ("heat_loss", ("теплопотери", "потери тепла", "ограждение", "через стену")),
    ("thermal_resistance_layer", ("сопротивление слоя", "термическое сопротивление", "r слоя")),
    ("required_insulation_thickness", ("толщина изоляции", "требуемая толщина", "утеплитель", "изоляция")),
    ("pipe_surface_heat_flux", ("удельный поток", "тепловой поток", "поток на метр")),
)
# formula id: stems that must all occur, where no alias did
FORMULA_FALLBACKS = (
    ("gsop", ("гсоп",)), ("gsop", ("градусо",)), ("ventilation_heat", ("вентиляц",)), ("ventilation_heat", ("приточ",)), ("heat_loss", ("теплопотер",)),
    ("heat_loss", ("ограждени",)), ("thermal_resistance_layer", ("сопротивление", "слой")), ("required_insulation_thickness", ("изоляция",)),
    ("required_insulation_thickness", ("утеплитель",)),
)
# formula id: name, unit, source, parameters
FORMULAS = (
    ("gsop", "ГСОП", "°C·сут", "СП 131.13330", ("t_v", "t_ot", "z_ot")),
    ("ventilation_heat", "Расход теплоты на вентиляцию", "Вт", "СП 60.13330", ("L", "t_v", "t_n")),
    ("heat_loss", "Теплопотери через ограждение", "Вт", "СП 50.13330", ("A", "delta_t", "R")),
    ("thermal_resistance_layer", "Сопротивление слоя", "м²·°C/Вт", "СП 50.13330", ("delta", "lambda_value")),
    ("required_insulation_thickness", "Требуемая толщина изоляции", "м", "СП 50.13330 / СП 61.13330", ("R_tr", "lambda_value")),
    ("pipe_surface_heat_flux", "Удельный тепловой поток", "Вт/м", "СП 61.13330", ("Q", "L")),
)
CITIES = (
    "москва", "санкт-петербург", "новосибирск", "екатеринбург", "казань", "нижний новгород", "челябинск", "омск", "самара", "ростов-на-дону", "уфа", "красноярск",
    "пермь", "воронеж", "волгоград", "краснодар", "тюмень",
)
CRITICAL_ERRORS = ("MemoryError", "RecursionError", "KeyboardInterrupt", "SystemError")
