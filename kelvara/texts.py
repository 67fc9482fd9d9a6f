"""Texts that answers are made of: the glossary, error messages and prompts. Fixed values."""

# term | definition | source | example, in order of precedence
GLOSSARY_TEXT = """
гсоп | Градусо-сутки отопительного периода (ГСОП) = (t_в - t_от) × z_от | СП 131.13330 | Для Москвы: (20 - (-3,1)) × 214 = 4943 °C·сут
градусо-сутки | Градусо-сутки отопительного периода (ГСОП) = (t_в - t_от) × z_от | СП 131.13330 | Для Москвы: (20 - (-3,1)) × 214 = 4943 °C·сут
dd | ГСОП — Degree Days (Градусо-сутки отопительного периода) | СП 131.13330 | Для Москвы: (20 - (-3,1)) × 214 = 4943 °C·сут
овк | ОВК — Отопление, Вентиляция, Кондиционирование | СП 60.13330 | Системы ОВК проектируются по СП 60.13330
hvac | HVAC — Heating, Ventilation, Air Conditioning (ОВК) | СП 60.13330 | Системы HVAC проектируются по СП 60.13330
вэр | ВЭР — Вторичные Энергетические Ресурсы | Энергосбережение | Рекуперация тепла, аккумулирование
снип | СНиП — Строительные Нормы и Правила (заменены на СП) | Техническое регулирование | СНиП 23-02-2003 заменён на СП 50.13330
гост | ГОСТ — Государственный Стандарт | Техническое регулирование | ГОСТ 30494-2011 — Микроклимат помещений
изоляция | Тепловая изоляция — уменьшение теплопередачи. δ = λ × ((t_в - t_н)/q - R_н) | СП 61.13330 | Расчёт толщины изоляции по формуле В.18
теплоизоляция | Тепловая изоляция — конструкция для уменьшения теплопередачи. | СП 61.13330 | Материалы: минеральная вата, пенополистирол
утеплитель | Утеплитель — материал с низкой теплопроводностью для теплоизоляции | СП 61.13330 | Минеральная вата, пенополистирол, пенополиуретан
термическое сопротивление | Термическое сопротивление R = δ/λ, где δ — толщина слоя (м), λ — коэффициент теплопроводности (Вт/(м·К)) | СП 50.13330 | R_0 ≥ R_тр для ограждающих конструкций
сопротивление теплопередаче | Сопротивление теплопередаче R_0 = 1/α_в + R_к + 1/α_н | СП 50.13330 | α_в и α_н — коэффициенты теплоотдачи
теплопроводность | Теплопроводность λ — способность материала проводить тепло. Чем ниже λ, тем лучше теплоизоляция. | СП 50.13330 | Для утеплителей: λ = 0,02-0,05 Вт/(м·К)
коэффициент теплопроводности | Коэффициент теплопроводности λ [Вт/(м·К)] — характеристика материала | СП 50.13330 | Для утеплителей: λ = 0,02-0,05 Вт/(м·К), для кирпича: λ = 0,5-1,0 Вт/(м·К)
теплопотери | Теплопотери — количество тепла, теряемое через ограждающие конструкции | СП 50.13330 | Q = (t_в - t_н) / R_0 × S, где S — площадь поверхности
тепловой поток | Тепловой поток q [Вт/м²] — плотность теплового потока через единицу площади | СП 50.13330 | q = (t_в - t_н) / R_0
точка росы | Точка росы — температура, при которой водяной пар в воздухе достигает насыщения | СП 50.13330 | Важна для расчёта влажностного режима ограждающих конструкций
энергоэффективность | Энергоэффективность — отношение полезного эффекта к затратам энергии | Приказ Минстроя | Классы: A, B, C, D, E
энергосбережение | Энергосбережение — комплекс мер по снижению потребления энергии | Энергосбережение | Утепление, рекуперация, автоматизация
тепловая защита | Тепловая защита здания — комплекс свойств ограждающих конструкций | СП 50.13330 | Обеспечивают нормируемый тепловой режим помещений
рекуперация | Рекуперация — использование тепла вытяжного воздуха для подогрева приточного | СП 60.13330 | КПД рекуператора до 85%
рекуператор | Рекуператор — устройство для передачи тепла между вытяжным и приточным воздухом | СП 60.13330 | Пластинчатый, роторный, с промежуточным теплоносителем
тепловой насос | Тепловой насос — устройство для отбора тепла от низкопотенциальных источников | Энергосбережение | Земля, вода, воздух для отопления и ГВС
микроклимат | Микроклимат — климатические условия внутри помещения | ГОСТ 30494-2011 | Температура: 20-24°C, влажность: 30-60%
ограждающие конструкции | Ограждающие конструкции — стены, перекрытия, покрытия, окна, двери | СП 50.13330 | Разделяют внутреннюю и наружную среду
отопление | Отопление — система обогрева помещений | СП 60.13330 | Расчётная температура: 20-22°C
вентиляция | Вентиляция — организованный воздухообмен в помещении | СП 60.13330 | Норма: 3 м³/ч на 1 м²
кондиционирование | Кондиционирование — поддержание температуры, влажности и чистоты воздуха | СП 60.13330 | Параметры: t=22-24°C, влажность=40-60%
сп 60 | СП 60.13330 — Свод правил «Отопление, вентиляция и кондиционирование воздуха» | Техническое регулирование | Основной документ по системам ОВК
сп 50 | СП 50.13330 — Свод правил «Тепловая защита зданий» | Техническое регулирование | Основной документ по теплозащите
сп 131 | СП 131.13330 — Строительная климатология | Техническое регулирование | Климатические данные для строительства
предел огнестойкости | Предел огнестойкости — это время в минутах от начала стандартного огневого воздействия до наступления одного или нескольких предельных состояний конструкции. | Встроенный инженерный глоссарий | Например, R 60 означает сохранение несущей способности в течение 60 минут.
коэффициент надежности | Коэффициент надежности — это нормативный коэффициент, учитывающий запас по нагрузке, материалу, ответственности конструкции или условиям работы в зависимости от контекста расчёта. | Встроенный инженерный глоссарий | Точное значение зависит от вида расчёта и применяемого нормативного документа.
прогиб | Прогиб — это перемещение точки элемента конструкции, обычно измеряемое перпендикулярно его первоначальной оси под действием нагрузки. | Встроенный инженерный глоссарий | Для балки прогиб обычно проверяют по предельным состояниям второй группы.
"""
GLOSSARY = tuple(tuple(x.strip() for x in line.split("|")) for line in GLOSSARY_TEXT.strip().splitlines())

# error class | message to the user; {m} is the error's own message, {lib} the name quoted in it
ERROR_TEXT = """
ModuleNotFoundError | ⚠️ Отсутствует необходимая библиотека. Установите: pip install {lib}
FileNotFoundError | 📁 Файл не найден: {m}
KeyError | 🔑 Отсутствует ключ в данных: {m}
ValueError | 📊 Ошибка в данных: {m}
ConnectionError | 🌐 Ошибка подключения. Проверьте интернет-соединение.
TimeoutError | ⏰ Превышено время ожидания. Попробуйте позже.
PermissionError | 🔒 Нет доступа к файлу: {m}
JSONDecodeError | 📄 Ошибка парсинга JSON. Проверьте формат данных.
ZeroDivisionError | ⚠️ Деление на ноль. Проверьте исходные данные.
TypeError | ⚠️ Неверный тип данных: {m}
AttributeError | ⚠️ Ошибка доступа к атрибуту: {m}
ImportError | ⚠️ Ошибка импорта: {m}
RuntimeError | ⚠️ Ошибка выполнения: {m}
MemoryError | ⚠️ Недостаточно памяти. Попробуйте уменьшить объём данных.
IndexError | ⚠️ Выход за границы списка. Проверьте индексы.
NotImplementedError | ⚠️ Функция ещё не реализована.
StopIteration | ⚠️ Итерация завершена.
OverflowError | ⚠️ Число слишком велико для обработки.
RecursionError | ⚠️ Превышена глубина рекурсии.
KeyboardInterrupt | ⏹️ Операция прервана пользователем.
OSError | ⚠️ Системная ошибка: {m}
IOError | ⚠️ Ошибка ввода/вывода: {m}
UnicodeDecodeError | ⚠️ Ошибка декодирования. Проверьте кодировку файла.
UnicodeEncodeError | ⚠️ Ошибка кодирования. Проверьте текстовые данные.
"""
ERRORS = tuple(tuple(x.strip() for x in line.split(" | ")) for line in ERROR_TEXT.strip().splitlines())
# by area, before the class counts
AREA_ERRORS = (("calculation", "📐 Ошибка расчёта: {m}"), ("search", "🔍 Ошибка поиска: {m}"), ("agent", "🤖 Ошибка агента: {m}"))
OTHER_ERROR, UNKNOWN_ERROR, UNNAMED_LIBRARY = "❌ Ошибка: {m}", "Неизвестная ошибка", "название-библиотеки"
NOT_FOUND = "Не удалось найти релевантную информацию в документах."

# prompts by kind of question: head, fields, steps
PROMPTS = {
    "search": ("Ты — инженерный помощник. Найди информацию по запросу.", (("Запрос", "query"), ("Контекст из документов", "context")), ("Найди релевантную информацию", "Выдели ключевые пункты", "Укажи источник", "Если информации нет — скажи «не найдено»")),
    "calculation": ("Ты — инженерный помощник. Выполни расчёт.", (("Запрос", "query"), ("Формула", "formula"), ("Исходные данные", "data")), ("Покажи формулу", "Покажи исходные данные", "Выполни подстановку", "Покажи результат с единицами", "Укажи источник")),
    "definition": ("Ты — инженерный помощник. Дай определение термина.", (("Термин", "term"), ("Определение", "definition"), ("Источник", "source")), ("Дай чёткое определение", "Укажи документ и пункт", "Приведи пример")),
    "table": ("Ты — инженерный помощник. Найди таблицу по запросу.", (("Запрос", "query"), ("Таблица", "table"), ("Источник", "source")), ("Покажи таблицу в читаемом формате", "Объясни ключевые значения", "Укажи источник")),
    "fallback": ("Ты — инженерный помощник. Ответь на вопрос.", (("Вопрос", "query"),), ("Если знаешь — ответь кратко и по делу", "Если не знаешь — скажи «не найдено»", "Всегда указывай источник")),
    "comparison": ("Ты — инженерный помощник. Сравни два объекта.", (("Объект 1", "first"), ("Объект 2", "second")), ("Найди информацию об обоих объектах", "Сравни характеристики", "Выдели ключевые отличия", "Укажи источники")),
    "regulatory": ("Ты — инженерный помощник. Найди нормативные требования.", (("Запрос", "query"),), ("Найди соответствующие нормативы (ГОСТ, СП, СНиП)", "Выдели ключевые требования", "Укажи пункты документов", "Если требований нет — скажи «не найдено»")),
}
