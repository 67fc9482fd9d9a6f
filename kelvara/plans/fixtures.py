"""Literal texts for operators that the tables give no case for. Both the queries and their SQL read them."""

MARKED = (
    (1, "Имя\n[ТАБЛИЦА 1]\na b\n1 2\n3 4\n\nx"), (2, "[ТАБЛИЦА 1]\na\n[ТАБЛИЦА 2]\nb\nc\nd"), (3, "[ТАБЛИЦА 1]\na\nb\nc"), (4, "текст\n\n[ТАБЛИЦА 5]\nГород  t\nУфа  -6\nОмск  -8\n\n[ТАБЛИЦА 6]\nодна\n\n" + "д" * 120 + "\n[ТАБЛИЦА 7]\nx\ty\n1\t2\n3\t4"),
    (5, "[ТАБЛИЦА]\n\nпусто"), (6, "таблица без знака\n1\n2"),
)
ALIGNED = (
    (11, "a  b  1\nc  d  2\ne  f  3"), (12, "a  b  1\nc  d  2"), (13, "до\n x   y   1 \nz  w  2  3\n p  q  4\nпосле\na  b  5\nc  d  6\ne  f  7"), (14, "a  b  c\nd  e  f\ng  h  i"), (15, "1 2 3\n4 5 6\n7 8 9"),
)
MIXED = (
    (21, "|a|b|c|\n|---|---|---|\n|1|2|3|\n|4|5|6|"), (22, "|a|b|\n|:---:|:---:|\n|1|2|"), (23, "Значения:\n1 мм\n2 мм\n3 мм"), (24, "x | y\n1 | 2\n3 | 4"), (25, "Климат\n[ТАБЛИЦА 1]\n|Город|t|z|\n|Уфа|-6|220|\n|Омск|-8|230|\n\nПоказатели: ниже\n1 а\n2 б\n3 в"),
)
ERRORS = (
    (1, "ModuleNotFoundError", "No module named 'abc'"), (2, "ModuleNotFoundError", "нет имени"), (3, "FileNotFoundError", "a.pdf"), (4, "ValueError", "Calculation failed"), (5, "QASystemError", "x"), (6, "AgentLoopError", "y"), (7, "FormulaEngineError", "z"),
    (8, "TimeoutError", "a"), (9, "KeyError", "search key"), (10, "Unknown", ""), (11, "Unknown", "беда"), (12, "MemoryError", "m"), (13, "KeyboardInterrupt", "k"), (14, "UnicodeDecodeError", "u"), (15, "OSError", "диск"),
)
