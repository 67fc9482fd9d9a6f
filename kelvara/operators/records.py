"""Records of tables kept as text: loading the sound ones, setting the faulty ones apart with a reason, and bringing
every value to the common unit of its quantity (problems 1 and 2).

Each task writes the record lines of its tables to files, one per delimiter and width, and lets DuckDB read them with
reject tables; line errors are joined to the raw records by the line's key, and lines that an open quote swallowed are
read again. Plain numbers come typed from the reader, other values are parsed per column, and the units are resolved
through the alias dictionary of `functions.units`.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelvara.functions import units as U
from kelvara.session import cut_lineage

#: Tables read together by one DuckDB call, and their characters.
SLICE, SLICE_CHARS = 2000, 8_000_000
_US = "\x1f"
#: Quantities of which no value is below zero. Fixed values.
NOT_NEGATIVE = ("conductivity", "density", "thickness", "specific_heat", "resistance", "duration", "air_flow", "pressure", "heat_flow")
ABSOLUTE_ZERO_C = -273.15

_CELL = pa.struct([("row_no", pa.int32()), ("text", pa.string()), ("state", pa.string()), ("lo", pa.float64()), ("hi", pa.float64()), ("unit", pa.string())])
_COLUMN = pa.struct([("col_no", pa.int32()), ("quantity", pa.string()), ("stated", pa.list_(pa.string())), ("cells", pa.list_(_CELL))])
_FAULT = pa.struct([("row_no", pa.int32()), ("reason", pa.string()), ("line", pa.string())])
_RECORD = pa.struct([("row_no", pa.int32()), ("cells", pa.list_(pa.string()))])
_OUT = pa.schema([("table_id", pa.int64()), ("headers", pa.list_(pa.string())), ("records", pa.list_(_RECORD)), ("faults", pa.list_(_FAULT)), ("columns", pa.list_(_COLUMN))])
_DDL = (
    "table_id bigint, headers array<string>, records array<struct<row_no:int,cells:array<string>>>, "
    "faults array<struct<row_no:int,reason:string,line:string>>, columns array<struct<col_no:int,quantity:string,stated:array<string>,"
    "cells:array<struct<row_no:int,text:string,state:string,lo:double,hi:double,unit:string>>>>"
)


class Names:
    """Column names of the quantities."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.quantity = {n.strip().casefold(): q for q, names in rows if names for n in names.split(";") if n.strip()}
        alt = "|".join(re.escape(n) for n in sorted(self.quantity, key=len, reverse=True)) or r"(?!)"
        self.header = re.compile(rf"\s*(?P<base>(?P<name>{alt})(?: \d+)?)(?P<rest>(?![\w-]).*)", re.IGNORECASE | re.DOTALL)
        self.mention = re.compile(rf"(?<![\w])(?P<base>(?P<name>{alt})(?: 2(?![\d.]))?)(?![\w])", re.IGNORECASE)

    def column(self, header: str | None) -> tuple[str, str, list[str]] | None:
        """(quantity, base name, spellings of its unit) of a header, or None."""
        m = self.header.fullmatch(header or "")
        if not m:
            return None
        return self.quantity[m["name"].casefold()], m["base"].casefold().strip(), U.stated_spellings(m["rest"])

    def statements(self, text: str | None) -> list[tuple[str, str, list[str]]]:
        """(quantity, base name, spellings) for every quantity that a title or note mentions."""
        out = []
        for m in self.mention.finditer(text or ""):
            out.append((self.quantity[m["name"].casefold()], m["base"].casefold(), U.stated_spellings(text[m.end() :])))
        return out


def delimiter_of(header: str) -> str:
    """The delimiter that the header line shows: | ; , a tab or two and more spaces; '' for one column."""
    for d in ("|", "\t"):
        if d in header:
            return d
    if re.search(r"\S {2,}\S", header):
        return "  "
    outside = re.sub(r'"(?:[^"]|"")*"', "", header)
    return ";" if ";" in outside else "," if "," in outside else ""


def _grammar(d: str) -> re.Pattern:
    field = rf'(?:"(?:[^"]|"")*"|[^"{re.escape(d)}]*)'
    return re.compile(rf"{field}(?:{re.escape(d)}{field})*")


_GRAMMAR = {d: _grammar(d) for d in ";,"}


class Table:
    """One table's header, record lines and delimiter class."""

    def __init__(self, headers: list | None, rows: list | None, raw: str | None):
        self.lines: list[str] = []
        self.note, self.delimiter = None, _US
        self.headers = headers
        if raw is not None:
            lines = raw.split("\n")
            header, body = lines[0], lines[1:]
            d = delimiter_of(header)
            if body and "-" in body[0] and re.fullmatch(r"[|\s:;,\t-]*", body[0]):
                body = body[1:]
            while body and not body[-1].strip():
                body.pop()
            if body and body[-1].lstrip().startswith("Примечание"):
                self.note = body.pop()
            framed = d == "|" and header.lstrip().startswith("|")
            self.delimiter = d if d in (";", ",") else _US
            self.lines = [self._plain(x, d, framed) for x in body]
            if self.headers is None:
                self.headers = self._split(self._plain(header, d, framed))
        elif rows is not None:
            parts = [[x or "" for x in r or []] for r in rows]
            self.delimiter = self._quoted_by(parts, len(self.headers or []))
            self.lines = [self.delimiter.join(r) for r in parts]
            self.headers = self.headers or []
        self.headers = [h if h is not None else "" for h in self.headers or []]
        self.width = len(self.headers)

    @staticmethod
    def _plain(line: str, d: str, framed: bool) -> str:
        line = line.rstrip("\r")
        if d in (";", ","):
            return line
        if framed:
            line = line.strip()
            line = line[1:] if line.startswith("|") else line
            line = line[:-1] if line.endswith("|") else line
        if d == "|":
            return _US.join(x.strip() for x in line.split("|"))
        if d == "\t":
            return line.replace("\t", _US)
        return re.sub(r" {2,}", _US, line.strip(" ")) if d else line

    def _split(self, line: str) -> list[str]:
        if self.delimiter == _US:
            return line.split(_US)
        fields = re.findall(rf'(?:^|{self.delimiter})("(?:[^"]|"")*"|[^{self.delimiter}]*)', line)
        return [f[1:-1].replace('""', '"') if f[:1] == '"' and len(f) > 1 else f for f in fields]

    def _quoted_by(self, rows: list[list[str]], width: int) -> str:
        """The delimiter of rows split without regard to quotes: the quoting one if their quotes work as quotes."""
        if not any(c.startswith('"') for r in rows for c in r):
            return _US
        plain = sum(len(r) == width for r in rows)
        best, most = _US, (plain, 0)
        whole = any(re.search(r'^".*""', c) for r in rows for c in r)
        for d in (";", ","):
            sound = decimals = 0
            for r in rows:
                line = d.join(r)
                fields = re.findall(rf'(?:^|{d})("(?:[^"]|"")*"|[^{d}]*)', line)
                sound += bool(_GRAMMAR[d].fullmatch(line)) and len(fields) == width
                # what a quoted field holds tells which sign it was quoted for
                decimals += sum(bool(re.match(rf'"[+\-−]?\d+{d}\d', f)) for f in fields) if d == "," else 0
            if (sound, decimals) > most or (whole and best == _US and sound >= plain * 0.8):
                best, most = d, (sound, decimals)
        return best


#: A cell that is a number as it stands; DuckDB gives it typed. Anything else is read by units.read_value.
_NUMBER = "[+-]?[0-9]{1,15}([.,][0-9]{1,15})?"
_COUNTS = ("MISSING COLUMNS", "TOO MANY COLUMNS")


def _read(groups: dict[tuple[str, int], list[tuple[int, str]]], folder: str, con) -> tuple[dict[int, tuple[list[str], list[float | None]]], dict[int, str]]:
    """Sound cells with the numbers among them, and reasons, by line key. groups: lines by delimiter and width.

    One file per group. A quote that never closes makes the reader swallow the lines up to the next quote: the reject (or a cell that
    holds a line end) names the culprit, and the swallowed lines are read again, which at least halves the culprits that are left.
    """
    sound: dict[int, tuple[list[str], list[float | None]]] = {}
    faults: dict[int, str] = {}
    for n, ((d, width), lines) in enumerate(groups.items()):
        quoting = d != _US
        pending = [(key, line.replace("\r", " ").replace("\n", " ")) for key, line in lines]
        names = [f"c{i}" for i in range(width)]
        columns = ", ".join(["'k': 'BIGINT'", *(f"'{c}': 'VARCHAR'" for c in names)])
        typed = ", ".join(f"case when regexp_full_match({c}, '{_NUMBER}') then replace({c}, ',', '.')::double end" for c in names)
        sign = "'\"'" if quoting else "''"
        while pending:
            path = os.path.join(folder, f"{n}.csv")
            body = "".join(f"{key}{d}{line}\n" for key, line in pending).encode()
            with open(path, "wb") as f:
                f.write(body)
            # a record may span lines where a quote is open, so the whole file is the longest possible line
            room = max(len(body) + 1024, 1 << 16)
            con.execute("drop table if exists reject_errors; drop table if exists reject_scans")
            got = con.execute(
                f"select k, [{', '.join(names)}], [{typed}] from read_csv('{path}', delim='{d}', quote={sign}, escape={sign}, header=false, auto_detect=false, strict_mode=true, "
                f"null_padding=false, store_rejects=true, parallel=false, max_line_size={room}, buffer_size={2 * room}, columns={{{columns}}})"
            ).fetchall()
            done: dict[int, str | None] = {}
            swallowed: set[int] = set()
            for key, cells, numbers in got:
                taken = [c for c in cells if c and "\n" in c] if quoting else ()
                if taken:
                    done[key] = "quoting"
                    swallowed.update(_keys("\n".join(taken).split("\n")[1:], d))
                else:
                    done[key] = None
                    sound[key] = (["" if c is None else c for c in cells], numbers)
            for text, kind in con.execute("select csv_line, error_type::varchar from reject_errors").fetchall():
                head, *more = (text or "").rstrip("\n").split("\n")
                for key in _keys([head], d):
                    if done.get(key) != "quoting":
                        done[key] = "column_count" if kind in _COUNTS and not more else "quoting"
                    sound.pop(key, None)
                swallowed.update(_keys(more, d))
            # what is neither read, rejected nor swallowed stands behind a quote that is open to the end of the file
            tail = next((key for key, _ in pending if key not in done and key not in swallowed), None)
            if tail is not None:
                done[tail] = "quoting"
            left = [x for x in pending if x[0] not in done]
            if quoting:
                # the reader takes some breaches of the quoting rules as text; every quote is checked against them
                for key, line in pending:
                    if key in done and '"' in line and not _GRAMMAR[d].fullmatch(line):
                        done[key] = "quoting"
            for key, reason in done.items():
                if reason:
                    sound.pop(key, None)
                    faults[key] = reason
            pending = left
    return sound, faults


def _keys(lines: list[str], d: str) -> list[int]:
    return [int(k) for x in lines if (k := x.split(d, 1)[0]).isdigit()]


def load_tables(tables: DataFrame, quantities: DataFrame) -> DataFrame:
    """One row per table: its headers, sound records, faults, and per column of a known quantity the cells with their numbers.

    Null headers come from raw_text and null raw_text from rows; a table with neither has no records. `quantities`
    (common_units) is a fixed table and goes to the tasks as names.
    """
    known = [(r.quantity, r.names) for r in quantities.select("quantity", "names").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        names = Names(known)
        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        for rows in _slices(batches):
            folder = tempfile.mkdtemp(prefix="kelvara-records-")
            try:
                yield _slice(rows, names, folder, con)
            finally:
                shutil.rmtree(folder, ignore_errors=True)

    source = tables.select(F.col("table_id").cast("bigint"), "title", "headers", "rows", "raw_text")
    return source.mapInArrow(run, _DDL)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Tables for one DuckDB call: up to SLICE of them, fewer where they are long."""
    held, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            own = len(row["raw_text"] or "") or sum(len(c or "") for r in row["rows"] or [] for c in r or [])
            if held and (len(held) >= SLICE or size + own > SLICE_CHARS):
                yield held
                held, size = [], 0
            held.append(row)
            size += own
    if held:
        yield held


def _slice(rows: list[dict], names: Names, folder: str, con) -> pa.RecordBatch:
    groups: dict[tuple[str, int], list[tuple[int, str]]] = {}
    parsed, places = [], {}
    for r in rows:
        t = Table(r["headers"], r["rows"], r["raw_text"])
        parsed.append((r, t))
        for row_no, line in enumerate(t.lines):
            key = len(places)
            places[key] = (len(parsed) - 1, row_no, line)
            if t.width:
                groups.setdefault((t.delimiter, t.width), []).append((key, line))
    sound, faults = _read(groups, folder, con)
    # structs as tuples in the order of their fields
    records: list[list] = [[] for _ in parsed]
    wrong: list[list] = [[] for _ in parsed]
    columns: list[list] = [[] for _ in parsed]
    numbers: list[list] = [[] for _ in parsed]
    for key, (k, row_no, line) in places.items():
        if key in sound:
            cells, typed = sound[key]
            records[k].append((row_no, cells))
            numbers[k].append(typed)
        else:
            wrong[k].append((row_no, faults.get(key, "column_count"), line.replace(_US, " | ")))
    for k, (r, t) in enumerate(parsed):
        title, note = names.statements(r["title"]), names.statements(t.note)
        named = [(i, names.column(h)) for i, h in enumerate(t.headers)]
        bases = {c[1] for _, c in named if c}
        for i, c in named:
            if not c:
                continue
            quantity, base, stated = c
            for told in (title, note):
                for q, b, spellings in told:
                    if q == quantity and (b == base or b not in bases):
                        stated = stated + spellings
            cells = []
            for (row_no, row), typed in zip(records[k], numbers[k]):
                x = typed[i]
                cells.append((row_no, row[i], "value", x, x, None) if x is not None else (row_no, row[i], *U.read_value(row[i])))
            columns[k].append((i, quantity, stated, cells))
    arrays = [[r["table_id"] for r, _ in parsed], [t.headers for _, t in parsed], records, wrong, columns]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(arrays, _OUT)], schema=_OUT)


def table_values(loaded: DataFrame) -> DataFrame:
    """Every cell of a known quantity: table_id, row_no, col_no, quantity, text, state (missing, value, bad), unit, unit_common,
    lo, hi in the common unit. A cell with an unknown unit or an impossible value is bad.

    `loaded` must be stable (checkpointed): it is read for the dictionary and again for the values.
    """
    spark = loaded.sparkSession
    columns = loaded.select("table_id", F.explode("columns").alias("c")).select("table_id", "c.*").where("size(cells) > 0")
    stated = columns.select("table_id", "col_no", "quantity", F.posexplode("stated").alias("pos", "spelling"))
    own = columns.select("quantity", F.explode("cells.unit").alias("spelling"))
    dictionary = cut_lineage(U.alias_dictionary(spark, stated.select("quantity", "spelling").unionByName(own)))
    by_column = stated.join(dictionary, ["quantity", "spelling"]).groupBy("table_id", "col_no").agg(F.min_by("unit", "pos").alias("column_unit"))
    cells = (
        columns.select("table_id", "col_no", "quantity", "cells").join(by_column, ["table_id", "col_no"], "left")
        .select("table_id", "col_no", "quantity", "column_unit", F.explode("cells").alias("c"))
        .select("table_id", "c.row_no", "col_no", "quantity", "column_unit", "c.text", "c.state", "c.lo", "c.hi", F.col("c.unit").alias("spelling"))
    )
    named = cells.join(dictionary, ["quantity", "spelling"], "left")
    table = U.rows_of(spark)
    default = table.where("common").select("quantity", F.col("unit").alias("common_unit"))
    full = named.join(F.broadcast(default), "quantity").withColumn("unit", F.coalesce("unit", F.when(F.col("spelling").isNull(), F.coalesce("column_unit", "common_unit"))))
    converted = full.join(F.broadcast(table.select("quantity", "unit", "factor", "shift", "common")), ["quantity", "unit"], "left")
    lo, hi = ((F.col(x) + F.col("shift")) * F.col("factor") for x in ("lo", "hi"))
    least = F.coalesce(lo, hi)
    impossible = (F.col("quantity").isin(*NOT_NEGATIVE) & (F.coalesce(F.col("lo"), F.col("hi")) < 0)) | ((F.col("quantity") == "temperature") & (least < ABSOLUTE_ZERO_C))
    bad: Column = (F.col("state") == "bad") | ((F.col("state") == "value") & (F.col("factor").isNull() | impossible))
    return converted.select(
        "table_id", "row_no", "col_no", "quantity", "text", F.when(bad, "bad").otherwise(F.col("state")).alias("state"),
        F.when(~bad & (F.col("state") == "value"), F.col("unit")).alias("unit"), F.coalesce("common", F.lit(False)).alias("is_common"),
        F.when(~bad, lo).alias("lo"), F.when(~bad, hi).alias("hi"),
    )


def faulty_records(loaded: DataFrame, values: DataFrame) -> DataFrame:
    """(table_id, row_no, reason): each record that cannot be loaded, with the first reason that applies (quoting,
    column_count, value); distinct."""
    structure = loaded.select("table_id", F.explode("faults").alias("f")).select("table_id", "f.row_no", "f.reason")
    return structure.unionByName(values.where("state = 'bad'").select("table_id", "row_no", F.lit("value").alias("reason"))).distinct()


def sound_cells(loaded: DataFrame, values: DataFrame) -> DataFrame:
    """(table_id, row_no, header_no, header, cell): the cells of every sound record under its headers."""
    bad = values.where("state = 'bad'").select("table_id", "row_no").distinct()
    records = loaded.select("table_id", "headers", F.explode("records").alias("r")).select("table_id", "headers", "r.row_no", "r.cells").join(bad, ["table_id", "row_no"], "left_anti")
    return records.select("table_id", "row_no", "headers", F.posexplode("cells").alias("header_no", "cell")).select(
        "table_id", "row_no", "header_no", F.get("headers", F.col("header_no")).alias("header"), "cell"
    )


_LAMBDA = r"(?iu)(?:λ|lambda|теплопроводност\p{L}*|conductivit\p{L}*)"


def _own_text(column: str) -> Column:
    """What follows the name of the conductivity in a text, or a bracketed text; null without either."""
    text = F.col(column)
    after = F.regexp_extract(text, rf"(?s){_LAMBDA}(.*)$", 1)
    bracket = F.regexp_extract(text, r"\[([^\]]+)\]\)?\s*$", 1)
    return F.when(text.rlike(_LAMBDA), after).when(bracket != "", bracket)


def material_values(materials: DataFrame, catalogues: DataFrame) -> DataFrame:
    """(material_id, lambda_value, unit, is_common, lambda_common): the conductivity of every material that has one, in the
    common unit. The material's own text (name, remark, source) states the unit, else `about` of its catalogue."""
    spark = materials.sparkSession
    about = catalogues.where("about is not null").select(F.col("source").alias("code"), _own_text("about").alias("s3"))

    @F.udf("array<string>", useArrow=True)
    def spellings(own: list, catalogue: str) -> list:
        return [s for x in [*(own or []), catalogue] if x for s in U.stated_spellings(x)]

    rows = (
        materials.where("lambda_value is not null").select("material_id", "lambda_value", _own_text("name").alias("s0"), _own_text("remark").alias("s1"), _own_text("source").alias("s2"), F.regexp_extract(F.coalesce("source", F.lit("")), r"^\s*([^\s(\[]+)", 1).alias("code"))
        .join(about, "code", "left")
        .select("material_id", "lambda_value", spellings(F.array("s0", "s1", "s2"), F.col("s3")).alias("stated"))
    )
    rows = cut_lineage(rows)
    each = rows.select("material_id", F.lit("conductivity").alias("quantity"), F.posexplode("stated").alias("pos", "spelling"))
    dictionary = U.alias_dictionary(spark, each.select("quantity", "spelling"))
    found = each.join(dictionary, ["quantity", "spelling"]).groupBy("material_id").agg(F.min_by("unit", "pos").alias("unit"))
    table = U.rows_of(spark).where("quantity = 'conductivity'").select("unit", "factor", "shift", "common")
    named = rows.join(found, "material_id", "left").withColumn("unit", F.coalesce("unit", F.lit(U.common_unit("conductivity"))))
    return named.join(F.broadcast(table), "unit").select("material_id", "lambda_value", "unit", F.col("common").alias("is_common"), ((F.col("lambda_value") + F.col("shift")) * F.col("factor")).alias("lambda_common"))
