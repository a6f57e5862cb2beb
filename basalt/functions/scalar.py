"""Scalar functions of the dialect as Spark SQL templates.

Each entry takes the arguments as (sql, type) pairs, with types int, real, text, blob, bool, ts,
null or any, and returns such a pair. NULL, zero and overflow rules live here and nowhere else.
"""

from __future__ import annotations

import re

from .formats import DIRECTIVE

Arg = tuple[str, str]


class FunctionError(ValueError):
    """A function's arguments do not fit."""


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_of(a: Arg) -> str:
    sql, kind = a
    if kind == "text":
        return sql
    if kind == "bool":
        return f"CAST(CAST({sql} AS BIGINT) AS STRING)"
    return f"CAST({sql} AS STRING)"


_PREFIX = r"'^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?)'"


def real_of(a: Arg) -> str:
    """The number that a value starts with, 0 if none; NULL stays NULL."""
    sql, kind = a
    if kind == "real":
        return sql
    if kind in ("text", "blob", "any"):
        return f"CASE WHEN {sql} IS NULL THEN NULL ELSE coalesce(try_cast(nullif(regexp_extract(CAST({sql} AS STRING), {_PREFIX}, 1), '') AS DOUBLE), 0D) END"
    return f"CAST({sql} AS DOUBLE)"


def int_of(a: Arg) -> str:
    sql, kind = a
    if kind == "int":
        return sql
    if kind in ("bool", "real", "null"):
        return f"CAST({sql} AS BIGINT)"
    return rf"CASE WHEN {sql} IS NULL THEN NULL ELSE coalesce(try_cast(nullif(regexp_extract(CAST({sql} AS STRING), '^\\s*([+-]?\\d+)', 1), '') AS BIGINT), 0L) END"


def number_of(a: Arg) -> Arg:
    if a[1] in ("int", "real"):
        return a
    if a[1] in ("bool", "null"):
        return int_of(a), "int"
    return real_of(a), "real"


def small(a: Arg) -> str:
    """An INT for Spark functions that take one."""
    return f"CAST({int_of(a)} AS INT)"


# -- strings ------------------------------------------------------------------
def _substr(args: list[Arg]) -> Arg:
    """Start 1 is the first character, a negative start counts from the end, 0 stands before the
    first; a negative length takes the characters before the start."""
    s, p = text_of(args[0]), small(args[1])
    if len(args) == 2:
        return f"CASE WHEN {p} = 0 THEN {s} WHEN {p} < 0 AND -{p} > char_length({s}) THEN {s} ELSE substring({s}, {p}) END", "text"
    n = small(args[2])
    first = f"(CASE WHEN {p} < 0 THEN char_length({s}) + {p} + 1 ELSE {p} END)"
    lo = f"(CASE WHEN {n} < 0 THEN {first} + {n} ELSE {first} END)"
    hi = f"(CASE WHEN {n} < 0 THEN {first} ELSE {first} + {n} END)"
    return f"substring({s}, greatest({lo}, 1), greatest({hi} - greatest({lo}, 1), 0))", "text"


def _trim(name: str):
    def build(args: list[Arg]) -> Arg:
        chars = text_of(args[1]) if len(args) > 1 else "' '"
        side = {"TRIM": "BOTH", "LTRIM": "LEADING", "RTRIM": "TRAILING"}[name]
        return f"trim({side} {chars} FROM {text_of(args[0])})", "text"

    return build


def _hex(args: list[Arg]) -> Arg:
    return f"hex({args[0][0] if args[0][1] in ('text', 'blob') else text_of(args[0])})", "text"


def _char(args: list[Arg]) -> Arg:
    one = [f"decode(unhex(lpad(hex({int_of(a)}), 8, '0')), 'UTF-32')" for a in args]
    return (f"concat({', '.join(one)})" if one else "''"), "text"


def _quote(args: list[Arg]) -> Arg:
    sql, kind = args[0]
    if kind in ("int", "real", "bool", "null"):
        return f"coalesce({text_of(args[0])}, 'NULL')", "text"
    if kind == "blob":
        return f"coalesce(concat('X\\'', hex({sql}), '\\''), 'NULL')", "text"
    return f"coalesce(concat('\\'', replace({text_of(args[0])}, '\\'', '\\'\\''), '\\''), 'NULL')", "text"


def _printf(args: list[Arg]) -> Arg:
    """printf/format; %d %i %u %f %e %g %s %q %x %X %o %c %%. A literal format becomes an expression, any other one goes row by row."""
    fmt = _literal(args[0])
    if fmt is None:
        return f"basalt_printf({text_of(args[0])}, CAST(array({', '.join(map(text_of, args[1:]))}) AS ARRAY<STRING>))", "text"
    out, used, at, values = "", 1, 0, []
    for d in DIRECTIVE.finditer(fmt):
        out += fmt[at : d.start()].replace("%", "%%")
        at = d.end()
        conv, flags, width, prec = d["conv"], d["flags"], d["width"], d["prec"]
        if conv == "%":
            out += "%%"
            continue
        a = args[used] if used < len(args) else ("NULL", "null")
        used += 1
        if conv in "diu":
            out += f"%{flags}{width}d"
            values.append(f"coalesce({int_of(a)}, 0L)")
        elif conv in "fFeEgG":
            if conv in "gG":
                values.append(f"coalesce({_general(real_of(a), int(prec or 6))}, '0')")
                out += f"%{flags.replace('0', '').replace('+', '')}{width}s"
            else:
                out += f"%{flags}{width}.{prec or 6}{conv.lower() if conv == 'F' else conv}"
                values.append(f"coalesce({real_of(a)}, 0D)")
        elif conv in "xXo":
            out += f"%{flags}{width}{conv}"
            values.append(f"coalesce({int_of(a)}, 0L)")
        else:
            text = f"coalesce({text_of(a)}, '')"
            if conv == "q":
                text = f"replace({text}, '\\'', '\\'\\'')"
            elif conv == "c":
                text = f"substring({text}, 1, 1)"
            elif prec:
                text = f"substring({text}, 1, {prec})"
            out += f"%{flags.replace('0', '')}{width}s"
            values.append(text)
    out += fmt[at:].replace("%", "%%")
    return f"format_string({', '.join([quote(out), *values])})", "text"


def _general(x: str, digits: int) -> str:
    """C's %g: `digits` significant digits, no trailing zeros, exponent form outside 1e-5 to 10**digits."""
    strip = lambda s: f"regexp_replace({s}, '\\\\.?0+$', '')"
    mantissa = f"format_string('%.{digits - 1}e', {x})"
    power = f"CAST(substring_index({mantissa}, 'e', -1) AS INT)"
    fixed = " ".join(f"WHEN {p} THEN {strip(f'format_string({quote(f'%.{digits - 1 - p}f')}, {x})') if digits - 1 - p > 0 else f'format_string({quote('%.0f')}, {x})'}" for p in range(-4, digits))
    return f"CASE {power} {fixed} ELSE concat({strip(f'substring_index({mantissa}, {quote('e')}, 1)')}, 'e', substring_index({mantissa}, 'e', -1)) END"


# -- numbers ------------------------------------------------------------------
def _real(sql: str):
    def build(args: list[Arg]) -> Arg:
        return sql.format(*[real_of(a) for a in args]), "real"

    return build


def _abs(args: list[Arg]) -> Arg:
    n, kind = number_of(args[0])
    return f"abs({n})", kind


def _round(args: list[Arg]) -> Arg:
    digits = small(args[1]) if len(args) > 1 else "0"
    # round() wants a literal scale: a column of scales is cut to the range and spelled out
    if re.fullmatch(r"CAST\(-?\d+L AS INT\)|\d+", digits):
        return f"round({real_of(args[0])}, {max(0, int(re.search(r'-?[0-9]+', digits)[0]))})", "real"
    arms = " ".join(f"WHEN {d} THEN round({real_of(args[0])}, {d})" for d in range(1, 16))
    return f"CASE WHEN {digits} IS NULL THEN NULL ELSE CASE least({digits}, 15) {arms} ELSE round({real_of(args[0])}, 0) END END", "real"


def _most(name: str):
    def build(args: list[Arg]) -> Arg:
        kinds = {a[1] for a in args}
        if kinds <= {"int", "bool", "null"}:
            values, kind = [int_of(a) for a in args], "int"
        elif kinds <= {"int", "real", "bool", "null"}:
            values, kind = [real_of(a) for a in args], "real"
        else:
            values, kind = [text_of(a) for a in args], "text"
        missing = " OR ".join(f"{v} IS NULL" for v in values)
        return f"CASE WHEN {missing} THEN NULL ELSE {name}({', '.join(values)}) END", kind

    return build


def united(args: list[Arg]) -> tuple[list[str], str]:
    """Values of one type for CASE, COALESCE and the like: numbers stay numbers, a mix with text is text."""
    kinds = {a[1] for a in args} - {"null"}
    if not kinds:
        return [a[0] for a in args], "null"
    if len(kinds) == 1 and kinds != {"bool"}:
        return [a[0] for a in args], kinds.pop()
    if kinds <= {"int", "bool"}:
        return [int_of(a) if a[1] != "null" else a[0] for a in args], "int"
    if kinds <= {"int", "bool", "real"}:
        return [real_of(a) if a[1] != "null" else a[0] for a in args], "real"
    return [text_of(a) if a[1] != "null" else a[0] for a in args], "text"


def _coalesce(args: list[Arg]) -> Arg:
    values, kind = united(args)
    return f"coalesce({', '.join(values)})", kind


def _nullif(args: list[Arg]) -> Arg:
    values, _ = united(args)
    return f"CASE WHEN {values[0]} = {values[1]} THEN NULL ELSE {args[0][0]} END", args[0][1]


def _typeof(args: list[Arg]) -> Arg:
    name = {"int": "integer", "bool": "integer", "real": "real", "blob": "blob", "null": "null"}.get(args[0][1], "text")
    return f"CASE WHEN {args[0][0]} IS NULL THEN 'null' ELSE '{name}' END", "text"


def cast(a: Arg, declared: str) -> Arg:
    """CAST by the affinity of the declared type's name."""
    t = declared.upper()
    if "INT" in t or "BOOL" in t:
        return int_of(a) if a[1] != "real" else f"CAST({a[0]} AS BIGINT)", "int"
    if any(w in t for w in ("CHAR", "CLOB", "TEXT", "STRING")):
        return text_of(a), "text"
    if "BLOB" in t or not t:
        return f"CAST({text_of(a) if a[1] != 'blob' else a[0]} AS BINARY)", "blob"
    if any(w in t for w in ("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL")):
        return real_of(a), "real"
    if any(w in t for w in ("DATE", "TIME")):
        return (int_of(a), "int") if a[1] == "text" else number_of(a)
    return number_of(a)


# -- date and time --------------------------------------------------------------
def moment(a: Arg) -> str:
    """A TIMESTAMP_NTZ of a time value: ISO text, 'now', a Julian day number or a native timestamp; NULL if neither."""
    sql, kind = a
    if kind == "ts":
        return f"CAST({sql} AS TIMESTAMP_NTZ)"
    if sql.lower() == "'now'":
        return "CAST(current_timestamp() AS TIMESTAMP_NTZ)"
    if kind in ("int", "real"):
        return f"CAST(timestamp_micros(CAST(round(({real_of(a)} - 2440587.5D) * 86400000D) AS BIGINT) * 1000) AS TIMESTAMP_NTZ)"
    t = f"trim({text_of(a)})"
    return rf"CASE WHEN {t} RLIKE '^\\d{{2}}:\\d{{2}}' THEN try_cast(concat('2000-01-01 ', {t}) AS TIMESTAMP_NTZ) WHEN {t} RLIKE '^\\d{{4}}-\\d{{2}}-\\d{{2}}' THEN try_cast({t} AS TIMESTAMP_NTZ) END"


_STEP = re.compile(r"([+-]?\d+(?:\.\d+)?)\s*(second|minute|hour|day|month|year)s?")
_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def modified(t: str, modifier: str) -> str:
    """A time after one modifier. Months count on from the first of the month, so the 31st may pass into the next."""
    word = modifier.strip().lower()
    day = f"CAST({t} AS DATE)"
    clock = f"({t} - CAST({day} AS TIMESTAMP_NTZ))"
    if m := _STEP.fullmatch(word):
        n, unit = float(m[1]), m[2]
        if unit in _SECONDS:
            return f"({t} + make_dt_interval(0, 0, 0, {n * _SECONDS[unit]:.6f}))"
        months = int(n) * (12 if unit == "year" else 1)
        return f"(CAST(date_add(add_months(trunc({day}, 'MM'), {months}), day({day}) - 1) AS TIMESTAMP_NTZ) + {clock})"
    if word == "start of day":
        return f"CAST({day} AS TIMESTAMP_NTZ)"
    if word in ("start of month", "start of year"):
        return f"CAST(trunc({day}, '{'MM' if word.endswith('month') else 'YEAR'}') AS TIMESTAMP_NTZ)"
    if m := re.fullmatch(r"weekday ([0-6])", word):
        return f"({t} + make_dt_interval(pmod({m[1]} + 1 - dayofweek({day}), 7)))"
    if word in ("localtime", "utc", "auto", "subsec"):
        return t  # sessions run in UTC
    raise FunctionError(f"unknown modifier {modifier!r}")


def modified_by(t: str, a: Arg) -> str:
    """A time after a modifier that is known for each row only; NULL if it is none."""
    word, pattern = f"lower(trim({text_of(a)}))", r"'^([+-]?[0-9]+(?:\\.[0-9]+)?)[ ]*(second|minute|hour|day|month|year)s?$'"
    n, unit = f"CAST(nullif(regexp_extract({word}, {pattern}, 1), '') AS DOUBLE)", f"regexp_extract({word}, {pattern}, 2)"
    day = f"CAST({t} AS DATE)"
    seconds = f"CAST({n} * CASE {unit} {' '.join(f'WHEN {quote(u)} THEN {k}' for u, k in _SECONDS.items())} END AS DECIMAL(18,6))"
    months = f"CAST({n} AS INT) * CASE {unit} WHEN 'year' THEN 12 ELSE 1 END"
    whole = "".join(f" WHEN {word} = {quote(w)} THEN {modified(t, w)}" for w in ("start of day", "start of month", "start of year", "localtime", "utc", *(f"weekday {k}" for k in range(7))))
    return (
        f"CASE WHEN {unit} IN ('second', 'minute', 'hour', 'day') THEN {t} + make_dt_interval(0, 0, 0, {seconds})"
        f" WHEN {unit} IN ('month', 'year') THEN CAST(date_add(add_months(trunc({day}, 'MM'), {months}), day({day}) - 1) AS TIMESTAMP_NTZ) + ({t} - CAST({day} AS TIMESTAMP_NTZ)){whole} END"
    )


def _literal(a: Arg) -> str | None:
    """The text of a literal; None for any other expression."""
    m = re.fullmatch(r"'((?:[^'\\]|\\.)*)'", a[0])
    return re.sub(r"\\(.)", r"\1", m.group(1)) if m else None


def _moment(args: list[Arg]) -> str:
    args = args or [("'now'", "text")]
    steps = args[1:]
    if steps and (_literal(steps[0]) or "").lower() == "unixepoch":
        t = f"CAST(timestamp_micros(CAST({real_of(args[0])} * 1000000D AS BIGINT)) AS TIMESTAMP_NTZ)"
        steps = steps[1:]
    else:
        t = moment(args[0])
    for a in steps:
        word = _literal(a)
        t = modified_by(t, a) if word is None else modified(t, word)
    return t


def _julian(t: str) -> str:
    return f"(unix_micros(CAST({t} AS TIMESTAMP)) / 86400000000D + 2440587.5D)"


def _strftime(args: list[Arg]) -> Arg:
    fmt, t = _literal(args[0]), _moment(args[1:])
    d = f"CAST({t} AS DATE)"
    part = {
        "Y": f"date_format({t}, 'yyyy')", "m": f"date_format({t}, 'MM')", "d": f"date_format({t}, 'dd')", "H": f"date_format({t}, 'HH')", "M": f"date_format({t}, 'mm')", "S": f"date_format({t}, 'ss')",
        "f": f"date_format({t}, 'ss.SSS')", "j": f"lpad(CAST(dayofyear({d}) AS STRING), 3, '0')", "w": f"CAST(dayofweek({d}) - 1 AS STRING)", "u": f"CAST(pmod(dayofweek({d}) - 2, 7) + 1 AS STRING)", "s": f"CAST(unix_seconds(CAST({t} AS TIMESTAMP)) AS STRING)",
        "J": f"CAST({_julian(t)} AS STRING)", "W": f"lpad(CAST((dayofyear({d}) + 6 - pmod(dayofweek({d}) - 2, 7)) DIV 7 AS STRING), 2, '0')", "F": f"date_format({t}, 'yyyy-MM-dd')", "T": f"date_format({t}, 'HH:mm:ss')", "R": f"date_format({t}, 'HH:mm')", "e": f"lpad(CAST(day({d}) AS STRING), 2, ' ')",
    }
    if fmt is None:  # a format of each row: specifiers are replaced one after another, an unknown one gives NULL
        made = f"replace({text_of(args[0])}, '%%', '\u0001')"
        for letter, value in part.items():
            made = f"replace({made}, '%{letter}', {value})"
        return f"CASE WHEN NOT contains({made}, '%') THEN replace({made}, '\u0001', '%') END", "text"
    out, at = [], 0
    for m in re.finditer(r"%(.)", fmt):
        if m.start() > at:
            out.append(quote(fmt[at : m.start()]))
        if m[1] == "%":
            out.append("'%'")
        elif m[1] in part:
            out.append(part[m[1]])
        else:
            raise FunctionError(f"unknown specifier %{m[1]}")
        at = m.end()
    if at < len(fmt):
        out.append(quote(fmt[at:]))
    return f"concat({', '.join(out) or quote('')})", "text"


def _format(pattern: str):
    return lambda args: (f"date_format({_moment(args)}, '{pattern}')", "text")


# -- JSON -----------------------------------------------------------------------
def json_text(a: Arg) -> str:
    """A value's JSON: text is quoted, numbers and NULL are not."""
    sql, kind = a
    if kind == "json":
        return f"coalesce({sql}, 'null')"
    if kind == "text":
        return f"coalesce(concat('\"', replace(replace(replace(replace(replace({sql}, '\\\\', '\\\\\\\\'), '\"', '\\\\\"'), '\\n', '\\\\n'), '\\t', '\\\\t'), '\\r', '\\\\r'), '\"'), 'null')"
    return f"coalesce({text_of(a)}, 'null')"


def _json_array(args: list[Arg]) -> Arg:
    return "concat('[', concat_ws(',', " + ", ".join(map(json_text, args)) + "), ']')" if args else "'[]'", "json"


def _json_object(args: list[Arg]) -> Arg:
    if len(args) % 2:
        raise FunctionError("json_object takes pairs")
    pairs = [f"concat({json_text((text_of(args[i]), 'text'))}, ':', {json_text(args[i + 1])})" for i in range(0, len(args), 2)]
    return "concat('{', concat_ws(',', " + ", ".join(pairs) + "), '}')" if pairs else "'{}'", "json"


def _python(name: str, kind: str, least: int = 1):
    """A JSON function that is a Python function on Arrow batches: arguments as text, values as JSON."""

    def build(args: list[Arg]) -> Arg:
        if len(args) < least:
            raise FunctionError(f"{name} takes at least {least} arguments")
        first = text_of(args[0]) if args[0][1] != "json" else args[0][0]
        rest = [text_of(a) if i % 2 == 0 else json_text(a) for i, a in enumerate(args[1:])]
        return f"basalt_{name}({first}, array({', '.join(rest) if rest else ''}))" if rest else f"basalt_{name}({first}, CAST(array() AS ARRAY<STRING>))", kind

    return build


def _json_extract(args: list[Arg]) -> Arg:
    if len(args) == 2 and re.fullmatch(r"'\$(?:\.[A-Za-z_]\w*|\[\d+\])+'", args[1][0]):
        return f"get_json_object({text_of(args[0])}, {args[1][0]})", "text"
    return f"basalt_json_extract({text_of(args[0])}, array({', '.join(text_of(a) for a in args[1:])}))", "text"


def _same(kind: str, sql: str):
    return lambda args: (sql.format(*[a[0] for a in args]), kind)


def _text1(sql: str, kind: str = "text"):
    return lambda args: (sql.format(*[text_of(a) for a in args]), kind)


FUNCTIONS = {
    "LENGTH": lambda a: (f"octet_length({a[0][0]})" if a[0][1] == "blob" else f"char_length({text_of(a[0])})", "int"),
    "CHAR_LENGTH": _text1("char_length({0})", "int"), "CHARACTER_LENGTH": _text1("char_length({0})", "int"),
    "OCTET_LENGTH": lambda a: (f"octet_length({a[0][0] if a[0][1] == 'blob' else text_of(a[0])})", "int"),
    "UPPER": _text1("upper({0})"), "LOWER": _text1("lower({0})"), "REVERSE": _text1("reverse({0})"),
    "REPEAT": lambda a: (f"repeat({text_of(a[0])}, {small(a[1])})", "text"),
    "TRIM": _trim("TRIM"), "LTRIM": _trim("LTRIM"), "RTRIM": _trim("RTRIM"),
    "SUBSTR": _substr, "SUBSTRING": _substr,
    "REPLACE": lambda a: (f"CASE WHEN {text_of(a[1])} = '' THEN {text_of(a[0])} ELSE replace({text_of(a[0])}, {text_of(a[1])}, {text_of(a[2])}) END", "text"),
    "INSTR": _text1("instr({0}, {1})", "int"), "POSITION": _text1("instr({0}, {1})", "int"),
    "HEX": _hex, "UNHEX": _text1("CASE WHEN {0} RLIKE '^([0-9A-Fa-f]{{2}})*$' THEN unhex({0}) END", "blob"),
    "CHAR": _char, "UNICODE": _text1("CASE WHEN {0} <> '' THEN ascii({0}) END", "int"), "QUOTE": _quote, "PRINTF": _printf, "FORMAT": _printf,
    "ZEROBLOB": lambda a: (f"unhex(repeat('00', {small(a[0])}))", "blob"),
    "RANDOMBLOB": lambda a: (f"unhex(substring(repeat(replace(uuid(), '-', ''), CAST({small(a[0])} DIV 16 + 1 AS INT)), 1, 2 * {small(a[0])}))", "blob"),
    "CONCAT": lambda a: ("concat(" + ", ".join(f"coalesce({text_of(x)}, '')" for x in a) + ")", "text"),
    "CONCAT_WS": lambda a: ("concat_ws(" + ", ".join(map(text_of, a)) + ")", "text"),
    "ABS": _abs, "ROUND": _round,
    "CEIL": _real("CAST(ceil({0}) AS DOUBLE)"), "CEILING": _real("CAST(ceil({0}) AS DOUBLE)"), "FLOOR": _real("CAST(floor({0}) AS DOUBLE)"), "TRUNC": _real("CAST(CAST({0} AS BIGINT) AS DOUBLE)"),
    "SQRT": _real("CASE WHEN {0} >= 0 THEN sqrt({0}) END"), "POW": _real("pow({0}, {1})"), "POWER": _real("pow({0}, {1})"),
    "SIGN": lambda a: (f"CAST(signum({real_of(a[0])}) AS BIGINT)", "int"),
    "MAX": _most("greatest"), "MIN": _most("least"), "GREATEST": _most("greatest"), "LEAST": _most("least"),
    "RANDOM": lambda a: ("CAST((rand() - 0.5D) * 18446744073709549568D AS BIGINT)", "int"),
    "EXP": _real("exp({0})"), "LN": _real("CASE WHEN {0} > 0 THEN ln({0}) END"), "LOG2": _real("CASE WHEN {0} > 0 THEN log2({0}) END"), "LOG10": _real("CASE WHEN {0} > 0 THEN log10({0}) END"),
    "LOG": lambda a: (f"CASE WHEN {real_of(a[-1])} > 0 THEN {f'log({real_of(a[0])}, {real_of(a[1])})' if len(a) > 1 else f'log10({real_of(a[0])})'} END", "real"),
    "MOD": _real("({0} % nullif({1}, 0D))"), "PI": lambda a: ("pi()", "real"),
    **{f: _real(f"{f.lower()}({{0}})") for f in "SIN COS TAN ASIN ACOS ATAN SINH COSH TANH RADIANS DEGREES".split()},
    "ATAN2": _real("atan2({0}, {1})"), "DEG_TO_RAD": _real("radians({0})"), "RAD_TO_DEG": _real("degrees({0})"),
    "COALESCE": _coalesce, "IFNULL": _coalesce, "NULLIF": _nullif, "TYPEOF": _typeof,
    "ISNULL": lambda a: (f"({a[0][0]} IS NULL)", "bool"), "NOTNULL": lambda a: (f"({a[0][0]} IS NOT NULL)", "bool"),
    "LIKELY": lambda a: a[0], "UNLIKELY": lambda a: a[0], "LIKELIHOOD": lambda a: a[0], "SQLITE_VERSION": lambda a: ("'3.40.1'", "text"),
    "DATE": _format("yyyy-MM-dd"), "TIME": _format("HH:mm:ss"), "DATETIME": _format("yyyy-MM-dd HH:mm:ss"),
    "CURRENT_DATE": _format("yyyy-MM-dd"), "CURRENT_TIME": _format("HH:mm:ss"), "CURRENT_TIMESTAMP": _format("yyyy-MM-dd HH:mm:ss"),
    "JULIANDAY": lambda a: (_julian(_moment(a)), "real"), "UNIXEPOCH": lambda a: (f"unix_seconds(CAST({_moment(a)} AS TIMESTAMP))", "int"), "STRFTIME": _strftime,
    "JSON_VALID": _text1("CAST(coalesce(try_parse_json({0}) IS NOT NULL, FALSE) AS BIGINT)", "int"), "JSON_ISVALID": _text1("CAST(coalesce(try_parse_json({0}) IS NOT NULL, FALSE) AS BIGINT)", "int"),
    "JSON_EXTRACT": _json_extract, "JSON_ARRAY": _json_array, "JSON_OBJECT": _json_object, "JSON_QUOTE": lambda a: (json_text(a[0]), "json"),
    "JSON": _python("json", "json"), "JSONB": _python("json", "json"), "JSON_PRETTY": _python("json_pretty", "text"), "JSON_TYPE": _python("json_type", "text"),
    "JSON_LENGTH": _python("json_length", "int"), "JSON_ARRAY_LENGTH": _python("json_array_length", "int"), "JSON_KEYS": _python("json_keys", "json"), "JSON_PATCH": _python("json_patch", "json", 2), "JSON_REMOVE": _python("json_remove", "json", 2),
    "JSON_SET": _python("json_set", "json", 3), "JSON_INSERT": _python("json_insert", "json", 3), "JSON_REPLACE": _python("json_replace", "json", 3), "JSON_ARRAY_INSERT": _python("json_array_insert", "json", 3),
}
