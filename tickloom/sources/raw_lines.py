"""Lines of raw snapshot files: load what is valid, set the rest apart with the reason.

Lines are read permissively under the explicit typed schema, with quotes as ordinary characters, and the text of those that
don't fit it is retained. That read is at least as strict as the rules (no value of the schema has a quote), but for
values that it takes and the rules don't (letters in numbers, infinite and negative values, years of five digits), which are checked on
the typed row. Only the corrupt text is then classified again, by quoting, column count and cast checks; what
these accept (quoted fields, blanks around a value) is loaded after all. Everything is a projection of the line: no shuffle, and a file is
split anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOCKS = ("timestamp", "exchtime")
SIDES = [f"{what}{i}" for side, levels in (("bid", range(4, -1, -1)), ("ask", range(5))) for i in levels for what in (f"{side}px", f"{side}vol")]
COLUMNS = [*CLOCKS, *SIDES, "lastpx", "totalvol", "totalvalue", "openinterest"]
INTS = [c for c in SIDES if "vol" in c]
LONGS = ["totalvol", "openinterest"]
DOUBLES = [c for c in COLUMNS if c not in CLOCKS and c not in INTS and c not in LONGS]
NOT_NEGATIVE = {*INTS, *LONGS, "totalvalue"}
CORRUPT = "_corrupt"

CLOCK = r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?\z"
INTEGER = r"^[+-]?[0-9]+\z"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def quoted_fields(line: Column) -> Column:
    """(fine, n): whether the quoting holds, and the number of fields. A field that begins with a double quote must end with one
    right before the next comma or the line's end (doubled quotes and commas inside are its own); no other field may have one.

    The pieces between commas are folded with one bit of state (inside a quoted field), so that long lines need
    no backtracking: once pairs of quotes are taken out of what follows the opening one, the first left closes."""
    state = lambda open_, bad, n: F.struct(open_.alias("open"), bad.alias("bad"), n.alias("n"))

    def step(s: Column, piece: Column) -> Column:
        opens = ~s["open"] & piece.startswith('"')
        inside = s["open"] | opens
        rest = F.replace(F.when(opens, F.substr(piece, F.lit(2))).otherwise(piece), F.lit('""'), F.lit(""))
        at = F.locate('"', rest)
        stray = F.when(inside, (at > 0) & (at < F.length(rest))).otherwise(piece.contains('"'))
        return state(inside & (at == 0), s["bad"] | stray, s["n"] + F.when(s["open"], 0).otherwise(1))

    start = state(F.lit(False), F.lit(False), F.lit(0))
    return F.aggregate(F.split(line, ",", -1), start, step, lambda s: F.struct((~s["open"] & ~s["bad"]).alias("fine"), s["n"].alias("n")))


def trimmed(c: Column) -> Column:
    """Without blanks and tabs around it; null if nothing is left."""
    text = F.trim(c, F.lit(" \t"))
    return F.when(text != "", text)


def _clock(c: Column) -> Column:
    # Spark has microseconds: digits beyond the sixth are cut.
    return F.when(c.rlike(CLOCK), F.regexp_replace(c, r"(\.[0-9]{6})[0-9]+", "$1").try_cast("timestamp_ntz"))


def _finite(c: Column) -> Column:
    v = F.when(c.rlike(NUMBER), c.try_cast("double"))
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def _whole(c: Column, kind: str) -> Column:
    return F.when(c.rlike(INTEGER), c.try_cast(kind))


def typed(name: str, text: Column) -> Column:
    """The field's value; null if empty or not valid."""
    value = _clock(text) if name in CLOCKS else _finite(text) if name in DOUBLES else _whole(text, "int" if name in INTS else "long")
    return F.when(value >= 0, value) if name in NOT_NEGATIVE else value


def _type(c: str) -> str:
    return "timestamp_ntz" if c in CLOCKS else "double" if c in DOUBLES else "int" if c in INTS else "long"


def _fits(row: str) -> Column:
    """Whether the typed row, read without complaint, holds only values that the rules allow."""
    ok = F.col(row).isNotNull() & F.col(f"{row}.`{CORRUPT}`").isNull()
    for c in COLUMNS:
        v = F.col(f"{row}.`{c}`")
        if c in CLOCKS:
            ok = ok & (v.isNull() | v.between(F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"), F.lit("9999-12-31 23:59:59.999999").cast("timestamp_ntz")))
        elif c in DOUBLES:
            ok = ok & (v.isNull() | (F.abs(v) < F.lit(float("inf"))))
        if c in NOT_NEGATIVE:
            ok = ok & (v.isNull() | (v >= 0))
    return ok


#: Fields that the reader can hold in a row; the text of a line with more is corrupt without being read.
READABLE = 20_000
#: A separator that no line holds keeps line ends inside a line as text of its fields.
READ = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "lineSep": "\u0001", "nullValue": "", "emptyValue": ""}


def _fields(text: Column) -> Column:
    """One more than the commas."""
    return F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))) + 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, and only where the whole expression is."""
    return F.transform(F.array(value), use)[0]


def _classified(raw: Column) -> Column:
    """The retained text of a corrupt row, classified by quoting, column count and casts: reason, and the columns as their types."""
    width, fields = len(COLUMNS), ", ".join(f"`{c}` string" for c in COLUMNS)
    text = F.replace(raw, F.lit("\u0001"), F.lit("\u0002"))

    def of_values(quoting: Column, v: Column, t: Column) -> Column:
        invalid = F.lit(False)
        for c in COLUMNS:
            invalid = invalid | (v[c].isNotNull() & t[c].isNull())
        reason = F.when(~quoting["fine"], "quoting").when(quoting["n"] != width, "column_count").when(invalid, "invalid_value")
        return F.struct(reason.alias("reason"), *[t[c].alias(c) for c in COLUMNS])

    def of_fields(quoting: Column, f: Column) -> Column:
        values = F.struct(*[trimmed(f[c]).alias(c) for c in COLUMNS])
        return _let(values, lambda v: _let(F.struct(*[typed(c, v[c]).alias(c) for c in COLUMNS]), lambda t: of_values(quoting, v, t)))

    def of_quoting(q: Column) -> Column:
        read = F.from_csv(F.when(q["fine"] & (q["n"] == width), text), fields, {**READ, "quote": '"', "escape": '"'})
        return _let(read, lambda f: of_fields(q, f))

    quoted = F.when(text.contains('"'), quoted_fields(text)).otherwise(F.struct(F.lit(True).alias("fine"), _fields(text).alias("n")))
    return _let(quoted, of_quoting)


def parsed(lines: DataFrame, line: str = "line", key: tuple[str, ...] = ("line_id", "raw_file_id", "raw_row_ordinal"), ordinal: str = "raw_row_ordinal") -> DataFrame:
    """One row per line but the header lines (ordinal 0): key, raw (the line), reason (null: valid), and the typed columns.

    ``reason``: the first that holds of ``quoting``, ``column_count``, ``invalid_value``. A null line is an empty one: one
    empty field, so ``column_count``. A null ordinal is no header. Values of rows with a reason are null. Other columns
    are dropped, whatever their names; repeated lines are kept.
    """
    body = lines.where(F.col(ordinal).isNull() | (F.col(ordinal) != 0)).select(*key, F.coalesce(F.col(line), F.lit("")).alias("raw"))
    columns = ", ".join(f"`{c}` {_type(c)}" for c in COLUMNS) + f", `{CORRUPT}` string"
    options = {**READ, "quote": "", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS]"}
    body = body.withColumn("_r", F.from_csv(F.when(_fields(F.col("raw")) <= READABLE, F.col("raw")), columns, options))
    # The reader takes a blank line for a row of nulls.
    body = body.withColumn("_ok", _fits("_r") & F.col("raw").contains(",") & ~F.col("raw").rlike(r"[^0-9+\-.,:eE \t]"))
    body = _computed(body, F.when(~F.col("_ok"), _classified(F.col("raw"))).alias("_c"))
    return body.select(*key, "raw", F.col("_c.reason").alias("reason"), *[F.when(F.col("_ok"), F.col(f"_r.`{c}`")).when(F.col("_c.reason").isNull(), F.col(f"_c.`{c}`")).alias(c) for c in COLUMNS])


def _computed(df: DataFrame, *columns: Column) -> DataFrame:
    """With further columns, computed once: a generator of one row keeps a filter on them from being moved below, which
    would compute them twice."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def rejected(lines: DataFrame) -> DataFrame:
    """(line_id, reason) of the lines that cannot be loaded."""
    return parsed(lines).where(F.col("reason").isNotNull()).select("line_id", "reason")


def loaded(lines: DataFrame) -> DataFrame:
    """The typed rows of the lines that can."""
    return parsed(lines).where(F.col("reason").isNull()).drop("raw", "reason")
