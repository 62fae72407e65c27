import datetime as dt
import random
import re

from tickloom.sources.raw_lines import CLOCKS, COLUMNS, DOUBLES, INTS, loaded, parsed, rejected

SCHEMA = "line_id long, raw_file_id string, raw_row_ordinal int, line string, reason string, totalvol string"


def split(line):
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j, text = i + 1, ""
            while True:
                k = line.find('"', j)
                if k < 0:
                    return None
                text += line[j:k]
                if line[k + 1 : k + 2] != '"':
                    break
                text, j = text + '"', k + 2
            if k + 1 < len(line) and line[k + 1] != ",":
                return None
            out.append(text)
            i = k + 1
        else:
            k = line.find(",", i)
            k = len(line) if k < 0 else k
            if '"' in line[i:k]:
                return None
            out.append(line[i:k])
            i = k
        if i >= len(line):
            return out
        i += 1


def valid(c, x):
    x = x.strip(" \t")
    if not x:
        return True
    if c in CLOCKS:
        m = re.fullmatch(r"([0-9]{4})-([0-9]{2})-([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})(\.[0-9]{1,9})?", x)
        try:
            return bool(m) and bool(dt.datetime(*map(int, m.groups()[:6])))
        except ValueError:
            return False
    if c in DOUBLES:
        return bool(re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", x)) and abs(float(x)) != float("inf") and (c != "totalvalue" or float(x) >= 0)
    return bool(re.fullmatch(r"[+-]?[0-9]+", x)) and 0 <= int(x) < 2 ** (31 if c in INTS else 63)


def reason(line):
    fields = split(line or "")
    if fields is None:
        return "quoting"
    if len(fields) != len(COLUMNS):
        return "column_count"
    return None if all(valid(c, x) for c, x in zip(COLUMNS, fields, strict=True)) else "invalid_value"


def base():
    return ["2024-01-25 09:00:00.123456789", "2024-01-25 09:00:00.5", *[str(100 + i) for i in range(20)], "101.5", "1000", "12345.5", "77"]


def mutated(rng):
    f = base()
    for _ in range(rng.randrange(0, 3)):
        i = rng.randrange(len(f))
        f[i] = rng.choice(["", " ", "\t5 ", '"7"', '"7', '7"', '"a""b"', '"1,5"', "+3", "-3", "-0", "1e3", "1e999", ".5", "5.", ".", "NaN", "inf", "0x1", "2147483648", "9223372036854775808", "1 2", "٣", "5\r", "5\n",
                           "2024-02-30 00:00:00", "2024-02-29 23:59:59.1", "2024-01-25T09:00:00", "2024-01-25 24:00:00", "2024-01-25 09:00:00.", "2024-01-25 09:00:00.1234567890", "0000-01-01 00:00:00", "\x01", "\\",
                           "-2024-01-25 09:00:00", "+12024-01-25 09:00:00", "12024-01-25 09:00:00", "2024-01-25 09:00:60", "2024-1-25 09:00:00", " 2024-01-25 09:00:00\t", "1d", "1F", "+-1", "1.5.2", "e5", "1E+2", "-", "\x00", "007", "1:2", "-9223372036854775808", "00000000000000000000005"])
    if rng.random() < 0.1:
        f = f[: rng.randrange(len(f))]
    if rng.random() < 0.1:
        f += [rng.choice(["", "1", '"'])]
    return ",".join(f)


def test_reasons_equal_a_plain_reader(spark):
    rng = random.Random(11)
    lines = [None, "", ",", '"', '""', '"' * 50_001, "," * 100_000, "x" * 100_000, ",".join(["1"] * 25) + "," + '"' + '""' * 30_000 + '"', "# comment", *[mutated(rng) for _ in range(1500)]]
    rows = [(i, "f", 1 if i else None, line, "?", "?") for i, line in enumerate(lines)] + [(99_999, "f", 0, "a header", "?", "?")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.line_id: r.reason for r in parsed(df).select("line_id", "reason").collect()}
    assert got == {i: reason(line) for i, line in enumerate(lines)}
    assert set(got.values()) == {None, "quoting", "column_count", "invalid_value"}
    assert rejected(df).count() + loaded(df).count() == len(lines)


def test_values_are_loaded(spark):
    f = base()
    f[2], f[3], f[-1], f[-2] = "1e2", " +7\t", '"9"', ""
    row = loaded(spark.createDataFrame([(1, "f", 1, ",".join(f), "", "")], SCHEMA)).collect()[0]
    assert row.bidpx4 == 100.0 and row.bidvol4 == 7 and row.openinterest == 9 and row.totalvalue is None
    assert row.timestamp == dt.datetime(2024, 1, 25, 9, 0, 0, 123456)
    assert loaded(spark.createDataFrame([], SCHEMA)).count() == 0


def test_both_reads_load_the_same_values(spark):
    """A valid line and the same one with a quoted field, which only the text read can load."""
    clocks = ["2024-01-25 09:00:00", "2024-01-25 09:00:00.1", "1999-12-31 23:59:59.123456789", "0001-01-01 00:00:00.000001"]
    numbers = ["0", "-0", "1e-7", "123456789.123456789", "1.7976931348623157e308", "+.5", "5."]
    rows, rng = [], random.Random(5)
    for i in range(60):
        f = base()
        f[0], f[2], f[-3] = rng.choice(clocks), rng.choice(numbers), str(rng.randrange(10**18))
        rows += [(2 * i, "f", 1, ",".join(f), "", ""), (2 * i + 1, "f", 1, ",".join([*f[:-1], f'"{f[-1]}"']), "", "")]
    got = {r.line_id: tuple(r)[3:] for r in loaded(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 120 and all(got[2 * i] == got[2 * i + 1] for i in range(60))
