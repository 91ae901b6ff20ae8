"""Small helpers of a command line: durations, output names, guarded integers, exit codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A 32-bit integer is refused where a further digit could exceed its range, and so is a 64-bit one.
INT_MAX, LONG_MAX = 2**31 - 1, 2**63 - 1


def begins_with(text: Column, prefix: str) -> Column:
    """Whether a text begins with a prefix, whatever the text's case."""
    return F.startswith(F.lower(text), F.lit(prefix.lower()))


def switch_value(text: Column) -> Column:
    """`name` and `name+` turn a switch on, `name-` off."""
    return F.when(F.endswith(text, F.lit("-")), False).otherwise(True)


def guarded_int(text: Column, wide: bool = False) -> Column:
    """A number of digits only; null if it isn't one or too large to take another digit safely."""
    limit = (LONG_MAX if wide else INT_MAX) // 10 - 1
    value = F.when(F.regexp_like(text, F.lit(r"^[0-9]+$")), text.try_cast("decimal(38,0)"))
    fits = F.floor(value / 10) < limit
    return F.when(fits, value.cast("long" if wide else "int"))


def duration(ms: Column) -> Column:
    """`Time: ` and the two or three largest units of a number of milliseconds."""
    unit = lambda size, of=None: (ms / size).cast("long") if of is None else F.floor(ms / size).cast("long") % of
    s, m, h, d = 1000, 60_000, 3_600_000, 86_400_000
    text = (
        F.when(ms < s, F.format_string("%d millisecond(s)", ms))
        .when(ms < m, F.format_string("%d second(s), %d millisecond(s)", unit(s, 60), ms % 1000))
        .when(ms < h, F.format_string("%d minute(s), %d second(s)", unit(m, 60), unit(s, 60)))
        .when(ms < d, F.format_string("%d hour(s), %d minute(s), %d second(s)", unit(h, 24), unit(m, 60), unit(s, 60)))
        .otherwise(F.format_string("%d day(s), %d hour(s), %d minute(s)", F.floor(ms / d).cast("long"), unit(h, 24), unit(m, 60)))
    )
    return F.concat(F.lit("Time: "), text)


def output_name(name: Column, keep_extension: bool = False, rebuild: bool = False) -> Column:
    """The container's name for a file's, or the file's for a container's."""
    if rebuild:
        return F.regexp_replace(name, r"\.pcf$", "")
    if keep_extension:
        return F.concat(name, F.lit(".pcf"))
    own = F.regexp_like(name, F.lit(r"\.pcf$"))
    bare = F.regexp_replace(name, r"\.[^./]*$", "")
    return F.when(own, F.concat(name, F.lit("_pcf.pcf"))).otherwise(F.concat(bare, F.lit(".pcf")))


def error_text(code: Column, message: Column) -> Column:
    return F.concat(F.lit("\nERROR "), code.cast("string"), F.lit(": "), message)


def exit_code(code: Column) -> Column:
    """Success, and nothing to do, are 0; anything else is 1."""
    return F.when(code.isin(0, 2), 0).otherwise(1)


def percent(done: Column, total: Column) -> Column:
    return F.format_string("%.2f%%", 100.0 * done / total)
