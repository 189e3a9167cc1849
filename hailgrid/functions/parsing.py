"""Column expressions that turn raw CSV text into typed trip values.

All of them return NULL where the text cannot be parsed; defaults are applied
later, once it is known which column of several won. Nothing here depends on
the session time zone: times are computed as UTC epoch seconds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vendor, flag, payment and cab spellings, in matching order.
VENDOR_CODES = (("1", 1), ("2", 2))
VENDOR_NAMES = (("cmt", 1), ("vts", 2))
TRUE_FLAGS = ("1", "y")
PAYMENT_WORDS = (
    # (code, substrings, whole words)
    (1, ("crd", "cre"), ()),
    (2, ("cas", "csh"), ()),
    (3, ("nocharge",), ("no", "na", "noc")),
    (4, ("dis",), ()),
    (5, ("unk",), ()),
    (6, ("void",), ()),
)
CAB_WORDS = (("yellow", 1), ("green", 2))

_INTEGER = r"^[+-]?[0-9]+$"
_NUMBER = r"^-?(0x[0-9a-f]+|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?[dfl]?)$"
# A date-time that Spark's own cast reads the same way.
_PLAIN_TIME = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}%s[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"
# Any date-time the lenient rules accept: blanks and a minus before a number, any
# number of digits, any text after.
_PART = r"[ \t]*(-?[0-9]+)"
_LENIENT_TIME = f"(?s)^{_PART}-{_PART}-{_PART}%s{_PART}:{_PART}:{_PART}.*$"
# Seconds that a timestamp can hold on either side of 1970.
_LAST_SECOND = 9_000_000_000_000


def parse_int(text: Column) -> Column:
    """32-bit integer with an optional sign and no blanks, else NULL."""
    return F.when(text.rlike(_INTEGER), text.try_cast("int"))


def parse_double(text: Column) -> Column:
    """Double in the usual notation; blanks around it are ignored.

    The cast also reads ``inf`` and ``nan`` in any case. Without a digit, only
    the spellings ``NaN`` and ``Infinity`` count here.
    """
    return F.when(text.rlike(r"[0-9]|^\s*[+-]?(NaN|Infinity)"), text.try_cast("double"))


def lenient_epoch_seconds(text: Column, separator: str = " ") -> Column:
    """Epoch seconds of ``yyyy-MM-dd HH:mm:ss`` read leniently, else NULL.

    Single digits are fine, out-of-range parts roll over (month 13 is January
    of the next year) and text after the seconds is ignored. ``separator``
    stands between date and time.
    """
    plain = F.unix_seconds(F.concat(text, F.lit("Z")).try_cast("timestamp"))
    pattern = _LENIENT_TIME % separator
    # Matched text has colons and what it is replaced by has none, so text that stays the same is no date-time.
    parts = F.regexp_replace(text, pattern, "$1,$2,$3,$4,$5,$6")
    rolled = _let(parts, lambda p: F.when(p != text, _rolled_second(p)))
    return F.coalesce(
        F.when(text.rlike(_PLAIN_TIME % separator), plain),
        _let(rolled, lambda s: F.when(F.abs(s) <= _LAST_SECOND, s)),
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: an expression that mentions another repeats its work at each place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rolled_second(parts: Column) -> Column:
    """Epoch seconds of ``year,month,day,hour,minute,second``; a number beyond 32 bits gives NULL."""

    def second(n: Column) -> Column:
        year, month, day, hour, minute, sec = (F.get(n, F.lit(i)) for i in range(6))
        days = _let(year * 12 + (month - 1) - 2, lambda months: _epoch_day(months, day))
        # Sums of 32-bit parts fit in 64 bits.
        return days * 86400 + hour * 3600 + minute * 60 + sec

    return _let(F.transform(F.split(parts, ","), lambda n: n.try_cast("int").cast("long")), second)


def _epoch_day(months: Column, day: Column) -> Column:
    """Days since 1970 of a Gregorian date whose month and day may lie outside their ranges.

    ``months`` and years are counted from March of the year 0, so that a leap day is the last of its year.
    """
    from_march, shifted = F.floor(months / 12), F.pmod(months, F.lit(12))
    leaps = F.floor(from_march / 4) - F.floor(from_march / 100) + F.floor(from_march / 400)
    return from_march * 365 + leaps + F.floor((shifted * 153 + 2) / 5) + day - 1 - 719468


def vendor_code(text: Column) -> Column:
    """1 or 2 for the known codes and names, 0 for anything else."""
    out = F.when(F.lit(False), F.lit(0))
    for code, value in VENDOR_CODES:
        out = out.when(text == code, value)
    for name, value in VENDOR_NAMES:
        out = out.when(F.lower(text) == name, value)
    return out.when(text.isNotNull(), 0)


def flag(text: Column) -> Column:
    """True for ``1`` or ``y`` in any case, false for any other text."""
    return F.lower(text).isin(*TRUE_FLAGS)


def payment_code(text: Column) -> Column:
    """Payment code of a number or a word.

    A number that is no 32-bit integer gives NULL (nothing is written), an
    unknown word gives 0.
    """
    word = F.translate(F.lower(text), "_ ", "")
    out = F.when(word.rlike(_NUMBER), parse_int(text))
    for code, parts, words in PAYMENT_WORDS:
        hit = reduce(lambda a, b: a | b, [F.contains(word, F.lit(p)) for p in parts])
        if words:
            hit = hit | word.isin(*words)
        out = out.when(hit, code)
    return out.when(text.isNotNull(), 0)


def cab_code(file_name: Column) -> Column:
    """1 for a yellow-cab file name, 2 for a green one, else 0."""
    name = F.lower(file_name)
    out = F.when(F.lit(False), F.lit(0))
    for word, code in CAB_WORDS:
        out = out.when(F.contains(name, F.lit(word)), code)
    return out.otherwise(0)


def time_of_day(epoch_seconds: Column) -> Column:
    """Seconds since midnight (UTC) of an epoch-seconds column."""
    return F.pmod(epoch_seconds, F.lit(86400)).cast("long")
