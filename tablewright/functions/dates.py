"""Date detection and conversion expressions.

Nothing here raises on bad text, and a bare cast is never used for detection
because ``cast('2024' as timestamp)`` succeeds.

A text is read by its form.  Month names become numbers, one pattern of all forms brings
the parts to ISO order in a single replacement, and only what it matched is cast.  The
only open question, whether ``03/04/2024`` names the day or the month first, is one of
the column: dates with a part above 12 tell, and ``date_orders`` counts them.  Where
none tells, the separator does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ways to write a date that are read, outer blanks and case aside.
#   2024-01-05  2024/1/5  2024.01.05  20240105
#   01/05/2024  01/05/24     month first, unless the column or a part above 12 says otherwise
#   05-01-2024  05.01.2024   day first, unless the column or a part above 12 says otherwise
#   Jan 5, 2024  January 5 2024  5 January 2024  05-Jan-2024  2024-Jan-05
#   a weekday before it: Fri, 5 Jan 2024
#   a clock behind it: 2024-01-05 10:00  2024-01-05T10:00:00.5  1/5/2024 9:30 PM
#   a zone behind that: 2024-01-05T10:00Z  10:00+05:30  10:00 +0530  10:00 UTC
MONTH_FIRST, DAY_FIRST, BY_SEPARATOR, BY_COLUMN = "month first", "day first", "by separator", "by column"
DEFAULT_DATE_FORMATS = BY_COLUMN

_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_SHORT = "".join(m[:3] for m in _MONTHS)


def _names(names, more=()) -> str:
    """Full names and their first three letters."""
    return "(?:" + "|".join([*more, *(n[:3] + (f"(?:{n[3:]})?" if n[3:] else "") for n in names)]) + ")"


_MONTH = rf"(?<![a-z])({_names(_MONTHS, ('sept',))})(?![a-z])\.?"
#: No date is longer.
_LONGEST = 64
#: No date has fewer digits.
_DIGITS = "(?:[0-9][^0-9]*+){4}"


def _form(order: str) -> tuple[str, str]:
    """The pattern of all forms, and the replacement ``#ap,zone,y-m-d clock``; month names
    stand in the text as ``m1m`` to ``m12m``."""
    count, groups = 0, {"y": [], "m": [], "d": []}

    def part(role: str | None, pattern: str) -> str:
        nonlocal count
        count += 1
        if role:
            groups[role].append(count)
        return f"({pattern})"

    def numeric(first: str, separators: str) -> str:
        """Day and month, ``first`` first, or the other way where its number is too large."""
        ranges, out = {"m": "0?[1-9]|1[0-2]", "d": "0?[1-9]|[12][0-9]|3[01]"}, []
        for a, b in (("m", "d"), ("d", "m")) if first == "m" else (("d", "m"), ("m", "d")):
            start = part(a, ranges[a]) + part(None, f"[{separators}]")
            out.append(start + f"(?:{part(b, ranges[b])}\\{count - 1}{part('y', '[0-9]{4}|[0-9]{2}')})")
        return "|".join(out)

    forms = [
        part("y", "[0-9]{4}") + part(None, "[-/.]") + part("m", "[0-9]{1,2}") + f"\\{count - 1}" + part("d", "[0-9]{1,2}"),
        part("y", "[0-9]{4}") + part("m", "[0-9]{2}") + part("d", "[0-9]{2}"),
        numeric("d" if order == DAY_FIRST else "m", "/"),
        numeric("m" if order == MONTH_FIRST else "d", "-."),
        part("d", "[0-9]{1,2}") + "[- /.]?m" + part("m", "[0-9]{1,2}") + "m[-, /.]{0,2}" + part("y", "[0-9]{4}"),
        "m" + part("m", "[0-9]{1,2}") + "m[- .]{0,2}" + part("d", "[0-9]{1,2}") + "(?:, ?| |-)" + part("y", "[0-9]{4}"),
        part("y", "[0-9]{4}") + "[-/ .]m" + part("m", "[0-9]{1,2}") + "m[-/ .]" + part("d", "[0-9]{1,2}"),
    ]
    clock = part(None, "[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\\.[0-9]{1,9})?)?")
    at = count
    half = f"(?: ?{part(None, '[ap]')}\\.?m\\.?)?"
    zone = f"(?: ?{part(None, 'z|utc|gmt|[+-][0-9]{2}(?::?[0-9]{2})?')})?"
    pattern = f"^(?:{_names(_DAYS)},? )?(?:{'|'.join(forms)})(?:(?:[ t]|, ){clock}{half}{zone})?$"

    def each(role):
        return "".join(f"${g}" for g in groups[role])

    return pattern, f"#${at + 1},${at + 2},{each('y')}-{each('m')}-{each('d')} ${at}"


_FORMS = {order: _form(order) for order in (MONTH_FIRST, DAY_FIRST, BY_SEPARATOR)}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _plain(c) -> Column:
    return F.lower(F.trim(_col(c).cast("string")))


def _numbered(text: Column) -> Column:
    """``text`` with its month name, if any, as a number between two m."""
    def replaced(name):
        number = F.floor((F.position(F.substring(name, 1, 3), F.lit(_SHORT)) + 2) / 3).cast("string")
        return F.when(name == "", text).otherwise(F.regexp_replace(text, F.lit(_MONTH), F.concat(F.lit("m"), number, F.lit("m"))))
    return _once(F.regexp_extract(text, _MONTH, 1), replaced)


def _told(parts: Column) -> Column:
    """The time of ``#ap``, zone and ``y-m-d clock``."""
    half, zone = F.substring(parts[0], 2, 1), F.upper(parts[1])

    def stamped(body):
        century = F.when(F.substring(body, 3, 1) != "-", "").when(F.substring(body, 1, 2) < "69", "20").otherwise("19")
        seconds = F.when(F.length(F.translate(body, ":", "")) == F.length(body) - 1, ":00").otherwise("")
        told = F.when(zone == "", "").otherwise(F.concat(seconds, F.when(zone.isin("UTC", "GMT"), "Z").otherwise(zone)))
        return F.concat(century, body, told).try_cast("timestamp")

    def shifted(ts):
        hour = F.hour(ts)
        shift = F.when((half == "p") & (hour < 12), 12).when((half == "a") & (hour == 12), -12).otherwise(0)
        return F.when(half == "", ts).when(hour.between(1, 12), F.timestamp_micros(F.unix_micros(ts) + shift * 3_600_000_000))

    return _once(_once(F.trim(parts[2]), stamped), shifted)


def parse_timestamp(c, formats=DEFAULT_DATE_FORMATS) -> Column:
    """The time that a text tells, by the form it has; NULL when it tells none.  ``formats``
    is DAY_FIRST, MONTH_FIRST, BY_SEPARATOR (also what BY_COLUMN means where no column is
    seen), or a list of datetime patterns, of which the first that parses wins."""
    if formats not in (MONTH_FIRST, DAY_FIRST, BY_SEPARATOR, BY_COLUMN):
        text = F.trim(_col(c).cast("string"))
        return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
    pattern, iso = _FORMS[BY_SEPARATOR if formats == BY_COLUMN else formats]

    def read(text):
        # the plain ISO date is its own replacement in every order, so it needs no patterns
        plain = (F.length(text) == 10) & text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
        return F.when(plain, text.try_cast("timestamp")).otherwise(by_form(text))

    def by_form(text):
        told = F.regexp_replace(_numbered(text), pattern, iso)
        return F.when(~text.startswith("#") & text.rlike(_DIGITS) & (F.length(text) <= _LONGEST),
                      _once(told, lambda t: F.when(t.startswith("#"), _once(F.split(t, ","), _told))))

    return _once(_plain(c), read)


def to_epoch_seconds(c, formats=DEFAULT_DATE_FORMATS, is_text: bool = True) -> Column:
    """Seconds since 1970-01-01 as DOUBLE; independent of the session time
    zone for date-only text (calendar date * 86400 + time of day)."""
    ts = parse_timestamp(c, formats) if is_text else _col(c)

    def seconds(ts):
        day = F.unix_date(F.to_date(ts)).cast("double") * F.lit(86400.0)
        return day + (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("double")
    return _once(ts, seconds)


def order_evidence(c) -> tuple[Column, Column]:
    """Whether a text is a numeric date that can only have its day first, or its month first."""
    big, small = "(?:1[3-9]|2[0-9]|3[01])", "(?:0?[1-9]|1[0-2])"
    text = F.trim(_col(c).cast("string"))
    return tuple(text.rlike(rf"^{a}([-/.]){b}\1(?:[0-9]{{4}}|[0-9]{{2}})(?![0-9])") for a, b in ((big, small), (small, big)))


def decided(n_day_first: int | None, n_month_first: int | None) -> str:
    day, month = n_day_first or 0, n_month_first or 0
    return DAY_FIRST if day > month else MONTH_FIRST if month > day else BY_SEPARATOR


def date_grammar(df: DataFrame, cols=None) -> DataFrame:
    """(column, n_dates, n_day_first, n_month_first, date_order) of the text columns: how
    many texts are dates, how many of them tell the order, and the order; one aggregate."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    aggs = []
    for i, c in enumerate(cols):
        day, month = order_evidence(c)
        aggs += [F.count(parse_timestamp(c)).alias(f"n{i}"), F.count_if(day).alias(f"d{i}"), F.count_if(month).alias(f"m{i}")]
    row = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{k}{i}").alias(n) for k, n in (("n", "n_dates"), ("d", "n_day_first"), ("m", "n_month_first"))])
                    for i, c in enumerate(cols)])
    out = df.agg(*aggs).select(F.inline(row))
    return out.withColumn("date_order", F.when(F.col("n_day_first") > F.col("n_month_first"), DAY_FIRST).when(
        F.col("n_month_first") > F.col("n_day_first"), MONTH_FIRST).otherwise(BY_SEPARATOR))


def date_orders(df: DataFrame, cols, formats=DEFAULT_DATE_FORMATS) -> dict:
    """{column: formats to read it by}; BY_COLUMN is decided for the text columns by one
    aggregate, anything else holds for all."""
    if isinstance(formats, dict):
        return {c: formats.get(c, BY_SEPARATOR) for c in cols}
    texts = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
    if formats != BY_COLUMN or not texts or df.isStreaming:
        return dict.fromkeys(cols, formats)
    aggs = [F.count_if(e).alias(f"{k}{i}") for i, c in enumerate(texts) for k, e in zip("dm", order_evidence(c), strict=True)]
    row = df.agg(*aggs).first()
    return dict.fromkeys(cols, BY_SEPARATOR) | {c: decided(row[f"d{i}"], row[f"m{i}"]) for i, c in enumerate(texts)}


def date_signatures(df: DataFrame, cols=None) -> DataFrame:
    """(column, signature, n, n_dates): how the dates of each text column are written.
    Digits become 9 and month names b; texts that hold no date share the empty signature,
    so a column has no more signatures than its dates have forms."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    form = F.translate(F.regexp_replace(_plain("text"), _MONTH, "b"), "0123456789", "9" * 10)
    texts = df.select(*[F.col(f"`{c}`").alias(c) for c in cols]).unpivot([], cols, "column", "text").where("text IS NOT NULL")
    is_date = parse_timestamp("text").isNotNull()
    return texts.select("column", is_date.alias("is_date"), F.when(is_date, form).otherwise("").alias("signature")).groupBy("column", "signature").agg(
        F.count("*").alias("n"), F.count_if("is_date").alias("n_dates"))
