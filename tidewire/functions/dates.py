"""Mixed-precision publication dates.

A publication date stays a string (``''``, ``2026-04``, ``2026-04-09`` or a full
ISO time) because its precision is part of the value.  Clock times are computed
on ``TIMESTAMP_NTZ`` so that no result depends on the session time zone.
"""

from __future__ import annotations

from tidewire.functions.sql import captures, case, constant_map, found, let, lit, sql_function
from tidewire.functions.text import group1, markdown_text, matches, replaced, squeeze, strip

ZONE = "Asia/Shanghai"
UNKNOWN_DATE = "日期未知"

# English months by their first letters, and all accepted forms.
_MONTH_ORDER = "jan feb mar apr may jun jul aug sep oct nov dec"
_MONTH = (
    r"Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|"
    r"Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
)
# The date forms found on pages, in the order they are tried.
NUMERIC_DATE = r"(?U)(?<!\d)(20\d{2})[年/-](\d{1,2})(?:[月/-](\d{1,2})日?)?"
ENGLISH_DAY = rf"(?iU)\b({_MONTH})\.?\s+(\d{{1,2}})(?:,?\s+(20\d{{2}}))?\b"
ENGLISH_MONTH = rf"(?iU)\b({_MONTH})\.?,?\s+(20\d{{2}})\b"
# Date text that is cut out of titles and descriptions.
NUMERIC_TEXT = r"(?U)\b\d{4}[年/-]\d{1,2}(?:[月/-]\d{1,2}日?)?\b"
ENGLISH_TEXT = rf"(?iU)\b(?:{_MONTH})\.?\s+\d{{1,2}}(?:,?\s+\d{{4}})?\b"
# RFC 822 zone names in hours; any other name means UTC.
ZONE_HOURS = {
    "AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5,
    "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}

_DAY_ONLY = r"^\d{4}-\d{2}-\d{2}$"
_MONTH_ONLY = r"^\d{4}-\d{2}$"
_ISO = (
    r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?"
    r"(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?$"
)
# The RFC 822 date form.
_RFC = (
    r"(?is)^\s*(?:[a-z]+\s*,\s*|[a-z]+\s+)?(\d{1,2})[\s-]+([a-z]+)[\s-]+(\d{2}|\d{4})"
    r"[\s,]+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s+([+-]\d{4}|[a-z]+))?.*$"
)


def _int(c: str) -> str:
    return f"try_cast({c} AS INT)"


def _month_number(name: str) -> str:
    """Month of an English name or abbreviation; NULL for any other word."""
    at = f"instr({lit(_MONTH_ORDER)}, lower(substring({name}, 1, 3)))"
    return case((matches(name, f"(?i)^(?:{_MONTH})$"), f"int(({at} + 3) / 4)"))


def month_length(year: str, month: str) -> str:
    leap = f"({year} % 4 = 0 AND {year} % 100 <> 0) OR {year} % 400 = 0"
    return case(
        (f"{month} IN (4, 6, 9, 11)", "30"),
        (f"{month} = 2", f"if({leap}, 29, 28)"),
        (f"{month} BETWEEN 1 AND 12", "31"),
    )


def _two(c: str) -> str:
    return f"lpad(string({c}), 2, '0')"


# --------------------------------------------------------------------------
# Dates on pages
# --------------------------------------------------------------------------


def first_date(text: str) -> str:
    """The first date in a line of plain text: ``struct<year, month, day>``.

    All NULL when there is none.  The year is NULL when the text has none; it is
    then a matter of context, see :func:`page_date`.
    """

    def parts(y: str, m: str, d: str) -> str:
        return f"named_struct('year', {y}, 'month', {m}, 'day', {d})"

    nothing = "cast(NULL AS INT)"

    def numeric(g: str) -> str:
        return parts(_int(f"{g}[0]"), _int(f"{g}[1]"), _int(f"{g}[2]"))

    def english_day(g: str) -> str:
        return parts(_int(f"{g}[2]"), _month_number(f"{g}[0]"), _int(f"{g}[1]"))

    def english_month(g: str) -> str:
        return parts(_int(f"{g}[1]"), _month_number(f"{g}[0]"), nothing)

    def first(t: str) -> str:
        none = parts(nothing, nothing, nothing)
        for pattern, groups, build in reversed(
            ((NUMERIC_DATE, 3, numeric), (ENGLISH_DAY, 3, english_day), (ENGLISH_MONTH, 2, english_month))
        ):
            some = let(captures(t, found(pattern), groups), build)
            none = case((matches(t, pattern), some), default=none)
        return none

    return let(text, first)


@sql_function
def page_date_parts(c: str) -> str:
    """The first date in a Markdown text, as :func:`first_date` gives it."""
    return first_date(markdown_text(c))


@sql_function
def page_date(parts: str, default_year: str | None = None) -> str:
    """Date text at the precision of the page; ``''`` without year, NULL when invalid."""

    def text(p: str) -> str:
        def dated(year: str) -> str:
            exists = (
                f"{p}.month BETWEEN 1 AND 12 AND"
                f" ({p}.day IS NULL OR {p}.day BETWEEN 1 AND {month_length(year, p + '.month')})"
            )
            day = f"if({p}.day IS NULL, '', concat('-', {_two(p + '.day')}))"
            return case(
                (f"{p}.month IS NULL OR {year} IS NULL", "''"),
                (f"NOT ({exists})", "NULL"),
                default=f"concat(lpad(string({year}), 4, '0'), '-', {_two(p + '.month')}, {day})",
            )

        return let(
            f"{p}.year" if default_year is None else f"coalesce({p}.year, {default_year})", dated
        )

    return let(parts, text)


@sql_function
def without_dates(c: str, published: str | None = None) -> str:
    """Cut date text (and the normalised date itself) out of a line."""
    text = replaced(replaced(c, NUMERIC_TEXT, " "), ENGLISH_TEXT, " ")
    if published is not None:
        text = let(text, lambda t: f"if({published} = '', {t}, replace({t}, {published}, ' '))")
    return squeeze(text)


# --------------------------------------------------------------------------
# Clock times
# --------------------------------------------------------------------------


def _local(utc: str) -> str:
    return f"convert_timezone('UTC', {lit(ZONE)}, {utc})"


def _shifted(ts: str, seconds: str) -> str:
    return f"{ts} - make_dt_interval(0, 0, 0, {seconds})"


def _rfc_year(y: str) -> str:
    return case(
        (f"length({y}) = 4", _int(y)),
        (f"{_int(y)} > 68", f"{_int(y)} + 1900"),
        default=f"{_int(y)} + 2000",
    )


def _rfc_parts(c: str) -> str:
    return captures(c, _RFC, 7)


def _rfc_stamp(g: str) -> str:
    """UTC time from the parts: day, month, year, hour, minute, second, zone."""

    def offset(zone: str) -> str:
        sign = f"if(startswith({zone}, '-'), -1, 1)"
        hours, minutes = _int(f"substring({zone}, 2, 2)"), _int(f"substring({zone}, 4, 2)")
        named = constant_map({n: h * 3600 for n, h in ZONE_HOURS.items()}, "string,int")
        return case(
            (matches(zone, r"^[+-]\d{4}$"), f"{sign} * ({hours} * 3600 + {minutes} * 60)"),
            default=f"coalesce(try_element_at({named}, {zone}), 0)",
        )

    second = f"coalesce({_int(f'{g}[5]')}, 0)"
    stamp = (
        f"try_make_timestamp_ntz({_rfc_year(f'{g}[2]')}, {_month_number(f'{g}[1]')}, {_int(f'{g}[0]')},"
        f" {_int(f'{g}[3]')}, {_int(f'{g}[4]')}, {second})"
    )
    return _shifted(stamp, let(f"upper({g}[6])", offset))


@sql_function
def rfc822_utc(c: str) -> str:
    """UTC clock time of an RFC 822 date, NULL when it is none.

    The weekday is not checked and a missing or unknown zone means UTC.
    """
    return let(_rfc_parts(c), _rfc_stamp)


@sql_function
def beijing_iso(utc: str) -> str:
    """``2026-08-10T12:30:00+08:00`` for a UTC clock time."""

    def text(u: str) -> str:
        def formatted(local: str) -> str:
            hours = f"hour({local}) + 24 * datediff(date({local}), date({u})) - hour({u})"
            return f"concat(date_format({local}, \"yyyy-MM-dd'T'HH:mm:ss\"), '+', {_two(hours)}, ':00')"

        return let(_local(u), formatted)

    return let(utc, text)


@sql_function
def rfc822_to_beijing(c: str) -> str:
    return beijing_iso(rfc822_utc(c))


@sql_function
def reference_year(markdown: str) -> str:
    """Year of the ``Published Time:`` header line of a page, NULL when unusable."""
    return let(
        _rfc_parts(strip(group1(markdown, r"(?dmU)^Published Time:\s*(.+)$"))),
        # The year as written, before any zone shift.
        lambda g: case((f"{_rfc_stamp(g)} IS NOT NULL", _rfc_year(f"{g}[2]"))),
    )


@sql_function
def iso_utc(c: str) -> str:
    """UTC clock time of an ISO 8601 time; no zone means UTC; NULL when invalid."""

    def offset(zone: str) -> str:
        digits = replaced(zone, "[^0-9]", "")
        piece = lambda n: f"coalesce({_int(f'substring({digits}, {n}, 2)')}, 0)"
        seconds = f"({piece(1)} * 3600 + {piece(3)} * 60 + {piece(5)})"
        return case((f"{zone} IN ('', 'Z')", "0"), default=f"if(startswith({zone}, '-'), -{seconds}, {seconds})")

    def stamp(g: str) -> str:
        part = lambda n: _int(f"{g}[{n}]")
        time = (
            f"try_make_timestamp_ntz({part(0)}, {part(1)}, {part(2)}, {part(3)},"
            f" coalesce({part(4)}, 0), coalesce({part(5)}, 0))"
        )
        return case((f"{part(3)} < 24", _shifted(time, let(f"{g}[7]", offset))))

    return let(captures(c, _ISO, 8), stamp)


@sql_function
def display_time(c: str) -> str:
    """How a publication date is shown: its own precision, times in Beijing time."""
    return let(
        strip(c),
        lambda t: case(
            (f"{t} = ''", lit(UNKNOWN_DATE)),
            (f"{matches(t, _MONTH_ONLY)} OR {matches(t, _DAY_ONLY)}", t),
            default=f"coalesce(date_format({_local(iso_utc(t))}, 'yyyy-MM-dd HH:mm:ss'), {t})",
        ),
    )


@sql_function
def date_bound(c: str) -> str:
    """Latest Beijing day an item can be from; NULL when the text is no date."""

    def bound(t: str) -> str:
        last = month_length(_int(f"substring({t}, 1, 4)"), _int(f"substring({t}, 6, 2)"))
        return case(
            (matches(t, _MONTH_ONLY), f"try_to_date(concat({t}, '-', string({last})), 'yyyy-MM-dd')"),
            (matches(t, _DAY_ONLY), f"try_to_date({t}, 'yyyy-MM-dd')"),
            default=f"date({_local(iso_utc(t))})",
        )

    return let(strip(c), bound)


@sql_function
def precision(c: str) -> str:
    """``none``, ``month``, ``day``, ``second`` or ``text``."""
    return let(
        strip(c),
        lambda t: case(
            (f"{t} = ''", "'none'"),
            (matches(t, _MONTH_ONLY), "'month'"),
            (matches(t, _DAY_ONLY), "'day'"),
            (f"{iso_utc(t)} IS NOT NULL", "'second'"),
            default="'text'",
        ),
    )
