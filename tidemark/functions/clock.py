"""Reading written times: a raw string becomes a wall clock, zone and precision, in Arrow batches; zones are applied in the JVM."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names by number, English, German, Spanish and French, with their usual short forms.
MONTHS = {
    1: "january januar enero janvier jan ene janv jän jänner",
    2: "february februar febrero février fevrier feb févr fév febr",
    3: "march märz maerz marzo mars mar mär mrz",
    4: "april abril avril apr abr avr",
    5: "may mai mayo",
    6: "june juni junio juin jun",
    7: "july juli julio juillet jul juil",
    8: "august agosto août aout aug ago",
    9: "september septiembre setiembre septembre sep sept",
    10: "october oktober octubre octobre oct okt",
    11: "november noviembre novembre nov",
    12: "december dezember diciembre décembre decembre dec dez dic déc",
}

# Zone abbreviations and their own offsets in minutes.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "ist": 330, "sgt": 480, "hkt": 480, "jst": 540, "kst": 540, "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
    "brt": -180, "brst": -120, "art": -180, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

# Abbreviations whose sense depends on where the site is; (abbreviation, pattern of the home zone, minutes).
LOCAL_SENSES = [
    ("cst", "^Asia/(Shanghai|Chongqing|Harbin|Urumqi|Taipei|Macau)|^PRC$", 480),
    ("cst", "^America/Havana", -300),
    ("cdt", "^America/Havana", -240),
    ("ist", "^Europe/Dublin|^Eire$", 60),
    ("ist", "^Asia/(Jerusalem|Tel_Aviv)|^Israel$", 120),
    ("bst", "^Asia/Dhaka", 360),
    ("est", "^Australia/", 600),
    ("edt", "^Australia/", 660),
    ("cst", "^Australia/", 570),
    ("cdt", "^Australia/", 630),
    ("ast", "^Asia/(Riyadh|Baghdad|Kuwait|Qatar|Bahrain)", 180),
    ("pst", "^Asia/Manila", 480),
    ("gst", "^Asia/(Dubai|Muscat)", 240),
]

_MONTH = "(" + "|".join(sorted((w for v in MONTHS.values() for w in v.split()), key=len, reverse=True)) + ")"
_ABBR = "|".join(sorted(ABBREVIATIONS, key=len, reverse=True)) + "|gst"
_ZONE = rf"((?:utc|gmt)? ?[+\-−]\d{{1,2}}(?::?\d{{2}})?(?!\d)|(?:{_ABBR})(?![a-z]))"
_CLOCK = rf"(\d{{1,2}})(?::|h(?=\d))(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)? ?([ap]\.? ?m\b\.?)?(?: ?uhr)? ?\(?{_ZONE}?"
#: What may stand between a date and its clock time.
_GAP = r"^(?:t|,|\.| |-|–|\||·|@|at|um|à|às|a las|a la|on|kl)*"

_NUMBER = re.compile(r"^[^\d+\-]*?(\d{1,19})(?:\.(\d{1,9}))?[^\d]*$")
_COMPACT = re.compile(rf"(?<!\d)(\d{{4}})(\d\d)(\d\d)t(\d\d)(\d\d)(\d\d)?(?:[.,](\d+))? ?{_ZONE}?")
_YEAR_FIRST = re.compile(r"(?<!\d)(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?!\d)")
_NUMERIC = re.compile(r"(?<![\d:])(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})(?![\d:])")
_DAY_WORD = re.compile(rf"(?<!\d)(\d{{1,2}})(?:st|nd|rd|th|er|\.|º)? ?-?(?:de |of )?{_MONTH}\.?,? ?-?(?:de |del )?(\d{{4}}|\d{{2}})(?![\d:])")
_WORD_DAY = re.compile(rf"(?<![a-z]){_MONTH}\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?![\d:])")
_CLOCK_AFTER = re.compile(_GAP + _CLOCK)
_CLOCK_BEFORE = re.compile(r"(?<![\d:])" + _CLOCK + r"(?: |,|-|on|am|le|el|del)*$")
_AGO = re.compile(
    r"(?<!\d)(\d{1,6}|an?|one) ?(second|sec|minute|min|hour|hr|day|week)s? ago|vor (\d{1,6}|eine[mr]?) (sekunde|minute|stunde|tag|woche)"
    r"|hace (\d{1,6}|una?) (segundo|minuto|hora|día|dia|semana)|il y a (\d{1,6}|une?) (seconde|minute|heure|jour|semaine)"
)
_NOW = re.compile(r"\b(just now|gerade eben|à l'instant|ahora mismo)\b")

# Seconds of the units in which distances are told.
UNITS = {
    1: "second sec sekunde segundo seconde", 60: "minute min minuto", 3600: "hour hr stunde hora heure",
    86400: "day tag día dia jour", 604800: "week woche semana semaine",
}


_MONTH_NO = {w: n for n, words in MONTHS.items() for w in words.split()}
_UNIT_S = {w: n for n, words in UNITS.items() for w in words.split()}
_SENSES = [(abbr, re.compile(where), m) for abbr, where, m in LOCAL_SENSES]
_EPOCH = dt.datetime(1970, 1, 1)
_US = dt.timedelta(microseconds=1)


def offset_minutes(zone: str, home: str | None) -> int | None:
    """Minutes east of UTC of a written zone; None for a zone that can't be."""
    z = zone.replace("−", "-").replace(" ", "").replace(":", "")
    if m := re.search(r"([+-])(\d{2}|\d)(\d{2})?$", z):
        h, mi = int(m[2]), int(m[3] or 0)
        return None if h > 15 or mi > 59 else (-1 if m[1] == "-" else 1) * (h * 60 + mi)
    for abbr, where, minutes in _SENSES:
        if z == abbr and home and where.search(home):
            return minutes
    return ABBREVIATIONS.get(z)


def _date(s: str, day_first: bool) -> tuple[int, int, int, str, str] | None:
    if m := _YEAR_FIRST.search(s):
        y, mo, d = int(m[1]), int(m[3]), int(m[4])
    elif m := _DAY_WORD.search(s):
        y, mo, d = int(m[3]), _MONTH_NO[m[2]], int(m[1])
    elif m := _WORD_DAY.search(s):
        y, mo, d = int(m[3]), _MONTH_NO[m[1]], int(m[2])
    elif m := _NUMERIC.search(s):
        y, mo, d = int(m[4]), int(m[3]), int(m[1])
        if not day_first:
            mo, d = d, mo
    else:
        return None
    return y + 2000 if y < 100 else y, mo, d, s[: m.start()], s[m.end() :]


def read_clock(raw: str | None, day_first: bool, home: str | None) -> tuple[str, int, int | None] | None:
    """What ``raw`` says: ('unix', micros, None), ('ago', seconds, None), ('wall', micros of the wall clock, offset minutes or None).

    None where no time is told or what is told is impossible. Words and blanks around a time don't matter.
    """
    if not raw:
        return None
    s = " ".join(raw.lower().split())
    if m := _COMPACT.search(s):
        y, mo, d, h, mi, sec = (int(m[k] or 0) for k in range(1, 7))
        fine, half, zone = m[7], None, m[8]
    elif found := _date(s, day_first):
        y, mo, d, before, after = found
        m = _CLOCK_AFTER.match(after) or _CLOCK_BEFORE.search(before)
        if not m:
            h = mi = sec = 0
            fine = half = zone = None
        else:
            h, mi, sec, fine, half, zone = int(m[1]), int(m[2]), int(m[3] or 0), m[4], m[5], m[6]
    elif m := _AGO.search(s):
        n, unit = next((m[k], m[k + 1]) for k in (1, 3, 5, 7) if m[k])
        return "ago", (int(n) if n.isdigit() else 1) * _UNIT_S[unit], None
    elif _NOW.search(s):
        return "ago", 0, None
    elif (m := _NUMBER.match(s)) and len(m[1]) >= 9:  # shorter numbers are no Unix times of any year since 1973
        n, nine = int(m[1]), int((m[2] or "").ljust(9, "0"))
        if n < 10**11:
            return "unix", n * 1_000_000 + nine // 1_000, None
        if n < 10**14:
            return "unix", n * 1_000 + nine // 1_000_000, None
        return "unix", n if n < 10**17 else n // 1_000, None
    else:
        return None
    if half:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if half[0] == "p" else 0)
    offset = None
    if zone and (offset := offset_minutes(zone, home)) is None:
        return None
    try:
        wall = dt.datetime(y, mo, d, h, mi, sec, int((fine or "")[:6].ljust(6, "0")))
    except ValueError:
        return None
    return "wall", (wall - _EPOCH) // _US, offset


def _epoch() -> Column:
    return F.lit("1970-01-01").cast("date").cast("timestamp_ntz")


def _micro() -> Column:
    return F.expr("INTERVAL '0.000001' SECOND")


def from_micros(us: Column) -> Column:
    """TIMESTAMP_NTZ so many microseconds after 1970-01-01, whatever the session's zone."""
    return _epoch() + _micro() * us


def to_micros(ntz: Column) -> Column:
    """Microseconds from 1970-01-01 to a TIMESTAMP_NTZ, whatever the session's zone."""
    return F.call_function("div", ntz - _epoch(), _micro())


def wall_to_utc(wall: Column, zone: Column) -> Column:
    """UTC wall clock of a wall time in a zone: the earlier instant where it occurs twice, NULL where it never occurs."""
    utc = F.convert_timezone(zone, F.lit("UTC"), wall)
    return F.when(F.convert_timezone(F.lit("UTC"), zone, utc) == wall, utc)
