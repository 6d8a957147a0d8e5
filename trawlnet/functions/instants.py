"""Reading of the date-times that sites write, in many formats, precisions and languages."""

from __future__ import annotations

import re
from datetime import date, datetime, timezone
from zoneinfo import ZoneInfo

#: Month names and abbreviations of English, German, French, Spanish, Portuguese, Czech, Polish, Russian
#: and Greek, in the form used with a day.
_MONTHS = """
january february march april may june july august september october november december
jan feb mar apr may jun jul aug sep oct nov dec
januar februar märz april mai juni juli august september oktober november dezember
jän feb mär apr mai jun jul aug sept okt nov dez
janvier février mars avril mai juin juillet août septembre octobre novembre décembre
enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre
janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro
ledna února března dubna května června července srpna září října listopadu prosince
stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia
января февраля марта апреля мая июня июля августа сентября октября ноября декабря
ιανουαρίου φεβρουαρίου μαρτίου απριλίου μαΐου ιουνίου ιουλίου αυγούστου σεπτεμβρίου οκτωβρίου νοεμβρίου δεκεμβρίου
"""
MONTHS = {name: i + 1 for line in _MONTHS.strip().splitlines() for i, name in enumerate(line.split())}

_ZONE = r"(?P<zone>[zZ]|[+-]\d{1,2}(?::?\d{2})?|\(?[A-Za-z]{2,5}\)?)?(?:\[(?P<named>[A-Za-z_+\-0-9/]+)\])?"
_CLOCK = r"(?P<h>\d{1,2})(?::(?P<m>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?)"
_CLOCK_H = r"(?P<h>\d{1,2})(?:[:h.]|\s?h\s?)(?P<m>\d{2})?(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?"
_HALF = r"(?:\s*(?P<half>[aApP])\.?\s?[mM]\b\.?)?"
_LEAD = r"(?:[^\W\d_]+\.?,?\s+)?"
_JOIN = r"(?:,?\s+(?:à|um|at|a las|às|v|o|в|στις)?\s*"
_FORMS = [
    re.compile(rf"(?P<y>\d{{4}})[-/.](?P<mo>\d{{1,2}})(?:[-/.](?P<d>\d{{1,2}})(?:(?:[tT]|,?\s+){_CLOCK}{_HALF}\s*{_ZONE})?)?"),
    re.compile(rf"(?P<y>\d{{4}})(?P<mo>\d{{2}})(?P<d>\d{{2}})[tT](?P<h>\d{{2}})(?P<m>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?)?\s*{_ZONE}"),
    re.compile(rf"(?P<a>\d{{1,2}})[-/.](?P<b>\d{{1,2}})[-/.](?P<y>\d{{4}})(?:[tT]?,?\s*{_CLOCK}{_HALF}\s*{_ZONE})?"),
    re.compile(rf"{_LEAD}(?P<d>\d{{1,2}})(?:\.|st|nd|rd|th|º)?\s+(?:de\s+)?(?P<name>[^\W\d_]+)\.?,?\s+(?:de\s+)?(?P<y>\d{{4}})(?:г\.)?{_JOIN}{_CLOCK_H}(?:\s+Uhr)?{_HALF}\s*{_ZONE})?"),
    re.compile(rf"{_LEAD}(?P<name>[^\W\d_]+)\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){_JOIN}{_CLOCK_H}{_HALF}\s*{_ZONE})?"),
    re.compile(rf"(?P<y>\d{{4}})年(?P<mo>\d{{1,2}})月(?:(?P<d>\d{{1,2}})日)?(?:\s*(?P<h>\d{{1,2}})[:時](?P<m>\d{{1,2}})分?(?:[:]?(?P<s>\d{{1,2}})秒?)?)?\s*{_ZONE}"),
]
_UTC = {"z", "utc", "gmt", "ut"}
_EPOCH = date(1970, 1, 1).toordinal()
#: Digits of a time since 1970 -> microseconds a unit.
_SINCE = {9: 1_000_000, 10: 1_000_000, 13: 1_000, 16: 1}


def _days(y: int, mo: int, d: int) -> int | None:
    try:
        return date(y, mo, d).toordinal() - _EPOCH
    except ValueError:
        return None


def read_instant(raw: str | None) -> tuple[int | None, int | None, str | None]:
    """(utc, local, abbreviation) in microseconds since 1970; of utc and local at most one is there.

    `utc` where the text says the offset or counts from 1970, else `local` wall-clock time, with the zone abbreviation if
    one is written. All are None for what is no date-time, for dates and hours that don't exist, and where day and month
    could be exchanged to give another date. Absent parts are the first; digits beyond microseconds are cut.
    """
    none = (None, None, None)
    if not raw:
        return none
    text = " ".join(raw.replace("\u2212", "-").split())
    if text.isascii() and text.replace(".", "", 1).isdigit():
        whole, _, frac = text.partition(".")
        if len(whole) in _SINCE and (not frac or len(whole) <= 10):
            return int(whole) * _SINCE[len(whole)] + int((frac + "000000")[:6]), None, None
        if not frac and len(text) == 4:
            text = f"{text}-01"
        elif not frac and len(text) == 8:
            text = f"{text[:4]}-{text[4:6]}-{text[6:]}"
        else:
            return none
    for form in _FORMS:
        if hit := form.fullmatch(text):
            break
    else:
        return none
    g = hit.groupdict()
    y = int(g["y"])
    if "a" in g:
        a, b = int(g["a"]), int(g["b"])
        days = {x for x in (_days(y, a, b), _days(y, b, a)) if x is not None}
        if len(days) != 1:
            return none
        day = days.pop()
    else:
        mo = MONTHS.get(g["name"].lower()) if "name" in g else int(g["mo"])
        day = _days(y, mo, int(g["d"] or 1)) if mo else None
        if day is None:
            return none
    h, m, s = int(g["h"] or 0), int(g["m"] or 0), int(g["s"] or 0)
    if half := g.get("half"):
        if not 1 <= h <= 12:
            return none
        h = h % 12 + 12 * (half in "pP")
    if m > 59 or s > 59 or h > 24 or h == 24 and (m or s):
        return none
    local = ((day * 24 + h) * 60 + m) * 60_000_000 + s * 1_000_000 + int(((g.get("f") or "") + "000000")[:6])
    zone = (g["zone"] or "").strip("()")
    if zone[:1] in ("+", "-"):
        digits = zone[1:].replace(":", "")
        hours, minutes = int(digits[:-2] if len(digits) > 2 else digits), int(digits[-2:] if len(digits) > 2 else 0)
        if hours > 18 or minutes > 59:
            return none
        return local - (1 if zone[0] == "+" else -1) * (hours * 60 + minutes) * 60_000_000, None, None
    if zone.lower() in _UTC:
        return local, None, None
    if not zone and g["named"]:
        return _in_named(local, g["named"]), None, None
    return None, local, zone.upper() or None


def _in_named(local: int, name: str) -> int | None:
    """The one instant of a wall-clock time in an IANA zone; None for none or two."""
    try:
        zone = ZoneInfo(name)
        at = datetime.fromtimestamp(0, timezone.utc).replace(tzinfo=None) + (local // 1_000_000) * (datetime(1970, 1, 2) - datetime(1970, 1, 1)) / 86400
        fits = set()
        for fold in (0, 1):
            utc = at.replace(tzinfo=zone, fold=fold).astimezone(timezone.utc)
            if utc.astimezone(zone).replace(tzinfo=None) == at:
                fits.add(int(utc.timestamp()))
        return fits.pop() * 1_000_000 + local % 1_000_000 if len(fits) == 1 else None
    except (ValueError, OSError, KeyError, OverflowError):
        return None
