"""The filter language: ``--after`` and ``--before`` values become two instants, on the driver."""

from __future__ import annotations

import itertools
import re
from datetime import datetime, timedelta, timezone

from chronoweave.functions import tz

#: Date forms, and what may stand between their clock and a zone.
_DATE = {"%Y%m%dT": ("",), "%Y-%m-%d ": (" ",), "%Y-%m-%dT": ("", " "), "%Y/%m/%d ": (" ",), "%Y/%m/%dT": (" ",)}
_UNITS = {"w": 604800, "d": 86400, "h": 3600, "m": 60, "s": 1}
_RELATIVE = re.compile(rf"(@?)([+-])((?:\d+[wdhms])+)(?:!(\d\d)(?::?(\d\d))?(?::?(\d\d))?)?([+\-{tz.MINUS}]\d\d(?::?\d\d)?)?")
_ZONE_AT_END = re.compile(rf"(.*?\d)( ?)([+\-{tz.MINUS}]\d\d(?::?\d\d)?|[A-Za-z]+)")


def _formats(gap: str | None = None):
    """Date and time forms, generated: five dates, then no, 3 or 6 fraction digits; with a zone, those that allow the gap."""
    for (date, gaps), fraction in itertools.product(_DATE.items(), ("", ".%f")):
        if gap is None or gap in gaps:
            yield date + ("%H%M%S" if date == "%Y%m%dT" else "%H:%M:%S") + fraction


def absolute(text: str, default_tz: int, now: datetime) -> datetime | None:
    """An instant, or None if no form fits. Missing date parts come from now in the default zone."""
    zone = timezone(timedelta(seconds=default_tz))
    if re.fullmatch(r"\+\d+", text):
        return datetime.fromtimestamp(int(text), timezone.utc).astimezone(zone)
    today = now.astimezone(zone)
    for form in ("%Y%m%d", "%Y-%m-%d", "%Y/%m/%d"):
        if re.fullmatch(form.replace("%Y", r"\d{4}").replace("%m", r"\d\d").replace("%d", r"\d\d"), text):
            return _try(text, form, zone)
    for form, shape in (("%m-%d", r"\d\d-\d\d"), ("%m/%d", r"\d\d/\d\d")):
        if re.fullmatch(shape, text):
            return _try(f"{today.year}-{text}", f"%Y-{form}", zone)
    if re.fullmatch(r"\d\d:\d\d(:\d\d)?", text):
        return _try(f"{today:%Y-%m-%d} {text}", "%Y-%m-%d %H:%M" + (":%S" if len(text) == 8 else ""), zone)
    for form in _formats():
        if (found := _try(text, form, zone)) is not None:
            return found
    if tail := _ZONE_AT_END.fullmatch(text):
        try:
            size = tz.option_seconds(tail[3])
        except ValueError:
            return None
        for form in _formats(tail[2]):
            if (found := _try(tail[1], form, timezone(timedelta(seconds=size)))) is not None:
                return found
    return None


def _try(text: str, form: str, zone: timezone) -> datetime | None:
    if "%f" in form and not re.search(r"\.(\d{3}|\d{6})$", text):
        return None
    try:
        return datetime.strptime(text, form).replace(tzinfo=zone)
    except ValueError:
        return None


def _relative(found: re.Match, base: datetime) -> datetime:
    # A unit given twice counts with its last number only.
    parts = {u: int(n) for n, u in re.findall(r"(\d+)([wdhms])", found[3])}
    move = timedelta(seconds=sum(n * _UNITS[u] for u, n in parts.items()))
    at = base + move if found[2] == "+" else base - move
    if found[4]:
        at = at.replace(hour=int(found[4]), minute=int(found[5] or 0), second=int(found[6] or 0))
    if found[7]:
        at = at.replace(tzinfo=timezone(timedelta(seconds=tz.numeric_seconds(found[7]))))
    return at


def resolve_window(after: str | None, before: str | None, default_tz: str = "+00:00", now: datetime | None = None):
    """(after, before) as aware datetimes or None; both ends belong to the window.

    A value that begins with ``@`` counts from the other one; both at once, an unknown form, or an
    ``after`` later than ``before`` raise ValueError.
    """
    size = tz.option_seconds(default_tz)
    now = (now or datetime.now(timezone.utc)).replace(microsecond=0)
    local = now.astimezone(timezone(timedelta(seconds=size)))
    given = {"after": after, "before": before}
    moves = {k: _RELATIVE.fullmatch(v) if v is not None else None for k, v in given.items()}
    if all(m and m[1] for m in moves.values()):
        raise ValueError("after and before cannot both be relative to each other")
    first, second = ("before", "after") if moves["after"] and moves["after"][1] else ("after", "before")
    done: dict[str, datetime | None] = {first: None, second: None}
    for key, other in ((first, second), (second, first)):
        if given[key] is None:
            continue
        if moves[key]:
            base = done[other] if moves[key][1] else local
            if base is None:
                raise ValueError(f"{given[key]!r} needs the other end")
            done[key] = _relative(moves[key], base)
        else:
            done[key] = absolute(given[key], size, now)
            if done[key] is None:
                raise ValueError(f"not a datetime: {given[key]!r}")
    if done["after"] and done["before"] and done["after"] > done["before"]:
        raise ValueError("after is later than before")
    return done["after"], done["before"]


def nanoseconds(at: datetime) -> int:
    return round((at - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1)) * 1000
