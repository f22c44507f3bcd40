"""Datetime recognition: families of shapes, each one regex, evaluated inside the JVM.

A family is a template of tokens between two guards. Fraction and zone are optional parts of every family, with
the longer zone forms tried first, so one regex stands for all combinations. Recognition goes in three steps:
the first family whose regex is found in a line gives the matched text; that short text is rewritten to its
fields in one canonical order; the fields become an instant. The same regexes run on the driver for
the heads of files, so they keep to what Java and Python read alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import tz

#: Separates the canonical fields; it is removed from lines before matching.
SEP = "\u0001"
FIELDS = ["Y", "y", "m", "b", "d", "H", "M", "S", "f", "z", "e", "u"]
#: Lines shorter than this hold no datetime; a datetime lies within this many characters, or more in JSON lines.
SHORTEST, REACH, JSON_REACH = 8, 500, 2100
#: Stands for the year until it is inferred; a leap year, so that February 29 parses.
DUMMY_YEAR = 1972

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"


def _any_of(names: list[str]) -> str:
    """A regex for one of the names, shared beginnings drawn together, the longest first."""
    ends, rest = "" in names, {}
    for n in names:
        if n:
            rest.setdefault(n[0], []).append(n[1:])
    parts = [re.escape(c) + _any_of(tails) for c, tails in sorted(rest.items())]
    if not parts:
        return ""
    body = parts[0] if len(parts) == 1 and not ends else f"(?:{'|'.join(parts)})"
    return f"(?:{body})?" if ends else body


_NAMES = _any_of([n for name in tz.NAMES for n in (name, name.lower())])
_ZONE = rf"[+\-{tz.MINUS}]\d\d:\d\d(?!\d)|[+\-{tz.MINUS}]\d{{4}}(?!\d)|[+\-{tz.MINUS}]\d\d(?![\d:])|{_NAMES}(?![A-Za-z0-9])"
_TOKENS = {
    "Y": r"([12]\d{3})",
    "y": r"(\d\d)",
    "m": r"(0[1-9]|1[0-2])",
    "n": r"(0?[1-9]|1[0-2])",
    "b": rf"((?i:{_MONTH}))\.?",
    "d": r"(0[1-9]|[12]\d|3[01]| ?[1-9])",
    "p": r"(0[1-9]|[12]\d|3[01])",
    "H": r"([01]\d|2[0-3])",
    "h": r"([01]\d|2[0-3]| ?\d)",
    "M": r"([0-5]\d)",
    "N": r"([0-5]\d|\d)",
    "S": r"([0-5]\d)",
    "s": r"([0-5]\d|\d)",
    "f": r"(?:[.,](\d{1,9})(?!\d))?",
    "F": r"(\d{3,9})",
    "g": r"(\d{2,9})",
    "z": rf"(?:[ \t]?({_ZONE}))?",
    "Z": rf"({_ZONE})",
    "e": r"([12]\d{9}|9\d{8})",
    "u": r"(\d{1,9})",
    "D": r"[/\-\\]",
    "T": r"[:\-.]?",
}
#: Tokens that are another one's field, and those without a group.
_ALIAS = {"n": "m", "p": "d", "h": "H", "N": "M", "s": "S", "Z": "z", "F": "f", "g": "f"}
_NO_FIELD = "DT"
_WORD_BEFORE, _LETTER_BEFORE, _DIGIT_BEFORE = r"(?<![0-9A-Za-z])", r"(?<![A-Za-z])", r"(?<!\d)"


@dataclass(frozen=True)
class Family:
    """``find`` is the guarded regex; ``core`` matches just the found text, and ``groups`` maps a field to its group."""

    id: int
    name: str
    find: str
    core: str
    groups: dict = field(hash=False, compare=False)

    @property
    def has_year(self) -> bool:
        return bool({"Y", "y", "e"} & self.groups.keys())

    @property
    def is_uptime(self) -> bool:
        return "u" in self.groups



def _family(number: int, name: str, before: str, template: str, after: str) -> Family:
    groups, parts = {}, []
    for place, part in enumerate(re.split(r"\{([A-Za-z])\}", template)):
        if place % 2 and part not in _NO_FIELD:
            groups[_ALIAS.get(part, part)] = len(groups) + 1
        parts.append(_TOKENS[part] if place % 2 else part)
    body = "".join(parts)
    return Family(number, name, before + body + after, f"^{body}$", groups)


_CLOCK = "{h}:{M}:{S}(?!\\d){f}{z}"
#: Specific shapes before general ones, with a year before without: (name, guard before, template, guard after).
_SHAPES = [
    ("compact_start", "(?:(?<=^)|(?<=^.)|(?<=^..))" + _WORD_BEFORE, "{Y}{m}{p}T{H}{M}{S}(?!\\d){f}{z}", ""),
    ("colon_fraction", _DIGIT_BEFORE, "{Y}{D}{m}{D}{d}[ T]{1,2}{H}:{M}:{S}:{F}{z}", "(?!\\d)"),
    ("iso", _WORD_BEFORE, "{Y}{D}{m}{D}{d}[ T:\\-_+]?[ ]?{h}[:\\-]?{M}[:\\-]?{S}(?!\\d){f}{z}", ""),
    ("compact", _WORD_BEFORE, "{Y}{m}{p}[ T:\\-_]?{H}{T}{M}{T}{S}(?!\\d){f}{z}", ""),
    ("loose", _WORD_BEFORE, "{Y}{D}{n}{D}{d}[ T:\\-_+]{1,2}{h}[:\\-]{N}[:\\-]{s}(?!\\d){f}{z}", ""),
    ("apache", _WORD_BEFORE, "{d}[/\\- ]{b}[/\\- ,]+{Y}[ T:\\-_]{1,2}" + _CLOCK, ""),
    ("zone_year", _LETTER_BEFORE, "{b}[ \\-/]{1,2}{d},?[ \\-:T]{1,2}{h}:{M}:{S}{f} {1,2}{Z} {1,2}{Y}", "(?!\\d)"),
    ("ctime", _LETTER_BEFORE, "{b}[ \\-/]{1,2}{d},?[ \\-:T]{1,2}{h}:{M}:{S}{f}[ \\t]{1,2}{Y}(?!\\d){z}", ""),
    ("month_day_year", _LETTER_BEFORE, "{b}[ \\-]{1,2}{d}[, \\-]{1,2}{Y}[, T:]{1,2}" + _CLOCK, ""),
    ("year_month_day", _WORD_BEFORE, "{Y}[ \\-/]{1,2}{b}[ \\-/]{1,2}{d}[ T:,]{1,2}" + _CLOCK, ""),
    ("short_year", _WORD_BEFORE, "{d}[\\-/ ]{b}[\\-/ ]{y}[ T:]" + _CLOCK, ""),
    ("us", _WORD_BEFORE, "{n}{D}{d}{D}{Y}[ T:,\\-]{1,2}{h}[:.]{N}[:.]{s}(?!\\d){f}{z}", ""),
    ("minute", "(?<=\\[)", "{Y}{D}{m}{D}{d}[ T]{H}:{M}", "(?=\\])"),
    ("compact_minute", "^", "{Y}{m}{p}[ T]?{H}{M}", "(?!\\d)"),
    ("day_month_short_year", "(?<=[\\[(<{])", "{p}{D}{m}{D}{y}[ T:\\-]{H}[:\\-]?{M}[:\\-]?{S}", "(?=[\\])>}])"),
    ("no_year", _LETTER_BEFORE, "{b}[ \\-/]{1,2}{d},?[ \\-:T]{1,2}" + _CLOCK, ""),
    ("numbers_no_year", "(?:(?<=[\\[(<{])|(?<=[\\[(<{] ))", "{n}{D}{d}[ T:\\-]{H}:{M}:{S}", "(?=[\\])>}])"),
    ("compact_no_year", _WORD_BEFORE, "{m}[\\-/]?{p}[/ T:\\-]{H}:?{M}:?{S}(?!\\d){f}", "(?![0-9A-Za-z])"),
    ("epoch_ms", "(?:(?<=[Tt]imestamp\":)|(?<=[Tt]imestamp\": )|(?<=TIMESTAMP\":)|(?<=TIMESTAMP\": ))", "\"?{e}{F}", "(?!\\d)"),
    ("epoch", "(?:^|(?<=audit\\()|(?<=[Tt]imestamp\":)|(?<=[Tt]imestamp\": )|(?<=TIMESTAMP\":)|(?<=TIMESTAMP\": ))", "\"?{e}{f}", "(?!\\d)"),
    ("uptime", "^", "\\[ *\\+?{u}[.]{g}s?\\]", ""),
]

FAMILIES = [_family(i, *shape) for i, shape in enumerate(_SHAPES, 1)]
BY_NAME = {f.name: f for f in FAMILIES}
BY_ID = {f.id: f for f in FAMILIES}


@cache
def _python(find: str) -> re.Pattern:
    return re.compile(find)


def head_of(line: str) -> str:
    """The characters of a line in which a datetime may lie."""
    return line[: JSON_REACH if line.startswith("{") else REACH]


def first_family(line: str, order: list[Family] = FAMILIES) -> Family | None:
    """The first of the families that the line holds; the same decision as :func:`recognise`, for heads of files."""
    if len(line.encode("utf-8", "replace")) < SHORTEST or not re.search("[0-9]", line):
        return None
    head = head_of(line)
    return next((f for f in order if _python(f.find).search(head)), None)


def _head(line: Column) -> Column:
    size = F.when(line.startswith("{"), JSON_REACH).otherwise(REACH)
    return F.translate(F.substring(line, F.lit(1), size), SEP, "")


def _found(head: Column, family: Family) -> Column:
    """Id and matched text, joined by SEP; null without a match."""
    return F.concat(F.lit(f"{family.id}{SEP}"), F.regexp_substr(head, F.lit(family.find)))


def recognise(line: Column, allowed: Column | None = None, families: list[Family] = FAMILIES) -> Column:
    """Id and matched text of the first family that matches; ``allowed`` may give up to two ids per row, in the order to try."""
    head = _head(line)
    if allowed is None:
        hit = F.coalesce(*[_found(head, f) for f in families])
    else:
        hit = F.coalesce(*[_one_of(F.get(allowed, F.lit(i)), lambda f: _found(head, f), families) for i in (0, 1)])
    return F.when((F.octet_length(line) >= SHORTEST) & line.rlike("[0-9]"), hit)


def _one_of(id_: Column, value, families: list[Family] = FAMILIES) -> Column:
    out = None
    for f in families:
        out = F.when(id_ == f.id, value(f)) if out is None else out.when(id_ == f.id, value(f))
    return out


def _canonical(hit: Column, families: list[Family]) -> Column:
    """The fields of a hit, then its id and text, joined by SEP."""
    text = F.substring_index(hit, SEP, -1)

    def rewritten(family: Family) -> Column:
        order = [f"${family.groups[k]}" if k in family.groups else "" for k in FIELDS]
        return F.regexp_replace(text, family.core, SEP.join(order))

    id_ = F.substring_index(hit, SEP, 1)
    return F.concat(_one_of(id_.try_cast("int"), rewritten, families), F.lit(SEP), id_, F.lit(SEP), text)


def stamped(df: DataFrame, line: Column, default_tz: Column, allowed: Column | None = None, compat_epoch: bool = False, families: list[Family] = FAMILIES) -> DataFrame:
    """``df`` with the columns of :func:`fields` for the text ``line``.

    Each step is a one-element generator: the optimiser doesn't copy its expressions into the
    filters and joins above it, so a line's regexes run once.
    """
    step = df.select("*", F.explode(F.array(recognise(line, allowed, families))).alias("_hit"))
    step = step.select("*", F.explode(F.array(F.split(_canonical(F.col("_hit"), families), SEP))).alias("_part"))
    made = fields(F.col("_part"), _head(line), default_tz, compat_epoch)
    return step.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()])))).drop("_hit", "_part")


def fields(part: Column, head: Column, default_tz: Column, compat_epoch: bool = False) -> dict[str, Column]:
    """Columns of a canonical text split at SEP; all null where it is null or names no real date.

    ``epoch_ns`` counts nanoseconds of the instant; without a year it is placed in DUMMY_YEAR, and
    an uptime counts from zero. ``compat_epoch`` relabels epoch seconds with the default offset.
    """
    at = dict(zip([*FIELDS, "id", "text"], [part.getItem(i) for i in range(len(FIELDS) + 2)]))
    month_name = F.create_map(*[F.lit(x) for i, m in enumerate(_MONTHS, 1) for x in (m, i)])
    number = lambda k: F.trim(at[k]).try_cast("int")
    short = F.when(number("y") < 70, number("y") + 2000).otherwise(number("y") + 1900)
    year = F.when(at["Y"] != "", number("Y")).when(at["y"] != "", short).otherwise(DUMMY_YEAR)
    month = F.when(at["b"] != "", F.try_element_at(month_name, F.lower(F.substring(at["b"], 1, 3)))).otherwise(number("m"))
    second = F.coalesce(number("S"), F.lit(0))
    wall = F.unix_seconds(F.try_make_timestamp(year, month, number("d"), number("H"), number("M"), second.cast("decimal(8,6)"), F.lit("UTC")))
    zone = F.coalesce(tz.seconds(at["z"]), default_tz)
    is_epoch, is_uptime = at["e"] != "", at["u"] != ""
    epoch = at["e"].try_cast("bigint") - (default_tz if compat_epoch else F.lit(0))
    whole = F.when(is_epoch, epoch).when(is_uptime, at["u"].try_cast("bigint")).otherwise(wall - zone)
    nanos = F.coalesce(F.rpad(at["f"], 9, "0").try_cast("bigint"), F.lit(0))
    begin = F.octet_length(F.call_function("substring_index", head, at["text"], F.lit(1)))
    return {
        "pattern_id": at["id"].try_cast("int"),
        "epoch_ns": whole.cast("bigint") * 1_000_000_000 + nanos,
        "tz_offset_s": zone.cast("int"),
        "has_year": (at["Y"] != "") | (at["y"] != "") | is_epoch,
        "is_uptime": is_uptime,
        "dt_beg": begin,
        "dt_end": begin + F.octet_length(at["text"]),
    }
