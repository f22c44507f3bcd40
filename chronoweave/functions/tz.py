"""Fixed offsets: named zones and numeric forms. No daylight-saving rules anywhere."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone names by offset; the first line holds names that stand for several offsets.
AMBIGUOUS = "ACT AMT AST BST CDT CST ECT GST IST LHST MST SST".split()
ZONES = {
    "-12:00": "BIT IDLW",
    "-11:00": "NUT",
    "-10:00": "CKT HST SDT TAHT",
    "-09:30": "MART MIT",
    "-09:00": "AKST GAMT GIT HDT",
    "-08:00": "AKDT CIST PST",
    "-07:00": "PDT",
    "-06:00": "EAST GALT MDT",
    "-05:00": "COT CT EASST EST PET",
    "-04:00": "BOT CLT COST EDT ET FKT GYT PYT VET",
    "-03:30": "NST NT",
    "-03:00": "ADT AMST ART BRT CLST FKST GFT PMST PYST ROTT SRT UYT WGT",
    "-02:30": "NDT",
    "-02:00": "BRST FNT PMDT UYST WGST",
    "-01:00": "AZOT CVT EGT",
    "+00:00": "AZOST ZULU Z EGST GMT UT UTC WET",
    "+01:00": "CET DFT MET WAT WEST",
    "+02:00": "CAT CEST EET HAEC KALT MEST SAST WAST",
    "+03:00": "EAT EEST FET IDT IOT MSK SYOT TRT VOLT",
    "+03:30": "IRST",
    "+04:00": "AZT GET MUT RET SAMT SCT",
    "+04:30": "AFT IRDT",
    "+05:00": "AQTT HMT MAWT MVT ORAT PKT TFT TJT TMT UZT YEKT",
    "+05:30": "SLST",
    "+05:45": "NPT",
    "+06:00": "ALMT BIOT BTT KGT OMST VOST",
    "+06:30": "CCT MMT",
    "+07:00": "CXT DAVT HOVT ICT KRAT NOVT THA WIB",
    "+08:00": "AWST BNT CHOT HKT HOVST IRKT MYT PHT PHST SGT ULAT WITA WST",
    "+08:45": "ACWST CWST",
    "+09:00": "CHOST JST KST PWT TLT ULAST WIT YAKT",
    "+09:30": "ACST",
    "+10:00": "AEST CHST CHUT DDUT PGT VLAT",
    "+10:30": "ACDT",
    "+11:00": "AEDT AET KOST MIST NCT NFT PONT SAKT SBT SRET VUT",
    "+12:00": "ANAT FJT GILT MAGT MHT NZST PETT TVT WAKT",
    "+12:45": "CHAST",
    "+13:00": "NZDT PHOT TKT TOT",
    "+13:45": "CHADT",
    "+14:00": "LINT",
}
MINUS = "−"


def numeric_seconds(text: str) -> int | None:
    """Seconds of ``+hh``, ``+hhmm`` or ``+hh:mm``; None for anything else."""
    found = re.fullmatch(rf"([+\-{MINUS}])(\d\d)(?::?(\d\d))?", text)
    if not found:
        return None
    size = int(found[2]) * 3600 + int(found[3] or 0) * 60
    return size if found[1] == "+" else -size


#: Upper-case name to seconds; ambiguous names are absent.
SECONDS = {name: numeric_seconds(offset) for offset, names in ZONES.items() for name in names.split()}
NAMES = sorted([*SECONDS, *AMBIGUOUS], key=lambda n: (-len(n), n))


def option_seconds(text: str) -> int:
    """An offset given as an option: numeric or an unambiguous name, all upper or all lower case."""
    if (size := numeric_seconds(text)) is not None:
        return size
    if text in (text.upper(), text.lower()) and text.upper() in SECONDS:
        return SECONDS[text.upper()]
    raise ValueError(f"unknown or ambiguous time zone: {text!r}")


def seconds(text: Column) -> Column:
    """Offset seconds of a recognised zone text; null where it is empty or ambiguous."""
    names = F.create_map(*[F.lit(x) for name, size in SECONDS.items() for x in (name, size)])
    digits = F.regexp_replace(F.substring(text, 2, 6), ":", "")
    size = F.substring(digits, 1, 2).try_cast("int") * 3600 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)) * 60
    sign = F.substring(text, 1, 1)
    return F.when(sign == "+", size).when(sign.isin("-", MINUS), -size).when(text != "", F.try_element_at(names, F.upper(text)))


def offset_text(size: int, colon: bool = False) -> str:
    """``+hhmm`` or ``+hh:mm``."""
    hours, minutes = divmod(abs(size) // 60, 60)
    return f"{'-' if size < 0 else '+'}{hours:02}{':' if colon else ''}{minutes:02}"


def utc_wall(epoch_s: Column) -> Column:
    """The UTC wall clock of epoch seconds as TIMESTAMP_NTZ, whatever the session's zone."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=epoch_s.cast("decimal(18,6)"))
