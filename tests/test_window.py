from datetime import datetime, timezone

import pytest

from chronoweave.functions.window import resolve_window
from chronoweave.operators.render import unescape

NOW = datetime(2020, 3, 4, 5, 6, 7, 800, timezone.utc)


def _iso(*args, **kw):
    return [x and x.isoformat() for x in resolve_window(*args, now=NOW, **kw)]


@pytest.mark.parametrize(
    ("text", "zone", "want"),
    [
        ("20200102T030405", "+08:00", "2020-01-02T03:04:05+08:00"),
        ("2020-01-02 03:04:05.123 -0130", "+08:00", "2020-01-02T03:04:05.123000-01:30"),
        ("2020/01/02T03:04:05 PST", "+00:00", "2020-01-02T03:04:05-08:00"),
        ("20200102", "+01:00", "2020-01-02T00:00:00+01:00"),
        ("01/02", "+00:00", "2020-01-02T00:00:00+00:00"),
        ("03:04", "+00:00", "2020-03-04T03:04:00+00:00"),
        ("+946684800", "+00:00", "2000-01-01T00:00:00+00:00"),
        ("-1d2h", "+00:00", "2020-03-03T03:06:07+00:00"),
        ("-1d1d", "+00:00", "2020-03-03T05:06:07+00:00"),
        ("-1w!10:20", "+00:00", "2020-02-26T10:20:00+00:00"),
        ("-1h+02:00", "+00:00", "2020-03-04T04:06:07+02:00"),
    ],
)
def test_after(text, zone, want):
    assert _iso(text, None, default_tz=zone) == [want, None]


def test_relative_to_the_other_end():
    assert _iso("@-1d", "20200102") == ["2020-01-01T00:00:00+00:00", "2020-01-02T00:00:00+00:00"]
    assert _iso("20200102", "@+6h") == ["2020-01-02T00:00:00+00:00", "2020-01-02T06:00:00+00:00"]


@pytest.mark.parametrize("pair", [("@-1d", "@+1d"), ("20200103", "20200102"), ("yesterday", None), ("2020-01-02 03:04:05 IST", None), ("@-1d", None)])
def test_refused(pair):
    with pytest.raises(ValueError):
        resolve_window(*pair, now=NOW)


def test_unescape():
    assert unescape(r"a\n\t\x41\\") == "a\n\tA\\"
    with pytest.raises(ValueError):
        unescape(r"\q")
