"""The Spark rating parser against a brute-force Python restatement of the
original parse (``strip`` -> ``split('::')`` -> int, int, float, long), on
random lines built from digits, signs, dots, exponents, words, separators and
ASCII/Unicode whitespace."""

import math
import re

from hypothesis import HealthCheck, given, settings, strategies as st

from ratecraft.sources import text

INT32 = (-(2 ** 31), 2 ** 31 - 1)
INT64 = (-(2 ** 63), 2 ** 63 - 1)
_ASCII_INT = re.compile(r"[+-]?[0-9]+")
_ASCII_FLOAT = re.compile(r"[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)")
_SPECIAL = {"inf", "infinity", "nan"}


def _int(s, bounds):
    t = s.strip()
    if not _ASCII_INT.fullmatch(t):
        return None
    v = int(t)
    return v if bounds[0] <= v <= bounds[1] else None


def _float(s):
    t = s.strip()
    body = t.lstrip("+-") if t[:1] in "+-" else t
    if not (_ASCII_FLOAT.fullmatch(t) or body.lower() in _SPECIAL):
        return None
    return float(t)


def reference_parse(line):
    f = line.strip().split("::")
    if len(f) < 4:
        return None, "too few fields"
    u, i, r, ts = _int(f[0], INT32), _int(f[1], INT32), _float(f[2]), _int(f[3], INT64)
    for v, name in ((u, "user_id"), (i, "item_id"), (r, "rating"), (ts, "ts")):
        if v is None:
            return None, name
    return (u, i, r, ts, ts % 10), None


WS = [" ", "\t", "\r", "\x0b", "\xa0", " ", "　"]
piece = st.one_of(
    st.integers(-10 ** 12, 10 ** 12).map(str),
    st.floats(allow_nan=False, allow_infinity=False, width=32).map(lambda x: f"{x:g}"),
    st.sampled_from(["inf", "-Infinity", "nan", "NaN", "1.5f", "3d", "0x10", "1_0", "", ".",
                     "1e", "e5", "+7", "-0", "007", ":", "x", "3.0", " 12 "]),
)
field = st.tuples(st.sampled_from([""] + WS), piece, st.sampled_from([""] + WS)).map("".join)
line = st.tuples(st.lists(field, min_size=0, max_size=6),
                 st.sampled_from([""] + WS), st.sampled_from([""] + WS)) \
    .map(lambda t: t[1] + "::".join(t[0]) + t[2])


def _norm(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in row)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(line, min_size=50, max_size=200))
def test_parser_matches_reference_semantics(spark, lines):
    df = spark.createDataFrame([(k, s) for k, s in enumerate(lines)], "k int, value string")
    good, bad = text.parse_ratings(df, mode="quarantine")
    got_good = sorted(_norm(tuple(r)) for r in good.collect())
    got_bad = sorted((r["line"], r["reason"]) for r in bad.collect())
    want_good, want_bad = [], []
    for s in lines:
        row, reason = reference_parse(s)
        if reason is None:
            want_good.append(_norm(row))
        else:
            want_bad.append((s, reason))
    assert got_good == sorted(want_good)
    assert got_bad == sorted(want_bad)
