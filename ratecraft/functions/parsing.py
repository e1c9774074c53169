"""Field extraction for delimited text lines.

The rating format's parser strips the line the way Python's ``str.strip`` does
(all whitespace, not only spaces as Spark's ``trim``), splits on the separator
and converts fields strictly: an integer field must be an integer literal
(``"3.0"`` is not an id), a float field a Python float literal.
Conversions use ``try_cast`` so a bad field becomes NULL rather than failing
the task; callers decide whether NULL means "reject" or "fail the job".
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() removes from a unicode line (PySpark's
# text reader yields unicode strings): every code point with str.isspace(),
# derived by rule rather than listed.
PY_WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
_WS_CLASS = "[" + "".join(f"\\u{ord(c):04x}" for c in PY_WHITESPACE) + "]"

# Integer literal as int()/long() accept it: optional sign, ASCII digits.
_INT_LITERAL = f"^{_WS_CLASS}*[+-]?[0-9]+{_WS_CLASS}*$"
# Float literal as float() accepts it (decimal, exponent, inf/infinity/nan);
# rejects the Java-only forms Spark's cast would take ("1.5f", "3d", hex).
_FLOAT_LITERAL = (f"(?i)^{_WS_CLASS}*[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?"
                  f"|inf|infinity|nan){_WS_CLASS}*$")


def py_strip(col: Column | str) -> Column:
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(PY_WHITESPACE))


def _field(fields: Column, pos: int) -> Column:
    # 1-based; NULL when the line has fewer fields.
    return F.try_element_at(fields, F.lit(pos))


def text_field(fields: Column, pos: int) -> Column:
    return _field(fields, pos)


def int_field(fields: Column, pos: int, dtype: str = "int") -> Column:
    s = _field(fields, pos)
    return F.when(s.rlike(_INT_LITERAL), py_strip(s).try_cast(dtype))


def float_field(fields: Column, pos: int) -> Column:
    s = _field(fields, pos)
    return F.when(s.rlike(_FLOAT_LITERAL), py_strip(s).try_cast("double"))
