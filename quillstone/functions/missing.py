"""What counts as a missing value: null, NaN, blank, or an entry that only says 'unknown'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and digits of entries that state no value, lower case.
NO_VALUE = (
    "na", "nan", "nil", "none", "null", "void", "empty", "blank", "missing", "drop", "other",
    "unknown", "notknown", "unspecified", "undefined", "undetermined", "unavailable", "notavailable",
    "notset", "notgiven", "notprovided", "notspecified", "notapplicable", "notstated", "noanswer", "novalue", "nodata",
    "tbd", "tbc", "tba", "tobedetermined", "tobeconfirmed", "dontknow",
    "sindato", "sindatos", "desconocido", "noconsta", "nodisponible", "noespecificado", "ninguno",
    "keineangabe", "keineangaben", "unbekannt", "nichtangegeben", "nichtverfügbar", "keine",
    "nonrenseigné", "nonrenseigne", "inconnu", "nonprécisé", "nonspécifié", "nondisponible", "aucun",
    "sconosciuto", "nonspecificato", "nondisponibile", "desconhecido", "nãoinformado", "seminformação",
    "不明", "未知", "未設定", "該当なし", "없음", "미상",
)


def plain_key(c: Column) -> Column:
    """Letters and digits of ``c`` only, lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def is_missing_text(c: Column) -> Column:
    """True for null, blank, punctuation only, and entries that only say that no value is given (``\\N`` too)."""
    key = plain_key(c)
    return c.isNull() | (key == "") | key.isin(*NO_VALUE) | c.rlike(r"^\s*\\[Nn]\s*$")


def is_missing_number(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """True for null, NaN, infinite, ``<= low`` and ``> high``."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    if low is not None:
        bad = bad | (c <= low)
    if high is not None:
        bad = bad | (c > high)
    return bad
