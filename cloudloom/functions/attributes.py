"""Attribute names, their aliases, and the numeric types a point table can hold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted spellings of the standard attributes. Case matters (r, R).
ALIASES: dict[str, tuple[str, ...]] = {
    "X": ("X", "x"),
    "Y": ("Y", "y"),
    "Z": ("Z", "z"),
    "Intensity": ("Intensity", "intensity", "i"),
    "ReturnNumber": ("ReturnNumber", "returnnumber", "return_number", "return", "Return", "r"),
    "NumberOfReturns": ("NumberOfReturns", "NumberReturns", "numberofreturns", "n"),
    "Classification": ("Classification", "classification", "class", "Class", "c"),
    "gpstime": ("gpstime", "gps_time", "GPStime", "time", "gps", "t"),
    "Synthetic": ("Synthetic", "synthetic", "Synthetic_flag", "s"),
    "Keypoint": ("Keypoint", "keypoint", "Keypoint_flag", "k"),
    "Withheld": ("Withheld", "withheld", "Withheld_flag", "w"),
    "Overlap": ("Overlap", "overlap", "Overlap_flag", "o"),
    "UserData": ("UserData", "userdata", "user_data", "ud", "u"),
    "PointSourceID": ("PointSourceID", "pointsourceid", "point_source", "point_source_id", "psid", "p"),
    "EdgeOfFlightline": ("EdgeOfFlightline", "edgeofflightline", "e"),
    "ScanDirectionFlag": ("ScanDirectionFlag", "scandirectionflag", "d"),
    "ScanAngle": ("ScanAngle", "scanangle", "scan_angle", "ScanAngleRank", "scananglerank", "angle", "Angle", "a"),
    "R": ("R", "Red", "red"),
    "G": ("G", "Green", "green"),
    "B": ("B", "Blue", "blue"),
    "NIR": ("NIR", "nir", "N"),
}
_CANONICAL = {alias: name for name, aliases in ALIASES.items() for alias in aliases}
COORDINATES = ("X", "Y", "Z")


@dataclass(frozen=True)
class NumericType:
    """How a named numeric type is stored: the Spark type and the range writes are clamped to."""

    spark: str
    low: float | None
    high: float | None

    @property
    def whole(self) -> bool:
        return self.spark not in ("float", "double")


# Names, storage and ranges of the attribute types.
TYPES: dict[str, NumericType] = {
    "uchar": NumericType("smallint", 0, 255),
    "char": NumericType("tinyint", -128, 127),
    "ushort": NumericType("int", 0, 65535),
    "short": NumericType("smallint", -32768, 32767),
    "uint": NumericType("bigint", 0, 4294967295),
    "int": NumericType("int", -2147483648, 2147483647),
    "uint64": NumericType("decimal(20,0)", 0, 18446744073709551615),
    "int64": NumericType("bigint", -9223372036854775808, 9223372036854775807),
    "float": NumericType("float", -3.4028234663852886e38, 3.4028234663852886e38),
    "double": NumericType("double", None, None),
}


def canonical(name: str) -> str:
    """The standard name behind an alias; unknown names are extra attributes and stay."""
    return _CANONICAL.get(name, name)


def find(df: DataFrame, name: str) -> str | None:
    """The column of ``df`` that an attribute name means, or None."""
    wanted = canonical(name)
    for column in df.columns:
        if column == wanted or (column not in _CANONICAL and column == name):
            return column
    return next((c for c in df.columns if canonical(c) == wanted), None)


def attribute(df: DataFrame, name: str) -> Column:
    """An attribute in double precision: ``|name|`` is its absolute value, a missing one is 0."""
    bare = name.strip()
    absolute = len(bare) > 2 and bare[0] == bare[-1] == "|"
    column = find(df, bare[1:-1] if absolute else bare)
    value = F.lit(0.0) if column is None else F.col(f"`{column}`").cast("double")
    return F.abs(value) if absolute else value


def clamped(value: Column, kind: NumericType, scale: float = 1.0, offset: float = 0.0) -> Column:
    """``value`` as it is stored: rounded half away from zero and clamped, then scaled back."""
    x = value.cast("double")
    if scale != 1.0 or offset != 0.0:
        x = (x - F.lit(float(offset))) / F.lit(float(scale))
    if kind.whole:
        x = F.round(x)
    if kind.low is not None:
        x = F.greatest(F.lit(float(kind.low)), F.least(F.lit(float(kind.high)), x))
    if scale != 1.0 or offset != 0.0:
        return x * F.lit(float(scale)) + F.lit(float(offset))
    if kind.spark == "bigint" and kind.high > 2**53:
        # the largest double under 2**63, as the bound itself is not a double
        x = F.least(x, F.lit(9223372036854774784.0))
    return x.cast(kind.spark)
