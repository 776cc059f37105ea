"""The Twp/Rge/Sec scalar as native column expressions: no Python runs for any of these.

A part is valid, erroneous (XXXz, XX) or undefined (___z, __); both of the latter have null numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.options import ERROR_RGE, ERROR_SEC, ERROR_TWP, UNDEF_RGE, UNDEF_SEC, UNDEF_TWP

#: A section of three digits is no section: it is erroneous.
_TRS = r"(([0-9]{1,3})([ns])|___z)(([0-9]{1,3})([ew])|___z)(([0-9]{2})(?![0-9])|__)?"
FIELDS = ("trs", "twp", "twp_num", "twp_ns", "twp_undef", "rge", "rge_num", "rge_ew", "rge_undef", "sec", "sec_num", "sec_undef")


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trs_fields(trs: Column | str) -> dict[str, Column]:
    """The twelve fields of a TRS string, by name; null and '' are undefined, other text that is no TRS is erroneous."""
    s = F.lower(F.coalesce(F.nullif(_column(trs), F.lit("")), F.lit(UNDEF_TWP + UNDEF_RGE + UNDEF_SEC)))
    group = lambda k: F.nullif(F.regexp_extract(s, _TRS, k), F.lit(""))
    # every field is cut from the text by itself: nested expressions would be copied into each other
    twp, rge, sec = (F.coalesce(group(k), F.lit(error)) for k, error in ((1, ERROR_TWP), (4, ERROR_RGE), (7, ERROR_SEC)))
    return {
        "trs": F.concat(twp, rge, sec),
        "twp": twp,
        "twp_num": group(2).cast("int"),
        "twp_ns": group(3),
        "twp_undef": twp == UNDEF_TWP,
        "rge": rge,
        "rge_num": group(5).cast("int"),
        "rge_ew": group(6),
        "rge_undef": rge == UNDEF_RGE,
        "sec": sec,
        "sec_num": group(8).cast("int"),
        "sec_undef": sec == UNDEF_SEC,
    }


def fields_of(twp: Column, rge: Column, sec: Column) -> dict[str, Column]:
    """The twelve fields of parts that are valid, erroneous or undefined."""
    # a failing try_cast costs an exception for each row, so only valid parts are cast
    valid = lambda c: F.substring(c, 1, 1).between("0", "9")
    number = lambda c, n: F.when(valid(c), F.substring(c, 1, n)).cast("int")
    letter = lambda c: F.when(valid(c), F.substring(c, -1, 1))
    return {
        "trs": F.concat(twp, rge, sec),
        "twp": twp,
        "twp_num": number(twp, F.length(twp) - 1),
        "twp_ns": letter(twp),
        "twp_undef": twp == UNDEF_TWP,
        "rge": rge,
        "rge_num": number(rge, F.length(rge) - 1),
        "rge_ew": letter(rge),
        "rge_undef": rge == UNDEF_RGE,
        "sec": sec,
        "sec_num": number(sec, F.lit(2)),
        "sec_undef": sec == UNDEF_SEC,
    }


def trs_struct(trs: Column | str) -> Column:
    return F.struct(*[c.alias(n) for n, c in trs_fields(trs).items()])


def is_error(trs: Column | str, twp: bool = True, rge: bool = True, sec: bool = True) -> Column:
    """Whether any of the chosen parts is erroneous; an undefined part is not."""
    f = trs_fields(trs)
    out = F.lit(False)
    for use, n in ((twp, "twp"), (rge, "rge"), (sec, "sec")):
        if use:
            out = out | (f[f"{n}_num"].isNull() & ~f[f"{n}_undef"])
    return out


def is_undef(trs: Column | str, twp: bool = True, rge: bool = True, sec: bool = True) -> Column:
    f = trs_fields(trs)
    out = F.lit(False)
    for use, n in ((twp, "twp"), (rge, "rge"), (sec, "sec")):
        if use:
            out = out | f[f"{n}_undef"]
    return out


def construct_trs(twp: Column | str, rge: Column | str, sec: Column | str, default_ns: str = "n", default_ew: str = "w", ocr_scrub: bool = False) -> Column:
    """A TRS string from its parts, numbers or text; a part that is malformed falls to its own error."""

    def text(c: Column | str) -> Column:
        out = F.trim(_column(c).cast("string"))
        return out

    def ranged(c: Column | str, letters: str, default: str, undef: str, error: str) -> Column:
        s = text(c)
        if ocr_scrub:
            # the last letter may be the direction
            s = F.concat(F.translate(F.regexp_extract(s, r"^(.*?)([nsewNSEW]?)$", 1), "SsOIlL", "550111"), F.regexp_extract(s, r"^(.*?)([nsewNSEW]?)$", 2))
        pattern = rf"^[trTR]?\.?\s*0*([0-9]{{1,3}})\s*([{letters}{letters.upper()}]?)$"
        number, way = F.regexp_extract(s, pattern, 1), F.lower(F.regexp_extract(s, pattern, 2))
        return F.when(s.isNull() | (s == "") | (s == undef), undef).when(number == "", error).otherwise(F.concat(number, F.when(way == "", default).otherwise(way)))

    s = text(sec)
    if ocr_scrub:
        s = F.translate(s, "SsOIlL", "550111")
    digits = F.regexp_extract(s, r"^0*([0-9]{1,2})$", 1)
    section = F.when(s.isNull() | (s == "") | (s == UNDEF_SEC), UNDEF_SEC).when(digits == "", ERROR_SEC).otherwise(F.lpad(digits, 2, "0"))
    return F.concat(ranged(twp, "ns", default_ns, UNDEF_TWP, ERROR_TWP), ranged(rge, "ew", default_ew, UNDEF_RGE, ERROR_RGE), section)


def pretty_twprge(trs: Column | str, t: str = "T", delim: str = "-", r: str = "R", n: str = "N", s: str = "S", e: str = "E", w: str = "W", undef: str = "---X") -> Column:
    """A heading such as T154N-R97W."""
    f = trs_fields(trs)
    twp = F.when(f["twp_num"].isNull(), undef).otherwise(F.concat(f["twp_num"].cast("string"), F.when(f["twp_ns"] == "n", n).otherwise(s)))
    rge = F.when(f["rge_num"].isNull(), undef).otherwise(F.concat(f["rge_num"].cast("string"), F.when(f["rge_ew"] == "e", e).otherwise(w)))
    return F.concat(F.lit(t), twp, F.lit(delim + r), rge)


def short_to_natural(twprge: Column | str) -> Column:
    return F.regexp_replace(F.upper(_column(twprge)), r"^([0-9]+[NS])([0-9]+[EW])$", "T$1-R$2")


def natural_to_short(twprge: Column | str) -> Column:
    return F.lower(F.regexp_replace(_column(twprge), r"^T([0-9]+[NS])-R([0-9]+[EW])$", "$1$2"))


def ocr_digits(c: Column | str) -> Column:
    return F.translate(_column(c), "SsOIlL", "550111")
