"""Measurement values, units, qualifiers, labels and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---- fixed values (formats, thresholds) ----
QUALIFIED_NUMBER = r"^\s*([<>=~]+)?\s*([0-9.eE+-]+)"
PLAIN_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"
ACTIVE_MAX_NM = 10000.0
GRAY_MAX_NM = 20000.0
POTENT_PIC50 = 6.0
UPPER_BOUND = ("<", "<=")
LOWER_BOUND = (">", ">=")
HYDROGEN_TOKEN = r"\[\d*H[+-]?\d*\]"
ATOM_TOKEN = r"\[[^\]]*\]|Br|Cl|[BCNOPSFIbcnops]"


def strip(col: Column) -> Column:
    """Drop blanks of any kind at both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def half_even(col: Column, digits: int) -> Column:
    """Round on the scaled value, ties to even."""
    scale = F.lit(float(10**digits))
    return F.rint(col * scale) / scale


def parse_qualified(col: Column) -> tuple[Column, Column]:
    """``'>10000'`` -> (relation, number); no number pattern -> ('', null)."""
    known = col.rlike(QUALIFIED_NUMBER)
    sign = F.regexp_extract(col, QUALIFIED_NUMBER, 1)
    relation = F.when(known, F.when(sign == "", "=").otherwise(sign)).otherwise("")
    number = F.when(known, F.regexp_extract(col, QUALIFIED_NUMBER, 2).try_cast("double"))
    return relation, number


def to_number(col: Column) -> Column:
    """Text to double, anything else to null."""
    text = col.cast("string")
    return F.when(text.rlike(PLAIN_NUMBER), F.trim(text).try_cast("double"))


def to_nanomolar(value: Column, unit: Column) -> Column:
    """Harmonise nM, uM and M; other units have no value."""
    u = strip(unit)
    return (
        F.when(u == "nM", value)
        .when(u == "uM", value * F.lit(1000.0))
        .when(u == "M", value * F.lit(1e9))
    )


def clean_relation(col: Column) -> Column:
    """Drop quote marks; a missing relation stays missing and counts as exact."""
    return F.replace(col, F.lit("'"), F.lit(""))


def is_qualified(relation: Column) -> Column:
    return F.coalesce(F.trim(relation).isin(*UPPER_BOUND, *LOWER_BOUND), F.lit(False))


def is_type(col: Column, wanted: str = "IC50") -> Column:
    return F.upper(col) == wanted


def has_key(col: Column) -> Column:
    return col.isNotNull() & (F.length(col) > 0)


def usable_measurement(key: Column, value: Column, unit: Column) -> Column:
    return key.isNotNull() & (unit == "nM") & (value > 0)


def pic50(nanomolar: Column) -> Column:
    """-log10 of the molar value; a zero value has none."""
    return -F.log10(F.when(nanomolar > 0, nanomolar) * F.lit(1e-9))


def pic50_floored(nanomolar: Column, floor: float = 1e-6) -> Column:
    return F.lit(9.0) - F.log10(F.greatest(nanomolar, F.lit(floor)))


def potency(pchembl: Column, value: Column, unit: Column | None = None) -> Column:
    """Reported potency, else the one computed from a value in nM."""
    usable = value if unit is None else F.when(strip(unit) == "nM", value)
    return F.coalesce(pchembl, pic50(usable))


def label_binary(value: Column, relation: Column, active_max: float = ACTIVE_MAX_NM) -> Column:
    """1 active, 0 inactive, null unknown; a lower bound is never active."""
    below = F.coalesce(F.trim(relation).isin(*LOWER_BOUND), F.lit(False))
    return F.when(value.isNull(), F.lit(None)).when(below, 0).otherwise(
        (value <= active_max).cast("int")
    )


def label_potency(potency_col: Column, threshold: float = POTENT_PIC50) -> Column:
    return (potency_col >= threshold).cast("int")


def activity_class(value: Column, relation: Column) -> Column:
    """active / gray / inactive / amb, qualifiers taken into account; a missing value has no class."""
    lower = F.coalesce(F.trim(relation).isin(*LOWER_BOUND), F.lit(False))
    bounded = (
        F.when(value >= GRAY_MAX_NM, "inactive").when(value > ACTIVE_MAX_NM, "gray").otherwise("amb")
    )
    exact = (
        F.when(value <= ACTIVE_MAX_NM, "active").when(value < GRAY_MAX_NM, "gray").otherwise("inactive")
    )
    return F.when(value.isNull(), F.lit(None)).when(lower, bounded).otherwise(exact)


def in_gray_zone(value: Column, relation: Column) -> Column:
    return (F.trim(relation) == "=") & (value > ACTIVE_MAX_NM) & (value < GRAY_MAX_NM)


def activity_name(label: Column) -> Column:
    return F.when(label == 1, "active").when(label == 0, "inactive").otherwise("unlabeled")


def finite(col: Column) -> Column:
    """Infinite and not-a-number cells become missing."""
    return F.when(~(F.isnan(col) | (F.abs(col) == F.lit(float("inf")))), col)


#: Matches the texts whose ``canonical_key`` is not null.
NOT_BLANK = r"[^ \t\r\n]"


def canonical_key(col: Column, lower: bool = False, valid: str | None = None) -> Column:
    """One normal form per structure text, null when empty or not valid."""
    form = F.trim(F.regexp_replace(col, r"[ \t\r\n]+", " "))
    if lower:
        form = F.lower(form)
    if valid:
        form = F.when(form.rlike(valid), form)
    return F.nullif(form, F.lit(""))


def largest_fragment(col: Column, mark: str = ".") -> Column:
    """The longest dot-separated fragment, the first of equals."""
    parts = F.split(col, "\\" + mark)
    longest = F.array_max(F.transform(parts, lambda p: F.length(p)))
    return F.element_at(F.filter(parts, lambda p: F.length(p) == longest), 1)


def coarse_key(col: Column) -> Column:
    """Identity that ignores case, blanks and punctuation."""
    return F.md5(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", ""))


def heavy_atoms(smiles: Column) -> Column:
    """Atom tokens of a SMILES text that are not hydrogen."""
    return F.regexp_count(smiles, F.lit(ATOM_TOKEN)) - F.regexp_count(smiles, F.lit(HYDROGEN_TOKEN))


def ligand_efficiency(affinity: Column, n_heavy: Column) -> Column:
    return -affinity / n_heavy
