"""Row-cleaning rules as Column -> Column functions.

Every rule is a built-in expression (no Python UDF), so it stays inside
whole-stage codegen and runs where the data is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values.  They must equal the reference's rules for equal results.
# ---------------------------------------------------------------------------
# quality code -> score; anything else (missing, unparsable, other codes) -> 0.5
QUALITY_SCORES = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.5, 5: 0.2}
QUALITY_DEFAULT = 0.5
# sentinel used by the registry for "unknown"
SENTINEL = -99
# registry construction years outside this range become NULL
REGISTRY_YEAR_MIN, REGISTRY_YEAR_MAX = 1800, 2050
# enrichment construction years outside this range become NULL
ENRICHMENT_YEAR_MIN, ENRICHMENT_YEAR_MAX = 1800, 2024
# text values that mean "missing" in the metadata text fields (exact match)
NULL_TEXT_TOKENS = ["", "-99", "nan", "None"]
# usage flag values that mean "true"
USE_TRUE_VALUES = ["Main", "Sec"]
# width of the country code column
COUNTRY_CODE_LEN = 10
# display-name fallback
NAME_FALLBACK_PREFIX = "Dam near "
NAME_FALLBACK_CITY = "Unknown"
# text written for a missing quality code
QUALITY_TEXT_MISSING = "nan"
# tokens the metadata CSV reader treats as missing (pandas read_csv defaults)
READER_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# The characters Python's str.strip() removes: every code point for which
# str.isspace() holds (derived from the rule, not listed by hand).
PY_SPACE_CHARS = "".join(chr(cp) for cp in range(0x3001) if chr(cp).isspace())
# decimal literal without thousands separators, exponent allowed
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# plain integer literal
INTEGER_PATTERN = r"^[+-]?[0-9]+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: removes Unicode white space at both ends
    (a character-set trim, no regular expression)."""
    return F.btrim(_col(c), F.lit(PY_SPACE_CHARS))


def _literal(c, pattern: str, kind: str) -> Column:
    """The stripped text as ``kind`` where it fits ``pattern``.  A text that fits as it
    stands (``\\z``: to its very end) has nothing to strip, which is by far the dearest step."""
    c, s = _col(c), py_strip(c)
    return F.when(c.rlike(pattern.removesuffix("$") + r"\z"), c.try_cast(kind)) \
        .otherwise(F.when(s.rlike(pattern), s.try_cast(kind)))


def parse_number(c) -> Column:
    """Text -> double; NULL when the stripped text is not a decimal literal.

    Functions that use the parsed value more than once take it as an already
    parsed column (see ``nonneg``), so callers can parse once per row in an
    earlier projection: Spark does not share a sub-expression between the
    condition and the value of a CASE WHEN.
    """
    return _literal(c, NUMBER_PATTERN, "double")


def parse_integer(c) -> Column:
    """Text -> bigint; NULL unless the stripped text is an integer literal.

    ``'1950.7'`` is not an integer literal and gives NULL, as ``int('1950.7')``
    fails in Python.
    """
    return _literal(c, INTEGER_PATTERN, "bigint")


# -- rules on parsed values -------------------------------------------------
def nonneg(d) -> Column:
    """Parsed measure: -99 and any negative -> NULL; 0 is kept."""
    d = _col(d)
    return F.when(d >= 0, d)


def year_between(i, lo: int, hi: int) -> Column:
    """Parsed year -> int when within [lo, hi], else NULL."""
    i = _col(i)
    return F.when(i.between(lo, hi), i.cast("int"))


def score_from_code(i) -> Column:
    """Parsed quality code -> score as decimal(3,2); 0.5 for any other code."""
    i = _col(i)
    expr = None
    for code, score in QUALITY_SCORES.items():
        expr = (F.when(i == code, F.lit(score)) if expr is None
                else expr.when(i == code, F.lit(score)))
    return expr.otherwise(F.lit(QUALITY_DEFAULT)).cast("decimal(3,2)")


def coordinate(d, as_written: bool = False) -> Column:
    """Parsed coordinate: -99 -> NULL, negatives kept (or dropped, as written)."""
    d = _col(d)
    return F.when(d >= 0, d) if as_written else F.when(d != SENTINEL, d)


def year_rounded(d, lo: int | None = None, hi: int | None = None) -> Column:
    """Parsed metadata number -> non-negative, optionally within [lo, hi],
    rounded half up to int (a stored INTEGER rounds, a Spark cast truncates)."""
    d = _col(d)
    ok = d >= 0
    if lo is not None:
        ok = ok & d.between(lo, hi)
    return F.when(ok, F.round(d).cast("int"))


# -- single-column forms (parse + rule) ------------------------------------
def sentinel_float(c) -> Column:
    """Registry measure: unparsable, -99 or any negative -> NULL; 0 is kept."""
    return nonneg(parse_number(c))


def registry_year(c) -> Column:
    """Registry year: integer text within 1800..2050, else NULL."""
    return year_between(parse_integer(c), REGISTRY_YEAR_MIN, REGISTRY_YEAR_MAX)


def quality_score(c) -> Column:
    """Quality code -> score as decimal(3,2); 0.5 for anything not in the table."""
    return score_from_code(parse_integer(c))


def display_name(dam_name, reservoir_name, alt_name, near_city) -> Column:
    """First non-blank of dam, reservoir, alternative name (stripped), else
    ``'Dam near ' + city`` (city as is, ``'Unknown'`` when missing)."""
    def nonblank(c):
        return F.nullif(py_strip(c), F.lit(""))

    return F.coalesce(
        nonblank(dam_name), nonblank(reservoir_name), nonblank(alt_name),
        F.concat(F.lit(NAME_FALLBACK_PREFIX), F.coalesce(_col(near_city), F.lit(NAME_FALLBACK_CITY))),
    )


def country_code(c) -> Column:
    """Country text cut to the first 10 characters; NULL stays NULL."""
    return F.substring(_col(c), 1, COUNTRY_CODE_LEN)


def enrichment_measure(c) -> Column:
    """Metadata measure: numeric, -99 and negatives -> NULL."""
    return nonneg(parse_number(c))


def enrichment_coordinate(c, as_written: bool = False) -> Column:
    """Metadata coordinate: numeric, -99 -> NULL, negatives kept.

    ``as_written=True`` reproduces the reference script, which runs the
    non-negative rule on coordinates too and so loses the western and southern
    hemispheres.
    """
    return coordinate(parse_number(c), as_written)


def enrichment_year(c) -> Column:
    """Metadata year: numeric, non-negative and within 1800..2024, rounded to int."""
    return year_rounded(parse_number(c), ENRICHMENT_YEAR_MIN, ENRICHMENT_YEAR_MAX)


def enrichment_int(c) -> Column:
    """Metadata integer without a range rule (pre-construction year)."""
    return year_rounded(parse_number(c))


def clean_text(c, tokens=None) -> Column:
    """Exact-match null tokens -> NULL (no stripping)."""
    return F.when(~_col(c).isin(tokens or NULL_TEXT_TOKENS), _col(c))


def usage_flag(c) -> Column:
    """True iff the value is exactly 'Main' or 'Sec'; missing -> false."""
    return F.coalesce(_col(c).isin(USE_TRUE_VALUES), F.lit(False))


def quality_text(c) -> Column:
    """Quality code kept as text; a missing code becomes the text 'nan'."""
    return F.coalesce(_col(c).cast("string"), F.lit(QUALITY_TEXT_MISSING))


def reader_nulls(c, tokens=None) -> Column:
    """Reader-level missing tokens -> NULL (what a pandas CSV read does)."""
    return F.when(~_col(c).isin(tokens or READER_NULL_TOKENS), _col(c))
