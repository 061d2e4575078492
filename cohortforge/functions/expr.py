"""Column -> Column expressions with the scripts' exact semantics.

All of these are built-in Spark expressions (no UDFs), so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# NULL / empty-string handling.  In the source database '' is NULL and the
# || operator treats NULL operands as ''.  Spark's || returns NULL when any
# operand is NULL, so concatenation goes through concat_ws (which skips NULLs)
# and an empty result is turned back into NULL.
# ---------------------------------------------------------------------------

def null_if_blank(c: ColumnOrName) -> Column:
    """'' -> NULL (the source database cannot hold an empty string)."""
    return F.nullif(_c(c), F.lit(""))


def oracle_concat(*cols: ColumnOrName) -> Column:
    """a || b || ... with NULL read as '' and an empty result read as NULL."""
    return F.nullif(F.concat_ws("", *[_c(c) for c in cols]), F.lit(""))


def nosp(c: ColumnOrName) -> Column:
    """REPLACE(c, ' ', ''); an all-blank value becomes NULL as in the source."""
    return F.nullif(F.replace(_c(c), F.lit(" "), F.lit("")), F.lit(""))


def match_key(first: ColumnOrName, last: ColumnOrName, addr: ColumnOrName, n: int,
              state: ColumnOrName | None = None, upper: bool = True) -> Column:
    """Normalised name-and-address key.

    ``upper(nosp(first) || nosp(last) || nosp(substr(addr, 1, n))) || nosp(state)``.
    The address is cut to ``n`` characters *before* blanks are removed, and the
    state is appended *outside* the upper-casing.  The insured side of the link
    is built with ``upper=False`` (its names are stored upper-case already).
    """
    body = oracle_concat(nosp(first), nosp(last), nosp(F.substring(_c(addr), 1, n)))
    if upper:
        body = F.upper(body)
    if state is None:
        return body
    return oracle_concat(body, nosp(state))


def full_name(first: ColumnOrName, last: ColumnOrName) -> Column:
    """first || ' ' || last with the source's NULL-as-'' concatenation."""
    return oracle_concat(first, F.lit(" "), last)


def like_any(c: ColumnOrName, patterns: Iterable[str]) -> Column:
    """c LIKE p1 OR c LIKE p2 ... (prefix patterns become StartsWith)."""
    col = _c(c)
    cond = None
    for p in patterns:
        t = col.like(p)
        cond = t if cond is None else (cond | t)
    return cond if cond is not None else F.lit(False)


def loose_email(c: ColumnOrName) -> Column:
    """The funnel's e-mail test: contains '@' OR contains '.' (either passes)."""
    col = _c(c)
    return col.like("%@%") | col.like("%.%")


# ---------------------------------------------------------------------------
# Policy attributes
# ---------------------------------------------------------------------------

# Wellness tier by vrcc code (any other code or NULL -> '' -> NULL).
WELLCARE_TIERS = ((99, "VRCC"), (144, "Core"), (264, "Premier"))


def wellcare_type(vrcc: ColumnOrName) -> Column:
    col = _c(vrcc)
    out = None
    for code, label in WELLCARE_TIERS:
        out = (F.when(col == code, F.lit(label)) if out is None
               else out.when(col == code, F.lit(label)))
    return out.otherwise(F.lit(None).cast("string"))


def cancer_flag(cancer: ColumnOrName) -> Column:
    """CASE cancer WHEN 0 THEN 'N' ELSE 'Y' END: NULL counts as 'Y'."""
    return F.when(_c(cancer) == 0, F.lit("N")).otherwise(F.lit("Y"))


def species_flag(species: ColumnOrName, codes: Sequence[str]) -> Column:
    """1 when the species code is one of ``codes`` else 0 (NULL -> 0)."""
    col = _c(species)
    cond = col == codes[0] if len(codes) == 1 else col.isin(list(codes))
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


# Household species classes (code list per output column).
SPECIES_CLASSES = (("dogs", ("C",)), ("cats", ("F",)), ("avian", ("A",)),
                   ("exoticothers", ("E", "R")))


# ---------------------------------------------------------------------------
# Report ladders
# ---------------------------------------------------------------------------

# Amount band upper bounds and labels, lowest first.  A value v
# is in the first band whose bound b satisfies v <= b; the first band starts
# at 0 inclusive, anything above the last bound is the open top band, and
# negative or NULL amounts get no band.
AMOUNT_BAND_BOUNDS = (100, 200, 300, 400, 500, 600, 700, 800, 900, 1000,
                      1200, 1400, 1600, 1800, 2000, 3000, 4000, 5000)
AMOUNT_BAND_LABELS = ("a0 to 100", "b101 to 200", "c201 to 300", "d301 to 400",
                      "e401 to 500", "f501 to 600", "g601 to 700", "h701 to 800",
                      "i801 to 900", "j901 to 1000", "k1001 to 1200", "l1201 to 1400",
                      "m1401 to 1600", "n1601 to 1800", "o1801 to 2000", "p2001 to 3000",
                      "q3001 to 4000", "r4001 to 5000", "s5000 Higher")


def amount_band(c: ColumnOrName) -> Column:
    col = _c(c)
    out = F.when((col >= 0) & (col <= AMOUNT_BAND_BOUNDS[0]), F.lit(AMOUNT_BAND_LABELS[0]))
    bands = zip(AMOUNT_BAND_BOUNDS, AMOUNT_BAND_BOUNDS[1:], AMOUNT_BAND_LABELS[1:-1])
    for lower, bound, label in bands:
        out = out.when((col > lower) & (col <= bound), F.lit(label))
    return out.when(col > AMOUNT_BAND_BOUNDS[-1], F.lit(AMOUNT_BAND_LABELS[-1]))


# Multi-pet household classes.
PET_MIX_LABELS = ("A_AllFeline", "B_AllCanine", "C_AllAvianExotic", "D_CanineFelineMix",
                  "E_CanineOthersMix", "F_FelineOthersMix", "G_CanineFelineorOthersMix",
                  "Unknown")
# Places of the labels by which animals a household has: none, dogs, cats, dogs and cats, others,
# dogs and others, cats and others, all.
_PET_MIX_BY_PRESENCE = (7, 1, 0, 3, 2, 4, 5, 6)


def pet_mix(dogs: ColumnOrName = "dogs", cats: ColumnOrName = "cats",
            avian: ColumnOrName = "avian", exotic: ColumnOrName = "exoticothers") -> Column:
    """The household's class, looked up by three presence flags; a NULL count gives 'Unknown'."""
    has = [_c(dogs) >= 1, _c(cats) >= 1, _c(avian) + _c(exotic) >= 1]
    at = F.lit(1)
    for weight, flag in zip((1, 2, 4), has):
        at = at + flag.cast("int") * weight
    labels = F.array(*[F.lit(PET_MIX_LABELS[k]) for k in _PET_MIX_BY_PRESENCE])
    return F.coalesce(F.element_at(labels, at), F.lit(PET_MIX_LABELS[_PET_MIX_BY_PRESENCE[0]]))


# Term bands (no ELSE: negative or NULL terms get no band).
def term_band(c: ColumnOrName) -> Column:
    col = _c(c)
    return (F.when(col == 0, F.lit("0"))
            .when(col.between(1, 3), F.lit("1 to 3"))
            .when(col.between(4, 5), F.lit("4 to 5"))
            .when(col > 5, F.lit("5 Higher")))


def household_size_band(c: ColumnOrName) -> Column:
    """between 1 and 6 -> itself, anything else (0, NULL, 7+) -> 7."""
    col = _c(c)
    return F.when(col.between(1, 6), col).otherwise(F.lit(7)).cast("int")


def pet_count_cap(c: ColumnOrName) -> Column:
    """>= 7 -> 7; NULL stays NULL and 0 stays 0."""
    col = _c(c)
    return F.when(col >= 7, F.lit(7)).otherwise(col).cast("int")


# Products folded into one reporting class.
PRODUCT_FOLD = ("I250%", "I250 (Reg/I250G)")


def product_class(c: ColumnOrName) -> Column:
    col = _c(c)
    return F.when(col.like(PRODUCT_FOLD[0]), F.lit(PRODUCT_FOLD[1])).otherwise(col)


def paid_per_claim(paid: ColumnOrName, claims: ColumnOrName) -> Column:
    """CAST(paid / NULLIF(claims, 0) AS DECIMAL(10,2)); half-up rounding."""
    return (_c(paid) / F.nullif(_c(claims), F.lit(0))).cast("decimal(10,2)")
