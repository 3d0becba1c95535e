"""Column-level functions (all built from Spark SQL expressions)."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, functions as F

Col = Column | str


def _c(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Col) -> Column:
    """Numeric value or NULL: text, NaN and infinities count as missing."""
    value = _c(c).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def non_negative(c: Col) -> Column:
    value = number(c)
    return F.when(value >= 0, value)


def split_ids(c: Col, separators: str = r"[;,|/\s]+", dropped: Sequence[str] = ("", "nan", "none")) -> Column:
    """Distinct sorted tokens of a delimited string."""
    tokens = F.split(_c(c), separators)
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: ~F.lower(t).isin(*dropped))))


def token_ids(c: Col, pattern: str = r"REF\d{4,}") -> Column:
    """Distinct sorted upper-cased matches of ``pattern`` (any case)."""
    found = F.regexp_extract_all(F.upper(_c(c)), F.lit(pattern), F.lit(0))
    return F.array_sort(F.array_distinct(found))


# UTF-8 dashes read as Latin-1, and their repair.
BROKEN_DASHES = ("â€“", "â€”", "–", "—")


def clean_text(c: Col, broken: Sequence[str] = BROKEN_DASHES) -> Column:
    """Dashes to ``-``, runs of white space to one blank, trimmed."""
    out = _c(c)
    for bad in broken:
        out = F.replace(out, F.lit(bad), F.lit("-"))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


# Unit suffixes of column headers and subscript digits.
UNIT_SUFFIXES = (" (wt.%)", " (wt%)", " (ppm)")
SUBSCRIPTS = ("₀₁₂₃₄₅₆₇₈₉", "0123456789")


def feature_name(c: Col, suffixes: Sequence[str] = UNIT_SUFFIXES) -> Column:
    out = F.translate(_c(c), *SUBSCRIPTS)
    for suffix in suffixes:
        out = F.replace(out, F.lit(suffix), F.lit(""))
    return F.trim(out)


def is_yes(c: Col) -> Column:
    return F.coalesce(F.lower(F.trim(_c(c).cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def bounded(value: Column, low: float = 1e-6, high: float = 1e6) -> Column:
    """NULL for anything not finite, otherwise clipped to ``[low, high]``."""
    finite = F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
    return F.when(finite.isNotNull(), F.greatest(F.least(finite, F.lit(high)), F.lit(low)))


def weighted_sum(terms: Mapping[str, float]) -> Column:
    out = None
    for column, weight in terms.items():
        term = F.col(column) * F.lit(weight)
        out = term if out is None else out + term
    return out


def ratio(numerator: Mapping[str, float], denominator: Mapping[str, float]) -> Column:
    """Ratio of two weighted sums, clipped."""
    return bounded(F.try_divide(weighted_sum(numerator), weighted_sum(denominator)))


def ratio_to_geometric_mean(numerator: tuple[str, float], left: tuple[str, float],
                            right: tuple[str, float]) -> Column:
    """``(a/na) / sqrt((b/nb)·(c/nc))``, clipped."""
    scaled = [F.col(c) / F.lit(n) for c, n in (numerator, left, right)]
    return bounded(F.try_divide(scaled[0], F.sqrt(F.when(scaled[1] * scaled[2] >= 0, scaled[1] * scaled[2]))))


# Molar masses and chondrite normalisation (ppm).
MOLAR_MASS = {"Al2O3": 101.9612, "CaO": 56.0774, "Na2O": 61.9789, "K2O": 94.196, "FeO": 71.8444,
              "Fe2O3": 159.6882, "MgO": 40.3044}
CHONDRITE = {"La": 0.237, "Sm": 0.153, "Eu": 0.0580, "Gd": 0.2055, "Yb": 0.170}
FERRIC_TO_FERROUS = 0.8998


def petrogenetic_ratios(columns: Sequence[str]) -> dict[str, Column]:
    """The eight ratios whose inputs are all among ``columns``."""
    mol = {k: 1.0 / v for k, v in MOLAR_MASS.items()}
    pick = lambda *names: {n: mol[n] for n in names}
    fe = {"FeO": mol["FeO"], "Fe2O3": FERRIC_TO_FERROUS * mol["FeO"]}
    specs = {
        "A/CNK": (pick("Al2O3"), pick("CaO", "Na2O", "K2O")),
        "A/NK": (pick("Al2O3"), pick("Na2O", "K2O")),
        "Fe*": (fe, {**fe, "MgO": mol["MgO"]}),
        "K2O/Na2O": ({"K2O": 1.0}, {"Na2O": 1.0}),
        "Rb/Sr": ({"Rb": 1.0}, {"Sr": 1.0}),
        "Zr/Hf": ({"Zr": 1.0}, {"Hf": 1.0}),
        "(La/Yb)N": ({"La": 1.0 / CHONDRITE["La"]}, {"Yb": 1.0 / CHONDRITE["Yb"]}),
    }
    have = set(columns)
    out = {n: ratio(a, b) for n, (a, b) in specs.items() if set(a) | set(b) <= have}
    if {"Eu", "Sm", "Gd"} <= have:
        out["Eu/Eu*"] = ratio_to_geometric_mean(*[(e, CHONDRITE[e]) for e in ("Eu", "Sm", "Gd")])
    return out


def unit_transform(value: Col, is_fraction: Column) -> Column:
    """Weight fractions as they are, trace amounts as ``log10(x + 1)``."""
    return F.when(is_fraction, _c(value)).otherwise(F.log10(_c(value) + F.lit(1.0)))


def to_scale(value: Col, center: Col, scale: Col) -> Column:
    return (F.log1p(_c(value)) - _c(center)) / _c(scale)


def from_scale(z: Col, center: Col, scale: Col) -> Column:
    return F.greatest(F.expm1(_c(z) * _c(scale) + _c(center)), F.lit(0.0))


def squash(score: Col) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(score)))


def softmax(scores: Column) -> Column:
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def temper(probabilities: Column, temperature: Col) -> Column:
    """Softmax of log probabilities divided by a temperature."""
    t = F.greatest(_c(temperature), F.lit(1e-6))
    return softmax(F.transform(
        probabilities, lambda p: F.ln(F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0))) / t))


def argmax(scores: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def first_max(columns: Sequence[str]) -> Column:
    return argmax(F.array(*[F.col(c) for c in columns]))


def complexity(model: Col, params: Column) -> Column:
    """Comparable size of a parameter set per model family (tie-breaker among equal trials).

    Forest: trees x depth / smallest leaf, unlimited depth counts as 30; boosting: trees x 2^depth; SVM:
    log10 C + log10(1e5 gamma + 1); MLP: hidden units.
    """
    p = lambda k: params.getItem(k)
    m = _c(model)
    return (
        F.when(m == "rf", p("n_estimators") * F.coalesce(p("max_depth"), F.lit(30.0)) / F.greatest(F.coalesce(p("min_leaf"), F.lit(1.0)), F.lit(1.0)))
        .when(m == "gbt", p("n_estimators") * F.pow(F.lit(2.0), p("max_depth")))
        .when(m == "svm", F.log10(F.greatest(p("C"), F.lit(1e-12))) + F.log10(p("gamma") * 1e5 + 1.0))
        .when(m == "mlp", p("hidden_1") + F.coalesce(p("hidden_2"), F.lit(0.0)))
    )


def passed_names(checks: Mapping[str, Column], sep: str = "; ", passed: bool = False) -> Column:
    """Names of the failed checks (or, with ``passed``, of those that hold), joined."""
    want = lambda c: c if passed else ~F.coalesce(c, F.lit(False))
    return F.array_join(F.array_compact(F.array(
        *[F.when(want(c), F.lit(n)) for n, c in checks.items()])), sep)


def same_sign(a: Col, b: Col) -> Column:
    return F.coalesce((F.signum(_c(a)) == F.signum(_c(b))) & (F.signum(_c(a)) != 0), F.lit(False))


def category(c: Col, families: Mapping[str, Sequence[str]], default: str) -> Column:
    """First family one of whose markers occurs in the name."""
    out = F.when(F.lit(False), F.lit(""))
    for family, markers in families.items():
        for marker in markers:
            out = out.when(F.contains(_c(c), F.lit(marker)), F.lit(family))
    return out.otherwise(F.lit(default))
