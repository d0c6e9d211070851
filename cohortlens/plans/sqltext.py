"""Small builders for the SQL the queries are checked with."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from cohortlens.functions import lexicons as L


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values: Iterable[str]) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def rnd(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def strip(expr: str) -> str:
    return f"trim({expr}, E' \\t\\n\\r\\f\\x0b')"


def fold(expr: str) -> str:
    return rf"regexp_replace({expr}, '[^\x00-\x7F\P{{L}}]|[^\x00-\x7F\P{{N}}]', '_', 'g')"


def count(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {lit(pattern)}))"


def hits(expr: str, patterns: Sequence[str], ignore_case: bool = True) -> str:
    flag = "(?i)" if ignore_case else ""
    return "CAST(" + " + ".join(count(expr, flag + p) for p in patterns) + " AS INTEGER)"


def keywords(lower: str, words: Sequence[str]) -> str:
    return "CAST(" + " + ".join(f"CAST(contains({lower}, {lit(w)}) AS INTEGER)" for w in words) + " AS INTEGER)"


def matches(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {lit('(?i)' + pattern)})"


def without_urls(expr: str) -> str:
    return f"regexp_replace({expr}, {lit(L.URL)}, '', 'g')"


def display(expr: str) -> str:
    e = f"regexp_replace({expr}, {lit(L.IMAGE_URL)}, '[image]', 'g')"
    e = f"regexp_replace({e}, {lit(L.URL)}, '[link]', 'g')"
    e = f"regexp_replace({e}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(e)


# ---- distribution tails by quadrature -------------------------------------------------------

_N = 4000


def _simpson(f: str, upper: str) -> str:
    """Integral of f(u) over [0, upper]; ``f`` is SQL in ``u``."""
    body = f.replace("{u}", f"(({upper}) * i / {_N}.0::DOUBLE)")
    return (
        f"(({upper}) / {3 * _N}.0::DOUBLE * list_sum(list_transform(range(0, {_N + 1}), lambda i: "
        f"(CASE WHEN i = 0 OR i = {_N} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({body}))))"
    )


def p_norm(z: str) -> str:
    """Two-sided normal tail."""
    return f"(1 - {_simpson('2 * exp(-{u} * {u} / 2) / sqrt(2 * pi())', f'least(abs({z}), 12.0::DOUBLE)')})"


def p_t(t: str, df: str) -> str:
    """Two-sided t tail, by the angle a with tan(a) = t / sqrt(df)."""
    norm = f"(2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi()))"
    return f"(1 - {norm} * {_simpson(f'pow(cos({{u}}), ({df}) - 1)', f'atan(abs({t}) / sqrt({df}))')})"


def p_chi2(x: str, df: str) -> str:
    """Upper tail, integrating over the square root so that one degree of freedom stays smooth."""
    norm = f"(2 / exp(lgamma(({df}) / 2.0)) / pow(2.0::DOUBLE, ({df}) / 2.0))"
    return f"(1 - {norm} * {_simpson(f'(CASE WHEN {{u}} = 0 THEN (CASE WHEN ({df}) = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) ELSE pow({{u}}, ({df}) - 1) * exp(-{{u}} * {{u}} / 2) END)', f'sqrt(least({x}, 400.0::DOUBLE))')})"


def p_f(f: str, d1: str, d2: str) -> str:
    """Upper tail by the angle a with sin(a)^2 = d1 f / (d1 f + d2)."""
    norm = f"(2 * exp(lgamma((({d1}) + ({d2})) / 2.0) - lgamma(({d1}) / 2.0) - lgamma(({d2}) / 2.0)))"
    inner = (
        f"(CASE WHEN {{u}} = 0 THEN (CASE WHEN ({d1}) = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) "
        f"ELSE pow(sin({{u}}), ({d1}) - 1) * pow(cos({{u}}), ({d2}) - 1) END)"
    )
    return f"(1 - {norm} * {_simpson(inner, f'asin(sqrt(({d1}) * ({f}) / (({d1}) * ({f}) + ({d2}))))')})"


def uniform(key: str) -> str:
    """The library's stable hash as a number in [0, 1)."""
    return f"(CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"
