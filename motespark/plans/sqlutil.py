"""Pieces of SQL that several queries share."""


def r6(expr: str, name: str | None = None) -> str:
    """``expr`` rounded as ``common.rounded`` does it, under ``name``."""
    return f"(CASE WHEN abs({expr}) >= 1e6 THEN round(({expr}) / 1e6, 6) * 1e6 ELSE round({expr}, 6) END) + 0.0 AS {name or expr}"


#: usable positions; the text of a number is compared, as isnan() trusts file statistics, which leave NaN out
OK = "x IS NOT NULL AND y IS NOT NULL AND CAST(x AS VARCHAR) <> 'nan' AND CAST(y AS VARCHAR) <> 'nan'"
