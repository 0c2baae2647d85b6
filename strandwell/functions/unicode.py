"""Unicode normal forms, for which Spark has no expression: Arrow-batched, meant for the one time a text is stored."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(form: str) -> Callable[[Column], Column]:
    """The function that brings a text column to NFC, NFD, NFKC or NFKD; nulls stay null."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(form)

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return apply


def stored_forms(text: Column) -> Column:
    """raw (NFC), norm (NFC, single spaces) and accentless (without marks, đ as d) of a text, from one pass."""

    @F.pandas_udf("raw string, norm string, accentless string")
    def forms(texts: pd.Series) -> pd.DataFrame:
        raw = texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))
        norm = raw.map(lambda t: None if t is None else " ".join(t.split()))

        def plain(t: str | None) -> str | None:
            if t is None:
                return None
            base = "".join(c for c in unicodedata.normalize("NFD", t.replace("đ", "d").replace("Đ", "D")) if unicodedata.category(c) != "Mn")
            return unicodedata.normalize("NFC", base)

        return pd.DataFrame({"raw": raw, "norm": norm, "accentless": norm.map(plain)})

    return forms(text)


def document_text(parts: dict[str, Column]) -> Column:
    """A text for an index from named parts: `name: value` lines, lists joined by `; `, empty parts left out."""
    lines = []
    for name, value in parts.items():
        text = F.trim(value)
        lines.append(F.when(F.length(text) > 0, F.concat(F.lit(f"{name}: "), text)))
    return F.concat_ws("\n", *lines)
