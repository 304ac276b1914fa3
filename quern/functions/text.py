"""Identifier, path, label and filename expressions; NFC alone needs Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def normalized_id(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "_"), F.lit("_"))


def slashes(c: Column) -> Column:
    return F.regexp_replace(c, r"\\", "/")


def label_code(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.concat(F.lit("U"), padded(F.hex(F.ascii(x)), 4))), "_")


def padded(c: Column, width: int) -> Column:
    """Zeros in front up to the width; longer texts stay whole."""
    return F.lpad(c, F.greatest(F.length(c), F.lit(width)), F.lit("0"))


def safe_stem(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", ""), " ", "_")


def portable_path(c: Column, root: str = "datasets") -> Column:
    found = F.regexp_extract(slashes(c), rf"({root}/.*)$", 1)
    return F.when(found != "", found).otherwise(c)


def strongest_group(levels: dict[str, Column]) -> Column:
    """struct(level, id) of the first non-empty value, by the order of `levels`."""
    return F.coalesce(*[F.when(F.coalesce(v, F.lit("")) != "", F.struct(F.lit(k).alias("level"), v.alias("id"))) for k, v in levels.items()])


def parse_reference(c: Column, names: list[str]) -> Column:
    """struct(inscription, page) of a reference such as "NAME, I, L. 4": first of `names` that equals or starts it."""
    whole = normalized_id(c)
    inscription = F.coalesce(*[F.when((whole == n) | whole.startswith(n + "_"), F.lit(n)) for n in names], F.lit(""))
    tail = F.regexp_replace(F.coalesce(F.get(F.split(c, ","), F.lit(1)), F.lit("")), r"(?i)\bL\s*\.?\s*\d+.*$", "")
    page = normalized_id(tail)
    return F.struct(inscription.alias("inscription"), F.when((inscription != "") & (page != ""), F.concat_ws("_", inscription, page)).otherwise("").alias("page"))


def filename_identity(c: Column, label: Column | None = None) -> Column:
    """struct(kind, word, crop, page) from the four filename families, in order; an unknown name raises.

    Numbers are padded, never cut. The last family is named by its class: the label given, or else the one in the name.
    """
    stem = F.regexp_replace(c, r"\.[^.]*$", "")
    part = lambda pattern, k=1: F.regexp_extract(stem, f"(?i){pattern}", k)
    number = lambda pattern, k, width: padded(F.regexp_replace(part(pattern, k), "^0+(?=.)", ""), width)
    families = {"word": r"^word_(\d+)_char_(\d+)_", "chart": r"^col_(\d+)_p(\d+)$", "page": r"^diff_page_(\d+)_p(\d+)$", "label": r"^diff_(.+)_p(\d+)$"}
    none = F.lit("")
    word = F.concat(F.lit("WORD_"), number(families["word"], 1, 4))
    page = F.concat(F.lit("DIFF_PAGE_"), number(families["page"], 1, 4))
    chart_page = number(families["chart"], 2, 3)
    own = {
        "word": (word, F.concat(word, F.lit("_CHAR_"), number(families["word"], 2, 2)), none),
        "chart": (none, F.concat(F.lit("COL_"), number(families["chart"], 1, 2), F.lit("_P"), chart_page), F.concat(F.lit("REFERENCE_CHART_P"), chart_page)),
        "page": (none, F.concat(page, F.lit("_P"), number(families["page"], 2, 3)), page),
        "label": (none, F.concat(F.lit("DIFF_"), label_code(part(families["label"]) if label is None else label), F.lit("_P"), number(families["label"], 2, 3)), none),
    }
    out = F.raise_error(F.concat(F.lit("unknown file name: "), c)).cast("struct<kind:string,word:string,crop:string,page:string>")
    for kind in reversed(families):
        w, crop, p = own[kind]
        out = F.when(part(families[kind]) != "", F.struct(F.lit(kind).alias("kind"), w.alias("word"), crop.alias("crop"), p.alias("page"))).otherwise(out)
    return out


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def label_parts(c: Column, nasals: str = "ँंः", vowels: str = "ािीुूृेैोौ") -> Column:
    """struct(base, modifier, nasal) of a Devanagari label: one trailing nasal, then one trailing vowel sign, is peeled off."""
    text = F.trim(nfc(c))
    bare = F.regexp_replace(text, f"[{nasals}]$", "")
    base = F.regexp_replace(bare, f"[{vowels}]$", "")
    good = F.when(~text.rlike(r"\p{IsDevanagari}") | (base == ""), F.raise_error(F.concat(F.lit("not a label: "), c)).cast("string")).otherwise(base)
    return F.struct(good.alias("base"), F.regexp_extract(bare, f"([{vowels}])$", 1).alias("modifier"), (text != bare).alias("nasal"))


def frequency_bin_evaluation(n: Column) -> Column:
    return F.when(n <= 0, "zero_shot").when(n == 1, "one_shot").when(n <= 4, "2_4").when(n <= 9, "5_9").otherwise("10_plus")


def frequency_bin_comparison(n: Column) -> Column:
    return F.when(n <= 1, "one_shot").when(n <= 4, "2_4").when(n <= 9, "5_9").when(n <= 19, "10_19").otherwise("20_plus")


def frequency_bin_strict(n: Column) -> Column:
    """As in the comparison, but counts below one are an error."""
    return F.when(n < 1, F.raise_error(F.lit("count below one")).cast("string")).otherwise(frequency_bin_comparison(n))


def legacy_source_key(label: Column, path: Column) -> Column:
    """label::key: the first chart, difference or page number in the file's name in lower case, or else the name without the
    endings that generated copies have."""
    families, copies = r"(col_\d+_p\d+|diff_[^_]*_p\d+|p\d+)", r"(_seed_?\d+|_aug_?\d+|_\d{3,})+$"  # fixed patterns
    stem = F.lower(F.regexp_replace(F.element_at(F.split(slashes(path), "/"), -1), r"(?<=.)\.[^.]+$", ""))
    family = F.regexp_extract(stem, families, 1)
    return F.concat(label, F.lit("::"), F.when(family != "", family).otherwise(F.regexp_replace(stem, copies, "")))
