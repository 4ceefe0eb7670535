"""Text normalisation and lexical column functions.

Three normalisation families exist and must stay apart: *label* (trims a set of edge
punctuation), *plain* (whitespace only) and *loose* (no NFKC, used by evaluation).
NFKC and full case folding have no Spark builtin, so ``fold_*`` run as Arrow functions;
everything else stays in the JVM.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.arrow import text_lists, texts

# Whitespace as Python sees it, edge characters trimmed from labels,
# letter ranges used by the language rule, and the token shape.
SPACE = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WHITESPACE = f"[{SPACE}]+"
NEAR_SPACE = r"[^!-\x{84}\x{A1}-\x{167F}]"  # most letters and signs fail here at once, before the list of SPACE is gone through
_ANY_SPACE = f"[{NEAR_SPACE}&&[{SPACE}]]"
WIDE_SPACE = f" {_ANY_SPACE}+|[{NEAR_SPACE.replace('!', ' ', 1)}&&[{SPACE}]]{_ANY_SPACE}*"  # runs of whitespace but single blanks, which stay as they are
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LABEL_EDGES = " \t\r\n:;,.\"'„“”"
QUERY_EDGES = " \t\r\n,;:-"
CYRILLIC_RUN = r"[\x{0400}-\x{04FF}]+"
LATIN_RUN = "[A-Za-z]+"
TOKEN = r"[\p{L}\p{N}_]+(?:[&+.-][\p{L}\p{N}_]+)*"


def strip(value: Column | str) -> Column:
    """Trim whitespace of any kind on both ends; inner whitespace stays."""
    return F.btrim(_col(value), F.lit(SPACES))  # a pattern for the end is tried at every inner blank, and runs of them in time with their square


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def squeeze(value: Column | str) -> Column:
    """Collapse whitespace runs and trim; NULL becomes the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(_col(value), F.lit("")), WIDE_SPACE, " "))


def label(value: Column | str) -> Column:
    """Collapse whitespace, then trim label punctuation on both ends."""
    return F.btrim(squeeze(value), F.lit(LABEL_EDGES))


def _fold(text: str | None, edges: str) -> str:
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return " ".join(text.split()).strip(edges).casefold()


#: Values of a batch that are Python objects at once.
FOLDED_ROWS = 64


def _each(values: pa.Array, change: Callable, kind: pa.DataType) -> pa.Array:
    """``change`` of every value, some at a time, so that a large batch is not held as Python objects too."""
    made = text_lists if pa.types.is_list(kind) else texts
    parts = [made([change(v) for v in values.slice(at, FOLDED_ROWS).to_pylist()]) for at in range(0, len(values), FOLDED_ROWS)]
    return pa.concat_arrays(parts) if parts else made([])


def _once(udf: Callable) -> Callable:
    """``udf`` where it stands. A filter on a folded column would else be pushed below it and fold the texts once more, in
    another worker of each task. Spark leaves only non-deterministic functions in place, so these are declared to be such."""
    return udf.asNondeterministic()


@_once
@F.arrow_udf(T.StringType())
def _fold_plain(values: pa.Array) -> pa.Array:
    return _each(values, lambda v: _fold(v, " "), pa.string())


@_once
@F.arrow_udf(T.StringType())
def _fold_label(values: pa.Array) -> pa.Array:
    return _each(values, lambda v: _fold(v, LABEL_EDGES), pa.string())


@_once
@F.arrow_udf(T.ArrayType(T.StringType()))
def _fold_labels(values: pa.Array) -> pa.Array:
    return _each(values, lambda row: None if row is None else [_fold(v, LABEL_EDGES) for v in row], pa.list_(pa.string()))


@_once
@F.arrow_udf(T.StringType())
def _fold_loose(values: pa.Array) -> pa.Array:
    return _each(values, lambda v: " ".join((v or "").casefold().split()), pa.string())


def loose(value: Column | str) -> Column:
    """Evaluation-time form: case-fold and collapse whitespace, no NFKC."""
    return _fold_loose(_col(value))


def fold_plain(value: Column | str) -> Column:
    """NFKC, collapse whitespace, case-fold; punctuation kept."""
    return _fold_plain(_col(value))


def fold_label(value: Column | str) -> Column:
    """NFKC, collapse whitespace, trim label punctuation, case-fold."""
    return _fold_label(_col(value))


def fold_labels(values: Column | str) -> Column:
    """``fold_label`` over each element of an array."""
    return _fold_labels(_col(values))


def words(value: Column | str) -> Column:
    """Whitespace-separated words; an empty text has none."""
    return F.array_remove(F.split(squeeze(value), " "), "")


def word_count(value: Column | str) -> Column:
    return F.size(F.array_remove(F.split(squeeze(value), " "), ""))


def tokens_of_folded(folded: Column | str) -> Column:
    """Tokens of an already folded text; inner ``& + . -`` join word parts."""
    return F.regexp_extract_all(_col(folded), F.lit(TOKEN), F.lit(0))


def tokenize(value: Column | str) -> Column:
    return tokens_of_folded(fold_plain(value))


def detect_language(value: Column | str) -> Column:
    """``bg`` or ``en`` by the letter majority between Cyrillic and basic Latin, else ``mixed``."""
    # text and counts are elements of an array, so that each is computed once however often it is named; letters are counted
    # by what is left without them, as a run of all but letters takes several times as long to match
    letters = lambda t, run: F.length(t) - F.length(F.regexp_replace(t, run, ""))
    counts = F.transform(
        F.array(F.coalesce(_col(value), F.lit(""))),
        lambda t: F.struct(letters(t, CYRILLIC_RUN).alias("cyrillic"), letters(t, LATIN_RUN).alias("latin")),
    )
    named = lambda n: F.when(n["cyrillic"] > n["latin"], "bg").when(n["latin"] > n["cyrillic"], "en").otherwise("mixed")
    return F.get(F.transform(counts, named), F.lit(0))


def passage_text(section: Column | str, text: Column | str) -> Column:
    """Section and body on separate lines, blanks left out (dense and lexical representation)."""
    return F.array_join(F.filter(F.array(squeeze(section), squeeze(text)), lambda part: part != ""), "\n")


def model_prefixes(model_name: str) -> tuple[str, str]:
    """Query and passage prefixes: only the multilingual E5 family wants them."""
    return ("query: ", "passage: ") if "multilingual-e5" in model_name.casefold() else ("", "")


def page_label(page_start: Column, page_end: Column, page: Column | None = None) -> Column:
    """A page span as text: ``3``, ``3-5`` or NULL."""
    start, end = page_start.cast("string"), page_end.cast("string")
    fallback = F.lit(None).cast("string") if page is None else page.cast("string")
    return (
        F.when(page_start.isNull() & page_end.isNull(), fallback)
        .when(page_start.isNull(), end)
        .when(page_end.isNull() | (page_start == page_end), start)
        .otherwise(F.concat(start, F.lit("-"), end))
    )


def percent(value: Column) -> Column:
    return F.format_string("%.1f%%", value * 100)


def sentences(value: Column | str) -> Column:
    """Split after sentence punctuation followed by whitespace."""
    return F.split(_col(value), rf"(?<=[.!?])[{SPACE}]+")
