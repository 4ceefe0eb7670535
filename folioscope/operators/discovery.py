"""Entity discovery: candidate extraction from page rows.

Every rule but one reads a single page row and needs no shuffle. Only the continuation of a
list table over consecutive pages looks at another page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import LABEL_EDGES, SPACE, fold_label, fold_labels, label
from folioscope.operators.ordered import carry_forward, page_bucket
from folioscope.session import durable

# The extraction patterns and word lists.
FUND_TERM = (
    r"(?iU)\b(?:sub[- ]?funds?|funds?|"
    r"подфонд(?:ът|а|и|ове)?|фонд(?:ът|а|и|ове)?)\b"
)
FUND_LIST = (
    r"(?isU)\b(?:list|списък)\b.{0,100}\b(?:sub[- ]?funds?|funds?|"
    r"подфонд(?:ове|и)?|фонд(?:ове|и)?)\b"
)
RELATIONS = (
    r"(?imUd)(?:^|[.!?]\s+|\n\n)\s*([A-ZА-ЯЁ„“][^.!?\n]{4,180}?)\s+(?:който\s+)?е\s+(?:подфонд|фонд)\b",
    r"(?imUd)(?:^|[.!?]\s+|\n\n)\s*([A-ZА-ЯЁ„“][^.!?\n]{4,180}?)\s+(?:which\s+)?"
    r"(?:is|constitutes|represents)\s+(?:an?\s+)?(?:sub[- ]?fund|fund)\b",
)
RELATION_ENDINGS = (
    r"(?iU)\sе\s+(?:подфонд|фонд)\b",
    r"(?iU)\s(?:is|constitutes|represents)\s+(?:an?\s+)?(?:sub[- ]?fund|fund)\b",
)
LABEL = (
    r"(?iUd)^(?:product(?:\s+name)?|fund\s+name|sub[- ]?fund\s+name|"
    r"продукт|име\s+на\s+(?:фонда|подфонда)|"
    r"наименование\s+на\s+(?:фонда|подфонда))\s*:?\s*(.*)$"
)
# Necessary conditions on blocks that are not cleaned yet: of being more than blank, of LABEL (its first word).
NOT_BLANK = rf"[^{SPACE}{LABEL_EDGES}]"
LABEL_WORD = rf"(?iU)\A[{SPACE}{LABEL_EDGES}]*(?:product|fund|sub|продукт|име|наименование)"
BAD_NAMES = (
    "summary", "резюме", "обобщение", "prospectus", "проспект", "selected strategy",
    "basic details", "introduction", "product", "продукт", "name", "име",
)
BAD_STARTS = ("този продукт", "this product", "този фонд", "this fund")
NAME_HEADERS = ("name", "име", "наименование", "fund", "sub-fund", "subfund")
NAME_HEADER_PARTS = ("fund name", "subfund name", "sub-fund name")
PAGE_HEADERS = ("page", "страница", "стр")
FUND_HEADER_PARTS = ("fund", "подфонд", "фонд")
EVIDENCE_CHARS = 300

CANDIDATE_COLUMNS = ("name", "document", "page", "method", "evidence", "seq")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def plausible_shape(name: Column) -> Column:
    """Length, word and letter limits of a cleaned name, and no sentence ending."""
    n_words = F.size(F.split(name, " "))
    letters = F.length(F.regexp_replace(name, r"[^\p{L}]", ""))
    return (
        F.length(name).between(5, 180)
        & n_words.between(2, 24)
        & (letters >= 4)
        & ~name.rlike(r"[.!?]\z")
    )


def allowed_name(folded: Column) -> Column:
    """Not a stock heading and not a sentence about 'this product'."""
    starts = any_of([folded.startswith(s) for s in BAD_STARTS])
    return ~folded.isin(*BAD_NAMES) & ~starts


def keep_valid(candidates: DataFrame, name: str = "name") -> DataFrame:
    """Rows whose cleaned name is a valid entity name (cheap shape test before folding)."""
    shaped = candidates.filter(plausible_shape(F.col(name)))
    return shaped.withColumn("_folded", fold_label(name)).filter(allowed_name(F.col("_folded"))).drop("_folded")


def with_validity(df: DataFrame, raw: str, name: str = "is_valid") -> DataFrame:
    """Add the name verdict for a raw text column."""
    checked = df.withColumn("_clean", label(raw)).withColumn("_folded", fold_label(raw))
    return checked.withColumn(name, plausible_shape(F.col("_clean")) & allowed_name(F.col("_folded"))).drop(
        "_clean", "_folded"
    )


def _evidence(text: Column) -> Column:
    return F.left(label(text), F.lit(EVIDENCE_CHARS))


def _seq(major: Column, minor: Column) -> Column:
    """Order of extraction inside one page and method."""
    return major.cast("long") * 1_000_000 + minor.cast("long")


def relation_candidates(
    pages: DataFrame, patterns: tuple[str, ...] = RELATIONS, endings: tuple[str, ...] = RELATION_ENDINGS
) -> DataFrame:
    """``<name> is a fund`` statements, every match of every pattern.

    ``endings`` are necessary conditions, one per pattern.
    """
    text = F.coalesce("text", F.lit(""))
    found = None
    for i, (pattern, ending) in enumerate(zip(patterns, endings)):
        # the fixed ending alone rules out almost every page before the lazy pattern runs
        relevant = pages.filter(text.rlike(ending))
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        part = relevant.select("document", "page", F.posexplode(matches).alias("pos", "m")).select(
            label(F.regexp_extract("m", pattern, 1)).alias("name"), "document", "page",
            F.lit("relation").alias("method"), _evidence(F.col("m")).alias("evidence"),
            _seq(F.lit(i), F.col("pos")).alias("seq"),
        )
        found = part if found is None else found.unionByName(part)
    return found


def filled_blocks(blocks: Column) -> Column:
    """Blocks that cleaning leaves some text of; positions count these. Their texts are not cleaned."""
    return F.filter(blocks, lambda b: b["text"].rlike(NOT_BLANK))


def label_candidates(pages: DataFrame) -> DataFrame:
    """``Product name: X`` labels; an empty label takes the next block of the page."""
    blocks = pages.select("document", "page", filled_blocks(F.col("text_blocks")).alias("b"))
    near = F.filter(
        F.transform(
            "b",
            lambda b, i: F.struct(
                i.alias("pos"), b["text"].alias("text"),
                F.get(F.col("b"), i + 1)["text"].alias("following"),
            ),
        ),
        lambda h: h["text"].rlike(LABEL_WORD),
    )
    # only blocks that begin like a label, and those that follow them, are cleaned
    cleaned = F.transform(
        near,
        lambda h: F.struct(
            h["pos"].alias("pos"), label(h["text"]).alias("text"),
            F.when(h["following"].isNotNull(), label(h["following"])).alias("following"),
        ),
    )
    hits = F.filter(cleaned, lambda h: h["text"].rlike(LABEL))
    rows = blocks.select("document", "page", F.explode(hits).alias("h")).select(
        "document", "page", "h.*", label(F.regexp_extract("h.text", LABEL, 1)).alias("value")
    )
    own = F.col("value") != ""
    return rows.filter(own | F.col("following").isNotNull()).select(
        F.when(own, F.col("value")).otherwise(F.col("following")).alias("name"),
        "document", "page",
        F.when(own, "label").otherwise("label_next").alias("method"),
        _evidence(
            F.when(own, F.col("text")).otherwise(F.concat_ws(" | ", "text", "following"))
        ).alias("evidence"),
        _seq(F.lit(0), F.col("pos")).alias("seq"),
    )


def array_median(values: Column) -> Column:
    """Exact median of a numeric array, NULL when empty."""
    ordered, n = F.array_sort(values), F.size(values)
    upper = F.get(ordered, F.floor(n / 2).cast("int"))
    lower = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    return F.when(n > 0, (lower + upper) / 2)


def title_candidates(pages: DataFrame) -> DataFrame:
    """A quoted, prominent first block of page 1 with fund wording nearby."""
    first_pages = pages.filter(
        (F.col("page") == 1) & F.coalesce("text", F.lit("")).rlike(rf'\A[{SPACE}]*[„"]')
    )
    filled = filled_blocks(F.col("text_blocks"))
    cleaned = F.transform(
        F.slice(filled, 1, 4),
        lambda b: F.struct(
            label(b["text"]).alias("text"), b["font_size"].alias("font_size"), F.coalesce(b["bold"], F.lit(False)).alias("bold")
        ),
    )
    sizes = F.filter(F.transform(filled, lambda b: b["font_size"]), lambda s: s.isNotNull() & (s != 0))
    # one element exploded: a filter below would else be pushed past the cleaning and clean the blocks again for each thing it asks
    blocks = first_pages.select(
        "document", "page", F.explode(F.array(F.struct(cleaned.alias("b"), sizes.alias("sizes")))).alias("p")
    ).select("document", "page", "p.*")
    rows = blocks.filter(F.size("b") > 0).select(
        "document", "page", F.get("b", F.lit(0)).alias("top"), array_median(F.col("sizes")).alias("body"),
        F.array_join(F.transform("b", lambda b: b["text"]), " ").alias("nearby"),
    )
    prominent = F.col("top.bold") | F.coalesce(F.col("top.font_size") >= F.col("body") * 1.25, F.lit(False))
    return rows.filter(
        prominent & F.col("nearby").rlike(FUND_TERM) & (F.size(F.split("top.text", " ")) <= 16)
    ).select(
        F.col("top.text").alias("name"), "document", "page", F.lit("quoted_title").alias("method"),
        _evidence(F.col("nearby")).alias("evidence"), F.lit(0).cast("long").alias("seq"),
    )


def column_index(header: Column, wanted: tuple[str, ...], parts: tuple[str, ...] = ()) -> Column:
    """0-based position of the first matching header cell, NULL if none."""

    def hit(cell: Column) -> Column:
        return any_of([cell.isin(*wanted), *[cell.contains(p) for p in parts]])

    places = F.filter(
        F.transform(header, lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda p: hit(p["c"])
    )
    return F.get(F.transform(places, lambda p: p["i"]), F.lit(0))


def list_tables(pages: DataFrame) -> DataFrame:
    """Tables with at least two rows and a name column, with the list-shape flags."""
    tables = pages.filter(F.size("tables") > 0).select(
        "document", "page", F.coalesce("text", F.lit("")).rlike(FUND_LIST).alias("page_lists"),
        F.posexplode("tables").alias("table_pos", "t"),
    )
    header = F.transform(F.element_at("t.rows", 1), lambda c: F.coalesce(c, F.lit("")))
    shaped = (
        tables.filter(F.size("t.rows") >= 2)
        .select("document", "page", "page_lists", "table_pos", F.col("t.rows").alias("rows"), fold_labels(header).alias("h"))
        .withColumn("name_col", column_index(F.col("h"), NAME_HEADERS, NAME_HEADER_PARTS))
        .filter(F.col("name_col").isNotNull())
        .withColumn("page_col", column_index(F.col("h"), PAGE_HEADERS))
    )
    own = F.get(F.col("h"), F.col("name_col"))
    return shaped.select(
        "document", "page", "page_lists", "table_pos", "rows", "name_col",
        F.col("page_col").isNotNull().alias("has_page"),
        any_of([own.contains(p) for p in FUND_HEADER_PARTS]).alias("names_funds"),
    ).filter(F.col("has_page") | F.col("names_funds"))


def list_pages(tables: DataFrame) -> DataFrame:
    """Per page: does it open a list, and is a list active when the page begins?

    A page opens a list when its text announces one and it has a list-shaped table; a page
    with a Name+Page table continues the list of the page right before it. Activity is the
    opening flag carried along runs of continuing pages.
    """
    flags = tables.groupBy("document", "page").agg(
        F.first("page_lists").alias("opens"), F.bool_or("has_page").alias("continues")
    )
    relevant = flags.filter(F.col("opens") | F.col("continues"))
    before = relevant.select("document", (F.col("page") + 1).alias("page"), F.lit(True).alias("_adjacent"))
    marked = durable(relevant.join(before, ["document", "page"], "left").withColumn(
        "_state",
        F.when(F.col("opens"), True).when(F.col("_adjacent").isNull(), False),
    ))
    carried = carry_forward(marked, ["document"], [F.col("page")], page_bucket(), "_state", "active")
    previous = carried.filter("active").select("document", (F.col("page") + 1).alias("page"), F.lit(True).alias("_was"))
    return carried.join(previous, ["document", "page"], "left").select(
        "document", "page", "opens", "active", F.coalesce("_was", F.lit(False)).alias("active_before")
    )


def _python_list(cells: Column) -> Column:
    """A list of strings the way Python prints it."""

    def quoted(c: Column) -> Column:
        escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
        single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
        double = F.concat(F.lit('"'), escaped, F.lit('"'))
        return F.when(c.isNull(), "None").when(c.contains("'") & ~c.contains('"'), double).otherwise(single)

    return F.concat(F.lit("["), F.array_join(F.transform(cells, quoted), ", "), F.lit("]"))


def table_candidates(pages: DataFrame) -> DataFrame:
    """Names from the rows of accepted list tables."""
    # tables with a name column are few next to the pages; they are read several times below
    tables = durable(list_tables(pages))
    states = list_pages(tables).select("document", "page", "active_before")
    accepted = tables.join(states, ["document", "page"]).filter(
        F.col("page_lists") | (F.col("active_before") & F.col("has_page"))
    )
    body = F.slice("rows", F.lit(2), F.size("rows"))
    return (
        accepted.select(
            "document", "page", "table_pos", "name_col",
            F.concat(F.lit("header="), _python_list(F.element_at("rows", 1))).alias("header"),
            F.posexplode(body).alias("row_pos", "row"),
        )
        .filter(F.col("name_col") < F.size("row"))
        .select(
            label(F.get(F.col("row"), F.col("name_col"))).alias("name"), "document", "page",
            F.lit("fund_list_table").alias("method"), _evidence(F.col("header")).alias("evidence"),
            _seq(F.col("table_pos"), F.col("row_pos")).alias("seq"),
        )
    )


def extract_candidates(pages: DataFrame) -> DataFrame:
    """All valid candidates of a page table."""
    parts = [relation_candidates(pages), label_candidates(pages), title_candidates(pages), table_candidates(pages)]
    return keep_valid(reduce(DataFrame.unionByName, parts)).select(*CANDIDATE_COLUMNS)
