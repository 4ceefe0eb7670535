import re
from statistics import median

from folioscope import schemas
from folioscope.functions import text as tx
from folioscope.operators import discovery

LABEL = re.compile(discovery.LABEL.replace("(?iUd)", "(?i)"))
TERM = re.compile(discovery.FUND_TERM.replace("(?iU)", "(?i)"))
TEXTS = [
    "„Oak  Fund“", "Product name: Elm Trust", " \t.:„Product Name", " ", ";: ,", None, "", "　Elm\nTwo", "product", "ſub-fund name Ash", "Subject: none",
    "\x1cИМЕ НА ФОНДА: Дъб две", "Name: none", "sub fund  name :", "“”", "Following ", "FUND NAME", "Продукт: Бор",
]


def clean(text):
    return " ".join((text or "").split()).strip(tx.LABEL_EDGES)


def odd_pages():
    for k in range(len(TEXTS)):
        texts = TEXTS[k:] + TEXTS[:k]
        blocks = [(t, [0.0] * 4, None if j % 4 == 3 else float(j % 3 * (14 if k % 2 else 5)), None if j % 2 else k % 4 < 2) for j, t in enumerate(texts[: k % 7 + 2])]
        yield (f"d{k}", 1, " „quoted“ funds" if k % 3 else "plain", blocks if k != 4 else None, [], [], [], "")


def test_labels_and_titles_of_odd_blocks(spark):
    pages = spark.createDataFrame(list(odd_pages()), schemas.PAGES)
    labels, titles = set(), set()
    for document, _, text, blocks, *_ in odd_pages():
        kept = [(clean(t), size, bool(bold)) for t, _, size, bold in blocks or [] if clean(t)]
        for at, (t, _, _) in enumerate(kept):
            if m := LABEL.match(t):
                value, after = clean(m[1]), kept[at + 1][0] if at + 1 < len(kept) else None
                if value or after is not None:
                    labels.add((document, value or after, at, clean(t if value else f"{t} | {after}")))
        sizes = [s for _, s, _ in kept if s]
        if text != "plain" and kept:
            top, size, bold = kept[0]
            near = " ".join(t for t, _, _ in kept[:4])
            if (bold or (sizes and size is not None and size >= 1.25 * median(sizes))) and TERM.search(near) and len(top.split(" ")) <= 16:
                titles.add((document, top, clean(near)))
    assert len(labels) > 15 and len(titles) > 3
    assert {(r.document, r.name, r.seq, r.evidence) for r in discovery.label_candidates(pages).collect()} == labels
    assert {(r.document, r.name, r.evidence) for r in discovery.title_candidates(pages).collect()} == titles


def test_titles_are_cleaned_once(spark):
    pages = spark.createDataFrame(list(odd_pages()), schemas.PAGES)
    plan = discovery.title_candidates(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") == 2  # first blocks, evidence; filters on titles cleaned every block again


def test_stripping_looks_at_the_ends_only(spark):
    points = [i for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF and (i < 0x3100 or i % 97 == 0 or chr(i).isspace())]
    rows = [(i, f"{chr(i)}{chr(i)} a{chr(i)}b{chr(i)} ") for i in points] + [(-1, " \n"), (-2, ""), (-3, None), (-4, "a" + "  " * 20_000 + "b\t")]
    df = spark.createDataFrame(rows, "i INT, s STRING")
    trimmed = df.select("i", "s", tx.strip("s").alias("t"))
    assert "regexp_replace" not in trimmed._jdf.queryExecution().executedPlan().toString()  # a pattern is tried at every inner blank
    assert all(r.t == (None if r.s is None else r.s.strip()) for r in trimmed.collect())
