import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from folioscope import schemas  # noqa: E402
from folioscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=4, shuffle_partitions=4, memory="4g", shared=tempfile.mkdtemp(prefix="run-"))


def block(text, y, size=10.0, bold=False):
    return (text, [0.0, float(y), 500.0, y + 12.0], float(size), bold)


def page(document, number, blocks, tables=(), charts=()):
    text = "\n".join(b[0] for b in blocks)
    return (document, number, text, list(blocks), list(tables), list(charts), [], text)


def table(rows, bbox=(0.0, 400.0, 500.0, 480.0)):
    return (list(bbox), rows)


@pytest.fixture(scope="session")
def pages(spark):
    """A two-entity prospectus, a one-entity leaflet and an entity-free rights document."""
    rows = [
        page(
            "handbook.pdf", 1,
            [block("List of sub-funds", 20, 16, True), block("What applies to every sub-fund.", 60)],
            [
                table([["Name", "Page"], ["Maple Growth Fund", "2"], ["Willow Bond Fund", "p. 3"]], (0.0, 100.0, 500.0, 180.0)),
                table([["Name", "Role"], ["Jane Example", "Chair"], ["John Sample", "Member"]], (0.0, 220.0, 500.0, 300.0)),
            ],
        ),
        page(
            "handbook.pdf", 2,
            [
                block("Maple Growth Fund", 20, 16, True), block("Objective", 50, 13, True),
                block("Maple buys shares around the world.", 80), block("Main risks", 110, 13, True),
                block("Prices may fall at any time.", 140),
            ],
        ),
        page(
            "handbook.pdf", 3,
            [block("Willow Bond Fund", 20, 16, True), block("Objective", 50, 13, True), block("Willow earns steady interest.", 80)],
        ),
        page(
            "leaflet.pdf", 1,
            [block("Product Name: Maple Growth Fund", 20, 14, True), block("Objective", 55, 12, True), block("It aims at long-term growth.", 85)],
        ),
        page(
            "rights.pdf", 1,
            [
                block("Passing on units", 20, 15, True),
                block("Holders may pass their units on to any other person within the law.", 55),
                block("Each change is entered in the register.", 85),
            ],
        ),
    ]
    return spark.createDataFrame(rows, schemas.PAGES).cache()


@pytest.fixture(scope="session")
def corpus(pages):
    from folioscope.plans.index import build_corpus

    return build_corpus(pages, max_words=120, min_words=10, overlap_words=20)
