"""Pages wrapped in forms or hidden elements, tags that never end, and time in proportion to the page."""

from __future__ import annotations

import time

import pytest

from folioscope.llm.html_paths import main_text

PASSAGE = "This is a whole passage of the page, with sentences, commas, and more than eighty characters in it."


@pytest.mark.parametrize("wrapper", ["<form>{}</form>", "<menu>{}</menu>", "<div hidden>{}</div>", '<div aria-hidden="true">{}</div>', '<div style="display: none">{}</div>'])
def test_a_wrapper_around_the_page_keeps_its_text(wrapper):
    inner = f"<nav>Home Shop</nav><div><p>{PASSAGE}</p><p>Short.</p></div><footer>Imprint</footer>"
    assert main_text(f"<body>{wrapper.format(inner)}</body>") == f"{PASSAGE}\n\nShort."


def test_a_wrapper_beside_the_article_stays_out():
    for wrapped in (f"<form>{PASSAGE} {PASSAGE}</form>", f"<div hidden><p>{PASSAGE} {PASSAGE}</p></div>"):
        assert main_text(f"<body>{wrapped}<article><p>{PASSAGE}</p></article></body>") == PASSAGE
    assert main_text(f"<article><p>{PASSAGE}</p><form><label>Mail</label><button>Send</button></form></article>") == PASSAGE


def test_a_form_without_a_passage_is_no_text():
    assert main_text("<form><label>Name</label><label>Password</label></form>") == ""


def test_tags_that_never_end_are_text_and_open_quotes_end_at_the_angle():
    assert main_text("<p>1 < 2 and a <b unclosed") == "1 < 2 and a <b unclosed"
    assert main_text(f'<p class="x>{PASSAGE}</p><p>More of it, as it were.</p>') == f"{PASSAGE}\n\nMore of it, as it were."


@pytest.mark.parametrize("piece", ["<div>", "<div>a ", "<p>one. ", "<ul><li>a ", "<div>a</span>", "<a ", '<a href="x>t '])
def test_time_grows_with_the_page(piece):
    def seconds(n: int) -> float:
        page = piece * n
        begin = time.process_time()
        main_text(page)
        return time.process_time() - begin

    seconds(1000)
    # Four times the page takes four times as long and not sixteen times; the rest allows for a noisy machine.
    assert seconds(40_000) < 9 * seconds(10_000) + 0.3
