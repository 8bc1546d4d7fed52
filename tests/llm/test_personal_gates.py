"""Cheap gates before the patterns lose no candidate that a pattern accepts."""

import pytest

from loomspan.llm import personal as P


@pytest.mark.parametrize("text", ["ann [ at ] lab.org", "ann ( at ) lab.org", "ann { AT } lab.org"])
def test_space_inside_the_bracket(text):
    assert P._email(text, text.lower()) == [(0, len(text))]


@pytest.mark.parametrize("before", ["", "\n", " ", "see\n"])
def test_id_at_the_start(before):
    assert P._ids(f"{before}X1234567L") == [(len(before), len(before) + 9)]


@pytest.mark.parametrize("space", [" ", "\t", "\u00a0", "\u2009", "\u202f"])
def test_space_after_a_street_word(space):
    word = P.STREET_NUMBER_LAST.split()[0]
    text = f"{word}{space}Aurora{space}12"
    assert P._ADDRESS_LAST.search(text) and P._may_end_in_number(text.lower())
