"""Addresses written out in words, in texts without a digit or an at-sign."""

import pytest

from tessera.llm import pii

WEIGHTS = pii.train(sentences=300, rounds=3)


@pytest.mark.parametrize("address", ["anna.berg at posthaus dot com", "bob(at)host.org", "carla [at] firm [dot] net"])
def test_written_out_addresses(address):
    text = f"please write to {address} today"
    base, spans = pii.find_spans(text, WEIGHTS)
    assert base == [] and spans == [("email", 16, 16 + len(address))]
    assert (16, 16 + len(address)) in pii.candidates(text)


@pytest.mark.parametrize(("text", "found"), [("key = abcdefghij", "abcdefghij"), ("password: hunterzwei", "hunterzwei"), ("write to john dot smith at example dot com", "smith at example dot com"), ("foo(at)bar.org", "foo(at)bar.org")])
def test_spans_without_digits(text, found):
    spans = pii.find_spans(text, WEIGHTS)[1]
    assert [text[a:b] for _, a, b in spans] == [found]


@pytest.mark.parametrize("text", ["We met at home. Then we left", "sit at the end. now", "no address in here"])
def test_prose_is_left_alone(text):
    assert pii.find_spans(text, WEIGHTS) == ([], [])
