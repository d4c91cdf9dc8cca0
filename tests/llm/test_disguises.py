"""The quick look before the transducers misses nothing, and single spelled digits count."""

import random

import pytest

from pulsegrid.llm import pii

ATS = ["[ AT ]", "( AT )", "{@}", "( @ )", "( at )", "{ at }", "{At}", "<@>", "[  @  ]", "<at>"]


@pytest.mark.parametrize("at", ATS)
@pytest.mark.parametrize("gap", ["", " "])
def test_every_bracket_is_an_at(at, gap):
    text = f"john{gap}{at}{gap}example.com ok"
    assert (0, 0, len(text) - 3) in pii.spans_of(text)[1]


@pytest.mark.parametrize("dot", ["{.}", "<.>", "( . )", "[ . ]", "{ dot }"])
def test_every_bracket_is_a_dot(dot):
    text = f"john@example{dot}com"
    assert pii.spans_of(text)[1] == [(0, 0, len(text))]
    text = dot.join(["10", "0", "0", "1"])
    assert pii.spans_of(text)[1] == [(1, 0, len(text))]


@pytest.mark.parametrize("text", [
    "10.0.zero.1", "ten 10 dot zero dot 0 dot one"[4:], "one.two.three.four", "one dot two dot three dot four", "one nine two dot one six eight dot 1 dot One",
    "10[.]zero[.]0[.]TWO", "+1 555  five 5 5 5  0 1"])
def test_single_spelled_digits(text):
    base, every = pii.spans_of(text)
    assert base == [] and len(every) == 1 and every[0][1:] == (0, len(text))


@pytest.mark.parametrize("text", ["Take one. Two are left.", "phone.x tone.y", "someone.else", "one.two.three"])
def test_plain_words_stay(text):
    assert pii.spans_of(text) == ([], [])


def test_gate_agrees_with_no_gate(monkeypatch):
    rng = random.Random(8)
    bits = ["john", "example", "com", "10", "0", "4111", "1111 1111 1111", "555", " ", "  ", "-", ".", "@", "+", "\n", "plus ", " ", "a", ",",
            "one", "Two", "SEVEN", " five", "zero ", " dot ", " DOT ", " Dot ", " at ", " AT ", "(", "[", "{", "<", ")", "]", "}", ">", "at", "At", "AT", "dot", "Dot", *ATS]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(60_000)]
    gated = [pii.spans_of(t) for t in texts]
    monkeypatch.setattr(pii, "_disguised", lambda t: True)
    assert [t for t, g in zip(texts, gated) if g != pii.spans_of(t)] == []
    assert sum(len(b) < len(e) for b, e in gated) > 50
