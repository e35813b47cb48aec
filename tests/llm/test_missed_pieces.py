"""A piece of ASCII letters that the encoder has not seen is known for a word without the pattern."""

import re
from array import array

import public_tokenizers
import pytest

from chronoframe.llm import tokens


class Counted:
    """A pattern that keeps what it is asked."""

    def __init__(self, inner):
        self.inner, self.asked = inner, []

    def fullmatch(self, piece):
        self.asked.append(piece)
        return self.inner.fullmatch(piece)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ascii_words_ask_no_pattern(monkeypatch, name):
    asked = []
    for pattern in [k for k, v in vars(tokens).items() if isinstance(v, re.Pattern) and k in ("WORD", "TAILED")]:
        monkeypatch.setattr(tokens, pattern, counted := Counted(getattr(tokens, pattern)))
        asked.append(counted.asked)
    own = tokens.Encoder(public_tokenizers.path(name))
    text = "Plain words, and-more *** of them!! xª ºo × été, naïve. a1 'tis"
    assert own.ids([text]) == [array("I", own.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()]
    assert not [p for a in asked for p in a if p.isascii()]
