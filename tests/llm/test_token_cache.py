"""Words at the start of a line or with symbols behind them are encoded as words, not by the whole library."""

import random
from array import array

import public_tokenizers
import pytest

from chronoframe.llm import tokens


class Counted:
    """A tokenizer that counts the pieces given to it."""

    def __init__(self, inner):
        self.inner, self.given = inner, []

    def encode(self, piece, **options):
        self.given.append(piece)
        return self.inner.encode(piece, **options)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_lines_and_symbols(name):
    own, r = tokens.Encoder(public_tokenizers.path(name)), random.Random(1)
    plain = own.tokenizer
    own.tokenizer = Counted(plain)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(9))
    texts = ["\n".join(word() + " " + word() + r.choice(["***", "&&&", ",%%%", "$", ".###", ""]) for _ in range(20)) for _ in range(50)]
    for text, found in zip(texts, own.ids(texts), strict=True):
        assert found == array("I", plain.encode(text, add_special_tokens=False).ids).tobytes()
    assert len(own.tokenizer.given) <= 10


def test_line_feeds():
    own = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(2)
    texts = ["".join(r.choice(["a", "Zu", "É", "12", "'s", "!", ".", "***", "&", "#", "$%", "\n", "\n", " ", "日", "\t"]) for _ in range(r.randrange(1, 12))) for _ in range(3000)]
    for text, found in zip(texts, own.ids(texts), strict=True):
        assert found == array("I", own.tokenizer.encode(text, add_special_tokens=False).ids).tobytes(), text
