"""Words that the packing's tokenizer gives to the merges alone."""

import random

import numpy as np
import public_tokenizers

from newsdesk.llm import packing


def test_plain_words_skip_the_pattern():
    """Plain words and numbers, with a stop or none, never reach the library's pattern (all did before); ids are its own."""
    tok = packing.ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    want = packing.ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json")).library
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZÀÖØßöøÿĀıſƀƻǃɏ"

    class Pattern:
        asked = 0

        def encode_batch_fast(self, texts, **_):
            self.asked += len(texts)
            return want.encode_batch_fast(texts, **_)

    tok.library = Pattern()
    for _ in range(300):
        words = ["".join(rng.choices(letters, k=rng.randint(1, 14))) if rng.random() < 0.8 else str(rng.randrange(10**6)) for _ in range(30)]
        text = " ".join(w + rng.choice(["", "", ",", "."]) for w in words)
        assert tok.encode(text) == np.array(want.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    assert tok.library.asked == 0
    mixed = " a1 é× 2½ x_y ·Ł. Ǝ7, ɐb ª"
    assert tok.encode(mixed) == np.array(want.encode(mixed, add_special_tokens=False).ids, "<u4").tobytes() and tok.library.asked > 0
