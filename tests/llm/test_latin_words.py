"""Words of Latin-1 texts without the pattern."""

import random

from newsdesk.llm import toxicity


def test_latin_texts_skip_the_pattern(monkeypatch):
    """Texts of Latin-1 are parted by their bytes (the pattern was asked before), into the words that the pattern finds."""
    pattern, rng = toxicity._WORD, random.Random(3)
    texts = ["".join(map(chr, range(256))), "Été à l’école", "ÿ_Ÿ ß½ ²a"]
    texts += ["".join(rng.choices([chr(c) for c in range(256)] + ["é", " "] * 40, k=60)) for _ in range(300)]
    want = [pattern.findall(x.lower()) for x in texts]
    assert [toxicity._found(x) for x in texts] == want
    asked = []

    class Watched:
        def findall(self, text):
            asked.append(text)
            return pattern.findall(text)

    monkeypatch.setattr(toxicity, "_WORD", Watched())
    assert [toxicity._found(x) for x in texts] == want
    assert {len(x.encode("latin-1", "ignore")) < len(x) for x in asked} == {True}
