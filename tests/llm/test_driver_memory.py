"""What the driver holds while op1's model is fitted."""

import weakref

from newsdesk.llm import toxicity


def test_one_index_at_a_time(spark, monkeypatch):
    """A fold's index is gone before the next one is made, and the folds' indexes before the model's."""
    made, before = [], []

    class Watched(toxicity.Index):
        def __init__(self, *args):
            before.append(sum(ref() is not None for ref in made))
            made.append(weakref.ref(self))
            super().__init__(*args)

    monkeypatch.setattr(toxicity, "Index", Watched)
    rows = [(k, f"plain words number {k} of many" if k % 2 else f"vile hateful slur number {k}", 1 - k % 2) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert before == [0] * (toxicity.FOLDS + 1)
