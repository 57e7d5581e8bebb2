import pytest

ODD = [None, "", " ", "\n\n", "one", "a b c d e", "Ünï çödé 中文 😀", "x" * 5000, "w " * 3000, "a\0b\tc\x0bd", "<P> in <S> it <M>", "one line\nanother\n", "one line\nanother\n", "\nlast", "Straße STRASSE ǅ"]


@pytest.fixture(scope="module")
def hostile(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns named like the operators' own."""
    rows = [(k, t, 7, 7, 7, "z") for k, t in enumerate(ODD)] + [(None, "a b c d e", None, None, None, None), (3, "again another", 1, 1, 1, None), (5, "a b c d e", 7, 7, 7, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, fim int, id int, _row int, component_id string").repartition(3)
