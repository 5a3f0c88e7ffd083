import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows; one extra column with a clashing name."""

    def make(rows, extra="size"):
        full = [(*r, *("en", "a")[len(r) - 2 :]) if len(r) < 4 else tuple(r) for r in rows]
        data = [(*r, None if r[1] is None else len(r[1]), "x") for r in full]
        return spark.createDataFrame(data, f"{DOC}, {extra} string").repartition(3)

    return make
