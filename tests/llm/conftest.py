import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text[, source]) tuples, with columns whose names clash with an operator's own."""

    def made(rows, *extra):
        extra = extra or ("tokens",)
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *("x" for _ in extra)) for r in rows]
        return spark.createDataFrame(full, ", ".join([DOCS, *(f"{c} string" for c in extra)])).repartition(3)

    return made
