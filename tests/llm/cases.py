"""Documents that every operator of the subpackage has to take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, words string, start long, score double"


def awkward(texts):
    """Rows with nulls, an empty and a very long text, ties, repeated rows, and extra columns with clashing names."""
    texts = [*texts, None, "", " \n\t ", "x", "long " * 30_000, "tie same words " * 20, "tie same words " * 20]
    rows = [(i, t, None if i % 3 else "en", "s", None, "k", "w", 1, 0.5) for i, t in enumerate(texts)]
    return [*rows, rows[0]]


def docs(spark, texts, extra=True):
    rows = awkward(texts) if extra else [(i, t, "en", "s", 0, "k", "w", 1, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sample(name, n=300):
    """Texts of a test table, in doc_id order."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pandas().sort_values("doc_id")
    return t.text.tolist()[:n]
