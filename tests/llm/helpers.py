"""Rows with every awkward case: nulls, empty and long texts, ties, repeats, clashing names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep string, row string, id string, block long"


def frame(spark, rows, schema=DOCS):
    """rows: (doc_id, text[, source]); the other columns clash with names used inside the operators."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", "y", "z", 7) for r in rows]
    return spark.createDataFrame(full, schema)


AWKWARD = [
    (1, "The cat sat on the mat. The dog lay by the door of the old house."),
    (2, "the cat SAT on the mat. The dog lay by the door of the old house."),
    (3, None), (4, ""), (5, "   \n\t "), (6, "word"), (6, "word"), (None, "a null id with some text here"), (None, None),
    (7, "é ü 中文 字 😀 <|endoftext|> it's 1234,5  double  spaces\n\n\nlines\r\n tabs\tx"),
    (8, "long " * 30000), (9, "x" * 50000), (10, "The cat sat on the mat. The dog lay by the door of the old barn."),
]
