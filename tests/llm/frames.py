"""Small tables with the odd cases that every operator must take."""

PROSE = "the old river runs past the quiet mill and over the weir into the green valley below where the children play"


def edge_rows():
    """(doc_id, text, lang, source, n_chars, and three columns whose names operators use inside)."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "word " * 30_000, "en", None, 150_000),
            (5, PROSE, "en", "b", 99), (5, PROSE, "en", "b", 99), (6, PROSE.upper(), "en", "a", 99), (7, "é漢😀 x", "fr", "c", 5),
            (8, "." * 500, "de", "c", 500), (9, PROSE + " today", "en", "c", 110), (None, PROSE, "en", "b", 99),
            (10, "A.", "es", "a", 2), (11, "a\x01b\x85c d ﬁ", "en", "b", 9), (12, "same size", "en", "z", 9), (13, "size same", "en", "z", 9)]
    return [(*r, i, "x", 1.5) for i, r in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, band string, size double"


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
