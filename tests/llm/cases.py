"""Documents with every odd case, for all operators."""

LONG = "word " * 30_000 + "end"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "size string, taken string, n_tokens string, fingerprint string, `group` string, _row string, _carried string, "
    "lines_total string, n_entities string, piece string, score string, host string, `two words` string"
)
CLASH = ("x",) * 13
TEXTS = [
    (1, "The house is on the hill, and the sea is near.\nfooter", "en", "a"),
    (2, "The house is on the hill, and the sea is near.\nfooter", "en", "a"),
    (2, "The house is on the hill, and the sea is near.\nfooter", "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, "b"),
    (5, LONG, "en", "a"),
    (None, "no id here\nfooter", "en", "a"),
    (None, "no id here\nfooter", None, None),
    (6, "12 34 !!", "en", "b"),
    (7, "Das Haus steht auf dem Berg und das Meer ist nah.\r\n \nfooter", "de", None),
    (8, "Ä" * 5000, "de", "b"),
    (9, "日本語 の 文章 です \U0001f600", None, "c"),
    (10, " \t\x0b\n ", "en", "c"),
    (11, "tab\tand more <|endoftext|> ▁ x  y", "en", "c"),
]


def odd_documents(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), *CLASH) for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df):
    return [tuple(r) for r in df.collect()]
