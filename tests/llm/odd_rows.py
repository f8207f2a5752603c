"""Rows that every operator must take: nulls, blanks, odd characters, ties, repeated rows, long texts, clashing columns."""

LONG = "alpha beta gamma delta " * 4000 + "omega"
ODD = [
    (1, "The quick brown fox jumps over the lazy dog. The quick brown fox jumps over the lazy cat."),
    (2, "The  quick brown\tfox jumps over\n the lazy dog. The quick brown fox jumps over the lazy cat."),
    (3, None), (4, ""), (5, " \t\n "), (6, "one"), (7, "one two"), (7, "one two"), (None, "one two"), (None, None),
    (8, LONG), (9, LONG), (10, "Café ÉCOLE naïve İstanbul ſoft 中文 テスト ①②  x y\x1cz\x85q 'S it's DON'T"),
    (11, "á ë <|endoftext|> <|startoftext|>x<|endoftext|> !!'s ''' 123 4.5　end "),
    (12, "   \n\n  spaces   between \n lines\n\n\n"), (13, "x" * 30000), (14, "   a  b"),
]


def frame(spark, rows=ODD):
    """The rows with columns whose names an operator might use itself."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, class string, label int"
    made = [(i, t, "en" if i else None, "s1" if i and i % 2 else None, len(t or ""), "d", "c", 1) for i, t in rows]
    return spark.createDataFrame(made, schema)


def by_row(df, *columns):
    """The result as a sorted list of tuples."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
