"""Rows that every operator has to bear."""

#: Nulls, empty and blank texts, ties, repeated rows, odd white space, marks and a long text.
ODD = [
    (5, "the cat sat on the mat"), (3, None), (4, ""), (1, "  two  spaces \n\n and\ttabs "), (1, "second text with key one"),
    (2, "x"), (2, "x"), (None, "no key"), (7, "é漢字 ñ  z 123,456.78 ''ll don't <|endoftext|> \x00\x1c"), (9, "word " * 20_000),
    (8, "a" * 5_000), (10, "\n"), (11, " "),
]
