#: Null and empty texts, blanks, ties, repeated rows, a null id, a null source, a long text.
ODD = [(1, None, "a"), (2, "", "a"), (3, " \n ", None), (4, "one two three four", "b"), (5, "one two three four", "b"), (5, "one two three four", "b"), (None, "one word more", "b"), (6, "word " * 30000, "c"), (7, "é 😀 ñ", "c"), (8, "x" * 50000, "c")]
