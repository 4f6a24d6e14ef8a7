"""Rows that every operator has to take."""

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One  two\nthree four"), (6, "é" * 3000), (7, "a b c d e f " * 4000), (7, "a b c d e f " * 4000), (None, "no id at all"), (8, "<|endoftext|> \x00 \x1c x  y"), (9, "ΑΣ ς ﬁ ² ½ 漢字 　 x")]
