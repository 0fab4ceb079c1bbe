"""Odd documents that every operator must take: nulls, empty and long texts, repeated rows, more columns with odd names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, `a.b` string, tokens int"


def odd_documents(spark):
    long = "Long words and more of them, said once again. " * 4000
    rows = [
        (1, None, "en", "src0"), (2, "", "en", "src0"), (3, " \n\t ", None, None), (None, "A text without an id. It has words.", "en", "src1"),
        (4, long, "fr", "src0"), (5, long, "fr", "src0"), (6, "password = abcdefghijkl0123 and more é ü 漢字 words here", "de", "src2"),
        (6, "password = abcdefghijkl0123 and more é ü 漢字 words here", "de", "src2"), (7, "one", "es", "src0"), (8, "x\x00y idiot 0123456789abcdef0", "en", "src3"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "k", 3, "ab", 5) for r in rows], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
