"""Documents with every awkward case, and plain versions of what operators compute."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, id long, fp long, norm string, n long, size long"


def docs(spark, rows):
    """rows of (doc_id, text, lang, source); the other columns clash with names that operators use inside."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 7, 7, "y", 1, 2) for r in rows], DOCS)


AWKWARD = [
    (1, "Hello World again and again, and once more", "en", "a"),
    (2, "hello world again and again, and once more", "en", "a"),
    (3, None, None, None),
    (4, "", "en", None),
    (5, " \n\t ", None, "b"),
    (6, "É ist EIN Text über Öl und vieles mehr, sagte er", "de", "b"),
    (7, "é ist ein text über öl und vieles mehr, sagte er", "de", "b"),
    (8, "one", "en", "c"),
    (8, "one", "en", "c"),
    (9, "12345 67 !!", "en", "c"),
    (None, "a text whose id is missing", "en", "a"),
    (10, "word " * 30000, "en", "a"),
    (11, "HELLO WORLD AGAIN AND AGAIN, AND ONCE MORE", "en", "b"),
]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
