"""Documents of every awkward kind."""

KIND = "doc_id long, text string, lang string, source string, n_chars long, key int, kept string, block string, row int, fp string"
LONG = " ".join(f"word{i % 811} and{i % 7}" for i in range(30000))
SHARED = "This line is held by several documents of the table."
PASSAGE = "a passage of more than fifty bytes that repeats in several documents, word for word, without a change"


def documents(spark, rows=None):
    """(doc_id, text, lang) with clashing further columns."""
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(k, t, lang, f"src{(k or 0) % 2}", len(t or ""), 1, "x", "y", 2, "z") for k, t, lang in rows], KIND)


ROWS = [
    (1, f"First text here.\n{SHARED}\n  {SHARED.upper()} \nshort", "en"),
    (2, f"{SHARED}\t\n{SHARED}\nAnother text about rivers and hills", "en"),
    (3, SHARED, "fr"),
    (3, f"{SHARED}\nsame id again", None),
    (4, None, "en"),
    (5, "", None),
    (6, " \n\t\n", "de"),
    (None, f"{SHARED}\nno id at all", "en"),
    (7, LONG, "en"),
    (8, LONG + f"\n{SHARED} \r\n{PASSAGE}", "en"),
    (9, f"x {PASSAGE} y", "es"),
    (10, f"{PASSAGE[:60]} but then it goes on é ñ ü {PASSAGE[30:]}", "es"),
    (11, "12345 %%% 678", "en"),
    (11, "12345 %%% 678", "en"),
    (12, "éééé ñññ\x0b\x0c" * 40, "es"),
    (13, "a" * 3000, None),
    (14, "a" * 500 + "b", None),
    (-5, "Ein Satz mit vielen deutschen Wörtern über den Fluß und die Hügel", "de"),
]
