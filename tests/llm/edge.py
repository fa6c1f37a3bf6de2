"""Documents with everything awkward: nulls, empties, ties, repeats, long texts, and clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words int, fp string, hits string, id string, block int, copies string, gone string, kept boolean"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(n))


def texts():
    passage = words(1, 60)
    return [
        (1, words(2, 120) + " " + passage + "\n" + words(3, 5)),
        (2, "Start " + passage + " end"),
        (3, passage),
        (4, passage),
        (4, passage),  # a repeated row
        (5, None),
        (6, ""),
        (7, " \t\n\x0b\f\r "),
        (8, "one"),
        (9, "\n".join(f"line number {i} of a text" for i in range(6))),
        (10, "other start\n" + "\n".join(f"line number {i} of a text" for i in range(6)) + "\nother end"),
        (11, words(4, 30000)),  # very long
        (12, "é ü ß " + words(5, 60) + " ’’ 漢字 \U0001f600"),
        (13, "ab " * 300),
        (None, passage + " " + words(6, 10)),
        (15, "same\nsame\nsame\nsame\nsame"),
        (16, "x" * 5000),
        (17, words(2, 119) + " changed " + passage),
        (18, "A b\nb c\n\n c d\nd e\ne f"),
        (19, "A b\nb c\nc d\n\nd e\nx y"),
    ]


def rows():
    return [(i, t, None if i in (3, 6) else "en", None if i in (2, 9) else f"s{(i or 0) % 3}", None if t is None else len(t), 0.5, 3, "f", "h", "i", 1, "c", "g", True) for i, t in texts()]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
