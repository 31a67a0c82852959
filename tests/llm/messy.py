"""Rows that operators must bear: nulls, empty and long texts, repeats, other columns with likely names."""

import random

CLASHES = "id n kept digest h w lines k b key node component host row start length score n_lines n_words doc tag s name span keep_id n_dropped kept_text ranges".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def texts() -> list[tuple]:
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    passage = " ".join(rnd.choices(words, k=50))
    base = rnd.choices(words, k=80)
    near = list(base)
    near[40] = "changed"
    long = " ".join(rnd.choices(words, k=30000)) + " " + passage
    line = "This very line is shared by several documents."
    rows = [
        (1, "plain text"), (2, None), (3, ""), (None, "plain text"), (4, "plain text"), (4, "plain text"), (None, None), (5, " \t\n "),
        (6, " ".join(base)), (7, " ".join(near)), (8, " ".join(base).upper()), (9, long), (10, "x" * 100_000),
        (11, f"{' '.join(rnd.choices(words, k=60))} {passage} {' '.join(rnd.choices(words, k=20))}"), (12, f"{passage} tail"),
        (13, f"{line}\nown line number thirteen\n\n  {line.upper()}\t"), (14, f"first line of fourteen\n{line}\n{line}"), (15, line),
        (16, "again " * 200), (17, "a\x0bb\x0cc\rd e\x1cf g"), (18, "né ünï 中文 😀 mixed"), (19, "again " * 90), (-3, " ".join(base)),
    ]
    return rows


def rows(extra: str | None = "other") -> list[tuple]:
    out = []
    for i, (doc, text) in enumerate(texts()):
        source = None if i == 3 else f"src{i % 3}"
        out.append((doc, text, None if i == 5 else "en", source, None if text is None else len(text), *[extra] * len(CLASHES)))
    return out


def frame(spark, empty: bool = False):
    return spark.createDataFrame([] if empty else rows(), SCHEMA)
