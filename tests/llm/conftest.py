import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, fp string, start int, score double"


def _rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))
    make = lambda n: " ".join(word() for _ in range(n))
    passage, near = make(60), make(300).split()
    texts = [
        None, "", " \t\n ", "one", "Two  Words", "Three still one",
        make(20) + " " + passage + " " + make(30), make(5) + "\n" + passage + make(40),
        passage, "x y " * 60, "same line of words here\n" * 40,
        "code CC BY, then the GENERAL public licence; general public license. All rights reserved! ccİ by",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without any restriction",
        "<|endoftext|> ids 中文 \x1c \x85 'll 12²", make(30_000), "K" * 50_000,
        " ".join(near), " ".join(near[:150] + ["changed"] + near[150:]), " ".join(near),
    ]
    texts += [make(rng.randint(1, 400)) for _ in range(40)]
    rows = [(i * 5 if i % 7 else i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or ""), -1, "x", 7, 0.5)
            for i, t in enumerate(texts)]
    rows += [rows[16], rows[16], rows[20]]                      # repeated rows
    rows += [(None, texts[6], None, "s0", None, None, None, None, None), (None, None, *[None] * 7)]
    return rows


@pytest.fixture(scope="session")
def doc_rows():
    return _rows()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    """Documents with every kind of odd row, repeats, and extra columns with clashing names."""
    return spark.createDataFrame(doc_rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
