"""Documents and vectors with everything that operators must bear: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

WORDS = "the of and to in is it on by with was for as at be this that are from not".split()
CLASHING = ["fingerprint", "component_id", "key", "fp", "row", "word", "length", "score", "kept", "held_out", "lang_pred", "part", "ord", "rank", "bucket", "ids", "__key", "n"]


def text(seed: int, n: int) -> str:
    out, x = [], seed + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x // 7 % len(WORDS)] + ("x" * (x // 991 % 4)))
    return " ".join(out)


def rows() -> list[tuple[int | None, str | None, str | None]]:
    base = [(i, text(i, 40 + i), "en") for i in range(20)]
    odd = [(100, None, "en"), (101, "", None), (102, "   \n\t ", "de"), (103, "one", "en"), (104, "one two", "en"), (105, text(7, 30_000), "en"), (106, "é ß 北京 \x00 <|endoftext|> ½ ٣", None), (None, text(3, 43), "en"), (None, None, None), (107, "x" * 60_000, "en")]
    return base + odd + [(200, text(3, 43), "en"), (201, text(3, 43) + " tail", "en"), (3, text(3, 43), "en"), (202, "", "en"), (203, "der die das und ist " * 20, "de"), (204, "und das ist die der " * 20, "de")]


def documents(spark, data=None):
    data = rows() if data is None else data
    df = spark.createDataFrame([(*r, "src", None) for r in data], "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *(f"'clash' as `{c}`" for c in CLASHING))


def nothing(spark):
    return documents(spark, [])


def labels(spark, data=None):
    data = [(i, 1, 0) for i in range(20)] + [(203, 0, 0), (204, 0, 1), (None, 1, 0), (19, None, 0)] if data is None else data
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")
