"""Documents with the awkward cases, and extra columns whose names clash with names inside the operators."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, key string, size string, shard string, items string, bits string"

WORDS = [f"w{k}" for k in range(400)]


def text(first: int, n: int) -> str:
    return " ".join(WORDS[(first + 7 * k + k * k) % len(WORDS)] for k in range(n))


def rows() -> list[tuple[int | None, str | None]]:
    return [
        (None, None), (None, text(3, 30)), (1, None), (2, ""), (3, "  \t\n"), (4, "a"), (5, "a"), (5, "a"), (6, "Ä é ß"), (7, "12 34 !!"),
        (8, text(1, 60)), (9, text(1, 60).upper()), (10, text(1, 60)), (10, text(1, 60)), (11, text(1, 60) + " extra end"), (11, text(90, 25)),
        (12, " ".join(["x"] * 50)), (13, " ".join(["x"] * 31)), (14, text(5, 40) + " " + text(200, 20)), (15, "other start " + text(200, 20) + "\nand on"),
        (16, " ".join(text(k, 997) for k in range(40))), (17, text(8, 13)), (18, text(8, 12)), (19, "a\x0bb\x0cc d e " * 5), (-4, text(1, 60)),
    ]


def documents(spark, data=None):
    data = rows() if data is None else data
    filled = [(i, t, "xx" if k % 3 else None, f"src{k % 4}" if k % 5 else None, None, "r", "k", "z", "s", "i", "b") for k, (i, t) in enumerate(data)]
    return spark.createDataFrame(filled, SCHEMA)


def ascii_lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def blank_words(t: str | None) -> list[str]:
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", t or "")
