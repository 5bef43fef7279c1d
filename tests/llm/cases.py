"""Small tables that every operator has to stand."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, value int, score string, _id int, _th int, _text string, `a.b` int"


def sentence(rng: random.Random, n: int, letters: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    shared, long = sentence(rng, 60), sentence(rng, 30_000)
    return [
        (1, shared),
        (2, shared),
        (3, sentence(rng, 10) + " " + shared + "\n" + sentence(rng, 10)),
        (4, ""),
        (5, None),
        (6, "   \n\t "),
        (7, long),
        (8, "word"),
        (8, "another text with the same id as the one before"),
        (9, shared + " tail"),
        (9, shared + " tail"),
        (None, "no id here but " + sentence(rng, 25)),
        (None, None),
        (10, "… Größe “Œuvre” 東京 İΣ don't <|endoftext|> a\x1fb\x0bc 12,5 km"),
        (11, "12345 678 90"),
        (12, "same same same same " * 12),
        (-13, shared),
    ]


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]] | None = None) -> DataFrame:
    rows = texts() if rows is None else rows
    lang = lambda i: None if i is None or i % 5 == 4 else ("xx", "yy")[i % 2]
    source = lambda i: None if i == 5 else f"s{(i or 0) % 3}"
    return spark.createDataFrame([(i, t, lang(i), source(i), len(t or ""), "x", 1, "s", 2, 3, "t", 4) for i, t in rows], SCHEMA)


def plain(rows: list) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=repr)
