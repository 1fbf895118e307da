"""Small inputs with everything odd in them."""

import random
import re

from cartlens.llm.common import read

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns with names that operators use themselves, or that differ in case only.
CLASHING = "TEXT string, size int, h long, key string, place int, fingerprint string, list int, pool string, item int"


def words(text):
    return WORD.findall(text or "")


def prose(seed, n, alphabet="abcdefgh"):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(alphabet) for _ in range(draw.randint(1, 7))) for _ in range(n))


def odd_rows():
    shared = prose("shared", 60)
    rows = [
        (1, "", "en", "a"), (2, None, "en", "a"), (3, prose("long", 6000), "en", "b"), (4, shared, "en", "a"),
        (4, shared, "en", "a"), (5, shared, "en", None), (None, shared, None, None), (None, None, None, None),
        (6, prose(6, 30) + " " + shared + "\n" + prose(7, 30), "fr", "b"), (7, "123 !!! ...", None, "b"),
        (8, "Ünï\tcodé 日本語 😀\r\n" + shared + " É", "de", "ß"), (9, "tick " * 300, "en", "a"), (10, "tick " * 200, "en", "a"),
        (11, prose(11, 40), "en", "a"), (12, prose(12, 40), "en", "c"), (-3, shared + " end", "en", "c"),
        (13, "<|endoftext|> it's <|startoftext|>", "en", "a"), (14, " \t\n ", "en", "a"),
    ]
    return [(*row, len(row[1] or "")) for row in rows]


def odd_documents(spark, rows=None):
    """The odd rows (doc_id, text, lang, source, n_chars) among clashing columns."""
    rows = odd_rows() if rows is None else rows
    clashing = tuple(None for _ in CLASHING.split(","))
    return spark.createDataFrame([(*row, *clashing) for row in rows], f"{SCHEMA}, {CLASHING}").repartition(3)


def documents(spark):
    return read(spark, SMALL, "documents")
