import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF_SMALL = "/root/testdata/sf0.001"

#: Texts that have broken something like this before.
NASTY = [
    None, "", " \t\n", "a", "one two", "Word", "x" * 30_000, "1 2 " * 4_000, "1.2." * 3_000, "a.b." * 2_000 + "c@d.e",
    "a@b.com_x@y.org, q@w.co", "10.0.0.1.5.6.7.8 and 300.1.1.1 and 001.02.3.255", "+1 (947) 555-7668 ext", "+1", "++12 34 56 78 90",
    "card 4111 1111 1111 1111 ok", "4111-1111-1111-1112", "4111  1111 1111 1111", "4111111111111111 4111111111111111", "5" * 40,
    "konto DE89 3704 0044 0532 0130 00.", "ssn 123-45-6789", "123-45-6789", "é@ü.de a@b.de", "\U0001F600 +49 30 1234567 \U0001F600",
    "Released under the MIT License.", "under the mit license", "UNDER  THE--MIT license, under the MIT License",
    "Licensed under the Apache License, Version 2.0.", "apache license version 2", "apache license version 20", "CC-BY-NC 4.0", "cc by nc cc by nc",
    "This work is licensed under the GNU Lesser General Public License, version 3.", "in the public domain", "Kelvin under the mit license",
    "same line\nsame line\n\nother\nsame line ", "a b c a b c a b c", "# * $ % & | < >", "The quick brown fox jumps over the lazy dog " * 12,
    "mañana\u0085x\u001cy z", "THE QUICK brown", "the quick BROWN", "\x00 zero", "a\rb\r\nc",
]


def documents(spark, texts, extra=()):
    rows = [(i, t, ("en", "de", None)[i % 3], (None, "b", "a", "\U00010000", "￿")[i % 5], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


@pytest.fixture(scope="session")
def nasty(spark):
    """Nasty rows, some of them twice, one without an id."""
    again = [(3, "a", "en", "\U00010000", 1), (3, "a", "en", "\U00010000", 1), (None, "no id at all", None, None, None)]
    return documents(spark, NASTY, again).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(rng: random.Random, n: int, words=("ab", "cde", "fgh", "i", "jk", "lmn", "op", "q", "rst", "uvw")) -> str:
    return " ".join("".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(n))
