"""Rows that all operators must stand: nulls, empty and very long texts, ties, repeats and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STRANGE = SCHEMA + ", size string, target int, taken int, copies int, shard int, slot int, id int, comp int, score int, kept int, length int, start int, _key int, _h int, _base int, _first int, page int"


def frame(spark, rows, schema=SCHEMA):
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


def syllables(rng, n, parts):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


EN, DE = ["the", "ing", "sh", "wh", "ou", "ea", "th", "er"], ["sch", "ung", "keit", "ein", "zu", "pf", "ß", "ä"]


def odd_documents(seed=1):
    rng = random.Random(seed)
    rows = [(i, syllables(rng, rng.randint(1, 300), EN if i % 3 else DE), "en" if i % 3 else "de", f"s{i % 5}", 1) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "", 0), (102, "   \n\t ", None, "s0", 6), (103, "one", "en", "s0", 3), (104, "12 34 !!", None, "s1", 8), (105, "日本語 ёлка", None, "s1", 8)]
    rows += [(110 + i, rows[1][1], "en", "hot", 1) for i in range(40)]
    rows += [(160, "long " + syllables(rng, 30_000, EN), "en", "s2", 1), (161, "x" * 50_000, None, "s2", 1)]
    return rows


def thue_morse(n, letters="ab"):
    """2**n letters; with its complement it has equal polynomial hashes, whatever the base, modulo 2**64 from n = 10 on."""
    return "".join(letters[i.bit_count() & 1] for i in range(1 << n))
