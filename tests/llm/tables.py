"""Small tables with what may go wrong: nulls, empty and long texts, ties, repeats and extra columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, spans string, cid string"
WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa quebec romeo sierra tango".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) * (rng.random() < 0.5) for _ in range(n))


PASSAGE = prose("passage", 70)


def rows():
    base = prose("base", 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    texts = [
        base,  # 0
        near,  # 1, like 0
        base,  # 2, the same as 0
        None,  # 3
        "",  # 4
        "  \n\t ",  # 5
        "two words",  # 6
        "two  Words",  # 7, the same words
        prose("a", 80) + " " + PASSAGE + " " + prose("b", 40),  # 8
        prose("c", 30) + "\n" + PASSAGE + " " + prose("d", 90),  # 9, shares a passage with 8
        "x" * 3000,  # 10, overlaps itself
        prose("long", 6000),  # 11
        "é中文🎉 don't 's    end ",  # 12
        prose("lone", 100),  # 13
    ]
    out = [(i, t, "en", "src0", len(t or ""), "s", "t", "c") for i, t in enumerate(texts)]
    out.append((None, "no id at all here", None, None, None, None, None, None))
    out.append((13, prose("lone", 100), "en", "src1", 1, None, None, None))  # a row again
    return out


def documents(spark, some=None):
    data = rows() if some is None else some
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
