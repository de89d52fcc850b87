"""Small inputs of the operator tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash long, node long, score double, part long"
SPACE = "".join(map(chr, [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]))


def plain_words(text):
    """Words by a plain loop: A-Z in lower case, parted by ASCII white space."""
    out, word = [], ""
    for c in text or "":
        if c in SPACE:
            out += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return out + ([word] if word else [])


def plain_shingles(text, size=5):
    words = plain_words(text)
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def vocabulary(n=400, seed=1):
    dice = random.Random(seed)
    return ["".join(dice.choice("aeioubdkmnst") for _ in range(dice.randint(2, 7))) for _ in range(n)]


def prose(dice, words, n):
    return " ".join(dice.choice(words) for _ in range(n))


def edited(dice, words, text, share):
    return " ".join(dice.choice(words) if dice.random() < share else w for w in text.split(" "))


def documents(spark, rows):
    """Rows of (doc_id, text) as documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None, 1, 2, 0.5, 3) for i, t in rows], DOCS)


ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "one two three four"),
    (6, "ONE two\x0bthree\x0cfour"),
    (7, "Zoë\u00a0naïve \u2003 x"),
    (None, "a text without an id that has more than five words"),
    (8, "same text here in two rows of a table"),
    (8, "same text here in two rows of a table"),
    (9, "same text here in two rows of a table"),
    (10, "long " * 30_000),
    (11, "x" * 200_000),
    (12, "<|endoftext|> it's 12 o'clock, é e\u0301 \u4e2d\u6587!?"),
]
