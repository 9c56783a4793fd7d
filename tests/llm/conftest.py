import random

import pytest

# Names that the operators use themselves.
CLASHES = ["row", "key", "mix", "ids", "counts", "kept", "w", "h", "removed_lines", "gone", "stratum", "packed", "mix_source"]


def made_texts():
    """Texts with copies, near copies, shared lines and passages, and odd ones."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage, line = prose(60), prose(9)
    texts = [prose(rng.randint(1, 150)) for _ in range(30)]
    base = prose(120)
    texts += [base] * 5 + [base.replace(" ", "  "), base + "\n", base.upper()]
    for _ in range(12):  # near copies of a text and of each other
        changed = base.split()
        changed[rng.randrange(120)] = "changed" + str(rng.random())
        texts.append(" ".join(changed))
    texts += [prose(20) + "\n" + passage + "\n" + prose(20) for _ in range(4)]
    texts += [line + "\n" + prose(30) + "\n" + line[:-1] + "\n" + line[1:] for _ in range(4)]
    texts += [None, "", " ", "\n\t\n", "one", "two words", "a b c d", "a b c d", "a b c d e", "é ñ ü 漢字 ▁ x", "x" * 450, "x" * 450]
    texts += ["word " * 400, prose(20_000), "#$%&*|<> ## $$", "1234 5678", "Ab\r\nab\rab", "tail\n"]
    return texts


@pytest.fixture(scope="session")
def texts():
    return made_texts()


@pytest.fixture(scope="session")
def odd_docs(spark, texts):
    """The texts as documents with null languages and sources and with columns of clashing names."""
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "", "a", "b"][i % 4], *[f"{c}{i}" for c in CLASHES]) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def repeated_docs(spark):
    """Repeated rows and null ids."""
    text = "some words that are long enough for a line of text"
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text + ".", None, "b"), (None, text, "en", None), (None, None, None, None), (3, None, "de", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
