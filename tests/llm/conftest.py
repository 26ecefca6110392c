import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): random prose with exact and near copies, repeated lines, null and empty texts, and a long text."""
    rng = random.Random(11)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(900)]

    def prose(n):
        words = [rng.choice(vocabulary) for _ in range(n)]
        return "".join(w + (".\n" if rng.random() < 0.07 else " ") for w in words).strip()

    docs = [(i, prose(rng.randrange(3, 260))) for i in range(60)]
    passage = prose(70)
    for i in range(60, 80):
        docs.append((i, prose(40) + "\n" + passage + "\n" + prose(30)))
    long = docs[7][1].split(" ")
    for i in range(80, 110):  # near copies of one text
        words = list(docs[8][1].split(" ") * 2)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = "zz"
        docs.append((i, " ".join(words)))
    docs += [(110 + i, docs[5][1].replace(" ", "  " if i % 2 else " ")) for i in range(8)]
    docs += [(200, None), (201, ""), (202, " \n\t "), (203, "a"), (204, "a b"), (205, "é漢😀 ▁ x\n\n" * 30), (206, " ".join(long * 40)), (207, "x" * 5000), (None, "the null id " + prose(20))]
    return docs


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns that clash with names the operators use inside."""
    rows = [(i, t, "n", 1.5, None, b"x") for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id bigint, text string, node string, score double, line int, blob binary").repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, id int")
