import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def texts():
    """Small documents with the awkward cases: null, empty, blanks only, copies, near copies, one very long."""
    import random

    rng = random.Random(5)
    prose = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 300)) for _ in range(n)) for n in (3, 4, 40, 120, 400)]
    near = prose[3].split()
    near[60] = "changed"
    long = " ".join(rng.choice(WORDS) for _ in range(9000)) + "x" * 30_000
    return [
        (0, None), (1, ""), (2, " \t\n"), (3, prose[0]), (4, prose[1].upper()), (5, prose[1]), (6, prose[2] + ".\n" + prose[2] + "."), (7, prose[3]), (8, " ".join(near)), (9, prose[3].replace(" ", "  ")),
        (10, prose[4]), (11, prose[4]), (11, prose[4]), (None, prose[4]), (None, None), (12, long), (13, "Füße 漢字 <|endoftext|> 'tis don't 12 34   é 😀" * 3), (14, "word " * 50), (15, "a b c"), (16, "A B C"),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The same with the columns of documents and others whose names operators use themselves."""
    rows = [(i, t, "en", None if n % 3 else "src0", None, "x", n, True) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, size int, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")
