import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, digest string, fp string, part int, score string, shard string, row string, a long, _copies int, held_out string"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(["ka", "lo", "mi", "ré", "tu", "Sen", "or"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def records():
    """(doc_id, text) with copies, near copies, nulls, empty, very long and odd texts, repeated rows and null ids."""
    rng = random.Random(11)
    base = [" ".join(words(rng, rng.randint(1, 90))) for _ in range(30)]
    out = [(k, t) for k, t in enumerate(base)]
    for k in range(12):  # near copies
        w = base[k].split()
        w[rng.randrange(len(w))] = "changed"
        out.append((100 + k, " ".join(w)))
    out += [(200 + k, base[3]) for k in range(15)]  # a group of copies
    out += [(300, ""), (301, None), (302, " \t\n "), (303, "x"), (304, "the\x0bword\u00a0here\u0085now <|endoftext|> 's '"), (305, "A" * 3000), (306, " ".join(words(rng, 4000)))]
    out += [(None, base[3]), (None, None), (5, base[5]), (5, base[5])]
    return out


@pytest.fixture(scope="session")
def docs(spark, records):
    """The records with the columns of documents and others whose names the operators use inside."""
    rows = [(i, t, "en", None if k % 7 == 0 else f"s{k % 3 and 1}", len(t or ""), "x", "y", "z", 1, "s", "t", "u", 2, 3, "h") for k, (i, t) in enumerate(records)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
