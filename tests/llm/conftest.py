import random
import re

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega été ß naïve".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if k % 9 == 8 else "") for k in range(n))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="session")
def frame(spark):
    def make(texts, ids=None, **more):
        rows = [(ids[k] if ids else k, t, "clash", *[v for v in more.values()]) for k, t in enumerate(texts)]
        # extra columns whose names the operators use themselves
        return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *[f"{k} string" for k in more]]))

    return make


#: Texts that every operator on texts must take.
HARD = [None, "", " \n\t ", "x", "é" * 3, prose(1, 40), prose(1, 40), prose(2, 30000), "a" * 200_000, "\x00 \x01 <|endoftext|> it's", prose(3, 12) + "\n" + prose(3, 12)]
