from __future__ import annotations

import random

import pytest

#: The columns of ``documents``, and extra ones named like operators' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, _row string, kept string, _w int, size int, first string"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, sources=None, ids=None):
        rows = []
        for k, text in enumerate(texts):
            source = sources[k] if sources else f"s{k % 3}"
            rows.append((ids[k] if ids else k, text, None if k % 4 == 0 else "en", source, None, 1, "x", "y", None, 3, None))
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, repeated and near texts, other scripts and control characters."""
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "été", "größe", "日本", "x y", "A#b", "c|d"]
    line = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    out = [None, "", " \t\n ", "one", "one two three", "a b c d e f a b c d e f a b c d e", "x\x0by\x0cz\r\nlast", "\x1cq  w\u0085e", "ab " * 4000]
    for _ in range(30):
        out.append("\n".join(line(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 6))))
    base = line(400)
    out += [base, base, base.replace("alpha", "ALPHA"), base + " tail", base.replace("beta1 ", "beta2 ", 1), out[-1], out[-2], None, ""]
    shared = line(60)
    out += [line(5) + "\n" + shared, shared + "\n" + line(3), shared.replace(" ", "  ", 3), shared.rsplit(" ", 1)[0], shared.replace(shared.split()[30], "other", 1)]
    return out
