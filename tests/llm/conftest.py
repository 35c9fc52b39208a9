import hashlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Ordinary, copied, nearly copied, null, empty, blank, one-word, long and repeated rows."""
    def prose(seed, n):
        return " ".join("w" + hashlib.md5(f"{seed}-{i}".encode()).hexdigest()[:4] for i in range(n))

    base = prose("a", 120)
    near = " ".join("changed" if i == 60 else w for i, w in enumerate(base.split()))
    shared = prose("p", 30)
    texts = [base, near, base, None, "", " \t\n", "word", prose("b", 3000), f"{prose('c', 40)} {shared} {prose('d', 40)}", f"{prose('e', 40)} {shared}", "a b c d", "Été x" * 3, prose("b", 3000)]
    rows = [(i, t, "en", None if i % 4 == 3 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], (None, prose("n", 50), None, None, 0)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
