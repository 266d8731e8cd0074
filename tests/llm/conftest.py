import random

import pytest

from ledgerprep.session import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def scratch(spark):
    own = Scratch(spark)
    yield own
    own.drop()


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, repeated ids."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, rows = text(70), []
    for i in range(40):
        rows.append((i, text(rng.randint(1, 200))))
    for i in range(40, 60):
        rows.append((i, f"{text(rng.randint(0, 60))} {passage} {text(rng.randint(0, 60))}"))
    for i in range(60, 90):
        words = rows[i - 60][1].split()
        for _ in range(rng.randint(0, max(1, len(words) // 60))):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, "\t ".join(words).upper() if i % 7 == 0 else " \n".join(words)))
    rows += [(90, rows[3][1]), (91, rows[3][1]), (91, rows[3][1]), (92, None), (93, ""), (94, " \t\n"), (95, "one"), (96, "One"), (97, "ONE two")]
    rows += [(None, rows[50][1]), (None, None), (98, text(30) + " " + " ".join([passage] * 3)), (99, text(9000)), (100, "x" * 5000), (100, passage)]
    rows += [(101, "é ü ß   ñ"), (102, "a b c d e"), (103, "a b c d e f"), (-5, rows[45][1])]
    return rows


@pytest.fixture
def documents(spark):
    def make(rows, extra=False):
        langs, sources = ["en", "de", None], ["src1", "src2", None, "src0", ""]
        full = [(i, t, langs[n % 3], sources[n % 5], None if t is None else len(t)) for n, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(full, DOCS)
        if not extra:
            return df
        names = ["node", "row", "match", "anchor", "copy", "copies", "d", "t", "key", "id", "text_key", "score", "size"]
        return df.selectExpr("*", *(f"{n} AS `{name}`" for n, name in enumerate(names)))

    return make
