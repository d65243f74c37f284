import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, rid long, key string, score string, shard string, runs int"


def corpus_rows(seed=3, size=60):
    """Documents with exact and near copies, shared passages, repeated lines and rows, nulls, empty and long texts."""
    rng = random.Random(seed)
    vocabulary = ["alpha", "beta", "Gamma", "delta", "été", "Straße", "naïve", "one", "two", "three", "four", "five", "x1", "y22", "ZZ"] + [f"w{i}" for i in range(120)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(50))
    texts = []
    for k in range(size):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 8))]
        if k % 5 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        if k % 4 == 0:
            lines += ["Terms of use", "All rights reserved.", "", "Terms of use"]
        texts.append("\n".join(lines))
    for k in range(0, size, 3):
        texts.append(texts[k])  # exact copies
        words = texts[k + 1].split(" ")
        words[-1] = "changed"
        texts.append(" ".join(words))  # near copies
    long = " ".join(rng.choice(vocabulary) for _ in range(4000))
    texts += [long, long.replace("alpha", "beta", 1), "a " * 300, "", "   ", "\n\n", "short", None, None, "Straße été naïve"]
    rows = [(i, t, ["en", "fr", None][i % 3], [f"src{i % 7}", None][i % 11 == 0], None if t is None else len(t), "f", -1, "k", "s", "h", 0) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "no id at all", "en", "src0", 12, "f", -1, "k", "s", "h", 0), (None, texts[1], None, None, 1, "f", -1, "k", "s", "h", 0), (5, "another text under a used id", "en", "src1", 27, "f", -1, "k", "s", "h", 0)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "documents.parquet")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="session")
def same():
    def check(frame, columns, expected):
        got = ordered([tuple(r) for r in frame.select(*columns).collect()])
        assert got == ordered([tuple(e) for e in expected])

    return check
