import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, row bigint, token string, d1 string, tid string, label string, batch int"


def words(r, n):
    syllables = "an er in on the re st ou en tion de la que ie os ge keit ent".split()
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(n))


def rows():
    """Nulls in any column, empty, blank and long texts, copies, near copies, ties, repeated rows and ids."""
    r = random.Random(5)
    base = words(r, 120)
    passage = words(r, 70)
    texts = [None, "", "   \n\t ", "one", "a b c d", "a b c d", base, base, base.replace("tion", "tiom", 2), base + " more words at the end", words(r, 60) + "\n" + passage, words(r, 80) + " " + passage]
    texts += [f"{words(r, 20)} mail bob.{i}@mail3.example.com or +1 (017) 555-771{i} at 10.0.0.{i} card 4539578763621486 ok {words(r, 10)}" for i in range(3)]
    texts += ["x" * 700, "ab " * 300, "\n".join(["same line here"] * 40), "é ñ 数据 😀 " * 30, "Released under the MIT License.\n" + words(r, 40), "# $ % & " * 30, words(r, 6000), "▁ a ▁  b ", "<|endoftext|> x"]
    texts += [words(r, r.randint(12, 90)) for _ in range(40)]
    words_of = base.split()
    for k in range(12):  # near copies by one to three edits
        w = list(words_of)
        for _ in range(1 + k % 3):
            w[r.randrange(len(w))] += "x"
        texts.append(" ".join(w))
    out = []
    for i, t in enumerate(texts):
        out.append((i, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "s10"][i % 4], None if t is None else len(t), 7, 8, "t", "d", "x", "l", 1))
    out += [out[6], out[6], (None, base, None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None), (7, "same id, other text", "en", "s1", 1, 1, 1, "", "", "", "", 0)]
    return out


@pytest.fixture(scope="session")
def fixture_rows():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, fixture_rows):
    return spark.createDataFrame(fixture_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, fixture_rows):
    return spark.createDataFrame([(r[0], k % 5 != 0, 0) for k, r in enumerate(fixture_rows)], "doc_id bigint, q boolean, toxic int").selectExpr("doc_id", "int(q) quality", "toxic")
