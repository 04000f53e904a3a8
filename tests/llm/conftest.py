import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, in three partitions, with clashing extra columns."""

    def build(rows, extra=False):
        full = [(*r, *[None] * (4 - len(r)), 0) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        if extra:
            from pyspark.sql import functions as F

            for name in ("id", "key", "kind", "size", "copies", "place", "words", "rest", "block", "n", "component", "starts", "score", "lang_pred", "piece", "length"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return build


@pytest.fixture(scope="session")
def prose():
    """Invented texts: plain ones, exact and near copies, shared passages, long, short and empty ones."""
    import random

    rng = random.Random(5)
    words = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage, base = text(40), text(120)
    rows = [text(rng.randint(1, 200)) for _ in range(40)]
    rows += [base] * 5 + [base.replace(" ", "\n", 3)]
    for _ in range(25):
        near = base.split()
        for _ in range(rng.randint(1, 3)):
            near[rng.randrange(len(near))] = rng.choice(words)
        rows.append(" ".join(near))
    rows += [text(rng.randint(0, 60)) + " " + passage + " " + text(rng.randint(0, 60)) for _ in range(20)]
    rows += ["", None, " \n\t ", "a", "a b", "A B", "ab " * 300, "é" * 400, "é" * 400 + "x", text(5000), "x" * 3000, passage + " " + passage]
    rng.shuffle(rows)
    return [(i * 3, t, "en", f"s{i % 4}" if i % 9 else None) for i, t in enumerate(rows)]
