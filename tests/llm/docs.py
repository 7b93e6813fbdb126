"""Small documents with everything that may go wrong."""

from pyspark.sql import functions as F

PASSAGE = " ".join(f"word{k % 97}x{k}" for k in range(90))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", "a", 4),
    (4, "one two three", "en", "a", 13),
    (5, f"start here {PASSAGE} and end", "en", "b", 900),
    (6, f"another beginning, quite different {PASSAGE} with a tail", "en", "b", 900),
    (7, f"start here {PASSAGE} and end", None, "b", 900),
    (7, f"start here {PASSAGE} and end", None, "b", 900),
    (None, "a row without an id but with words enough for a shingle", "en", None, 50),
    (None, None, "en", None, None),
    (8, "mail a.b@c.de or 10.0.0.1, card 4111 1111 1111 1111, tel +1 (555) 010-9999 now", "en", "a", 80),
    (9, "é" * 500, "fr", "a", 500),
    (10, "ab" * 100_000, "de", "c", 200_000),
    (11, " ".join(f"w{k}" for k in range(60_000)), "de", "c", 400_000),
    (12, "ONE two\x0bTHREE", "en", "a", 13),
    (13, "日本語 のテキスト 😀 <|endoftext|> ▁x", "ja", "a", 30),
]


def documents(spark, rows=ROWS, clash=True):
    """With further columns whose names operators use themselves."""
    docs = spark.createDataFrame(rows, SCHEMA)
    if clash:
        for name in ("uid", "h", "spans", "shard", "score", "component_id", "kept", "cls", "slot", "length"):
            docs = docs.withColumn(name, F.lit(f"own {name}"))
    return docs


def empty(spark):
    return documents(spark, [])
