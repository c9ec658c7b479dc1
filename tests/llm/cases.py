"""Rows that every operator has to bear: nulls, empty, repeated and long texts, ties, clashing columns."""

LONG = "The quick brown fox jumps over the lazy dog. " * 4000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (None, "A text without an id, Ünïcödé and 漢字 🙂 too."),
    (6, "repeated row"),
    (6, "repeated row"),
    (7, LONG),
    (8, "\x00\x1c\x85 odd \xa0 separators<|endoftext|> here"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row_key int, fp string"


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "en" if t else None, "s", None, "mine", 1, "mine") for i, t in rows], SCHEMA)


def documents(spark, sf_dir="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(rows):
    return sorted(rows, key=repr)
