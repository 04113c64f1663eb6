"""Card runs and abstracted values in odd texts: borders of words, white space and neighbouring values as the SQL has them."""

import random

import duckdb
import pytest

from quillmark import catalog

TEXTS = [
    "a1059743005344", "1059743005344x", "_4111111111111111", "é4111111111111111é", "4111 1111 1111 1111", "4111\x0b1111111111111", "4111-1111-1111-1111 4111111111111111", "12 +5(7) 03/2024", "5€7", "+3+4 -5EUR6", "1.5 -2",
    "éA@b.fr", "a@bſſ.com x@y.cK", "éLU280019400644750000é", "12345678\x0b9", "x 1/2é", "7\x0b8", " 12\x0b ", "", None, "٣٤ 12",
]


def made(n):
    r = random.Random(7)
    parts = ["1", "23", "4111", "11111111", " ", " ", "-", "+", ".", ",", "/", "'", "\n", "\t", "\x0b", "a", "Z", "é", "_", "@", "EUR", "€", "$", "LU28", "x@y.fr", "(", ")", "ſ", " "]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(n)]


@pytest.mark.parametrize("name", ["card_luhn", "abstracted_values"])
def test_odd_texts(spark, tmp_path, name):
    rows = list(enumerate(TEXTS + made(3000)))
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = catalog.queries()[name](spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()), key=lambda r: (r[0], str(r[1:])))
    want = sorted(con.execute(f"select {', '.join(df.columns)} from ({catalog.oracle_sql()[name]})").fetchall(), key=lambda r: (r[0], str(r[1:])))
    assert [(w, g) for w, g in zip(want, got) if w != g] == [] and len(got) == len(want)
