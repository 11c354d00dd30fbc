"""Queries against their SQL on small tables that the given ones have no rows like."""

import duckdb
import pandas as pd
from test_oracles import rows

import __spark_entry__


def same(spark, path, name, **tables):
    """The rows of a query on these tables, after comparing them with its SQL's, one thread."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for t, frame in tables.items():
        frame.to_parquet(f"{path}/{t}.parquet", index=False)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in want.description]
    df = __spark_entry__.queries()[name](spark, str(path))
    got = rows(df.columns, df.collect())
    assert got == rows(names, want.fetchall())
    return got


def test_equal_line_numbers_keep_the_first_translation_of_the_table(spark, tmp_path):
    nation = pd.DataFrame({"n_nationkey": pd.Series([3, 4], dtype="int32"), "n_name": ["A", "B"]})
    part = pd.DataFrame({"p_partkey": [3, 4], "p_name": ["x", "y"], "p_type": ["t", "u"]})
    lines = [(7, 3, 279, 3), (7, 3, 111, 3), (7, 3, 5, 3), (9, 3, 1, 3), (8, 1, 301, 4), (8, 1, 99, 4)]
    lineitem = pd.DataFrame(lines, columns=["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]).astype({"l_linenumber": "int32"})
    got = same(spark, tmp_path, "reused_translations", nation=nation, part=part, lineitem=lineitem)
    assert "T279" in str(got) and "T301" in str(got) and "T111" not in str(got)


def test_quantities_are_rounded_as_by_the_sql(spark, tmp_path):
    quantities = [0.5, 1.5, 2.5, 0.6, 7.5, 13.9, -0.6, 6.49, None]
    lineitem = pd.DataFrame({"l_suppkey": [1] * 9, "l_partkey": [100 * i for i in range(9)], "l_quantity": quantities})
    got = same(spark, tmp_path, "span_merge", lineitem=lineitem)
    assert sorted(r[0] - r[2] for r in got) == [1, 1, 2, 2, 6]


def test_quotes_are_compared_as_by_the_sql(spark, tmp_path):
    """Case, composed forms, white space and soft hyphens; compatibility forms and case foldings are other characters. Repeated rows repeat."""
    texts = [
        "Die Straße ist lang und breit", "Die STRASSE ist lang und breit", "die  Stra­ße\tist\nlang und breiter", "un eﬃcace plan de l'eau ici", "un efficace plan de l'eau ici",
        "die Straße ist\u00a0lang und breit", "café au lait du matin frais", "CAFÉ AU LAIT DU MATIN FRAIS", None, "", "ΟΔΟΣ α β γ δ ε", "la mer", "x la mer y",
    ]
    documents = pd.DataFrame({"doc_id": [*range(13), 0, 1], "source": ["src1"] * 12 + ["src2"] + ["src1"] * 2, "text": [*texts, texts[0], texts[0]]})
    quotes = ["Straße ist lang und breit", "un efficace plan de l'eau", "café au lait du matin", "οδοσ α β γ δ", "\u00a0la mer ", None, "ist lang"]
    benchmark = pd.DataFrame({"item_id": [20 * i + 1 for i in range(7)], "text": quotes})
    got = same(spark, tmp_path, "gold_quotes", documents=documents, benchmark=benchmark)
    assert len([r for r in got if r[1] == 1]) == 4 and (1.0, 21.0) not in got
    same(spark, tmp_path, "gold_hits", documents=documents, benchmark=benchmark)


def test_languages_are_decided_as_by_the_sql(spark, tmp_path):
    """Short samples between spaces of any kind, windows of unclear texts, repeated, null and empty rows, characters that vanish or leave several."""
    fr, en = "le plan de l'eau et des communes rurales avec un suivi des ménages ", "the plan for water and rural communities with monitoring of households "
    texts = [fr * 90, en * 90, fr * 200 + en * 120, "qqq zzz " * 900 + en * 200, "\u00a0" * 5 + "le plan des eaux" + "\u00a0" * 5, "le plan des eaux et", None, "", "ﬁn œuvre Ⅷ ① ½ été ́ naïve İstanbul K", "日本語" * 20, "a b c d e f g h i j k l m n o p", fr * 2, en * 3]
    documents = pd.DataFrame({"doc_id": [*range(11), 0, 5], "lang": ["fr", "en"] + [None] * 11, "text": texts})
    got = same(spark, tmp_path, "language_decision", documents=documents)
    assert len(got) == 13
