import random

import pytest
from pyspark.sql import functions as F

from chronotext import fixed_values as fixed
from chronotext.functions.text import replace_terms
from chronotext.operators.lexicon import replace_terms_by_table

ODD = {"a b": "1", "b a": "2", "a b a": "3", "o'clock": "4", "c_d": "5", "é": "6", "ab": "7 7"}


@pytest.mark.parametrize("send_bytes", [1 << 20, 0])
@pytest.mark.parametrize("entries", [fixed.LEXICON, ODD])
def test_same_rows_as_one_expression_per_entry(spark, entries, send_bytes):
    rnd = random.Random(7)
    pieces = [*entries, *(w for t in entries for w in t.split()), "x", "É", "ab-c_d", "o'clock"]
    texts = [rnd.choice(["", " ", "\n"]) + rnd.choice([" ", "  ", "-", ", "]).join(
        rnd.choices(pieces, k=rnd.randint(0, 12))) for _ in range(150)]
    texts = [t.upper() if i % 5 == 0 else t for i, t in enumerate(texts)] + [None, "", "x", "x"]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "id int, text string, term string")
    lex = spark.createDataFrame([*entries.items()], "term string, native string")
    got = replace_terms_by_table(df, lex, send_bytes=send_bytes)
    assert got.columns == ["id", "text", "term", "normalized"]
    want = df.withColumn("normalized", replace_terms(F.col("text"), entries))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("send_bytes", [1 << 20, 0])
def test_odd_entries(spark, send_bytes):
    texts = spark.createDataFrame([("The  cat",), ("the cat",), ("the cat",), (None,)], "text string")
    lex = spark.createDataFrame([(" THE ", "z"), ("the", "y"), ("the", None), (None, "q"), ("", "q")],
                                "term string, native string")
    got = replace_terms_by_table(texts, lex, send_bytes=send_bytes)
    assert sorted(r.normalized or "" for r in got.collect()) == ["", "y cat", "y cat", "y cat"]
    none = replace_terms_by_table(texts, lex.limit(0), send_bytes=send_bytes)
    assert sorted(r.normalized or "" for r in none.collect()) == ["", "the cat", "the cat", "the cat"]
    assert replace_terms_by_table(texts.limit(0), lex, send_bytes=send_bytes).count() == 0


def test_a_dictionary_takes_little_more_memory_than_its_text():
    import tracemalloc

    from chronotext.operators.lexicon import lookup_of, replace_longest
    terms = [f"word{i * 7919:07d}" for i in range(20_000)]
    tracemalloc.start()
    lookup = lookup_of((t, f"T{len(t)}") for t in terms)
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert taken < 200 * len(terms)
    assert replace_longest(f"x {terms[5]}, {terms[5]}y", lookup) == f"x  T11 , {terms[5]}y"
