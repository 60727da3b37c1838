"""Similar pairs by blocks against the column function pair by pair, and against the query's own SQL on odd rows."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagelattice.functions import text as T
from pagelattice.operators import similarity

OPENING = "the same forty characters begin every text of this key"


def rows(rng):
    words = [f"w{k}" for k in range(60)]
    texts = [f"{OPENING} {' '.join(rng.choices(words, k=rng.randrange(90)))}" for _ in range(120)]
    texts += [t[: rng.randrange(60, 90)] for t in texts[:20]] + texts[:10] + [OPENING, OPENING + " " + texts[3], "", "", "!?", None, None, "alone"]
    return list(enumerate(texts)) + [(3, texts[3]), (4, texts[5]), (None, texts[6])]


@pytest.mark.parametrize("block", [1024, 16])
def test_pairs_equal_the_column_function(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK_TEXTS", block)
    docs = spark.createDataFrame(rows(random.Random(7)), "id bigint, text string").where("text is not null")
    lines = docs.select("id", T.words_only(F.col("text")).alias("line")).withColumn("key", F.substring("line", 1, 40))
    got = Counter((r.a, r.b, r.similarity) for r in similarity.similar_pairs(lines).collect())
    a, b = lines.alias("a"), lines.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")))
    like = F.floor(T.line_similarity(F.col("a.line"), F.col("b.line")) * 1e6 + 0.5) / 1e6
    assert got == Counter(map(tuple, met.select("a.id", "b.id", like).collect()))
    assert len({s for _, _, s in got}) > 100


def test_many_words_in_the_matrix_and_outside():
    rng = random.Random(1)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join({*rng.choices(words[:1500], k=700), *rng.choices(words, k=30)}) for _ in range(80)]
    common, one, two = similarity.shared_words(texts[:50], texts[30:])
    sets = [set(t.split()) for t in texts]
    assert one.tolist() == [len(s) for s in sets[:50]] and two.tolist() == [len(s) for s in sets[30:]]
    assert common.tolist() == [[len(a & b) for b in sets[30:]] for a in sets[:50]]


def test_query_equals_its_sql_on_odd_rows_and_joins_no_pairs(spark, tmp_path):
    spark.createDataFrame(rows(random.Random(8)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = entry.queries()["text_similarity"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT doc_a, doc_b, similarity FROM ({entry.oracle_sql()['text_similarity']})").fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(want)
    # Documents meet in blocks: no join makes a row for each pair.
    plan = df._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert "array_intersect" not in plan and "doc_id" in plan
