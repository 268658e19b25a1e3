from pyspark.sql import functions as F

from lectern.plans import ask

CHUNK = "chunk_id string, text string, program_key string, program_name string, degree_level string, total_ects int, section string, chunk_type string, contains_table boolean, doc_label string"


def test_retrieve(spark):
    chunks = spark.createDataFrame(
        [
            ("a1", "EC.00123 Statistics for beginners", "k1", "Business Informatics", "Master", 90, "1. Jahr", "table", True, "Studienplan"), ("a2", "Law of contracts", "k1", "Business Informatics", "Master", 90, "2. Jahr", "text", False, None),
            ("a3", "General remarks", "k1", "Business Informatics", None, None, None, "text", False, None), ("b1", "Statistics", "k2", "Law", "Master", 90, "1. Jahr", "text", False, None), ("b2", "Statistics", "k2", "Law", "Bachelor", 60, None, "text", False, None),
        ],
        CHUNK,
    )
    q = spark.createDataFrame([(1, "Statistics in the first year of the Master Business Informatics, 90 ECTS"), (2, "Who teaches statistics?"), (3, "third year of Business Informatics"), (4, "unrelated")], "id int, text string")
    got = {}
    for r in ask.retrieve(q, chunks, 2).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.chunk_id, r.program_key))
    assert got[1] == [("a1", "k1")]
    assert got[2] == [("a1", None), ("b1", None)]
    assert [c for c, _ in got[3]] == ["a1", "a2"] and 4 not in got
    near = spark.createDataFrame([(4, "b2")], "id int, chunk_id string")
    assert [r.chunk_id for r in ask.retrieve(q, chunks, 2, near).where(F.col("id") == 4).collect()] == ["b2"]


def test_route(spark):
    q = spark.createDataFrame([(1, "What is EC-A12.34567?"), (2, "Was sagt Artikel 5?")], "id int, text string")
    got = {r.id: r for r in ask.route(q).collect()}
    assert got[1].mode == "api" and got[1].args == {"code": "EC-A12.34567"} and got[2].mode == "rag" and got[2].store == "regulations"
