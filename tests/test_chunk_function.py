"""The chunker as a table function gives the rows of chunk_pages()."""

from passagework.operators import chunk


def test_same_rows_by_sql(spark):
    text = "# Title\n\n" + "A sentence of some length stands here. " * 120 + "\n\n## Part\n\n" + "def f(x):\n    return x\n" * 80
    pages = spark.createDataFrame([("a", "a.pdf", 1, text), ("a", "a.pdf", 2, "short"), ("b", None, 1, ""), ("c", "c", 7, None), (None, "d", 1, "no document")], "document_id string, source_file string, physical_page int, text string")
    chunk.register_chunker(pages, "test_pages")
    by_sql = spark.sql("SELECT c.* FROM test_pages p, LATERAL chunk_units(p.document_id, p.source_file, p.physical_page, p.doc_shape, p.units) c")
    want = chunk.chunk_pages(pages)
    assert by_sql.columns == want.columns
    rows = sorted(map(tuple, by_sql.collect()), key=repr)
    assert rows == sorted(map(tuple, want.collect()), key=repr) and len(rows) > 8
    of_page = [r for r in by_sql.where("document_id = 'a' and physical_page = 1").collect()]
    assert sorted(r["chunk_index"] for r in of_page) == list(range(len(of_page)))


def test_one_page_as_a_call(spark):
    spark.udtf.register("chunk_units", chunk.ChunkUnits)
    rows = spark.sql("SELECT * FROM chunk_units('d', 'f', 3, 'prose', array('one unit', 'another'))").collect()
    assert [(r["chunk_id"], r["node_type"], r["text"]) for r in rows if r["node_type"] == "parent"] == [("d_page_3_parent_0", "parent", "one unit"), ("d_page_3_parent_1", "parent", "another")]
    assert spark.sql("SELECT * FROM chunk_units('d', 'f', 3, 'prose', array())").count() == 0
