"""Blocks, sections, chunks, ingestion, files, catalog and streams."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlake import schemas
from bidlake.operators import chunking as C
from bidlake.plans import ingest, retrieval
from bidlake.sources import catalog, files
from bidlake.streaming import incremental

BLOCKS = "id string, blocks array<struct<page_number:int,type:string,level:int,text:string>>"


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 17, 18, 25, 100])
def test_windows_cover_every_token_once_beyond_the_overlap(spark, n):
    df = spark.createDataFrame([("d", words(n))], "doc string, text string")
    rows = C.token_chunks(df, "doc", "text", 10, 3).orderBy("chunk_index").collect()
    assert all(0 < r.n_tokens <= 10 for r in rows) and bool(rows) == bool(n)
    rebuilt = []
    for r in rows:
        part = r.text.split()
        assert len(part) == r.n_tokens
        rebuilt = rebuilt[:r.token_start] + part
    assert rebuilt == words(n).split()
    links = C.token_chunks(df, "doc", "text", 10, 3, with_text=False).orderBy("chunk_index").collect()
    assert [(r.id, r.token_start, r.n_tokens) for r in links] == [(r.id, r.token_start, r.n_tokens) for r in rows]


@pytest.mark.parametrize("n", [3, 12, 17, 18, 40])
def test_short_tail_joins_its_predecessor(spark, n):
    df = spark.createDataFrame([("d", words(n))], "doc string, text string")
    rows = C.token_chunks(df, "doc", "text", 10, 3, min_tokens=6).orderBy("chunk_index").collect()
    assert rows[-1].token_start + rows[-1].n_tokens == n
    assert len(rows) == 1 or all(r.n_tokens >= 6 for r in rows)


def test_blank_text_gives_no_chunk_and_bad_sizes_fail(spark):
    df = spark.createDataFrame([("a", " \n\t "), ("b", None), ("c", "\n x ")], "doc string, text string")
    assert [(r.id, r.text) for r in C.token_chunks(df, "doc", "text").collect()] == [("c-0", "x")]
    with pytest.raises(ValueError):
        C.token_chunks(df, "doc", "text", 10, 10)


@pytest.fixture(scope="module")
def blocks(spark):
    return spark.createDataFrame([
        ("d", [(1, "paragraph", None, "intro"), (1, "heading", 1, "A"), (1, "paragraph", None, "x"), (2, "heading", 3, "B"),
               (2, "table", None, "cell"), (3, "heading", 2, "C"), (3, "heading", 1, "D"), (4, "paragraph", None, "y")]),
        ("e", []), ("f", [(1, "heading", None, "Only")])], BLOCKS)


def test_sections_paths_and_pages(blocks):
    rows = {r.id: r for r in C.section_chunks(blocks, "id").collect()}
    assert [rows[f"d#{i}"].section_path for i in range(5)] == ["", "A", "A > B", "A > C", "D"]
    assert [rows[f"d#{i}"].text for i in range(5)] == ["intro", "x", "cell", "", "y"]
    assert rows["d#2"].page_numbers == [2] and rows["d#4"].page_numbers == [3, 4] and rows["d#0"].title is None
    assert rows["f#0"].heading_level == 1 and not any(k.startswith("e") for k in rows)


def test_html_blocks_skip_scripts(spark):
    html = "<script>var t='<p>no</p>'</script><h2 class=x>Title &amp; more</h2><p>a <b>b</b></p><ul><li>i</li></ul><pre>z</pre><table><tr><td>c</td></tr></table>"
    got = C.html_blocks(spark.createDataFrame([(1, html)], "p int, html string"), "html").first().blocks
    assert [(b.type, b.level, b.text) for b in got] == [
        ("heading", 2, "Title & more"), ("paragraph", None, "a b"), ("list_item", None, "i"), ("paragraph", None, "z"),
        ("table", None, "c")]


def test_html_blocks_keep_all_text(spark):
    html = "<html><head><title>T</title></head><body>top <b>bold</b><div>one<div>two</div>three<p>p</p></div><li>open<footer>end</footer></body>"
    got = C.html_blocks(spark.createDataFrame([(1, html), (2, None), (3, "")], "p int, html string"), "html").orderBy("p").collect()
    assert [b.text for b in got[0].blocks] == ["T", "top bold", "one", "two", "three", "p", "open", "end"]
    assert got[1].blocks is None and got[2].blocks == []


def test_parsed_pages_flatten(spark):
    doc = [("d", "f.pdf", "it", [(1, [("heading", "H", 1, None, None, None, None, {"k": "v"})]), (2, [("paragraph", "t", None, [1.0], [["c"]], 9.0, "f", None)])])]
    flat = C.page_blocks(spark.createDataFrame(doc, schemas.PARSED_DOCUMENT)).first().blocks
    assert [(b.page_number, b.type, b.text) for b in flat] == [(1, "heading", "H"), (2, "paragraph", "t")]
    assert flat[0].extra == {"k": "v"} and flat[1].bbox == [1.0] and flat[1].raw_cells == [["c"]] and flat[1].font_name == "f"


def test_similar_paragraphs_merge(spark):
    df = spark.createDataFrame([("d", ["a b", "c d", "e", "f g h"], [[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [0.1, 1.0]])],
                               "id string, ps array<string>, vs array<array<double>>")
    assert [r.text for r in C.merge_similar_paragraphs(df, "id", "ps", "vs").orderBy("chunk_index").collect()] == ["a b\nc d", "e\nf g h"]
    assert C.merge_similar_paragraphs(df, "id", "ps", "vs", max_tokens=3).count() == 4


def test_ingest_upsert_and_self_check(spark, blocks):
    rows = ingest.ingest_blocks(blocks, "id", 8)
    assert rows.columns == schemas.CHUNK_COLLECTION.fieldNames() and rows.count() == 6
    first = rows.filter("id = 'd#0-0'").first()
    assert first.metadata == {"chunk_index": "0", "page_number": "1"} and first.tender_id == "d"
    empty = spark.createDataFrame([], schemas.CHUNK_COLLECTION)
    stored = ingest.upsert_chunks(empty, rows.withColumn("ord", F.lit(1)))
    again = ingest.upsert_chunks(stored, rows.withColumn("text", F.lit("new")).withColumn("ord", F.lit(2)))
    assert again.count() == 6 and again.filter("text = 'new'").count() == 6
    unit = spark.createDataFrame([("a-0", "a", [1.0, 0.0]), ("a-1", "a", [0.0, 1.0]), ("b-0", "b", [0.6, 0.8])],
                                 "id string, doc string, embedding array<float>")
    assert {(r.qid, r.id) for r in ingest.self_check(unit, unit, "doc").collect()} == {("a-0", "a-0"), ("b-0", "b-0")}
    assert ingest.self_check(unit.filter("false"), unit, "doc").count() == 0


def test_wrong_vector_width_fails_the_job(spark):
    bad = spark.createDataFrame([("1", "t", "", {}, [1], "s", "d")],
                                "id string, text string, section_path string, metadata map<string,string>, page_numbers array<int>, source_chunk_id string, document_id string")
    with pytest.raises(Exception, match="dim mismatch"):
        ingest.collection_rows(bad, 4, lambda text: F.array(F.lit(1.0)).cast("array<float>")).collect()


def test_hybrid_search_and_answer(spark):
    df = spark.createDataFrame([("a", "alpha beta", [1.0, 0.0]), ("b", "alpha", [0.9, 0.1]), ("c", "beta", [0.0, 1.0]), ("d", "zeta alpha beta", [0.1, 0.2])],
                               "id string, text string, embedding array<float>")
    got = retrieval.hybrid_search(df, "alpha beta", [1.0, 0.0], 2).orderBy("rank").collect()
    assert [(r.id, round(r.score, 3)) for r in got] == [("a", 0.7), ("b", 0.63)]
    hits = spark.createDataFrame([(0, "q", 2, "b", 0.5, "two"), (0, "q", 1, "a", 0.9, "one")],
                                 "qid int, question string, rank int, id string, score double, text string")
    answer = retrieval.answer_context(hits, generate=F.upper).first()
    assert answer.answer == "CONTEXT:\nONE\n\nTWO\n\nQUESTION: Q" and answer.n_citations == 2
    assert retrieval.answer_context(hits.filter("false"), generate=F.upper).count() == 0
    questions = spark.createDataFrame([(0, "q"), (1, "other")], "qid int, question string")
    seen = []

    def retrieve(asked):
        seen.extend(r.question for r in asked.orderBy("qid").collect())
        return hits.drop("question")

    rewritten = retrieval.answer_questions(questions, retrieve, lambda q: q.withColumn("question", F.upper("question")), generate=F.lower)
    assert seen == ["Q", "OTHER"]
    assert {(r.qid, r.n_citations, r.answer) for r in rewritten.collect()} == {
        (0, 2, "context:\none\n\ntwo\n\nquestion: q"), (1, 0, "context:\n\n\nquestion: other")}


def test_files_continue_past_failures(spark, tmp_path):
    for name, data in (("a.pdf", b"one"), ("b.DOCX", b"boom"), ("c.exe", b"x")):
        (tmp_path / name).write_bytes(data)

    def parser(name, content):
        if content == b"boom":
            raise ValueError("broken")
        return [{"page_number": 1, "type": "paragraph", "text": content.decode(), "bbox": [0.0, 1.0], "raw_cells": [["c"]],
                 "font_size": 9.5, "font_name": "f", "extra": {"k": "v"}}]

    # an empty file has no split to read, so the folder source cannot deliver it; a row can
    empty = spark.createDataFrame([("mem:d.pdf", "d.pdf", 0, bytearray(b""))], "path string, filename string, length long, content binary")
    found = files.read_files(spark, str(tmp_path)).unionByName(empty)
    parsed = files.parse_files(found, parser)
    rows = {r.filename: r for r in parsed.collect()}
    assert rows["a.pdf"].error is None and rows["a.pdf"].blocks[0].text == "one"
    block = rows["a.pdf"].blocks[0]
    assert (block.bbox, block.raw_cells, block.font_size, block.font_name, block.extra) == ([0.0, 1.0], [["c"]], 9.5, "f", {"k": "v"})
    assert rows["b.DOCX"].error == "ValueError: broken" and rows["c.exe"].error.startswith("Unsupported") and "empty" in rows["d.pdf"].error
    assert files.failed(parsed).count() == 3
    retried = files.retry_failed(found, parsed, lambda n, c: [{"text": "ok"}])
    assert {r.filename for r in retried.filter("error is null").collect()} == {"a.pdf", "b.DOCX"}


def test_blobs_text_and_open_data(spark, tmp_path):
    root = str(tmp_path / "blobs")
    files.put_blobs(spark.createDataFrame([("t/1_a.pdf", bytearray(b"A")), ("t/2_b.pdf", bytearray(b"B"))], "storage_path string, content binary"), root)
    assert bytes(files.get_blob(spark, root, "t/2_b.pdf").first().content) == b"B"
    assert files.get_blob(spark, root, "none").count() == 0
    files.put_blobs(spark.createDataFrame([("t/2_b.pdf", bytearray(b"new"))], "storage_path string, content binary"), root)
    assert [bytes(r.content) for r in files.get_blob(spark, root, "t/2_b.pdf").collect()] == [b"new"]
    (tmp_path / "x.txt").write_text("line one\nline two")
    assert files.read_text_documents(spark, str(tmp_path / "x.txt")).first().text == "line one\nline two"
    schema = T.StructType([T.StructField("code", T.StringType()), T.StructField("base_amount", T.DoubleType())])
    (tmp_path / "o.csv").write_text("code,base_amount\nA,1.5\n")
    (tmp_path / "o.json").write_text(json.dumps({"code": "B", "base_amount": 2.0}))
    assert files.read_open_data(spark, str(tmp_path / "o.csv"), schema).first().base_amount == 1.5
    assert files.read_open_data(spark, str(tmp_path / "o.json"), schema, "json").first().code == "B"


FIELDS = [{"name": "id", "dtype": "varchar", "max_length": 64, "is_primary": True}, {"dtype": "INT64"}, {"name": "v", "dtype": "FLOAT_VECTOR", "dim": 4}]


def test_collections(spark):
    schema = catalog.build_schema(FIELDS, strict=True)
    assert schema.fieldNames() == ["id", "v"] and schema["v"].metadata["dim"] == 4 and not schema["id"].nullable
    assert catalog.ensure_collection(spark, "things", schema) and not catalog.ensure_collection(spark, "things", schema)
    properties = {r.key: r.value for r in spark.sql("show tblproperties things").collect()}
    assert properties["shards"] == "2" and properties["index.metric_type"] == "IP"
    assert "things" in catalog.catalog_collections(spark)
    assert catalog.list_collections(catalog.catalog_collections(spark)).filter("name = 'things'").first().row_count == 0
    catalog.drop_collection(spark, "things")
    catalog.drop_collection(spark, "things")
    assert not spark.catalog.tableExists("things")


@pytest.mark.parametrize("fields", [
    [{"name": "id", "dtype": "VARCHAR", "is_primary": True}], [{"name": "v", "dtype": "FLOAT_VECTOR"}],
    [{"name": "id", "dtype": "INT64", "is_primary": True}], [{"name": "v", "dtype": "FLOAT_VECTOR", "dim": 4}], [{"name": "x", "dtype": "GEO"}]])
def test_collection_form_rules(fields):
    with pytest.raises(ValueError):
        catalog.build_schema(fields, strict=True)


def test_schema_round_trip_and_previews(spark):
    df = spark.createDataFrame([("b", [1.0] * 8, {"k": "v"}), ("a", [2.0] * 8, {})], "id string, v array<float>, m map<string,string>")
    assert catalog.import_schema(catalog.export_schema(df)) == df.schema
    assert [(r.id, len(r.v)) for r in catalog.preview_rows(df, "id").collect()] == [("a", 5), ("b", 5)]
    assert catalog.collection_rows(df, "id", " id , m ", 1).columns == ["id", "m"]
    assert catalog.serialised(df).filter("id = 'b'").first().m == '{"k":"v"}'
    assert [r.type for r in catalog.describe(df).collect()] == ["string", "array<float>", "map<string,string>"]
    for call in (lambda: catalog.collection_rows(df, "id", limit=501), lambda: catalog.preview_rows(df, "id", 0)):
        with pytest.raises(ValueError):
            call()


def test_stream_sync_is_idempotent(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    docs = spark.createDataFrame([(1, words(25)), (2, words(5))], "doc_id long, text string")
    docs.coalesce(1).write.parquet(source)

    def run():
        incremental.start_chunk_sync(incremental.stream_documents(spark, source, docs.schema), target, check, size=10, overlap=2, dim=4).awaitTermination()
        return incremental.current_chunks(spark, target)

    before = run().count()
    assert run().count() == before == 4
    spark.createDataFrame([(1, words(8))], docs.schema).coalesce(1).write.mode("append").parquet(source)
    after = run()
    assert {r.id for r in after.filter("doc_id = 1").collect()} == {"1-0"} and after.count() == 2


def test_a_batch_holds_one_version_of_a_document(spark, tmp_path):
    docs = spark.createDataFrame([(1, words(8), 1), (1, words(3), 2), (2, words(4), 1), (2, words(4), 1)], "doc_id long, text string, v int")

    def run(rows, name, **options):
        source, target, check = (str(tmp_path / name / n) for n in ("src", "out", "check"))
        rows.coalesce(1).write.parquet(source)
        incremental.start_chunk_sync(incremental.stream_documents(spark, source, rows.schema), target, check, size=10, overlap=2, dim=4, **options).awaitTermination()
        return sorted((r.id, r.text) for r in incremental.current_chunks(spark, target).collect())

    assert run(docs, "ordered", order_column="v") == [("1-0", words(3)), ("2-0", words(4))]
    assert run(docs.filter("doc_id = 2"), "repeated") == [("2-0", words(4))]
    with pytest.raises(Exception, match="several versions"):
        run(docs, "unlike")


def test_short_tails_join_their_predecessor_by_default(spark):
    blocks = spark.createDataFrame([(1, [(1, "paragraph", None, words(900))])], "id int, blocks array<struct<page_number:int,type:string,level:int,text:string>>")
    assert [r.n_tokens for r in C.document_chunks(blocks, "id").collect()] == [900]
    assert [r.n_tokens for r in C.document_chunks(blocks, "id", min_tokens=0).collect()] == [800, 220]
    assert [r.n_tokens for r in C.document_chunks(blocks, "id", 400, 0).collect()] == [400, 400, 100]


def test_catalog_names_and_values_are_quoted(spark):
    name = "`select`"
    schema = catalog.build_schema([{"name": "id", "dtype": "VARCHAR"}])
    assert catalog.ensure_collection(spark, name, schema, index={"note": "it's a \\ 'mark'"})
    shown = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    assert shown["index.note"] == "it's a \\ 'mark'"
    catalog.drop_collection(spark, name)
    assert not spark.catalog.tableExists(name)


def test_stream_activity(spark, tmp_path):
    source = str(tmp_path / "events")
    events = spark.sql("""select timestamp_ntz'2024-01-01 10:00:00' as ts, 1L as user_id, 'click' as event_type, 1.5D as value
        union all select timestamp_ntz'2024-01-01 11:00:00', 2L, 'click', 2.0D union all select timestamp_ntz'2024-01-03 00:00:00', 2L, 'view', 1.0D
        union all select timestamp_ntz'2024-01-05 00:00:00', 3L, 'view', 1.0D""")
    events.coalesce(1).write.parquet(source)
    out = []
    incremental.start_activity(spark.readStream.schema(events.schema).parquet(source),
                               lambda df, _: out.extend(df.collect()), str(tmp_path / "check")).awaitTermination()
    got = {(r.day.day, r.event_type): (r.n_events, r.n_users, r.total_value) for r in out}
    assert got[(1, "click")] == (2, 2, 3.5)
