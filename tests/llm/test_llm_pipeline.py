import corpus_pipeline
import public_tokenizers
import pyarrow.parquet as pq
from brute import dropped_lines, failures, measures, near_groups, without, WORD
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    docs = [(r["doc_id"], r["text"]) for r in rows]
    docs = [(i, t) for i, t in docs if not failures(measures(t))]
    gone = dropped_lines(docs)
    docs = [(i, without(t, gone[i])) for i, t in docs]
    docs = [(i, t) for i, t in docs if not gone[i] or WORD.search(t)]
    groups = near_groups(docs)
    docs = [(i, t) for i, t in docs if groups[i][1] == i]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in docs}
    got, room = {}, {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        room[r.sequence_id] = room.get(r.sequence_id, 0) + r.length
    assert got == want and max(room.values()) <= 4096
    assert len(room) <= -(-sum(want.values()) // 4096) + 1
    assert 100 < len(want) < len(rows)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 30")
    for name, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names, name
        assert [f.dataType for f in out.schema.fields] == [f.dataType for f in docs.schema.fields]


def test_stages_take_odd_rows(spark):
    long = "\n".join(f"one{k} {k * 7919}two {k * 104729}three four{k * 17}" for k in range(1200))
    plain = " ".join(f"word{k % 97}x{k}" for k in range(60))
    rows = [
        (1, None, None, "s", None, "x"), (2, "", "en", None, 0, "x"), (None, plain, "en", "s", 1, None),
        (3, plain, "en", "s", 1, "x"), (3, plain, "en", "s", 1, "x"), (3, plain.upper() + " y", "en", "s", 2, "x"),
        (4, long, "en", "s", len(long), "x"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, dropped string"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.where("false"), SF).count() == 0, name
        kept = sorted((r.doc_id or 0, len(r.text or "")) for r in out.collect())
        assert any(i == 4 for i, _ in kept), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {None, 1, 2, 3, 4} and max(r.length for r in packed) == 4096


def test_registered(spark):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
