"""The pipeline against a plain version of each stage, on a small table."""

import os

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
from tablewright.llm.queries import tokenizer_path
from test_classifiers import corpus
from test_decontamination import plain as plain_contamination
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer

import __spark_entry__ as entry_module


def tables(folder):
    texts, marks = corpus(200)
    passage = " ".join(f"item{i}" for i in range(30))
    texts += [(300, texts[7][1]), (301, texts[7][1] + " more"), (302, passage), (303, texts[8][1] + " " + passage), (304, None), (305, "")]
    pq.write_table(pa.table({"doc_id": [i for i, _ in texts], "text": [t for _, t in texts], "lang": ["en"] * len(texts), "source": ["s"] * len(texts), "n_chars": [len(t or "") for _, t in texts]}), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"doc_id": [m[0] for m in marks], "quality": pa.array([m[1] for m in marks], pa.int32()), "toxic": pa.array([m[2] for m in marks], pa.int32())}), f"{folder}/labels.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [passage]}), f"{folder}/benchmark.parquet")
    return [(1, passage)]


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    items = tables(folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, library = docs.columns, Tokenizer.from_file(tokenizer_path())
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.staged(stage(spark, docs, folder))
        rows = docs.collect()
        after = {r["doc_id"]: r for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name != "bpe":
            assert docs.columns == columns
        if name == "simhash":
            ids = sorted(before)
            roots = plain_components([plain_fingerprint(before[i]) for i in ids])
            assert set(after) == {ids[r] for r in roots}
        if name == "decontamination":
            assert all(not plain_contamination(r["text"], items)[4] for r in rows)
            assert all(after[i]["text"] == t for i, t in before.items() if not plain_contamination(t, items)[4])
            assert set(before) - set(after) <= {302}
        if name == "bpe":
            assert all(r["ids"] == library.encode(before[i] or "", add_special_tokens=False).ids for i, r in after.items())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash", "decontamination", "bpe"]
    assert corpus_pipeline.run(spark, folder).count() == len(after)


def test_registered():
    names = entry_module.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert os.path.exists(tokenizer_path())


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, repeated ids and rows, long and empty texts, columns with the names that stages use; then no rows at all."""
    from odd import TEXTS, documents, labels

    from tablewright.llm.shared import letter_words

    benchmark = spark.createDataFrame([(1, "One word, two words three four five six seven"), (2, None), (None, "x"), (3, "")], "item_id bigint, text string")
    for name, rows in (("full", TEXTS + [(5, "another text under the same id")]), ("empty", [])):
        folder, docs = f"{tmp_path}/{name}", documents(spark, rows)
        labels(spark, [(4, 1, 0, 0, ""), (6, 1, 0, 0, "")] if rows else []).write.parquet(f"{folder}/labels.parquet")
        (benchmark if rows else benchmark.limit(0)).write.parquet(f"{folder}/benchmark.parquet")
        docs.write.parquet(f"{folder}/documents.parquet")
        docs, counts = spark.read.parquet(f"{folder}/documents.parquet"), []
        for stage_name, stage in corpus_pipeline.STAGES:
            before = docs
            docs = corpus_pipeline.staged(stage(spark, docs, folder))
            counts.append(docs.count())
            if stage_name != "bpe":
                assert docs.schema == before.schema
            if stage_name == "decontamination" and rows:
                assert all("two" not in letter_words((r["text"] or "").encode()) for r in docs.collect())
        # labels of one class reject nothing; ids 1, 2, 3 are one empty group, 4 and 5 copies; 4 is nothing but an item
        assert counts == ([len(rows), len(rows), len(rows) - 4, len(rows) - 5, len(rows) - 5] if rows else [0] * 5)
        assert corpus_pipeline.run(spark, folder).count() == counts[-1]
