import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from passagekit.llm import pii
from tests.llm.test_dedup import slow_lines


def test_stages_against_plain_python(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 120")
    extra = spark.createDataFrame([(900, None, "en", "s", 0), (901, "12 34 --", "en", "s", 8), (902, "mail me at x@y.zz now and here\nthe of and to it is", "en", "s", 5)], source.schema)
    docs = source.unionByName(extra)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "pii_redaction", "best_fit_packing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        after = out.collect()
        if name != "best_fit_packing":
            assert out.columns == source.columns
            kept.append({r.doc_id for r in after})
        if name == "language_id":
            assert kept[-1] == set(before) - {900, 901}
        elif name == "line_dedup":
            want = slow_lines([(d, r.text) for d, r in before.items()], 0.8)
            assert {r.doc_id: r.text for r in after} == want
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "simhash_near_dedup":
            assert kept[-1] < set(before) and all(before[r.doc_id] == r for r in after)
            assert len({r.text for r in after}) == len({r.text for r in before.values()}) == len(after)
        elif name == "pii_redaction":
            fitted = pii.model()
            assert {r.doc_id: r.text for r in after} == {d: pii.redact(r.text, pii.find_spans(r.text, fitted)[1]) for d, r in before.items()}
            assert "x@y.zz" not in next(r.text for r in after if r.doc_id == 902)
        else:
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            for d, r in before.items():
                ids = np.array([*library.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
                mine = sorted((p for p in after if p.doc_id == d), key=lambda p: p.piece)
                assert sum(p.length for p in mine) == len(ids)
                assert [p.ids_crc32 for p in mine] == [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in mine]
        docs = out


def test_empty_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0


def test_rows_that_repeat_or_lack_ids_and_clashing_columns(spark, sf):
    rows = [(1, "the cat sat on the mat and it was good", "row", 1), (1, "the cat sat on the mat and it was good", "row", 1), (None, "the dog is not in the house of them", "key", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, drop int").selectExpr("*", "'en' as lang", "'x' as fp", "0 as class")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.filter("doc_id is null").count() == 1
    assert corpus_pipeline.STAGES[2][1](spark, docs, sf).filter("doc_id = 1").count() == 1
