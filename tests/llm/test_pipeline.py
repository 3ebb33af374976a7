import hashlib

import pytest
import tiktoken
from cases import awkward, documents
from test_exact_dedup import brute as exact_brute
from test_minhash import brute as near_brute

import __spark_entry__ as entry
import corpus_pipeline as C
from tabwright.llm import bpe


def test_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


def test_stages_against_brute_force(spark, tmp_path):
    rows = awkward()
    spark.createDataFrame([(10, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark, rows)
    before = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    for i, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / f"stage{i}")
        out.write.parquet(path)
        done = spark.read.parquet(path)
        if i < len(C.STAGES) - 1:
            assert done.columns == docs.columns
            after = [(r.doc_id, r.text, r.lang, r.source) for r in done.collect()]
            assert {r[0] for r in after} <= {r[0] for r in before}
        if name == "language_id":
            assert {t for _, t, *_ in before} - {t for _, t, *_ in after} == {None, "", "  \n\t", "+++ 123 --- 456"}
        if name == "exact_dedup":
            assert sorted({(i, t) for i, t, *_ in after}, key=repr) == sorted(
                {(i, t) for i, t, *_ in before if any(b[0] == i and b[3] and b[4] == hashlib.sha256((t or "").encode()).hexdigest() for b in exact_brute(before))}, key=repr
            )
            assert len(after) == len({t for _, t, *_ in after})
        if name == "near_dedup":
            assert sorted((r[0] for r in after), key=repr) == sorted((r[0] for r in near_brute(before, 5) if r[3]), key=repr)
        if name == "bpe":
            with open(C.TOKENIZER, "rb") as f:
                import public_tokenizers as public

                library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
            want = sorted(tuple(library.encode_ordinary(t)) for _, t, *_ in before)
            assert sorted(tuple(r.ids) for r in done.collect()) == want
        docs, before = done, after


def test_run_on_a_test_table(spark, sf):
    out = C.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.count() > 100


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_stage_takes_an_empty_table(spark, sf, name):
    stage = dict(C.STAGES)[name]
    assert stage(spark, documents(spark, []), sf).count() == 0
