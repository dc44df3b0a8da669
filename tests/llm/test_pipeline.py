import corpus_pipeline as P
from pressdesk.llm.common import keep

import public_tokenizers
import tiktoken

from pressdesk.llm import bpe


def test_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != P.STAGES[-1][0]:
            assert out.columns == columns
        docs = keep(out, name) if name != P.STAGES[-1][0] else out
        sizes.append(docs.count())
        if name == "personal_data":
            texts = {r.doc_id: r.text for r in docs.collect()}
    assert sizes[1] == sizes[0] and sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[3] == sizes[4] == sizes[5]
    other = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=bpe.load_ranks(P.RANK_FILE)
    )
    for r in docs.limit(30).collect():
        assert r.ids == other.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)


def test_odd_rows(odd, none, spark, sf_dir):
    docs = odd.filter("length(text) < 100000 or text is null")
    for _, stage in P.STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), "odd")
        assert docs.columns == odd.columns
    kept = {r.doc_id for r in docs.collect()}
    assert {1, 11, 12} <= kept and not kept & {2, 3, 4, 5, 7, 10}
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, none, sf_dir).count() == 0
    assert P.STAGES[-1][1](spark, none, sf_dir).count() == 0
