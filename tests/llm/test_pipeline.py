"""The corpus pipeline, stage by stage, against plain versions."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from driftwell.llm import mixing, quality, sentencepiece  # noqa: E402
from driftwell.llm.queries import tokenizer_path  # noqa: E402
from driftwell.llm.shared import written  # noqa: E402

from test_operators import base_texts, brute_components, brute_exact, table  # noqa: E402


def rows_of(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def test_stages(spark):
    long = [f"n{i}" for i in range(150)]
    near = [" ".join(long[:k] + ["changed"] + long[k + 1 :]) + "." for k in (5, 50, 100)]
    docs, _ = table(spark, [*base_texts(), *near])
    docs = docs.drop("hash", "size", "bucket")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "encode_pieces"]

    before = rows_of(docs)
    docs = written(steps["quality_rules"](spark, docs, ""), "t")
    verdict = {(i, t): quality.measure(pa.array([t], pa.string()))[0]["kept"][0] for i, t, *_ in before}
    assert Counter(r[0] for r in rows_of(docs)) == Counter(i for i, t, *_ in before if verdict[i, t])

    before = rows_of(docs)
    docs = written(steps["exact_dedup"](spark, docs, ""), "t")
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = Counter()
    for (i, _, _, kept, _), n in brute_exact(before).items():
        want[i] += n * kept
    assert Counter(r[0] for r in rows_of(docs)) == +want

    before = rows_of(docs)
    docs = written(steps["near_dedup"](spark, docs, ""), "t")
    stays = [i for (i, _), (_, c) in brute_components(before, 5, 4, 5).items() if i is None or c == i]
    assert Counter(r[0] for r in rows_of(docs)) == Counter(stays)
    assert len(stays) < len(before)

    copies = {r.doc_id: r.copies for r in mixing.sample(docs).collect()}
    before = {r[0]: r[1] for r in rows_of(docs)}
    docs = written(steps["mix_sources"](spark, docs, ""), "t")
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter(r[0] for r in rows_of(docs)) == +Counter(copies)

    ids = steps["encode_pieces"](spark, docs, "")
    back = Counter((r.doc_id, r.text) for r in sentencepiece.decode(ids, tokenizer_path("piece_bpe_32k.model")).collect())
    assert back == Counter({(i, before[i]): n for i, n in copies.items() if n})


def test_run(spark, tmp_path):
    docs, _ = table(spark)
    docs.drop("hash", "size", "bucket").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and "ids" in out.columns
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
