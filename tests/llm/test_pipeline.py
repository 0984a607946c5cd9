"""The pipeline against a brute-force version on a small fixture."""

import hashlib

import pytest

from versewright.llm import near_dedup, quality_rules
from versewright.llm.queries import MODEL
from versewright.llm.shingles import word_hashes

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_run(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline

    prose = lambda seed, n=80: " ".join(f"{'abcdefghij'[(seed * 7 + i * 3) % 10]}{'lmnopqrstu'[(seed + i * i) % 10]}word{seed}x{i}" for i in range(n))
    leak = " ".join(f"leak{i}" for i in range(30))
    rows = [(1, prose(1)), (2, prose(1)), (3, prose(1) + " tail"), (4, prose(4)), (5, "too short"), (6, prose(6) + " " + leak + " end"), (7, prose(7) + " password=abcdef123456"), (8, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    words = lambda t: word_hashes(t.lower().split())
    assert near_dedup.similar(words(rows[0][1]), words(rows[2][1])) and quality_rules.BASE.rules
    assert set(got) == {1, 4, 7}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    for i, text in ((1, prose(1)), (4, prose(4)), (7, prose(7) + " [secret]")):
        ids = sp.encode(text)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "piece_codec"]
