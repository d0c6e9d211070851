from __future__ import annotations

import os
import zlib

import corpus_pipeline
import numpy as np
from cohortlens.llm import decontaminate, mixing
from test_neardup import brute
from test_tokens import PATH
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, SF)
        if k == len(corpus_pipeline.STAGES) - 1:
            break
        out.write.parquet(path := os.path.join(tmp_path, name))
        out = spark.read.parquet(path)
        assert out.columns == columns
        kept[name] = sorted(r.doc_id for r in out.select("doc_id").collect())
        if name == "language_id":
            assert kept[name] == sorted(d for d, t in rows if t and any(c.isalpha() for c in t))
        elif name == "near_duplicates":
            assert kept[name] == sorted(int(d) for d, _, _, stays in brute(rows, 5) if stays)
        elif name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            hit = {r.doc_id for r in decontaminate.matches(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert {d for d, t in rows if any(x in t for x in items)} <= hit
            assert kept[name] == sorted(d for d, _ in rows if d not in hit)
        elif name == "mixed_sources":
            taken = {r.doc_id: r.taken // r.size for r in mixing.mixed_sizes(docs).collect() if r.size}
            assert kept[name] == sorted(d for d, n in taken.items() for _ in range(n))
        docs = out
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out.collect())
    tokenizer, want, start = Tokenizer.from_file(PATH), [], 0
    for d, t in sorted(rows):
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_run_equals_the_stages_and_empty_input(spark, frame):
    assert corpus_pipeline.run(spark, SF).count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
