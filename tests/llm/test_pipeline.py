"""The pipeline against a brute-force version of its stages."""

import re
import zlib

import numpy as np

import corpus_pipeline
from chronolex.llm import byte_bpe, quality
from chronolex.llm.common import tokenizer
from tests.llm.test_near_dup import brute as near
from tests.llm.test_tokens import packed
from tests.llm.test_weak import KINDS, features, spans


def masked(text):
    keys = [f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer(r'token = "([0-9a-f]{40})"', text)]
    places = sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in spans(text) + keys))
    out, at = [], 0
    for a, b, kind in places:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, -b)
    return "".join(out) + text[at:]


def test_run(spark, data, texts):
    rows = corpus_pipeline.run(spark, data).collect()
    kept = {r["row"]["doc_id"] for r in quality.judged(spark.read.parquet(f"{data}/documents.parquet")).filter("kept").collect()}
    assert not any(features(texts[d])[0] < 10 for d in kept)
    classes = near([(d, texts[d]) for d in kept])
    left = {d for d, (_, c) in classes.items() if c == d}
    assert {r["doc_id"] for r in rows} == left
    packed(rows)
    bpe = tokenizer(byte_bpe.default_files()[0])
    for d in left:
        ids = np.array([*bpe.encode(masked(texts[d]), add_special_tokens=False).ids, 2], dtype="<u4")
        pieces = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["piece"])
        assert sum(r["length"] for r in pieces) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces)
    assert re.fullmatch("email|ip|card|phone", next(iter(KINDS)))


def test_stages_keep_columns(spark, odd, empty, data):
    for table in (odd, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, data)
            assert name == "packing" or out.columns == docs.columns
            docs = out
        assert docs.count() >= 0
    once = corpus_pipeline.near_dedup(spark, odd, data)
    assert sorted(str(r["doc_id"]) for r in once.collect()) == sorted(["1", "2", "3", "4", "6", "7", "8", "9", "None"])
