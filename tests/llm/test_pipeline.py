"""The pipeline's stages, each against a plain version over its own input."""

from collections import Counter

import corpus_pipeline as C
from tokenizers import Tokenizer

from stowage.llm import mixing, pii, toxicity
from stowage.llm.common import text_rows
from stowage.llm.queries import QUERIES
from stowage.llm.tokens import WORD_BPE
from stowage.session import scratch_path

from .conftest import SF_DIR
from .test_near_duplicates import groups, shingle_set
from .test_tokens import crc


def written(spark, frame):
    path = scratch_path(spark, "stage")
    frame.write.parquet(path)
    return spark.read.parquet(path)


def test_stages(spark, documents):
    assert [stage.__name__ for _, stage in C.STAGES] == ["drop_toxic", "drop_near_duplicates", "mask_private", "mix_sources", "pack"]
    docs, inputs = documents, []
    for _, stage in C.STAGES:
        inputs.append(docs)
        docs = written(spark, stage(spark, docs, SF_DIR))
    assert all(frame.columns == documents.columns and frame.dtypes == documents.dtypes for frame in inputs)
    rows = [[tuple(r) for r in frame.collect()] for frame in inputs]

    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    scored = toxicity.score_documents(spark, inputs[0], labels).collect()
    toxic = {r["doc_id"] for r in scored if r["predicted"]}
    assert sorted(r for r in rows[0] if r[0] not in toxic) == sorted(rows[1])

    ordered = sorted(rows[1])
    group = groups([shingle_set(r[1]) for r in ordered])
    assert [r for at, r in enumerate(ordered) if group[at] == at] == sorted(rows[2])

    model = pii.train(pii.training_table(text_rows(inputs[2])))
    found = pii.find([r[1] for r in rows[2]], pii.Decoder(model))
    hidden = [(i, t := pii.mask_text(text, [*base, *added]), lang, source, len(t)) for (i, text, lang, source, _), (base, added) in zip(rows[2], found)]
    assert sorted(hidden) == sorted(rows[3])

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(inputs[3]).collect()}
    assert Counter(r for r in rows[3] for _ in range(copies[r[0]])) == Counter(rows[4])

    tokenizer = Tokenizer.from_file(WORD_BPE)
    ids = {r[0]: [*tokenizer.encode(r[1], add_special_tokens=False).ids, 1] for r in rows[4]}
    want = Counter((r[0], at, s, crc(ids[r[0]][s : s + 4096])) for r in rows[4] for at, s in enumerate(range(0, len(ids[r[0]]), 4096)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in docs.collect()) == want


def test_run_is_all_stages(spark):
    found = QUERIES["pipeline"](spark, SF_DIR)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and found.count() > 0


def test_edge_cases(spark, edge, none):
    for docs in (edge, none):
        for name, stage in C.STAGES:
            out = written(spark, stage(spark, docs, SF_DIR))
            if name != "best_fit_packing":
                assert out.columns == docs.columns
            out.collect()
            docs = out
