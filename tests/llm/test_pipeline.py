import hashlib
import os
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from palaver.llm import bpe
from palaver.llm import decontaminate as dc
from palaver.llm.shared import table
from tests.llm.test_linededup import stretches as brute_lines
from tests.llm.test_minhash import brute as brute_near

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_against_brute_force(spark, tmp_path):
    rows = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    passages = ["".join(map(chr, dc.normalise(r.text)[0])) for r in table(spark, SF, "benchmark").collect()]
    with_letter = {i: t for i, t in rows.items() if t and re.search(r"[^\W\d_]", t)}
    deduped = {i: t for i, t in brute_lines(list(with_letter.items())).items() if t and t.strip()}
    kept = {i: t for i, t in deduped.items() if brute_near_cache(deduped)[i][2]}
    # passages stand in these texts either whole or not at all
    clean = {i: t for i, t in kept.items() if not any(p in "".join(map(chr, dc.normalise(t)[0])) for p in passages)}
    library = Tokenizer.from_file(bpe.default_vocabulary())
    want = {}
    for i, t in clean.items():
        ids = library.encode(t, add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want[i] = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in cp.run(spark, SF).collect()} == want
    assert len(want) < len(kept) < len(deduped) <= len(rows)


_NEAR = {}


def brute_near_cache(rows):
    if not _NEAR:
        _NEAR.update(brute_near(rows.items()))
    return _NEAR


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents").selectExpr("*", "n_chars as band", "lang as rep").limit(30)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
