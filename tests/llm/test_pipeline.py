"""Each stage of the corpus pipeline against a brute-force version, on its own input."""

from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from tests.llm.test_operators import WORD, _brute_components, _water
from watchloom.llm import queries as Q
from watchloom.llm.feistel_pii import pseudonymise

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    docs = spark.read.parquet(SF + "/documents.parquet")
    rows = [[r.asDict() for r in docs.collect()]]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pii", "mix", "packing"]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        held = [r.asDict() for r in out.collect()]
        rows.append(held)
        if len(rows) < 6:
            assert out.columns == corpus_pipeline.COLUMNS
            docs = spark.createDataFrame(held, out.schema)  # each stage works on what the one before it returned
    before, good, single, private, mixed, pieces = rows

    def base_failed(text):
        w = WORD.findall(text or "")
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = Counter(windows)
        return len(w) < 10 or 100 * len({j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 5)}) > 20 * len(w)

    kept = {r["doc_id"] for r in Q.op7_quality_rules(spark, SF).where("kept").collect()}
    assert {r["doc_id"] for r in good} == kept and not any(base_failed(r["text"]) for r in good)
    comps = _brute_components({r["doc_id"]: r["text"] for r in good}, 80)  # without a contract of its own the stage links from 0.8
    assert sorted(r["doc_id"] for r in single) == sorted({c for _, c in comps.values()})
    texts = {r["doc_id"]: r["text"] for r in single}
    assert {r["doc_id"]: r["text"] for r in private} == {i: pseudonymise(t, Q.PSEUDONYM_KEY)[0] for i, t in texts.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in private)

    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in private}
    order = sorted({r["source"] for r in private}, key=lambda s: (s is None, s or ""))
    have = [sum(size[r["doc_id"]] for r in private if r["source"] == s) for s in order]
    want = _water(have, [[5, 2, 1][i % 3] for i in range(len(order))], 3)
    copies = Counter(r["doc_id"] for r in mixed)
    assert max(copies.values()) <= 3 and set(copies) <= set(size)
    for s, target in zip(order, want):
        longest = max(size[r["doc_id"]] for r in private if r["source"] == s)
        assert abs(sum(size[r["doc_id"]] for r in mixed if r["source"] == s) - target) <= longest / 2 + 16

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by = defaultdict(int)
    for p in pieces:
        by[p["doc_id"]] += p["length"]
    for r in private:
        n = len(t.encode(r["text"], add_special_tokens=False).ids) + 1
        assert by[r["doc_id"]] == n * copies[r["doc_id"]]
    load = Counter()
    for p in pieces:
        load[p["sequence_id"]] += p["length"]
    assert max(load.values()) <= 1024 and np.mean(list(load.values())) > 0.95 * 1024


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None
