"""Operators against brute-force versions, round trips and held-out accuracy."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchloom.llm import queries as Q
from watchloom.llm.apportion import highest_quotients, mix_sources
from watchloom.llm.chat_trees import best_paths, masked_text, parsed, threads
from watchloom.llm.components import connected_components
from watchloom.llm.feistel_pii import Permutation, luhn_digit, pseudonymise
from watchloom.llm.license_rules import scan_licenses
from watchloom.llm.minhash_join import near_duplicates
from watchloom.llm.nra_topk import SortedLists, exact_topk
from watchloom.llm.url_equivalence import Rule, judge_urls
from watchloom.llm.vector_packing import pack_documents

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_feistel_is_a_cycle_without_fixed_points():
    for n in (2, 3, 10, 97, 1000):
        p = Permutation(b"key", "t", n)
        image = [p.shift(i, 1) for i in range(n)]
        assert sorted(image) == list(range(n)) and all(a != b for a, b in enumerate(image))
        assert [p.shift(i, -1) for i in image] == list(range(n))


def test_pseudonyms_keep_formats_and_come_back():
    text = "Card 4111 1111 1111 1111 / 4111111111111111, not 4111111111111112; GB82 WEST 1234 5698 7654 32; 1990-02-28, 31/12/1999, 12/31/1999, 31/02/1999; 123-45-6789; 10.0.0.1, 300.1.1.1; x.y@mail.example.com; +1 (212) 555-1234; token = \"0a1b2c3d4e5f6071\""
    new, spans = pseudonymise(text, b"key")
    assert pseudonymise(new, b"key", -1)[0] == text
    parts = {(k, new[s : s + n]) for k, s, n in spans}
    cards = [re.sub(" ", "", v) for k, v in parts if k == "card"]
    assert len(set(cards)) == 1 and luhn_digit(cards[0][:-1]) == cards[0][-1]
    assert "4111111111111112" in new and "300.1.1.1" in new and "31/02/1999" in new
    for old in ("4111111111111111", "WEST", "1990-02-28", "123-45-6789", "10.0.0.1", "x.y@", "212", "0a1b2c3d4e5f6071"):
        assert old not in new
    assert pseudonymise(text, b"other")[0] != new


def test_licenses(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification,\nare permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    rows = [(1, "Foo bar. Released under the MIT License.\nall else"), (2, "Licensed under the Apache License, Version 2.0 (the \"License\");\n you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless"), (3, bsd), (4, "MIT Licenses are nice. This license is mine."), (5, "Released under the MIT License. Licensed under CC BY-NC 4.0.")]
    got = {r["doc_id"]: r["licenses"] for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["MIT"], 2: ["Apache-2.0"], 3: ["BSD-2-Clause"], 4: [], 5: ["MIT", "CC-BY-NC-4.0"]}


def test_reply_trees_rank_branches(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a <s> ~ [~INST]", 1.0), ("t", 3, 1, "assistant", "b", 5.0), ("t", 4, 3, "user", "more", 0.0), ("t", 5, 4, "assistant", None, 9.0), (None, 1, 77, None, "alone", None), ("c", 1, 2, "user", "x", 0.0), ("c", 2, 1, "user", "y", 0.0), ("c", 3, 2, "user", "z", 0.0)]
    m = spark.createDataFrame(rows, "tree_id string, message_id long, parent_id long, role string, text string, score double")
    got = best_paths(m).select("*", parsed(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    by = {(r["tree_id"], r["leaf"]): r for r in got}
    assert set(by) == {("t", 2), ("t", 5), (None, 1)}
    assert by["t", 5]["rank"] == 1 and by["t", 2]["rank"] == 2 and by["t", 5]["score"] == 3.5
    assert [tuple(x) for x in by["t", 2]["turns"]] == [("user", "q"), ("assistant", "a <s> ~ [~INST]")] and by["t", 2]["loss"] == "a <s> ~ [~INST]"
    assert by["t", 5]["formatted"].count("</s>") == 4 and best_paths(m, top=1).count() == 2


def test_long_thread(spark):
    rows = spark.range(300).selectExpr("0 conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('t', id) text")
    got = best_paths(threads(rows), score_col=None).select(parsed(F.col("formatted")).alias("p")).collect()
    assert len(got) == 1 and [x["text"] for x in got[0]["p"]] == [f"t{i}" for i in range(300)]


def test_components_of_random_graphs(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(200)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_redirects_spread_blocks_but_not_over_allows(spark):
    link = '<link href="https://bad.net/x" rel="canonical">'
    rows = [(1, "http://a.com/1", link), (2, "http://b.com/2", '<meta http-equiv="refresh" content="0; url=http://a.com/1#top">'), (3, "http://c.org/fr/3", link), (4, "http://d.com/4", ""), (5, "http://bad.net/x", "")]
    got = {r["page_id"]: (r["verdict"], r["rule"]) for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), Q.URL_RULES).collect()}
    assert got == {1: ("block", None), 2: ("block", None), 3: ("allow", "org/fr/"), 4: ("allow", None), 5: ("block", "net/")}
    log = spark.createDataFrame([("http://d.com/4", "http://e.com/")], "u string, v string")
    more = judge_urls(spark.createDataFrame(rows[3:], "page_id long, url string, html string"), [Rule("block", "e.com", "/")], edges=log)
    assert {r["page_id"]: r["verdict"] for r in more.collect()} == {4: "block", 5: "allow"}


def _brute_components(texts, percent=85):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(low))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    both = Counter((a, b) for ids in where.values() for k, b in enumerate(ids) for a in ids[:k])
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts, n = {}, 0
    shared = " ".join(rnd.choice(words) for _ in range(30))
    for g in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([8, 60, 150, 400]))]
        for _ in range(rnd.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rnd.randrange(4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts[n] = " ".join(copy) + (" " + shared if g % 3 == 0 else "")
            n += 1
    chain = [rnd.choice(words) for _ in range(200)]
    for k in range(40):  # neighbours are alike, the ends are not: links must chain
        texts[n] = " ".join(chain[k * 3 :] + [f"n{j}" for j in range(k * 3)])
        n += 1
    texts |= {n: "A b c", n + 1: "a B c", n + 2: None, n + 3: ""}
    got = near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == _brute_components(texts)


def test_quality_counts_equal_brute_force(spark):
    got = {r["doc_id"]: r for r in Q.op7_quality_rules(spark, SF).collect()}
    for r in spark.read.parquet(SF + "/documents.parquet").collect():
        t = r["text"] or ""
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = Counter(windows)
        covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        g = got[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert g["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and (not g["base_failed"] or not g["kept"])


def test_quality_keeps_trusted_rows(spark):
    labels = spark.read.parquet(SF + "/labels.parquet")
    got = Q.op7_quality_rules(spark, SF).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {r["quality"]: r["k"] for r in got}
    assert share[1] > 0.98 and share.get(0, 0) < 0.5


@pytest.mark.parametrize("prompt", [None, "lang"])
def test_packing_cuts_and_limits(spark, prompt):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(SF + "/documents.parquet").union(spark.createDataFrame([(-1, None, None, None, 0), (-2, "a <|endoftext|> b", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long"))
    limits = {"capacity": 256, "max_segments": 6, "max_loss": 200} if prompt else {}
    rows = pack_documents(docs, ranks_path=P.path("byte_bpe_50k.tiktoken"), pattern=P.PATTERN, prompt_col=prompt, **limits).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for r in docs.collect():
        ids = (t.encode(r[prompt] or "", add_special_tokens=False).ids if prompt else []) + t.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        mine = sorted(pieces[r["doc_id"]], key=lambda p: p["start"])
        assert np.frombuffer(b"".join(p["ids"] for p in mine), "<u4").tolist() == ids
        assert all(p["doc_tokens"] == len(ids) for p in mine)
    cap, seg, loss = (256, 6, 200) if prompt else (1024, 256, 1024)
    for s in sequences.values():
        s.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in s] == [sum(q["length"] for q in s[:i]) for i in range(len(s))]
        assert sum(p["length"] for p in s) <= cap and len(s) <= seg and sum(p["n_loss"] for p in s) <= loss
    if not prompt:
        assert sum(p["length"] for p in rows) > 0.985 * cap * len(sequences)


def test_highest_quotients_equal_a_heap(spark):
    rnd = random.Random(2)
    for trial in range(4):
        w = [rnd.choice([0.0, 1.0, rnd.random() * 1000, 500.0]) for _ in range(rnd.randrange(1, 30))]
        n = rnd.randrange(0, 500)
        rows = spark.createDataFrame([(i, x, n) for i, x in enumerate(w)], "i long, w double, n long")
        got = {r["i"]: r["s"] for r in highest_quotients(rows, [], "w", "n", "s").collect()}
        seats = [0] * len(w)
        for _ in range(n if sum(w) else 0):
            best = max(range(len(w)), key=lambda i: (w[i] / (2 * seats[i] + 1), w[i]))
            seats[best] += 1
        mine = [got[i] for i in range(len(w))]
        # equal quotients may go either way
        assert sum(mine) == sum(seats) and all(abs(a - b) <= 1 for a, b in zip(mine, seats))
        assert sorted(zip(w, mine)) == sorted(zip(w, seats)) or len(set(w)) < len(w)


def _water(sizes, weights, cap):
    total, target, full = sum(sizes), [0.0] * len(sizes), set()
    while True:
        rest = total - sum(target[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        over = []
        for i in range(len(sizes)):
            if i not in full:
                target[i] = rest * weights[i] / w
                if target[i] > cap * sizes[i]:
                    over.append(i)
        if not over:
            return target
        for i in over:
            target[i] = cap * sizes[i]
            full.add(i)


def test_mix_targets_and_quotas(spark):
    rnd = random.Random(4)
    rows, n = [], 0
    for s, count in (("a", 3), ("b", 400), ("c", 50), ("é", 9), (None, 30), ("z", 1)):
        for _ in range(count):
            rows.append((n, None if n % 50 == 7 else " ".join(["w"] * rnd.randrange(0, 200)), s))
            n += 1
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mix_sources(d, keep=["source"], shard_rows=100)
    got = sorted((r.asDict(True) for r in first.collect()), key=lambda r: r["doc_id"])
    order = ["a", "b", "c", "z", "é", None]
    sizes = [sum(r["size"] for r in got if r["kept"]["source"] == s) for s in order]
    want = _water(sizes, [5, 2, 1, 5, 2, 1], 3)
    for s, size, t in zip(order, sizes, want):
        mine = [r for r in got if r["kept"]["source"] == s]
        assert all(abs(r["target"] - t) < 1e-6 * max(1, t) and r["source_size"] == size for r in mine)
        assert abs(sum(r["taken"] for r in mine) - t) <= 16
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    again = sorted((r.asDict(True) for r in mix_sources(d.repartition(7), keep=["source"], shard_rows=100).collect()), key=lambda r: r["doc_id"])
    assert got == again


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-60, 60, size=(700, 12))
    x[5:60] = x[5]
    ids = rng.permutation(5000)[:700]
    rows = spark.createDataFrame([(int(i), [int(y) for y in v]) for i, v in zip(ids, x)], "vec_id long, vector array<long>")
    got = [tuple(r) for r in exact_topk(rows, rows.where("vec_id % 50 = 0"), shard_rows=150, block_rows=5, stop_at=8).orderBy("query_id", "rank").collect()]
    want = []
    for i in sorted(i for i in ids if i % 50 == 0):
        s = x @ x[list(ids).index(i)]
        best = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:5]
        want += [(i, k + 1, ids[j], s[j]) for k, j in enumerate(best)]
    assert got == want
    lists = SortedLists(np.arange(700), np.where(x > 40, x, 0))
    assert lists.top(np.maximum(x[0], 0), 3, -1, 32)[2] < x.size  # sparse lists are not read to their ends


def test_language_id_on_held_out_rows(spark):
    got = Q.op5_language_id(spark, SF).join(spark.read.parquet(SF + "/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got) > 20
    assert all(0 <= r["score"] <= 1 for r in got)


def test_conversations_read_back(spark):
    got = Q.op3_chat_trees(spark, SF)
    assert got.count() == spark.read.parquet(SF + "/conversations.parquet").select("conv_id").distinct().count() + 1
