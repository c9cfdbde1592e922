"""Each stage of the corpus pipeline against brute force on what the stage before it kept."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from parleylake.llm import nbsvm, simhash
from tests.llm import test_operators as brute
from tests.llm.fixtures import documents, empty, table


def test_stages_in_order(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()} if name != "best-fit packing" else docs.collect())
        assert docs.columns == columns or name == "best-fit packing"
    first, unique, clean, masked, packed = kept
    whole = dict(table(sf, "documents", "doc_id, text"))
    marks = dict(table(sf, "labels", "doc_id, quality"))
    model = nbsvm.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(first) == {i for i, t in whole.items() if model.score(t) >= nbsvm.THRESHOLD}
    assert all(i in first for i, q in marks.items() if q) and sum(i in first for i, q in marks.items() if not q) <= 0.05 * sum(not q for q in marks.values())
    assert set(unique) == slow_kept(sorted(first.items())) and all(unique[i] == first[i] for i in unique)
    items = table(sf, "benchmark", "item_id, text")
    grams = {tuple(w[k : k + 10]) for _, t in items for w in [brute.WORD.findall((t or "").translate(brute.A2Z))] for k in range(max(1, len(w) - 9))}

    def leaks(text):
        w = brute.WORD.findall((text or "").translate(brute.A2Z))
        return any(tuple(w[k : k + 10]) in grams for k in range(len(w) - 9))

    assert set(clean) == {i for i, t in unique.items() if not leaks(t)}
    assert set(masked) == set(clean)
    held = {i: (s, lang) for i, s, lang in table(sf, "documents", "doc_id, source, lang")}
    order = sorted(clean)
    found = brute.slow_secrets([(clean[i], held[i][0], "/".join(x for x in held[i] if x is not None)) for i in order])
    for i, (_, live, *_) in zip(order, found, strict=True):
        text, at = "", 0
        for start, end in live:
            text, at = text + (clean[i][at:start] + "[SECRET]" if start >= at else ""), max(at, end)
        assert masked[i] == (text + clean[i][at:] if live else clean[i]), i
    assert any(live for _, live, *_ in found)
    from parleylake.llm import packing
    from tokenizers import Tokenizer

    brute.check_packed(packed, list(masked.items()), Tokenizer.from_file(packing.default_tokenizer()))


def test_stages_take_awkward_rows(spark, sf, tmp_path):
    for name, docs in (("rows", documents(spark)), ("none", empty(spark))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            out.write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
        assert name == "rows" or docs.count() == 0


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in names if x.startswith("op")}


def _sets(text):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def slow_kept(texts):
    """Ids of the smallest document of each group, by op4's links and by five-word shingles at 0.8, every pair compared."""
    sets, near = [_sets(t) for _, t in texts], []
    for a in range(len(texts)):
        for b in range(a):
            least, most = sorted((len(sets[a]), len(sets[b])))
            if least and least / most >= 0.8 and (both := len(sets[a] & sets[b])) / (least + most - both) >= 0.8:
                near.append((b, a))
    prints = [brute.slow_print(t) for _, t in texts]
    bits = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    roots = brute.roots(len(texts), near + bits)
    return {min(i for (i, _), r in zip(texts, roots, strict=True) if r == root) for root in set(roots)}


def test_near_copies_by_the_general_rule_go(spark, sf):
    """Five-word shingles at 0.8 by brute force, joined with op4's links, on whole documents and on a group too large for all pairs."""
    words = [f"w{k}" for k in range(120)]
    copies = [(10**6 + k, " ".join([*words[:40], f"copy{k}", *words[41:]])) for k in range(3 * simhash.FEW)]
    texts = sorted(table(sf, "documents", "doc_id, text")) + copies
    want = slow_kept(texts)
    got = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == want and len(want) < len(set(brute.slow_groups([(i, brute.slow_print(t)) for i, t in texts])))


def test_near_copies_among_texts_that_share_a_passage(spark):
    """Hundreds of texts share half of their words, so all their bands are large; near copies among them still meet."""
    rng, passage, texts = np.random.default_rng(3), [f"common{k}" for k in range(140)], []
    for k in range(500):
        own = [f"own{k}x{j}" for j in range(50)]
        texts.append((k, " ".join(passage + own)))
        if k % 4 == 0:
            own[int(rng.integers(50))] = "changed"
            texts.append((1000 + k, " ".join(passage + own)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    large = simhash.signatures(docs).select("key", F.explode("bands").alias("band")).groupBy("band").count().where(f"count > {simhash.FEW}").count()
    want = slow_kept(sorted(texts))
    got = {r["doc_id"] for r in simhash.deduplicate(docs).collect()}
    assert large > 20 and got == want and want == set(range(500))


def test_texts_of_several_groups_under_one_id_stay(spark):
    fox, wolf = (" ".join(f"{x}{k}" for k in range(40)) for x in ("fox", "wolf"))
    docs = spark.createDataFrame([(1, fox), (1, wolf), (1, wolf), (2, fox), (3, wolf + " end")], "doc_id long, text string")
    assert sorted(simhash.deduplicate(docs).collect()) == [(1, fox), (1, wolf)]


def test_sketches_keep_pairs_at_the_limit():
    """Sets whose similarity is 0.8 exactly, small and large, pass the count of unlike MinHashes; it is the count of unlike bits."""
    rng, seen = np.random.default_rng(5), []
    for size in (4, 8, 40, 400) * 150:
        shared, one, two = np.split(rng.integers(0, 2**64, size + size // 4, dtype=np.uint64), [size, size + size // 8])
        least = [simhash.minima(np.concatenate([shared, own])) for own in (one, two)]
        a, b = (np.array(simhash.sketch(x), np.int64).reshape(simhash.BITS, 2) for x in least)
        either = np.bitwise_or.reduce(a ^ b, axis=0)
        low = [(x >> np.uint64(simhash.SHIFT)) & np.uint64(2**simhash.BITS - 1) for x in least]
        seen.append(sum(int(x).bit_count() for x in either.view(np.uint64)))
        assert seen[-1] == (low[0] != low[1]).sum()
    assert max(seen) <= simhash.MOST_UNLIKE and 17 < np.mean(seen) < 28


def test_unlike_counts_minhashes(spark):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(12)]
    least = [simhash.minima(x) for x in sets]
    rows = [(i, j, simhash.sketch(least[i]), simhash.sketch(least[j])) for i in range(12) for j in range(12)]
    got = spark.createDataFrame(rows, "i int, j int, a array<long>, b array<long>").select("i", "j", simhash.unlike("a", "b").alias("n")).collect()
    low = [(x >> np.uint64(simhash.SHIFT)) & np.uint64(2**simhash.BITS - 1) for x in least]
    assert all(r["n"] == (low[r["i"]] != low[r["j"]]).sum() for r in got) and len(got) == 144
