"""Merkle manifests, URL filters and hard negatives against plain versions and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parleylake.llm import merkle, negatives, packing, urls
from tests.llm import slow_urls
from tests.llm.fixtures import TEXTS, documents, empty, oracle


def equals_its_sql(spark, sf, query, sql):
    names, want = oracle(sf, sql)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted(repr([plain(r[c]) for c in names]) for r in query(spark, sf).collect())
    assert got == sorted(repr([plain(v) for v in r]) for r in want) and got


# merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_tree(nodes, arity):
    """The root, and for each node the siblings (left, right) of each level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, place in enumerate(at):
            lo = place - place % arity
            paths[i].append(("".join(level[lo:place]), "".join(level[place + 1 : lo + arity])))
            at[i] = place // arity
        level = [sha("".join(level[lo : lo + arity])) for lo in range(0, len(level), arity)]
    return (level or [None])[0], paths


def slow_manifest(rows, arity):
    """Of (doc_id, source, lang, n_chars, text) rows: (doc_id, leaf, subroot, root, proof, folded root)."""
    leaf = lambda r: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    groups = defaultdict(list)
    for r in rows:
        crc = zlib.crc32(str(r[0]).encode()) if r[0] is not None else 1
        start = leaf((*r[:3], r[3] + 1 if crc % 7 == 0 and r[3] is not None else r[3], r[4]))
        groups[r[2]].append((r[0], leaf(r), start))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, out = {}, []
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = slow_tree([x[1] for x in groups[g]], arity)
    root, tops = slow_tree([trees[g][0] for g in order], arity)
    for g, top in zip(order, tops):
        for (key, node, start), path in zip(groups[g], trees[g][1]):
            for left, right in path + top:
                start = sha(left + start + right)
            out.append((key, node, trees[g][0], root, sha("".join(a + b for a, b in path + top)), start))
    return out


def manifest_of(spark, rows, arity=2, levels=10):
    docs = spark.createDataFrame([(*r, None, None) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, node string, pos long").repartition(3)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.verified(merkle.manifest(docs, merkle.FIELDS, "lang", "doc_id", arity, levels, {"n_chars": tampered}))
    rows = found.select("key", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256), "folded_root", "verified").collect()
    assert all(r["verified"] == (r["root"] == r["folded_root"]) for r in rows)
    return sorted((tuple(r)[:-1] for r in rows), key=repr)


@pytest.mark.parametrize(("arity", "levels"), [(2, 10), (2, 2), (3, 1)])
def test_manifest_of_unlike_groups(spark, arity, levels):
    """A hot language, a single row, null and empty languages, repeated rows, null ids, counts and texts; several rounds of blocks."""
    rows = [(i if i % 11 else None, f"s{i % 3}" if i % 5 else None, "en" if i % 3 else ["é", "", None, "de"][i % 4], i if i % 6 else None, f"text {i % 30}" if i % 7 else None) for i in range(61)]
    rows += [(5, "s", "en", 1, "again")] * 3 + [(900, "s", "solo", 1, "x" * 100_000)]
    assert manifest_of(spark, rows, arity, levels) == sorted(slow_manifest(rows, arity), key=repr)


def test_manifest_of_few_rows(spark):
    for rows in ([], [(1, None, None, None, None)], [(7, "a", "en", 3, "abc"), (14, "a", "de", 3, "abc")]):
        assert manifest_of(spark, rows) == sorted(slow_manifest(rows, 2), key=repr)


def test_manifest_finds_every_change(spark):
    """A row that is changed, and one that isn't, on the awkward rows; without changes all is verified."""
    docs = documents(spark)
    same = merkle.verified(merkle.manifest(docs, merkle.FIELDS, "lang", "doc_id"))
    assert same.count() == len(TEXTS) and same.where("not verified").count() == 0
    for field in ("source", "text"):
        other = merkle.verified(merkle.manifest(docs, merkle.FIELDS, "lang", "doc_id", changed={field: F.when(F.col("doc_id") == 2, "other").otherwise(F.col(field))}))
        assert {r["key"] for r in other.where("not verified").collect()} == {2}
    assert merkle.manifest(empty(spark), merkle.FIELDS, "lang", "doc_id").count() == 0


def test_manifest_sql(spark, sf):
    equals_its_sql(spark, sf, merkle.op11_merkle_manifest, merkle.ORACLE)


# urls

AWKWARD = [None, "", "no scheme", "://", "http://", "http://Example.COM", "http://example.com/", "HTTP://WWW.EXAMPLE.COM/en/x?y#z", "http://example.com/en", "http://notexample.com/en/", "x://net/es/", "x://a.net/fr/q://b",
           "x://é.net/fr/ü", "https://ÀB.com?x", "http://a.org#f/en/", "http://a.net/en/" + "long/" * 5_000, "http://\x02\x03.org/\n/x", "http://com/es/", "http://.com/"]


def judged(spark, listed, **options):
    pages = spark.createDataFrame([(i, u, "gain", 1) for i, u in enumerate(listed)], "page_id long, url string, gram string, row int").repartition(3)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], round(r["score"], 9), r["threshold"]) for r in urls.filter_urls(pages, **options).collect()}


def test_urls_by_rules_and_models(spark):
    """Awkward URLs among many: rules, scores, threshold and verdicts of a plain version; repeated URLs count as often as they stand there."""
    listed = AWKWARD + [f"http://site{i % 7}.{['com', 'net', 'org'][i % 3]}/{['en', 'es', 'fr'][i // 3 % 3]}/{i}" for i in range(150)] + ["http://hot.net/es/1"] * 40
    want, limit = slow_urls.judge(listed)
    assert judged(spark, listed) == {i: (*w[:4], round(w[4], 9), limit) for i, w in enumerate(want)}


def test_urls_without_training(spark):
    """No rules: nothing is known, all scores are 0 and allowed. One class only: its model against one that knows nothing, threshold 0. No rows: none."""
    assert {v[2:] for v in judged(spark, ["http://a.org/x", None], rules=[]).values()} == {(None, "allow", 0.0, 0.0)}
    one = judged(spark, [f"http://a{i}.net/es/" for i in range(20)] + ["http://a.org/"])
    assert one[20][3] == "block" and one[20][4] < 0 and one[20][5] == 0
    assert judged(spark, []) == {}


def test_rare_and_frequent_grams_are_scored_alike(spark, monkeypatch):
    listed = [f"http://site{i % 7}.{['com', 'net', 'org'][i % 3]}/{['en', 'es', 'fr'][i // 3 % 3]}/{i}" for i in range(60)]
    whole = judged(spark, listed)
    for part in (0, 40):
        monkeypatch.setattr(urls, "FREQUENT", part)
        assert judged(spark, listed) == whole


def test_url_sql(spark, sf):
    equals_its_sql(spark, sf, urls.op12_url_filter, urls.ORACLE)


# hard negatives


def slow_negatives(rows, every=50, k=5, m=3):
    """Of (vec_id, label, vector) rows that take part."""
    last = lambda i: (i is None, i or 0)
    whole = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for at, (anchor, label, v) in enumerate(whole):
        if anchor is None or anchor % every:
            continue
        others = [(dot(v, w), i, lab) for j, (i, lab, w) in enumerate(whole) if j != at]
        own = sorted(((-s, last(i), i) for s, i, lab in others if lab == label))[:k]
        for minus, _, positive in own:
            p = -minus
            fits = sorted((-s, last(i), i) for s, i, lab in others if lab != label and 50 * p <= 100 * s <= 95 * p)[:m]
            out += [(anchor, positive, r, i, p, -s) for r, (s, _, i) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, every=50):
    table = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, label int, embedding array<double>, row int, anchor string").repartition(3)
    ready = negatives.materialize(negatives.prepared(table))
    return sorted((tuple(r) for r in negatives.mine(ready, ready.where(F.col("vec_id") % every == 0)).collect()), key=repr)


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for dim, most in ((1, 3_000_000_000), (64, 370_000_000), (64, 256), (2_500, 1_000_000), (3, 0)):
        a, b = (rng.integers(-most, most + 1, (7, dim)) for _ in range(2))
        a[0], b[0], b[1] = most, most, -most
        primes = negatives.primes_for(dim * max(most, 1) ** 2)
        got = negatives.products(negatives.residues(a, primes), negatives.residues(b, primes), primes)
        assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]


def test_negatives_by_brute_force(spark, monkeypatch):
    """Ties, repeated vectors and ids, null ids, unlike lengths, negative and zero scores; in one block and in many."""
    rng = np.random.default_rng(5)
    rows = [(int(i) if i % 9 else None, int(rng.integers(3)), [float(x) for x in np.round(rng.normal(size=8 if i % 5 else 6) * 2, int(i % 2))]) for i in range(160)]
    rows += [(7_000, 1, [1.0] * 8)] * 4 + [(50, 1, [1.0] * 8), (50, 2, [0.9] * 8), (100, 0, [0.0] * 8), (150, 2, [])] + [(200 + i, i % 3, [0.75] * 8) for i in range(40)]
    want = slow_negatives(rows, 10)
    assert mined(spark, rows, 10) == want and len(want) > 50
    for name, size in (("BLOCK", 5), ("CHUNK", 30), ("SLICE", 3), ("STEP", 7)):
        monkeypatch.setattr(negatives, name, size)
    assert mined(spark, rows, 10) == want


def test_negatives_of_awkward_rows(spark):
    bad = [(0, None, [1.0]), (50, 1, None), (100, 1, [None, 1.0]), (150, 1, [float("nan")]), (200, 1, [float("inf")]), (250, 1, [1e300])]
    assert mined(spark, bad) == [] and mined(spark, []) == [] and mined(spark, [(1, 1, [1.0])]) == [] and mined(spark, [(50, 1, [1.0])]) == []
    good = [(50, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.75, 0.0]), (3, 2, [0.2, 0.0])]
    assert mined(spark, bad + good) == slow_negatives(good) == [(50, 1, 1, 2, 65536, 49152)]


def test_negatives_sql(spark, sf):
    equals_its_sql(spark, sf, negatives.op13_hard_negatives, negatives.ORACLE)


# packing


def test_long_runs_are_encoded_as_tokenizers_does():
    """Runs of millions of blanks, newlines and one letter, at the start, inside and at the end, on both sides of the bound, with an added token."""
    import tokenizers

    path = packing.default_tokenizer()
    encode, want = packing.Encoder(path), tokenizers.Tokenizer.from_file(path)
    added = next(iter(encode.added), "")
    n = packing.BLANKS
    for text in (" " * 1_000_000 + "x", "\n" * 2_000_000 + "x", "x" + " \n\t" * 600_000, "a" * 5_000_000, "\u3000" * 1_000_000 + f"b{added} c", " " * (n - 1) + "x", " " * n + "x", f"a{added}" + " " * n + f"{added} b"):
        assert np.frombuffer(encode(text), "<u4").tolist() == want.encode(text, add_special_tokens=False).ids


def test_a_document_of_blanks_is_packed(spark):
    docs = spark.createDataFrame([(1, " " * 1_500_000 + "x"), (2, "word")], "doc_id long, text string")
    lengths = {r["doc_id"]: r["n"] for r in packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert lengths[2] == 2 and lengths[1] > 100_000
