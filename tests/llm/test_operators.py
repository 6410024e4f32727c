"""Each training-data operator against brute force, exact round trips or held-out accuracy, and on odd tables."""

import json
import math
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path
from urllib.parse import urlsplit

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from packwright.llm import chat, common, decontam, html_extract, langid, media, ngram_join, packing, quality, queries, token_output, tokens, url_filter

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double"
ODD = [(1, None, None, None, None, 0.5), (2, "", "en", "s", 0, None), (None, "a b", "en", None, 3, 1.0), (4, "... !!! 123", "fr", "s", 11, 0.0), (5, "Tie tie. " * 9, "en", "s", 81, 0.1), (5, "Tie tie. " * 9, "en", "s", 81, 0.1), (6, "word " * 30000, "en", "s", 150000, 0.2), (2**60 + 1, "a\x00b ퟿", "de", "s", 5, 0.3)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return re.findall(r"\w+", (text or "").lower())


# 1 -------------------------------------------------------------------------------------------------------


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_classes(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {i: root(i) for i in ids}


def brute_links(rows):
    """Of each row, how many different texts are similar to its own."""
    sets = {t: frozenset(shingles(t)) for _, t in rows}
    return {i: sum(t != u and len(sets[t] & b) / len(sets[t] | b) >= 0.8 for u, b in sets.items() if b) if sets[t] else 0 for i, t in rows}


@pytest.mark.parametrize("sizes", [(1024, 8 << 20), (3, 8 << 20), (1024, 2000)])
def test_near_duplicates_equal_brute_force(spark, sizes, monkeypatch):
    """Classes of one block, and cut into blocks by texts and by bytes."""
    monkeypatch.setattr(ngram_join, "CLASS_BLOCK", sizes[0])
    monkeypatch.setattr(ngram_join, "LEAST_BLOCK", min(sizes[0], 128))
    monkeypatch.setattr(ngram_join, "CLASS_BYTES", sizes[1])
    random.seed(3)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for _ in range(30):
        base = random.choices(vocabulary, k=random.randint(20, 120))
        for edits in (0, 0, 1, 1, 2, 4, 8):
            own = list(base)
            for _ in range(edits):
                own[random.randrange(len(own))] = random.choice(vocabulary)
            rows.append((n, " ".join(own).upper() + "." if n % 11 == 0 else " ".join(own)))
            n += 1
    got = {r["doc_id"]: r for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert {i: r["n_links"] for i, r in got.items()} == brute_links(rows)
    copies = {}
    for i, t in rows:
        copies.setdefault(frozenset(shingles(t)), []).append(i)
    assert all(got[i]["n_copies"] == len(copies[frozenset(shingles(t))]) and got[i]["text_id"] == min(copies[frozenset(shingles(t))]) for i, t in rows)


def test_counts_by_columns(monkeypatch):
    """Intersections summed over few columns at a time, with an empty set, within a block and between two."""
    monkeypatch.setattr(ngram_join, "COLUMNS", 7)
    rng = np.random.RandomState(1)
    base = rng.permutation(60).astype(np.uint64)
    sets = [np.sort(np.delete(base, rng.choice(60, k, replace=False))) for k in (0, 1, 2, 5, 9, 20, 40, 60, 3, 4)]
    near = np.array([[i != j and len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b))) >= 0.8 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    packed, every = [x.tobytes() for x in sets], np.arange(10)
    assert (ngram_join.similar_counts(packed, every, every, 0.8) == near.sum(axis=1)).all()
    left, right = every[:4], every[4:]
    want = np.concatenate([near[:4, 4:].sum(axis=1), near[:4, 4:].sum(axis=0)])
    assert (ngram_join.similar_counts(packed, left, right, 0.8) == want).all()


def random_links():
    """A path, a star, a cycle and random links, with ids far apart: links, and the least id of each end's component."""
    rng = random.Random(5)
    names = [k * 10_000_019 for k in rng.sample(range(10**6), 400)]
    pairs = [*zip(names[:90], names[1:90]), *((names[90], x) for x in names[91:200]), *zip(names[200:230], [*names[201:230], names[200]]), *(rng.sample(names[230:], 2) for _ in range(120))]
    links = sorted({(min(p), max(p)) for p in pairs})
    least = {x: x for p in links for x in p}
    while moved := [p for p in links if least[p[0]] != least[p[1]]]:
        for a, b in moved:
            least[a] = least[b] = min(least[a], least[b])
    return links, {x: c for x, c in least.items() if x != c}


@pytest.mark.parametrize("one_task, jobs", [(2_000_000, 4), (0, None)])
def test_components_of_few_links_take_no_rounds_of_jobs(spark, one_task, jobs, monkeypatch):
    """In one task and by stars the same components; a few links are not shuffled over all partitions round by round."""
    monkeypatch.setattr(ngram_join, "ONE_TASK_LINKS", one_task, raising=False)
    monkeypatch.setattr(ngram_join, "OUT_ROWS", 7, raising=False)
    links, want = random_links()
    made = common.materialize(spark.createDataFrame(links, "a long, b long"), "test_links")
    spark.sparkContext.setJobGroup(f"components {one_task}", "")
    found = ngram_join.components(made)
    ran = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {one_task}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r["uid"]: r["comp"] for r in found.collect()} == want
    assert ran and (jobs is None or ran <= jobs)
    assert ngram_join.components(made.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1 << 28, 1000])
def test_known_hashes_keep_all_that_join(spark, most, monkeypatch):
    """Each row with a known hash stays, also when the table is full; with room, few others do."""
    monkeypatch.setattr(ngram_join, "MOST_BITS", most)
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    left = rows.unionByName(rows.where("id < 10")).unionByName(spark.createDataFrame([(-1, None), (-2, -(2**63)), (-3, 2**63 - 1)], "id long, h long"))
    right = left.where("id % 10 = 0 or id < -1").select("h").distinct()
    got = ngram_join.with_known_hash(left, right, "h")
    assert got.columns == left.columns
    assert got.join(right, "h").count() == left.join(right, "h").count() == 2003
    assert got.count() < 4_000 or most == 1000


def test_shared_files_have_no_files_beside_them_and_are_still_verified(spark, monkeypatch):
    """One process start less for each file; a byte that changed in a page is found by Parquet's checksum."""
    seen = []
    monkeypatch.setattr(common, "new_path", lambda s, label, f=common.new_path: (seen.append(f(s, label)), seen[-1])[1])
    rows = spark.range(0, 4000, 1, 4).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    made = common.materialize(rows, "test_files", "uncompressed")
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, rows.collect()))
    folder = Path(urlsplit(seen[0]).path)
    assert not list(folder.glob(".*.crc"))
    parts = sorted(folder.glob("part-*"))
    assert len(parts) == 4
    data = bytearray(parts[0].read_bytes())
    data[data.index(made.where("id = 7").first()["text"].encode()) + 5] ^= 1
    parts[0].write_bytes(data)
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        common.materialize(made, "test_again").collect()


def test_pruning_table_is_made_once(monkeypatch):
    made, comb = [], math.comb
    monkeypatch.setattr(ngram_join.math, "comb", lambda n, k: made.append(n) or comb(n, k))
    a = np.zeros((1, ngram_join.N_HASHES))
    for _ in range(3):
        ngram_join.survivors(a, a, 0.8125)
    assert len(made) < 2 * sum(ngram_join.least_matches(0.8125) + 1)


def test_star_of_variants_is_one_class(spark):
    """Variants that are near the base, but not each other."""
    base = [f"b{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for k in range(1, 30):
        own = list(base)
        for j in range(3):
            own[(k * 6 + j * 61) % 200] = f"v{k}x{j}"
        rows.append((k, " ".join(own)))
    want = brute_classes(rows)
    got = {r["doc_id"]: r["class_id"] for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("partitions, coalesce, batch, hot", [(1, True, 512, 256), (40, False, 512, 3), (8, False, 1, 256)])
def test_heads_that_miss_links(spark, partitions, coalesce, batch, hot, monkeypatch):
    """Edits shared by many variants, so that links go between members of different stars; groups alone in a partition, batches of one row, many hot keys."""
    monkeypatch.setattr(common, "BATCH_ROWS", batch)
    monkeypatch.setattr(ngram_join, "HOT_ROWS", hot)
    rng = random.Random(8)
    base = [f"b{k}" for k in range(200)]
    edits = [(rng.randrange(200), f"e{k}") for k in range(2000 if batch > 1 else 60)]
    rows = []
    for n in range(250 if batch > 1 else 40):
        own = list(base)
        for at, word in rng.sample(edits, 3):
            own[at] = word
        rows.append((n, " ".join(own)))
    saved = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(coalesce).lower())
        got = {r["doc_id"]: r for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert {i: r["class_id"] for i, r in got.items()} == brute_classes(rows)
    assert {i: r["n_links"] for i, r in got.items()} == brute_links(rows)


def test_texts_that_share_a_doc_id(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(7, a), (7, b), (7, b), (9, a + " x"), (11, b + " y"), (None, a), (12, None)]
    made = spark.createDataFrame([(*r, 1, 2, "u") for r in rows], "doc_id long, text string, class_id int, bands int, uid string")
    got = sorted((r["doc_id"], r["class_id"], r["n_copies"], r["n_links"]) for r in ngram_join.near_duplicates(made).collect() if r["doc_id"])
    assert got == [(7, 7, 1, 1), (7, 7, 2, 1), (7, 7, 2, 1), (9, 7, 1, 1), (11, 7, 1, 1), (12, 12, 1, 0)]


def test_pruning_keeps_the_similar():
    rng = np.random.RandomState(0)
    a = rng.randint(0, 60_000, (5000, ngram_join.N_HASHES))
    same = rng.rand(5000, ngram_join.N_HASHES) < 0.8
    b = np.where(same, a, rng.randint(0, 60_000, a.shape))
    assert len(ngram_join.survivors(a, b)) >= 4990
    assert len(ngram_join.survivors(a, rng.randint(0, 60_000, a.shape))) == 0


def test_near_duplicates_odd(odd, docs):
    got = ngram_join.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert ngram_join.near_duplicates(odd, with_links=False).columns == ["doc_id", "text_id", "n_copies", "class_id"]
    assert all(r["n_links"] == 0 for r in got)
    assert by[5]["n_copies"] == 2 and by[1]["class_id"] == 1 and by[None]["class_id"] is None
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


# 2 -------------------------------------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()}
    items = [(r["item_id"], " ".join(words(r["text"]))) for r in bench.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in items if t and f" {t} " in f" {' '.join(words(r['text']))} "}
    assert want <= got
    assert len(got - want) <= 0.05 * len(want) + 1  # what is near an item, as the next test has it


def brute_leaks(docs, items):
    """Every passage of every document against every item, by the definitions."""
    said = {k: words(t) for k, t in items if words(t)}
    n, mean = len(said), sum(map(len, said.values())) / len(said)
    df = Counter(w for t in said.values() for w in set(t))
    runs = lambda t, m: {tuple(t[k : k + m]) for k in range(len(t) - m + 1)}
    found = {}
    for item, own in said.items():
        weight = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w, tf in Counter(own).items()}
        half = 64
        while half < len(own):
            half *= 2
        parts = [p for p in map(words, decontam.split_item(dict(items)[item])) if p]
        for doc, text in docs:
            t = words(text)
            for at in range(0, len(t), half):
                passage = t[at : at + 2 * half]
                score = sum(weight.get(w, 0) for w in set(passage)) / sum(weight.values())
                shares = [len(runs(p, min(3, len(p))) & runs(passage, min(3, len(p)))) / len(runs(p, min(3, len(p)))) for p in parts]
                if score >= 0.5 and min(shares) >= 0.7:
                    found[doc, item] = max(found.get((doc, item), 0), score)
    return found


@pytest.mark.parametrize("index_bytes", [16 << 20, 900])
def test_leaks_equal_definitions(spark, index_bytes, monkeypatch):
    """Whole, changed, torn and near items of 3 to 400 words in texts of up to 900."""
    monkeypatch.setattr(decontam, "INDEX_BYTES", index_bytes)
    rng = random.Random(11)
    some = lambda k: [f"w{int(rng.paretovariate(0.7))}" for _ in range(k)]
    items = [(k, f"{' '.join(some(q))}? {' '.join(some(a))}") for k, (q, a) in enumerate([(3, 1), (9, 2), (20, 4), (30, 0), (40, 30), (60, 3), (64, 1), (120, 10), (380, 20), (9, 9), (2, 2)])]
    docs = []
    for n in range(60):
        own = some(rng.choice([0, 5, 60, 300, 900]))
        said = words(rng.choice(items)[1])
        for at in rng.sample(range(len(said)), int(len(said) * rng.choice([0, 0, 0.05, 0.1, 0.3]))):
            said[at] = "other"
        cut = rng.choice([0, 0, 0, len(said) // 4, len(said) // 2])
        place = rng.randint(0, len(own))
        docs.append((n, " ".join([*own[:place], *said[cut:], *own[place:]])))
    made = spark.createDataFrame([(*d, 1.0, 2) for d in docs], "doc_id long, text string, score double, item_id int")
    bench = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.find_leaks(made, bench).collect()}
    want = brute_leaks(docs, items)
    assert set(got) == set(want) and len(want) > 20 and all(abs(got[k] - min(1, want[k])) < 1e-6 for k in want)


def test_search_equals_full_scoring():
    random.seed(5)
    vocabulary = [f"w{int(random.paretovariate(0.4))}" for _ in range(300)]
    items = [(k, " ".join(random.choices(vocabulary, k=random.randint(3, 40)))) for k in range(120)]
    hashed = [decontam.word_hashes([t])[0] for _, t in items]
    df = {}
    for h in hashed:
        for w in set(h.tolist()):
            df[w] = df.get(w, 0) + 1
    (index,) = decontam.Index.build_all(items, len(items), sum(map(len, hashed)) / len(items), df)
    full = np.zeros((len(items), len(index.terms)))
    for t in range(len(index.terms)):
        full[index.item[index.start[t] : index.start[t + 1]], t] = index.weight[index.start[t] : index.start[t + 1]]
    for k in range(60):
        passage = " ".join(random.choices(vocabulary, k=30)) + " " + items[k][1]
        h = decontam.word_hashes([passage])[0]
        score = full[:, np.isin(index.terms, h)].sum(axis=1)
        want = {i for i in range(len(items)) if score[i] >= decontam.SCORE - 1e-9}
        assert {i for i, _ in index.search(h)} == want and k in want
        assert index.open_windows(h, np.array([0, len(h)]))


def test_leaks_odd(spark, odd):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "tie tie tie tie"), (None, "word word"), (4, "One two. Three four five."), (5, "One two. Three four five.")], "item_id long, text string")
    got = decontam.find_leaks(odd.unionByName(spark.createDataFrame([(9, "so ONE two, three four FIVE so", "en", "s", 1, 0.0)], DOC)), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(5, 3), (9, 4), (9, 5)}
    assert decontam.find_leaks(odd.limit(0), bench).count() == 0 and decontam.find_leaks(odd, bench.limit(0)).count() == 0


def test_sharded_index_agrees(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {tuple(r) for r in decontam.find_leaks(docs, bench).select("doc_id", "item_id").collect()}
    monkeypatch.setattr(decontam, "INDEX_BYTES", 3000)
    assert {tuple(r) for r in decontam.find_leaks(docs, bench).select("doc_id", "item_id").collect()} == whole


# 3, 4 ----------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op3_quality(spark, sf).where("held_out").join(labels, "doc_id").toPandas()
    assert ((got.predicted == 1) == (got.quality == 1)).mean() > 0.9
    assert got.score.between(0, 1).all()


def test_quality_scores_are_gaussian_densities(spark):
    """Scores against densities written out: covariances shrunk to the pooled one and to its diagonal, no Cholesky factor."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (pd.read_parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    x = {i: np.array(quality.statistics(t)) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    train = [(x[i], y) for i, y in zip(labels.doc_id, labels.quality, strict=True) if i in x and y in (0, 1) and zlib.crc32(str(i).encode()) % 4 != 2]
    own = [np.array([v for v, y in train if y == k]) for k in (0, 1)]
    covs = [np.cov(v.T, bias=True) for v in own]
    pooled = sum(len(v) * c for v, c in zip(own, covs, strict=True)) / len(train)
    terms = []
    for v, c in zip(own, covs, strict=True):
        c = 0.98 * (0.8 * c + 0.2 * pooled) + 0.02 * np.diag(np.maximum(np.diag(pooled), 1e-6))
        terms.append((v.mean(axis=0), np.linalg.inv(c), math.log(len(v) / len(train)) - 0.5 * np.linalg.slogdet(c)[1]))
    for r in quality.score_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect():
        density = [t - 0.5 * (x[r["doc_id"]] - m) @ inverse @ (x[r["doc_id"]] - m) for m, inverse, t in terms]
        want = 1 / (1 + math.exp(min(50.0, max(-50.0, density[0] - density[1]))))
        assert abs(r["score"] - want) < 1e-4 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, None, 0), (5, 1, 0), (6, 0, 0), (None, 1, 0), (77, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(odd, labels)
    assert got.count() == len(ODD) and got.where("score is null or score < 0 or score > 1").count() == 0
    assert got.where("doc_id = 1152921504606846977").count() == 1  # exact beside a null
    assert {r["score"] for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(odd, labels.limit(0)).count() == len(ODD)
    assert quality.score_quality(odd.limit(0), labels).count() == 0


def test_language_held_out(spark):
    got = queries.op4_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95


def test_bundle_is_sum_of_bound_vectors():
    letters = langid.letter_vectors().astype(float)
    table = langid._symbol_table()
    text = "aé b"
    s = [0, *table[[ord(c) for c in text]], 0]
    want = sum(letters[0][s[k]] * letters[1][s[k + 1]] * letters[2][s[k + 2]] for k in range(len(s) - 2))
    got = langid.bundle([text])[0]
    assert np.allclose(got, want / np.linalg.norm(want), atol=1e-5)


def test_languages_equal_brute_force(spark, docs):
    """Prototypes and predictions from vectors bound and summed one n-gram at a time."""
    letters, table = langid.letter_vectors().astype(float), langid._symbol_table()
    own = docs.limit(40).toPandas()
    own.loc[3, "text"] = "ы ю 漢字 ж"

    def vector(text):
        s = [0]
        for c in (text or "").lower():
            s.append(int(table[ord(c)]))
        s = [x for k, x in enumerate([*s, 0]) if k == 0 or x or s[k - 1]]
        grams = [letters[0][a] * letters[1][b] * letters[2][c] for a, b, c in zip(s, s[1:], s[2:], strict=False)]
        return np.sum(grams, axis=0) / len(grams)

    vectors = [vector(t) for t in own.text]
    unit = lambda v: v / np.linalg.norm(v)
    sums = {}
    for i, lang, v in zip(own.doc_id, own.lang, vectors, strict=True):
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            sums[lang] = sums.get(lang, 0) + v
    names = sorted(sums)
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(own[["doc_id", "text", "lang"]])).collect()}
    for i, v in zip(own.doc_id, vectors, strict=True):
        cosine = [float(unit(v) @ unit(sums[n])) for n in names]
        assert got[i]["lang_pred"] == names[int(np.argmax(cosine))] and abs(got[i]["score"] - max(0.0, *cosine)) < 1e-4


def test_language_odd(odd):
    got = {(r["doc_id"], r["lang_pred"], r["score"] > 0) for r in langid.identify(odd).collect()}
    assert {(1, "und", False), (2, "und", False), (4, "und", False)} <= got
    assert langid.identify(odd, odd.limit(0)).where("lang_pred != 'und'").count() == 0
    assert langid.identify(odd.limit(0), odd).count() == 0


# 5, 9 ----------------------------------------------------------------------------------------------------


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def library_ids(tokenizer, texts):
    return [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("sizes", [(1 << 19, 1 << 18), (7, 1 << 18), (40, 5)])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_equal_library(name, sizes, monkeypatch):
    """Texts whole and cut into chunks, with a table that starts anew all the time, and with strings of added tokens."""
    monkeypatch.setattr(tokens, "CHUNK", sizes[0])
    monkeypatch.setattr(tokens, "TABLE_PIECES", sizes[1])
    tokens._tables.clear()
    encoder, own = tokens.Encoder(public_tokenizers.path(name)), library(name)
    added = st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "a", " ", " b c", "\n"]), max_size=5).map("".join)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.one_of(st.text(max_size=40), added, st.text(alphabet="ab1 2\n\t'srtdvmle!?.É́ß漢½  　Zz", max_size=60)), max_size=6))
    def same(texts):
        assert encoder.encode_many(texts) == library_ids(own, texts)

    same()
    newer = [":\U00013460", "a\U00013460b é", "1\U00010d40 2", "x\ua7cbY", "!\uffff?", "plain é", "a <|endoftext|> b"]
    assert encoder.encode_many(newer) == library_ids(own, newer)
    rng = random.Random(4)
    long = " ".join(rng.choice(["a", "it's", "1 2", "x,  y", "\n\nb", "É"]) + str(rng.randrange(50)) for _ in range(3000))
    assert encoder.encode_many([long, "", long[:9]]) == library_ids(own, [long, "", long[:9]])
    tokens._tables.clear()


def test_table_of_pieces_stays_small():
    encoder, rng = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json")), random.Random(1)
    for _ in range(8):
        encoder.encode_many([" ".join("".join(rng.choices("abcdefgh", k=8)) for _ in range(60_000))])
        assert len(encoder.table.key) <= tokens.TABLE_PIECES and (np.diff(encoder.table.key.astype(object)) > 0).all()
    assert max(len(x) for x in tokens._tables.values()) <= max(2 * tokens.CHUNK, 0x110000)


def check_pieces(rows, texts, encode):
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for doc, text in texts.items():
        ids = [*encode(text or ""), packing.END_ID]
        own = sorted(by[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == 1024 for r in own[1:])
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert zlib.crc32(part) == r["ids_crc32"]


def check_layout(rows):
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(seqs)


def test_packing(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(docs, path).collect()
    own = Tokenizer.from_file(path)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check_pieces(rows, texts, lambda t: own.encode(t, add_special_tokens=False).ids)
    total = sum(r["length"] for r in rows)
    assert check_layout(rows) <= total / 1024 * 1.05 + 2


def test_packing_odd(odd):
    rows = packing.pack(odd, public_tokenizers.path("byte_bpe_50k.json")).collect()
    check_layout(rows)
    assert sum(r["doc_id"] == 5 for r in rows) == 2 and {r["length"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert packing.pack(odd.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.integers(1, 500)), max_size=30))
def test_plan_places_everything_once(lengths):
    histogram = np.zeros(65, np.int64)
    for length, n in lengths:
        histogram[length] += n
    runs, n_seq = packing.plan(histogram, 64)
    ranks, seqs = {}, {}
    for length, first, count, seq, offset in runs:
        for i in range(count):
            assert (length, first + i) not in ranks
            ranks[length, first + i] = 1
            seqs.setdefault(seq + i, []).append((offset, length))
    assert len(ranks) == histogram.sum() and all((v, k) in ranks for v in range(65) for k in range(histogram[v]))
    assert len(seqs) == n_seq
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


@pytest.mark.parametrize("small", [False, True])
def test_token_files_round_trip(spark, docs, odd, tmp_path, small, monkeypatch):
    if small:  # several shards in several groups, read in short ranges
        for name, value in (("LEAST_BYTES", 1), ("GROUP_SHARDS", 2), ("READ_DOCS", 7), ("READ_IDS", 50)):
            monkeypatch.setattr(token_output, name, value)
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    rows = token_output.token_files(docs.repartition(3), path, folder=f"file://{tmp_path}/out").orderBy("doc_id").collect()
    at = 0
    for r, d in zip(rows, docs.orderBy("doc_id").collect(), strict=True):
        ids = [*own.encode(d["text"] or "", add_special_tokens=False).ids, token_output.END_ID]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = token_output.token_files(odd, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 4, 5, 5, 6, 2**60 + 1]
    assert token_output.token_files(odd.limit(0), path).count() == 0
    with pytest.raises(Exception, match="does not fit"):
        token_output.token_files(docs, path, dtype="u1").count()


# 6 -------------------------------------------------------------------------------------------------------

STOPPED = "It was the best of times and it was the worst of times for all of the people in this city. "


def test_html():
    page = f"""<!DOCTYPE html><html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body><header><h1>Site name</h1></header>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice">We use cookies on this site and you accept it by reading on. {STOPPED}</div>
<article><h2>Caf&eacute; &amp; co</h2><p>{STOPPED * 3}<p>Short.</p><!-- <p>hidden</p> --><p>Bold <b>and</b>
 <i>more</i>&nbsp;text &lt;3</p></article><aside>Side {STOPPED}</aside><section id="comments"><p>Reader: {STOPPED}</p></section><form><label>Name</label></form><footer>&copy; 2024 Us</footer></body></html>"""
    assert html_extract.main_text(page) == f"Café & co\n{(STOPPED * 3).strip()}\nShort.\nBold and more text <3"
    plain = f"<body><div><p>{STOPPED * 3}</p><p>Yes.</p><p>{STOPPED * 3}</p></div><div><a href=x>One</a> <a href=y>Two</a></div></body>"
    assert html_extract.main_text(plain) == f"{(STOPPED * 3).strip()}\nYes.\n{(STOPPED * 3).strip()}"
    for broken in (None, "", "<", "<p", "<p>" * 5000, "</div></div>", "<a href='", "<script>", "&#xZZ; &amp"):
        assert isinstance(html_extract.main_text(broken), str)


def test_html_article_keeps_links_and_copyright():
    cited = f"The notice © 2001 is cited here. {STOPPED}"
    links = "<p><a href=x>One</a> <a href=y>Two</a></p>"
    said = html_extract.main_text(f"<article><p>See the <a href=r>full report</a> today.</p><p>{cited}</p>{links}<p>&copy; is a sign.</p></article><p>&copy; 2024 Us</p>")
    assert said == f"See the full report today.\n{cited.strip()}\nOne Two\n© is a sign."
    body = f"<p>{STOPPED * 3}</p>"
    said = html_extract.main_text(f"<body>{body}<p>See the long and full <a href=r>report</a>.</p><p>© marks it.</p><p>{cited * 3}</p>{body}<div>© 2024 Us</div>{links}")
    assert said == "\n".join([(STOPPED * 3).strip(), "See the long and full report.", "© marks it.", (cited * 3).strip(), (STOPPED * 3).strip()])


def test_html_wrappers_with_drop_words():
    text = (STOPPED * 3).strip()
    noise = f'<div class="sidebar">{STOPPED}</div>'
    for page in (
        f'<div class="content-sidebar-wrap"><main><p>{text}</p></main>{noise}</div>',
        f'<div class="layout no-sidebar"><article><p>{text}</p></article>{noise}</div>',
        f'<div class="has-nav"><div><p>{text}</p><p>{text}</p></div>{noise}</div>',
        f'<form><div id="form"><main><p>{text}</p></main></div></form>',
        f'<header><main><p>{text}</p></main></header>',
    ):
        assert set(html_extract.main_text(page).split("\n")) == {text}, page
    assert html_extract.main_text(f'<article><header class="entry-header"><h1 class="banner">Title</h1></header><p>{text}</p></article>') == f"Title\n{text}"
    comments = f'<section class="comments"><article><p>{STOPPED * 9}</p></article></section>'
    assert html_extract.main_text(f"<article><p>{text}</p>{comments}</article>{comments}<p hidden>{text}</p>") == text


@pytest.mark.parametrize("n", [1, 300, 1000])
def test_html_short_lines_follow_the_decided_side(n):
    lines = [f"Line {k} of it." for k in range(n)]
    body, text = "".join(f"<p>{x}</p>" for x in lines), (STOPPED * 3).strip()
    nav = "<nav><a href=x>Home</a></nav>"
    assert html_extract.main_text(f"<p>{text}</p>{body}").split("\n") == [text, *lines]
    assert html_extract.main_text(f"{body}<p>{text}</p>").split("\n") == [*lines, text]
    assert html_extract.main_text(body).split("\n") == lines
    assert html_extract.main_text(f"{nav}{body}<footer>Us</footer>").split("\n") == lines
    assert html_extract.main_text(f"{nav}{body}<p>{text}</p><h2>End</h2>").split("\n")[-2:] == [text, "End"]
    assert html_extract.main_text(nav) == ""


@pytest.mark.parametrize("words", ["все люди рождаются свободными и равными в своём достоинстве", "wszyscy ludzie rodzą się wolni i równi pod względem swej godności", "bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar", "人人生而自由在尊严和权利上一律平等他们赋有理性和良心"])
def test_html_languages_without_stop_words(words):
    rng = random.Random(words)
    for _ in range(20):
        parts = [" ".join([words] * n) + "." for n in (9, *(rng.choice((1, 3, 5, 9)) for _ in range(7)), 9)]
        page = "<nav><a href=x>A</a></nav><p><a href=y>" + words * 4 + "</a></p>" + "".join(f"<p>{x}</p>" for x in parts) + "<footer>" + words * 5 + "</footer>"
        assert html_extract.main_text(page).split("\n") == parts


def test_html_code_and_names_between_paragraphs():
    text, code = (STOPPED * 3).strip(), "x = f(y); " * 10
    assert html_extract.main_text(f"<p>{text}</p><p>Code:</p><pre>{code}</pre><p>So.</p><p>{text}</p>").split("\n") == [text, "Code:", code.strip(), "So.", text]


def plain_page(rng):
    """A page without article, main or dropped elements: menus of links, a title, paragraphs with short ones among them, and links below. Its main text, too."""
    menu = lambda n: "".join(f"<li><a href=x>{rng.choice(('Home', 'News', 'All of it'))} {k}</a></li>" for k in range(n))
    paragraphs = [STOPPED.strip() + f" {rng.randrange(9)} " + STOPPED.strip() * rng.randint(2, 4)]
    for _ in range(rng.randint(1, 6)):
        paragraphs.append(rng.choice((f"Yes {rng.randrange(9)}.", "See below: 12, 13.", STOPPED * 3, "It was for him and for her.")).strip())
    paragraphs.append(STOPPED * 3 + "End.")
    title = f"Part {rng.randrange(99)}"
    body = "".join(f"<p>{x}</p>" for x in paragraphs)
    return f"<body><p>Menu</p><ul>{menu(rng.randint(2, 6))}</ul><div><a href=y>Log in now</a></div><h1>{title}</h1>{body}<ul>{menu(3)}</ul><p>Pages</p><ul>{menu(2)}</ul></body>", [title, *paragraphs]


def test_html_passes_decide(monkeypatch):
    """Without elements that say what is the article, the rules and neighbours find it; without the rules, or without neighbours, they don't."""
    rng = random.Random(6)
    made = [plain_page(rng) for _ in range(60)]
    right = lambda: sum(html_extract.main_text(page).split("\n") == want for page, want in made)
    assert right() == len(made)
    for name, value in (("LINK_DENSITY", 2.0), ("LENGTH_HIGH", 10**6), ("STOPS_LOW", 2.0)):
        with monkeypatch.context() as m:
            m.setattr(html_extract, name, value)
            if name != "STOPS_LOW":
                assert right() < len(made), name
            else:
                m.setattr(html_extract, "STOPS_HIGH", 2.0)
                m.setattr(html_extract, "covered", lambda found: True)
                assert right() < len(made)
    with monkeypatch.context() as m:
        m.setattr(html_extract, "classify", lambda found: [html_extract.first_pass(b) == "good" for b in found])
        assert right() < len(made)
    # article only shifts: taken away, the rules find nearly the same text of the given pages
    pages = pd.read_parquet(f"{SF}/pages.parquet").html.tolist()
    whole = [html_extract.main_text(p) for p in pages]
    monkeypatch.setattr(html_extract, "KEEP_TAGS", frozenset())
    assert sum(html_extract.main_text(p) == w for p, w in zip(pages, whole, strict=True)) >= 0.95 * len(pages)


def test_html_depth_costs_no_square():
    at = time.process_time()
    for opened in ("<div>x", "<b>x", "<p><b>x", '<div class="nav">x', "<article>x", "</i><div>x"):
        assert html_extract.main_text(opened * 30_000 + f"<p>{STOPPED * 3}</p>")
    assert time.process_time() - at < 30


def test_html_wrappers_keep_their_text():
    text = (STOPPED * 3).strip()
    for page in (
        f'<div class="layout with-sidebar"><article><p>{text}</p></article></div>',
        f'<article><div class="short-form"><p>{text}</p></div></article>',
        f'<form id="aspnetForm"><div><p>{text}</p></div><input><button>Go</button></form>',
        f'<form id="aspnetForm"><nav>No</nav><article><p>{text}</p></article></form>',
        f"<article><form><p>{text}</p></form></article>",
    ):
        assert html_extract.main_text(page) == text, page
    assert html_extract.main_text(f"<article><p>{text}</p><form><p>Your name and {text}</p></form></article>") == text
    assert html_extract.main_text("<form><p>Sign in here.</p></form>") == ""


def test_html_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_extract.extract(pages).collect():
        assert r["text"] and r["n_chars"] == len(r["text"]) and "©" not in r["text"] and "track(" not in r["text"]
    want = {}
    for p in pages.collect():
        inner = re.search(r"<article>(.*)</article>", p["html"], re.S)[1]
        parts = [" ".join(re.sub(r"<[^>]*>", " " if False else "", x).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        import html

        want[p["page_id"]] = "\n".join(" ".join(html.unescape(x).split()) for x in parts if x)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got == want
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2)], "page_id long, url string, html string, text int")
    assert [tuple(r)[2:] for r in html_extract.extract(odd).collect()] == [("", 0), ("", 0)]


# 7 -------------------------------------------------------------------------------------------------------


def test_media(spark, odd):
    import hashlib

    rows = media.media_digests(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = next(d[1] for d in ODD if d[0] == r["doc_id"]) or ""
        raw = text.encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        stored = media.to_media(text)[0]
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert len({r["feature"] for r in rows if r["doc_id"] == 5}) == 1
    assert media.media_digests(odd.limit(0)).count() == 0


def test_resample_equals_direct_sum():
    rng = np.random.RandomState(1)
    x = rng.randn(57)
    for up, down in ((1, 2), (2, 1), (3, 2), (2, 3)):
        half = media.TAPS * max(up, down) // 2
        t = np.arange(-half, half + 1)
        low = np.sinc(t / max(up, down)) / max(up, down) * np.hamming(len(t)) * up
        full = np.zeros(len(x) * up)
        full[::up] = x
        want = np.convolve(full, low)[half : half + len(full)][::down]
        assert np.allclose(media.resample(x, up, down), want)


def test_segments_and_tensors(spark):
    mel = np.full((200, media.MELS), -10, np.float32)
    mel[50:90] = 0
    assert media.segments(mel) == [(50, 90)]
    stored = media.store_media(spark.createDataFrame([(1, "abc " * 9000), (2, "")], "doc_id long, text string"))
    tiles = pa.Table.from_pandas(media.tensor_tiles(stored).toPandas().drop(columns="spans"))
    fixed = media.as_fixed_shape(tiles)
    assert fixed["tensor"].type.shape == [media.TILE, media.MELS] and fixed.num_rows >= 2


@pytest.mark.parametrize("size", [64, 320, 384, 448, 1024, 1088, 1152, 1216, 5056])
def test_features_reach_the_last_byte(size):
    payload = np.random.RandomState(size).randint(32, 127, size).astype(np.uint8)
    whole = media.Features.of(payload.tobytes())
    for k in range(max(32, size - 200), size):
        other = payload.copy()
        other[k] ^= 16
        assert media.Features.of(other.tobytes()).digest() != whole.digest(), k
    assert len(media.log_mel(np.ones(140), 8000)) == 1 and len(media.log_mel(np.ones(141), 8000)) == 2


def test_features_come_from_stored_tensors(spark, odd, monkeypatch):
    seen = []
    monkeypatch.setattr(media, "new_path", lambda s, label, f=media.new_path: (seen.append(f(s, label)), seen[-1])[1])
    texts = {d[0]: d[1] for d in ODD}
    rows = media.media_digests(odd).collect()
    assert len(rows) == len(ODD) and all(r["feature"] == media.Features.of(media.from_media(media.to_media(texts[r["doc_id"]])[0])).digest() for r in rows)
    files = sorted(Path(urlsplit(seen[0]).path).glob("*.tensors"))
    for f in files:
        with pa.OSFile(str(f)) as source:
            stored = pa.ipc.open_file(source).read_all()
        assert stored["tensor"].type == pa.fixed_shape_tensor(pa.float32(), (media.TILE, media.MELS)) and {"from_s", "to_s", "spans"} <= set(stored.column_names)
        # what is stored is what counts: with other values in the files the features differ
        flat = stored["tensor"].combine_chunks().storage.flatten().to_numpy() + np.float32(1)
        other = stored.drop_columns("tensor").append_column("tensor", pa.FixedSizeListArray.from_arrays(flat, media.TILE * media.MELS))
        assert not set(media.digests_of(media.as_fixed_shape(other).combine_chunks().to_batches()[0])) & {r["feature"] for r in rows}
    assert files and len({f.stem for f in files}) == len(files)


# 8 -------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab/*?", min_size=1, max_size=12), min_size=1, max_size=12), st.lists(st.text(alphabet="ab/", max_size=12), max_size=6))
def test_automaton_equals_regex(globs, strings):
    def regex(g):
        g = re.sub(r"\*\*+", lambda m: "\1" * (len(m[0]) // 2) + "*" * (len(m[0]) % 2), g)
        return "".join({"\1": ".*", "*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in g)

    got = url_filter.Automaton.compile(globs).match([s.encode() for s in strings])
    assert got.tolist() == [[bool(re.fullmatch(regex(g), s)) for g in globs] for s in strings]


def test_urls(spark):
    urls = [None, "", "x", "http://A.Example.COM/de/x", "https://example.com/DE/x", "http://net", "http://a.net/?q", "https://example.net/en/1#a", "http://b.org/fr/", "http://ads.b.org/fr/", "http://ads.b.org/en/", "http://x/ads/y", "http://x.org/a.net/en/", "http://" + "a" * 5000 + ".net/"]
    rows = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(rows).collect()}
    assert got[0] == got[1] == got[2] == ("", None, "allow")
    assert got[3] == ("a.example.com", "example.com/de/", "block") and got[4] == ("example.com", None, "allow")
    assert got[5] == ("net", None, "allow") and got[6] == ("a.net", "net/", "block") and got[7] == ("example.net", "example.net/en/", "allow")
    assert got[8][1:] == got[9][1:] == ("org/fr/", "allow") and got[10][1:] == (None, "block") and got[11][1:] == (None, "block")
    assert got[12][1:] == (None, "allow") and got[13][1:] == ("net/", "block")
    assert url_filter.filter_urls(rows.limit(0)).count() == 0


def test_thousands_of_rules(spark):
    """Many words of states, against plain comparisons; rules from a table."""
    rng = random.Random(2)
    rules = sorted({(f"{rng.choice('abcdefgh')}{rng.randrange(400)}.{rng.choice(('com', 'org'))}", rng.choice(("/", "/en/", "/x/y"))) for _ in range(3000)})
    table = spark.createDataFrame([(("block", "allow")[k % 2], h, p) for k, (h, p) in enumerate(rules)], "verdict string, host string, path string")
    verdicts = {r: ("block", "allow")[k % 2] for k, r in enumerate(rules)}
    assert len(url_filter.Automaton.compile([h + p for h, p in rules]).start) > 64
    urls = [f"http://{rng.choice(('', 'www.', 'x'))}{rng.choice(rules)[0]}{rng.choice(('/', '/en/1', '/x/yz', ''))}" for _ in range(300)]
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.rules_of(table), ()).collect()
    assert len(got) == len(urls)
    for r in got:
        fits = [(h, p) for h, p in rules if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert (r["rule"], r["verdict"]) == ((best[0] + best[1], verdicts[best]) if best else (None, "allow"))


# 10 ------------------------------------------------------------------------------------------------------


def test_chat(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "assistant", None), (1, 0, "user", "hi"), (1, 1, "assistant", "no no"), (2, 0, "user", "alone"), (None, 0, "user", "x"), (4, 0, None, "a"), (5, 0, None, "a"), (5, 0, None, "a")]
    rows = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, line int")
    got = {r["pair_id"]: r for r in chat.format_preferences(rows).collect()}
    r = got[0]
    assert r["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and r["n_prompt_turns"] == 1
    for name, said in (("chosen", ["yes", ""]), ("rejected", ["no no"])):
        assert [r[f"{name}_completion"][a:b] for a, b in r[f"{name}_mask"]] == [f"{x}<|im_end|>" for x in said]
    assert got[1]["chosen_id"] == 2 and got[1]["rejected_completion"] is None and got[1]["prompt"] == ""
    assert got[2]["n_prompt_turns"] == 1 and got[2]["chosen_completion"] == "" and set(got) == {0, 1, 2}
    assert chat.format_preferences(rows.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("pages", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours, theirs = queries.queries()[name](spark, SF).toPandas(), c.sql(queries.oracle_sql()[name]).df()
    text = lambda x: x[sorted(x)].astype(str).sort_values(sorted(x)).reset_index(drop=True)
    assert text(ours).equals(text(theirs))


# pipeline ------------------------------------------------------------------------------------------------


def test_pipeline(spark, docs, odd):
    import corpus_pipeline

    d = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == docs.columns
        assert out.select("doc_id").exceptAll(d.select("doc_id")).isEmpty()
        d = spark.createDataFrame(out.collect(), docs.schema)
    assert 0 < d.count() < docs.count()
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    assert len(set(brute_classes(list(texts.items())).values())) == len(texts)
    items = [" ".join(words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(f" {t} " in f" {' '.join(words(x))} " for t in items for x in texts.values())
    rows = corpus_pipeline.run(spark, SF).collect()
    check_layout(rows)
    assert {r["doc_id"] for r in rows} == set(texts)
    part = odd.select(docs.columns)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        part = stage(spark, part, SF)
        assert part.where("doc_id = 5").count() <= 2
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"
    assert part.where(F.col("text").isNull()).count() == 0


def test_pipeline_decides_by_row(spark, docs):
    import corpus_pipeline

    rng = random.Random(3)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(None, a), (None, a), (7, a), (7, b), (7, c), (8, c), (3, b + " end"), (None, leak), (9, leak), (9, a + " " + c), (None, None)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5) for i, t in rows], DOC)
    pairs = lambda d: sorted(((r["doc_id"], r["text"]) for r in d.collect()), key=str)
    want = [(7, a), (7, c), (3, b + " end"), (9, leak), (9, a + " " + c), (None, None)]
    assert pairs(corpus_pipeline.one_of_each_group(spark, table, SF)) == sorted(want, key=str)
    assert pairs(corpus_pipeline.no_benchmark(spark, table, SF)) == sorted([r for r in rows if r[1] != leak], key=str)
