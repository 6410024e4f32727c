"""Benchmark decontamination: a BM25 index of test items with block-max WAND, then overlap of question and answer."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm.common import bound_batches, map_pandas, materialize, word_hashes

K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that a passage must reach, and of the word runs of its question and of its answer.
SCORE, OVERLAP, RUN = 0.5, 0.7, 3
#: Words of half a passage, at least; passages overlap by half, so a run of so many words lies within one. Items of up to HALF words,
#: twice as many, four times ... have indexes and passages of their own, so a long item doesn't make the passages of short ones long.
HALF = 64
#: Items of one block of the index; bytes of items whose indexes are broadcast at once.
BLOCK, INDEX_BYTES = 16, 16 << 20
_END = re.compile(r"\n|(?<=[.?!])\s")


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: an item's text before and after its first line feed or sentence end that has words on both sides; without one, all is question."""
    for m in _END.finditer(text):
        q, a = text[: m.start()], text[m.end() :]
        if re.search(r"\w", q) and re.search(r"\w", a):
            return q, a
    return text, ""


@dataclass
class Index:
    """Impacts of terms on items, over the item's own score, so that a passage with all its words has 1.

    terms: sorted hashes. Term t has postings start[t]:start[t+1] of item (ascending) and weight.
    block_max[t] maps a block of items to the term's greatest weight there. Terms that aren't
    essential are the commonest ones that together give no item more than slack; slack[i] is what they give it."""

    ids: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray]]
    half: int
    terms: np.ndarray
    start: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    essential: np.ndarray
    slack: np.ndarray
    quick: np.ndarray

    @staticmethod
    def build_all(items: list[tuple[int, str]], n_items: int, mean_words: float, frequency: dict[int, int]) -> list[Index]:
        """An index for each class of lengths. frequency: in how many of all n_items items a word is."""
        classes: dict[int, list] = {}
        for k, t in items:
            words = word_hashes([t])[0]
            if len(words):
                half = HALF << max(0, -(-len(words) // HALF) - 1).bit_length()
                classes.setdefault(half, []).append((k, words, *(word_hashes([p])[0] for p in split_item(t))))
        return [Index.build(own, half, n_items, mean_words, frequency) for half, own in sorted(classes.items())]

    @staticmethod
    def build(hashed: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], half: int, n_items: int, mean_words: float, frequency: dict[int, int]) -> Index:
        """hashed: id and the words of each item, of its question and of its answer."""
        terms = np.unique(np.concatenate([h for _, h, _, _ in hashed]))
        idf = np.array([np.log(1 + (n_items - frequency[int(t)] + 0.5) / (frequency[int(t)] + 0.5)) for t in terms])
        at, item, weight = [], [], []
        for i, (_, h, _, _) in enumerate(hashed):
            own, tf = np.unique(h, return_counts=True)
            t = np.searchsorted(terms, own)
            w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / mean_words))
            at.append(t)
            item.append(np.full(len(t), i))
            weight.append(w / w.sum())
        at, item, weight = np.concatenate(at), np.concatenate(item), np.concatenate(weight)
        order = np.lexsort((item, at))
        at, item, weight = at[order], item[order], weight[order]
        start = np.searchsorted(at, np.arange(len(terms) + 1))
        slack, essential = np.zeros(len(hashed)), np.ones(len(terms), bool)
        for t in np.argsort(start[:-1] - start[1:], kind="stable"):
            own = slice(start[t], start[t + 1])
            if start[t + 1] - start[t] < 2 or (slack[item[own]] + weight[own]).max() > SCORE / 2:
                break
            slack[item[own]] += weight[own]
            essential[t] = False
        quick = np.zeros(1 << 20, bool)
        quick[terms[essential] & np.uint64((1 << 20) - 1)] = True
        return Index(np.array([k for k, *_ in hashed]), [(q, a) for _, _, q, a in hashed], half, terms, start, item, weight, essential, slack, quick)

    def block_max(self, term: int) -> dict[int, float]:
        cache = self.__dict__.setdefault("_block_max", {})
        if term not in cache:
            out: dict[int, float] = {}
            for k in range(self.start[term], self.start[term + 1]):
                block = int(self.item[k]) // BLOCK
                out[block] = max(out.get(block, 0.0), float(self.weight[k]))
            cache[term] = out
        return cache[term]

    def search(self, words: np.ndarray) -> list[tuple[int, float]]:
        """All items whose score for the passage reaches SCORE, by block-max WAND.

        Cursors stand in order of item. The pivot is the first item that the greatest
        weights of the lists up to it could carry over SCORE; if the block maxima can't, the
        cursors jump past the block; else they move to the pivot, and it is scored."""
        own = np.unique(words)
        t = np.minimum(np.searchsorted(self.terms, own), len(self.terms) - 1)
        lists = [[self.start[k], self.start[k + 1], max(self.block_max(k).values()), k] for k in t[self.terms[t] == own].tolist()]
        found, item, eps = [], self.item, 1e-9
        while True:
            lists = sorted((x for x in lists if x[0] < x[1]), key=lambda x: item[x[0]])
            bound, pivot = 0.0, None
            for n, x in enumerate(lists):
                bound += x[2]
                if bound >= SCORE - eps:
                    pivot = int(item[x[0]])
                    upto = n + 1
                    break
            if pivot is None:
                return found
            while upto < len(lists) and item[lists[upto][0]] == pivot:
                upto += 1
            block = pivot // BLOCK
            if sum(self.block_max(x[3]).get(block, 0.0) for x in lists[:upto]) < SCORE - eps:
                target = (block + 1) * BLOCK
                if upto < len(lists):
                    target = min(target, int(item[lists[upto][0]]))
                for x in lists[:upto]:
                    x[0] += np.searchsorted(item[x[0] : x[1]], target)
                continue
            if item[lists[0][0]] == pivot:
                score = float(sum(self.weight[x[0]] for x in lists[:upto]))
                if score >= SCORE - eps:
                    found.append((pivot, min(1.0, score)))
                for x in lists[:upto]:
                    x[0] += 1
            else:
                for x in lists[:upto]:
                    x[0] += np.searchsorted(item[x[0] : x[1]], pivot)

    def open_windows(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        """Passages (text, from, to) that essential terms and slack could carry over SCORE for some item.

        Weights of distinct terms are summed for each half passage and item, a term in
        both halves counting twice: a bound from above. No other passage can reach SCORE."""
        near = np.flatnonzero(self.quick[words & np.uint64(len(self.quick) - 1)])
        t = np.minimum(np.searchsorted(self.terms, words[near]), len(self.terms) - 1)
        hit = (self.terms[t] == words[near]) & self.essential[t]
        place, t = near[hit], t[hit]
        if not len(place):
            return []
        text = np.searchsorted(bounds, place, "right") - 1
        halves = -(-np.diff(bounds) // self.half)
        first = np.concatenate([[0], np.cumsum(halves + 1)])  # one more for each text, so that neighbours are of one text
        half = first[text] + (place - bounds[text]) // self.half
        half, t = np.divmod(np.unique(half * len(self.terms) + t), len(self.terms))
        n = self.start[t + 1] - self.start[t]
        posting = np.repeat(self.start[t] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        n_items = len(self.ids)
        key, where = np.unique(np.repeat(half, n) * n_items + self.item[posting], return_inverse=True)
        mass = np.bincount(where, self.weight[posting])
        following = np.searchsorted(key, key + n_items)
        following[following == len(key)] = 0
        pair = mass + np.where(key[following] == key + n_items, mass[following], 0)
        before = np.searchsorted(key, key - n_items)
        before[before == len(key)] = 0
        alone = key[before] != key - n_items  # also as the second half of the passage before
        enough = lambda m: m + self.slack[key % n_items] >= SCORE - 1e-6
        starts = set((key[enough(pair)] // n_items).tolist()) | set((key[alone & enough(mass)] // n_items).tolist())
        out = []
        for h in sorted(starts):
            i = int(np.searchsorted(first, h, "right")) - 1
            a = bounds[i] + (h - first[i]) * self.half
            out.append((i, int(a), int(min(a + 2 * self.half, bounds[i + 1]))))
        return out

    def overlaps(self, words: list[int], item: int) -> tuple[float, float]:
        """Shares of the runs of RUN words of question and answer that are in the passage; 1 for an empty answer."""
        out = []
        for part in (p.tolist() for p in self.parts[item]):
            n = min(RUN, len(part))
            runs = {tuple(part[k : k + n]) for k in range(len(part) - n + 1)} if n else set()
            there = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()
            out.append(len(runs & there) / len(runs) if runs else 1.0)
        return out[0], out[1]


def build_indexes(benchmark: DataFrame) -> Iterator[tuple[list[Index], bool]]:
    """Indexes over all items, of at most about INDEX_BYTES of text at a time, and whether there are more; all weigh words by their frequency in all items."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // INDEX_BYTES)

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [word_hashes([t])[0] for t in b["text"]]
            yield pd.DataFrame({"shard": b["shard"], "words": [len(h) for h in own], "own": [np.unique(h).view(np.int64) for h in own]})

    if shards > 1:
        items = items.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int"))
        counted = items.select("shard", "text").transform(map_pandas, count_words, "shard int, words long, own array<long>")
        n_items, mean = counted.where("words > 0").agg(F.count(F.lit(1)), F.avg("words")).first()
        frequency = counted.select("shard", F.explode("own").alias("word"))
        total = frequency.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        for k in range(shards):
            own = {int(np.int64(w).view(np.uint64)): n for w, n in total.join(frequency.where(F.col("shard") == k).select("word").distinct(), "word").collect()}
            if found := Index.build_all([tuple(r) for r in items.where(F.col("shard") == k).select("item_id", "text").collect()], n_items or 0, mean or 1.0, own):
                yield found, True
        return
    rows = sorted(tuple(r) for r in items.collect())
    own = [word_hashes([t])[0] for _, t in rows]
    sizes = [len(h) for h in own if len(h)]
    frequency = Counter(w for h in own for w in np.unique(h).tolist())
    if found := Index.build_all(rows, len(sizes), sum(sizes) / max(1, len(sizes)), frequency):
        yield found, False


MATCH = "doc_id long, item_id long, word_start long, score double, question_overlap double, answer_overlap double"


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, passages, score, question_overlap, answer_overlap for each document that holds a benchmark item.

    Every whole document is cut into passages that overlap by half, each at least twice as
    long as the item. Passages that score SCORE of an item's own BM25 are
    retrieved, and kept if they have OVERLAP of the runs of RUN words both of its question and of its answer.
    passages counts those kept, the other columns are of the best. Null, empty and wordless texts and
    items match nothing; a null doc_id is reported as such, items without item_id are left out. Rows with one doc_id are reported together. Items with
    equal texts are all reported. Other columns, whatever their names, are left out; an empty table of either kind gives no rows. Documents are neither shuffled nor
    joined; they are read once for each INDEX_BYTES of items, and the indexes of one reading are let go before the next."""
    spark = documents.sparkSession
    bound_batches(spark)
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    found = None
    for indexes, many in build_indexes(benchmark):
        shared = spark.sparkContext.broadcast(indexes)  # of at most about INDEX_BYTES of items

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                words, bounds = word_hashes(list(b["text"]))
                out = []
                for index in shared.value:
                    for i, a, z in index.open_windows(words, bounds):
                        passage = words[a:z].tolist()
                        for item, score in index.search(words[a:z]):
                            q, r = index.overlaps(passage, item)
                            if q >= OVERLAP and r >= OVERLAP:
                                out.append((b["doc_id"].iloc[i], int(index.ids[item]), int(a - bounds[i]), score, q, r))
                frame = pd.DataFrame(out, columns=["doc_id", "item_id", "word_start", "score", "question_overlap", "answer_overlap"])
                yield frame.astype({"doc_id": "Int64"})

        part = rows.transform(map_pandas, run, MATCH)
        if many:
            part = materialize(part, "leaks")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], MATCH)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap"))
    found = found.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("passages"), best.alias("best"))
    return found.select("doc_id", "item_id", "passages", "best.*")
