"""text.lexical_terms over whole Arrow batches, by arrays of bytes, and their inversion into lists of rows by term."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from packwright.sources.shared import bound_batches

#: Bytes of text in one step, more where no word ends there; rows by term (at least) that are sorted together.
STEP, RUN = 4 << 20, 2_000_000
_UPPER, _LOWER, _DIGIT = 1, 2, 4
#: Kinds of bytes (an underscore is 8, what is in no word 0), and bytes in lower case.
_KIND = bytes(_UPPER if 65 <= k <= 90 else _LOWER if 97 <= k <= 122 else _DIGIT if 48 <= k <= 57 else 8 if k == 95 else 0 for k in range(256))
_SMALL = bytes(k + 32 if 65 <= k <= 90 else k for k in range(256))


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=-1) != 0] if len(keys) else keys


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    n = hi - lo
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def _strings(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(values))


def _parts(b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Where in b each part of an identifier starts, and the parts, as text.identifier_parts cuts them but not yet distinct. first: bytes that start a text."""
    raw = b.tobytes()
    kind = np.frombuffer(raw.translate(_KIND), np.uint8)
    word = kind != 0
    cut = word.copy()
    cut[1:] &= ~word[:-1]
    cut |= first
    kept = (kind & 7) != 0
    others = np.append(np.flatnonzero((kind != _DIGIT) | first), len(b))
    digits = lambda at: others[np.searchsorted(others, at, side="right")]  # where the digits at a place end
    bare = np.flatnonzero(cut & (kind == _DIGIT))
    kept[_ranges(bare, digits(bare))] = False  # digits before the first letter of a word are none of it
    cut[1:] |= ~kept[:-1] | ((kind[1:] == _UPPER) & ((kind[:-1] & (_LOWER | _DIGIT)) != 0))
    cut[1:-1] |= (kind[:-2] == _UPPER) & (kind[1:-1] == _UPPER) & (kind[2:] == _LOWER) & ~first[2:]
    cut &= kept
    last = kept.copy()
    last[:-1] &= ~kept[1:] | cut[1:]
    begin, end = np.flatnonzero(cut), np.flatnonzero(last) + 1
    good = end - begin >= 2
    kept[begin[~good]] = False
    perhaps = np.flatnonzero(good & (kind[begin] == _DIGIT))
    perhaps = perhaps[digits(begin[perhaps]) >= end[perhaps]]
    good[perhaps] = False
    kept[_ranges(begin[perhaps], end[perhaps])] = False
    begin, end = begin[good], end[good]
    return begin, _strings(np.frombuffer(raw.translate(_SMALL), np.uint8)[kept], end - begin)


def coded_terms(texts: pa.Array) -> tuple[list[np.ndarray], list[pa.DictionaryArray]]:
    """By step, row and term of what texts hold, each once a row but where a text is longer than a step; a row without any has none."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    every = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    rows, terms, lo, end = [], [], int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(lo + STEP, end)
        while hi < end and _KIND[every[hi]]:  # a word stays whole
            hi += 1
        b = every[lo:hi]
        first = np.zeros(len(b), bool)
        first[offsets[(offsets >= lo) & (offsets < hi)] - lo] = True
        at, found = _parts(b, first)
        if len(found):
            coded = found.dictionary_encode()
            row = np.searchsorted(offsets, at + np.int64(lo), side="right") - 1
            both = _distinct(row * len(coded.dictionary) + coded.indices.to_numpy())
            rows.append(both // len(coded.dictionary))
            terms.append(pa.DictionaryArray.from_arrays(pa.array((both % len(coded.dictionary)).astype(np.int32)), coded.dictionary))
        lo = hi
    return rows, terms


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """coded_terms of all steps together, as text."""
    rows, terms = coded_terms(texts)
    return np.concatenate([np.zeros(0, np.int64), *rows]), pa.concat_arrays([pa.array([], pa.string()), *(t.dictionary_decode() for t in terms)])


def _inverted(names: list[str], kinds: pa.DataType, only: tuple[str, ...] | None, apart: dict[str, pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    lists, columns = pa.list_(pa.int32()), ["run", "term", "n", "rows", "held", *apart]

    def flush(batches: list[pa.RecordBatch], rows: list[np.ndarray], terms: list[pa.DictionaryArray]) -> Iterator[pa.RecordBatch]:
        from pyarrow import compute as pc

        held, run = pa.Table.from_batches(batches).combine_chunks(), uuid.uuid4().int >> 65
        row = np.concatenate([np.zeros(0, np.int64), *rows])
        bare = np.flatnonzero(np.bincount(row, minlength=len(held)) == 0)
        row, empty = np.concatenate([row, bare]), pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(bare), np.int32)), pa.array([""], pa.string()))
        coded = pa.chunked_array([*terms, empty] if len(bare) else terms).unify_dictionaries().combine_chunks()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        both = _distinct(place[coded.indices.to_numpy()] * len(held) + row)
        row, code = (both % len(held)).astype(np.int32), both // len(held)
        counts = np.bincount(code, minlength=len(order))
        ends = np.concatenate([[0], np.cumsum(counts)])
        words = coded.dictionary.take(pa.array(order))
        asked = np.ones(len(order), bool) if only is None else pc.is_in(words, pa.array(only, pa.string())).to_numpy(zero_copy_only=False)
        for lo in range(0, len(order), 8192):
            hi = min(lo + 8192, len(order))
            shown = np.where(asked[lo:hi], counts[lo:hi], 0)
            at = row[ends[lo] : ends[hi]][np.repeat(asked[lo:hi], counts[lo:hi])]
            offsets = np.concatenate([[0], np.cumsum(shown)]).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(at), type=lists)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, run)), words.slice(lo, hi - lo), pa.array(counts[lo:hi]), found, pa.nulls(hi - lo, kinds), *(pa.nulls(hi - lo, k) for k in apart.values())], columns)
        parts = [pa.concat_arrays(held[n].chunks) for n in names] + [pa.array(np.bincount(row, minlength=len(held)).astype(np.int32))]
        every = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(parts, kinds.value_type, strict=True)], fields=list(kinds.value_type))
        whole = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), values, type=kind)
        others = [whole(pa.concat_arrays(held[n].chunks).cast(k.value_type), k) for n, k in apart.items()]
        yield pa.RecordBatch.from_arrays([pa.array([run]), pa.nulls(1, pa.string()), pa.array([len(held)]), pa.nulls(1, lists), whole(every, kinds), *others], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, terms, n = [], [], [], 0
        for b in batches:
            found, term = coded_terms(b.column("text").fill_null(""))
            rows += [row + sum(map(len, held)) for row in found]
            terms += term
            held.append(b.select([*names, *apart]))
            n += sum(map(len, found)) + len(b)
            if n >= RUN:
                yield from flush(held, rows, terms)
                held, rows, terms, n = [], [], [], 0
        if n:
            yield from flush(held, rows, terms)

    return run


def inverted(rows: DataFrame, only: list[str] | None = None, apart: tuple[str, ...] = ()) -> DataFrame:
    """run, term, n, rows, held: runs of rows by term, in order of term within a run; no shuffle. rows: text, and columns to keep with dl (a row's number of terms).

    n counts the run's rows with the term, rows are their places. A null term comes once a run: n counts its rows, held has them. only: terms whose
    rows are asked for, others have none. apart: columns that are kept as lists of their own beside held, as few readers ask for them."""
    names = [c for c in rows.columns if c != "text" and c not in apart]
    held = ArrayType(StructType([*(StructField(c, rows.schema[c].dataType) for c in names), StructField("dl", IntegerType())]))
    others = {c: ArrayType(rows.schema[c].dataType) for c in apart}
    bound_batches(rows.sparkSession)
    run = _inverted(names, to_arrow_type(held), None if only is None else tuple(only), {c: to_arrow_type(k) for c, k in others.items()})
    out = StructType().add("run", "long").add("term", "string").add("n", "long").add("rows", ArrayType(IntegerType())).add("held", held)
    for c, k in others.items():
        out = out.add(c, k)
    return rows.mapInArrow(run, out)


def opened(runs: DataFrame) -> DataFrame:
    """term, and what was kept of each row that has it; conditions on term reach the scan of runs."""
    held = runs.where("term is null").select("run", "held")
    return runs.where("term is not null").select("run", "term", "rows").join(held, "run").select("term", F.inline(F.transform("rows", lambda r: F.get("held", r))))
