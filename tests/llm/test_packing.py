import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute_force import ODD, PLAIN, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomgraph.llm import catalog, packing

SF = "/root/testdata/sf0.001"


def check(rows, texts, capacity):
    """rows: all pieces as returned; texts: (doc_id, text) with repeats."""
    library = Tokenizer.from_file(catalog.BYTE_TOKENIZER)
    library.no_truncation()
    wanted = Counter()
    total = 0
    for i, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        total += len(ids)
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        at = 0
        for offset, length in held:
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-total // capacity)


def test_query_packs_every_document(spark):
    rows = catalog.QUERIES["op1_best_fit_packing"](spark, SF).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bins, least = check(rows, texts, 2048)
    assert bins <= least * 1.02 + 1


@pytest.mark.parametrize("rows", [PLAIN, ODD, []])
def test_odd_documents(spark, rows):
    check(packing.pack(frame(spark, rows), catalog.BYTE_TOKENIZER, capacity=64).collect(), rows, 64)


def test_sequences_hold_the_ids(spark):
    docs = frame(spark, ODD)
    placed = packing.pack(docs, catalog.BYTE_TOKENIZER, capacity=256)
    made = packing.sequences(docs, placed, catalog.BYTE_TOKENIZER, capacity=256).collect()
    held = defaultdict(int)
    for r in placed.collect():
        held[r.sequence_id] += r.length
    assert {r.sequence_id: len(r.ids) for r in made} == dict(held)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plan_places_every_length_once(lengths):
    plan = packing.best_two_fit(Counter(lengths), 40)
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 40
        for length in pattern:
            used[length] += times
    assert used == Counter(lengths)
    assert sum(t for _, t in plan) <= 2 * max(1, -(-sum(lengths) // 40))


def test_smallest_gives_way_to_two_that_fit_better():
    # 6 and 3 leave 1 of 10; the two 2s fill what 6 leaves
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == ((6, 2, 2), 1)
