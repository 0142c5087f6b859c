import hashlib
import random

import pytest
from brute_force import ODD, PLAIN, frame, kept_lines, near_classes, shingles, uncovered

from loomgraph.llm import catalog, line_dedup, near_dup, span_dedup
from loomgraph.llm.components import components
from loomgraph.llm.suffix_array import suffix_array

SF = "/root/testdata/sf0.001"


def texts(spark, sf=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_line_query(spark):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in catalog.QUERIES["op4_line_dedup"](spark, SF).collect()}
    assert got == {i: (n, d, sha(t)) for i, (n, d, t) in kept_lines(texts(spark)).items()}


def test_lines_of_odd_documents(spark):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.without_repeats(frame(spark, PLAIN), 20, 3).collect()}
    assert got == kept_lines(PLAIN)
    assert line_dedup.without_repeats(frame(spark, ODD), 20, 3).count() == len(ODD)
    assert line_dedup.without_repeats(frame(spark, []), 20, 3).count() == 0
    assert set(frame(spark, []).columns) <= set(line_dedup.without_repeats(frame(spark, ODD), 20, 3).columns)


def test_lines_of_repeated_ids(spark):
    """Documents are distinct pairs of doc_id and text; a line stays in those of the largest doc_id."""
    line = "a line of more than twenty characters"
    rows = [(3, line), (3, line), (3, line + "\nelse"), (1, line + "\n" + line), (None, line + "\nnull"), (3, "else")]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.without_repeats(frame(spark, rows), 20, 3).collect()), key=str)
    assert got == sorted([(3, 1, 0, line), (3, 1, 0, line), (3, 2, 0, line + "\nelse"), (1, 2, 2, ""), (None, 2, 1, "null"), (3, 1, 0, "else")], key=str)
    few = [(None, line), (None, line + "\n1"), (None, line + "\n2")]
    assert {r.n_dropped for r in line_dedup.without_repeats(frame(spark, few), 20, 3).collect()} == {0}


def test_hot_line_is_dropped_from_all_but_the_last(spark):
    rows = [(i, "a line that all of them have in common\nown " + str(i)) for i in range(200)]
    got = {r.doc_id: r.text for r in line_dedup.without_repeats(frame(spark, rows), 20, 3).collect()}
    assert got == {i: t if i == 199 else f"own {i}" for i, t in rows}


def test_span_query(spark):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in catalog.QUERIES["op5_span_dedup"](spark, SF).collect()}
    rows = texts(spark)
    wanted = uncovered(rows)
    assert got == {i: (len((t or "").encode()), sum(b - a for a, b in wanted[i][0]), len(wanted[i][0]), sha(wanted[i][1])) for i, t in rows}


def test_spans_of_odd_documents(spark):
    wanted = uncovered(PLAIN)
    got = {r.doc_id: ([tuple(s) for s in r.spans], bytes(r.kept)) for r in span_dedup.without_repeats(frame(spark, PLAIN)).collect()}
    assert got == wanted
    assert span_dedup.without_repeats(frame(spark, ODD)).count() == len(ODD)
    twice = span_dedup.without_repeats(frame(spark, [*PLAIN, *PLAIN])).collect()
    assert len(twice) == 2 * len(PLAIN) and all(([tuple(s) for s in r.spans], bytes(r.kept)) == wanted[r.doc_id] for r in twice)
    assert span_dedup.without_repeats(frame(spark, [])).count() == 0


def test_random_overlaps(spark):
    rng = random.Random(3)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randrange(40, 400))) for _ in range(8)]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(0, 5)))) for i in range(60)]
    got = {r.doc_id: ([tuple(s) for s in r.spans], bytes(r.kept)) for r in span_dedup.without_repeats(frame(spark, rows)).collect()}
    assert got == uncovered(rows)


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefgh"])
def test_suffix_array_orders_suffixes(letters):
    rng = random.Random(1)
    for n in [*range(30), 300]:
        data = "".join(rng.choice(letters) for _ in range(n)).encode()
        assert suffix_array(data).tolist() == sorted(range(n), key=lambda i: data[i:])


def test_near_query(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in catalog.QUERIES["op9_near_duplicates"](spark, SF).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in near_classes(texts(spark), 3, 85).items()}


def test_near_duplicates_of_odd_documents(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.classes(frame(spark, PLAIN), 3, 85, 32, 5).collect()}
    assert got == near_classes(PLAIN, 3, 85)
    rows = near_dup.classes(frame(spark, ODD), 3, 85, 32, 5).collect()
    assert len(rows) == len(ODD) and all(r.kept for r in rows if r.doc_id is None)
    assert near_dup.classes(frame(spark, []), 3, 85, 32, 5).count() == 0


def test_ids_with_several_texts(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    # 5 and 6 link only by 30's two texts; 8's null row has no set; 9's other text has near and exact copies
    rows = [(30, text("p")), (30, text("q")), (5, text("p")), (6, text("q") + " more"), (8, None), (8, text("r")), (18, text("r") + " more"), (9, text("s")), (9, text("t")), (19, text("t")), (29, text("t") + " more"), (40, text("u"))]
    wanted = {5: 5, 6: 5, 30: 5, 8: 8, 18: 8, 9: 9, 19: 9, 29: 9, 40: 40}
    for partitions in (1, 3, 7):
        got = [(r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in near_dup.classes(frame(spark, rows, partitions), 3, 85, 32, 5).collect()]
        assert sorted(got, key=str) == sorted(((i, t is not None, wanted[i], wanted[i] == i) for i, t in rows), key=str)


def test_repeated_ids_by_brute_force(spark):
    """Rows link by their sets or by their doc_id; the component is the least doc_id."""
    found = [(i, t, shingles(t, 3)) for i, t in ODD]
    part = list(range(len(found)))
    for _ in found:
        for x, (i, _, s) in enumerate(found):
            for y, (j, _, r) in enumerate(found):
                if i is not None and j is not None and s and r and (i == j or 100 * len(s & r) >= 85 * len(s | r)):
                    part[x] = part[y] = min(part[x], part[y])
    least = {p: min(found[y][0] for y in range(len(found)) if part[y] == p and found[y][0] is not None) for p in set(part) if found[p][0] is not None}
    wanted = sorted(((i, len(s), None if i is None else least[part[x]] if s else i) for x, (i, _, s) in enumerate(found)), key=str)
    got = near_dup.classes(frame(spark, ODD), 3, 85, 32, 5).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == wanted


def test_one_id_with_the_least_text_of_two_classes(spark):
    rows = [(1, "a b c d e f"), (1, "x y z w v u"), (5, "x y z w v u"), (6, "a b c d e f")]
    got = near_dup.classes(frame(spark, rows), 3, 85, 32, 5).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (5, 1, False), (6, 1, False)]


def test_chains_and_blocks_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(90):  # each one is a little further from the first
        base[rng.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(base)))
    rows += [(100 + i, t + " extra") for i, (_, t) in enumerate(rows[:40])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.classes(frame(spark, rows), 2, 85, 32, 5).collect()}
    assert got == near_classes(rows, 2, 85)
    assert len(shingles(rows[0][1], 2)) == 59


@pytest.mark.parametrize("chunk", [7, 1 << 19])
def test_components(spark, chunk):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    table = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    got = {r.node: r.component for r in components(table, chunk).collect()}
    assert got == {x: find(x) for x in root if x in got} and set(got) == {x for p in pairs for x in p if p[0] != p[1]}
    assert components(table.limit(0), chunk).count() == 0
