from brute_force import ODD, frame, kept_lines, near_classes
from test_packing import check

import corpus_pipeline as pipeline
from loomgraph.llm import common, pii, quality

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_each_stage_against_brute_force(spark):
    docs = common.documents(spark, SF)
    got = {}
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, SF)
        got[name] = docs, made
        docs = common.stored(made)
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "line dedup", "near-duplicates", "pseudonyms", "packing"]
    for _, made in list(got.values())[:-1]:
        assert made.columns == COLUMNS

    before, after = map(rows, got["quality classifier"])
    labels = common.table(spark, SF, "labels").where(~quality.held_out(common.F.col("doc_id")))
    good = {r.doc_id for r in quality.scored(common.documents(spark, SF), labels).collect() if r.score >= 0.7}
    assert set(after) == good and 0 < len(good) < len(before) and all(after[i] == before[i] for i in good)

    before, after = map(rows, got["line dedup"])
    wanted = kept_lines([(i, r.text) for i, r in before.items()])
    assert {i: r.text for i, r in after.items()} == {i: t for i, (_, _, t) in wanted.items()}
    assert all(r.n_chars == len(r.text) for r in after.values())

    before, after = map(rows, got["near-duplicates"])
    kept = {i for i, (_, c) in near_classes([(i, r.text) for i, r in before.items()], 5, 80).items() if c == i}
    assert set(after) == kept and len(kept) < len(before) and all(after[i] == before[i] for i in kept)

    before, after = map(rows, got["pseudonyms"])
    assert {i: r.text for i, r in after.items()} == {i: pii.replaced(r.text or "", b"loomgraph")[0] for i, r in before.items()}
    before, after = got["packing"]
    check(after.collect(), [(r.doc_id, r.text) for r in before.collect()], 2048)


def test_whole_run_is_the_stages(spark):
    assert pipeline.run(spark, SF).count() > 0 and pipeline.ORACLE_SQL is None


def test_odd_documents(spark):
    docs = frame(spark, ODD)
    for _, stage in pipeline.STAGES[1:]:
        for table in (docs, docs.limit(0)):
            made = stage(spark, table, SF)
            assert made.count() <= len(ODD) + 200
    assert pipeline.quality_filter(spark, docs, SF).columns == docs.columns
    lines = pipeline.repeated_lines(spark, docs, SF)
    assert lines.count() == len(ODD) and lines.columns == docs.columns
    near = pipeline.near_duplicates(spark, docs, SF)
    assert near.columns == docs.columns and near.where("doc_id is null").count() == 2
    for made in (lines, near, pipeline.pseudonyms(spark, docs, SF), pipeline.quality_filter(spark, docs, SF)):
        assert {x for r in made.select(*docs.columns[5:]).distinct().collect() for x in r} <= {7}


def test_a_row_goes_only_for_its_own_class(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    table = [(1, text("p")), (1, text("q")), (1, text("q")), (1, None), (2, text("p") + " more"), (3, text("q") + " more"), (3, text("r")), (4, "")]
    got = [(r.doc_id, r.text) for r in pipeline.near_duplicates(spark, frame(spark, table), SF).collect()]
    assert sorted(got, key=str) == sorted([(1, text("p")), (1, text("q")), (1, None), (3, text("r")), (4, "")], key=str)
