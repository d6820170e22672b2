"""The pipeline's stages, each on what its predecessor kept, against plain definitions."""

import corpus_pipeline
from settings import SF
from test_text_models import brute, check_packing

from riskloom.llm import line_dedup, quality
from riskloom.llm.common import bucket_of_id, written
from riskloom.llm.simhash import near_components


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, items = docs.columns, [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF), "stage")
        assert out.columns == names
        kept[name] = ({r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in out.collect()}, docs)
        docs = out
    before, after, table = kept["quality classifier"]
    model = quality.fit_quality(table, labels.where(bucket_of_id("doc_id", 4) != 2))
    assert {*after} == {r.doc_id for r in quality.score_quality(table, model).where("score >= 0.7").collect()} and 0.6 * len(before) < len(after) < len(before)
    before, after, table = kept["line dedup"]
    seen = set()
    for k in sorted(after):
        own = {x for _, x in line_dedup.lines_of(after[k])}
        assert not own & seen
        seen |= own
    every = {x for t in before.values() for _, x in line_dedup.lines_of(t)}
    assert len(seen) >= 0.95 * len(every)
    before, after, table = kept["SimHash near-dedup"]
    assert {*after} == {r.component_id for r in near_components(table).collect()}
    before, after, _ = kept["benchmark decontamination"]
    clean = set()
    for k, t in before.items():
        n, hit, _ = brute(t, items)
        if not (hit and 20 * hit >= n):
            clean.add(k)
    assert {*after} == clean
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), after)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_keep_clashing_columns(spark):
    """Columns named like those the operators make come through unchanged, with null ids and texts and repeated rows."""
    names = ["doc_id", "text", "lang", "source", "n_chars", "score", "fp", "_fp", "matches", "n_words", "_drops", "h", "items", "_text", "root", "_place"]
    row = lambda k, t: (k, t, "en", "s", len(t or ""), *(f"{c}-{k}" for c in names[5:]))
    text = "a line of words that is long enough to be counted as one, number {}"
    rows = [row(1, text.format("one")), row(1, text.format("one")), row(2, None), row(3, ""), row(None, text.format("quite other and null")), row(4, text.format("four hundred") + "\n" + text.format("one"))]
    docs = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == names, name
        got = out.collect()
        assert all(r[c] == f"{c}-{r.doc_id}" for r in got for c in names[5:]), name
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)
