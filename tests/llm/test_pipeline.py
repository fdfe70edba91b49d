"""Each stage of the pipeline against plain Python on its own input."""

import corpus_pipeline
from tsprobe.llm.common import saved, table
from tsprobe.llm.ngram_join import near_duplicates
from tsprobe.llm.queries import ORACLES, QUERIES


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(saved(stage(spark, seen[-1], sf_dir)))
        if name != "best-fit packing":
            assert seen[-1].columns == names
    start, good, single, cut, mixed, packed = (d.toPandas() for d in seen)
    assert 0.7 * len(start) < len(good) < len(start)
    classes = near_duplicates(seen[1]).toPandas()
    assert sorted(single.doc_id) == sorted(classes.class_id.unique())
    assert set(cut.doc_id) <= set(single.doc_id)
    windows: dict[bytes, int] = {}
    for r in single.sort_values("doc_id").itertuples():
        b = r.text.encode()
        for s in range(len(b) - 49):
            windows.setdefault(b[s : s + 50], r.doc_id)
    left = dict(zip(cut.doc_id, cut.text))
    for r in single.itertuples():
        b = r.text.encode()
        if all(windows[b[s : s + 50]] == r.doc_id for s in range(len(b) - 49)):
            assert left[r.doc_id] == r.text
        else:
            assert len(left.get(r.doc_id, "")) < len(r.text)
    assert set(mixed.doc_id) <= set(cut.doc_id) and mixed.doc_id.value_counts().max() <= 3
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert packed.groupby("doc_id").ngroups == mixed.doc_id.nunique()


def test_odd_tables_go_through_all_stages(spark):
    clashing = ["quality", "rules", "clean_text", "_t", "_w", "_mark", "mark", "_same", "same", "_copy", "row", "_tokens", "repeats"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clashing)
    body = "The council met in the town hall on Monday and agreed on a plan for the new bridge over the river. "
    texts = [body + f"Number {i} of the plan is that the road to the {w} is closed for the summer." for i, w in enumerate(["mill", "port", "school"] * 4)]
    rows = [(i, t, "en", s) for i, (t, s) in enumerate(zip(texts, ["a", "b", None] * 4))]
    rows += [(20, None, "en", "a"), (21, "", "en", "a"), (None, texts[0], None, None), (3, texts[3], "en", "a"), (22, "### $$$ !!! " * 40, "en", "b"), (23, body * 400, "en", "b")]
    docs = spark.createDataFrame([(*r, 1, *clashing) for r in rows], schema)
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        seen = saved(stage(spark, seen, ""))
        if name != "best-fit packing":
            assert seen.columns == docs.columns and seen.schema == docs.schema
            assert all(tuple(r)[5:] == tuple(clashing) for r in seen.collect())
    assert seen.count() > 0
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = saved(stage(spark, empty, ""))
        assert empty.count() == 0


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5
