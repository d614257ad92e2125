"""The pipeline against its operators, stage by stage."""

import re

import corpus_pipeline
from parlance.llm import catalog
from parlance.llm.common import written

FOLDER = "/root/testdata/sf0.001"


def test_every_stage_takes_effect(llm, small):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "near_copies", "decontamination", "packing"]
    queries = catalog.queries()
    docs = small
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(stage(llm, docs, FOLDER))
        assert docs.columns == small.columns
        assert {tuple(r) for r in docs.collect()} <= {tuple(r) for r in before.collect()}
        if name == "quality_rules":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in queries["op9_quality_rules"](llm, FOLDER).filter("kept").collect()}
        if name == "toxicity":
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()}
            assert 0 < len(gone) < 0.3 * before.count()
        if name == "near_copies":
            from parlance.llm.simhash import near_copies

            assert {r.doc_id for r in docs.collect()} == {r.component_id for r in near_copies(before).collect()}
        if name == "decontamination":
            from parlance.llm.decontaminate import judged, scan

            bad = judged(scan(before, catalog.table(llm, FOLDER, "benchmark"))).filter("contaminated")
            assert before.count() - docs.count() == bad.count()
    got = corpus_pipeline.run(llm, FOLDER).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}


def test_stages_take_odd_and_empty_documents(llm, odd, odd_rows, nothing):
    """Null, empty, very long and repeated texts, null ids, clashing columns: what each stage does with them."""
    from collections import Counter

    every = Counter(odd_rows)
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(llm, odd, FOLDER)
        got = Counter(tuple(r) for r in rows.collect())
        assert stage(llm, nothing, FOLDER).collect() == []
        if name == "packing":
            firsts = [r.doc_id for r in rows.collect() if r.piece == 0]
            assert Counter(firsts) == Counter(r[0] for r in odd_rows)      # each row has its pieces, also without a text
            continue
        assert rows.columns == odd.columns and not got - every
        texts = Counter(row[1] for row in got.elements())
        if name == "quality_rules":
            assert all(len(re.findall(r"[^\x20\x09-\x0D]+", text)) >= 20 for text in texts)
        if name == "toxicity":
            assert sum(got.values()) >= 0.5 * len(odd_rows)
        if name == "near_copies":
            long = max((r[1] for r in odd_rows if r[1]), key=len)
            wordless = [text for text in texts if not (text or "").split()]
            assert sum(row[1] == odd_rows[9][1] for row in got.elements()) == 1 and texts[long] <= 1 and sum(texts[w] for w in wordless) <= 1
        if name == "decontamination":
            assert got == every
