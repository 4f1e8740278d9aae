"""Every stage of the pipeline on its predecessor's output, against brute force."""

import test_decontaminate
import test_linededup
import test_packing

import corpus_pipeline
from kmerloom.llm import puquality, simhash
from kmerloom.llm.common import table

SF = "/root/testdata/sf0.001"


def brute_keepers(texts):
    """Smallest doc_id of each component of texts that share four fifths of their five-word shingles."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    label = {i: i for i in texts}
    near = {i: [j for j in texts if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in texts}
    while (new := {i: min(label[j] for j in near[i]) for i in texts}) != label:
        label = new
    return {i for i in texts if label[i] == i}


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, outputs = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        outputs.append(docs)
    classified, lined, near, clean, packed = outputs
    assert all(x.columns == columns for x in outputs[:-1])
    text = lambda df: {r.doc_id: r.text for r in df.collect()}

    given = text(table(spark, SF, "documents"))
    model = puquality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    ids = sorted(given)
    scores = puquality.scores(model, [given[i].encode() for i in ids])
    assert text(classified) == {i: given[i] for i, s in zip(ids, scores) if s >= 0.3}

    assert text(lined) == test_linededup.brute(list(text(classified).items()))
    kept = brute_keepers(text(lined))
    assert text(near) == {i: t for i, t in text(lined).items() if i in kept}

    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    dirty = {i for i, _, _ in test_decontaminate.brute(list(text(near).items()), items)}
    assert text(clean) == {i: t for i, t in text(near).items() if i not in dirty}
    test_packing.check([(i, t, "x") for i, t in text(clean).items()], packed.collect(), 1024)


def test_run_equals_the_stages(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    rows = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(docs)


def test_empty_documents(spark, tmp_path):
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    table(spark, SF, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_keeps_one_row_of_an_op5_component(spark, monkeypatch):
    """Fingerprints within two bits link by op5's grid, also where the shingle sets differ too much for the other links."""
    line = "every line of this long page is the same sentence again and again "
    texts = [line * 60 + " ".join(f"{c}{i}" for i in range(14)) for c in "xyz"] + ["an unrelated text of a few words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    components = {r.doc_id: r.component_id for r in simhash.simhash_components(docs).collect()}
    assert components == {0: 0, 1: 0, 2: 0, 3: 3} and brute_keepers(dict(enumerate(texts))) == {0, 1, 2, 3}
    grids, grid = [], simhash.grid_edges
    monkeypatch.setattr(simhash, "grid_edges", lambda *x: grids.append(x) or grid(*x))
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == {0, 3}
    assert len(grids) == 1
