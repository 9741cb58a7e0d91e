"""The corpus pipeline against its operators applied one after another in plain Python."""
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from canopy.llm import quality, secrets, simhash
from llm_tables import SF01


def test_stages_take_effect_one_after_another(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash_dedup", "secrets", "packing"]
    rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    model = quality.fit(docs, labels)
    scores = model.score(quality.matrix(docs.select("text").toArrow().column(0).combine_chunks()))
    good = {r.doc_id for r, s in zip(docs.collect(), scores) if s >= 0.3}
    marks = {i: simhash.fingerprint(rows[i].text) for i in sorted(good)}
    root = {i: i for i in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, m in marks.items():
        for b, n in marks.items():
            if b < a and (m ^ n).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = {i for i in marks if find(i) == i}

    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF01)
        assert now.columns == docs.columns
        if name == "quality":
            assert {r.doc_id for r in now.collect()} == good
    left = {r.doc_id: r.text for r in now.collect()}
    assert set(left) == kept and len(kept) < len(good) < len(rows)
    for i in kept:
        from test_secrets import plain_base
        assert left[i] == rows[i].text or secrets.MASK in left[i]
        if plain_base(rows[i].text):
            assert secrets.MASK in left[i] and not plain_base(left[i].replace(secrets.MASK, " "))

    tk = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    packed = corpus_pipeline.run(spark, SF01).collect()
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {i: len(tk.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}


def test_registered_only_beside_the_subpackage():
    import __spark_entry__ as E
    assert "pipeline" in E.queries()
    assert sum(k.startswith("op") and k[2].isdigit() for k in E.queries()) == 10
