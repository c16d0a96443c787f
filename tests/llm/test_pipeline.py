"""The pipeline's stages against plain versions, each on its own input."""

import collections

import brute
import public_tokenizers
from test_operators import check_packing, odd_texts, texts
from tokenizers import Tokenizer

import corpus_pipeline
from veclume.llm import packing, toxicity
from veclume.llm.scratch import Scratch


def test_stages(spark, sf):
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, sf), name)
        out[name] = before, docs
        assert name == "packing" or docs.columns == columns
    before, after = out["toxicity"]
    scores = toxicity.score(before, toxicity.fit_contract(before, spark, sf)).where("score < 0.7")
    assert {r.doc_id for r in scores.collect()} == {d for d, _ in texts(after)}
    before, after = out["jaccard_join"]
    assert sorted(d for d, _ in texts(after)) == sorted(d for d, _, c in brute.components(texts(before)) if d == c)
    before, after = out["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(d for d, _ in texts(after)) == sorted(r[0] for r in brute.contamination(texts(before), items) if not r[5])
    before, after = out["secret_scan"]
    was, now = dict(texts(before)), dict(texts(after))
    assert was.keys() == now.keys() and all(was[d] == now[d] for d, a, b, c, _ in brute.secrets(list(was.items())) if not a + b + c and "[secret]" not in now[d])
    assert all(r.n_chars == len(r.text) for r in after.collect())
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(out["packing"][1].collect(), {d: t.encode(x, add_special_tokens=False).ids + [1] for d, x in now.items()}, packing.Limits(loss=packing.LOSS))


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_stages_on_odd_rows(spark, sf):
    """Nulls in all columns, empty and long texts, repeated rows and ids, another column, no rows at all."""
    rows = [(d, t, None if k % 3 else "en", "s" if k % 2 else None, None if t is None else len(t), f"x{k}") for k, (d, t, *_) in enumerate(odd_texts())]
    rows += rows[12:16] + [(None, rows[13][1], "en", "s", 5, None), (None, None, None, None, None, None), (rows[3][0], rows[20][1], None, None, None, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot string").repartition(3)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    counted = lambda df: collections.Counter(map(tuple, df.collect()))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = stage(spark, docs, sf)
        none = stage(spark, docs.limit(0), sf)
        assert none.count() == 0 and none.columns == out[name].columns
        assert name == "packing" or out[name].columns == docs.columns
    assert not counted(out["toxicity"]) - collections.Counter(rows) and out["toxicity"].where("text is null").count() == docs.where("text is null").count()
    by_id = {}
    for d, t, *_ in rows:
        by_id.setdefault(d, []).append(t)
    several = {d for d, ts in by_id.items() if len(set(ts)) > 1 and d is not None}
    roots = {d for d, _, c in brute.components([(d, ts[0]) for d, ts in by_id.items() if d is not None and d not in several]) if d == c}
    kept = counted(out["jaccard_join"])
    assert all(n == collections.Counter(rows)[r] for r, n in kept.items()) and {r[0] for r in kept} - several - {None} <= roots | {d for d in by_id if d in several}
    assert sum(r[0] is None for r in kept.elements()) == 2
    clean = [r for r, hit in zip(rows, brute.contamination([r[:2] for r in rows], items), strict=True) if not hit[5]]
    assert counted(out["decontamination"]) == collections.Counter(clean)
    assert [r.n_chars for r in out["secret_scan"].collect() if r.text is not None] == [len(r.text) for r in out["secret_scan"].collect() if r.text is not None] and out["secret_scan"].count() == len(rows)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in out["packing"].collect()) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x, *_ in rows)
