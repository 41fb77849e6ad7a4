"""The pipeline and the queries with SQL."""

import os
import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from seqloom.llm import jaccard_join, mixing, quality, registry

from . import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    df = registry.QUERIES[name](spark, SF)
    rel = con.sql(registry.SQL[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    at = [rel.columns.index(c) for c in columns]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        before = {r.doc_id: r.text for r in docs.collect()}
        out.write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        ids = [r.doc_id for r in after.collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= set(before)
        if i == 0:
            kept = {r.doc_id for r in quality.op2_quality_classifier(spark, SF).where("quality_keep").collect()}
            bad = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0")
            assert set(ids) == kept and after.join(bad, "doc_id").count() <= 0.1 * bad.count()
        elif i == 1:
            assert len(ids) >= 0.99 * len(before)
        elif i == 2:
            found = jaccard_join.join(docs).collect()
            assert set(ids) == {r.component_id for r in found}
        else:
            assert set(ids) == set(before)
        assert after.columns == columns if i < 4 else after.columns[: len(columns)] == columns
        docs = after
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(ids)


def test_run_keeps_the_mixed_order(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i}", "en", "hot" if i % 10 else f"s{i % 3}", 9) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])  # the others keep or drop rows, whatever their order
    files = []
    monkeypatch.setattr(corpus_pipeline, "written", lambda df, what, f=corpus_pipeline.written: (out := f(df, what), files.extend(out.inputFiles()))[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.mix_position)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) > 2 and [r.mix_position for r in got] == list(range(3000)) and {r.doc_id for r in got} == set(range(3000))
    left = Counter(r[3] for r in rows)
    want = []
    for s, _ in mixing.schedule({s: -(-n // 64) for s, n in left.items()}, mixing.default_targets(left)):
        want += [s] * min(64, left[s])
        left[s] -= min(64, left[s])
    assert [r.source for r in got] == want


def test_run_against_brute_force(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rng = random.Random(11)
    spoken = {"en": "the of and which that with from house water light".split(), "de": "der die und nicht haus wasser schön über mit stein".split()}
    rows = []
    for i in range(260):
        l = rng.choice(["en", "en", "de"])
        words = [rng.choice(spoken[l]) for _ in range(rng.randrange(20, 60))]
        if i % 6 == 0:
            words = [w + "$$$" for w in words]
        rows.append([i, " ".join(words), l, rng.choice(["hot", "hot", "s1", "s2", None]), i % 6 > 0])
    for i in range(200, 230):  # copies, some with a word changed
        words = rows[i - 150][1].split()
        if i % 2:
            words[3] = "changed"
        rows[i][1], rows[i][2], rows[i][4] = " ".join(words), rows[i - 150][2], rows[i - 150][4]
    rows += [[300, "漢字仮名交じり文の例です" * 30, None, "s1", True], [301, None, "en", "s1", True], [302, "", None, None, True]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string"
    docs = spark.createDataFrame([(i, t, l, s, len(t or ""), "mine") for i, t, l, s, _ in rows], schema)
    labels = spark.createDataFrame([(r[0], int(r[4]), 0) for r in rows[:100]], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = [r[:4] for r in rows]
    judged = brute.qualities([(t, s, l) for _, t, l, s in left], quality.train(docs, labels))
    left = [r for r, (*_, keep) in zip(left, judged) if keep]
    judged = brute.Languages([(t, l) for _, t, l, _ in left]).judge([(t, l, "", s) for _, t, l, s in left])
    left = [r for r, (*_, keep) in zip(left, judged) if keep]
    firsts = {i for i, _, component in brute.join([(i, t) for i, t, _, _ in left]) if i == component}
    left = [r for r in left if repr(r[0]) in firsts]
    assert 100 < len(left) < 230
    counts = Counter(s or "" for *_, s in left)
    places = brute.positions([(i, s) for i, _, _, s in left], mixing.default_targets(counts), mixing.BLOCK_ROWS)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert set(got) == set(places)
    for i, text, l, s in left:
        r = got[i]
        ids = t.encode(text, add_special_tokens=False).ids
        assert (r.text, r.lang, r.source, r.ids) == (text, l, s, "mine") and (r.mix_source, r.mix_block, r.mix_slot, r.mix_position) == places[i]
        assert list(memoryview(bytes(r.ids_)).cast("I")) == ids and r.n_tokens == len(ids)


def test_intermediate_tables_go(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    docs.write.parquet(f"{tmp_path}/0")
    here = lambda: [t for t in corpus_pipeline.tables() if os.path.isdir(t.removeprefix("file:"))]
    before = set(here())
    first = corpus_pipeline.good_quality(spark, spark.read.parquet(f"{tmp_path}/0"), SF)
    made = set(here()) - before
    assert made
    corpus_pipeline.known_language(spark, first, SF)  # its input isn't saved: nothing goes
    assert made <= set(here())
    second = corpus_pipeline.good_quality(spark, spark.read.parquet(f"{tmp_path}/0"), SF)
    made = set(here()) - before - made
    second.write.parquet(f"{tmp_path}/1")
    n = second.count()
    corpus_pipeline.mixed_sources(spark, spark.read.parquet(f"{tmp_path}/1"), SF)
    assert not corpus_pipeline._LEFT and n == spark.read.parquet(f"{tmp_path}/1").count()
    assert not any("evidence" in t for t in set(here()) & made)
