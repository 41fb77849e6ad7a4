import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import bpe, chat_template, common, components, fingerprints, jaccard_join, language, licences, mixing, mpeg, quality, url_filter, words
from seqloom.llm.licence_texts import DIGESTS, TEXTS

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __h string, canonical string, path string"
LONG = "lorem ipsum dolor sit amet " * 4000


def table(spark, texts):
    """Documents with odd columns beside the known ones."""
    return spark.createDataFrame([(i, t, "en" if i is not None and i % 2 else None, "s" if i is None or i % 3 else None, None, "x", "y", "z") for i, t in texts], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, LONG), (6, LONG), (7, "a b c d e f g h"), (7, "a b c d e f g h"), (None, "a b c d e f g h"), (8, "é中 😀 <|endoftext|> x")]


# --- fingerprints --------------------------------------------------------------------------------


def brute_sketch(text):
    words = text.lower().split()
    hashes = sorted({hashlib.md5(" ".join(words[i : i + 5]).encode()).hexdigest()[:16] for i in range(max(len(words) - 4, 1))}) if words else []
    kept = [h for h in hashes if h <= fingerprints.BOUND]
    if len(kept) >= fingerprints.FLOOR:
        return fingerprints.BOUND, kept
    return (fingerprints.ALL if len(hashes) <= fingerprints.FLOOR else hashes[fingerprints.FLOOR - 1]), hashes[: fingerprints.FLOOR]


def test_fingerprints(spark):
    docs = [(i, t) for i, t in ODD if i is not None]
    got = fingerprints.fingerprint_documents(table(spark, ODD)).collect()
    assert len(got) == len(ODD)
    order = sorted([(i if i is not None else -(2**70), t or "") for i, t in ODD], key=lambda x: (-x[0], x[1]))
    after = {order[j]: order[(j + 1) % len(order)][1] for j in range(len(order))}
    for r in got:
        text = next((t or "") for i, t in docs + [(None, "a b c d e f g h")] if i == r.doc_id)
        assert r.n_chars == len(text) and r.fingerprint == ":".join([brute_sketch(text)[0], ",".join(brute_sketch(text)[1])])
        if r.doc_id not in (7, None):
            h = len(text) // 2
            edited = text[: len(text) - h] + after[r.doc_id, text][:h]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert r.edited_fingerprint == ":".join([brute_sketch(edited)[0], ",".join(brute_sketch(edited)[1])])
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert next(r for r in got if r.doc_id == 6).near_next == 1.0
    assert fingerprints.fingerprint_documents(table(spark, []).where("false")).count() == 0


def test_fingerprint_order_over_sparse_ids(spark):
    rng = random.Random(1)
    ids = sorted({rng.randrange(-(2**40), 2**40) for _ in range(300)})
    rows = spark.createDataFrame([(i, f"w{i} a b c d") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.fingerprint_documents(rows).collect()}
    for a, b in zip(ids, [ids[-1], *ids]):
        t, n = f"w{a} a b c d", f"w{b} a b c d"
        assert got[a] == hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()


def test_fingerprint_estimates(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    long, short = " ".join(words), " ".join(words[100:700])
    half = " ".join(words[:3000] + [f"x{i}" for i in range(3000)])
    rows = spark.createDataFrame([(long, short, half)], "a string, b string, c string")
    for c in "abc":
        rows = fingerprints.with_sketch(rows, c, "s" + c)
    both = rows.withColumn("m", fingerprints.merged("array(sb, sc)"))
    r = both.select(fingerprints.containment("sb", "sa").alias("c"), fingerprints.likeness("sa", "sc").alias("j"), fingerprints.likeness("sa", "sa").alias("one"), "m").first()
    assert r.c == 1.0 and abs(r.j - 1 / 3) < 0.06 and r.one == 1.0
    assert set(r.m.hashes) <= set(brute_sketch(short)[1]) | set(brute_sketch(half)[1])


def test_containment_of_short_texts_is_never_wrongly_none(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    rows = spark.createDataFrame([(i, " ".join(words[20 * i : 20 * i + 8]), " ".join(words)) for i in range(100)] + [(100, "x y", "z"), (101, "", "z")], "i int, a string, b string")
    for c in "ab":
        rows = fingerprints.with_sketch(rows, c, "s" + c)
    rows = fingerprints.exact_containment(rows, "a", "b", "exact").withColumn("c", fingerprints.containment("sa", "sb"))
    got = {r.i: (r.c, r.exact) for r in rows.select("i", "c", "exact").collect()}
    assert {c for i, (c, _) in got.items() if i < 100} == {None, 1.0} and all(x == 1.0 for i, (_, x) in got.items() if i < 100)
    assert got[100] == (0.0, 0.0) and got[101] == (1.0, 1.0)
    assert rows.where("c = 1").count() + rows.where("c is null").count() == 101  # a filter on it comes back in time


def test_fingerprint_order_over_extreme_ids(spark):
    ids = [-(2**63), -(2**63) + 1, -1, 0, 2**62, 2**63 - 1]
    rows = spark.createDataFrame([*((i, f"w{i} a b c d") for i in ids), (None, "none"), (None, "other")], "doc_id long, text string")
    got = {(r.doc_id, r.n_chars): r.edited_sha256 for r in fingerprints.fingerprint_documents(rows).collect()}
    texts = [(i, f"w{i} a b c d") for i in reversed(ids)] + [(None, "none"), (None, "other")]
    for (i, t), (_, n) in zip(texts, texts[1:] + texts[:1]):
        assert got[i, len(t)] == hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()


# --- quality -------------------------------------------------------------------------------------


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(["the", "river", "stone", "walks", "under", "green", "light", "and", "of"]) for _ in range(60)]
        bad = rng.random() < (0.6 if i % 5 == 0 else 0.1)
        text = " ".join(w + "$$$" for w in words) if bad else " ".join(words) + "."
        rows.append((i, text, "en", f"src{i % 5}", 0 if bad else 1))
    return rows


def test_quality(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], r[4], 0) for r in rows[:200]], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert sum(got[r[0]].quality_keep == bool(r[4]) for r in rows[200:]) >= 198  # held out
    model = quality.train(docs, labels)
    again = quality.train(docs.repartition(3), labels)
    assert (model.weights == again.weights).all() and (model.tables == again.tables).all()
    want = brute.qualities([(r[1], r[3], r[2]) for r in rows], model)
    for r, w in zip(rows, want):
        g = got[r[0]]
        assert (g.host_rate, g.path_rate, g.quality_posterior) == pytest.approx(w[:3], abs=1e-6) and g.quality_keep == w[3]


def test_quality_by_words_alone(spark):
    # both kinds have one shape; only the vocabulary tells them
    rng = random.Random(5)
    kinds = [[f"{a}{b}" for a in "bdfgk" for b in ("ato", "eri", "omu")], [f"{a}{b}" for a in "lmnps" for b in ("ato", "eri", "omu")]]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(50)), "en", f"s{i % 3}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(0, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.quality_keep for r in quality.judge(docs, labels).collect()}
    assert all(got[i] == bool(i % 2) for i in range(200, 400))


def test_measure_piece_by_piece(monkeypatch):
    rng = random.Random(6)
    text = " ".join(rng.choice(["The", "the", "LOUD", "a..b", "x!!", "é", "\n", "word"]) for _ in range(3000)).encode()
    whole = quality.measure(text)
    monkeypatch.setattr(words.pieces, "__defaults__", (1000,))
    parts = quality.measure(text)
    assert parts[0][:13] == pytest.approx(whole[0][:13]) and parts[0][14:] == pytest.approx(whole[0][14:])
    assert (parts[1] == whole[1]).all() and (parts[2] == whole[2]).all()


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(table(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and {r.doc_id for r in got if not r.quality_keep} >= {1, 2, 3}
    assert quality.judge(table(spark, ODD).where("false"), labels).count() == 0


# --- mixing --------------------------------------------------------------------------------------


@pytest.mark.parametrize("weights", [[1, 1, 1], [5, 3, 2], [97, 2, 1], [1, 1000, 7, 13]])
def test_schedule_deviation(weights):
    total = sum(weights)
    target = {f"s{i}": Fraction(w, total) for i, w in enumerate(weights)}
    blocks = {s: 40 * w for s, w in zip(target, weights)}
    order = mixing.schedule(blocks, target)
    assert len(order) == sum(blocks.values()) and len(set(order)) == len(order)
    seen = dict.fromkeys(target, 0)
    for t, (s, b) in enumerate(order):
        assert b == seen[s]
        seen[s] += 1
        assert all(abs(seen[x] - target[x] * (t + 1)) < 1 for x in target)


def test_mixing_rows(spark):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 else f"s{i % 4}") for i in range(900)] + [(None, "t", "en", None), (5, "t5", "en", "hot"), (5, "t5", "en", "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("MIX_slot", F.lit("x"))
    got = mixing.with_positions(docs, block_rows=8).collect()
    assert sorted(r.mix_position for r in got) == list(range(len(rows)))
    by_slot = {}
    for r in got:
        by_slot.setdefault(r.mix_slot_, set()).add((r.mix_source, r.mix_block))
    assert all(len(v) == 1 for v in by_slot.values())
    again = mixing.with_positions(docs.repartition(7), block_rows=8).collect()
    assert {(r.doc_id, r.mix_position) for r in got if r.doc_id != 5} == {(r.doc_id, r.mix_position) for r in again if r.doc_id != 5}
    whole = mixing.mixed(docs).collect()
    assert len(whole) == len(rows)
    assert mixing.with_positions(docs.where("false")).count() == 0


@pytest.mark.parametrize("block", [4, 64])
def test_mixing_against_brute_force(spark, block, monkeypatch):
    rng = random.Random(block)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", "b", None])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    counts = Counter(s or "" for _, s in rows)
    for targets in (mixing.default_targets(counts), {"hot": Fraction(1, 2), "a": Fraction(1, 3), "b": Fraction(1, 6)}):
        want = brute.positions(rows, targets, block)
        got = mixing.with_positions(docs, targets, block).collect()
        assert {r.doc_id: (r.mix_source, r.mix_block, r.mix_slot) for r in got} == {i: w[:3] for i, w in want.items()}
        assert {r.doc_id: r.mix_position for r in got} == {i: w[3] for i, w in want.items()}


def test_schedule_repeats_its_period():
    rng = random.Random(1)
    for _ in range(100):
        blocks = {f"s{i}": rng.randrange(80) for i in range(rng.randrange(1, 6))}
        targets = {s: Fraction(rng.randrange(7)) for s in blocks}
        assert mixing.schedule(blocks, targets) == brute.slots(blocks, targets)
    big = mixing.phases({"a": 3 * 10**8, "b": 2 * 10**8}, {"a": Fraction(3, 5), "b": Fraction(2, 5)})
    assert [(n, len(x)) for n, x in big] == [(10**8 - 1, 5), (1, 5)]  # what is worked out doesn't grow with the blocks


# --- language ------------------------------------------------------------------------------------

SPOKEN = {"en": "the of and which that with from house water light", "de": "der die und nicht haus wasser licht schön über mit", "fr": "le la les et que dans maison eau lumière été"}


def spoken(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(SPOKEN[l].split()) for _ in range(40)), l, f"h{i % 4}") for i in range(n) for l in [rng.choice(list(SPOKEN))]]


def test_language(spark):
    rows = spoken(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.train(docs)
    wrong = spark.createDataFrame([(i, t, "en", s) for i, t, _, s in spoken(90, 7)] + [(900, "漢字仮名交じり文の例です" * 20, "en", "h0"), (901, None, None, None), (902, "", "en", "h1")], docs.schema)
    got = {r.doc_id: r for r in language.identify(wrong.withColumn("language", F.lit(1)), model, declared=F.col("lang"), host=F.col("source")).collect()}
    assert all(got[i].language_ == l and got[i].language == 1 and got[i].language_keep for i, _, l, _ in spoken(90, 7))
    assert not got[900].language_keep and not got[901].language_keep and not got[902].language_keep
    assert language.identify(wrong.where("false"), model).count() == 0
    none = language.train(docs.where("false"))
    assert not any(r.language_keep for r in language.identify(wrong, none).collect())


def test_language_evidence_decides_short_texts(spark):
    docs = spark.createDataFrame(spoken(300), "doc_id long, text string, lang string, source string")
    model = language.train(docs)
    short = [(1000 + i, "xx", "de", "hd") for i in range(3)]
    many = [(i, " ".join(SPOKEN["de"].split()), "de", "hd") for i in range(200, 400)] + [(i, " ".join(SPOKEN["en"].split()), "en", "he") for i in range(400, 600)]
    rows = spark.createDataFrame(short + many, docs.schema)
    got = {r.doc_id: r.language for r in language.identify(rows, model, declared=F.col("lang"), host=F.col("source")).collect()}
    assert all(got[i] == "de" for i, *_ in short)


def test_language_keeps_clean_documents_beyond_the_sample(spark):
    # every tenth document is of rarer words, with codes among them; the sample has about 5 of 400 a language
    rng = random.Random(3)
    code = lambda: "".join(rng.choice("0123456789QXZJKW") for _ in range(16))
    rows = [(i, t if i % 10 else " ".join([*t.split()[:3], *(code() for _ in range(6))]), l, s) for i, t, l, s in spoken(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.train(docs, most=5)
    got = language.identify(docs, model, declared=F.col("lang"), host=F.col("source")).collect()
    assert [r.doc_id for r in got if not r.language_keep] == []


def test_language_without_a_model_is_kept_as_declared(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    rows = [(i, t, l, s) for i, t, l, s in spoken(300) if l != "fr" or i % 3 == 0]  # fr is the third by count
    rows += [(1000, "ett hus med vatten och ljus i skogen " * 5, "sv", "h0"), (1001, "漢字仮名交じり文の例です" * 20, "ja", "h1"), (1002, " ", "sv", "h1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.train(docs)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in language.identify(docs, model, declared=F.col("lang"), host=F.col("source")).collect()}
    assert all(got[i].language == l and got[i].language_keep for i, _, l, _ in rows if i != 1002)
    assert got[1000].language_posterior is None and not got[1002].language_keep


def same_language(got, want):
    post = lambda x: None if x is None else pytest.approx(x, abs=1e-5)
    return (got.language, got.text_language, got.language_keep) == (want[0], want[2], want[3]) and got.language_posterior == post(want[1])


@pytest.mark.parametrize("at_once", [1, 2, 32])
def test_language_against_brute_force(spark, at_once, monkeypatch):
    monkeypatch.setattr(language, "AT_ONCE", at_once)
    rng = random.Random(at_once)
    rows = [(i, t if i % 7 else rng.choice(["die the", "haus", "la", "", None]), rng.choice([l, l, "en", "", None]), rng.choice(["x.de", "y.fr", "shop.de", "plain", None])) for i, t, l, _ in spoken(120)]
    rows += [(900, "漢字仮名交じり文の例です" * 20, None, "x.de"), (901, "ett hus med vatten och ljus " * 4, "sv", "y.se")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language.unboxed(language.of_documents(docs), {c: F.col(c) for c in language.ADDED}).collect()}
    suffix = lambda h: h.rsplit(".", 1)[1] if h and "." in h else ""
    want = brute.Languages([(t, l) for _, t, l, _ in rows]).judge([(t, l, suffix(h), h) for _, t, l, h in rows])
    assert all(same_language(got[r[0]], w) for r, w in zip(rows, want))
    assert not got[900].language_keep and got[901].language == "sv"


def test_language_of_pages_against_brute_force(spark, tmp_path):
    docs = [(i, t, l, s) for i, t, l, s in spoken(90)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rng = random.Random(2)
    pages = []
    for i, t, l, _ in spoken(60, 9):
        host = f"h{i % 3}.example.{rng.choice([l, 'com'])}"
        pages.append((i, f"http://{host}/x", f"<html lang={rng.choice([l, 'en'])}><body><p>{t if i % 3 else 'haus la'}</p></body></html>"))
    pages.append((99, None, None))
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in language.language_of_pages(spark, str(tmp_path)).collect()}
    found = language.page_evidence(spark.read.parquet(f"{tmp_path}/pages.parquet")).collect()
    want = brute.Languages([(t, l) for _, t, l, _ in docs]).judge([(r.page_text, r.declared, r.suffix, r.host) for r in found])
    assert len(got) == 61 and all(same_language(got[r.page_id], w) for r, w in zip(found, want))


def test_page_evidence(spark):
    pages = spark.createDataFrame([(1, "https://A.example.DE/x", '<HTML dir=ltr lang="de-AT"><head>no</head><p>ja <b>gut</b><script>x</script>'), (2, None, None)], "page_id long, url string, html string")
    a, b = language.page_evidence(pages).orderBy("page_id").collect()
    assert (a.declared, a.suffix, a.host) == ("de", "de", "a.example.de") and a.page_text.split() == ["ja", "gut"]
    assert (b.declared, b.suffix, b.host, b.page_text) == ("", "", "", "")


# --- BPE -----------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcthe ing  \n\t'sreve1290é中\u0085\x1c-=_AaAa") for _ in range(rng.randrange(80))) for _ in range(1500)]
    texts += ["a" * n for n in range(1, 80)] + [" " * n + "x" for n in range(5)] + ["x<|endoftext|>y", "<|endoftext|>", "", "z" * 50_000]
    rows = [(i, x) for i, x in enumerate(texts)] + [(-1, None)]
    got = bpe.with_ids(spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)), decode=True).collect()
    assert len(got) == len(rows)
    for r in got:
        want = t.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids_, "<u4").tolist() == want and r.n_tokens == len(want) and r.ids == 1
        assert r.decoded == t.decode(want, skip_special_tokens=False)
    assert bpe.with_text(bpe.with_ids(table(spark, ODD))).where("decoded <> coalesce(text, '')").count() == 0
    assert bpe.with_ids(table(spark, ODD).where("false")).count() == 0


def test_bpe_sections_change_nothing(monkeypatch):
    pytest.importorskip("public_tokenizers")
    m = bpe.Model(bpe._source(None))
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab  \n\t'sé中\u0085\u3000.,12") for _ in range(400)) + "<|endoftext|> x" for _ in range(60)] + ["a" * 300, " " * 300]
    whole = m.encode(texts)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 20)
    assert m.encode(texts) == whole and [m.decode(w) for w in whole] == texts
    assert len(list(m.sections(texts[0]))) > 5 and "".join(m.sections(texts[0])) == texts[0]


def test_bpe_speculation_is_checked():
    pytest.importorskip("public_tokenizers")
    m = bpe.Model(bpe._source(None))
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghinorst") for _ in range(9)) for _ in range(400)]
    proposals = [m.propose(w.encode()) for w in words]
    good = m._compatible(proposals)
    assert 0 < sum(good) < len(words)
    assert all((p == m.merge(w.encode())) == g for w, p, g in zip(words, proposals, good))


# --- chat ----------------------------------------------------------------------------------------


def test_templates():
    run = lambda s, **d: chat_template.compile_template(s)(d)[0]
    assert run("{% for x in xs %}{{ loop.index }}{{ x.n|upper }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[{"n": "a"}, {"n": "b"}]) == "1A,2B"
    assert run("{{ 1 + 2 }}{{ 'a' if true else 'b' }}{# no #}{% set y = 'q' ~ 3 %}{{ y }}{{ z|default('-') }}") == "3aq3-"
    assert run("{% if a == 1 %}x{% elif a in [1] %}y{% else %}z{% endif %}".replace("in [1]", "== 2"), a=2) == "y"
    assert chat_template.fold_body(chat_template.parse("a{{ 1 + 1 }}{% if false %}b{% endif %}c")) == [("put", ("value", "a2c"))]
    for bad in ("{{ x.__class__() }}", "{{ f(1) }}", "{% for %}{% endfor %}", "{% if a %}", "{% endfor %}", "{{ 'a }}", "{% import os %}", "{{ a|nofilter }}", "{% if a %}{% else %}{% elif b %}{% endif %}", "{% if a %}{% else %}{% else %}{% endif %}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.parse(bad)
    assert run("{{ x.__class__ }}{{ x.y.z }}", x={}) == ""
    for wrong in ("{{ x|length }}", "{{ 'a' + x }}"):
        with pytest.raises(chat_template.TemplateError):
            run(wrong, x=None)
    for text in ("", "\\l", "</turn>\n<turn>", "\\\\<", "a\\nb\n", "<|x|>"):
        assert chat_template.unescape(chat_template.escape(text)) == text == chat_template.unescape(chat_template.escape_line(text))


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a</turn>\n"), (2, None, None, "x"), (None, 0, "user\n<", "y"), (3, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat_template.format_conversations(df, add_generation_prompt=True).collect()}
    assert len(got) == 4 and got[1].n_turns == 3
    assert chat_template.read_back(got[1].formatted) == [("user", ""), ("assistant", "a</turn>\n"), ("assistant", "b")]
    assert [chat_template.unescape(got[1].formatted[a:b]) for a, b in got[1].loss_spans] == ["a</turn>\n", "b"]
    assert chat_template.read_back(got[None].formatted) == [("user\n<", "y")] and got[2].loss_spans == []
    assert all(r.formatted.endswith("<turn>assistant\n") for r in got.values())
    assert chat_template.format_conversations(df.where("false")).count() == 0


# --- urls ----------------------------------------------------------------------------------------


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    urls = ["http://A.NET/x", "http://net", "https://x.example.net/en/1", "https://example.net/de/", "ftp://example.com/de/?q#f", "x://y.org/fr/", "org/fr/", None, "", "http://www.a.com:80/p/#z", "http://a.com/p?x=1", "http://a.com/p", "http://b.com/p"]
    pages = spark.createDataFrame([(i, u, "k", "h") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string").drop("rule", "host")
    listed = spark.createDataFrame([("https://a.com/p/",), (None,), ("https://a.com/p/",), ("junk",)], "url string")
    got = {r.page_id: r for r in url_filter.judge(pages, listed).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest.split("/")[0].split("?")[0].split("#")[0].lower()
        path = rest[len(host) :].split("?")[0].split("#")[0]
        rule, verdict = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or ("block" if got[i].listed else "allow"))
    assert [i for i in got if got[i].listed] == [9, 11]
    assert url_filter.judge(pages.where("false"), listed).count() == 0
    assert url_filter.judge(pages, listed.where("false")).where("listed").count() == 0


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("http://h.com/"), "id").alias("url"))
    pages = spark.range(12000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.com/"), "id").alias("url"))
    got = url_filter.judge(pages, listed)
    r = got.agg(F.count_if("listed").alias("l"), F.count_if("maybe_listed").alias("m")).first()
    assert r.l == 3000 and 3000 <= r.m < 3000 + 0.02 * 9000


# --- media ---------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    got = mpeg.with_found(mpeg.with_media(table(spark, ODD))).collect()
    assert len(got) == len(ODD)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(ODD, key=lambda x: (x[0] is None, x[0]))):
        raw = (t or "").encode()
        want = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        assert r.payload == want and r.n_bytes == r.tag_n_bytes == len(raw) and r.n_crc_bad == 0 and r.n_crc_good == len(want) // 576
        assert r.n_samples == 1152 * r.n_frames and r.sample_rate == 48000 and all(r.media[o : o + 2] == b"\xff\xfa" for o in r.seek_offsets)
    assert mpeg.with_found(mpeg.with_media(table(spark, ODD).where("false"))).count() == 0


def test_media_parser():
    rng = random.Random(1)
    payload = bytes(rng.choice([0xFF, 0xFA, 0xFB, 0xC4, 0]) for _ in range(576 * 9))
    media = mpeg.store(payload, 5000)
    assert mpeg.load(media)[0] == payload
    broken = bytearray(media)
    at = int(mpeg.frame_offsets(media)["offsets"][3])
    broken[at + 10] ^= 1  # side information
    assert mpeg.frame_offsets(bytes(broken))["crc_bad"] == 1
    cut = media[: at + 5] + media[at + 672 :]  # most of a frame is lost
    found = mpeg.frame_offsets(cut)
    assert 5 <= len(found["offsets"]) <= 9 and found["skipped"] >= 0
    lead = mpeg.frame_offsets(b"junk\xff\xf0junk" + media[-672 * 4 :] + b"TAG" + b"name".ljust(125, b"\0"))
    assert len(lead["offsets"]) == 4 and lead["skipped"] == 10 and lead["tags"]["title"] == "name"
    assert mpeg.frame_offsets(b"")["samples"] == 0 and mpeg.frame_offsets(b"\xff" * 1000)["samples"] == 0
    h = mpeg.header(bytes([0xFF, 0xF3, 0x90, 0xC0]))
    assert (h["version"], h["layer"], h["rate"], h["samples"], h["kbit"]) == (2.0, 3, 22050, 576, 80)
    # a 44.1 kHz layer III frame of 128 kbit/s has 417 bytes, padded 418
    assert [mpeg.header(bytes([0xFF, 0xFB, 0x90 | p << 1, 0]))["size"] for p in (0, 1)] == [417, 418]
    vbri = b"\xff\xfb\x90\x00" + bytes(32) + b"VBRI" + bytes(6) + (4000).to_bytes(4, "big") + (9).to_bytes(4, "big") + b"\0\2\0\1\0\2\0\1" + b"\0\5\0\6"
    assert mpeg.vbr_table(vbri, 32) == {"kind": "VBRI", "bytes": 4000, "frames": 9, "seek": [5, 6]}


@pytest.mark.parametrize("units", [1, 3])
def test_media_payload_is_no_tag(units):
    for at in range(576 - 128, 576 - 2):
        payload = b"x" * (576 * (units - 1) + at) + b"TAG" + b"y" * (573 - at)
        got, found = mpeg.load(mpeg.store(payload, len(payload)))
        assert got == payload and len(found["offsets"]) == units and found["skipped"] == 0


def test_media_digests(spark):
    r = mpeg.op8_mpeg_audio(spark, "/root/testdata/sf0.001") if os.path.isdir("/root/testdata/sf0.001") else None
    if r is not None:
        docs = {x.doc_id: x.text.encode() for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
        for x in r.collect():
            want = docs[x.doc_id].ljust(max(1, -(-len(docs[x.doc_id]) // 576)) * 576, b"\xff")
            assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(docs[x.doc_id]), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))


# --- Jaccard join --------------------------------------------------------------------------------


def family(rng, n, words=60, edits=6):
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_join_against_brute_force(spark, seed):
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [t for k in range(5) for t in family(rng, rng.randrange(1, 40))]
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 25))) for _ in range(80)]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(40)] + texts[:20]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute.join(rows)


@pytest.mark.parametrize("what", ["hot", "doubled", "long"])
def test_join_in_rare_ways(spark, what, monkeypatch):
    rng = random.Random(9)
    texts = [t for _ in range(4) for t in family(rng, 12)] + [" ".join(["p q r s t", *(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 9)))]) for _ in range(60)]
    if what == "hot":  # a shingle of 8 documents is dealt out in parts
        monkeypatch.setattr(jaccard_join, "HOT", 8)
        monkeypatch.setattr(jaccard_join, "LEAST_COMMON", 2)
        texts = ["p q r s t " * 3 + t for t in texts]
    elif what == "doubled":  # halves of set names that many sets share
        real = jaccard_join.names_of
        monkeypatch.setattr(jaccard_join, "names_of", lambda tokens: (real(tokens)[0] % 7, real(tokens)[1]))
    else:
        monkeypatch.setattr(jaccard_join, "CHUNK", 40)
    rows = list(enumerate(texts + texts[:9]))
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute.join(rows)


def test_join_odd_rows(spark):
    got = jaccard_join.join(table(spark, ODD)).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute.join(ODD)
    assert jaccard_join.join(table(spark, ODD).where("false")).count() == 0
    kept = jaccard_join.one_of_each(table(spark, ODD))
    assert kept.columns == table(spark, ODD).columns
    assert sorted(map(repr, [r.doc_id for r in kept.collect()])) == sorted(map(repr, [1, 2, 3, 4, 5, 7, None, 8]))


def test_bits_bound():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 5000, rng.integers(1, 300)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        b = np.unique(rng.integers(0, 5000, rng.integers(1, 900)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        assert jaccard_join.lacks(jaccard_join.bits_of(a, len(a)), jaccard_join.bits_of(b, len(b))) <= len(np.setdiff1d(a, b))


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.vertex: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {v: find(v) for v in root if find(v) != v}


# --- licences ------------------------------------------------------------------------------------


def test_licences(spark):
    mit = next(t for i, t in TEXTS if i == "MIT")
    changed = "Copyright (c) 2019 Somebody\n\n" + mit.replace("sublicense", "sub-license").replace(",", " ,").upper()
    texts = [(1, mit), (2, changed), (3, "Some words.\nReleased under the MIT licence!\nreleased  under the mit License"), (4, mit + " And more."), (5, None), (6, ""), (7, "MIT"), (8, LONG), (None, "Licensed under CC BY-NC 4.0.")]
    got = {(r.doc_id, r.licence, r.scope): r.n_matches for r in licences.scan(table(spark, texts)).collect()}
    assert got == {(1, "MIT", "document"): 1, (2, "MIT", "document"): 1, (3, "MIT", "line"): 2, (None, "CC-BY-NC-4.0", "document"): 1, (None, "CC-BY-NC-4.0", "line"): 1}
    assert licences.scan(table(spark, texts).where("false")).count() == 0


def test_licences_whole_long_texts(spark):
    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    if not all(os.path.isfile(f"{folder}/{f}") for f in names.values()):
        pytest.skip("no licence texts")
    assert set(names) <= {i for i, _ in DIGESTS}
    texts = [open(f"{folder}/{f}", encoding="utf-8").read() for f in names.values()]
    rows = [(i, re.sub(r"\bLICENSE\b", "LICENCE", t.upper().replace(" ", "  "))) for i, t in enumerate(texts)] + [(100 + i, t + " more") for i, t in enumerate(texts)]
    got = {(r.doc_id, r.licence) for r in licences.scan(table(spark, rows)).where("scope = 'document'").collect()}
    assert got == set(enumerate(names))


# --- all operators -------------------------------------------------------------------------------

CLASHES = ["box", "text_", "evidence", "host", "path", "pn", "hs", "id", "h", "r", "n", "rank", "slot", "start", "declared", "known", "means", "scores", "prior", "language",
           "quality_keep", "mix_position", "mix_source", "ids", "n_tokens", "decoded", "w0", "block", "canonical", "found", "own", "rule", "gone", "Host", "a.b", "with space", "__next", "__b"]
OPERATORS = {
    "fingerprints": lambda spark, df: fingerprints.fingerprint_documents(df),
    "quality": lambda spark, df: quality.judge(df, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")),
    "language": lambda spark, df: language.identify(df, declared=F.col("lang"), suffix=F.col("source"), host=F.col("source")),
    "mixing": lambda spark, df: mixing.with_positions(df),
    "mixed": lambda spark, df: mixing.mixed(df),
    "bpe": lambda spark, df: bpe.with_ids(df, decode=True),
    "urls": lambda spark, df: url_filter.judge(df, df.select(F.col("url")).where("doc_id = 1")),
    "join": lambda spark, df: jaccard_join.join(df),
    "one_of_each": lambda spark, df: jaccard_join.one_of_each(df),
    "licences": lambda spark, df: licences.scan(df),
    "media": lambda spark, df: mpeg.with_found(mpeg.with_media(df)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, name):
    texts = [(1, "a b c d e f"), (2, None), (None, "x"), (2, "a b c d e f"), (3, "Released under the MIT License.")]
    df = spark.createDataFrame([(i, t, "en" if t else None, "s", f"http://{j}.net/") for j, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, url string")
    for c in CLASHES:
        if c != "Host":
            df = df.withColumn(c, F.lit(f"mine {c}"))
    df = df.withColumns({"maps": F.array(F.create_map(F.lit("k"), F.lit(1))), "raw": F.lit(b"1"), "nothing": F.lit(None).cast("double")})
    columns = df.columns
    for rows in (df, df.where("false")):
        out = OPERATORS[name](spark, rows)
        got = out.collect()
        columns = [c for c in columns if name != "media" or c != "text"]
        if name not in ("fingerprints", "join", "licences"):
            assert out.columns[: len(columns)] == columns and len({c.lower() for c in out.columns}) == len(out.columns)
            assert all(r[c] == f"mine {c}" for r in got for c in CLASHES if c != "Host")
        assert rows is df or not got
        assert rows is not df or len(got) == {"one_of_each": 3, "licences": 2}.get(name, len(texts))


def test_shared_dir_needs_a_shared_folder(monkeypatch):
    monkeypatch.setattr(common, "_OWN", {})
    session = lambda master, where=None: SimpleNamespace(conf={"spark.checkpoint.dir": where}, sparkContext=SimpleNamespace(master=master))
    assert common.shared_dir(session("spark://elsewhere:7077", "hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(ValueError):
        common.shared_dir(session("spark://elsewhere:7077"))
    own = common.shared_dir(session("local[2]"))
    assert os.path.isdir(own) and common.shared_dir(session("local[2]")) == own
