"""The stages of the pipeline against brute force, and on nulls, empties, repeats, clashing columns and empty tables."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_llm import brute_hits, brute_lines, jaccard_roots

import corpus_pipeline
from groundgrid.llm import bpe, decontaminate, quality, simhash
from groundgrid.llm.common import crc_mod

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def brute_statistics(text):
    """The statistics of quality.STATISTICS, one by one."""
    t = (text or "").encode()
    if not t:
        return dict.fromkeys(quality.STATISTICS, 0.0)
    share = lambda of: sum(c in of for c in t) / len(t)
    words, lines = t.split(), t.split(b"\n")
    odd = sum(w[0] in b"%$#&*|@^~" or w[-1] in b"%$#&*|@^~" for w in words)
    blank = sum(c in b" \t\r\x0b\x0c\n" for c in t)
    return {
        "log_chars": math.log1p(len(t)), "upper": share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": share(b"0123456789"), "spaces": share(b" \t\r\x0b\x0c"), "newlines": share(b"\n"),
        "symbols": share(b"%$#&*@^~<>{}[]\\/=+_"), "bangs": share(b"!?"), "stops": share(b".,;:"), "pipes": share(b"|"), "non_ascii": sum(c > 127 for c in t) / len(t),
        "word_chars": (len(t) - blank) / max(1, len(words)), "distinct_words": len(set(words)) / max(1, len(words)), "distinct_lines": len(set(lines)) / len(lines), "symbol_words": odd / max(1, len(words)),
    }


def brute_score(text, model):
    found = brute_statistics(text)
    holds = lambda i, low, t: (found[quality.STATISTICS[i]] <= t) == low
    total = model.bias + sum(w for rule, w in zip(model.rules, model.weights) if all(holds(*c) for c in rule))
    return 1 / (1 + math.exp(-total))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Good prose with shared lines, near copies and benchmark passages, and junk of symbols; all labelled."""
    rng = random.Random(21)
    pool = [f"{a}{b}" for a in "ba do fi gu le mo na pe ri su".split() for b in "lan mer tis kor den".split()]
    sentence = lambda n: " ".join(rng.choice(pool) for _ in range(n)) + "."
    items = [(i, " ".join(f"exam{i}w{j}" for j in range(n))) for i, n in enumerate([14, 25, 4])]
    shared = ["a line that many documents share, " + sentence(6) for _ in range(4)]
    good = []
    for i in range(90):
        lines = [sentence(12) for _ in range(4)]
        if i % 5 == 0:
            lines.insert(2, rng.choice(shared))
        if i % 9 == 0:
            lines.append("before " + rng.choice(items)[1] + " after " + sentence(5))
        good.append("\n".join(lines))
    for i in range(0, 30, 3):  # near copies that share no whole line
        w = " ".join(good[i].split("\n")).split()
        good.append(" ".join(["changed", *w[1:]]))  # one shingle of 44 or more
    good += [shared[0], shared[0] + "\n" + shared[1], good[5]]  # lose all their lines
    junk = ["".join(rng.choice("#$%&@|~^<>{}!?0123456789 ") for _ in range(rng.randrange(100, 400))) for _ in range(60)]
    rows = [(t, 1) for t in good] + [(t, 0) for t in junk] + [("", 0), (None, 0)]
    rng.shuffle(rows)
    docs = [(d, t, "en", "web", len(t or "")) for d, (t, _) in enumerate(rows)]
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(d, y, 0) for d, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, rows, items


def words_left(text, items):
    hit = set(brute_hits(text, items)[0])
    return [w for i, w in enumerate(decontaminate.words_of((text or "").encode())) if i not in hit]


def test_rules_equal_brute_force(spark, corpus):
    where, rows, _ = corpus
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    model = quality.fit(docs, labels, crc_mod(F.col("doc_id"), 4) != 2)
    assert model.rules
    for r in quality.score(docs, model).collect():
        assert abs(r.score - brute_score(r.text, model)) < 1e-9


def test_each_stage_equals_brute_force_on_its_own_input(spark, corpus):
    from tokenizers import Tokenizer

    where, rows, items = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.cut(stage(spark, docs, where))
        if name != "bpe_encoding":
            assert docs.columns == before.columns
        steps[name] = (texts(before), docs)
    after = {name: texts(df) for name, (_, df) in steps.items() if name != "bpe_encoding"}

    assert after["quality_classifier"] == {d: t for d, (t, y) in enumerate(rows) if y == 1}

    before = steps["line_dedup"][0]
    want = brute_lines(before.items())
    assert after["line_dedup"] == {d: t for d, t in want.items() if t == before[d] or t.strip()}
    assert len(after["line_dedup"]) < len(before)

    before = steps["simhash_near_dedup"][0]
    root = jaccard_roots(list(before.items()))
    assert after["simhash_near_dedup"] == {d: t for d, t in before.items() if root[d] == d}
    assert len(after["simhash_near_dedup"]) <= len(before) - 6

    before = steps["benchmark_decontamination"][0]
    got = after["benchmark_decontamination"]
    assert got.keys() == before.keys()
    for d, t in before.items():
        assert list(decontaminate.words_of(got[d].encode())) == words_left(t, items)
        assert brute_hits(t, items)[0] or got[d] == t
    assert sum(got[d] != t for d, t in before.items()) >= 8

    own = Tokenizer.from_file(bpe.default_vocabulary())
    encoded = steps["bpe_encoding"][1].collect()
    for r in encoded:
        assert r.ids == own.encode(got[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) and r.round_trip

    whole = corpus_pipeline.run(spark, where).collect()
    assert {(r.doc_id, tuple(r.ids)) for r in whole} == {(r.doc_id, tuple(r.ids)) for r in encoded} and len(whole) == len(encoded)


def test_stages_on_odd_rows(spark, corpus):
    """Nulls, empties, repeats and columns named as the operators' own; and an empty table. Only what a stage says it removes goes."""
    where = corpus[0]
    names = ["doc_id", "text", "score", "n_dropped", "text_bytes", "keep", "hit_spans", "component_id", "stat_upper", "map_id", "n_words", "node"]
    schema = ", ".join(n + (" long" if n == "doc_id" else " string") for n in names)
    rows = [(1, None), (2, ""), (2, ""), (3, "one"), (None, "a line of words\nB"), (None, None), (5, "x" * 5000), (6, "A line of words ")]
    odd = spark.createDataFrame([(*r, *names[2:]) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, where)
        assert got.schema.simpleString() == odd.schema.simpleString()
        assert all(tuple(r)[2:] == tuple(names[2:]) for r in got.collect())
        assert stage(spark, odd.limit(0), where).count() == 0
    ids = lambda name: sorted((r.doc_id or 0, r.text or "") for r in STAGES[name](spark, odd, where).collect())
    assert ids("line_dedup") == sorted((d or 0, "B" if t and "\n" in t else t or "") for d, t in rows)
    assert ids("simhash_near_dedup") == sorted((d or 0, t or "") for d, t in rows if d != 2)
    assert ids("benchmark_decontamination") == sorted((d or 0, t or "") for d, t in rows)
    last = STAGES["bpe_encoding"](spark, odd, where).collect()
    assert len(last) == len(rows) and all(r.round_trip for r in last)
    assert STAGES["bpe_encoding"](spark, odd.limit(0), where).count() == 0


def test_near_dedup_links_by_simhash(spark, corpus, monkeypatch):
    """The stage seeks its near copies by fingerprints, and their links are those of op3's: at most two bits."""
    rows = [(i, fp) for i, fp in enumerate([0, 5, 5, 7, -1, -2, 0xF00, 5])]  # 5 and 7 differ in one bit, 0 and 5 in two
    got = {tuple(r) for r in simhash.signed(spark.createDataFrame(rows, "node long, fp long")).collect()}
    assert got == {(1, 2), (1, 7), (0, 1), (1, 3), (4, 5)}
    seen, own = [], simhash.signed
    monkeypatch.setattr(simhash, "signed", lambda nodes: seen.append(own(nodes)) or seen[0])
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").where("text IS NOT NULL")
    near = STAGES["simhash_near_dedup"](spark, docs.union(docs.selectExpr("doc_id + 1000", "concat(text, ' .')", "lang", "source", "n_chars")), corpus[0])
    assert near.count() <= docs.count() + 20 and seen[0].count() >= 20
