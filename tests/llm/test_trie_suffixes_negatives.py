"""The prefix trie, suffix-array dedup and hard negatives against brute force, and on odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundgrid.llm import negatives, suffixes, trie
from groundgrid.llm.common import crc_mod

CONV = "conv_id long, turn long, role string, text string, k1 string, depth string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    head = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: head[c]] + own[c][head[c] :] for c in own}


def brute_trie(rows):
    found = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for node, cs in members.items():
        under = [n for n in members if n[: len(node)] == node]
        children = [n for n in under if len(n) == len(node) + 1]
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in under) for n in under)
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in under if n)
        ends = hashlib.sha256(",".join(map(str, sorted(c for c in cs if len(found[c]) == len(node)))).encode()).hexdigest()
        out.add((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children), leaves, saved, ends))
    return out


def trie_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(100, 125), 250, 251, 999]:
        for t in range(rng.choice([1, 1, 2, 3, 7])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hello", "hello", "hi there", "ü", ""]) if t < 2 else rng.choice(["a", "bb"])))
    rows += [(7, 50 + i, "user", f"turn {i % 9}") for i in range(60)]  # one long conversation
    rows += [(300, None, "user", "null first"), (300, 0, None, None), (None, 0, "user", "no id"), (301, 1, "user", "tie b"), (301, 1, "user", "tie a"), (301, 1, "user", "tie a")]
    return rows


@pytest.mark.parametrize("block", [2, 40, 50_000])
def test_trie_equals_brute_force(spark, block):
    rows = trie_rows(block)
    c = F.col("conv_id")
    got = trie.prefix_trie(spark.createDataFrame([(*r, "x", "y") for r in rows], CONV).repartition(3), c - c % 100, crc_mod(c, 6), 5, block).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == brute_trie(rows)


def test_trie_of_nothing_and_of_a_turnless_conversation(spark):
    c = F.col("conv_id")
    assert trie.prefix_trie(spark.createDataFrame([], CONV), c - c % 100, crc_mod(c, 6)).count() == 0
    alone = next(i for i in range(101, 200) if zlib.crc32(str(i).encode()) % 6 >= 1)  # its head is longer than what it has, its base is absent
    got = trie.prefix_trie(spark.createDataFrame([(alone, 0, "user", "x", "", "")], CONV), c - c % 100, crc_mod(c, 6)).collect()
    assert set(map(tuple, got)) == brute_trie([(alone, 0, "user", "x")]) and len(got) == 1


def test_running_sums_cross_partitions(spark):
    rows = [(k, i, k * 1000 + i * 7) for k, n in ((1, 3), (2, 700), (3, 1), (5, 40)) for i in range(n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = trie.running(spark.createDataFrame(rows, "k long, i long, x long"), "k", ["i"], ["i", "x"], ["x"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for k, i, _ in rows:
        want[k, i] = (i + 1, int(np.bitwise_xor.reduce([k * 1000 + j * 7 for j in range(i + 1)])))
    assert {(r.k, r.i): (r.n, r.x) for r in got} == want


def test_centroid_rollup_on_a_path_a_star_and_random_trees():
    rng = random.Random(8)
    for n, parent in ((1, lambda i: 0), (400, lambda i: i - 1), (400, lambda i: 0), *[(200, lambda i: rng.randrange(i)) for _ in range(5)]):
        parents = [-1, *[parent(i) for i in range(1, n)]]
        weights = [rng.choice([1, 1, 9]) for _ in range(n)]
        values = [(rng.randrange(5), rng.randrange(100)) for _ in range(n)]
        sizes, sums = list(weights), [list(v) for v in values]
        for i in range(n - 1, 0, -1):
            sizes[parents[i]] += sizes[i]
            sums[parents[i]] = [a + b for a, b in zip(sums[parents[i]], sums[i])]
        assert trie.centroid_rollup(parents, sizes, values) == sums


DOC = "doc_id long, text string, windows string, kept string"


def brute_suffixes(rows, length=100):
    seen, out = set(), {}
    for key in sorted({(d is None, d or 0, t or "") for d, t in rows}):
        data = key[2].encode()
        gone = bytearray(len(data))
        for j in range(len(data) - length + 1):
            w = data[j : j + length]
            if w in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[None if key[0] else key[1]] = (len(data), sum(gone), sum(g and not p for g, p in zip(gone, b"\0" + gone)), kept)
    return out


def suffix_rows(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["wald", "baum", "höhe", "kante", "licht"]) + str(rng.randrange(50))
    passages = [" ".join(word() for _ in range(n)) for n in (14, 20, 40, 120)] + ["=" * 260, "ab" * 130, "é" * 90]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(1, 40)))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 3)
            parts += [p[a : a + rng.randrange(60, 400)], " ".join(word() for _ in range(rng.randrange(30)))]
        rows.append((i, " ".join(parts)))
    rows += [(100 + i, rows[i][1]) for i in range(0, 20, 3)]  # exact copies
    rows += [(200 + i, passages[3][:300] + str(i) * 3 + passages[2]) for i in range(40)]  # one gram among many contexts
    rows += [(300, None), (301, ""), (302, "x" * 99), (303, "x" * 101), (None, rows[3][1]), (5, rows[5][1])]
    rows += [(400, "0123456789" * 3000 + passages[1])]
    return rows


@pytest.mark.parametrize("chunk,block", [(1 << 17, 50_000), (64, 7)])
def test_suffix_dedup_equals_brute_force(spark, chunk, block, monkeypatch):
    rows = suffix_rows(chunk)
    whole = suffixes.repeated_windows
    monkeypatch.setattr(suffixes, "repeated_windows", lambda docs, length: whole(docs, length, chunk, block))
    got = suffixes.remove_repeats(spark.createDataFrame([(*r, "w", "k") for r in rows], DOC).repartition(5)).collect()
    want = brute_suffixes(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id], r.doc_id
        assert sum(s["last"] - s["first"] + 1 for s in r.removed) == r.n_removed and r.windows == "w"


def test_suffix_dedup_over_many_partitions(spark):
    rng = random.Random(1)
    line = "The same long line stands in very many of these documents, and what stands round it differs in each one of them."
    rows = [(i, f"{rng.random()} {line} {rng.random()}") for i in range(400)] + [(1000 + i, "copy " * 60) for i in range(150)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute_suffixes(rows)
    assert all((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id] for r in got) and len(got) == 550


def test_suffix_dedup_of_nothing(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], DOC)).count() == 0
    only = suffixes.remove_repeats(spark.createDataFrame([(1, None, "", "")], DOC)).collect()[0]
    assert (only.n_bytes, only.n_removed, only.n_spans, bytes(only.kept)) == (0, 0, 0, b"")


def brute_negatives(rows, positives=5, negatives_=10):
    ok = sorted({(v, lab, tuple(int(np.floor(256 * float(x))) for x in e)) for v, e, lab in rows if v is not None and lab is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)})
    out = set()
    for a in ok:
        if a[0] % 100:
            continue
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2]))  # noqa: B023, E731
        best = sorted((-score(r), r[0]) for r in ok if r is not a and r[1] == a[1])[:positives]
        others = sorted((-score(r), r[0]) for r in ok if r[1] != a[1])
        for s, p in best:
            fit = [(n, v) for n, v in others if 30 * -s <= 100 * -n <= 90 * -s][:negatives_]
            out |= {(a[0], p, k + 1, v, -s, -n) for k, (n, v) in enumerate(fit)}
    return out


VEC = "vec_id long, embedding array<float>, label int, row string"


def vector_rows():
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6) * (i % 3 + 0.2))], int(i % 4)) for i in range(250)]
    rows += [(300, None, 1), (301, [1.0, None, 2.0, 3.0, 4.0, 5.0], 1), (302, [float("nan")] * 6, 1), (303, [float("inf")] * 6, 2), (304, [1.0] * 6, None), (None, [1.0] * 6, 2), (200, rows[200][1], rows[200][2]), (400, [0.0] * 6, 3), (500, [1.0], 0), (600, [], 1)]
    return rows + [(700 + i, rows[100][1], 1) for i in range(8)]  # ties


@pytest.mark.parametrize("sizes", [(2048, 8192), (2, 30)])
def test_negatives_equal_brute_force(spark, sizes):
    rows = vector_rows()
    got = negatives.hard_negatives(negatives.prepared(spark.createDataFrame([(*r, "x") for r in rows], VEC)), F.col("vec_id") % 100 == 0, anchor_rows=sizes[0], group_rows=sizes[1]).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == brute_negatives(rows)


def test_negatives_of_nothing(spark):
    assert negatives.hard_negatives(negatives.prepared(spark.createDataFrame([], VEC)), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.hard_negatives(negatives.prepared(spark.createDataFrame([(1, [1.0], 1, "")], VEC)), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("span", [1, 200, 2**20, 2**40, 2**62])
def test_packed_scores_are_exact(span):
    rng = np.random.default_rng(span % 97)
    a, c = (rng.integers(-span, span, (n, 17)) for n in (5, 11))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in c] for p in a]
    most = 2**63 - 1
    assert negatives.packed_scores(a, c).tolist() == [[min(max(x, -most), most) for x in q] for q in want]
