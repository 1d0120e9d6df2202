"""Benchmark decontamination (4): a generalised suffix automaton over the words of test items."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, fresh, map_arrow

#: A-Z to a-z, digits, a-z and all bytes of non-ASCII characters stay; the rest parts words.
_WORDS = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b) in LOWER else ord(chr(b).lower()) if chr(b) in UPPER else 0x20 for b in range(256))
_WORD = re.compile(rb"[^\x20]+")
_SPANS = "array<struct<first:int,last:int>>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


class Automaton:
    """Suffix automaton of all items' word sequences.

    It answers, for each position of a streamed text, how many of the last words form a
    substring of an item (the matching length), and which items have a window ending there.
    A window is `length` consecutive words of an item; an item that is shorter must be covered
    by the share `coverage` of its words, as a run that it begins with (1.0: whole).

    It is built with a table a state and then frozen into flat arrays, some 30 bytes a
    transition, so that each worker holds little: transitions sorted by state and word, and
    the marked states with the range of their marks.
    """

    def __init__(self, items: list[tuple[str | None, bytes | None]], length: int, coverage: float = 1.0):
        self.length, self.ids = length, {}
        self.next, self.link, self.size = [{}], [-1], [0]
        seqs = [(name, [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]) for name, text in items]
        seqs = [(name, s) for name, s in seqs if s]
        for _, s in seqs:
            last = 0
            for w in s:
                last = self._extend(last, w)
        marks: dict[int, set[tuple[int, int]]] = {}  # state: matching lengths from which it counts, and items
        self.names, self.least = [name for name, _ in seqs], length
        for item, (_, s) in enumerate(seqs):
            need = min(length, max(1, int(np.ceil(coverage * len(s)))))
            self.least = min(self.least, need)
            at = 0
            for i, w in enumerate(s[: need if need < length else None]):
                at = self.next[at][w]
                if i + 1 >= need:
                    u = at
                    while self.size[self.link[u]] >= need:
                        u = self.link[u]
                    marks.setdefault(u, set()).add((need, item))
        order = sorted(range(len(self.size)), key=self.size.__getitem__)
        near = [-1] * len(order)  # the nearest state on the suffix path, itself included, that has marks
        for u in order:
            near[u] = u if u in marks else near[self.link[u]] if u else -1
        pairs = {(a, b) for _, s in seqs for a, b in zip(s, s[1:])}
        self.seen = np.zeros(1 << 22, bool)
        if pairs:
            a = np.array(sorted(pairs), "uint64")
            self.seen[self._slot(a[:, 0], a[:, 1])] = True
        keys = np.fromiter((u << 32 | w for u, t in enumerate(self.next) for w in t), "int64")
        to = np.fromiter((v for t in self.next for v in t.values()), "int32", len(keys))
        order = np.argsort(keys)
        self.keys, self.to = array("q", keys[order].tobytes()), array("i", to[order].tobytes())
        del self.next
        self.link, self.size, self.near = array("i", self.link), array("i", self.size), array("i", near)
        self.marked = array("i", sorted(marks))
        self.first_mark = array("i", np.cumsum([0, *(len(marks[u]) for u in self.marked)]).astype("int32").tobytes())
        self.need = array("i", (n for u in self.marked for n, _ in sorted(marks[u])))
        self.item = array("i", (i for u in self.marked for _, i in sorted(marks[u])))

    def step(self, state: int, w: int) -> int:
        """The state after a word, or 0."""
        key = state << 32 | w
        at = bisect_left(self.keys, key)
        return self.to[at] if at < len(self.keys) and self.keys[at] == key else 0

    @staticmethod
    def _slot(a, b):
        return ((a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(42)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        if w in nxt[last]:  # an earlier item has it
            q = nxt[last][w]
            return q if size[q] == size[last] + 1 else self._clone(last, w, q)
        cur = len(size)
        nxt.append({}), link.append(0), size.append(size[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        new = len(self.size)
        self.next.append(dict(self.next[q])), self.link.append(self.link[q]), self.size.append(self.size[p] + 1)
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans (first and last word, inclusive) inside occurring windows, and the items they come from."""
        n = len(words)
        get = self.ids.get
        found = np.fromiter((get(w, 0) for w in words), "uint64", n)
        # Only stretches of words whose every neighbouring pair may be in an item can hold a match.
        joined = self.seen[self._slot(found[:-1], found[1:])] & (found[:-1] > 0) & (found[1:] > 0) if n > 1 else np.zeros(0, bool)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], joined.astype("int8"), [0]))))
        begin, end = edge[::2], edge[1::2]  # words begin..end inclusive
        if self.least == 1:
            alone = found > 0
            alone[:-1] &= ~joined
            alone[1:] &= ~joined
            solo = np.flatnonzero(alone)
            begin, end = np.concatenate((begin, solo)), np.concatenate((end, solo))
            order = np.argsort(begin, kind="stable")
            begin, end = begin[order], end[order]
        keep = end - begin + 1 >= self.least
        spans: list[list[int]] = []
        items: set = set()
        step, link, size, near = self.step, self.link, self.size, self.near
        for b, e in zip(begin[keep].tolist(), end[keep].tolist()):
            state, length = 0, 0
            for at, w in enumerate(found[b : e + 1].tolist(), b):
                while not (to := step(state, w)) and state:
                    state = link[state]
                    length = size[state]
                state = to
                length = length + 1 if state else 0
                u, most, longest = near[state], length, 0
                while u != -1:
                    most = min(length, size[u])
                    m = bisect_left(self.marked, u)
                    for i in range(self.first_mark[m], self.first_mark[m + 1]):
                        if self.need[i] <= most:
                            items.add(self.names[self.item[i]])
                            longest = max(longest, self.need[i])
                    u = near[link[u]] if u else -1
                if longest:
                    first = at - longest + 1
                    while spans and first <= spans[-1][1] + 1:  # a long window may hold several spans of short items
                        first = min(first, spans.pop()[0])
                    spans.append([first, at])
        return [tuple(x) for x in spans], items


def _blocks(benchmark: DataFrame, block_words: int):
    """The items as lists of bounded size, each with the number of lists: hash blocks, collected one by one."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // (8 * block_words)))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield [(r["item_id"], bytes(r["text"])) for r in rows.collect()], n


_HITS = [("n_words", pa.int64()), ("hit_spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("hit_items", pa.list_(pa.string()))]


def _marked(shared, kept: list[str], sparse: bool):
    """Batches (kept..., text as bytes) with the three results in place of the text; sparse: only rows with a hit."""

    def run(batches):
        automaton = shared.value
        for b in batches:
            counts, spans, names = [], [], []
            for t in b.column(len(kept)):
                words = words_of(t.as_py())
                new, items = automaton.stream(words)
                counts.append(len(words))
                spans.append([{"first": x, "last": y} for x, y in new])
                names.append(sorted(x for x in items if x is not None))
            made = [pa.array(col, kind) for col, (_, kind) in zip((counts, spans, names), _HITS)]
            b = pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *made], names=[*kept, *(n for n, _ in _HITS)])
            yield b.filter(pa.array([bool(x) for x in spans], pa.bool_())) if sparse else b

    return run


def _merged(lists):
    """The spans of several blocks as one merged list."""
    return lists.map(lambda spans: [{"first": x, "last": y} for x, y in merged(sorted((s["first"], s["last"]) for part in spans for s in part))])


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10, coverage: float = 1.0, block_words: int = 200_000) -> DataFrame:
    """docs with n_words, hit_spans (words first..last, merged, in order) and hit_items (sorted item ids as strings).

    Words: whole text, A-Z lower-cased, runs of digits, a-z and non-ASCII characters. A word is
    hit inside any occurrence of `length` consecutive words of an item, or of a shorter item's
    first words that make up the share `coverage` of it (1.0: the whole item). The texts stream
    past automata of about block_words words each, however large the benchmark is. One block:
    no shuffle. Several: each pass writes only the hits, keyed by a hash of the text so that
    copies count once, and the hits are joined to docs at the end.

    Null or empty texts have no words; items without words or with a null text match nothing;
    items with a null id mark words but aren't listed; repeated ids are listed once; repeated
    rows are marked each. An empty benchmark marks nothing. Columns of docs named like the
    three results are replaced.
    """
    docs = docs.drop(*(n for n, _ in _HITS))
    as_bytes, h1, h2 = fresh(docs, "text_bytes", "text_h1", "text_h2")
    content = F.col("text").cast("binary").alias(as_bytes)
    results = {"n_words": F.lit(0).cast("long"), "hit_spans": F.array().cast(_SPANS), "hit_items": F.array().cast("array<string>")}
    sc = docs.sparkSession.sparkContext
    parts, total = [], None
    for items, blocks in _blocks(benchmark, block_words):
        shared = sc.broadcast(Automaton(items, length, coverage))  # bounded by block_words
        if blocks == 1:
            return map_arrow(docs.select("*", content), _marked(shared, docs.columns, False), docs.withColumns(results).schema)
        keyed = docs.select(*_text_hash(h1, h2), content)
        hits = map_arrow(keyed, _marked(shared, [h1, h2], True), keyed.drop(as_bytes).withColumns(results).schema)
        parts.append(cut(hits.dropDuplicates([h1, h2])))
        shared.destroy()
        total = parts[-1] if total is None else total.union(parts[-1])
    hits = total.groupBy(h1, h2).agg(F.collect_list("hit_spans").alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("hit_items"))
    hits = cut(hits.withColumn("hit_spans", F.pandas_udf(_merged, _SPANS)("hit_spans")))
    empty = sc.broadcast(Automaton([], length, coverage))
    counted = map_arrow(docs.select("*", *_text_hash(h1, h2), content), _marked(empty, [*docs.columns, h1, h2], False), docs.select("*", *_text_hash(h1, h2)).withColumns(results).schema)
    both = counted.drop("hit_spans", "hit_items").join(hits, [h1, h2], "left")
    return both.select(*docs.columns, "n_words", *(F.coalesce(n, results[n]).alias(n) for n in ("hit_spans", "hit_items")))


def _text_hash(h1: str, h2: str) -> list[Column]:
    return [F.xxhash64("text").alias(h1), F.xxhash64(F.lit(1), "text").alias(h2)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    done: list[tuple[int, int]] = []
    for x, y in spans:
        if done and x <= done[-1][1] + 1:
            done[-1] = (done[-1][0], max(y, done[-1][1]))
        else:
            done.append((x, y))
    return done


def _without(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, bool]:
    """The text without what lies from a span's first to its last word, and whether a word is left."""
    at = [m.span() for m in _WORD.finditer(text.translate(_WORDS))]
    parts, last = [], 0
    for x, y in spans:
        parts.append(text[last : at[x][0]])
        last = at[y][1]
    kept = b"".join([*parts, text[last:]])
    return kept, bool(words_of(kept))


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = 10, coverage: float = 1.0, block_words: int = 200_000) -> DataFrame:
    """docs without the hit spans: the text from a span's first to its last word goes.

    Texts without a hit stay as they are, also empty and null ones; a document that had words
    and has none left goes. Same columns as docs, whatever they are named; a count of the
    text's characters, say, is as it was. With one block of items the texts are read once.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]
    text = own[[c.lower() for c in docs.columns].index("text")]
    plain = docs.toDF(*own)
    items, blocks = next(_blocks(benchmark, block_words))
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(items, length, coverage)) if blocks == 1 else None
    if blocks > 1:
        plain = contamination(plain.withColumnRenamed(text, "text"), benchmark, length, coverage, block_words)
        plain = plain.withColumnRenamed("text", text).select(*own, "hit_spans")

    def run(batches):
        for b in batches:
            texts, stay = b.column(text).to_pylist(), []
            known = b.column("hit_spans").to_pylist() if shared is None else None
            for i, t in enumerate(texts):
                raw, left = (t or "").encode(), True
                spans = shared.value.stream(words_of(raw))[0] if known is None else [(s["first"], s["last"]) for s in known[i]]
                if spans:
                    raw, left = _without(raw, spans)
                    texts[i] = raw.decode("utf-8", "replace")
                stay.append(left)
            b = b.select(own)
            yield b.set_column(b.schema.get_field_index(text), text, pa.array(texts, pa.string())).filter(pa.array(stay, pa.bool_()))

    return map_arrow(plain, run, docs.toDF(*own).schema).toDF(*docs.columns)
