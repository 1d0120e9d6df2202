"""BPE encoding and decoding (8): long texts are encoded in parts, in parallel, and joined exactly."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_arrow

#: The pattern by which byte-level BPE of this family parts a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Codec:
    """A byte-level BPE file of the tokenizers library, run by its ranks. Ids rank the merges, which is checked."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(kept)]
        byte = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks = {bytes(byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if all(c in byte for c in token)}
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        for s in special:
            ranks.pop(s.encode(), None)
        merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        if any(file["model"]["vocab"]["".join(m)] != 256 + i for i, m in enumerate(merges)) or file.get("normalizer") or file["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("ids that follow the merges, no normaliser and no prefix space are needed")
        self.bpe = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.tokens: list[bytes] = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for b, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.tokens[i] = b
        self.token_array = pa.array(self.tokens, pa.binary())

    @classmethod
    def at(cls, path: str) -> Codec:
        """One for each worker process."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def encode(self, text: str) -> list[int]:
        return self.bpe.encode(text, allowed_special="all")

    def encode_array(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, allowed_special="all")

    def raw(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def decode_lists(self, lists: pa.ListArray) -> pa.StringArray:
        """The text of each list of ids: the tokens' bytes taken in one go and cut where the lists end."""
        raw = self.token_array.take(lists.flatten())
        ends = np.frombuffer(raw.buffers()[1], "int32")[raw.offset : raw.offset + len(raw) + 1]
        kept = pa.py_buffer(np.packbits(~lists.is_null().to_numpy(zero_copy_only=False), bitorder="little"))
        texts = pa.Array.from_buffers(pa.binary(), len(lists), [kept, pa.py_buffer(ends[_ends(lists)]), raw.buffers()[2]])
        try:
            return texts.cast(pa.string())
        except pa.ArrowInvalid:  # some list isn't UTF-8
            return pa.array([None if x is None else x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())

    def join(self, left: list[int], right: list[int], agree: int = 4) -> list[int]:
        """The encoding of two neighbouring texts' concatenation, from the encodings of each.

        A window of tokens around the join is encoded again and doubled until its outer tokens
        are those that each side had: in BPE a sequence whose neighbouring tokens all stand in
        a valid encoding is the encoding. A side that the window covers whole agrees by itself.
        """
        if not left or not right:
            return [*left, *right]
        k = 16
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            head, tail = self.raw(left[a:]), self.raw(right[:b])
            while a and (head[0] & 0xC0 == 0x80 or head[:1] in b"' "):  # inside a character, or where a pattern of several kinds may begin
                a -= 1
                head = self.tokens[left[a]] + head
            while b < len(right) and self.tokens[right[b]][0] & 0xC0 == 0x80:
                tail += self.tokens[right[b]]
                b += 1
            mid = self.encode((head + tail).decode("utf-8"))
            if (not a or mid[:agree] == left[a : a + agree]) and (b == len(right) or mid[-agree:] == right[b - agree : b]):
                return left[:a] + mid + right[b:]
            k *= 2

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Neighbours joined pairwise, then the pairs, up the tree."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []


def _ends(lists: pa.ListArray) -> np.ndarray:
    """Offsets of the lists in lists.flatten()."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(sizes))).astype("int32")


def cuts(text: str, part_chars: int) -> list[str]:
    """Halves of halves of a text until none is longer than part_chars (code points)."""
    if len(text) <= part_chars:
        return [text]
    half = len(text) // 2
    return cuts(text[:half], part_chars) + cuts(text[half:], part_chars)


def encode(docs: DataFrame, path: str | None = None, part_chars: int = 65_536) -> DataFrame:
    """docs with ids array<int>: the BPE encoding of the whole text, no tokens added; special tokens' strings become their ids.

    Texts of up to part_chars code points are encoded where they lie. Longer ones are halved
    until no part is longer, wherever the cuts fall; the parts are spread over the cluster and
    encoded in parallel, and joined up the tree by encoding growing windows round each join
    until both sides agree. What meets in one task is one document's ids.

    Null and empty texts have no ids. Repeated rows, repeated doc_ids and null doc_ids each keep
    a row of their own. A column of docs named ids is replaced.
    """
    path = path or default_vocabulary()
    docs = docs.drop("ids")
    (mark,) = fresh(docs, "text_hash")
    long = F.char_length("text") > part_chars

    def run(batches):
        codec, none = Codec.at(path), np.empty(0, "uint32")
        for b in batches:
            ids = [codec.encode_array(t) if t else none for t in (x.as_py() for x in b.column("text"))]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype("int32")
            yield b.append_column("ids", pa.ListArray.from_arrays(ends, np.concatenate([none, *ids]).view("int32")))

    whole = docs.where(~F.coalesce(long, F.lit(False)))
    whole = map_arrow(whole, run, whole.withColumn("ids", F.array().cast("array<int>")).schema)

    def split(batches):
        for b in batches:
            for h, t in zip(b.column("text_hash").to_pylist(), (x.as_py() for x in b.column("text"))):
                parts = cuts(t, part_chars)
                for i in range(0, len(parts), 16):
                    some = parts[i : i + 16]
                    yield pa.RecordBatch.from_arrays([pa.array([h] * len(some), pa.string()), pa.array(range(i, i + len(some)), pa.int32()), pa.array(some, pa.string())], names=["text_hash", "part", "text"])

    def join(keys, table):
        ids = table.column("ids")
        ids = Codec.at(path).join_all([ids[int(i)].values.to_numpy().tolist() for i in np.argsort(table.column("part").to_numpy())])
        return pa.Table.from_arrays([pa.array([keys[0].as_py()]), pa.array([ids], pa.list_(pa.int32()))], names=["joined_hash", "ids"])

    marked = docs.where(long).withColumn(mark, F.sha2("text", 256))
    # Of copies of a text one is encoded, so that a group never holds more than one text's ids.
    single = marked.select(F.col(mark).alias("text_hash"), "text").dropDuplicates(["text_hash"])
    parts = map_arrow(single, split, "text_hash string, part int, text string")
    parts = map_arrow(parts.repartition("text_hash", "part"), run, "text_hash string, part int, text string, ids array<int>")
    joined = parts.select("text_hash", "part", "ids").groupBy("text_hash").applyInArrow(join, "joined_hash string, ids array<int>")
    back = marked.join(joined, marked[mark] == joined["joined_hash"]).select(*(marked[c] for c in docs.columns), "ids")
    return whole.union(back)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """tokens with decoded: the text of ids, special tokens included; null for null ids, bytes that are no UTF-8 replaced."""
    path = path or default_vocabulary()
    tokens = tokens.drop("decoded")

    def run(batches):
        codec = Codec.at(path)
        for b in batches:
            yield b.append_column("decoded", codec.decode_lists(b.column("ids")))

    return map_arrow(tokens, run, tokens.withColumn("decoded", F.lit(None).cast("string")).schema)


def ids_digest(tokens: DataFrame) -> DataFrame:
    """tokens with ids replaced by n_tokens and ids_sha256 (ids as little-endian unsigned 32-bit integers)."""

    def run(batches):
        for b in batches:
            ids, ends = b.column("ids").flatten().to_numpy().astype("<u4", copy=False), _ends(b.column("ids"))
            b = b.drop_columns(["ids"]).append_column("n_tokens", pa.array(np.diff(ends), pa.int64()))
            yield b.append_column("ids_sha256", pa.array([hashlib.sha256(ids[i:j]).hexdigest() for i, j in zip(ends[:-1], ends[1:])], pa.string()))

    return map_arrow(tokens, run, tokens.drop("ids").withColumns({"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit("")}).schema)
