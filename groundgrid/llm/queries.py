"""The corpus queries op1 to op13 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, embeddings, lines, negatives, quality, secrets, simhash, suffixes, toxicity, trie, unigram
from .common import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.range(2, numPartitions=1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    every = turns.union(more)
    done = chat.format_conversations(every.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    read = chat.read_turns(F.col("formatted"))
    done = done.withColumns({"turns": read, "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))})
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (SELECT *, 19 + length(role || text) * 2 - length(replace(replace(replace(role || text, '~', ''), '<', ''), '[', '')) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op2_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = unigram.token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_tokens", "n_words", "n_unknown")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3)
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    done = done.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"))
    return done.withColumn("contaminated", F.col("n_hit") > 0)


OP4_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM words, sizes WHERE len(w) >= k)),
found AS (SELECT p.doc_id, p.i, p.k, t.item_id FROM places p JOIN windows t ON p.k = t.k AND p.s = t.s),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
  coalesce(n.items_sha256, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM words d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id
"""


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), 0.98)


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
rows AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM rows),
first AS (SELECT key, min(doc_id) AS doc FROM keyed WHERE length(key) >= 10 GROUP BY key)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (f.doc <> k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (f.doc IS NULL OR f.doc = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN first f ON k.key = f.key AND length(k.key) >= 10 GROUP BY k.doc_id
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~held)
    done = toxicity.score(docs, model)
    return done.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")
    done = bpe.decode(tokens).withColumn("decoded_sha256", F.sha2(F.col("decoded").cast("binary"), 256)).drop("decoded")
    return bpe.ids_digest(done).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), ~held)
    done = quality.score(docs, model)
    return done.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return done.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(secrets.written(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"), c - c % 100, crc_mod(c, 6), 5)


OP11_SQL = """
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY n) AS l FROM turns GROUP BY conv_id),
steps AS (SELECT conv_id, flatten(list_transform(str_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ord(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS s FROM own),
heads AS (SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), s), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END), CAST(4294967295 AS BIGINT)) % 6 AS h FROM steps),
rebuilt AS (SELECT o.conv_id, list_concat(coalesce(b.l[1:h.h], []), o.l[h.h + 1:len(o.l)]) AS l
  FROM own o JOIN heads h ON h.conv_id = o.conv_id LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
path AS (SELECT conv_id, len(l) AS total, d, sha256(CAST(l[1:d] AS JSON)) AS node, CASE WHEN d > 0 THEN sha256(CAST(l[1:d - 1] AS JSON)) END AS parent, CASE WHEN d > 0 THEN length(l[d].t) ELSE 0 END AS chars
  FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT node, d, min(conv_id) AS conv_id, max(parent) AS parent, count(*) AS n_convs, max(chars) AS chars, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (total = d) AS ends FROM path GROUP BY node, d),
children AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
above AS (SELECT DISTINCT a.node AS up, b.node FROM path a JOIN path b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS (SELECT up, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved FROM above JOIN nodes n ON n.node = above.node LEFT JOIN children c ON c.parent = n.node GROUP BY up)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN children c ON c.parent = n.node JOIN sums s ON s.up = n.node
"""


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), 100)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, k, substr(h, 1000 * k + 1, 1198) AS p FROM (SELECT doc_id, h, unnest(range(0, (len(h) // 2 - 100) // 500 + 1)) AS k FROM d WHERE len(h) >= 200)),
windows AS (SELECT doc_id, 500 * k + i AS j, md5(substr(p, 2 * i + 1, 200)) AS w FROM (SELECT *, unnest(range(0, len(p) // 2 - 99)) AS i FROM pieces)),
firsts AS (SELECT w, min({'d': doc_id, 'j': j}) AS f FROM windows GROUP BY w HAVING count(*) > 1),
again AS (SELECT doc_id, j FROM windows JOIN firsts USING (w) WHERE f.d <> doc_id OR f.j <> j),
begun AS (SELECT doc_id, j, coalesce(lag(j) OVER (PARTITION BY doc_id ORDER BY j) + 100 < j, true) AS new FROM again),
runs AS (SELECT doc_id, min(j) AS a, max(j) + 100 AS z FROM (SELECT doc_id, j, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY j) AS g FROM begun) GROUP BY doc_id, g),
kept AS (SELECT doc_id, z AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000) AS z FROM (SELECT doc_id, a, z FROM runs UNION ALL SELECT doc_id, -1, 0 FROM d)),
texts AS (SELECT d.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS h FROM kept JOIN d USING (doc_id) GROUP BY d.doc_id),
counts AS (SELECT doc_id, sum(z - a) AS n, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(t.h)) AS kept_sha256
FROM d JOIN texts t USING (doc_id) LEFT JOIN counts c USING (doc_id)
"""


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(negatives.prepared(vectors.withColumn("label", moved)), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT vec_id, label, list_transform(e, lambda x: CAST(floor(256 * x) AS BIGINT)) AS c FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(CAST(a.c AS DOUBLE[]), CAST(b.c AS DOUBLE[])) AS BIGINT) AS score
  FROM ok a JOIN ok b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_unigram": op2_unigram,
    "op3_simhash": op3_simhash,
    "op4_decontamination": op4_decontamination,
    "op5_embeddings": op5_embeddings,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_quality": op9_quality,
    "op10_secrets": op10_secrets,
    "op11_trie": op11_trie,
    "op12_suffixes": op12_suffixes,
    "op13_negatives": op13_negatives,
}

ORACLES: dict[str, str] = {"op1_chat": OP1_SQL, "op5_embeddings": OP5_SQL, "op4_decontamination": OP4_SQL, "op6_line_dedup": OP6_SQL, "op11_trie": OP11_SQL, "op12_suffixes": OP12_SQL, "op13_negatives": OP13_SQL}
