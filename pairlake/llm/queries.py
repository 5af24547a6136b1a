"""The registered queries of the training-data operators, over the driver
tables, and their DuckDB SQL where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlake.llm import (
    bpe, chat, decontam, knn, langid, lexical, pii, quality, sharding, simhash, substring, tokenfile, trie)
from pairlake.llm.scratch import scratch_path, written
from pairlake.session import checkpoint_dir, load_table, ship_package

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            checkpoint_dir(spark)
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql.strip()
        return run
    return wrap


def multi_ranks() -> tuple[str, str]:
    """Path of the rank file and the pattern of op1."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op1_byte_bpe")
def op1(spark, sf_dir):
    ranks, pattern = multi_ranks()
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, ranks, pattern).select("doc_id", "ids")
    both = bpe.decode(ids, ranks)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op2_language_id")
def op2(spark, sf_dir):
    return langid.identify(load_table(spark, sf_dir, "pages"), load_table(spark, sf_dir, "documents"))


@query("op3_simhash")
def op3(spark, sf_dir):
    return simhash.near_duplicates(load_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


@query("op4_kd_tree", sql="""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
best AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score
  FROM pair)
SELECT query_id, rank, vec_id, score FROM best WHERE rank <= 5
""")
def op4(spark, sf_dir):
    vectors = load_table(spark, sf_dir, "embeddings")
    return knn.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


_WORDS5 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', " \
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op5_decontamination", sql=f"""
WITH item AS (SELECT item_id, {_WORDS5} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_WORDS5} AS w FROM documents),
win AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM doc, (SELECT DISTINCT k FROM grams) WHERE len(w) >= k)),
hit AS (SELECT w.doc_id, w.k, w.i, g.item_id FROM win w JOIN grams g ON w.k = g.k AND w.g = g.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AS contaminated
FROM doc d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op5(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, load_table(spark, sf_dir, "benchmark"), n=10)
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query("op6_token_file")
def op6(spark, sf_dir):
    import zlib

    import public_tokenizers

    path = scratch_path(spark, "tokens")
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    tokenfile.write_tokens(load_table(spark, sf_dir, "documents"), path,
                           lambda: tokenfile.library_encoder(vocabulary), end_id=2)
    fields = T.StructType([T.StructField("ids_crc32", T.LongType())])
    return tokenfile.read_tokens(spark, path, lambda ids: (zlib.crc32(ids.tobytes()),), fields)


@query("op7_compression_quality")
def op7(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = load_table(spark, sf_dir, "labels").filter(~quality.held_out())
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def _jump_sql(shards: int) -> str:
    """Recursive steps of the jump hash; ``b`` of the last step is the shard."""
    return f"""(WITH RECURSIVE jump AS (
  SELECT doc_id, (CAST(doc_id AS HUGEINT) + 18446744073709551616) % 18446744073709551616 AS k,
         CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM documents
  UNION ALL
  SELECT doc_id, n AS k, j AS b,
         CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST(1 + n // 8589934592 AS DOUBLE))) AS BIGINT) AS j
  FROM (SELECT doc_id, b, j, (k * 2862933555777941757 + 1) % 18446744073709551616 AS n FROM jump WHERE j < {shards}))
SELECT doc_id, CAST(max(b) AS INTEGER) AS shard FROM jump GROUP BY doc_id)"""


_CRC_SQL = """crc AS (  -- the byte table of the checksum, from its rule
  SELECT list(v ORDER BY n) AS t
  FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
                              lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
        FROM (SELECT CAST(range AS BIGINT) AS n FROM range(256))))"""


@query("op8_jump_shards", sql=f"""
WITH {_CRC_SQL},
raw AS (SELECT *, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                                 lambda h: CAST('0x' || h AS BIGINT)) AS x FROM documents),
placed AS (SELECT d.doc_id, CAST(coalesce(strlen(d.text), 0) + 1 AS BIGINT) AS size,
  CAST(xor(list_reduce(list_prepend(4294967295, d.x), lambda a, v: xor(a >> 8, t[(xor(a, v) & 255) + 1])), 4294967295)
       AS BIGINT) AS text_crc32, a.shard, g.shard AS grown_shard
  FROM raw d JOIN {_jump_sql(16)} a USING (doc_id) JOIN {_jump_sql(17)} g USING (doc_id), crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY substr(md5(CAST(doc_id AS VARCHAR) || ':' || CAST(text_crc32 AS VARCHAR)), 1, 3),
    doc_id, text_crc32, size) - 1 AS BIGINT) AS slot, grown_shard
FROM placed
""")
def op8(spark, sf_dir):
    return sharding.shard(load_table(spark, sf_dir, "documents"), 16, keep=["doc_id"])


@query("op9_substring", sql=r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p, len(w) AS n FROM doc),
win AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least
  FROM (SELECT doc_id, p AS i, n, md5(string_agg(x, ' ') OVER (
          PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS g FROM word)
  WHERE i <= n - 49),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win WHERE least < doc_id),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s
  FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.s, '')) AS kept_sha256
FROM doc d LEFT JOIN kept k USING (doc_id)
""")
def op9(spark, sf_dir):
    done = substring.remove_repeats(load_table(spark, sf_dir, "documents"), length=50)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op10_pii")
def op10(spark, sf_dir):
    found = pii.find(load_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin("email", "ip", "card", "phone"))

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("email", "ip", "card", "phone")),
                        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))


_CONTROL = r"<\\*(?:/?s>|</?SYS>>|</?ROLE>>)|\[\\*/?INST\]"
_SAID = "</s>[INST] ok [/INST]"


@query("op11_chat_format", sql=rf"""
WITH turn AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_SAID}'), (-1, 1, 'assistant', '{_SAID}')),
sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROL}'))
    + CASE role WHEN 'system' THEN 8 + 11 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 1 + 5
      ELSE 9 + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) + 11 + 5 END AS chars
  FROM turn)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
""")
def op11(spark, sf_dir):
    rows = chat.turns_of_table(load_table(spark, sf_dir, "conversations"), "conv_id")
    record = F.to_json(F.struct(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(_SAID).alias("content"))
                                          for r in ("user", "assistant")]).alias("messages")))
    added = chat.turns_of_records(spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), record.alias("record")),
                                  "record", "conv_id")
    out = written(chat.format_turns(rows.unionByName(added)), "chat")
    back = out.select("key", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                      chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(F.col("key").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
                       F.length("learned").cast("long").alias("loss_chars"),
                       F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


_TERMS12 = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op12_nra_search", sql=f"""
WITH asked AS (SELECT DISTINCT item_id, unnest({_TERMS12}) AS t FROM benchmark),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS12} AS w FROM documents),
count AS (SELECT count(*) AS n, sum(len(w)) AS l FROM doc WHERE len(w) > 0),
held AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM doc)
  WHERE t IN (SELECT t FROM asked) GROUP BY r, t),
weight AS (
  SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT t, CAST(count(*) AS DOUBLE) AS df FROM held GROUP BY t), (SELECT CAST(n AS DOUBLE) AS n FROM count)),
impact AS (
  SELECT h.r, h.t, w.w * ((1000000000 * h.tf) // (1000 * h.tf + 20 * (50 + CAST((50 * len(d.w) * c.n) // c.l AS BIGINT)))) AS x
  FROM held h JOIN weight w USING (t) JOIN doc d USING (r), count c),
score AS (SELECT item_id, r, CAST(sum(x) AS BIGINT) AS score FROM asked JOIN impact USING (t) GROUP BY item_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM score JOIN doc USING (r) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
""")
def op12(spark, sf_dir):
    return lexical.search(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "benchmark"), k=50)


@query("op13_prefix_trie", sql=f"""
WITH {_CRC_SQL},
turn AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
  WHERE conv_id IS NOT NULL),
conv AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295, x),
    lambda a, v: xor(a >> 8, t[(xor(a, v) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id, list_transform(regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..'),
          lambda d: CAST('0x' || d AS BIGINT)) AS x FROM turn), crc),
part AS (
  SELECT c.conv_id, 0 AS part, t.place, t.role, t.text FROM conv c JOIN turn t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL SELECT c.conv_id, 1, t.place, t.role, t.text FROM conv c JOIN turn t USING (conv_id) WHERE t.place > c.h),
prefix AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes,
    md5(string_agg(md5(role) || md5(text), '') OVER (w ROWS UNBOUNDED PRECEDING)) AS node
  FROM part WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)),
path AS (
  SELECT conv_id, 0 AS depth, 0 AS bytes, '' AS node, NULL AS parent FROM conv
  UNION ALL SELECT conv_id, depth, bytes, node, lag(node, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) FROM prefix),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n, min(parent) AS parent, min(bytes) AS bytes
  FROM path GROUP BY node, depth),
kids AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
total AS (
  SELECT p.node, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((d.n - 1) * d.bytes) AS saved
  FROM nodes d LEFT JOIN kids k ON k.node = d.node JOIN path p ON p.conv_id = d.conv_id AND p.depth <= d.depth
  GROUP BY p.node),
ends AS (
  SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS s
  FROM (SELECT conv_id, max_by(node, depth) AS node FROM path GROUP BY conv_id) GROUP BY node)
SELECT d.conv_id, CAST(d.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(d.n AS BIGINT) AS n_convs,
  CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, CAST(t.leaves AS BIGINT) AS n_leaves,
  CAST(t.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.s, '')) AS ends_sha256
FROM nodes d JOIN total t ON t.node = d.node LEFT JOIN kids k ON k.node = d.node LEFT JOIN ends e ON e.node = d.node
  LEFT JOIN nodes u ON u.node = d.parent
""")
def op13(spark, sf_dir):
    return trie.prefix_trie(*rebuilt(load_table(spark, sf_dir, "conversations")))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations of op13: each conversation c begins with the
    first crc32(c) % 9 turns of conversation c - c % 5 in place of its own."""
    turns = written(trie.digest_turns(conversations), "trie-turns")
    base, h = F.col("conv_id") - F.col("conv_id") % 5, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select("conv_id", "own", base.alias("base"), h.alias("h"))
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = written(convs.join(lengths, "base", "left").select(
        "conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")),
        "trie-conversations")
    first = turns.filter("place <= 8 and conv_id % 5 = 0").withColumnRenamed("conv_id", "base").join(
        convs, "base").filter("place <= h").select("conv_id", "place", "a", "b", "size")
    after = turns.drop("length").join(convs, "conv_id").filter("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "a", "b", "size")
    return first.unionByName(after), convs.select("conv_id", "length")
