"""The registered queries on the driver's smallest tables: against DuckDB where
there is SQL, else against plain libraries."""

import base64
import hashlib
import struct
import zlib

import duckdb
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from pairlake.llm import bpe, queries, quality
from tests.conftest import SF_SMALL
from tools.oracle_check import digest, type_mismatches

from .test_decontam import brute as brute_hits
from .test_pii import plain as plain_spans
from .test_simhash import brute_components, brute_print

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return dict(con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall())


def rows(spark, name):
    return queries.QUERIES[name](spark, SF_SMALL).collect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(queries.SQL[name])
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(columns) and len(got) == len(want)
    assert not type_mismatches(df, con.sql(queries.SQL[name]))
    assert digest(df.columns, got)[0] == digest(columns, want)[0]


def test_op1(spark, docs):
    path, pattern = queries.multi_ranks()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: tuple(r)[1:] for r in rows(spark, "op1_byte_bpe")}
    for d, text in docs.items():
        ids = plain.encode_ordinary(text or "")
        assert got[d] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                          hashlib.sha256((text or "").encode()).hexdigest())
    assert len(got) == len(docs)


def test_op2(spark, con):
    got = {r["page_id"]: r["lang"] for r in rows(spark, "op2_language_id")}
    want = dict(con.execute("SELECT page_id, regexp_extract(html, 'lang=\"(..)\"', 1) FROM pages").fetchall())
    assert got == want


def test_op3(spark, docs):
    got = sorted((tuple(r) for r in rows(spark, "op3_simhash")), key=str)
    assert got == brute_components([(d, brute_print(t)) for d, t in docs.items()], 2)


def test_op6(spark, docs):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    start, want = 0, []
    for d, text in docs.items():
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(tuple(r) for r in rows(spark, "op6_token_file")) == want


def test_op7(spark, con, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op7_compression_quality")}
    labels = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    assert got.keys() == docs.keys()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    right = [got[d]["predicted"] == q for d, q in labels.items() if got[d]["held_out"]]
    assert sum(right) / len(right) > 0.8


def test_op10(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op10_pii")}
    for d, text in docs.items():
        spans = plain_spans(text)
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [
            sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        assert set(f"{k}:{a}:{b}" for k, a, b in spans) <= set(got[d]["spans"].split(","))


def test_pipeline_stage_by_stage(spark, con, tmp_dir):
    path, pattern = queries.multi_ranks()
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = table.columns
    before = {r["doc_id"]: r["text"] for r in table.collect()}
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, SF_SMALL).write.parquet(f"{tmp_dir}/{k}")
        table = spark.read.parquet(f"{tmp_dir}/{k}")
        if name == "encode":
            break
        assert table.columns == columns
        after = {r["doc_id"]: r["text"] for r in table.collect()}
        assert len(after) == table.count()
        if name == "quality":
            docs = spark.createDataFrame(list(before.items()), "doc_id long, text string")
            labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").filter(~quality.held_out())
            scored = quality.score(docs, quality.fit(docs, labels)).collect()
            assert after == {r["doc_id"]: r["text"] for r in scored if r["score"] >= 0.3}
        elif name == "near_duplicates":
            groups = brute_components([(d, brute_print(t)) for d, t in before.items()], 2)
            assert after == {d: before[d] for d, _, least in groups if d == least}
        elif name == "decontamination":
            hits = brute_hits(list(before.items()), items, 10)
            assert after == {d: before[d] for d, _, n, _ in hits if not n}
        elif name == "pii":
            assert after.keys() == before.keys()
            for d, text in before.items():
                assert not plain_spans(after[d]) and (plain_spans(text) or "[" in after[d] or after[d] == text)
        before = after
    plain = tiktoken.Encoding("plain", pat_str=pattern, special_tokens={},
                              mergeable_ranks=bpe.load_ranks(path))
    got = {r["doc_id"]: list(memoryview(bytes(r["ids"])).cast("I")) for r in table.collect()}
    assert got == {d: plain.encode_ordinary(t or "") for d, t in before.items()}
    assert [(r["doc_id"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, SF_SMALL).orderBy("doc_id").collect()] == [
        (d, struct.pack(f"<{len(i)}I", *i)) for d, i in sorted(got.items())]


EDGES = [(None, None, None, None, None), (1, None, "en", "s", None), (2, "", None, None, 0), (3, "word " * 30_000, "en", "s", 9),
         (4, "same text of these words", "en", "s", 1), (5, "same text of these words", "en", "s", 1),
         (5, "same text of these words", "en", "s", 1)]


@pytest.mark.parametrize("edge", ["rows", "empty"])
def test_stages_on_edges(spark, tmp_dir, edge):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(EDGES if edge == "rows" else [], schema)
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([(1, 1, None), (None, 0, 0), (4, None, 1)] if edge == "rows" else [],
                          "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "not in any text")] if edge == "rows" else [],
                          "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    out = corpus_pipeline.run(spark, tmp_dir).collect()
    if edge == "empty":
        assert out == []
    else:  # 1 and 2 have no words alike, 4 and 5 are copies, a row without an id cannot be kept by id
        assert sorted(r["doc_id"] for r in out) == [1, 3, 4]


def test_near_duplicates_keep_one_row_of_each_component(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(1, a, "en"), (5, a, "en"), (5, b, "en"), (5, b, "de"), (None, c, "en"), (None, c, "en"), (7, "d e f", "en"),
            (7, "d e f", "en"), (None, "d e f", "en"), (None, "g h", None), (None, "g h", "en"), (None, "i j k", "en"),
            (None, None, "en"), (9, "", None)]
    docs = spark.createDataFrame([(d, t, g, None, 1) for d, t, g in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = [stage(spark, docs.repartition(n), SF_SMALL).collect() for n in (1, 5)]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1]))
    assert sorted([(r["doc_id"], r["text"]) for r in got[0]], key=str) == sorted(
        [(1, a), (5, b), (None, c), (7, "d e f"), (None, "g h"), (None, "i j k"), (9, "")], key=str)


def test_stages_keep_columns_of_any_name(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    extra = ["score", "_quality", "row", "_row", "place", "n", "N_HIT", "items", "hits", "found", "key", "spans", "x.y", "c0", "Text2", "TEXT"]
    rows = [(i, t, "en", "s", 5, *[f"{c}{i}" for c in extra]) for i, t in ((1, a), (1, a), (2, a), (None, b), (3, b))]
    fields = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"e{i} string" for i in range(len(extra)))
    docs = spark.createDataFrame(rows, fields).toDF("doc_id", "text", "lang", "source", "n_chars", *extra)
    want = {"quality": [0, 1, 2, 3, 4], "near_duplicates": [0, 4], "decontamination": [0, 1, 2, 3, 4], "pii": [0, 1, 2, 3, 4]}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        if name == "near_duplicates":  # one of the rows alike, and one of the near copies
            assert sorted((r[0], r[5]) for r in got) == [(1, "score1"), (3, "score3")]
        elif name != "quality":
            assert sorted(r[5:] for r in got) == sorted(rows[i][5:] for i in want[name])
        else:
            assert all(r in rows for r in got)
    assert [c[0] for c in corpus_pipeline.STAGES[4][1](spark, docs, SF_SMALL).dtypes] == ["doc_id", "ids", "n_tokens"]


def test_entry_lists_every_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op")}
    assert "pipeline" in names and set(queries.SQL) <= set(entry.oracle_sql())
