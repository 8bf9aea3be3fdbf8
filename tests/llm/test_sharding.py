import hashlib
import os

import duckdb
import pytest

from flowlens.llm import sharding as S

SCHEMA = "doc_id long, text string, shard string, page string"


def _brute(rows, limit):
    """Split buckets one bit at a time."""
    def bits(i, t):
        key = f"{'' if i is None else i}:{'' if t is None else hashlib.md5(t.encode()).hexdigest()}"
        return bin(int(hashlib.md5(key.encode()).hexdigest()[:15], 16))[2:].zfill(60)

    out, todo = {}, [("", [(bits(i, t), len((t or "").encode())) for i, t, *_ in rows])]
    while todo:
        prefix, held = todo.pop()
        if sum(b for _, b in held) <= limit or len(prefix) == 60:
            if held:
                out[prefix] = (len(held), sum(b for _, b in held))
        else:
            todo += [(prefix + c, [h for h in held if h[0].startswith(prefix + c)]) for c in "01"]
    return out


ROWS = [(i, "é" * (i * 37 % 90), "clash", None) for i in range(150)] + [
    (None, "no id", None, None), (7, None, None, None), (8, "", None, None), (9, "x" * 5000, None, None)] + [(3, "same", None, None)] * 40


@pytest.mark.parametrize("limit", [60, 400, 3000, 10**9])
def test_buckets_equal_brute_force(spark, limit):
    out = S.shards(spark.createDataFrame(ROWS, SCHEMA), limit).collect()
    assert len(out) == len(ROWS)
    got = {}
    for r in out:
        n, b = got.get(r.shard, (0, 0))
        got[r.shard] = (n + 1, b + r.n_bytes)
        assert r.depth == len(r.shard)
    assert got == {k: v for k, v in _brute(ROWS, limit).items()}
    assert all((r.shard_rows, r.shard_bytes) == got[r.shard] for r in out)


def test_empty_and_no_bytes(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert S.shards(df.limit(0)).count() == 0
    none = S.shards(spark.createDataFrame([(1, None, None, None), (2, "", None, None)], SCHEMA)).collect()
    assert [r.shard for r in none] == ["", ""]


def test_written_shards_hold_every_row(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = os.path.join(tmp_path, "shards")
    S.write_shards(df, path, 400)
    back = spark.read.parquet(path).select("row.*")
    assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0


@pytest.mark.parametrize("limit", [400, 60, 11])
def test_sql_agrees_where_buckets_split(spark, limit):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in ROWS])
    exp = con.execute(S.ORACLE_SQL.replace(str(S.LIMIT_BYTES), str(limit))).fetchall()
    out = S.shards(spark.createDataFrame(ROWS, SCHEMA), limit).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, exp))


@pytest.mark.parametrize("limit", [4, 11, 12, 60])
def test_pages_keep_the_limit(spark, tmp_path, limit):
    df = spark.createDataFrame(ROWS, SCHEMA)
    pages, buckets = {}, {}
    for r in S.shards(df, limit).collect():
        pages.setdefault((r.shard, r.page), []).append(r.n_bytes)
        buckets[r.shard] = max(buckets.get(r.shard, 0), r.page + 1)
    assert all(sum(b) <= limit or len(b) == 1 for b in pages.values())
    assert sum(buckets.values()) == len(pages)           # numbered without gaps
    same = max(pages, key=lambda k: k[1])[0]             # the 40 equal rows of 4 bytes
    assert buckets[same] == -(-40 // (limit // 4))
    path = os.path.join(tmp_path, "shards")
    S.write_shards(df, path, limit)
    back = spark.read.parquet(path)
    sizes = back.selectExpr("shard", "page", "octet_length(row.text) AS b").groupBy("shard", "page").agg({"b": "sum", "*": "count"})
    assert all((r["sum(b)"] or 0) <= limit or r["count(1)"] == 1 for r in sizes.collect())
    assert back.count() == len(ROWS)


def test_repeated_row_above_the_default_limit(spark):
    df = spark.range(3000).selectExpr("1L AS doc_id", "repeat('x', 4096) AS text")
    got = S.shards(df).groupBy("shard", "page").agg({"n_bytes": "sum"}).collect()
    assert len(got) == 3 and all(r["sum(n_bytes)"] <= S.LIMIT_BYTES for r in got)
