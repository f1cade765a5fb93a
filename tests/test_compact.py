import json
import os

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import pytest

from leafwork.operators.compact import compact_parquet, consolidate_cache, normal_key, normal_page, record_members, same_record_pairs
from leafwork.sources.parquet_blocks import IncompatibleFile, merge

K = "ab" * 32


def test_merge_copies_blocks_unchanged(tmp_path):
    tables = [pa.table({"a": [i, None, i + 2], "s": [f"x{i}", "ü", None], "l": [[1, 2], [], None]}) for i in range(5)]
    for i, t in enumerate(tables):
        pq.write_table(t, tmp_path / f"{i}.parquet", compression=["snappy", "zstd", "none", "gzip", "snappy"][i], use_dictionary=i % 2 == 0)
    got = merge(pafs.LocalFileSystem(), [str(tmp_path / f"{i}.parquet") for i in range(5)], str(tmp_path / "out.parquet"))
    assert got["rows"] == 15 and got["blocks"] == 5
    assert pq.read_table(tmp_path / "out.parquet").equals(pa.concat_tables(tables))


def test_merge_refuses_other_schema_and_broken_files(tmp_path):
    pq.write_table(pa.table({"a": [1]}), tmp_path / "a.parquet")
    pq.write_table(pa.table({"b": [1]}), tmp_path / "b.parquet")
    (tmp_path / "c.parquet").write_bytes((tmp_path / "a.parquet").read_bytes()[:-3])
    for other in "bc":
        with pytest.raises(IncompatibleFile):
            merge(pafs.LocalFileSystem(), [str(tmp_path / "a.parquet"), str(tmp_path / f"{other}.parquet")], str(tmp_path / "o.parquet"))
    assert not (tmp_path / "o.parquet").exists()


def test_compact_keeps_every_row(spark, tmp_path):
    spark.range(1000).selectExpr("id", "repeat(cast(id as string), 20) s").repartition(40).write.parquet(str(tmp_path / "in"))
    size = sum(f.stat().st_size for f in (tmp_path / "in").glob("*.parquet"))
    m = compact_parquet(spark, str(tmp_path / "in"), str(tmp_path / "out"), target_bytes=size // 3).collect()
    assert sum(r["rows"] for r in m) == 1000 and len(m) <= 4 and sum(r["source_files"] for r in m) == 40
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 1000 and back.select("id").distinct().count() == 1000
    assert len([f for f in os.listdir(tmp_path / "out") if f.endswith(".parquet")]) == len(m)


@pytest.mark.parametrize("key", [K, K.upper(), f" {K}.json", f"work/ocr_cache/{K}.json.bak", "sha256:" + K, "-".join([K[:8], K[8:]])])
def test_keys(key):
    assert normal_key(key) == K


def test_no_keys():
    assert [normal_key(k) for k in (None, "", "abc", K + "0", "g" * 64)] == [None] * 5


def test_pages_as_values():
    a = normal_page('{"page_index": 1, "blocks": [{"kind": "text", "bbox": [1, 2, 3, 4], "text": "\\u00fc"}]}')
    b = normal_page('{"blocks":[{"bbox":[1.0,2e0,3,4.00],"caption":"","conf":null,"font_scale":1,"kind":"text","text":"ü"}],"page_index":1.0}')
    assert a == b
    assert a != a.replace("\\u00fc", "u") and normal_page('{"a": "1"}') != normal_page('{"a": 1}') and normal_page('{"a": true}') != normal_page('{"a": 1}')
    assert [normal_page(p) for p in (None, "", "null", "[]", '{"a":', '{"a": NaN}', "1")] == [None] * 7


def test_consolidation(spark):
    p = json.dumps({"page_index": 0, "blocks": []})
    rows = [(1, K, p), (2, K.upper(), p), (3, K + ".json", p.replace("0", "0.0")), (4, "cd" * 32, p), (5, K, p.replace("0", "1")), (6, K, None), (7, None, p), (8, "cd" * 32, '{"pa'), (1, K, p)]
    df = spark.createDataFrame(rows, "file_id long, key string, page string").selectExpr("*", "1 as fp", "2 as n")
    done = consolidate_cache(df)
    assert sorted(r[0] for r in done.records.select("file_id").collect()) == [1, 4, 5]
    assert sorted(map(tuple, same_record_pairs(done).collect())) == [(1, 2), (1, 3), (2, 3)]
    assert {r["file_id"]: (r["record"], r["links"]) for r in record_members(done).collect()} == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 0), 5: (5, 0)}
    empty = consolidate_cache(df.limit(0))
    assert empty.records.count() == 0 and same_record_pairs(empty).count() == 0


def test_many_small_files_of_the_cache(spark, tmp_path):
    """One-record files as a cache keeps them, written one by one: merged by size, none lost, none twice."""
    sizes = {}
    for i in range(120):
        pq.write_table(pa.table({"key": [f"{i:064x}"], "page": ["x" * (10 + i % 7 * 400)]}), tmp_path / f"{i}.parquet", compression="none")
        sizes[i] = (tmp_path / f"{i}.parquet").stat().st_size
    out = str(tmp_path / "out")
    m = compact_parquet(spark, str(tmp_path), out, target_bytes=20_000).collect()
    assert sum(r["source_files"] for r in m) == sum(r["rows"] for r in m) == sum(r["blocks"] for r in m) == 120
    assert max(r["source_bytes"] for r in m) <= 20_000 + max(sizes.values()) and len(m) <= 2 * sum(sizes.values()) / 20_000 + 1
    assert spark.read.parquet(out).select("key").distinct().count() == 120 and not [f for f in os.listdir(out) if f.startswith("_")]


def test_hot_record(spark, monkeypatch):
    from leafwork.operators import compact

    monkeypatch.setattr(compact, "SALT_ROWS", 5)
    df = spark.createDataFrame([(i, K, '{"a":1}') for i in range(40)], "file_id long, key string, page string")
    got = same_record_pairs(consolidate_cache(df)).collect()
    assert len(got) == len(set(got)) == 40 * 39 // 2
