import hashlib
import math
import zipfile
import zlib

import pytest

import corpus_pipeline
from corpusloom.llm import media, queries


def test_png_round_trip_and_damage():
    for payload in (b" " * 192, bytes(range(192)) * 3, b"\x89PNG" * 48 * 50):
        stored = media.encode_png(payload)
        assert media.decode_png(stored) == payload
        with pytest.raises((ValueError, zlib.error)):
            media.decode_png(stored[:60] + bytes([stored[60] ^ 1]) + stored[61:])
    with pytest.raises(ValueError):
        media.decode_png(b"GIF89a")
    assert len(media.padded(b"")) == 192 and len(media.padded(b"x" * 192)) == 192 and len(media.padded(b"x" * 193)) == 384


def test_query_on_odd_rows(odd_docs, no_docs, monkeypatch):
    spark = odd_docs.sparkSession
    monkeypatch.setattr(queries, "table", lambda spark, sf, name: odd_docs)
    got = sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.doc_id or -1) for r in queries.op7_media_columns(spark, "").collect())
    want = []
    for r in odd_docs.collect():
        raw = (r.text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        want.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), r.doc_id or -1))
    assert got == sorted(want)
    monkeypatch.setattr(queries, "table", lambda spark, sf, name: no_docs)
    assert queries.op7_media_columns(spark, "").count() == 0


def test_ranges_and_damaged_members(odd_docs, tmp_path):
    spark, path = odd_docs.sparkSession, f"file://{tmp_path}/archives"
    members = media.text_media(odd_docs).coalesce(1)
    media.write_archives(members, path, archive_bytes=1000)
    archives = sorted((tmp_path / "archives").glob("*.zip"))
    assert len(archives) > 2
    whole = media.read_archives(spark, path, range_bytes=300)
    assert whole.rdd.getNumPartitions() > len(archives)
    assert whole.count() == odd_docs.count() and whole.filter("error is not null").count() == 0
    with zipfile.ZipFile(archives[0]) as z:
        at = z.infolist()[0].header_offset + 60
    data = bytearray(archives[0].read_bytes())
    data[at] ^= 0xFF
    archives[0].write_bytes(data)
    rows = media.media_features(media.read_archives(spark, path, range_bytes=300)).collect()
    broken = [r for r in rows if r.error]
    assert len(rows) == odd_docs.count() and len(broken) == 1 and broken[0].payload_sha256 is None and "damaged" in broken[0].error


def test_appends_add_up_and_overwriting_replaces(odd_docs, tmp_path):
    spark, path = odd_docs.sparkSession, f"file://{tmp_path}/archives"
    part = lambda n: media.text_media(odd_docs.filter(f"doc_id = {n}"))
    ids = lambda: sorted(r.doc_id for r in media.read_archives(spark, path).collect())
    media.write_archives(part(1), path)
    media.write_archives(part(3), path)
    media.write_archives(part(777), path)  # a commit without members
    assert ids() == [1, 1, 3]
    media.write_archives(part(4), path, mode="overwrite")
    assert ids() == [4]
    media.write_archives(part(5), path)
    assert ids() == [4, 5]


def test_features_equal_plain_loops():
    for raw in (b"", b"abc" * 100, bytes(range(256)) * 7, "é漢🙂 ".encode() * 333, b"z" * 192):
        payload = media.padded(raw)
        n = len(payload)
        mean = sum(payload) / n
        spread = max(0.0, sum(b * b for b in payload) / n - mean * mean) ** 0.5
        shares = [payload.count(bytes([v])) / n for v in range(256)]
        entropy = abs(-sum(p * math.log2(p) for p in shares if p))
        bits = "".join("1" if sum(payload[a:b]) / (b - a) > mean else "0" for a, b in ((k * n // 64, (k + 1) * n // 64) for k in range(64)))
        assert media.features(payload) == f"rows={n // 192};mean={mean:.4f};std={spread:.4f};entropy={entropy:.4f};blocks={int(bits, 2):016x}"


def test_pipeline_keeps_columns_and_drops_copies(spark, mixed_docs, no_docs, no_labels, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf, name: no_labels)
    docs = mixed_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == mixed_docs.columns
    kept = sorted((r.doc_id for r in docs.collect()), key=str)
    assert {1, *range(100, 140)} <= set(kept) and not {2, 3, 4, 5, 10, 11, 12} & set(kept)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sorted({r.doc_id for r in rows}, key=str) == sorted(set(kept), key=str)
    empty = no_docs
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0


def test_run_is_its_stages(spark):
    from pathlib import Path

    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("driver tables are not here")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, docs.collect())) == sorted(map(key, corpus_pipeline.run(spark, sf).collect()))
