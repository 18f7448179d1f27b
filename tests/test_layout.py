"""Long paragraphs, long joins and image headers."""

import time

from pyspark.sql import functions as F

from quire.functions.text import join_lines
from quire.publish.validate import probe_image
from quire.sources.layout import layout_runs


def test_a_long_paragraph_takes_linear_time(spark):
    docs = spark.createDataFrame([(1, "word " * 20_000), (2, None), (3, "")], "doc_id long, text string")
    began = time.time()
    assert layout_runs(docs).count() == 20_000
    assert time.time() - began < 20


def test_many_lines_join(spark):
    lines = spark.createDataFrame([(["ab-", "cd"] * 3000 + ["re-", "al"],), ([],), (["one"],)], "t array<string>")
    got = [r[0] for r in lines.select(join_lines(F.col("t"))).collect()]
    assert got == [" ".join(["abcd"] * 3000) + " re- al", "", "one"]


def test_image_headers(spark):
    jpeg = bytes([0xFF, 0xD8, 0xFF, 0xE0, 0, 4, 1, 2, 0xFF, 0xC4, 0, 3, 9, 0xFF, 0xC2, 0, 17, 8, 0x03, 0x20, 0x02, 0x58, 3]) + bytes(12)
    png = bytes.fromhex("89504e470d0a1a0a0000000d49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    gif = b"GIF89a" + (320).to_bytes(2, "little") + (200).to_bytes(2, "little")
    rows = spark.createDataFrame([(1, jpeg), (2, png), (3, gif), (4, jpeg[:8]), (5, b"GIF00a1234"), (6, None), (7, png[:20])], "k int, data binary")
    got = {r["k"]: r["i"] and tuple(r["i"]) for r in rows.select("k", probe_image(F.col("data")).alias("i")).collect()}
    assert got == {1: ("image/jpeg", 600, 800), 2: ("image/png", 640, 480), 3: ("image/gif", 320, 200), 4: None, 5: None, 6: None, 7: None}


def test_size_guard_takes_linear_time(spark):
    """A hundred thousand blocks in one chapter; a fold that copies what it made would take its square."""
    from pyspark.sql import functions as F

    from quire.operators.toc import guard_size

    n, largest = 100_000, 900
    blocks = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("chapter"), F.col("id").cast("int").alias("ord"), F.when(F.col("id") % 9 < 2, "list").otherwise("p").alias("kind"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    got = [(r["ord"], r["weight"], r["kind"], r["part"]) for r in guard_size(blocks, largest).orderBy("ord").collect()]
    part = held = count = 0
    for _, weight, kind, p in got:
        if held + weight > largest and count and kind == "p":
            part, held, count = part + 1, 0, 0
        held, count = held + weight, count + 1
        assert p == part
    assert len(got) == n and part > 1000
