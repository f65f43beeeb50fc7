"""What archive comparison shuffles."""

from pyspark.sql import functions as F

from quern.operators import archive


def test_pictures_meet_open_entries_only(spark):
    """Hashes are shuffled packed, texts that are no hex keep apart, and only entries that pixels decide are joined with the pictures."""
    schema = "archive long, position int, comment string, meta string, sha256 string, png boolean, metadata boolean, integrity boolean"
    texts = ["ab", "AB", "ac", "a", "\x01\xab", "", None, "zz"]
    make = lambda shas: spark.createDataFrame([(i, 0, "", "m", s, True, False, False) for i, s in enumerate(shas)], schema)
    a, b = make(texts), make(["ac", *texts[1:6], "ab", "zy"])
    pairs = archive.changed_pictures(a, b)
    assert sorted(tuple(r) for r in pairs.collect()) == [("ab", "ac"), ("zz", "zy")]
    out = archive.compare_archives(a, b, None, pairs.withColumn("same", F.col("sha256") == "ab"))
    want = {i: None for i in range(8)} | {6: "archive_image_pixels_changed", 7: "archive_image_pixels_changed"}
    assert {r["archive"]: r["verdict"] for r in out.collect()} == want
    x = spark.createDataFrame([(p, q) for p in texts for q in texts], "p string, q string")
    assert x.where(~archive._packed(F.col("p")).eqNullSafe(archive._packed(F.col("q"))).eqNullSafe(F.col("p").eqNullSafe(F.col("q")))).count() == 0
    assert x.where(~archive._unpacked(archive._packed(F.col("p"))).eqNullSafe(F.col("p"))).count() == 0
