"""Archives by position, sprites and references on small cases."""

from quern.operators import archive, references, sprites

ENTRY = "archive long, position int, comment string, meta string, sha256 string, png boolean, metadata boolean, integrity boolean"


def entry(a, p, sha="s", meta="m", comment="", png=True, metadata=False, integrity=False):
    return (a, p, comment, meta, sha, png, metadata, integrity)


def test_archives_by_position(spark):
    before = [entry(1, 0), entry(1, 1, "t"), entry(2, 0), entry(2, 1), entry(3, 0), entry(3, 0), entry(4, 0, png=False), entry(5, 0, "x"), entry(6, 0, metadata=True), entry(7, 0, comment="c"), entry(8, 0), entry(9, 0, integrity=True), entry(9, 1, "q"), entry(None, 0), entry(10, 0, "x"), entry(11, 5, "x"), entry(11, 4, meta="n")]
    after = [entry(1, 0), entry(1, 1, "t2"), entry(2, 0), entry(3, 0), entry(3, 0), entry(4, 0, "z"), entry(5, 0, "y"), entry(6, 0, "z"), entry(7, 0), entry(8, 0), entry(8, 1), entry(9, 0), entry(9, 1, "r"), entry(10, 0, "x"), entry(11, 5, "y"), entry(11, 4), entry(12, 0)]
    a, b = spark.createDataFrame(before, ENTRY), spark.createDataFrame(after, ENTRY)
    assert {tuple(r) for r in archive.changed_pictures(a, b).collect()} >= {("t", "t2"), ("x", "y")}
    pictures = spark.createDataFrame([("t", "t2", True), ("x", "y", False)], "sha256 string, other string, same boolean")
    got = {r["archive"]: (r["verdict"], r["position"]) for r in archive.compare_archives(a, b, spark.createDataFrame([(10,)], "archive long"), pictures).collect()}
    contract, torn = "archive_integrity_contract_requires_publisher", "archive_structure_changed"
    assert got == {
        1: (None, None), 2: (torn, None), 3: (torn, None), 4: ("archive_non_image_payload_changed", 0), 5: ("archive_image_pixels_changed", 0), 6: ("archive_non_image_payload_changed", 0), 7: (torn, None), 8: (torn, None),
        9: (contract, 0), 10: (contract, None), 11: ("archive_entry_metadata_changed", 4), 12: (torn, None),
    }
    assert {r["archive"]: r["verdict"] for r in archive.compare_archives(a, b).collect()}[1] == "archive_image_pixels_changed"


def test_archive_sums_that_overflow(spark):
    e = spark.createDataFrame([(1, "a", 1 << 62, 1), (1, "b", 1 << 62, 1), (2, "a", 5, None)], "archive int, name string, bytes long, compressed long")
    got = {r["archive"]: (r["expanded_bytes"], r["problem"]) for r in archive.totals(e).collect()}
    assert got == {1: (None, "entry_too_large"), 2: (5, None)}


def test_sprites(spark):
    s = spark.createDataFrame([(1, 0, "a", None), (1, 1, "m.matte", None), (1, 2, "b", "m.matte"), (1, 3, "m.matte", "m.matte"), (1, 4, None, "no.matte"), (1, 5, "a", ""), (2, 0, "b", "m.matte")], "movie int, sprite int, image_key string, matte_key string")
    i = spark.createDataFrame([(1, "a", True), (1, "b", False), (1, "m", True), (1, "m", True), (2, "b", True)], "movie int, key string, drawable boolean")
    got = {(r["movie"], r["sprite"]): (r["role"], r["matte"], r["image"]) for r in sprites.resolve(s, i).collect()}
    assert got == {(1, 0): ("plain", None, 0), (1, 1): ("matte", None, 1), (1, 2): ("masked", 3, None), (1, 3): ("matte", None, 1), (1, 4): ("plain", None, None), (1, 5): ("plain", None, 0), (2, 0): ("plain", None, 0)}
    f = spark.createDataFrame([(1, 0, k) for k in range(5)], "movie int, sprite int, frame int")
    shapes = spark.createDataFrame([(1, 0, 1, 1, "x"), (1, 0, 1, 2, "y"), (1, 0, 3, 3, None), (1, 1, 0, 4, "z")], "movie int, sprite int, frame int, seq int, shape string")
    assert {r["frame"]: r["shape"] for r in sprites.frame_shapes(f, shapes).collect()} == {0: None, 1: "y", 2: "y", 3: None, 4: None}


def test_references(spark):
    paths = spark.createDataFrame([(p,) for p in ("a.png", "x/b.png", "y/B.png", "x/c.png", "x/y/d.png", "x/c.png")], "path string")
    texts = [("x/t.html", '<a href="c.png"> "b.png?v" \'/abs/a.png\' `d.png` "no.png" "http://q/a.png" "..\\\\a.png" "../a.png#f" "words" '), ("x.css", "url(a.png) url( x/y/d.png )"), ("r.md", "![i](y/B.png)"), ("t.bin", '"a.png"')]
    refs = references.literals(spark.createDataFrame(texts, "path string, text string"))
    got = {(r["path"], r["value"]): set() for r in refs.collect()}
    for r in references.resolve(refs, paths).collect():
        got[r["path"], r["value"]].add((r["source"], r["how"]))
    assert got == {
        ("x/t.html", "c.png"): {("x/c.png", "local")}, ("x/t.html", "b.png?v"): {("x/b.png", "local")}, ("x/t.html", "/abs/a.png"): {(None, "outside")}, ("x/t.html", "d.png"): {("x/y/d.png", "suffix")}, ("x/t.html", "no.png"): {(None, "missing")},
        ("x/t.html", "http://q/a.png"): {(None, "outside")}, ("x/t.html", "..\\\\a.png"): {(None, "escaped")}, ("x/t.html", "../a.png#f"): {("a.png", "local")}, ("x.css", "a.png"): {("a.png", "local")}, ("x.css", "x/y/d.png"): {("x/y/d.png", "local")}, ("r.md", "y/B.png"): {("y/B.png", "local")},
    }
    lone = spark.createDataFrame([("q/r.md", "b.png"), ("q/r.md", "x/b.png")], "path string, value string")
    assert {tuple(r) for r in references.resolve(lone, paths).select("value", "source", "how").collect()} == {("b.png", "x/b.png", "ambiguous"), ("x/b.png", "x/b.png", "exact")}
    assert references.resolve(lone.limit(0), paths).count() == 0
