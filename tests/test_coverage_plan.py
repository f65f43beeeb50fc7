"""What coverage of many tables sends to the driver, and how often files are parsed for it."""

from pyspark.sql import functions as F

from quern.operators import localization
from quern.sources import l10n


def test_no_table_that_grows_is_broadcast(spark):
    """Joins of coverage are sorted, however small the tables look, and files are parsed for the entries and for the files' claims only."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    files = [(f"B{i}/{language}.lproj/T.strings", f'"a" = "{i}"; "b" = "%@";'.encode()) for i in range(20) for language in ("en", "de")]
    read = spark.createDataFrame(files, "path string, content binary").mapInArrow(count, "path string, content binary")
    rows = localization.tables(l10n.localization_entries(read))
    got = localization.table_coverage(rows)
    assert got.count() == 40 and got.agg(F.sum("translated")).first()[0] == 80
    assert made.value <= 2 * len(files)
    for df in (rows, localization.table_cells(rows)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
