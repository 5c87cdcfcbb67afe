"""Work that must follow the length of the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.functions import text


def test_offsets_take_few_additions_a_piece(spark):
    """Half of CHUNK additions a piece, and the square of what is left after LEVELS chunkings; it was 256 a piece."""
    pieces = 1_000_000
    assert pieces * text.CHUNK / 2 + (pieces / text.CHUNK**text.LEVELS) ** 2 < 10 * pieces
    df = spark.range(4).select(F.repeat(F.lit("é b "), 12_500).alias("t")).select(text.pieces(F.col("t")).alias("p"))
    last = df.select(text.starts(F.col("p")).alias("s")).agg(F.min(F.element_at("s", -1)), F.min(F.size("s")), F.min(F.element_at("s", 40_003))).first()
    assert tuple(last) == (62_500, 50_001, 50_003)
