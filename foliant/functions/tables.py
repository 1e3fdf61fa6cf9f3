"""Table functions with declared schemas, for use from SQL alone: blocks, turns, parts of narrations, and sections out of lines.

register(spark) makes them known by name. Those that take a text yield its pieces; those that take a table work on one partition of it
after the other, in its order (TABLE(t) PARTITION BY ... ORDER BY ...)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from foliant.operators.blocks import stitched, typed_blocks
from foliant.operators.dialogue import MARKS, PAUSES, TAGS

BLOCK = "block_idx int, kind string, content string, level int"


class SplitBlocks:
    """Typed blocks of a text, lines that belong together stitched; a null text has none."""

    def eval(self, text: str) -> Iterator[tuple]:
        for i, (kind, content, level) in enumerate(typed_blocks(stitched(text or ""))):
            yield i, kind, content, level


class SplitTurns:
    """Turns of a dialogue: number, tag (S1, S2 or PAUSE) and text. A null text has none."""

    def eval(self, text: str) -> Iterator[tuple]:
        speaker, i = "S1", 0
        for piece in re.split(f"({TAGS})", text or ""):
            piece = piece.strip()
            if piece in ("[S1]", "[S2]"):
                speaker = piece[1:3]
            elif piece:
                yield i, "PAUSE" if piece in PAUSES else speaker, piece
                i += 1


class SplitNarration:
    """Parts of a narration: number, kind (pause or text) and text. A null text has none."""

    def eval(self, text: str) -> Iterator[tuple]:
        parts = (x.strip() for x in re.split(f"({MARKS})", text or ""))
        for i, piece in enumerate(filter(None, parts)):
            yield i, "pause" if piece in PAUSES else "text", piece


class LineBlocks:
    """Typed blocks out of a table of lines: TABLE(lines) has the partition's column first, then the line's number, then the line. The
    table is divided by the first and ordered by the second column by itself; nulls count as empty lines. A partition's lines are held
    together, no other's."""

    def __init__(self) -> None:
        self.key, self.lines = None, []

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        if not lines.isTable or len(lines.dataType.fields) != 3:
            raise ValueError("line_blocks takes a table of three columns: key, number, line")
        key, number, _ = lines.dataType.fields
        rest = [StructField("block_idx", IntegerType()), StructField("kind", StringType()), StructField("content", StringType()), StructField("level", IntegerType())]
        return AnalyzeResult(StructType([key, *rest]), partitionBy=[PartitioningColumn(f"`{key.name}`")], orderBy=[OrderingColumn(f"`{number.name}`")])

    def eval(self, row: Row) -> None:
        self.key, line = row[0], row[2]
        self.lines.append(line or "")

    def terminate(self) -> Iterator[tuple]:
        for i, (kind, content, level) in enumerate(typed_blocks(stitched("\n".join(self.lines)))):
            yield self.key, i, kind, content, level


def register(spark: SparkSession) -> None:
    """Makes split_blocks, split_turns, split_narration and line_blocks known to SQL."""
    for name, kind, schema in (("split_blocks", SplitBlocks, BLOCK), ("split_turns", SplitTurns, "turn_idx int, tag string, text string"), ("split_narration", SplitNarration, "part_idx int, kind string, text string")):
        spark.udtf.register(name, udtf(kind, returnType=schema))
    spark.udtf.register("line_blocks", udtf(LineBlocks))
