"""Files of the unix compress program (.Z), which Spark's text reader does not know."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAGIC = b"\x1f\x9d"


def expand(data: bytes) -> bytes:
    """The plain bytes of a .Z file: Lempel-Ziv-Welch with codes of 9 bits and more, lowest bit first, in groups of eight codes."""
    if data[:2] != MAGIC or len(data) < 3:
        raise ValueError("no compressed file")
    most, clears = data[2] & 31, bool(data[2] & 128)
    if not 10 <= most <= 16:  # files said to stop at nine bits don't, and programs differ in how they read them
        raise ValueError(f"codes of at most {most} bits")
    first = 257 if clears else 256
    words = [bytes([i]) for i in range(256)] + [b""] * (first - 256)
    out: list[bytes] = []
    width, at, begun, last = 9, 24, 24, b""
    end = 8 * len(data)

    def aligned() -> int:
        """Where the next group of eight codes of this width begins."""
        group = 8 * width
        return begun + -(-(at - begun) // group) * group

    while at + width <= end:
        byte = at >> 3
        code = int.from_bytes(data[byte : byte + 4], "little") >> (at & 7) & (1 << width) - 1
        at += width
        if clears and code == 256:
            at = begun = aligned()
            words, width, last = words[:first], 9, b""
            continue
        if code < len(words):
            word = words[code]
        elif last and code == len(words):
            word = last + last[:1]
        else:
            raise ValueError("a broken compressed file")
        out.append(word)
        if last and len(words) < 1 << most:
            words.append(last + word[:1])
        last = word
        if len(words) >= 1 << width and width < most:
            at = begun = aligned()
            width += 1
    return b"".join(out)


def read_lines(spark: SparkSession, path: str, name_pattern: str = "*.Z") -> DataFrame:
    """(value, file): lines of .Z files. The format has no places to start from, so each file is one task and must fit its memory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name_pattern).load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"]):
                lines = expand(bytes(content)).decode("utf-8", "replace").split("\n")
                lines = lines[:-1] if lines[-1] == "" else lines
                for i in range(0, len(lines), 10_000):
                    part = lines[i : i + 10_000]
                    yield pd.DataFrame({"value": part, "file": [name] * len(part)})

    return files.select("path", "content").mapInPandas(run, "value string, file string")
