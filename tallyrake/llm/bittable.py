"""Sets of 64-bit hashes as a bounded table of bits, built by Spark and sent to the tasks.

A full table lets more rows through; it never misses one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
PAGE = 1 << 19                    # cells of a page of the bit table


def _pages(shift: int):
    def run(batches):
        pages = {}
        for batch in batches:
            cells = (np.asarray(batch.column(1)).view(U) >> U(shift)).astype(np.int64)
            for page in np.unique(cells // PAGE):
                bits = pages.setdefault(int(page), np.zeros(PAGE, np.uint8))
                bits[cells[cells // PAGE == page] % PAGE] = 1
        for page, bits in pages.items():
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int64()),
                                              pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())],
                                             ["page", "bits"])
    return run


def bit_table(rows: DataFrame, filter_bits: int) -> np.ndarray:
    """One bit per cell of the hash space, set where an ``fp`` of ``rows`` lies: about 16 cells a
    row, at most filter_bits (so at most filter_bits / 8 bytes reach the driver and the tasks)."""
    cells = min(filter_bits, max(PAGE, 1 << (16 * rows.count()).bit_length()))
    shift = 64 - (cells.bit_length() - 1)
    pages = (rows.select(F.shiftrightunsigned("fp", shift + PAGE.bit_length() - 1).alias("page"), "fp")
             .repartition("page").mapInArrow(_pages(shift), "page long, bits binary"))
    table = np.zeros(cells // 8, np.uint8)
    for row in pages.toLocalIterator():
        at = row["page"] * (PAGE // 8)
        table[at:at + PAGE // 8] |= np.frombuffer(row["bits"], np.uint8)
    return table


def marked(fp: np.ndarray, table: np.ndarray) -> np.ndarray:
    """True where the cell of a 64-bit hash is set."""
    cell = (fp >> U(64 - (len(table).bit_length() + 2))).astype(np.int64)
    return (table[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
