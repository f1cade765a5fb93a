"""Merging Parquet files by copying their encoded column blocks.

No page is decompressed or decoded: row groups are copied byte for byte, and only the footer is written anew, with every offset
moved by the distance its row group moved.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
import pyarrow.parquet as pq

from leafwork.sources import thrift

MAGIC = b"PAR1"
COPY_BYTES = 8 << 20

# Field numbers of the Parquet format's Thrift structures (fixed values).
FILE_SCHEMA, FILE_ROWS, FILE_GROUPS, FILE_PAIRS = 2, 3, 4, 5
GROUP_COLUMNS, GROUP_OFFSET, GROUP_ORDINAL = 1, 5, 7
CHUNK_PATH, CHUNK_OFFSET, CHUNK_META = 1, 2, 3
CHUNK_INDEXES = (4, 5, 6, 7)
META_SIZE, META_DATA, META_INDEX, META_DICTIONARY, META_BLOOM = 7, 9, 10, 11, (14, 15)


class IncompatibleFile(ValueError):
    """A file whose blocks cannot be copied behind the others': other schema, encrypted, or not whole."""


def read_footer(fs: pafs.FileSystem, path: str) -> dict:
    """The parsed footer of a Parquet file."""
    size = fs.get_file_info(path).size
    with fs.open_input_file(path) as f:
        if size is None or size < 12 or f.read_at(4, 0) != MAGIC or (tail := f.read_at(8, size - 8))[4:] != MAGIC:
            raise IncompatibleFile(f"{path}: not a plain Parquet file")
        n = int.from_bytes(tail[:4], "little")
        if n + 12 > size:
            raise IncompatibleFile(f"{path}: the footer is longer than the file")
        return thrift.Reader(f.read_at(n, size - 8 - n)).struct()


def _columns(group: dict) -> list[dict]:
    return group[GROUP_COLUMNS][1][1]


def _start(chunk: dict) -> int:
    meta = chunk[CHUNK_META][1]
    return min(meta[f][1] for f in (META_DATA, META_DICTIONARY) if f in meta and (f == META_DATA or meta[f][1] > 0))


def merge(fs: pafs.FileSystem, inputs: list[str], output: str) -> dict:
    """Copy all row groups of ``inputs`` into ``output`` and return its row, block and byte counts.

    Inputs without rows add no block. Files of unlike schema raise ``IncompatibleFile``; so does a result whose block or row
    count, read back from disk, is not the sum of the inputs'. The output appears under its name only when it is whole; every
    attempt writes under a name of its own until then.
    """
    footers = [(p, read_footer(fs, p)) for p in inputs]
    first = footers[0][1]
    groups, rows, at, temporary = [], 0, len(MAGIC), f"{output.rpartition('/')[0]}/_{uuid.uuid4().hex}-{output.rpartition('/')[2]}"
    with fs.open_output_stream(temporary) as out:
        out.write(MAGIC)
        for path, footer in footers:
            if footer[FILE_SCHEMA] != first[FILE_SCHEMA]:
                raise IncompatibleFile(f"{path}: its schema is not that of {inputs[0]}")
            rows += footer[FILE_ROWS][1]
            with fs.open_input_file(path) as f:
                for group in footer[FILE_GROUPS][1][1]:
                    for chunk in _columns(group):
                        if CHUNK_PATH in chunk or CHUNK_META not in chunk:
                            raise IncompatibleFile(f"{path}: its columns are in other files or encrypted")
                        meta, begin = chunk[CHUNK_META][1], _start(chunk)
                        left, shift = meta[META_SIZE][1], at - begin
                        at += left
                        while left:
                            data = f.read_at(min(left, COPY_BYTES), begin)
                            if not data:
                                raise IncompatibleFile(f"{path}: a column block ends too early")
                            out.write(data)
                            begin, left = begin + len(data), left - len(data)
                        for field in (META_DATA, META_INDEX, META_DICTIONARY):
                            if field in meta and meta[field][1] > 0:
                                meta[field][1] += shift
                        for field in META_BLOOM:
                            meta.pop(field, None)
                        for field in CHUNK_INDEXES:
                            chunk.pop(field, None)
                        chunk[CHUNK_OFFSET][1] = 0
                    if GROUP_OFFSET in group:
                        group[GROUP_OFFSET][1] = _start(_columns(group)[0])
                    if GROUP_ORDINAL in group:
                        group[GROUP_ORDINAL][1] = len(groups)
                    groups.append(group)
        footer = first | {FILE_ROWS: [thrift.I64, rows], FILE_GROUPS: [thrift.LIST, (thrift.STRUCT, groups)]}
        data = thrift.write(thrift.STRUCT, footer)
        out.write(data + len(data).to_bytes(4, "little") + MAGIC)
    with fs.open_input_file(temporary) as f:
        found = pq.ParquetFile(f).metadata
        if (found.num_rows, found.num_row_groups) != (rows, len(groups)):
            raise IncompatibleFile(f"{output}: {found.num_rows} rows in {found.num_row_groups} blocks, not {rows} in {len(groups)}")
    if fs.get_file_info(output).type != pafs.FileType.NotFound:  # an earlier attempt of the same task
        fs.delete_file(output)
    fs.move(temporary, output)
    return {"rows": rows, "blocks": len(groups), "bytes": fs.get_file_info(output).size}
