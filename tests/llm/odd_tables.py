import os

import duckdb
import pyarrow.parquet as pq


def rows_of(sf_dir, table, columns):
    """Rows of a test table as tuples."""
    p = f"{sf_dir}/{table}.parquet"
    return duckdb.sql(f"SELECT {columns} FROM '{p + '/*.parquet' if os.path.isdir(p) else p}' ORDER BY 1").fetchall()


def write(tmp_path, table, arrow):
    pq.write_table(arrow, tmp_path / f"{table}.parquet")
    return str(tmp_path)


LONG = "lorem ipsum dolor " * 40_000


def odd_documents():
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    import pyarrow as pa

    texts = [None, "", "   \n\t", "one", "One", "a b c d e f g h", "a b c d e f g h", "a b c d e f g i", LONG, "12345 !!", "é ü ß 你好 😀 ▁", "x" * 70_000, "\0nul\0"]
    ids = [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    texts += ["a b c d e f g h", "a b c d e f g h"]
    ids += [6, 6]
    n = len(ids)
    langs = [None, "en", "de"] * n
    return pa.table({
        "doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": langs[:n], "source": [None, "s"] * (n // 2) + ["s"] * (n % 2), "n_chars": pa.array([None] * n, pa.int64()),
        "score": ["clash"] * n, "block": pa.array(range(n)), "component": ["clash"] * n, "__score": ["clash"] * n, "key": [1.5] * n, "label": ["clash"] * n, "TEXT_": [None] * n,
    })


def odd_labels():
    import pyarrow as pa

    return pa.table({"doc_id": pa.array([None, 1, 3, 5, 5, 9, 11, 77], pa.int64()), "quality": pa.array([1, None, 1, 0, 1, 0, 0, 1], pa.int32()), "toxic": pa.array([0, 1, None, 0, 0, 1, 0, 1], pa.int32()), "extra": ["x"] * 8})
