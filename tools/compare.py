"""Run registered queries and their SQL side by side on one data folder.

    python tools/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gleaner.catalog import QUERIES, SQL  # noqa: E402
from gleaner.session import build_session  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    text = frame.apply(lambda col: col.map(lambda v: "<null>" if pd.isna(v) else str(v)))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con, bad = build_session(**{"spark.ui.showConsoleProgress": "false"}), connect(folder), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        started = time.time()
        try:
            frame = QUERIES[name](spark, folder)
            got = frame.toPandas()
        except Exception as error:
            bad += 1
            place = traceback.format_tb(error.__traceback__)[-6:]
            print(f"{name:20s} FAILED {str(error)[:800]}\n{''.join(place)}", flush=True)
            continue
        spark_s, started = time.time() - started, time.time()
        if name not in SQL:
            print(f"{name:20s} rows={len(got):7d} {spark_s:6.1f}s (no SQL)", flush=True)
            continue
        try:
            want = con.execute(SQL[name]).df()
        except Exception as error:
            bad += 1
            print(f"{name:20s} SQL FAILED {str(error)[:600]}", flush=True)
            con = connect(folder)
            continue
        duck_s = time.time() - started
        note = "ok"
        if sorted(got.columns) != sorted(want.columns):
            note = f"COLUMNS {sorted(got.columns)} {sorted(want.columns)}"
        elif len(got) != len(want):
            note = f"ROWS {len(got)} {len(want)}"
        else:
            left, right = canonical(got), canonical(want)
            if not left.equals(right):
                differ = (left != right).any(axis=1)
                note = f"VALUES {differ.sum()}\n{left[differ].head(3).to_string()[:900]}\n{right[differ].head(3).to_string()[:900]}"
        bad += note != "ok"
        print(f"{name:20s} rows={len(got):7d} {spark_s:6.1f}s duck {duck_s:5.1f}s {note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
