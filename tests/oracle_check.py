"""Run registered queries against their DuckDB oracles (like the driver).

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, ".")
import __spark_entry__ as E  # noqa: E402
from knnhard.session import get_spark  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm_val(x):
    if x is None:
        return None
    if isinstance(x, float):
        if math.isnan(x):
            return None
        return round(x, 6) + 0.0
    if isinstance(x, (np.floating,)):
        return norm_val(float(x))
    if isinstance(x, (np.integer,)):
        return int(x)
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(norm_val(v) for v in x)
    if pd.isna(x) if not isinstance(x, (dict,)) else False:
        return None
    return x


def canon(df: pd.DataFrame):
    cols = sorted(df.columns)
    rows = [tuple(norm_val(r[c]) for c in cols) for r in df[cols].to_dict("records")]
    return cols, sorted(rows, key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_spark()
    qs, os_ = E.queries(), E.oracle_sql()
    con = duck(sf)
    bad = 0
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in os_:
            print(f"ROWS {name}: {len(sdf)} rows (no oracle) {t1 - t0:.1f}s")
            continue
        try:
            ddf = con.execute(os_[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:600]}")
            bad += 1
            continue
        t2 = time.time()
        sc, sr = canon(sdf)
        dc, dr = canon(ddf)
        if sc != dc:
            print(f"FAIL {name}: columns {sc} vs {dc}")
            bad += 1
        elif len(sr) != len(dr):
            print(f"FAIL {name}: rows {len(sr)} vs {len(dr)}")
            bad += 1
        elif sr != dr:
            diff = [(a, b) for a, b in zip(sr, dr) if a != b]
            print(f"FAIL {name}: {len(diff)} differing rows, e.g. {diff[:2]}")
            bad += 1
        else:
            print(f"OK   {name}: {len(sr)} rows  spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s")
    print("bad:", bad)


if __name__ == "__main__":
    main()
