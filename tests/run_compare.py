"""Command line: python tests/run_compare.py <folder> [query ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry
from compare import connect, differences
from glyphwarden.session import build_session

if __name__ == "__main__":
    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("OFF")
    connection = connect(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        try:
            started = time.time()
            df = run(spark, folder)
            if name in oracles:
                notes = differences(df, connection, oracles[name])
            else:
                notes = [] if df.count() else ["empty result"]
            state = "ok  " if not notes else "DIFF"
            extra = "" if name in oracles else " (rows only)"
            print(f"{state} {name} {time.time() - started:.2f}s{extra}", *[n[:1500] for n in notes], sep="\n     ", flush=True)
            bad += bool(notes)
        except Exception as error:  # keep going, report all
            bad += 1
            print(f"FAIL {name} {str(error)[:900]}", flush=True)
    print("not equal:", bad)
