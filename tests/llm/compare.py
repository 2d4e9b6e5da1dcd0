"""``python -m tests.llm.compare sf0.01 [names]``: queries of the subpackage against their oracle SQL."""

from __future__ import annotations

import sys
import time
from collections import namedtuple

from skytrace.llm.queries import QUERIES
from tests.compare import check, connect

Query = namedtuple("Query", "run sql")


def differs(spark, con, name: str, sf_dir: str) -> str | None:
    return check(spark, con, Query(*QUERIES[name]), sf_dir)


if __name__ == "__main__":
    import __spark_entry__  # noqa: F401  (task functions travel by value)
    from skytrace.session import local_session

    sf = "/root/testdata/" + sys.argv[1]
    spark = local_session("4")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for name in sys.argv[2:] or list(QUERIES):
        start = time.time()
        try:
            said = differs(spark, con, name, sf)
        except Exception as exc:  # report and go on
            said = f"{type(exc).__name__}: {str(exc)[:1500]}"
        print("FAIL" if said else "ok", name, f"{time.time() - start:.1f}", said or "", flush=True)
