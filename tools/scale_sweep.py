"""Cells per second of the two central matrix jobs on generated long matrices.

``python tools/scale_sweep.py 1e6 1e7 1e8``: 400 samples, the rest probes; written once as
Parquet clustered by probe, then read by both jobs.
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from cpgloom.operators.probe_stats import probe_correlation  # noqa: E402
from cpgloom.operators.selection import two_stage  # noqa: E402
from cpgloom.session import local_session  # noqa: E402

SAMPLES = 400


def main(sizes: list[int]) -> None:
    spark = local_session(cores="8", shuffle_partitions=32)
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="run-")
    for cells in sizes:
        s, p = F.col("id") % SAMPLES, F.floor(F.col("id") / SAMPLES)
        age = 18.0 + (s * 37 % 720) / 10.0
        noise = (F.xxhash64("id") % 1000).cast("double") / 4000.0
        beta = F.when(F.xxhash64("id", F.lit(1)) % 20 == 0, None).otherwise(0.4 + age / 400.0 * (p % 9) / 8.0 + noise)
        path = f"{folder}/{cells}"
        spark.range(cells).select(p.alias("probe_ord"), s.cast("int").alias("sample_id"), beta.alias("beta"), age.alias("age")).write.parquet(path)
        df = spark.read.parquet(path)
        for name, job in (("correlation", probe_correlation), ("two_stage", lambda d: two_stage(d, 10_000, 2_000))):
            start = time.perf_counter()
            job(df).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            print(f"{name} cells={cells:.0e} seconds={took:.2f} cells/s={cells / took:.3g}", flush=True)


if __name__ == "__main__":
    main([int(float(x)) for x in sys.argv[1:]] or [10**6, 10**7])
