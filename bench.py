"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import contextlib
import io
import json
import os
import sys
import time

from pyspark.sql import functions as F

from siteloom.operators.parse import parse_pages
from siteloom.operators.select import select
from siteloom.operators.scrape import sample, scrape
from siteloom.operators.summary import SHORT, summarize
from siteloom.queries import inputs as I
from siteloom.queries import linking, pages, planning, scraping
from siteloom.session import balance, build_session


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    # the session's start and the saved inputs are not part of any query
    run(parse_pages(balance(I.pages(spark, sf))))
    docs, site, index = I.docs(spark, sf), I.site_docs(spark, sf), I.site_index(spark, sf)
    queries = {
        "d1_parse_pages": lambda: parse_pages(balance(I.pages(spark, sf))),
        "d8_summarize": lambda: summarize(docs, **SHORT),
        "x1_article_p": lambda: select(docs, "article p"),
        "x6_scrape_customers": lambda: scrape(I.customer_levels(spark, sf), site, index=index).rows,
        "x6_scrape_suppliers": lambda: scrape(I.supplier_levels(spark, sf), site, index=index).rows,
        "x4_cards": lambda: scraping.x4_items(spark, sf),
        "x7_sample": lambda: sample(I.customer_levels(spark, sf), site, 3, index=index),
        "u1_normalize_url": lambda: pages.u1_normalize_url(spark, sf),
        "d4_class_frequency": lambda: pages.d4_class_frequency(spark, sf),
        "d9_find_values": lambda: pages.d9_find_values(spark, sf),
        "n2_link_pool": lambda: linking.n2_link_pool(spark, sf),
        "l3_schema_edits": lambda: planning.l3_schema_edits(spark, sf),
        "m2_merged_fields": lambda: planning.m2_merged_fields(spark, sf),
        "b1_schema_requests": lambda: planning.b1_schema_requests(spark, sf),
    }
    seconds = {}
    for name, make in queries.items():
        best = None
        for _ in range(2):
            started = time.perf_counter()
            with contextlib.redirect_stdout(io.StringIO()):
                run(make())
            took = time.perf_counter() - started
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries (best of two runs each)",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")),
                "pages": docs.count(),
                "pages_per_second_parsed": round(docs.count() / seconds["d1_parse_pages"]),
            }
        )
    )
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
