"""python -m glossmill.cli FOLDER COMMAND: the store's commands over a folder of Parquet tables."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from glossmill.config import checked_limit
from glossmill.operators.planner import cited_answers, run_plan
from glossmill.operators.queries import query_terms
from glossmill.plans import common, quality, retrieval
from glossmill.session import remove_written, session

COMMANDS = {"stats": quality.a1_store_counts, "doctor": quality.d2_mapping_audit, "evaluate": retrieval.e2_mean_metrics}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="glossmill")
    parser.add_argument("folder")
    parser.add_argument("command", choices=[*COMMANDS, "search", "answer"])
    parser.add_argument("--query", default="")
    parser.add_argument("--mode", default="hybrid", choices=[*retrieval.MODES, "hybrid"])
    parser.add_argument("--limit", type=int, default=8)
    a = parser.parse_args(argv)
    limit = checked_limit(a.limit)
    spark = session()
    if a.command in COMMANDS:
        rows = COMMANDS[a.command](spark, a.folder)
    else:
        q = spark.createDataFrame([("q", a.query)], "query_id string, query string")
        q = q.join(query_terms(q, common.lexicon(spark, a.folder)), "query_id")
        p = common.paragraphs(spark, a.folder)
        if a.command == "answer":
            plan = retrieval.plan_of(spark, a.folder, q)
            fused = run_plan(plan, lambda x, n: retrieval.search(spark, a.folder, a.mode, x, n), limit, common.lexicon(spark, a.folder))
            rows = cited_answers(q, fused.select("query_id", "row_id", "rank"), p)
        else:
            shown = p.select(F.col("paragraph_id").alias("row_id"), "title", "page_start", common.T.quote(F.col("text")).alias("quote"))
            rows = retrieval.search(spark, a.folder, a.mode, q, limit).join(shown, "row_id").orderBy("rank")
    for line in rows.toJSON().take(max(limit, 100)):
        print(json.dumps(json.loads(line), ensure_ascii=False))
    remove_written(spark)


if __name__ == "__main__":
    main()
